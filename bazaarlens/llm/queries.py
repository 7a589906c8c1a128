"""The registered queries of this subpackage, each over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.storage import materialise
from bazaarlens.llm.bpe import encode, read_ranks
from bazaarlens.llm.chat import format_chats, read_loss, read_turns, threads
from bazaarlens.llm.decontaminate import contamination
from bazaarlens.llm.divergence import divergence
from bazaarlens.llm.interactions import filter_audit
from bazaarlens.llm.langid import held_out, predict, train
from bazaarlens.llm.licenses import license_scan
from bazaarlens.llm.mixing import score
from bazaarlens.llm.neardup import near_duplicates
from bazaarlens.llm.quality import fit, judge, signals
from bazaarlens.llm.shipping import ship
from bazaarlens.llm.substring import substring_dedup
from bazaarlens.llm.suffixes import suffix_dedup
from bazaarlens.llm.urls import apply_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


#: Words between white space, with their place in the document.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op8_substring_dedup",
    rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
    v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
    r AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
    g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM r) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
      sha256(array_to_string(
        CASE WHEN gone IS NULL THEN w
             ELSE list_filter(list_transform(w, lambda x, k: CASE WHEN list_contains(gone, k) THEN NULL ELSE x END),
                              lambda x: x IS NOT NULL) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op10_suffix_dedup",
    r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM d),
    p AS (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM s WHERE n >= 50),
    v AS (SELECT doc_id, i, md5_number(substring(h, CAST(2 * i - 1 AS BIGINT), 100)) AS k FROM p),
    f AS (SELECT k, min(doc_id) AS lowest FROM v GROUP BY k HAVING count(DISTINCT doc_id) > 1),
    r AS (SELECT v.doc_id, v.i FROM v JOIN f USING (k) WHERE f.lowest < v.doc_id),
    g AS (SELECT doc_id, i, sum(CASE WHEN i - coalesce(before, -100) > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
          FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
    m AS (SELECT doc_id, span, min(i) AS a, max(i) + 49 AS b FROM g GROUP BY doc_id, span),
    o AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops, CAST(sum(b - a + 1) AS BIGINT) AS gone FROM m GROUP BY doc_id)
    SELECT s.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, CAST(coalesce(len(starts), 0) AS BIGINT) AS n_spans,
      sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda j:
        substring(h, CAST(CASE WHEN j = 0 THEN 1 ELSE 2 * stops[j] + 1 END AS BIGINT),
                  CAST(CASE WHEN j = len(starts) THEN length(h) ELSE 2 * (starts[j + 1] - 1) END
                    - CASE WHEN j = 0 THEN 0 ELSE 2 * stops[j] END AS BIGINT))), '') END)) AS kept_sha256
    FROM s LEFT JOIN o USING (doc_id)
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op5_decontamination",
    rf"""
    WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
    b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m,
             array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
                 FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
    hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
    c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return contamination(docs, table(spark, folder, "benchmark", "item_id", "text"))


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    measured = materialise(signals(table(spark, folder, "documents", "doc_id", "text")), "signals")
    judged = judge(measured, fit(measured))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, F.round("quality", 6).alias("quality"))


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op7_url_filter",
    r"""
    WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
          FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, folder, "pages", "page_id", "url")
    return apply_rules(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_CONTROL = "<|im_end|><|im_start|>assistant ok"


@query(
    "op9_chat_format",
    rf"""
    WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(32 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT)
        AS formatted_chars
    FROM m GROUP BY conv_id
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, i, r, _CONTROL) for i, r in enumerate(("user", "assistant"))], rows.schema)
    chats = format_chats(threads(rows.unionByName(control)))
    turns, said = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("conv").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op3_minhash_dedup",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.k + nb.k - c)),
    r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
    SELECT r.doc_id, CAST(coalesce(any_value(k), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = train(docs.filter(~held_out("doc_id", 3)))
    judged = predict(docs.select("doc_id", held_out("doc_id", 3).alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "accepted")


#: The public rank file that the BPE queries use; another may be named.
RANKS = "byte_bpe_50k.tiktoken"


def ranks_and_pattern(name: str = RANKS) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents", "doc_id", "text"), *ranks_and_pattern())


@query("op4_context_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text").withColumn("held_out", held_out("doc_id", 5))
    scored = score(docs, ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


_LETTERS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    "op11_source_divergence",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS w FROM documents),
    o AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
    t AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM o GROUP BY lang, term HAVING count(*) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, t.term, t.n AS lang_n, CAST(coalesce(x.n, 0) AS HUGEINT) AS n
          FROM g JOIN t USING (lang)
          LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = t.term),
    s AS (SELECT c.lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY c.lang, source) + 2 * v) AS p,
            1 + 1000000000 * (lang_n + 2) // (total + 2 * v) AS q
          FROM c JOIN l USING (lang)),
    f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
          FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
      CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM r QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents", "lang", "source", "text"))


@query("op12_license_scan")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents", "doc_id", "text")).drop("detections")


@query(
    "op13_filter_audit",
    rf"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    b AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
          FROM w),
    m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
    c AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM b LEFT JOIN m USING (doc_id) GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
    f AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
          FROM f, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, bit,
            sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n * good ELSE 0 END) AS good_lost,
            sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n * toxic ELSE 0 END) AS toxic_lost
          FROM c, s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
      CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
      CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM r
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return filter_audit(docs, table(spark, folder, "labels", "doc_id", "quality", "toxic"))
