"""Encoding, language ID, LM scores, decontamination and quality rules."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import corpora as R
from pyspark.sql import functions as F

from bazaarlens.llm import bpe, langid, quality
from bazaarlens.llm.decontaminate import contamination
from bazaarlens.llm.mixing import score
from bazaarlens.llm.queries import ranks_and_pattern

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def reference_encoding():
    import tiktoken

    ranks, pattern = ranks_and_pattern()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library_and_round_trip(spark):
    own, (ranks, pattern) = reference_encoding(), ranks_and_pattern()
    rows = [r for r in R.hard_documents() if r[0] is not None] + [(200, "q" * 300 + " zq" * 50 + " " * 77 + "\n", None, None, None)]
    coded = bpe.encode(R.documents(spark, rows), ranks, pattern, with_ids=True)
    back = {r["doc_id"]: r for r in bpe.decode(coded, ranks).collect()}
    for doc_id, text, *_ in rows:
        ids, r = own.encode_ordinary(text or ""), back[doc_id]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["text"] == (text or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(R.empty(spark), ranks, pattern).collect() == []
    assert bpe.encode(R.documents(spark), ranks, pattern).count() == len(R.hard_documents())


def test_short_and_long_words_merge_alike():
    ranks, _ = ranks_and_pattern()
    for word in ("thththerebledthe" * 2, "aaaaaaaaaaaaaaaaaaaaaaaaab", "ßüßüßü…—", "of", "e"):
        raw = word.encode()
        assert bpe.merge(raw, ranks) == (bpe._merge_long(raw, ranks) if raw not in ranks else [ranks[raw]])


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out("doc_id", 3)))
    judged = langid.predict(docs.withColumn("held_out", langid.held_out("doc_id", 3)), model).filter("held_out")
    right, total = judged.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.97
    hard = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in langid.predict(R.documents(spark), model).collect()}
    assert {(5, True, True), (6, True, True), (7, True, True), (0, False, False)} <= hard
    untrained = langid.train(R.empty(spark))
    assert {r["lang_pred"] for r in langid.predict(R.documents(spark), untrained).collect()} == {"und"}
    assert langid.predict(R.empty(spark), model).collect() == []


def test_held_out_is_crc32(spark):
    got = spark.range(50).select("id", langid.held_out("id", 3).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def slow_base(rows, train):
    counts = Counter()
    for r in rows:
        if train(r):
            counts.update([*WORD.findall(lower(r[1])), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for r in rows:
        tokens = [*WORD.findall(lower(r[1])), None]
        out[r[0]] = (len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out


def test_scores(spark):
    rows = [r for r in R.hard_documents() if r[0] is not None]
    want = slow_base(rows, lambda r: r[0] % 3 != 1)
    got = score(R.documents(spark, rows), F.col("doc_id") % 3 != 1).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens, known, n, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    assert score(R.empty(spark), F.lit(True)).collect() == []
    unseen = score(R.documents(spark), F.lit(False)).filter("doc_id = 0").first()
    assert unseen["train_tokens"] == 0 and unseen["n_known"] == 0


def test_scores_are_a_distribution(spark):
    """All texts that begin alike cannot have more than the beginning's probability: here, one word and an end."""
    train = [(i, "ab abc ab", None, None, None) for i in range(20)]
    words = [f"{a}{b}" for a in "abcde" for b in ["", *"abcde"]]
    tests = [(100 + i, w, None, None, None) for i, w in enumerate(words)]
    got = score(R.documents(spark, train + tests), F.col("doc_id") < 100).filter("doc_id >= 100").collect()
    assert sum(10 ** r["score"] for r in got) < 1
    assert max(got, key=lambda r: r["score"])["doc_id"] == 100 + words.index("ab")


def test_scores_beat_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = score(docs, ~langid.held_out("doc_id", 5)).filter(langid.held_out("doc_id", 5)).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


ITEMS = [(1, R.sentence(30, 1)), (2, "one two three"), (3, None), (4, ""), (5, R.sentence(30, 1)), (10, R.sentence(15, 5)), (None, "naïve café"), (7, "one")]


def slow_contamination(rows, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        words = cut(text)
        m = min(len(words), size)
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add("null" if item is None else str(item))
    out = []
    for r in rows:
        words, hit, found = cut(r[1]), set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(words) - m + 1):
                if own := windows.get(tuple(words[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= own
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((r[0], len(words), len(hit), len(found), ids, bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("per_index", [100_000, 7])
def test_contamination(spark, monkeypatch, per_index):
    monkeypatch.setattr("bazaarlens.llm.decontaminate.INDEX_WINDOWS", per_index)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    rows = R.hard_documents()
    got = contamination(R.documents(spark, rows), items).drop("lang", "kept")
    assert Counter(tuple(r) for r in got.collect()) == slow_contamination(rows, ITEMS, 10)
    assert contamination(R.empty(spark), items).collect() == []
    assert contamination(R.documents(spark, rows), items.limit(0)).filter("contaminated").count() == 0


def slow_signals(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_signals(spark):
    rows = R.hard_documents() + [(300, "a b\na b\n\n a b\n# x | y <&>\na b", None, None, None), (301, "r s t u r s t " * 9, None, None, None)]
    got = quality.signals(R.documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r) for r in got.collect()) == Counter((r[0], *slow_signals(r[1])) for r in rows)


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    measured = quality.signals(docs)
    judged = quality.judge(measured, quality.fit(measured))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    seen = {(r["label"], r["base_failed"], r["kept"]) for r in labels.join(judged, "doc_id").collect()}
    assert seen <= {(0, True, False), (0, False, False), (1, True, False), (1, False, True)}
    nothing = quality.signals(R.empty(spark))
    assert quality.judge(nothing, quality.fit(nothing)).collect() == []


def fitted(patterns):
    """Posterior of good for each vote pattern, and the model of patterns with their counts."""
    names = [*quality.rules()]
    v = np.array([[p.get(k, 1) for k in names] for p, _ in patterns])
    model = quality.estimate(v, np.array([n for _, n in patterns], float), names)
    total = model.prior + sum(np.array([model.weights[k][1 - (x == 0)] if x >= 0 else 0 for x in v[:, i]]) for i, k in enumerate(names))
    return [g < 1 for g in np.exp(-total)], model


def test_one_bad_vote_of_an_inaccurate_rule_does_not_reject(spark):
    junk = [({"symbols": 0, "symbol_words": 0}, 400), ({"repeats": 0, "echoes": 0}, 300), ({"capitals": 0, "upper_case": 0}, 200)]
    kept, model = fitted([({}, 8000), ({"word_length": 0}, 80), ({"letters": 0}, 60), *junk])
    assert kept == [True, True, True, False, False, False]
    assert model.accuracy["word_length"] < model.accuracy["symbols"]


def test_a_clean_document_with_one_quirk_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    quirk = " ".join(f"{w}unusuallylongword" for w in R.sentence(80, 5).split())
    docs = docs.unionByName(spark.createDataFrame([(10**9 + i, f"{quirk} {i}") for i in range(10)], docs.schema))
    measured = quality.signals(docs)
    rows = quality.judge(measured, quality.fit(measured)).filter("doc_id >= 1000000000").select("*", *[v.alias(f"vote_{k}") for k, v in quality.rules().items()])
    for r in rows.collect():
        assert [k for k in quality.rules() if r[f"vote_{k}"] == 0] == ["word_length"]
        assert r["kept"]


def test_word_rules_abstain_on_scripts_without_spaces(spark):
    texts = ["日本語の文章は単語の間に空白を入れないで書かれるものである。 " * 60, "ภาษาไทยไม่เว้นวรรคระหว่างคำในประโยคเดียวกัน " * 60, "한국어 문장은 띄어 씁니다 " * 20, "longlonglonglonglongword " * 60]
    measured = quality.signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    votes = measured.select("doc_id", quality.rules()["word_length"].alias("v")).collect()
    assert {r["doc_id"]: r["v"] for r in votes} == {0: None, 1: None, 2: None, 3: 0}
