"""Source divergence audit by iceberg prefix refinement.

Terms are refined as byte prefixes with an end sign: at each level the prefixes in too few distinct documents go, with all
terms under them, until only complete terms in enough documents remain. So that a prefix's distinct documents can be
counted by adding, a document's distinct terms are sorted: a term counts for those prefixes that it does not share with
the one before. One pass over the texts notes for each (lang, source, term) how many documents count it from which level
on; these small counts are combined in the map tasks and each level is a plain aggregation of them.

What is kept is compared in integers: every source with every other of its language, in blocks of terms, and its own terms
with the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.functions.storage import materialise
from bazaarlens.llm.arrays import LOWER, Words, slices, text_buffers

#: Bytes of a prefix at the first level; each further level doubles them.
FIRST_LEVEL = 4
#: Bytes of text whose terms are counted together before they are sent on.
SLICE = 4 << 20
#: Cells (kept term x source) of a block, and of what is compared at once.
BLOCK_CELLS, PANEL_CELLS = 1 << 16, 1 << 16
SCALE = 1_000_000_000

#: Bytes between terms: all ASCII but letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_COUNTS = T.StructType(
    [T.StructField(c, t) for c, t in (
        ("lang", T.StringType()), ("source", T.StringType()), ("term", T.BinaryType()), ("fresh", T.IntegerType()),
        ("docs", T.LongType()), ("n", T.LongType()))]
)


def level_bytes(level: int) -> int:
    return FIRST_LEVEL << level


def _terms(data: np.ndarray, words: Words) -> pa.Array:
    """The lower-cased terms of some texts, each with an end sign (byte 0, which no term holds)."""
    lengths = words.ends - words.starts
    places = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=places[1:])
    body = np.zeros(places[-1], np.uint8)
    filled = np.ones(places[-1], bool)
    filled[places[1:] - 1] = False
    body[filled] = LOWER[data[words.inside]]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(body)])


def term_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts with their group numbers: group, term, the first level at which the term is new in its document,
    documents and occurrences; a row for each that occurs."""
    words = Words(data, offsets, NOT_LETTER)
    coded = _terms(data, words).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    sorted_terms = coded.dictionary.take(order)
    size = max(1, len(sorted_terms))
    rank = np.empty(size, np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    cells, times = np.unique(words.doc * size + rank[coded.indices.to_numpy()], return_counts=True)
    doc, term = cells // size, cells % size
    # a level at which the term before, in the same document, has the same prefix is not the term's own
    fresh = np.zeros(len(cells), np.int64)
    longest, levels = int(pc.max(pc.binary_length(sorted_terms)).as_py() or 0), 0
    same_doc = doc[1:] == doc[:-1]
    while level_bytes(levels) < longest:
        cut = pc.binary_slice(sorted_terms, 0, level_bytes(levels))
        prefix = np.zeros(size, np.int64)
        prefix[1:] = np.cumsum(pc.not_equal(cut[1:], cut[:-1]).to_numpy(zero_copy_only=False))
        fresh[1:] += same_doc & (prefix[term[1:]] == prefix[term[:-1]])
        levels += 1
    key = (group[doc] * size + term) * (levels + 1) + fresh
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    docs = np.diff(np.r_[first, len(key)])
    n = np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
    at = order[first]
    return group[doc[at]], sorted_terms.take(pa.array(term[at])), fresh[at], docs, n


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    target = to_arrow_schema(_COUNTS)
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        width = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        data, offsets = text_buffers(batch.column(2))
        for a, b in slices(offsets, SLICE):
            own, term, fresh, docs, n = term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], group[a:b])
            names = [lang.dictionary.take(pa.array(own // width)), source.dictionary.take(pa.array(own % width))]
            numbers = [pa.array(fresh, pa.int32()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*names, term, *numbers], schema=target)


def counts_of_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term (with its end sign), fresh, docs, n over all of ``docs`` (lang, source, text, none null)."""
    counted = docs.select("lang", "source", "text").mapInArrow(_work, _COUNTS)
    return counted.groupBy("lang", "source", "term", "fresh").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def refine(counts: DataFrame, least: int) -> DataFrame:
    """lang, term: those that at least ``least`` documents of the language hold, found level by level.

    ``counts``: lang, term, fresh, docs. A level counts each prefix's distinct documents, keeps the complete terms among the
    frequent prefixes and goes on with the longer terms under the others.
    """
    rows = materialise(counts.groupBy("lang", "term", "fresh").agg(F.sum("docs").alias("docs")), "terms")
    kept, level = [], 0
    while True:
        cut = F.substring("term", 1, level_bytes(level))
        frequent = rows.filter(F.col("fresh") <= level).groupBy("lang", cut.alias("prefix")).agg(F.sum("docs").alias("docs"))
        frequent = materialise(frequent.filter(F.col("docs") >= least).select("lang", "prefix"), "frequent")
        kept.append(frequent.filter(F.substring("prefix", -1, 1) == F.lit(b"\0")).select("lang", F.col("prefix").alias("term")))
        longer = rows.filter(F.length("term") > level_bytes(level)).withColumn("prefix", cut)
        rows = materialise(longer.join(frequent, ["lang", "prefix"], "left_semi").drop("prefix"), f"prefixes-{level_bytes(level)}")
        level += 1
        if rows.isEmpty():
            out = kept[0]
            for more in kept[1:]:
                out = out.unionAll(more)
            return out


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), exactly."""
    return F.expr("1L") + F.call_function(
        "div", (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")).cast("decimal(38,0)"), (total + 2 * terms).cast("decimal(38,0)")
    )


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


_PAIR_SUMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("item", T.StringType()), T.StructField("value", T.LongType())])


def _block_gaps(cells: pa.Table, sources: pa.Table) -> pa.Table:
    """One block of a language's kept terms: for each two of its sources the sum of the gaps.

    ``cells``: term, source, p of the cells that occur; ``sources``: source, the share of a term that does not occur.
    """
    target = to_arrow_schema(_PAIR_SUMS)
    sources = sources.sort_by("source")
    names, zero = sources["source"].combine_chunks(), sources["zero"].to_numpy()
    if not len(cells) or len(names) < 2:
        return target.empty_table()
    term = cells["term"].combine_chunks().dictionary_encode()
    row, at = term.indices.to_numpy().astype(np.int64), pc.index_in(cells["source"].combine_chunks(), names).to_numpy().astype(np.int64)
    order = np.argsort(row, kind="stable")
    row, at, p = row[order], at[order], cells["p"].to_numpy()[order]
    panel = max(1, PANEL_CELLS // len(names))
    sums = np.zeros((len(names), len(names)), np.int64)
    for a in range(0, len(term.dictionary), panel):
        b = min(a + panel, len(term.dictionary))
        i, j = np.searchsorted(row, (a, b))
        shares = np.repeat(zero[:, None], b - a, axis=1)
        shares[at[i:j], row[i:j] - a] = p[i:j]
        for g in range(len(names) - 1):
            d = shares[g + 1 :] - shares[g]
            sums[g, g + 1 :] += (d * d // (shares[g + 1 :] + shares[g])).sum(axis=1)
    g, h = np.triu_indices(len(names), 1)
    g, h, value = np.r_[g, h], np.r_[h, g], np.r_[sums[g, h], sums[g, h]]
    lang = pa.array([cells["lang"][0].as_py()] * len(g), pa.string())
    return pa.table([lang, names.take(pa.array(g)), names.take(pa.array(h)), pa.array(value)], schema=target)


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's share of its language's kept terms lies from each other
    source's (part ``pair``), and the ``top`` terms that it uses more than the language (part ``term``).

    ``docs``: lang, source, text; null in any is ''. Each row is a document, also a repeated one. Kept are the terms that at
    least ``least`` documents of the language hold; without any, pairs have the value 0 and there are no term rows. Ties go
    by the item's bytes. Whole texts are read, a long one as a slice of its own; without documents there is no row.
    """
    full = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = materialise(counts_of_terms(full), "term-counts")
    kept = refine(counts, least)
    cells = counts.join(kept, ["lang", "term"], "left_semi").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    cells = materialise(cells, "kept-counts")
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = full.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.fillna(0, ["total", "v", "lang_total"]), "sources")
    shared = cells.join(groups.drop("v", "lang_total"), ["lang", "source"]).join(langs.select("lang", "v"), "lang")
    shared = shared.withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    rows = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v"))
    rows = rows.withColumn("blocks", F.ceil(F.col("v") * F.col("sources") / F.lit(BLOCK_CELLS)))
    blocks = groups.filter("v > 0").join(rows.select("lang", "blocks"), "lang").select(
        "lang", "source", share(F.lit(0), F.col("total"), F.col("v")).alias("zero"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    dealt = shared.join(rows.select("lang", "blocks"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p"
    )
    sums = dealt.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(_block_gaps, _PAIR_SUMS)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    ahead = shared.join(terms, ["lang", "term"]).join(langs.select("lang", "lang_total"), "lang")
    ahead = ahead.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).filter("p > q")
    word = F.expr("substring(term, 1, length(term) - 1)").cast("string")
    ahead = ahead.select("lang", "source", F.lit("term").alias("part"), word.alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, ahead)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
