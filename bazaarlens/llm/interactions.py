"""Filter interaction audit over sorted posting lists.

Each document fails some of the filters. For each part of the corpus and each range of ids the failing ids are kept as one
sorted posting list a filter. Unions of lists, and what a marked list (good, toxic) has beyond them, come from galloping
merges; their sizes, summed over ranges, give what every order of the filters removes at every step.

A range spans RANGE_IDS ids and equal rows of one id are counted before they are dealt, so that no group grows with the
corpus, however many rows a part, a text or an id holds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.functions.storage import materialise
from bazaarlens.llm.arrays import WHITE, Words, group_edges, slices, text_buffers

RANGE_IDS = 1 << 13
#: Needles of a galloping search that share one bracket.
STRIDE = 512
FILTERS = "ABCDE"

MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_marks")
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*|")] = True


def gallop(haystack: np.ndarray, needles: np.ndarray) -> np.ndarray:
    """Where each needle would stand in ``haystack`` (both sorted): from the place of the last needles the step is doubled
    until it has passed the next ones, and the bracket found is bisected."""
    at = np.empty(len(needles), np.int64)
    low, size = 0, len(haystack)
    for a in range(0, len(needles), STRIDE):
        part = needles[a : a + STRIDE]
        step = 1
        while low + step < size and haystack[low + step] < part[-1]:
            step *= 2
        at[a : a + len(part)] = low + np.searchsorted(haystack[low : low + step + 1], part)
        low = int(at[a + len(part) - 1])
    return at


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What sorted ``a`` has and sorted ``b`` has not; the shorter list gallops through the longer one."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        at = gallop(b, a)
        at[at == len(b)] = 0
        return a[b[at] != a]
    at = gallop(a, b)
    held = at < len(a)
    at, b = at[held], b[held]
    return np.delete(a, at[a[at] == b])


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The sorted union of sorted lists, the longest first, so that each shorter one gallops through what is there."""
    ordered = sorted(lists, key=len, reverse=True)
    merged = ordered[0]
    for other in ordered[1:]:
        new = difference(other, merged)
        merged = np.insert(merged, gallop(merged, new), new)
    return merged


def union_sizes(lists: list[np.ndarray], marked: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """For each set of lists, by bit mask: the weight of its union, and of the part of it in each ``marked`` list."""
    unions = [np.zeros(0, np.int64)]
    sizes = np.zeros((1 << len(lists), 1 + len(marked)), np.int64)
    whole = [int(weight[m].sum()) for m in marked]
    for mask in range(1, 1 << len(lists)):
        top = mask.bit_length() - 1
        merged = union([unions[mask ^ (1 << top)], lists[top]])
        unions.append(merged)
        sizes[mask] = [weight[merged].sum(), *(w - weight[difference(m, merged)].sum() for w, m in zip(whole, marked, strict=True))]
    return sizes


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MEASURES of each text, one row each."""
    rows = len(offsets) - 1
    words = Words(data, offsets, WHITE)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][offsets])

    h = words.hashes()
    order = np.lexsort((h, words.doc))
    distinct = np.bincount(words.doc[order][group_edges(words.doc[order], h[order])], minlength=rows)
    return np.stack(
        [words.counts, distinct, per_text((data >= 65) & (data <= 90)), per_text((data & 0xC0) != 0x80), per_text(_MARK[data])], axis=1
    ).astype(np.int64)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """MEASURES and a digest of each text beside the other columns of ``docs`` (the text goes); null: empty."""
    keep = [c for c in docs.columns if c not in (text_col, "digest", *MEASURES)]
    schema = T.StructType(
        [T.StructField("row", T.StructType([docs.schema[c] for c in keep])), T.StructField("digest", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in MEASURES]
    )
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            values = np.concatenate([np.zeros((0, len(MEASURES)), np.int64), *parts])
            new = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], schema=target)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    return rows.mapInArrow(work, schema).select("row.*", "digest", *MEASURES)


def failures(measures: DataFrame) -> DataFrame:
    """Adds ``fails``, a bit mask of FILTERS, lowest bit first: under 100 words; under 80 % distinct words; over 10 %
    capitals; a mark; a text that a smaller ``doc_id`` has too.

    A null id is larger than all others; rows of one id do not make each other fail the last filter, nor do two null ids.
    """
    first = measures.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    joined = measures.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    conditions = [
        F.col("n_words") < 100,
        100 * F.col("n_distinct") < 80 * F.col("n_words"),
        100 * F.col("n_capitals") > 10 * F.col("n_chars"),
        F.col("n_marks") > 0,
        F.col("first_digest").isNull(),
    ]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    return joined.withColumn("fails", mask.cast("int")).drop("first_id", "first_digest")


_SIZES = T.StructType([T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("total", "gone", "good", "toxic")])


def _range_sizes(rows: pa.Table, filters: int) -> pa.Table:
    """One part and id range: posting lists of row numbers in the order of ids, and the sizes of their unions."""
    rows = rows.sort_by([("doc_id", "ascending"), ("fails", "ascending"), ("good", "ascending"), ("toxic", "ascending")])
    fails, weight = rows["fails"].to_numpy(), rows["n"].to_numpy()
    lists = [np.flatnonzero(fails >> i & 1) for i in range(filters)]
    marked = [np.flatnonzero(rows[c].to_numpy()) for c in ("good", "toxic")]
    sizes = union_sizes(lists, marked, weight)
    columns = [pa.array([rows["part"][0].as_py()] * len(sizes), pa.string()), pa.array(np.arange(len(sizes)), pa.int32())]
    columns += [pa.array(np.full(len(sizes), weight.sum()))] + [pa.array(np.ascontiguousarray(sizes[:, i])) for i in range(3)]
    return pa.table(columns, schema=to_arrow_schema(_SIZES))


def subset_sizes(failing: DataFrame, part: Column, filters: int = len(FILTERS)) -> DataFrame:
    """part, mask, total, gone, good, toxic: for each part and each set of filters the rows, those that fail one of the set,
    and the good and toxic ones of these.

    ``failing``: doc_id (null: a range of its own), fails, good and toxic (0 or 1). Repeated rows are each counted.
    """
    counted = failing.groupBy(part.alias("part"), "doc_id", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    ranged = counted.withColumn("id_range", F.floor(F.col("doc_id") / F.lit(RANGE_IDS)))
    sizes = ranged.groupBy("part", "id_range").applyInArrow(lambda rows: _range_sizes(rows, filters), _SIZES)
    return sizes.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("total", "gone", "good", "toxic")))


def order_steps(sizes: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of
    the filters, from ``subset_sizes``."""
    spark, every = sizes.sparkSession, (1 << len(names)) - 1
    steps = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for i, k in enumerate(order):
            steps.append(("".join(names[j] for j in order), i + 1, 1 << k, before, before | 1 << k))
            before |= 1 << k
    plan = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int, after int")
    entry = F.struct("mask", "total", "gone", "good", "toxic")
    parts = sizes.groupBy("part").agg(F.sort_array(F.collect_list(entry)).alias("by_mask"))
    parts = parts.select("part", "by_mask", F.explode(F.sequence(F.lit(1), F.lit(every))).alias("after"))
    rows = parts.join(plan, "after")
    here, before, alone = (F.col("by_mask")[c] for c in (F.col("after"), F.col("before"), F.col("bit")))
    whole, others = F.col("by_mask")[every], F.col("by_mask")[every - F.col("bit")]
    removed = here["gone"] - before["gone"]
    out = rows.select(
        "part", "filter_order", "step", "bit",
        (here["total"] - here["gone"]).alias("kept"), removed.alias("removed"), (alone["gone"] - removed).alias("redundant"),
        (whole["gone"] - others["gone"]).alias("unique_fails"), (here["good"] - before["good"]).alias("good_lost"),
        (here["toxic"] - before["toxic"]).alias("toxic_lost"),
    )
    total = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "bit"]).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters of ``failures`` removes at each step of each of their 120 orders, by ``lang``.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. A null text is empty, a null lang the part ''. Every
    row of ``docs`` is a document, also when it repeats another's id; a document counts as good (toxic) if any row of
    ``labels`` with its id says so, and rows of either table without an id have no label. Without documents there is no row.
    Texts are read whole, one slice each when long.
    """
    part = F.coalesce(F.col("lang"), F.lit("")).alias("lang")
    flags = materialise(measured(docs.select("doc_id", part, "text")), "filter-measures")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    failing = failures(flags).join(marks, F.col("doc_id") == F.col("label_id"), "left")
    failing = failing.select("lang", "doc_id", "fails", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    return order_steps(subset_sizes(failing, F.col("lang")))
