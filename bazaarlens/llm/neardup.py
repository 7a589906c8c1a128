"""MinHash near-dedup with odd sketches.

Every distinct word sequence is one node. Its MinHash samples make band keys, and are folded into an odd sketch: a bitmap
of parities, of which the population count of the XOR of two estimates their similarity most precisely where it is high.
Nodes that share a band key are candidates. Within a band's bucket, pairs are made only with a few centres, and only
between nodes that are not yet in one component; what the odd sketches do not rule out is confirmed on the full shingle
sets. Rounds with more centres follow until each bucket has been settled, after nodes have been cleared that by exact
bounds have no link left, so no link is lost and a large group of copies costs a few comparisons a document, not all its
pairs. Large buckets that the first round leaves open are dealt anew, by the rare differences of their nodes from one of
them: copies with changes of their own, mutually near but not linked, then meet only where they may be linked.

There are as many bands of 5 samples as the threshold asks for: a pair at 0.85 shares none of 32 with a chance of 7e-9, a
pair at 0.80 none of 48 with one of 5e-9.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.functions.storage import materialise
from bazaarlens.llm.arrays import LOWER, WHITE, Words, group_edges, mix, slices, text_buffers, word_sums
from bazaarlens.llm.groups import LAST_ID
from bazaarlens.llm.substring import kept_words

ROWS, SKETCH_BITS = 5, 1024
#: A pair at the threshold shares no band with at most this chance.
MISSED = 7.2e-9
#: Centres of the second round, and so many times more in each further one. Buckets of more nodes are dealt anew.
CENTRES = 16
#: Pairs whose odd sketches estimate less are not compared: about seven standard errors under the threshold.
ESTIMATE_SLACK = 0.2


def band_count(percent: int) -> int:
    """How many bands a threshold takes."""
    missed = 1 - (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(MISSED) / math.log(missed))) if 0 < missed < 1 else 1


def _steps(samples: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, (3, samples), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (as 64-bit hashes, in order) of each text, and where each text's begin (one entry more)."""
    sums = word_sums(words.hashes())
    at = words.windows(size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    h = np.r_[sums.windows(size)[at] if len(at) else np.zeros(0, np.uint64), sums.runs(words.first[short], words.first[short + 1])]
    doc = np.r_[words.doc[at], short]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    first = group_edges(doc, h)
    return h[first], np.searchsorted(doc[first], np.arange(len(words.counts) + 1))


def _samples(h: np.ndarray, edges: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """MinHash values of the texts that have shingles, one row each."""
    full = edges[:-1][np.diff(edges) > 0]
    return np.stack([np.minimum.reduceat(h * step, full) for step in steps], axis=1) if len(full) else np.zeros((0, len(steps)), np.uint64)


def sketch(docs: DataFrame, text_col: str, size: int, n_bands: int) -> DataFrame:
    """Beside the other columns: n_shingles, sequence (digest of the words), bands and odd (the parity bitmap)."""
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("n_shingles long, sequence binary, bands array<long>, odd array<long>")])
    target = to_arrow_schema(schema)
    steps = _steps(n_bands * ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_col))
            counts, digests, bands, odds = [], [], [], []
            for a, b in slices(offsets):
                words = Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], WHITE)
                digests += [hashlib.blake2b(x, digest_size=16).digest() for x in kept_words(words, np.ones(len(words.starts), bool))]
                h, edges = shingle_sets(words, size)
                own = np.diff(edges)
                counts.append(own)
                low = _samples(h, edges, steps[0])
                # one key a band, different for different bands
                parts = (mix(low.copy()) * steps[1]).reshape(-1, n_bands, ROWS).sum(axis=2, dtype=np.uint64)
                keys = mix(parts + np.arange(n_bands, dtype=np.uint64)).view(np.int64)
                place = (mix(low + steps[2]) >> np.uint64(54)).astype(np.int64)
                flat = place + SKETCH_BITS * np.arange(len(place))[:, None]
                odd = np.bincount(flat.ravel(), minlength=SKETCH_BITS * len(place)).reshape(-1, SKETCH_BITS) & 1
                odd = np.packbits(odd.astype(bool), axis=1).view(np.int64)
                row = np.cumsum(own > 0) - 1
                for d in range(b - a):
                    bands.append(keys[row[d]] if own[d] else keys[:0].ravel())
                    odds.append(odd[row[d]] if own[d] else odd[:0].ravel())
            new = [
                pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)),
                pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], schema=target)

    return docs.mapInArrow(work, schema)


def estimated_similarity(a: Column, b: Column, samples: int) -> Column:
    """From two odd sketches of so many samples; below what they can tell apart: 0."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    inside = 1 - 2.0 * differing / SKETCH_BITS
    return F.when(inside > 0, 1 + SKETCH_BITS / (4.0 * samples) * F.log(inside)).otherwise(0.0)


def _both_sets(left: pa.Array, right: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows x to y with a text on the left and on the right: x, y, sizes of the left and of the right sets; and for each
    element of either its row from x, the element, and in how many of the two sets it is, by row."""
    (left, at), (right, bt) = text_buffers(left), text_buffers(right)
    for x, y in slices(at + bt):
        ha, ea = shingle_sets(Words(LOWER[left[at[x] : at[y]]], at[x : y + 1] - at[x], WHITE), size)
        hb, eb = shingle_sets(Words(LOWER[right[bt[x] : bt[y]]], bt[x : y + 1] - bt[x], WHITE), size)
        pair = np.r_[np.repeat(np.arange(y - x), np.diff(ea)), np.repeat(np.arange(y - x), np.diff(eb))]
        h = np.r_[ha, hb]
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(pair[order], kind="stable")]
        first = group_edges(pair[order], h[order])
        yield x, y, np.diff(ea), np.diff(eb), pair[order][first], h[order][first], np.diff(np.r_[first, len(h)])


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets. ``texts``: node, text."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for x, y, na, nb, pair, _, _ in _both_sets(batch.column("text_a"), batch.column("text_b"), size):
                union = np.bincount(pair, minlength=y - x)
                common = na + nb - union
                good[x:y] = (100 * common >= percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _differences(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the nodes of each bucket in ``rows`` (key, node) the differences from one of them, c: c, node, delta (the elements
    that are in one of the two sets only) and far = (100 + percent) * (size of delta) - (100 - percent) * (size of the set).

    Two sets are linked if (100 + percent) * (size of their symmetric difference) <= (100 - percent) * (sum of their sizes).
    The symmetric difference is that of the deltas from any c, so with o elements common to both deltas they are linked if
    far + far' <= 2 * (100 + percent) * o. As c each bucket takes its node with the most neighbours in all its buckets, so
    that buckets of the same copies have the same c.
    """
    by_key = Window.partitionBy("key")
    rows = rows.select("key", "node", F.count("*").over(by_key).alias("met"))
    weights = rows.groupBy("node").agg(F.sum("met").alias("weight"))
    leader = F.max(F.struct("weight", "node")).over(by_key)["node"]
    pairs = rows.join(weights, "node").select(leader.alias("c"), "node").distinct()
    left = pairs.join(texts.select(F.col("node").alias("c"), F.col("text").alias("text_c")), "c")
    both = left.join(texts.select("node", "text"), "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, _, n, pair, h, held in _both_sets(batch.column("text_c"), batch.column("text"), size):
                pair, h = pair[held == 1], h[held == 1]
                differing = np.bincount(pair, minlength=y - x)
                ends = np.r_[0, np.cumsum(differing)].astype(np.int32)
                far = (100 + percent) * differing - (100 - percent) * n
                delta = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("c").slice(x, y - x), batch.column("node").slice(x, y - x), pa.array(far, pa.int64()), delta], names=["c", "node", "far", "delta"]
                )

    return both.select("c", "node", "text_c", "text").mapInArrow(work, "c long, node long, far long, delta array<long>")


def _certain_links(differences: DataFrame) -> DataFrame:
    """Links (a, b) that need no common difference. Of two nodes with far + far' <= 0 each has that with the nearest one."""
    nearest = differences.groupBy("c").agg(F.min(F.struct("far", "node")).alias("near"))
    linked = differences.join(nearest, "c").filter("far + near.far <= 0 AND node <> near.node")
    return linked.select(F.col("near.node").alias("a"), F.col("node").alias("b")).distinct()


def _by_rare_differences(differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Buckets (key, node) in which all nodes meet that share a c and may be linked but are not yet in one component, once
    the certain links are in ``labels``.

    With s of a node's differences found in other components, too, two nodes have at most min(s, s') in common, so they are
    linked only if far + far' <= most * min(s, s'), most = 2 * (100 + percent). For a node, ``low`` is the least far' with
    which that can hold. It then has at least need = (far + low) / most differences in common with the other, so one of
    them is among the s - need + 1 rarest of both (ties in one order): these are the keys.
    """
    most = 2 * (100 + percent)
    rows = differences.join(labels, "node")
    # the component of the node nearest to c has most nodes, which need not meet each other
    homes = rows.groupBy("c").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.min_by("comp", F.struct("far", "node")).alias("home"))
    rows = rows.join(homes.filter("first < last").select("c", "home"), "c")
    rows = rows.select("c", "node", "far", "comp", (F.col("comp") == F.col("home")).alias("at_home"), F.explode("delta").alias("h"))
    often = rows.groupBy("c", "h").agg(F.count("*").alias("often"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    shared = rows.join(often.filter("first < last").select("c", "h", "often"), ["c", "h"])
    nodes = shared.groupBy("c", "node", "far", "at_home").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("held"))
    nodes = nodes.withColumn("reach", most * F.size("held") - F.col("far"))
    # in whole steps of ``most``, so that there are no more of them than a set has elements, however many nodes there are
    step = lambda x: F.floor(F.col(x) / most)
    nodes = materialise(nodes.withColumns({"from": step("far"), "to": step("reach")}), "differences")
    away = F.when(~F.col("at_home"), F.col("far"))
    ends = nodes.groupBy("c", F.col("to").alias("at")).agg(F.min("far").alias("low"), F.min(away).alias("low_away"))
    asked = nodes.select("c", F.col("from").alias("at"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("low_away"))
    ends = ends.unionByName(asked).groupBy("c", "at").agg(F.min("low").alias("low"), F.min("low_away").alias("low_away"))
    beyond = Window.partitionBy("c").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("c", F.col("at").alias("from"), F.min("low").over(beyond).alias("low"), F.min("low_away").over(beyond).alias("low_away"))
    nodes = nodes.join(ends, ["c", "from"]).withColumn("low", F.when(F.col("at_home"), F.col("low_away")).otherwise(F.col("low")))
    nodes = nodes.filter("low <= reach").withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("far") + F.col("low")) / most)))
    keys = nodes.filter("need <= size(held)").select("c", "node", F.explode(F.expr("slice(held, 1, int(size(held) - need + 1))")).alias("one"))
    return keys.select(F.xxhash64("c", "one.h").alias("key"), "node").distinct()


def _linkable(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``open_`` (key, node, comp) whose node may still have a link to another component, by exact bounds.

    A shingle that no open node of another component has cannot be in the intersection of such a link. If f of a node's n
    shingles are left, the other set has at least m (the smallest of the bucket), and the sets are linked, then
    (100 + percent) * f >= percent * (n + m). This clears groups of copies with many changes of their own, in which no pair
    is similar enough but all are candidates.
    """
    nodes = open_.select("node", "comp").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            node, comp = batch.column("node").to_numpy(), batch.column("comp").to_numpy()
            for a, b in slices(offsets):
                h, edges = shingle_sets(Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], WHITE), size)
                of = np.repeat(np.arange(a, b), np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(node[of]), pa.array(comp[of]), pa.array(h.view(np.int64))], names=["node", "comp", "h"])

    shingles = texts.join(nodes, "node").select("node", "comp", "text").mapInArrow(work, "node long, comp long, h long")
    shared = shingles.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("h")
    useful = shingles.join(shared.withColumn("shared", F.lit(1)), "h", "left").groupBy("node").agg(F.count("*").alias("n"), F.count("shared").alias("f"))
    rows = open_.join(useful, "node").withColumn("m", F.min("n").over(Window.partitionBy("key")))
    rows = rows.filter((100 + percent) * F.col("f") >= percent * (F.col("n") + F.col("m")))
    by_key = Window.partitionBy("key")
    rows = rows.withColumns({"low": F.min("comp").over(by_key), "high": F.max("comp").over(by_key)})
    return rows.filter("low < high").select("key", "node", "comp")


def spread_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest label of each connected component. ``labels``: node, comp (a node of the same component).

    In each round every component that is linked to a smaller one takes over the smallest such label, and what that one takes
    over in turn, four steps far, then 16, 64, ...: long chains of components take few rounds, stars one.
    """
    doublings = 0
    while True:
        ends = links.join(labels.withColumnsRenamed({"node": "a", "comp": "x"}), "a")
        ends = ends.join(labels.withColumnsRenamed({"node": "b", "comp": "y"}), "b").filter("x <> y")
        hooks = ends.groupBy(F.greatest("x", "y").alias("comp")).agg(F.min(F.least("x", "y")).alias("low"))
        hooks = materialise(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        for _ in range(doublings):
            further = hooks.select(F.col("comp").alias("low"), F.col("low").alias("next"))
            hooks = hooks.join(further, "low", "left").select("comp", F.coalesce("next", "low").alias("low"))
            hooks = materialise(hooks, "hooks")
        doublings += 2
        out = labels
        for _ in range(4):
            out = out.join(hooks, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp"))
        labels = materialise(out, "labels")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, row_col: str | None = None
) -> DataFrame:
    """Adds n_shingles, component_id and kept to each document's id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct ``size``-word shingles, or
    its whole word sequence if that is shorter. Documents are linked if 100 * intersection >= percent * union; component_id
    is the smallest id reachable. Texts without words (also null) are linked with nothing: component_id is their own id.
    A null id stands after all others and stays null. Repeated rows are in one component, and each row with the smallest
    id is kept; with ``row_col``, a column of different whole numbers, only the one with the smallest number of these, and
    the column is returned, too. An empty table gives an empty result. Memory follows the longest text.
    """
    row = F.lit(0).cast("long") if row_col is None else F.col(row_col).cast("long")
    ids = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), row.alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.xxhash64("text"))
    n_bands = band_count(percent)
    sketched = materialise(sketch(ids, "text", size, n_bands), "sketches")
    full = sketched.filter("n_shingles > 0")
    classes = full.groupBy("sequence").agg(F.min(F.struct("id", "row", "digest", "bands", "odd")).alias("one"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "sequence", "one.*")
    classes = materialise(classes, "sequences")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    open_ = materialise(keyed.join(several.select("key"), "key", "left_semi"), "buckets")
    nodes = open_.select("node").distinct()
    labels = materialise(nodes.withColumn("comp", F.col("node")), "labels")
    wanted = classes.join(nodes, "node").select("node", "id", "row", "digest")
    # rows of one id are told apart by their texts; equal ones give equal nodes
    texts = ids.join(wanted, ["id", "row", "digest"]).select("node", "text").dropDuplicates(["node"])
    texts = materialise(texts, "candidate-texts")
    odd = classes.join(nodes, "node", "left_semi").select("node", "odd")
    by_key = Window.partitionBy("key")

    def apart(buckets: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with their component."""
        rows = buckets.join(labels, "node").withColumns({"low": F.min("comp").over(by_key), "high": F.max("comp").over(by_key)})
        return rows.filter("low < high").select("key", "node", "comp")

    tested = None
    centres = 1
    while True:
        rows = apart(open_)
        if centres > 1:
            rows = _linkable(materialise(rows, "buckets"), texts, size, percent)
        if centres == CENTRES:
            rows = materialise(rows.withColumn("met", F.count("*").over(by_key)), "buckets")
            large = materialise(_differences(rows.filter(F.col("met") > CENTRES + 1), texts, size, percent), "differences")
            labels = spread_labels(labels, _certain_links(large))
            small = rows.filter(F.col("met") <= CENTRES + 1).select("key", "node")
            rows = apart(materialise(small.unionByName(_by_rare_differences(large, labels, percent)), "buckets"))
        # the smaller components of a bucket come first: when all but the largest have been centres, it is settled
        rows = rows.withColumn("of", F.count("*").over(Window.partitionBy("key", "comp")))
        rows = rows.withColumn("rank", F.row_number().over(by_key.orderBy("of", "comp", "node"))).drop("of")
        if centres == 1:
            rows = rows.withColumn("first", F.min_by(F.struct("node", "comp"), "rank").over(by_key))
        open_ = materialise(rows, "buckets")
        if open_.isEmpty():
            break
        if centres == 1:
            pairs = open_.filter("rank > 1").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.comp").alias("comp_a"), "comp")
        else:
            first = open_.filter(F.col("rank") <= centres).select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.col("rank").alias("rank_a"))
            pairs = first.join(open_, "key").filter("rank_a < rank AND comp_a <> comp").select("a", F.col("node").alias("b"), "comp_a", "comp")
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pairs.join(odd.withColumnsRenamed({"node": "a", "odd": "odd_a"}), "a").join(odd.withColumnsRenamed({"node": "b", "odd": "odd_b"}), "b")
        pairs = pairs.withColumn("near", estimated_similarity(F.col("odd_a"), F.col("odd_b"), n_bands * ROWS))
        pairs = materialise(pairs.filter(F.col("near") >= percent / 100 - ESTIMATE_SLACK).drop("odd_a", "odd_b"), "pairs")
        now = pairs.select("a", "b")
        if centres == 1:
            # most nodes find their component by the nearest centre alone; only the others are compared with all
            nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("a")).select("a", "b")
            found = materialise(confirm(nearest, texts, size, percent), "links")
            labels = spread_labels(labels, found)
            at = labels.select(F.col("node").alias("a"), F.col("comp").alias("x"))
            now = now.join(nearest, ["a", "b"], "left_anti").join(at, "a")
            now = now.join(at.withColumnsRenamed({"a": "b", "x": "y"}), "b").filter("x <> y").select("a", "b")
        found = materialise(confirm(now, texts, size, percent), "links")
        labels = spread_labels(labels, found)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        open_ = open_.filter(F.col("rank") > centres).select("key", "node")
        centres *= CENTRES

    of_class = classes.select("sequence", "node", F.struct("id", "row").alias("lowest")).join(labels, "node", "left")
    of_class = of_class.withColumn("comp", F.coalesce("comp", "node"))
    smallest = of_class.groupBy("comp").agg(F.min("lowest").alias("first"))
    of_class = of_class.join(smallest, "comp").select("sequence", "first")
    out = sketched.select("id", "row", "n_shingles", "sequence").join(of_class, "sequence", "left")
    own = F.struct("id", "row")
    first = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(own)
    real = lambda c: F.when(c != LAST_ID, c)
    return out.select(
        real(F.col("id")).alias(id_col), *([] if row_col is None else [F.col("row").alias(row_col)]), "n_shingles",
        real(first["id"]).alias("component_id"), (own == first).alias("kept"),
    )


assert math.log2(SKETCH_BITS) == 10  # the ten bits that place a sample
