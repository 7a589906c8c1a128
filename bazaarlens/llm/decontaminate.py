"""Benchmark decontamination: Wu-Manber search for all windows of the test items at once.

The windows are the patterns and words are the letters. A table of shifts over hashed blocks of two words tells how far
the search may jump; where the shift is zero, the patterns that end in that block are selected, their hash is compared
and then their words. Documents are searched in lanes of equal length that advance together as arrays.

The patterns are cut into blocks of at most about INDEX_WINDOWS windows. One block is broadcast as an index of bounded size
and searched for in one pass. Beyond that, documents are numbered and stored, and searched for block by block: the driver and
the tasks hold one block at a time, what it finds is stored as merged spans, and these are brought together by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.functions.storage import materialise
from bazaarlens.llm.arrays import LOWER, PLAIN, Words, covered, mix, slices, text_buffers, word_sums
from bazaarlens.llm.naming import names_apart

#: Windows of one index: about 20 MB.
INDEX_WINDOWS = 100_000
LANE = 512
#: Slots of a shift table for each block of words in the patterns, so that most places of a text meet an empty one.
SLOTS_PER_BLOCK, MOST_BITS = 8, 24


def _plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[data], offsets, PLAIN)


def _joined(words: Words, flat: bytes, start: int, size: int) -> bytes:
    s, e = words.starts[start : start + size].tolist(), words.ends[start : start + size].tolist()
    return b" ".join(flat[a:b] for a, b in zip(s, e, strict=True))


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Each distinct window of the items as text, with its length in words and the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _plain_words(*text_buffers(batch.column(1)))
            flat = words.data.tobytes()
            rows = []
            for doc in range(batch.num_rows):
                first, n = int(words.first[doc]), int(words.counts[doc])
                length = min(n, size)
                found = {_joined(words, flat, first + i, length) for i in range(n - length + 1)} if n else ()
                rows += [(batch.column(0)[doc].as_py(), length, text) for text in found]
            yield pa.RecordBatch.from_pylist([{"item": i, "words": w, "body": t} for i, w, t in rows], schema)

    schema = pa.schema([("item", pa.string()), ("words", pa.int32()), ("body", pa.binary())])
    picked = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))
    cut_up = picked.mapInArrow(cut, "item string, words int, body binary")
    return cut_up.groupBy("words", "body").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Index:
    """The tables of Wu and Manber for windows of one length."""

    def __init__(self, rows: list[tuple[bytes, list[str]]], size: int):
        self.size, self.block = size, min(2, size)
        self.bodies = [b for b, _ in rows]
        self.items = [i for _, i in rows]
        flat = np.frombuffer(b"\n".join(self.bodies), np.uint8)
        words = Words(flat, np.array([0, len(flat)]), PLAIN)
        hashes = words.hashes()
        blocks = self.block_hashes(hashes)
        ends = np.arange(1, len(rows) + 1) * size - 1
        jump = size - self.block + 1
        self.below = np.uint64(64 - min(MOST_BITS, (SLOTS_PER_BLOCK * len(rows) * jump).bit_length()))
        self.shift = np.full(1 << (64 - int(self.below)), jump, np.min_scalar_type(jump))
        for back in range(size - self.block, -1, -1):  # the block that ends so many words before the window does
            self.shift[blocks[ends - back] >> self.below] = back
        sums = word_sums(hashes)
        whole = sums.runs(ends - size + 1, ends + 1)
        order = np.lexsort((whole, blocks[ends]))
        self.suffix, self.whole, self.pattern = blocks[ends][order], whole[order], order

    def block_hashes(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at each word."""
        if self.block == 1:
            return mix(hashes.copy())
        before = np.r_[np.zeros(1, np.uint64), hashes[:-1]]
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)

    def search(self, words: Words, hashes: np.ndarray, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence."""
        blocks = self.block_hashes(hashes)
        slots = (blocks >> self.below).astype(np.int32)
        long_enough = np.flatnonzero(words.counts >= self.size)
        begin, end = words.first[long_enough] + self.size - 1, words.first[long_enough + 1]
        lanes = -(-(end - begin) // LANE)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begin, lanes) + nth * LANE
        stop = np.minimum(at + LANE, np.repeat(end, lanes))
        zeros = []
        while len(at):
            jump = self.shift[slots[at]]
            zeros.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate([np.zeros(0, np.int64), *zeros])
        lo, hi = np.searchsorted(self.suffix, blocks[ends], "left"), np.searchsorted(self.suffix, blocks[ends], "right")
        ends, lo, hi = ends[hi > lo], lo[hi > lo], hi[hi > lo]
        whole = word_sums(hashes).runs(ends - self.size + 1, ends + 1)
        starts, patterns = [], []
        while len(ends):  # through the bucket of each suffix
            same = np.flatnonzero(self.whole[lo] == whole)
            for i in same.tolist():
                pattern, start = int(self.pattern[lo[i]]), int(ends[i]) - self.size + 1
                if _joined(words, flat, start, self.size) == self.bodies[pattern]:
                    starts.append(start)
                    patterns.append(pattern)
            # patterns of a bucket are in the order of their hash: what lies above cannot come any more
            lo = lo + 1
            on = (lo < hi) & (self.whole[np.minimum(lo, len(self.whole) - 1)] <= whole)
            ends, lo, hi, whole = ends[on], lo[on], hi[on], whole[on]
        return np.array(starts, np.int64), np.array(patterns, np.int64)


def _block(patterns: DataFrame, i: int, blocks: int) -> list[Index]:
    """The indexes of one block of patterns, at most about INDEX_WINDOWS windows in all."""
    rows = patterns.filter(F.pmod(F.xxhash64("body"), F.lit(blocks)) == i).collect()
    by_size: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: bytes(r.body)):
        by_size.setdefault(r.words, []).append((bytes(r.body), r["items"]))
    return [Index(rows, size) for size, rows in sorted(by_size.items())]


def _occurrences(indexes: list[Index], words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurrence, and the items concerned by text."""
    hashes, flat = words.hashes(), words.data.tobytes()
    starts, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    for index in indexes:
        start, pattern = index.search(words, hashes, flat)
        starts.append(start)
        ends.append(start + index.size)
        for d, p in zip(words.doc[start].tolist(), pattern.tolist(), strict=True):
            found.setdefault(d, set()).update(index.items[p])
    return covered(np.concatenate(starts), np.concatenate(ends), len(words.starts)), found


def _texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, Words]]:
    for a, b in slices(offsets):
        yield a, _plain_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _spans(numbered: DataFrame, indexes) -> DataFrame:
    """What one broadcast block finds: by document, where its hit runs of words begin and end, and the items."""
    kinds = "__row long, begins array<int>, ends array<int>, found array<string>"
    target = to_arrow_schema(T._parse_datatype_string(kinds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, words in _texts(*text_buffers(batch.column("__text"))):
                hit, found = _occurrences(indexes.value, words)
                for d, own in found.items():
                    flags = np.r_[False, hit[words.first[d] : words.first[d + 1]], False]
                    edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                    row = batch.column("__row")[a + d].as_py()
                    out.append({"__row": row, "begins": edges[::2], "ends": edges[1::2], "found": sorted(own)})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return numbered.select("__row", "__text").mapInArrow(search, kinds)


FOUND = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]


@names_apart
def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, with_text: bool = False,
) -> DataFrame:
    """Words of each document that lie in an occurrence of a window of the items, and the items concerned.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; an item of fewer words than ``window`` is
    one window. Keeps the columns of ``docs`` (the text's only ``with_text``) and adds n_words, n_hit, n_items,
    items_sha256 (of the item ids, sorted as strings and joined by commas) and contaminated. Null or empty texts have no
    words, as documents and as items; a null item id reads ``null``; repeated items and rows each count. Without items
    nothing is hit. Where several windows tie for a place all of them count. Memory follows the longest text.
    """
    spark = docs.sparkSession
    patterns = materialise(windows_of(items, item_id, item_text, window), "windows")
    blocks = -(-patterns.count() // INDEX_WINDOWS)
    names = dict(FOUND)
    keep = [c for c in docs.columns if c not in names and (with_text or c != text_col)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in FOUND))])
    target = to_arrow_schema(schema)
    nothing = hashlib.sha256(b"").hexdigest()

    def judged(batch: pa.RecordBatch, n_words: list, n_hit: list, found: dict[int, set[str]]) -> pa.RecordBatch:
        n_items, digest = np.zeros(batch.num_rows, np.int64), [nothing] * batch.num_rows
        for d, own in found.items():
            n_items[d] = len(own)
            digest[d] = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        n_words, n_hit = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (n_words, n_hit))
        new = [n_words, n_hit, n_items, pa.array(digest, pa.string()), n_hit > 0]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, new)], schema=target)

    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    if blocks <= 1:
        indexes = spark.sparkContext.broadcast(_block(patterns, 0, 1) if blocks else [])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, n_hit, items_of = [], [], {}
                for a, words in _texts(*text_buffers(batch.column("__text"))):
                    hit, found = _occurrences(indexes.value, words)
                    n_words.append(words.counts)
                    n_hit.append(np.bincount(words.doc[hit], minlength=len(words.counts)))
                    items_of |= {a + d: own for d, own in found.items()}
                yield judged(batch, n_words, n_hit, items_of)

        return picked.mapInArrow(search, schema)

    numbered = materialise(picked.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = []
    for i in range(blocks):
        indexes = spark.sparkContext.broadcast(_block(patterns, i, blocks))
        found.append(materialise(_spans(numbered, indexes), "spans"))
        indexes.destroy()
    lists = [F.flatten(F.collect_list(c)).alias(f"__{c}") for c in ("begins", "ends", "found")]
    spans = reduce(DataFrame.unionByName, found).groupBy("__row").agg(*lists)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items_of = [], [], {}
            begins, ends, own = (batch.column(f"__{c}") for c in ("begins", "ends", "found"))
            for a, words in _texts(*text_buffers(batch.column("__text"))):
                n_words.append(words.counts)
                hits = np.zeros(len(words.counts), np.int64)
                for d in range(len(hits)):
                    if begins[a + d].is_valid:
                        hits[d] = covered(*(np.array(x[a + d].as_py(), np.int64) for x in (begins, ends)), int(words.counts[d])).sum()
                        items_of[a + d] = set(own[a + d].as_py())
                n_hit.append(hits)
            yield judged(batch, n_words, n_hit, items_of)

    return numbered.join(spans, "__row", "left").drop("__row").mapInArrow(unite, schema)
