"""LM scoring by logistic context mixing.

A text is coded as its lower-cased words, a space after each, and an end sign. Each byte is a path of binary decisions
down a Huffman tree of the corpus's bytes, so that a byte takes four to five decisions and not eight. Every decision is
predicted from several contexts (the last one, two, three, four and six bytes, and the word so far), by the counts of the
bytes that follow the context in all training documents. The predictions are added in the logistic domain under weights that
a gate selects, namely how many of the three longest contexts have been seen; the weights start alike for every document and
are refined online after every few bytes of it, to its end.

The model grows with the corpus: the last bytes are counted as numbers, without a hash, and the word so far by a 64-bit hash.
Groups of documents send their distinct contexts, each with the bytes that follow it, to hash ranges and get back the log
odds of these decisions in the corpus, and the counts of their words for the base score. No table of contexts goes through
the driver or to all tasks, and none is written: a group works out the pairs it sent again when their odds come back.

A group sorts each place's last six bytes and symbol once; the pairs of shorter contexts are those of the distinct longer
ones, and the pairs of words those of its distinct words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm import groups as G
from bazaarlens.llm.arrays import LOWER, WHITE, Sums, Words, byte_sums, group_edges, mix, pack, slices, text_buffers, unpack
from bazaarlens.llm.naming import names_apart

#: Bytes of the contexts beside the word so far, which comes last.
ORDERS = (1, 2, 3, 4, 6)
CONTEXTS = len(ORDERS) + 1
#: A decision's odds of all contexts, its branch and what fills them up.
WIDE = 8
#: The gate counts which of so many last contexts have been seen.
GATED = 3
#: Bytes of text that are coded at once.
CODED_BYTES = 1 << 18
#: Bytes of text of a large group, on average: the more, the fewer pairs are sent, and the more memory a task takes.
GROUP_BYTES = 14 << 20
#: Places whose pairs are sorted at once, and rows of contexts whose odds are computed or laid out at once.
SORTED_PLACES = 1 << 22
ODDS_ROWS = 1 << 17
#: Predictions are kept in sixteenths of a natural-log odds unit.
SCALE = 16.0
END = 0xFF  # no byte of UTF-8
PAD = max(ORDERS)
#: Added to both counts of a decision.
PRIOR = 0.1
#: Weights are updated after so many bytes, by so much for each decision's slope.
UPDATE_BYTES = 32
RATE = 0.003
#: Weights by gate (none to all of the three longest contexts seen) and context, before a document has said anything.
START_WEIGHTS = np.array(
    [[0.1, 0.2, 0.5, 0.2, 0.1, 0.0], [0.05, 0.1, 0.5, 0.3, 0.1, 0.0], [0.0, 0.1, 0.4, 0.4, 0.15, 0.0], [0.0, 0.0, 0.25, 0.35, 0.35, 0.2]], np.float32
)


_MARKS = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE = np.uint64(8)
_ORDER_AT = np.uint64(56)
_GRAM = np.uint64((1 << 56) - 1)


class Coded:
    """Texts as bytes to predict.

    ``bytes``: every text's coded bytes behind PAD zeros; ``at``: places to predict; ``doc``: the text of each;
    ``symbols``: the bytes there; ``grams``: the PAD bytes before and the symbol, as one number. Units are words with their
    space, and end signs: ``first``: their first places (numbers in ``at``); ``lengths``; ``unit_doc``; ``units``: hashes.
    """

    def __init__(self, words: Words):
        rows = len(words.counts)
        lengths = words.ends - words.starts
        self.size = size = np.bincount(words.doc, lengths + 1, rows).astype(np.int64) + 1
        base = np.cumsum(size + PAD) - size - PAD
        total = int((size + PAD).sum())
        unit = np.arange(len(lengths)) + words.doc
        self.lengths = np.ones(len(lengths) + rows, np.int64)
        self.lengths[unit] += lengths
        self.unit_doc = np.repeat(np.arange(rows), words.counts + 1)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.begins = self.first + PAD * (self.unit_doc + 1)
        out = np.full(total, 32, np.uint8)
        coded = np.ones(total, bool)
        pads = (base[:, None] + np.arange(PAD)).ravel()
        coded[pads] = False
        out[pads] = 0
        ends = base + PAD + size - 1
        out[ends] = END
        body = coded.copy()
        body[ends] = False
        body[self.begins[unit] + lengths] = False
        out[body] = words.data[words.inside]
        self.bytes = out
        self.coded = coded
        self.symbols = out[coded]
        # the last byte, two, four and all, each from the one before
        gram = out.astype(np.uint64)
        for k in (1, 2, 4):
            gram[k:] |= gram[:-k] << np.uint64(8 * k)
        gram = gram[coded]
        gram &= _GRAM
        self.grams = gram

    @cached_property
    def sums(self) -> Sums:
        return byte_sums(self.bytes)

    @cached_property
    def units(self) -> np.ndarray:
        return self.sums.runs(self.begins, self.begins + self.lengths)

    @property
    def at(self) -> np.ndarray:
        return np.flatnonzero(self.coded)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def pairs(self, k: int) -> np.ndarray:
        """A hash of each place's k-th context with the byte there."""
        if k < len(ORDERS):
            context = gram_contexts(tagged(self.grams, ORDERS[k]))
        else:
            context = self.sums.runs(np.repeat(self.begins, self.lengths), self.at)
        return context ^ _MARKS[self.symbols]


def tagged(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of the context and the symbol, under their number."""
    return grams & np.uint64((1 << 8 * (order + 1)) - 1) | np.uint64(order) << _ORDER_AT


def gram_contexts(grams: np.ndarray) -> np.ndarray:
    """Hashes of the contexts of tagged grams, of which no two are alike."""
    return mix(grams >> _BYTE)


def _coded(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, Coded]]:
    for a, b in slices(offsets, limit):
        yield a, b, Coded(Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], WHITE))


class Tree:
    """The Huffman tree of the symbols: for each, the nodes on its path and the branches taken."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, s, (s,)) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        node = 0
        while len(heap) > 1:
            (n0, s0, left), (n1, s1, right) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in enumerate((left, right)):
                for s in side:
                    paths[s].append((node, bit))
            node += 1
            heapq.heappush(heap, (n0 + n1, min(s0, s1), left + right))
        self.lengths = np.array([len(p) for p in paths], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.nodes = np.array([n for p in paths for n, _ in reversed(p)], np.int64)
        self.signs = np.array([2 * b - 1 for p in paths for _, b in reversed(p)], np.float32)
    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each symbol takes, and where each decision stands among the paths."""
        steps = self.lengths[symbols]
        before = np.cumsum(steps, dtype=np.int32) - steps
        return steps, np.arange(int(steps.sum()), dtype=np.int32) + np.repeat(self.starts[symbols] - before, steps)


def byte_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each coded byte stands in the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            total[END] += batch.num_rows
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
                if len(part):
                    inside = ~WHITE[part]
                    begins = np.r_[True, ~inside[:-1]]
                    begins[at[at < len(part)]] = True
                    seen = np.bincount(part, minlength=256)
                    seen[WHITE] = 0
                    total += np.bincount(LOWER, seen, 256).astype(np.int64)
                    total[32] += np.count_nonzero(inside & begins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["s", "n"])

    out = np.zeros(256, np.int64)
    for r in docs.select(text_col).mapInArrow(work, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        out[r["s"]] = r["n"]
    return out


def _edges_of(first: np.ndarray, rows: int) -> np.ndarray:
    """For each row of sorted keys, the number of the group it stands in."""
    return np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, rows]))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, where each key stands among them, and where one of each stood."""
    order = np.argsort(key)
    key = key[order]
    first = group_edges(key)
    back = np.empty(len(order), np.int32)
    back[order] = _edges_of(first, len(order))
    return key[first], np.add.reduceat(n[order], first, dtype=n.dtype) if len(first) else n, back, order[first]


class Pairs:
    """The distinct pairs of context and byte in some texts, with their counts in the training texts.

    ``grams``: tagged, by order and number, and ``edges``: where each order begins; ``up``: for each order but the last,
    where the grams of the next order have theirs. Then the pairs of the distinct units, by the context's hash: ``contexts``
    and ``symbols``; ``units``: hashes of the distinct units, rising, ``often``: their counts, ``unit_rows``: which of them each
    unit of the texts is, ``unit_first``: their first
    places in ``unit_pairs``, the pair of each place of a unit. ``times``: counts of the grams, then of the units' pairs.
    """

    def __init__(self, parts: Iterator[tuple[Coded, np.ndarray]]):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, filled = np.empty(SORTED_PLACES, np.uint64), 0
        hashes, often, lengths, bodies = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        for coded, train in parts:
            places = coded.grams << np.uint64(1)
            places |= np.repeat(train.astype(np.uint64), coded.size)
            if filled + len(places) > len(waiting):
                found.append(self._distinct(waiting[:filled]))
                waiting, filled = waiting if len(places) <= len(waiting) else np.empty(len(places), np.uint64), 0
            waiting[filled : (filled := filled + len(places))] = places
            hashes.append(coded.units)
            often.append(train[coded.unit_doc])
            lengths.append(coded.lengths.astype(np.int32))
            bodies.append(coded.bytes[coded.coded])
        del parts
        found.append(self._distinct(waiting[:filled]))
        del waiting
        key, n = found[0]
        if len(found) > 1:
            key, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = group_edges(key)
            key, n = key[first], np.add.reduceat(n, first, dtype=np.uint32)
            del order, first
        del found
        grams, counts, self.up = [tagged(key, ORDERS[-1])], [n], []
        for k in ORDERS[-2::-1]:
            key, n, back, _ = _summed(tagged(grams[0], k), counts[0])
            grams.insert(0, key)
            counts.insert(0, n)
            self.up.insert(0, back)
        del key, n
        hash_ = np.concatenate(hashes)
        del hashes
        order = np.argsort(hash_).astype(np.int32)
        hash_ = hash_[order]
        first = group_edges(hash_)
        self.units = hash_[first]
        self.unit_rows = np.empty(len(order), np.int32)
        self.unit_rows[order] = _edges_of(first, len(order))
        del hash_
        train = np.concatenate(often)[order]
        self.often = np.add.reduceat(train, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)
        one, lengths = order[first], np.concatenate(lengths)
        del order, train, often, first
        begins = np.cumsum(lengths, dtype=np.int64) - lengths
        begins, lengths = begins[one], lengths[one].astype(np.int64)
        bytes_ = np.concatenate(bodies)
        del bodies, one
        bytes_ = bytes_[_runs(begins, lengths)]
        del begins
        self.unit_first = np.cumsum(lengths) - lengths
        context = np.empty(len(bytes_), np.uint64)
        ends = np.r_[self.unit_first, len(bytes_)]
        for a, b in slices(ends, CODED_BYTES):
            i, j = ends[a], ends[b]
            heads = np.repeat(self.unit_first[a:b] - i, lengths[a:b])
            context[i:j] = byte_sums(bytes_[i:j]).runs(heads, np.arange(j - i))
        _, times, back, one = _summed(context ^ _MARKS[bytes_], np.repeat(self.often, lengths))
        context, symbol = context[one], bytes_[one]
        del bytes_, one
        order = np.argsort(context)
        self.contexts, self.symbols, word_times = context[order], symbol[order], times[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.unit_pairs = place[back]
        del context, symbol, order, place, back, times
        self.edges = np.cumsum([0, *map(len, grams)])
        self.grams, self.times = np.concatenate(grams), np.concatenate([*counts, word_times])

    @staticmethod
    def _distinct(all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of places marked by whether they train, and how many train."""
        all_.sort()
        at = group_edges(all_)
        n = np.diff(np.r_[at, len(all_)])
        key = all_[at]
        n = np.where(key & np.uint64(1), n, 0).astype(np.uint32)
        key >>= np.uint64(1)
        first = group_edges(key)
        return key[first], np.add.reduceat(n, first, dtype=np.uint32) if len(first) else n

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Context and byte of all pairs, grams before those of the units."""
        return (
            np.concatenate([gram_contexts(self.grams), self.contexts]),
            np.concatenate([self.grams.astype(np.uint8), self.symbols]),
        )


def pair_counts(parts: Iterator[tuple[Coded, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, byte, count in training, and hash of the distinct pairs of some texts.

    ``parts``: coded texts, and which of them are for training.
    """
    pairs = Pairs(parts)
    context, symbol = pairs.rows()
    return context, symbol, pairs.times, context ^ _MARKS[symbol]


def corpus_odds(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, tree: Tree) -> np.ndarray:
    """Log odds of the branch taken, in steps of 1 / SCALE (0: never seen), at each decision of each row's byte.

    A row says that the byte follows the context n times; rows of all that sent the context are summed. So many rows are
    worked on at once, those of a context together.
    """
    order = np.argsort(context)
    start, parts, size, a = np.empty(len(order), np.int64), [np.zeros(0, np.int8)], 0, 0
    while a < len(order):
        b = min(a + ODDS_ROWS, len(order))
        # to the end of the last context
        b = int(np.searchsorted(context, context[order[b - 1]], "right", sorter=order))
        part = order[a:b]
        odds, begin = _odds(context[part], symbol[part], n[part], tree)
        start[part] = begin + size
        parts.append(odds)
        size += len(odds)
        a = b
    del order
    found, parts = np.concatenate(parts), []
    for a in range(0, len(start), ODDS_ROWS):
        parts.append(found.take(_runs(start[a : a + ODDS_ROWS], tree.lengths[symbol[a : a + ODDS_ROWS]]), mode="clip"))
    return np.concatenate([np.zeros(0, np.int8), *parts])


def _sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small keys in order, and where each stood, those of equal ones rising."""
    bits = np.uint64(max(1, int(len(key)).bit_length()))
    both = np.sort(key.astype(np.uint64) << bits | np.arange(len(key), dtype=np.uint64))
    return both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _odds(c: np.ndarray, symbol: np.ndarray, n: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The odds of the distinct pairs in rows sorted by context, and where those of each row begin."""
    key, order = _sorted_places(np.cumsum(np.r_[False, c[1:] != c[:-1]]) << 8 | symbol)
    first = group_edges(key)
    back = np.empty(len(order), np.int64)
    back[order] = _edges_of(first, len(order))
    total = np.add.reduceat(n[order].astype(np.int64), first)
    key = key[first]
    steps, inner = tree.steps(key.astype(np.uint8))
    key, by_key = _sorted_places(np.repeat(key >> _BYTE << _BYTE, steps) | tree.nodes[inner].astype(np.uint64))
    edges = group_edges(key)
    times = np.repeat(total, steps)[by_key]
    both = np.add.reduceat(times, edges)
    ones = np.add.reduceat(np.where(tree.signs[inner[by_key]] > 0, times, 0), edges)
    z = np.log((ones + PRIOR) / (both - ones + PRIOR)) * SCALE
    z = np.where(z >= 0, np.maximum(z, 1), np.minimum(z, -1))
    z = np.clip(np.rint(np.where(both > 0, z, 0)), -127, 127).astype(np.int8)
    odds = np.empty(len(key), np.int8)
    odds[by_key] = np.repeat(z, np.diff(np.r_[edges, len(key)]))
    odds *= tree.signs[inner].astype(np.int8)
    return odds, (np.cumsum(steps, dtype=np.int64) - steps)[back]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Answers:
    """The odds of a group's pairs, as the hash ranges have answered them; ``start``: where those of each pair begin.

    ``pair``: hashes of the pairs, for those who look them up.
    """

    def __init__(self, symbol: np.ndarray, pair: np.ndarray | None, odds: np.ndarray, tree: Tree):
        lengths = tree.lengths[symbol].astype(np.int64)
        self.pair, self.start, self.odds = pair, np.cumsum(lengths) - lengths, odds

    def starts(self, pair: np.ndarray) -> np.ndarray:
        """Where the odds of each pair begin."""
        order = np.argsort(self.pair)
        return self.start[order[np.searchsorted(self.pair, pair, sorter=order)]]


class Places:
    """Where numbers stand in an array of distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.last = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        row, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(row):
            free = self.slots[at] < 0
            self.slots[at[free]] = row[free]
            lost = self.slots[at] != row
            row, at = row[lost], (at[lost] + 1) & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, all of which must be there."""
        at = self._home(keys)
        found = self.slots.take(at, mode="clip")
        wrong = np.flatnonzero(self.keys.take(found, mode="clip") != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        return found


class Table:
    """The answers by place: for each gram the odds of all orders side by side, for each place of a unit its odds.

    ``rows``: WIDE bytes for each decision of each gram, namely the odds by order and free ones; ``gram``: 4 * its first row + how many of the gated orders have been seen; ``word``: 2 * where the odds
    begin + whether the context has been seen.
    """

    def __init__(self, pairs: Pairs, start: np.ndarray, odds: np.ndarray, tree: Tree):
        self.odds, self.unit_first = odds, pairs.unit_first
        last, words = pairs.edges[-2], pairs.edges[-1]
        self.grams = Places(pairs.grams[last:])
        # every path begins at the root: a context that has been seen has odds there
        word = start[words:]
        self.word = (word << 1 | (odds[word] != 0))[pairs.unit_pairs]
        symbol = pairs.grams[last:].astype(np.uint8)
        steps = tree.lengths[symbol].astype(np.int64)
        begin = np.cumsum(steps) - steps
        self.rows = np.zeros(int(steps.sum()), np.uint64)
        view = self.rows.view(np.int8).reshape(-1, WIDE)
        seen = np.zeros(len(symbol), np.int64)
        for a in range(0, len(symbol), ODDS_ROWS):
            b = min(a + ODDS_ROWS, len(symbol))
            own, row = steps[a:b], np.arange(a, b)
            i, j = int(begin[a]), int(begin[b - 1] + own[-1])
            step = np.arange(i, j) - np.repeat(begin[a:b], own)
            for k in range(len(ORDERS) - 1, -1, -1):
                row = row if k == len(ORDERS) - 1 else pairs.up[k][row]
                from_ = start[pairs.edges[k] + row]
                view[i:j, k] = odds[np.repeat(from_, own) + step]
                if k >= CONTEXTS - GATED:
                    seen[a:b] += odds[from_] != 0
        self.gram = begin << 2 | seen


def mixed_cost(coded: Coded, rows: int, tree: Tree, answers: Answers | Table, units: np.ndarray | None = None) -> np.ndarray:
    """Natural-log cost of each text. ``units``: with a table, the number of each unit there."""
    gates = GATED + 1
    weights = np.zeros((rows * gates, WIDE), np.float32)
    weights[:, :CONTEXTS] = np.tile(START_WEIGHTS / np.float32(SCALE), (rows, 1))
    cost = np.zeros(rows)
    if not rows:
        return cost
    if isinstance(answers, Answers):
        pairs = Pairs([(coded, np.zeros(rows, bool))])
        context, symbol = pairs.rows()
        answers, units = Table(pairs, answers.starts(context ^ _MARKS[symbol]), answers.odds, tree), pairs.unit_rows
    gram = answers.gram.take(answers.grams.of(tagged(coded.grams, PAD)), mode="clip")
    unit = np.repeat(answers.unit_first[units] - coded.first, coded.lengths)
    unit += np.arange(len(unit))
    word = answers.word.take(unit, mode="clip")
    gate = (gram & 3) + (word & 1)
    # chunks of UPDATE_BYTES places, in the order in which they are worked on: the first ones of all texts, then the second
    chunks = -(-coded.size // UPDATE_BYTES)
    before = np.cumsum(chunks) - chunks
    chunk_doc = np.repeat(np.arange(rows), chunks)
    chunk = np.arange(len(chunk_doc)) - before[chunk_doc]
    places = np.full(len(chunk), UPDATE_BYTES)
    places[before + chunks - 1] = coded.size - (chunks - 1) * UPDATE_BYTES
    by_chunk = np.argsort(chunk, kind="stable")
    rank = np.empty(len(chunk), np.int64)
    rank[by_chunk] = np.arange(len(chunk))
    # places of a text and gate in a chunk stand together: they share their weights
    key, order = _sorted_places(np.repeat(rank, places) * gates + gate)
    first = group_edges(key)
    which = key[first].astype(np.int64)
    chunk, which = chunk[by_chunk[which // gates]], chunk_doc[by_chunk[which // gates]] * gates + which % gates
    del key, unit, gate
    gram, word = gram[order] >> 2, word[order] >> 1
    steps = tree.lengths[coded.symbols[order]]
    begin = np.cumsum(steps, dtype=np.int64) - steps
    at = _runs(gram, steps)
    inputs = answers.rows.take(at, mode="clip").view(np.int8).reshape(-1, WIDE)
    at += np.repeat(word - gram, steps)
    inputs[:, CONTEXTS - 1] = answers.odds.take(at, mode="clip")
    begin = np.r_[begin[first], len(at)]
    run_lengths = np.diff(begin)
    run_cost = np.empty(len(which))
    del at, gram, word, steps, order
    cuts = np.searchsorted(chunk, np.arange(int(chunk[-1]) + 2))
    # the inputs are SCALE times the predictions, and so are their sums; the weights are one SCALE-th
    rate, low, high = np.float32(RATE / SCALE / SCALE), np.float32(-12), np.float32(12)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, j = begin[a], begin[b]
        own, at = which[a:b], begin[a:b] - i
        x = inputs[i:j].astype(np.float32)
        z = np.einsum("ij,ij->i", x, weights[own].repeat(run_lengths[a:b], axis=0))
        np.maximum(np.minimum(z, high, out=z), low, out=z)
        odds = np.exp(np.negative(z, out=z), out=z)
        run_cost[a:b] = np.add.reduceat(np.log1p(odds), at)
        odds /= 1 + odds
        x *= odds.repeat(WIDE).reshape(-1, WIDE)
        weights[own] += rate * np.add.reduceat(x, at, axis=0)
    cost += np.bincount(which // gates, run_cost, rows)
    return cost


@names_apart
def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document by the base model and by context mixing, both learned from the rows where ``training`` holds.

    Adds n_tokens (words and one end), n_known, train_tokens, base_score, score (log10 probabilities) and n_bytes (coded
    bytes, for bits per byte) to the columns but the text's. A null text is empty and costs its end. A null id does no
    harm; repeated rows count each. Without training rows every context is unseen and each decision costs one bit.
    """
    marked = docs.withColumn("__train", F.coalesce(training, F.lit(False)))
    tree = Tree(byte_counts(marked.filter("__train"), text_col))
    n = G.group_count(docs, text_col, 1, GROUP_BYTES)
    texts = G.in_groups(marked, id_col, text_col, n)
    added = "n_tokens long, n_known long, score double, n_bytes long, train_tokens long, base_score double"
    names = [x.split()[0] for x in added.split(", ")]
    columns = [f for f in docs.schema.fields if f.name not in {text_col, *names}]

    def contexts(table_: pa.Table) -> tuple[Pairs, np.ndarray, np.ndarray]:
        """The group's pairs, and its grams by the hash range of their context: in what order, and where each begins."""
        train = table_["__train"].to_numpy()
        pairs = Pairs((coded, train[a:b]) for a, b, coded in _coded(*text_buffers(table_[G.TEXT]), CODED_BYTES))
        to = (gram_contexts(pairs.grams) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        to = to.astype(np.uint16 if n < 1 << 16 else np.uint32)
        return pairs, np.argsort(to, kind="stable"), np.cumsum(np.r_[0, np.bincount(to, minlength=n)])

    def send(table_: pa.Table) -> pa.Table:
        pairs, order, grams_at = contexts(table_)
        units_at, words_at = G.ranges(pairs.units, n, 64), G.ranges(pairs.contexts, n, 64)
        origin, rows, word_times = table_[G.GROUP][0].as_py(), [], pairs.times[len(pairs.grams) :]
        for i in range(n):
            (a, b), (v, w), own = units_at[i : i + 2], words_at[i : i + 2], order[grams_at[i] : grams_at[i + 1]]
            if b > a or w > v or len(own):
                body = pairs.units[a:b], pairs.often[a:b], pairs.grams[own], pairs.times[own], pairs.contexts[v:w], pairs.symbols[v:w], word_times[v:w]
                rows.append((i, origin, pack(*body)))
        return G.messages(rows)

    def total(table_: pa.Table) -> pa.Table:
        """Counts of units and odds of pairs, to each group its own, and the sums of all counts to every group."""
        parts = [unpack(x.as_py()) for x in table_["body"]]
        units_at, grams_at, words_at = (np.cumsum([0, *(len(p[i]) for p in parts)]) for i in (0, 2, 4))
        h, often, grams, times, context, symbol, word_times = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        _, all_, back, _ = _summed(h, often.astype(np.int64))
        symbol, middle = np.concatenate([grams.astype(np.uint8), symbol]), len(grams)
        odds = corpus_odds(np.concatenate([gram_contexts(grams), context]), symbol, np.concatenate([times, word_times]), tree)
        at = np.r_[0, np.cumsum(tree.lengths[symbol], dtype=np.int64)]
        grams_at, words_at = at[grams_at], at[middle + words_at]
        sums = np.array([all_.sum(), (all_ > 0).sum()])
        me, rows = table_["to"][0].as_py(), []
        place = {g: i for i, g in enumerate(table_["origin"].to_pylist())}
        for g in range(n):
            if (i := place.get(g)) is None:
                rows.append((g, me, pack(all_[:0], odds[:0], odds[:0], sums)))
            else:
                (a, b), (v, w), (x, y) = units_at[i : i + 2], grams_at[i : i + 2], words_at[i : i + 2]
                rows.append((g, me, pack(all_[back[a:b]], odds[v:w], odds[x:y], sums)))
        return G.messages(rows)

    def both(table_: pa.Table, answer: pa.Table) -> pa.Table:
        # texts of like lengths are mixed together, all to their ends
        table_ = table_.take(np.argsort(pc.fill_null(pc.binary_length(table_[G.TEXT]), 0).to_numpy(), kind="stable"))
        parts = [unpack(x.as_py()) for x in answer["body"].take(np.argsort(answer["origin"].to_numpy()))]
        c, gram_odds, word_odds = (np.concatenate([p[i] for p in parts]) for i in range(3))
        tokens, vocabulary = np.sum([p[3] for p in parts], axis=0).tolist()
        del parts
        pairs, order, _ = contexts(table_)
        symbol = np.concatenate([pairs.grams.astype(np.uint8)[order], pairs.symbols])
        answers = Answers(symbol, None, np.concatenate([gram_odds, word_odds]), tree)
        start = answers.start.copy()
        start[order] = answers.start[: len(order)]
        odds = answers.odds
        del gram_odds, word_odds, symbol, order, answers
        table, units, end = Table(pairs, start, odds, tree), pairs.unit_rows, 0
        del pairs, start
        logs, each = np.log10(c + 0.5), float(np.log10(tokens + 0.5 * (vocabulary + 1)))
        out = {k: [] for k in names}
        for a, b, coded in _coded(*text_buffers(table_[G.TEXT]), CODED_BYTES):
            at, rows = units[end : (end := end + len(coded.lengths))], b - a
            n_tokens = np.bincount(coded.unit_doc, minlength=rows)
            out["n_tokens"].append(n_tokens)
            out["n_known"].append(np.bincount(coded.unit_doc[c[at] > 0], minlength=rows))
            out["score"].append(-mixed_cost(coded, rows, tree, table, at) / np.log(10))
            out["n_bytes"].append(coded.size)
            out["train_tokens"].append(np.full(rows, tokens))
            out["base_score"].append(np.bincount(coded.unit_doc, logs[at], rows) - n_tokens * each)
        arrays = [table_[f.name] for f in columns] + [pa.array(np.concatenate(out[k])) for k in names]
        return pa.table(arrays, names=[*(f.name for f in columns), *names])

    schema = T.StructType([*columns, *T._parse_datatype_string(added)])
    return G.receive(texts, G.compare(G.send(texts, send), total), both, schema)
