"""Suffix-array dedup over bytes: a radix sort of suffixes through the first 50 bytes only.

Which suffixes can be equal so far is found by the smallest 24-byte hash of each 50-byte window (equal windows have equal
ones): windows in a row with the same smallest place make a run, and only runs whose 24 bytes stand in two documents are
sorted. All runs with the same 24 bytes meet in one hash range, each distinct run once a group of documents. There the
suffixes that start in them are ordered by passes over eight bytes at a time, most significant first; after each pass
only suffixes that still have an equal go on. What is equal after 50 bytes is exactly a repeated window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm import groups as G
from bazaarlens.llm.arrays import byte_sums, covered, group_edges, member, mix, pack, slices, text_buffers, unpack, unpack_all
from bazaarlens.llm.naming import names_apart

SEED_BYTES = 24
#: A hash range is sorted in so many parts, one after the other, each with all runs of its seeds.
PARTS = 8
_LOW = np.uint64(0xFFFFFFFF)


class _Runs:
    """Runs of windows with the same smallest place, in the texts of a slice.

    ``seed``: hash of the bytes at that place; ``doc``; ``start``: first window; ``windows``: how many; ``hash``: of the
    run's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        n = max(0, len(data) - window + 1)
        if not n:
            self.seed = self.hash = np.zeros(0, np.uint64)
            self.doc = self.start = self.windows = np.zeros(0, np.int64)
            return
        sums = byte_sums(data)
        seeds = sums.windows(SEED_BYTES)
        low = (seeds & ~_LOW) | np.arange(len(seeds), dtype=np.uint64)
        width, span = window - SEED_BYTES + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[width - span : width - span + n])
        place = (low & _LOW).astype(np.int64)
        del low
        sizes = np.diff(offsets)
        whole = np.zeros(n, bool)
        has = sizes >= window
        whole[:] = covered(offsets[:-1][has], offsets[1:][has] - window + 1, n)
        new = whole.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        at = offsets[:-1][has]
        new[at] = True
        self.start = np.flatnonzero(new)
        end = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True]) + 1
        self.windows = end - self.start
        self.seed = seeds[place[self.start]] >> np.uint64(16)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = mix(sums.runs(self.start, end + window - 1) + self.windows.astype(np.uint64))


def _sliced(table: pa.Table, window: int):
    data, offsets = text_buffers(table[G.TEXT])
    for a, b in slices(offsets):
        own = data[offsets[a] : offsets[b]]
        places = offsets[a : b + 1] - offsets[a]
        yield a, own, places, _Runs(own, places, window)


def repeated_windows(blob: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``window`` bytes with another, and where each group of equal ones begins.

    ``starts``: places of the suffixes in ``blob``, each with ``window`` bytes after it.
    """
    digits = np.ndarray((max(0, len(blob) - 7),), ">u8", blob, strides=(1,))
    at, group = starts, np.zeros(len(starts), np.int32)
    first = np.zeros(0, np.int64)
    for depth in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        if not len(at):
            break
        key = digits[at + depth].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        if depth:
            order = order[np.argsort(group[order], kind="stable")]
        at, group, key = at[order], group[order], key[order]
        del order
        first = group_edges(group, key)
        size = np.diff(np.r_[first, len(at)])
        many = size > 1
        keep = np.repeat(many, size)
        at = at[keep]
        size = size[many]
        group = np.repeat(np.arange(len(size), dtype=np.int32), size)
        first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)
    return at, first


def _smaller_ids(
    key: np.ndarray, windows: np.ndarray, doc: np.ndarray, start: np.ndarray, blob: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs given by their hash, number of windows, smallest id and place in ``blob``: the ranges of their windows that
    stand under a smaller id somewhere: number of the run, first window, end, that id."""
    order = np.argsort(key, kind="stable")
    first = group_edges(key[order])
    text_of = np.empty(len(key), np.int64)
    text_of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    lead = order[first]
    smallest = np.minimum.reduceat(doc[order], first)
    kind = np.int32 if len(blob) < 2**31 else np.int64
    count = windows[lead].astype(np.int64)
    base = np.cumsum(count) - count  # where each distinct run's windows stand among all
    of = np.repeat(np.arange(len(lead), dtype=np.int32), count)
    inner = (np.arange(len(of)) - base[of]).astype(kind)
    best = smallest[of]
    at, cuts = repeated_windows(blob, start[lead].astype(kind)[of] + inner, window)
    if len(at):
        # back from a place in the blob to the window's number
        by_start = np.argsort(start[lead])
        which = by_start[np.searchsorted(start[lead][by_start], at, "right") - 1]
        number = base[which] + at - start[lead][which]
        least = np.minimum.reduceat(best[number], cuts)
        best[number] = np.repeat(least, np.diff(np.r_[cuts, len(at)]))
    pieces = group_edges(of, best)
    owner, value = of[pieces], best[pieces]
    begin = inner[pieces]
    end = np.r_[pieces[1:], len(of)] - pieces + begin
    per = np.bincount(owner, minlength=len(lead))
    head = np.cumsum(per) - per
    times = per[text_of]
    entry = np.repeat(np.arange(len(key)), times)
    piece = head[text_of[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    tell = value[piece] < doc[entry]
    entry, piece = entry[tell], piece[tell]
    return entry, begin[piece], end[piece], value[piece]


@names_apart
def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove each byte covered by a string of ``window`` bytes that also starts in a document with a smaller id.

    Texts count as UTF-8 bytes (null: empty) and are judged on the input; matches never cross documents. Keeps all columns
    but the text's and adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256. A null id counts as the
    largest; rows with one id count as one document. An empty table gives an empty result.
    """
    n = G.group_count(docs, text_col)
    texts = G.in_groups(docs, id_col, text_col, n)
    columns = [f for f in docs.schema.fields if f.name not in (text_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")]

    def seeds(table: pa.Table) -> pa.Table:
        ids, found = table[G.ID].to_numpy(), []
        for a, _, _, runs in _sliced(table, window):
            found.append((runs.seed, ids[runs.doc + a]))
        seed, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(seed, kind="stable")
        seed, doc = seed[order], doc[order]
        first = group_edges(seed)
        last = np.r_[first[1:], len(seed)] - 1 if len(first) else first
        return G.to_ranges(table[G.GROUP][0].as_py(), n, 48, seed[first], (doc[first] != doc[last]).astype(np.uint8))

    def shared(table: pa.Table) -> pa.Table:
        (seed, many), counts = unpack_all(table["body"], [np.uint64, np.uint8])
        origin = np.repeat(table["origin"].to_numpy(), counts)
        order = np.argsort(seed, kind="stable")
        seed, many, origin = seed[order], many[order], origin[order]
        first = group_edges(seed)
        if not len(first):
            return G.messages([])
        size = np.diff(np.r_[first, len(seed)])
        found = np.repeat((size > 1) | (np.bitwise_or.reduceat(many, first) > 0), size)
        return G.answers(origin[found], seed[found])

    def runs_of(table: pa.Table, answer: pa.Table) -> pa.Table:
        wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_py())[0] for x in answer["body"])]))
        ids, found, bodies = table[G.ID].to_numpy(), [], []
        seen = np.zeros(0, np.uint64)
        for a, own, _, runs in _sliced(table, window) if len(wanted) else ():
            take = np.flatnonzero(member(runs.seed, wanted))
            _, lead = np.unique(runs.hash[take], return_index=True)  # the first, so of the smallest id
            take = take[lead]
            take = take[~member(runs.hash[take], seen)]
            seen = np.union1d(seen, runs.hash[take])
            found.append((runs.seed[take], runs.hash[take], runs.windows[take].astype(np.int32), ids[runs.doc[take] + a]))
            flat = own.tobytes()
            bodies += [flat[s:e] for s, e in zip(runs.start[take].tolist(), (runs.start[take] + runs.windows[take] + window - 1).tolist(), strict=True)]
        if not found:
            return G.messages([])
        seed, key, windows, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(seed, kind="stable")
        origin = table[G.GROUP][0].as_py()
        edges = G.ranges(seed[order], n, 48)
        rows = []
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                part = order[a:b]
                part = part[np.argsort(key[part])]
                text = np.frombuffer(b"".join(bodies[j] for j in part.tolist()), np.uint8)
                rows.append((i, origin, pack(key[part], windows[part], doc[part], (seed[part] % np.uint64(PARTS)).astype(np.uint8), text)))
        return G.messages(rows)

    def ordered(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table["body"]]
        if not parts:
            return G.messages([])
        origin = np.repeat(table["origin"].to_numpy(), [len(p[0]) for p in parts])
        key, windows, doc, part, blob = (np.concatenate([p[i] for p in parts]) for i in range(5))
        del parts
        size = windows.astype(np.int64) + window - 1
        start = np.cumsum(size) - size
        found = [np.flatnonzero(part == i) for i in range(PARTS)]
        told = [(i, *_smaller_ids(key[i], windows[i], doc[i], start[i], blob, window)) for i in found if len(i)]
        if not told:
            return G.messages([])
        entry = np.concatenate([i[e] for i, e, *_ in told])
        begin, end, value = (np.concatenate([t[k] for t in told]) for k in (2, 3, 4))
        return G.answers(origin[entry], key[entry], begin.astype(np.int32), end.astype(np.int32), value)

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        (key, begin, end, value), _ = unpack_all(answer["body"], [np.uint64, np.int32, np.int32, np.int64])
        order = np.argsort(key, kind="stable")
        key, begin, end, value = key[order], begin[order], end[order], value[order]
        ids = table[G.ID].to_numpy()
        local = [(runs.hash, ids[runs.doc + a]) for a, _, _, runs in _sliced(table, window)]
        run_key, run_doc = (np.concatenate(x) for x in zip(*local, strict=True))
        by_key = np.argsort(run_key, kind="stable")
        first = group_edges(run_key[by_key])
        lead = np.empty(len(run_key), np.int64)
        lead[by_key] = np.repeat(by_key[first], np.diff(np.r_[first, len(run_key)]))
        copy = run_doc[lead] < run_doc
        n_bytes, n_removed, n_spans, digests, done = [], [], [], [], 0
        for a, own, places, runs in _sliced(table, window):
            whole = np.flatnonzero(copy[done : done + len(runs.hash)])
            done += len(runs.hash)
            lo, hi = np.searchsorted(key, runs.hash, "left"), np.searchsorted(key, runs.hash, "right")
            run = np.repeat(np.arange(len(lo)), hi - lo)
            piece = np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            told = value[piece] < ids[runs.doc[run] + a]
            run, piece = run[told], piece[told]
            starts = np.r_[runs.start[whole], runs.start[run] + begin[piece]]
            ends = np.r_[runs.start[whole] + runs.windows[whole], runs.start[run] + end[piece]] + window - 1
            gone = covered(starts, ends, len(own))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            filled = places[:-1][np.diff(places) > 0]
            opens[filled] |= gone[filled]
            total, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(opens)]
            n_bytes.append(np.diff(places))
            n_removed.append(np.diff(total[places]))
            n_spans.append(np.diff(spans[places]))
            kept = own[~gone].tobytes()
            edge = places - total[places]
            digests += [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        out = [table[f.name] for f in columns]
        out += [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_bytes, n_removed, n_spans)]
        return pa.table(
            [*out, pa.array(digests, pa.string())],
            names=[*(f.name for f in columns), "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    new = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    schema = T.StructType([*columns, *(T.StructField(k, v) for k, v in new)])
    common = G.compare(G.send(texts, seeds), shared)
    repeats = G.compare(G.receive(texts, common, runs_of), ordered)
    return G.receive(texts, repeats, remove, schema)
