"""Substring dedup over words: fixed-block anchors.

A window of 20 words holds at least one whole block of 10 words that begins at a multiple of 10 in the document where it
stands. So the blocks at multiples of 10 are the index, and every rolling window of 10 words is a probe: a hash that was
probed twice or more and has an indexed block is an anchor. Only around anchors are repeats looked for: each hit is
extended to the 20-word windows about it, and a window's earliest place in the corpus decides about all its others, so
that runs of repeated windows grow to maximal exact repeats. The first hash only selects candidates (48 bits); windows
are compared by 96 bits of two independent hash families.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm import groups as G
from bazaarlens.llm.arrays import (
    WHITE,
    Words,
    covered,
    group_edges,
    member,
    slices,
    text_buffers,
    unpack,
    unpack_all,
    word_sums,
)
from bazaarlens.llm.naming import names_apart

ANCHOR_BITS = 48


def _sliced(table: pa.Table):
    data, offsets = text_buffers(table[G.TEXT])
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WHITE)


def _anchor_hashes(words: Words, hashes: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the rolling blocks of the documents that have a window."""
    at = words.windows(block)
    at = at[words.counts[words.doc[at]] >= window]
    return at, word_sums(hashes).windows(block)[at] >> np.uint64(64 - ANCHOR_BITS)


def _window_hashes(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = words.windows(window)
    check = word_sums(hashes, second=True).windows(window)[at] >> np.uint64(32)
    return at, word_sums(hashes).windows(window)[at], check.astype(np.uint32)


@names_apart
def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False
) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``; earlier: a smaller id, or the same id and an earlier start. Windows are judged on
    the input. Keeps all columns but the text's and adds n_words, n_removed, kept_sha256 (kept words joined by a space)
    and, ``with_text``, the text column: unchanged where nothing is removed, else the kept words joined by a space.
    Null or empty texts have no words; a null id counts as the largest; rows with one id count as one document, so a
    row repeated as a whole removes nothing of its twin. An empty table gives an empty result.
    """
    block = window // 2
    n = G.group_count(docs, text_col)
    columns = [f for f in docs.schema.fields if f.name != text_col]
    texts = G.in_groups(docs, id_col, text_col, n)

    def probe(table: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.uint64)]
        for _, _, words in _sliced(table):
            at, h = _anchor_hashes(words, words.hashes(), block, window)
            aligned = (at - words.first[words.doc[at]]) % block == 0
            keys.append(h << np.uint64(1) | aligned.astype(np.uint64))
        keys = np.sort(np.concatenate(keys))
        h = keys >> np.uint64(1)
        first = group_edges(h)
        size = np.diff(np.r_[first, len(h)])
        aligned = keys[first + size - 1] & np.uint64(1)
        flags = aligned.astype(np.uint8) | (size > 1).astype(np.uint8) << 1
        return G.to_ranges(table[G.GROUP][0].as_py(), n, ANCHOR_BITS, h[first], flags)

    def shared(table: pa.Table) -> pa.Table:
        (h, flags), counts = unpack_all(table["body"], [np.uint64, np.uint8])
        origin = np.repeat(table["origin"].to_numpy(), counts)
        order = np.argsort(h, kind="stable")
        h, flags, origin = h[order], flags[order], origin[order]
        first = group_edges(h)
        if not len(first):
            return G.messages([])
        size = np.diff(np.r_[first, len(h)])
        any_flag = np.bitwise_or.reduceat(flags, first)
        found = np.repeat(((size > 1) | (any_flag & 2 > 0)) & (any_flag & 1 > 0), size)
        return G.answers(origin[found], h[found])

    def extend(table: pa.Table, answer: pa.Table) -> pa.Table:
        anchors = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_py())[0] for x in answer["body"])]))
        ids = table[G.ID].to_numpy()
        found = []
        for a, _, words in _sliced(table) if len(anchors) else ():
            hashes = words.hashes()
            at, h = _anchor_hashes(words, hashes, block, window)
            hit = np.zeros(len(words.starts) + window + 1, np.int64)
            hit[at + 1] = member(h, anchors)
            hits = np.cumsum(hit)
            at, h, check = _window_hashes(words, hashes, window)
            near = hits[at + window - block + 1] > hits[at]
            at = at[near]
            doc = words.doc[at]
            found.append((h[near], check[near], ids[doc + a], (at - words.first[doc]).astype(np.int32)))
        if not found:
            return G.messages([])
        h, check, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, check, doc, pos = h[order], check[order], doc[order], pos[order]
        first = group_edges(h, check)
        return G.to_ranges(table[G.GROUP][0].as_py(), n, 64, h[first], check[first], doc[first], pos[first])

    def earliest(table: pa.Table) -> pa.Table:
        (h, check, doc, pos), counts = unpack_all(table["body"], [np.uint64, np.uint32, np.int64, np.int32])
        origin = np.repeat(table["origin"].to_numpy(), counts)
        order = np.lexsort((pos, doc, check, h))
        h, check, doc, pos, origin = h[order], check[order], doc[order], pos[order], origin[order]
        first = group_edges(h, check)
        lead = np.repeat(first, np.diff(np.r_[first, len(h)]))
        later = (doc != doc[lead]) | (pos != pos[lead])
        return G.answers(origin[later], h[later], check[later])

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        (known, known_check), _ = unpack_all(answer["body"], [np.uint64, np.uint32])
        order = np.argsort(known, kind="stable")
        known, known_check = known[order], known_check[order]
        ids = table[G.ID].to_numpy()
        parts = []
        for a, _, words in _sliced(table):
            at, h, check = _window_hashes(words, words.hashes(), window)
            doc = words.doc[at]
            parts.append((h, check, doc + a, (at - words.first[doc]).astype(np.int32)))
        row_of = np.zeros(0, np.int64)
        gone = np.zeros(0, bool)
        if parts:
            h, check, row_of, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            first = group_edges(h[order], check[order])
            lead = np.empty(len(h), np.int64)
            lead[order] = np.repeat(order[first], np.diff(np.r_[first, len(h)]))
            gone = (ids[row_of] != ids[row_of[lead]]) | (pos != pos[lead])
            gone |= _answered(h, check, known, known_check)
        n_words, n_removed, digests, kept = [], [], [], []
        at = 0
        for _, _, words in _sliced(table):
            starts = words.windows(window)
            removed = covered(starts[gone[at : at + len(starts)]], starts[gone[at : at + len(starts)]] + window, len(words.starts))
            at += len(starts)
            n_words.append(words.counts)
            n_removed.append(np.bincount(words.doc[removed], minlength=len(words.counts)))
            for text in kept_words(words, ~removed):
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode("utf-8", "replace"))
        n_words, n_removed = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (n_words, n_removed))
        out = {f.name: table[f.name] for f in columns}
        out |= {"n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            old = table[G.TEXT]
            out[text_col] = pa.array([k if r else o.as_py() for k, r, o in zip(kept, n_removed, old, strict=True)], pa.string())
        return pa.table(list(out.values()), names=list(out))

    new = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    new += [(text_col, T.StringType())] if with_text else []
    columns = [f for f in columns if f.name not in dict(new)]
    schema = T.StructType([*columns, *(T.StructField(k, v) for k, v in new)])
    anchors = G.compare(G.send(texts, probe), shared)
    repeats = G.compare(G.receive(texts, anchors, extend), earliest)
    return G.receive(texts, repeats, remove, schema)


def _answered(h: np.ndarray, check: np.ndarray, known: np.ndarray, known_check: np.ndarray) -> np.ndarray:
    """Which windows are among the known ones; equal first hashes stand side by side in ``known``."""
    found = np.zeros(len(h), bool)
    if len(known):
        at = np.searchsorted(known, h)
        open_ = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h))
        at = at[open_]
        while len(open_):
            found[open_[known_check[at] == check[open_]]] = True
            at = at + 1
            on = at < len(known)
            open_, at = open_[on], at[on]
            on = known[at] == h[open_]
            open_, at = open_[on], at[on]
    return found


def kept_words(words: Words, keep: np.ndarray):
    """Of each text, the kept words joined by a space."""
    size = len(words.data)
    body = covered(words.starts[keep], words.ends[keep], size)
    after = words.ends[keep]
    after = after[after < size]
    after = after[~words.inside[after]]
    space = np.zeros(size, bool)
    space[after] = True
    out = np.where(space, np.uint8(32), words.data)
    picked = body | space
    counts = np.r_[0, np.cumsum(picked)][words.offsets]
    flat = out[picked].tobytes()
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        text = flat[a:b]  # a word that ends a text may have marked the space that begins the next one
        yield text[1:].removesuffix(b" ") if text[:1] == b" " else text.removesuffix(b" ")
