"""Array helpers that the operators use inside Spark tasks: words, windows and hashes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Word separators, by byte. WHITE: everything but ``[^\x20\x09-\x0D]``; PLAIN: all ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.ones(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_STEP, _WORD_STEP, _WORD_STEP_2 = (int(x) | 1 for x in _RANDOM.integers(2**62, 2**63, 3))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64 for i < n."""
    kept = _powers.get(step)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        kept = tuple(
            np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64)
            for x in (step, pow(step, -1, 2**64))
        )
        if size <= 2 * SLICE_BYTES:  # what one very long text needs is not kept
            _powers[step] = kept
    return kept


class Sums:
    """Hashes of any run of a sequence, from sums over its prefixes: equal runs hash alike wherever they stand."""

    def __init__(self, values: np.ndarray, step: int):
        power, self.inverse = _power(step, len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.prefix[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def windows(self, size: int) -> np.ndarray:
        """The hash of each run of ``size`` values, by its start."""
        n = max(0, len(self.prefix) - size)
        return mix((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n])


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(_BYTE_VALUE[data], _BYTE_STEP)


def word_sums(words: np.ndarray, second: bool = False) -> Sums:
    """Sums over word hashes; ``second``: an independent family, to confirm the first."""
    return Sums(words, _WORD_STEP_2 if second else _WORD_STEP)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, one text after the other, and where each begins (one entry more than rows); null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text, or with one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


class Words:
    """The words of some texts.

    ``starts``, ``ends``: byte range of each word; ``doc``: its text; ``first``: number of words before each text (one
    entry more than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            filled = offsets[1:] > offsets[:-1]
            at = offsets[:-1][filled]
            begins[at] |= inside[at]
            at = offsets[1:][filled] - 1
            ends[at] |= inside[at]
        self.inside = inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return byte_sums(self.data).runs(self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """The start of each window of ``size`` words within one text."""
        at = np.arange(max(0, len(self.starts) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    change = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(change[:size]) > 0


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def group_edges(*keys: np.ndarray) -> np.ndarray:
    """In sorted keys, where each group of equal rows begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compact byte string: byte planes, compressed. Rising unsigned arrays are stored as differences."""
    parts = []
    for a in arrays:
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        raw = np.diff(a, prepend=np.uint64(0)) if rising else np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""
        body = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        head = np.array([len(raw), len(body), rising], np.int64).tobytes() + a.dtype.str.encode().ljust(8)
        parts += [head, body]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    out, at = [], 0
    while at < len(blob):
        n, size, rising = np.frombuffer(blob, np.int64, 3, at)
        kind = np.dtype(bytes(blob[at + 24 : at + 32]).decode().strip())
        at += 32
        if n:
            planes = pa.decompress(blob[at : at + int(size)], decompressed_size=int(n) * kind.itemsize, codec="zstd", asbytes=True)
            a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
            a = np.cumsum(a, dtype=np.uint64) if rising else a
        else:
            a = np.zeros(0, kind)
        out.append(a)
        at += int(size)
    return out


def unpack_all(blobs: pa.ChunkedArray, kinds: list) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of several ``pack``, each joined, and the number of entries of each blob."""
    parts = [unpack(x.as_py()) for x in blobs]
    counts = np.array([len(p[0]) for p in parts], np.int64)
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]).astype(k, copy=False) for i, k in enumerate(kinds)], counts
