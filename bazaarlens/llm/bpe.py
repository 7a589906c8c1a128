"""Byte-level BPE with a global shuffle of distinct words.

Documents are split into pre-tokens once; what travels are the distinct ones of some documents and their places. Each group of documents sends its distinct words to
their hash ranges; a range merges each distinct word of the corpus once and sends its ids back; the group puts the ids
together again by position. Words that are a token of their own need no shuffle. Decoding looks the bytes of each id up
in the token table, which a vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.llm import groups as G
from bazaarlens.llm.arrays import byte_sums, group_edges, pack, slices, text_buffers, unpack
from bazaarlens.llm.naming import names_apart

#: Longer words are merged with a heap.
SHORT_WORD = 48
#: Pre-tokens that are put together at once.
PLACES = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(parts[0]): int(parts[1]) for parts in lines if parts}


class TokenTable:
    """The bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: of adjacent parts the pair with the lowest rank, the leftmost of them, is merged until none has a
    rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT_WORD:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        low = min(pairs)
        if low == 1 << 60:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list of parts."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = after[i]
    return ids


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _split(texts: pa.ChunkedArray, split: regex.Pattern) -> tuple[bytes, bytes]:
    """Texts as pre-tokens: the distinct ones, and for each text the numbers of its own in their order; both packed."""
    numbers, counts, codes = _Numbers(), [], []
    data, offsets = text_buffers(texts)
    for a, b in slices(offsets):
        flat, at = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
        for x, y in zip(at[:-1], at[1:], strict=True):
            found = split.findall(flat[x:y].decode("utf-8", "replace"))
            counts.append(len(found))
            codes.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
    words = [w.encode() for w in numbers]
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    places = np.concatenate([np.zeros(0, np.uint32), *codes])
    return pack(lengths, np.frombuffer(b"".join(words), np.uint8)), pack(np.array(counts, np.uint32), places)


def _words(body: bytes) -> list[bytes]:
    lengths, flat = unpack(body)
    ends, flat = np.cumsum(np.r_[0, lengths.astype(np.int64)]).tolist(), flat.tobytes()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_CODED = pa.schema([(G.GROUP, pa.int32()), ("rows", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])


def _coded(table: pa.Table, split: regex.Pattern) -> pa.RecordBatch:
    """Documents by group: the columns but the text, the distinct pre-tokens and where they stand."""
    table = table.take(np.argsort(table[G.GROUP].to_numpy(), kind="stable"))
    group = table[G.GROUP].to_numpy()
    first = group_edges(group)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True):
        part = table.slice(a, b - a)
        sink = pa.BufferOutputStream()
        rows = part.drop_columns([G.TEXT]).combine_chunks()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows)
        out.append((int(group[a]), sink.getvalue().to_pybytes(), *_split(part[G.TEXT], split)))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _CODED, strict=True)], schema=_CODED)


def _unknown(words: set[bytes], ranks: dict[bytes, int], n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words without an id of their own in the order of their hash, their ends when joined, and where each range begins."""
    open_ = [w for w in words if w not in ranks]
    ends = np.cumsum([0, *map(len, open_)])
    h = byte_sums(np.frombuffer(b"".join(open_), np.uint8)).runs(ends[:-1], ends[1:])
    order = np.lexsort((np.diff(ends), h))
    if len(h) and len(np.unique(h)) < len(h):  # equal hashes: the words themselves decide, so that order never varies
        order = np.array(sorted(range(len(h)), key=lambda i: (int(h[i]), open_[i])))
    ranked = [open_[i] for i in order.tolist()]
    return ranked, np.cumsum([0, *map(len, ranked)]), G.ranges(h[order], n, 64)


@names_apart
def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Ids of each whole text, and the digests of the ids and of the bytes they decode to.

    Each match of ``pattern`` is encoded separately, without special tokens. Keeps all columns but the text's and adds
    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 and, ``with_ids``, ids. Null is
    an empty text, which has no tokens. Null and repeated ids do no harm. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = G.group_count(docs, text_col)
    shared = spark.sparkContext.broadcast((ranks, TokenTable(ranks)))
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    new += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    columns = [f for f in docs.schema.fields if f.name not in {text_col, *dict(new)}]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, waiting = regex.compile(pattern), []
        for batch in batches:
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= G.PACK_BYTES:
                yield _coded(pa.Table.from_batches(waiting), split)
                waiting = []
        if waiting:
            yield _coded(pa.Table.from_batches(waiting), split)

    # the pattern is matched here alone: what is shuffled are numbers of pre-tokens, with these
    id_, text = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.col(text_col).cast("string")
    rows = docs.select(F.pmod(F.xxhash64(id_), F.lit(n)).cast("int").alias(G.GROUP), text.alias(G.TEXT), *(F.col(f.name) for f in columns))
    coded = rows.mapInArrow(code, f"{G.GROUP} int, rows binary, words binary, places binary")

    def send(table: pa.Table) -> pa.Table:
        distinct = set().union(*(_words(x.as_py()) for x in table["words"]))
        words, ends, edges = _unknown(distinct, shared.value[0], n)
        rows = []
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b > a:
                body = pack(np.diff(ends[a : b + 1]).astype(np.uint32), np.frombuffer(b"".join(words[a:b]), np.uint8))
                rows.append((i, table[G.GROUP][0].as_py(), body))
        return G.messages(rows)

    def merge_once(table: pa.Table) -> pa.Table:
        ranks_, known, rows = shared.value[0], {}, []
        for to, origin, body in zip(table["to"].to_pylist(), table["origin"].to_pylist(), table["body"], strict=True):
            lengths, flat = unpack(body.as_py())
            ends, flat = np.cumsum(np.r_[0, lengths]).tolist(), flat.tobytes()
            found = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                word = flat[a:b]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = np.array(merge(word, ranks_), np.uint32).tobytes()
                found.append(ids)
            counts = np.array([len(x) // 4 for x in found], np.uint32)
            rows.append((origin, to, pack(counts, np.frombuffer(b"".join(found), np.uint32))))
        return G.messages(rows)

    def assemble(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(table):
            return to_arrow_schema(schema).empty_table()
        ranks_, tokens = shared.value
        by_pack = [_words(x.as_py()) for x in table["words"]]
        distinct = set().union(*by_pack)
        open_, _, _ = _unknown(distinct, ranks_, n)
        single = [w for w in distinct if w in ranks_]
        number = {w: i for i, w in enumerate([*open_, *single])}
        order = np.argsort(answer["origin"].to_numpy())
        parts = [unpack(answer["body"][int(i)].as_py()) for i in order]
        lengths = np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts), np.ones(len(single), np.uint32)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(p[1] for p in parts), np.array([ranks_[w] for w in single], np.uint32)])
        starts = np.cumsum(lengths) - lengths
        found = []
        for words, body, rows in zip(by_pack, table["places"], table["rows"], strict=True):
            counts, codes = unpack(body.as_py())
            renumbered = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            documents = pa.ipc.open_stream(rows.as_buffer()).read_all()
            at = np.r_[0, np.cumsum(counts.astype(np.int64))]
            n_tokens, coded_, decoded, all_ids = [], [], [], []
            for a, b in slices(at, PLACES):
                places = renumbered[codes[at[a] : at[b]]]
                ids = gather(flat, starts[places], lengths[places]).astype(np.int64)
                cut = np.r_[0, np.cumsum(lengths[places])][at[a : b + 1] - at[a]]
                raw, text = ids.astype("<u4").tobytes(), tokens.decode(ids).tobytes()
                text_cut = np.r_[0, np.cumsum(tokens.lengths[ids])][cut].tolist()
                n_tokens.append(np.diff(cut))
                cut = cut.tolist()
                for i in range(b - a):
                    coded_.append(hashlib.sha256(raw[4 * cut[i] : 4 * cut[i + 1]]).hexdigest())
                    decoded.append(hashlib.sha256(text[text_cut[i] : text_cut[i + 1]]).hexdigest())
                    if with_ids:
                        all_ids.append(ids[cut[i] : cut[i + 1]].astype(np.int32))
            out = {f.name: documents[f.name] for f in columns}
            out["n_tokens"] = pa.array(np.concatenate([np.zeros(0, np.int64), *n_tokens]).astype(np.int64))
            out["ids_sha256"], out["decoded_sha256"] = pa.array(coded_, pa.string()), pa.array(decoded, pa.string())
            if with_ids:
                out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            found.append(pa.table(list(out.values()), names=list(out)))
        return pa.concat_tables(found)

    schema = T.StructType([*columns, *(T.StructField(k, v) for k, v in new)])
    # all columns, so that both rounds read one exchange
    sent = coded.groupBy(G.GROUP).applyInArrow(lambda t: G.returned(send(t)), G.MESSAGE)
    merged = G.compare(sent, merge_once)
    return coded.groupBy(G.GROUP).cogroup(merged.groupBy("to")).applyInArrow(lambda t, answer: G.returned(assemble(t, answer)), schema)


def decode(coded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of each row's ids (bytes that are no UTF-8 are replaced); null ids give null."""
    shared = coded.sparkSession.sparkContext.broadcast(TokenTable(ranks))
    keep = [c for c in coded.columns if c != text_col]
    schema = T.StructType([*(coded.schema[c] for c in keep), T.StructField(text_col, T.StringType())])
    target = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            texts = [
                None if x.as_py() is None else shared.value.decode(np.array(x.as_py(), np.int64)).tobytes().decode("utf-8", "replace")
                for x in batch.column(ids_col)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema=target)

    return coded.select(*keep).mapInArrow(work, schema)
