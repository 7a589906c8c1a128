"""Groups of documents, and messages between them.

Operators that look for equal pieces of text all over the corpus work in rounds. Documents are dealt once, by a hash of
their id, into groups, by the bytes of text there are, and there are as many hash ranges. In each round a group sends one packed row of its distinct
hashes to each hash range, a range compares what all groups sent, and sends back to each group only what that group has
to know. A piece that a third of all documents hold is thus one entry a group, not one a document; texts are shuffled
once, packed, as the rounds of a query share the exchange.

So a group's memory is bounded whatever the number of shuffle partitions is. But a round has up to the square of the number
of groups of messages: with groups of LARGEST bytes, one for each 1.3 KB of text at 200 GB. Beyond that messages outweigh
texts; they would have to be merged on the way, over several hops, which is not built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.arrays import group_edges, pack

GROUP, ID, TEXT = "__group", "__id", "__text"
#: Several groups share a task, so that tasks are even and a group is small; but no group is split below SMALLEST bytes of
#: text for that, nor has one, on average, more than LARGEST.
GROUPS_PER_TASK = 3
SMALLEST, LARGEST = 4 << 20, 16 << 20
#: Documents that a task gathers before it packs them.
PACK_BYTES = 32 << 20
#: A null id stands after all others.
LAST_ID = 2**63 - 1
MESSAGE = T.StructType(
    [T.StructField("to", T.IntegerType()), T.StructField("origin", T.IntegerType()), T.StructField("body", T.BinaryType())]
)
MESSAGE_ARROW = pa.schema([("to", pa.int32()), ("origin", pa.int32()), ("body", pa.binary())])


def group_count(docs: DataFrame, text_col: str, per_task: int = GROUPS_PER_TASK, largest: int = LARGEST) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    wanted = per_task * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // largest), min(wanted, -(-size // SMALLEST)))


def in_groups(docs: DataFrame, id_col: str, text_col: str, groups: int) -> DataFrame:
    """The documents by group, packed: in each row what one task has of a group, as a compressed Arrow table with group,
    id (null: last) and text in columns of their own."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    rows = docs.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias(GROUP), key.alias(ID), F.col(text_col).cast("string").alias(TEXT),
        *[c for c in docs.columns if c != text_col],
    )
    return rows.mapInArrow(_packed, f"{GROUP} int, body binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= PACK_BYTES:
            yield _pack_groups(waiting)
            waiting = []
    if waiting:
        yield _pack_groups(waiting)


def _pack_groups(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    order = np.argsort(table[GROUP].to_numpy(), kind="stable")
    table = table.take(order)
    group = table[GROUP].to_numpy()
    first = group_edges(group)
    bodies = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=False):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.slice(a, b - a).combine_chunks())
        bodies.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), pa.array(bodies, pa.binary())], names=[GROUP, "body"])


def in_order(packed: pa.Table) -> pa.Table:
    """A group's documents by id: the same order in each round, whatever order a shuffle gave them."""
    table = pa.concat_tables([pa.ipc.open_stream(body.as_buffer()).read_all() for body in packed["body"]])
    ids = table[ID].to_numpy()
    ties = len(np.unique(ids)) < len(ids)
    order = pc.sort_indices(table, [(ID, "ascending"), (TEXT, "ascending")]) if ties else np.argsort(ids)
    return table.take(order)


def ranges(hashes: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """Where each of ``groups`` equal ranges of ``bits``-bit hashes begins in a sorted array, and the array's end."""
    edges = np.array([(i << bits) // groups for i in range(groups)], np.uint64)
    return np.r_[np.searchsorted(hashes, edges), len(hashes)]


def to_ranges(origin: int, groups: int, bits: int, key: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    """One message to each hash range that has entries; ``key`` is sorted."""
    edges = ranges(key, groups, bits)
    rows = [
        (i, origin, pack(key[a:b], *(x[a:b] for x in arrays)))
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        if b > a
    ]
    return messages(rows)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, origin, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(to, pa.int32()), pa.array(origin, pa.int32()), pa.array(body, pa.binary())], schema=MESSAGE_ARROW)


def answers(origin: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    """Entries sent back to the groups they came from, in their order."""
    if not len(origin):
        return messages([])
    order = np.argsort(origin, kind="stable")
    origin = origin[order]
    cuts = np.flatnonzero(np.r_[True, origin[1:] != origin[:-1]])
    rows = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(origin)], strict=True):
        part = order[a:b]
        rows.append((int(origin[a]), -1, pack(*(x[part] for x in arrays))))
    return messages(rows)


def returned(result: pa.Table) -> pa.Table:
    """Gives what a group has used back to the system, as the worker will live on."""
    pa.default_memory_pool().release_unused()
    return result


def send(texts: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return texts.groupBy(GROUP).applyInArrow(lambda t: returned(work(in_order(t))), MESSAGE)


def compare(sent: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return sent.groupBy("to").applyInArrow(lambda t: returned(work(t)), MESSAGE)


def receive(
    texts: DataFrame, answered: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType = MESSAGE
) -> DataFrame:
    """Each group with what was answered to it."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return returned(work(in_order(left), right)) if len(left) else empty

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    return texts.groupBy(GROUP).cogroup(answered.groupBy("to")).applyInArrow(both, schema)
