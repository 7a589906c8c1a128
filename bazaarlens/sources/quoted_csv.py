"""CSV files whose quoted texts hold line breaks, read by as many tasks as the file has splits.

Whether a line begins a record depends on the quotes before it. Each split is read once for its number of quotes and, under
either assumption about its first line, of records; prefix sums over a file's splits tell which assumption holds and how many
records came before. The splits are then read in parallel: records of one line are parsed where they are, and only the lines
of longer ones are brought together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The function sent to the executors carries this module's code, which need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("text", T.StringType()),
        # quotes before the line in its split and in it, modulo 2, and records begun so far if the split begins outside or
        # inside quotes
        T.StructField("before", T.IntegerType()),
        T.StructField("own", T.IntegerType()),
        T.StructField("outside", T.LongType()),
        T.StructField("inside", T.LongType()),
    ]
)


def _annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, quotes, begun = None, 0, [0, 0]
    for batch in batches:
        block, text = batch.column(1).to_numpy(), batch.column(3)
        file = batch.column(0).dictionary_encode()
        own = pc.count_substring(text, '"').to_numpy().astype(np.int64)
        code = file.indices.to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        before, counts = np.zeros(len(own), np.int64), np.zeros((2, len(own)), np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            if a == b:
                continue
            here = (file[a].as_py(), int(block[a]))
            if here != split:
                split, quotes, begun = here, 0, [0, 0]
            before[a:b] = (quotes + np.cumsum(own[a:b]) - own[a:b]) % 2
            for k in (0, 1):
                counts[k, a:b] = begun[k] + np.cumsum(before[a:b] == k)
                begun[k] = int(counts[k, b - 1])
            quotes += int(own[a:b].sum())
        numbers = [pa.array(before, pa.int32()), pa.array(own % 2, pa.int32()), pa.array(counts[0]), pa.array(counts[1])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=_LINE.names)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: the records of CSV files, numbered from 1 in each file, with the line breaks they hold.

    A record that ends in a carriage return and a line feed has line feeds alone in its texts, too. A quote that is never closed makes one record of the rest of its file, as it does for any reader.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"),
    ).mapInArrow(_annotate, _LINE)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg((F.sum("own") % 2).alias("own"), F.max("outside").alias("outside"), F.max("inside").alias("inside"))
    splits = splits.withColumn("open", F.coalesce(F.sum("own").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("starts", F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside")))
    splits = splits.select("file", "block", "open", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("begun"))
    placed = lines.join(splits, ["file", "block"]).select(
        "file", "block", "row", "text",
        (F.col("begun") + F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside"))).alias("record"),
        ((F.col("before") == F.col("open")) & (F.col("own") == 0)).alias("whole"),
    )
    alone = placed.filter("whole").select("file", "record", "text")
    pieces = F.sort_array(F.collect_list(F.struct("block", "row", "text")))
    joined = placed.filter("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    windows = F.replace(F.rtrim("text", F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
    return alone.unionByName(joined).withColumn("text", F.when(F.endswith("text", F.lit("\r")), windows).otherwise(F.col("text")))


def read_quoted_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV files with a header, all ``columns`` as text; a file whose header differs ends the query with an error."""
    records = quoted_records(spark, path).filter("text <> ''")
    text = F.when(F.col("record") == 1, F.ltrim("text", F.lit("﻿"))).otherwise(F.col("text"))
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    parsed = records.select("record", F.from_csv(text, schema, {"escape": '"', "multiLine": "true"}).alias("row"))
    values = F.array(*[F.col("row").getField(c) for c in columns])
    wrong = F.raise_error(F.concat(F.lit("another header: "), F.array_join(values, ","))).cast("boolean")
    header = F.when(values == F.lit(list(columns)), F.lit(False)).otherwise(wrong)
    return parsed.filter(F.when(F.col("record") == 1, header).otherwise(F.lit(True))).select("row.*")
