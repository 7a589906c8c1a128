"""The training-data pipeline over ``documents``: STAGES in order, each written as Parquet and read again by the next.

Every stage takes (spark, docs, folder of the tables). All but the last return the columns of ``docs``, whatever else they
hold; the last returns the token ids beside them. Documents may have null columns, empty texts and repeated rows, or be
none at all: see the operators' docstrings. Rows that share a doc_id count as one document, and rows without one are never
taken for duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.storage import materialise
from bazaarlens.llm.bpe import encode
from bazaarlens.llm.decontaminate import contamination
from bazaarlens.llm.neardup import near_duplicates
from bazaarlens.llm.quality import fit, judge, signals
from bazaarlens.llm.queries import ranks_and_pattern
from bazaarlens.llm.shipping import ship
from bazaarlens.llm.substring import substring_dedup

#: Near copies: so many per cent of their distinct shingles of so many words in common.
NEAR_SIZE, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_ROW = "__row"


def _carried(docs: DataFrame) -> DataFrame:
    """The other columns in one, so that none clashes with what an operator adds."""
    ship(docs.sparkSession)
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias(_ROW), "doc_id", "text")


def _unpacked(carried: DataFrame, docs: DataFrame) -> DataFrame:
    return carried.select(*["text" if c == "text" else F.col(f"{_ROW}.{c}") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules reject go."""
    carried = _carried(docs)
    model = fit(signals(docs.select("doc_id", "text")))
    judged = judge(signals(carried, with_text=True), model)
    return _unpacked(judged.filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies, linked by five-word shingles of similarity 0.8 or more, the document with the smallest
    id stays, a null one standing last; of several rows with that id one. Documents without a word all stay."""
    rows = materialise(_carried(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    judged = near_duplicates(rows, size=NEAR_SIZE, percent=NEAR_PERCENT, row_col="row")
    return _unpacked(rows.join(judged.filter("kept").select("row"), "row", "left_semi"), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words in windows that stand earlier in the corpus go; n_chars follows the text, and a document left without a word
    stays, empty."""
    out = _unpacked(substring_dedup(_carried(docs), with_text=True), docs)
    if "n_chars" not in docs.columns:
        return out
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return _unpacked(contamination(_carried(docs), benchmark, with_text=True).filter("NOT contaminated"), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    ship(spark)
    return encode(docs, *ranks_and_pattern(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Merging by rank and expectation-maximisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
