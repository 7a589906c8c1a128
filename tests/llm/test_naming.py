"""Columns of a caller that carry the names operators use themselves."""

from __future__ import annotations

import corpora as R
import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm.bpe import encode
from bazaarlens.llm.decontaminate import Index, contamination
from bazaarlens.llm.licenses import license_scan
from bazaarlens.llm.mixing import score
from bazaarlens.llm.quality import signals
from bazaarlens.llm.queries import ranks_and_pattern
from bazaarlens.llm.substring import substring_dedup
from bazaarlens.llm.suffixes import suffix_dedup

CLASHING = ("__text", "__id", "__group", "__train", "__row", "__found")


def _decontaminated(docs):
    items = docs.sparkSession.createDataFrame([(1, R.sentence(30, 1))], "item_id int, text string")
    return contamination(docs, items)


OPERATORS = {
    "encode": lambda docs: encode(docs, *ranks_and_pattern()),
    "contamination": _decontaminated,
    "license_scan": license_scan,
    "score": lambda docs: score(docs, F.col("doc_id") % 2 == 0),
    "signals": signals,
    "substring_dedup": substring_dedup,
    "suffix_dedup": suffix_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_pass_through(spark, name):
    docs = R.documents(spark, R.hard_documents()[:6]).select("doc_id", "text")
    clashing = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    plain, got = OPERATORS[name](docs), OPERATORS[name](clashing)
    assert set(got.columns) == {*plain.columns, *CLASHING}
    rows = got.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)
    same = lambda found: sorted(str(tuple(r[c] for c in plain.columns)) for r in found)
    assert same(rows) == same(plain.collect())


def test_a_clashing_column_can_be_the_text(spark):
    docs = R.documents(spark, R.hard_documents()[:6]).select("doc_id", "text")
    wanted = sorted(map(tuple, suffix_dedup(docs).collect()))
    assert sorted(map(tuple, suffix_dedup(docs.withColumnRenamed("text", "__text"), text_col="__text").collect())) == wanted


@pytest.mark.parametrize("n", [100, 20_000])
def test_the_shift_table_skips_at_every_size(n):
    pick = np.random.default_rng(1)
    bodies = {" ".join(f"w{x}" for x in pick.integers(0, 10**6, 10)).encode() for _ in range(n)}
    index = Index([(b, ["x"]) for b in sorted(bodies)], 10)
    assert index.shift.max() == 9 and index.shift.mean() > 8
