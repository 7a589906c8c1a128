"""CSV with line breaks inside quotes, read split by split."""

from __future__ import annotations

import random

import pytest

from bazaarlens.sources.quoted_csv import quoted_records, read_quoted_csv

COLUMNS = ["id", "title", "message"]


def quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def write(path, rows, end="\n"):
    body = [",".join(COLUMNS), *(",".join(cells) for cells in rows)]
    path.write_bytes((end.join(body) + end).encode())


def rows_with_breaks(n, seed):
    pick = random.Random(seed)
    pieces = ["bom", 'diz "ótimo"', "linha um\nlinha dois", "a,b", "\n\n", 'fim"', "", "x" * 60, "\r\n", '""', "日本\n語"]
    text = lambda: quoted("".join(pick.choice(pieces) for _ in range(pick.randrange(4))))
    return [(str(i), pick.choice([text(), "plain", ""]), text()) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_give_the_rows_of_one_task(spark, tmp_path, end):
    for k in range(3):
        write(tmp_path / f"part{k}.csv", rows_with_breaks(150, k), end)
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path))
    want = sorted(map(tuple, whole.collect()), key=repr)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (311, 1000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = read_quoted_csv(spark, str(tmp_path), COLUMNS)
            assert sorted(map(tuple, got.collect()), key=repr) == want
            if size == 1000:
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_numbers_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"x\ny"\n\nz\n"never closed\nto the end\n')
    got = sorted((r["record"], r["text"]) for r in quoted_records(spark, str(tmp_path)).collect())
    assert got == [(1, "h"), (2, '"x\ny"'), (3, ""), (4, "z"), (5, '"never closed\nto the end')]
    (tmp_path / "b.csv").write_text("")
    assert quoted_records(spark, str(tmp_path / "b.csv")).collect() == []


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,title,message\n1,a,b\n")
    assert [tuple(r) for r in read_quoted_csv(spark, str(tmp_path), COLUMNS).collect()] == [("1", "a", "b")]
    (tmp_path / "b.csv").write_text("id,message,title\n1,a,b\n")
    with pytest.raises(Exception, match="another header"):
        read_quoted_csv(spark, str(tmp_path), COLUMNS).collect()
