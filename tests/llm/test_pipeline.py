"""Stages of the pipeline on planted rows."""

from __future__ import annotations

import random

import corpora as R

import corpus_pipeline
from bazaarlens.llm.neardup import ROWS, band_count


def shingles(text: str, size: int) -> set[tuple]:
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def similarity(a: str, b: str, size: int) -> float:
    x, y = shingles(a, size), shingles(b, size)
    return len(x & y) / len(x | y)


def scattered(n: int, changes: int, seed: int) -> tuple[str, str]:
    words = [f"s{seed}w{i}" for i in range(n)]
    other = list(words)
    for k in range(changes):
        other[10 + k * (n // changes)] = f"x{k}"
    return " ".join(words), " ".join(other)


def test_near_dedup_takes_five_words_and_four_fifths(spark):
    words = [f"a{i}" for i in range(200)]
    longer = [*words, *(f"b{i}" for i in range(45))]
    appended = " ".join(words), " ".join(longer)
    many_edits = scattered(1000, 26, 1)
    unlike = scattered(300, 20, 2)
    assert 0.80 <= similarity(*appended, 5) < 0.85 > similarity(*appended, 3)
    assert similarity(*many_edits, 5) < 0.80 < 0.85 <= similarity(*many_edits, 3)
    texts = [*appended, *many_edits, *unlike]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if similarity(texts[a], texts[b], 5) >= 0.8]
    assert pairs == [(0, 1)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    got = corpus_pipeline.near_dedup(spark, R.documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3, 4, 5]


def test_bands_follow_the_threshold():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** ROWS) ** band_count(percent) < 7.2e-9
    assert (band_count(85), band_count(80)) == (32, 48)


def test_near_dedup_keeps_one_row_of_copies_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, lang, None, None) for i, lang in ((2, "a"), (None, "b"), (1, "c"), (1, "d"), (None, "e"))]
    rows += [(None, text.replace("w", "v"), "f", None, None), (None, None, "g", None, None), (3, "", "h", None, None)]
    rows += [(None, text.replace("w", "v"), "i", None, None)]
    docs = R.documents(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    langs = [r["lang"] for r in got.collect()]
    assert len(langs) == 4 and {"g", "h"} < set(langs)
    assert len({"c", "d"} & set(langs)) == len({"f", "i"} & set(langs)) == 1
