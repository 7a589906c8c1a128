"""Small corpora that hold the cases every operator has to bear."""

from __future__ import annotations

import random

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lu", "mo", "ni", "zü") for b in ("ra", "tos", "vi", "n", "ß")]
SCHEMA = "doc_id long, text string, lang string, n_words long, kept boolean"


def sentence(n: int, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


def hard_documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, copies, shared passages and a long text; n_words and
    kept clash with what operators add."""
    passage = sentence(30, 1)
    base = sentence(120, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        base,
        base,
        " ".join(near),
        f"{sentence(40, 3)} {passage} {sentence(40, 4)}",
        f"{sentence(35, 5)}\n{passage}\t{sentence(35, 6)} {passage}",
        None,
        "",
        " \n\t ",
        "one",
        "Two Words",
        "a b c",
        "same " * 90,
        sentence(9000, 7),
        base.upper(),
        "naïve café — déjà vu … 日本語のテキスト " * 12,
        "x\x85y z  tail ",
    ]
    rows = [(i, t, "en" if i % 2 else "fr", 7, True) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, base, None, None, None), (None, None, None, None, None), (99, passage, None, None, None)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(hard_documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
