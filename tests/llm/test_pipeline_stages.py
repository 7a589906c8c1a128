"""Every stage of the pipeline, and the whole of it, against plain Python on planted rows."""

from __future__ import annotations

import hashlib
import re

import corpora as R
import pytest

import corpus_pipeline
from bazaarlens.functions.storage import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = R.sentence(14, 900)


def shouted(text):
    return re.sub("[a-z]", lambda m: m[0].upper(), text)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def planted() -> list[tuple]:
    clean = [R.sentence(90 + i, 100 + i) for i in range(24)]
    passage = R.sentence(45, 50)
    near = clean[3].split()
    near[40] = "edited"
    texts = [
        *clean,
        clean[0],  # an exact copy
        " ".join(near),  # a near copy
        f"{R.sentence(60, 51)} {passage} {R.sentence(50, 52)}",
        f"{R.sentence(55, 53)} {passage} {R.sentence(65, 54)}",  # a passage that stands earlier
        f"{R.sentence(70, 55)} {shouted(ITEM)}, {R.sentence(60, 56)}",  # benchmark words
        R.sentence(20, 57),  # under 50 words
        "over and over again " * 30,  # repeats itself
        "",
        None,
    ]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, clean[5], None, None, len(clean[5]))]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_failed(text) -> bool:
    own = words(text)
    cut = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    twice = {i + k for i, w in enumerate(cut) if cut.count(w) > 1 for k in range(3)}
    return len(own) < 50 or 100 * len(twice) > 50 * len(own)


def without_copies(rows):
    sets = []
    for r in rows:
        own = words(lower(r[1]))
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union and 100 * len(sets[a] & sets[b]) >= 80 * union:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    return [rows[i] for i in sorted(first.values())]


def without_passages(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own, gone = words(r[1]), set()
        for i in range(len(own) - 19):
            window = tuple(own[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        text = " ".join(w for i, w in enumerate(own) if i not in gone) if gone else r[1]
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def without_tests(rows):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    test = cut(ITEM)
    assert len(test) >= 10
    windows = {tuple(test[i : i + 10]) for i in range(len(test) - 9)}
    hit = lambda t: any(tuple(t[i : i + 10]) in windows for i in range(len(t) - 9))
    return [r for r in rows if not hit(cut(r[1]))]


def encoded(rows):
    import tiktoken

    ranks, pattern = corpus_pipeline.ranks_and_pattern()
    library = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                    hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


def listed(rows):
    return sorted(map(repr, rows))


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(planted(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize(
    "stage, slow",
    [
        (corpus_pipeline.quality_rules, lambda rows: [r for r in rows if not base_failed(r[1])]),
        (corpus_pipeline.substring_stage, without_passages),
        (corpus_pipeline.decontamination, without_tests),
    ],
    ids=["quality", "substring", "decontamination"],
)
def test_stage_equals_plain_python(spark, folder, stage, slow):
    rows = planted()[:33]  # ids without repeats: rows that share one count as one document in substring dedup
    docs = spark.createDataFrame(rows, SCHEMA)
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns
    assert listed(plain(got)) == listed(slow(rows))
    none = stage(spark, docs.limit(0), folder)
    assert none.columns == docs.columns and none.collect() == []


def test_near_dedup_stage_equals_plain_python(spark, folder):
    rows = planted()[:33]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert listed(plain(got)) == listed(without_copies(rows))


CODES = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_encoding_stage_equals_the_library(spark, folder):
    got = corpus_pipeline.byte_bpe(spark, spark.createDataFrame(planted(), SCHEMA), folder)
    assert listed(plain(got.select(*CODES))) == listed(encoded(planted()))


def test_run_equals_plain_python(spark, folder):
    rows = [r for r in planted() if not base_failed(r[1])]
    for slow in (without_copies, without_passages, without_tests):
        rows = slow(rows)
    got = materialise(corpus_pipeline.run(spark, folder), "result")
    assert listed(plain(got.select(*CODES))) == listed(encoded(rows))
    assert {"lang", "source", "n_chars"} <= set(got.columns)
    ids = {r[0] for r in rows}
    assert {24, 25, 28, 29, 30, 31, 32, None}.isdisjoint(ids) and {0, 3, 26, 27} <= ids
