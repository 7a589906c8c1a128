"""Substring, suffix and near-duplicate dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import corpora as R
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlens.functions.storage import materialise
from bazaarlens.llm import neardup
from bazaarlens.llm.arrays import pack, unpack
from bazaarlens.llm.neardup import near_duplicates, spread_labels
from bazaarlens.llm.substring import substring_dedup
from bazaarlens.llm.suffixes import repeated_windows, suffix_dedup

LAST = 2**63 - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def slow_substring(rows, window):
    first = {}
    docs = [(LAST if r[0] is None else r[0], r[0], WORD.findall(r[1] or "")) for r in rows]
    for key, _, words in docs:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, (key, i)), (key, i))
    out = []
    for key, doc_id, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (key, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), sha(kept.encode())))
    return Counter(out)


def slow_suffix(rows, window):
    docs = [(LAST if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for key, _, text in docs:
        for i in range(len(text) - window + 1):
            w = text[i : i + window]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, doc_id, text in docs:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - window + 1):
            if first[text[i : i + window]] < key:
                gone[i : i + window] = True
        gone[-1] = False
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        out.append((doc_id, len(text), int(gone.sum()), spans, sha(kept)))
    return Counter(out)


def slow_near(rows, size, percent):
    sets = []
    for r in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        short = {tuple(words)} if words else set()
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else short)
    ids = [LAST if r[0] is None else r[0] for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    lowest = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
    out = []
    for i, g, s in zip(ids, group, sets, strict=True):
        component = lowest[g] if s else i
        out.append((None if i == LAST else i, len(s), None if component == LAST else component, i == component))
    return Counter(out)


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def shared_parts(seed: int, n: int = 60) -> list[tuple]:
    pick = random.Random(seed)
    pool = [R.sentence(pick.randrange(5, 60), i) for i in range(12)]
    rows = [(i, " ".join(pick.choice(pool) for _ in range(pick.randrange(4))), None, None, None) for i in range(n)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [R.hard_documents(), shared_parts(1), shared_parts(2)])
def test_substring_dedup(spark, rows):
    got = substring_dedup(R.documents(spark, rows))
    assert got.columns == ["doc_id", "lang", "kept", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == slow_substring(rows, 20)


def test_substring_dedup_texts(spark):
    rows = R.hard_documents()
    got = substring_dedup(R.documents(spark, rows), with_text=True).collect()
    before = {r[0]: r[1] for r in rows}
    for r in got:
        if not r["n_removed"] and r["doc_id"] is not None:
            assert r["text"] == before[r["doc_id"]]
        elif r["n_removed"]:
            assert sha(r["text"].encode()) == r["kept_sha256"]


@pytest.mark.parametrize("rows", [R.hard_documents()[:12] + R.hard_documents()[13:], shared_parts(3)])
def test_suffix_dedup(spark, rows):
    got = suffix_dedup(R.documents(spark, rows))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == slow_suffix(rows, 50)


@pytest.mark.parametrize("rows", [R.hard_documents(), shared_parts(4, 40)])
def test_near_duplicates(spark, rows):
    got = near_duplicates(R.documents(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == slow_near(rows, 3, 85)


def test_chains_of_near_copies_are_one_component(spark):
    words = R.sentence(200, 9).split()
    rows = []
    for i in range(25):  # each differs from the one before in one place more, so the ends are far apart
        words[(i * 7) % 200] = f"new{i}"
        rows.append((100 - i, " ".join(words), None, None, None))
    assert rows_of(near_duplicates(R.documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == slow_near(rows, 3, 85)


def test_labels_spread_over_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    labels = spark.range(41).selectExpr("id AS node", "id AS comp")
    assert {r["comp"] for r in spread_labels(labels, links).collect()} == {0}


def test_empty_tables(spark):
    for operator in (substring_dedup, suffix_dedup, near_duplicates):
        assert operator(R.empty(spark)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.text("ab", min_size=0, max_size=200), st.integers(8, 20))
def test_radix_sort_finds_exactly_the_repeated_windows(text, window):
    blob = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(max(0, len(text) - window + 1))
    at, cuts = repeated_windows(blob, starts, window)
    by_text = Counter(text[i : i + window] for i in starts)
    groups = [sorted(at[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=False)]
    assert sorted(groups) == sorted([i for i in starts.tolist() if text[i : i + window] == t] for t, n in by_text.items() if n > 1)


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint64) ** 3, np.array([3, -1, 2], np.int32), np.zeros(0, np.int64), np.array([5, 1], np.uint64)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def unlinked_copies(n: int, changes: int) -> list[tuple]:
    """Copies of one text with changes of their own, of which no two are similar enough; the text itself is not there."""
    pick, words = random.Random(5), R.sentence(150, 11).split()
    rows = []
    for i in range(n):
        own = list(words[: 150 - i % 4])
        for k in range(changes):
            own[pick.randrange(len(own))] = f"own{i}x{k}"
        rows.append((i, " ".join(own), None, None, None))
    return rows


@pytest.mark.parametrize("changes", [1, 2, 3, 5])
def test_copies_with_changes_of_their_own(spark, changes):
    rows = unlinked_copies(40, changes)
    assert rows_of(near_duplicates(R.documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == slow_near(rows, 3, 85)


def test_copies_with_many_changes_of_their_own_are_not_all_compared(spark, monkeypatch):
    pick, words = random.Random(8), R.sentence(150, 12).split()
    rows = []
    for i in range(240):  # some are linked to the text or to each other, and most to none, though each is near to most others
        own = list(words[: 150 - 4 * (i % 3)])
        for k in range(i % 9):
            own[pick.randrange(len(own))] = f"own{i}x{k}" if i % 4 else f"same{k % 3}"
        rows.append((i, " ".join(own), None, None, None))
    pairs = []

    def counted(df, name):
        out = materialise(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    got = rows_of(near_duplicates(R.documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == slow_near(rows, 3, 85)
    assert sum(pairs) < 10 * len(rows)
