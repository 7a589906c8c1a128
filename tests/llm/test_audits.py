"""Source divergence, license scans and filter audits against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import corpora as R
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlens.llm import divergence as D
from bazaarlens.llm import interactions as I
from bazaarlens.llm import licenses as L


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- divergence


def slow_divergence(rows, least, top=10):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    in_docs, counts = Counter(), Counter()
    for lang, source, terms in docs:
        in_docs.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang in {d[0] for d in docs}:
        sources = sorted({d[1] for d in docs if d[0] == lang})
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        whole = {t: sum(counts[lang, s, t] for s in sources) for t in kept}

        def shares(n):
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares({t: counts[lang, s, t] for t in kept}) for s in sources}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def divergent_rows():
    pick = random.Random(5)
    stem = "wort" * 700
    vocabulary = [f"{a}{b}" for a in ("pre", "prefix", "p", "überaus", stem) for b in ("", "a", "ab", "abc", "z", "ß", "日本")]
    rows = [
        (pick.choice(["en", "de", None]), pick.choice(["x", "y", "zü", None]), " ".join(pick.choice(vocabulary) for _ in range(pick.randrange(12))))
        for _ in range(120)
    ]
    return rows + [rows[0], ("fr", "only", "rare words"), ("fr", "two", None), ("fr", None, ""), (None, "x", None), ("de", "x", "PRE Pre pRe-pre9pre")]


@pytest.mark.parametrize("least", [1, 4, 10])
def test_divergence_by_brute_force(spark, least):
    rows = divergent_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, fresh int")
    got = D.divergence(docs.repartition(5), least=least).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == slow_divergence(rows, least)


def test_divergence_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CELLS", 16)
    monkeypatch.setattr(D, "PANEL_CELLS", 8)
    rows = divergent_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = D.divergence(docs, least=3).select("lang", "source", "part", "item", "value", "rank").collect()
    assert {tuple(r) for r in got} == slow_divergence(rows, 3)


def test_prefixes_count_documents_and_thin_out(spark):
    rows = divergent_rows()
    docs = spark.createDataFrame([(a or "", b or "", c or "") for a, b, c in rows], "lang string, source string, text string")
    counts = D.counts_of_terms(docs).collect()
    for level in range(4):
        n = D.level_bytes(level)
        got = Counter()
        for r in counts:
            if r["fresh"] <= level:
                got[r["lang"], bytes(r["term"])[:n]] += r["docs"]
        want = Counter()
        for lang, _, text in rows:
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
            want.update({(lang or "", (t.encode() + b"\0")[:n]) for t in terms})
        assert got == want


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert D.divergence(empty).collect() == []


# --- licenses


def slow_scan(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    base = [(label, i) for label, phrase in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spaced = f" {' '.join(words)} ".encode() if words else b" "
    found = [(r.priority, m.start(), m.end(), k) for k, r in enumerate(rules) for m in r.pattern.finditer(spaced)]

    def beats(a, b):
        if a[0] != b[0] or (a[1], a[2]) != (b[1], b[2]):
            return a[0] >= b[0]
        return a[3] < b[3]

    stands = [x for x in found if not any(y != x and y[1] <= x[1] and x[2] <= y[2] and beats(y, x) for y in found)]
    base_labels = {label for label, _ in base}
    at = [i for _, i in base]
    return (
        len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {rules[x[3]].label for x in stands})), max((L.CERTAINTY[x[0]] for x in found), default=0.0),
    )


def licensed_texts():
    pick = random.Random(11)
    pieces = [
        "CC BY", "cc-by-nc 4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "GNU General Public License, version 3.", "or any later version",
        "GNU Lesser General Public License version 2.1", "All rights reserved", "Copyright (c) 2020", "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT", "MIT License", "the MIT licence", "BSD 3-Clause", "public domain",
        "Mozilla Public License 2.0", "MPL 2.0", "general public", "license", "rights reserved", "cc by cc by", "http://www.gnu.org/licenses/gpl-3.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "über", "日本語", "x", "GPLv2", "gpl v3 or later", "CC0",
    ]
    texts = [" ".join(pick.choice(pieces) for _ in range(pick.randrange(1, 14))) for _ in range(150)]
    return [*texts, None, "", " \n ", "!!!", "all rights reserved " * 400, pieces[0], pieces[6]]


def test_scan_by_brute_force(spark):
    rules = L.all_rules()
    texts = licensed_texts()
    docs = spark.createDataFrame([(i, t, -1, "clash") for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, texts[1], None, None)], "doc_id long, text string, n_words int, row string")
    got = L.license_scan(docs).collect()
    assert len(got) == len(texts) + 2
    names = "n_words n_base first_word last_word base_labels labels score".split()
    for r in got:
        text = texts[r["doc_id"] if r["doc_id"] is not None else 1]
        assert tuple(r[c] for c in names) == slow_scan(text, rules), text
        assert all(0 <= d["first_word"] <= d["last_word"] < r["n_words"] for d in r["detections"])
    assert L.license_scan(docs.limit(0)).collect() == []


RULES = L.all_rules()


@given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r.pattern.pattern[: -len(b"(?= )")], fullmatch=True))))
@settings(deadline=None, max_examples=1500, database=None)
def test_each_match_holds_its_keyword(example):
    found, match = example
    assert found.keyword in match + b" "


def test_there_are_hundreds_of_rules():
    assert len({r.pattern.pattern for r in RULES}) > 300


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(1, 3)), max_size=25))
@settings(deadline=None, max_examples=150)
def test_suppression(found):
    start, end, priority = (np.array([f(x) for x in found], np.int64) for f in (lambda x: x[0], lambda x: x[0] + x[1], lambda x: x[2]))
    got = L.resolve(start, end, priority, np.arange(len(found)))
    for i in range(len(found)):
        beaten = any(
            start[j] <= start[i] and end[i] <= end[j] and (priority[j] > priority[i] or priority[j] == priority[i] and ((start[j], end[j]) != (start[i], end[i]) or j < i))
            for j in range(len(found)) if j != i
        )
        assert got[i] == (not beaten)


# --- filter audit


def slow_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any((x[1] or "") == text and x[0] is not None and (doc_id is None or x[0] < doc_id) for x in docs)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller,
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            before = set()
            for step, name in enumerate(order, 1):
                here = [r for r in own if name in r[1] and not r[1] & before]
                key = (part, "".join(order), step)
                out[key] = [
                    sum(not r[1] & (before | {name}) for r in own), len(here), sum(name in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {name} for r in own), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
                shapley[part, name] += len(here)
                before.add(name)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE_IDS", 4)
    base = [(r[0], r[1], r[2]) for r in R.hard_documents()]
    base += [(40 + i, t, "en") for i, t in enumerate(["A B C " * 50, "a|b " * 120, "a|b " * 120, "SHOUT", R.sentence(120, 9), R.sentence(120, 9).upper()])]
    base += [(40, "other text", "fr"), (None, "a|b " * 120, "en"), (-7, R.sentence(120, 2), "fr"), (2**62, "x", "fr")]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (41, 1, None), (42, None, 1), (None, 1, 1), (40, 1, 0), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 5, "clash") for r in base], "doc_id long, text string, lang string, fails int, digest string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = I.filter_audit(docs.repartition(3), marks)
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got.collect()}
    assert found == slow_audit(base, labels)
    assert I.filter_audit(docs.limit(0), marks).collect() == []
    assert I.filter_audit(docs, marks.limit(0)).count() == 3 * 600


_SORTED = st.lists(st.integers(0, 400), unique=True, max_size=300).map(lambda x: np.array(sorted(x), np.int64))


@given(st.lists(_SORTED, min_size=1, max_size=4), st.sampled_from([1, 3, 512]))
@settings(deadline=None, max_examples=150)
def test_merges(lists, stride):
    kept, I.STRIDE = I.STRIDE, stride
    try:
        assert I.union(lists).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
        a, b = lists[0], lists[-1]
        assert I.gallop(a, b).tolist() == np.searchsorted(a, b).tolist()
        assert I.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    finally:
        I.STRIDE = kept
