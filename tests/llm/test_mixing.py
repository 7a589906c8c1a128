"""Context mixing against plain Python."""

from __future__ import annotations

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import corpora as R

from bazaarlens.functions import storage
from bazaarlens.llm import mixing as M


def coded_bytes(text: str) -> bytes:
    return b"".join(w.encode() + b" " for w in text.lower().split()) + bytes([M.END])


def slow_contexts(coded: bytes):
    """The contexts of each byte: the last ones, and the word so far."""
    for i, symbol in enumerate(coded):
        before = bytes(M.PAD) + coded[:i]
        begin = coded.rfind(b" ", 0, i) + 1
        yield symbol, [*((k, before[-k:]) for k in M.ORDERS), (0, b"" if symbol == M.END else coded[begin:i])]


def slow_odds(train: list[str]) -> dict:
    counts = defaultdict(Counter)
    for text in train:
        for symbol, contexts in slow_contexts(coded_bytes(text)):
            for c in contexts:
                counts[c][symbol] += 1
    return counts


def slow_cost(text: str, counts: dict, tree: M.Tree) -> float:
    weights, cost, slope = M.START_WEIGHTS.astype(float).copy(), 0.0, np.zeros(M.START_WEIGHTS.shape)
    paths = [dict(zip(tree.nodes[a : a + n].tolist(), tree.signs[a : a + n].tolist(), strict=True)) for a, n in zip(tree.starts, tree.lengths, strict=True)]
    for i, (symbol, contexts) in enumerate(slow_contexts(coded_bytes(text))):
        if i % M.UPDATE_BYTES == 0:
            weights, slope = weights + M.RATE * slope, np.zeros(slope.shape)
        gate = sum(c in counts for c in contexts[-M.GATED :])
        for node, sign in paths[symbol].items():
            x = np.zeros(M.CONTEXTS)
            for k, c in enumerate(contexts):
                sides = [sum(n for s, n in counts.get(c, {}).items() if paths[s].get(node) == side) for side in (-1, 1)]
                z = math.log((sides[1] + M.PRIOR) / (sides[0] + M.PRIOR)) * M.SCALE
                z = max(z, 1) if z >= 0 else min(z, -1)
                x[k] = np.clip(np.rint(z), -127, 127) / M.SCALE if sum(sides) else 0
            odds = math.exp(-np.clip(sign * (weights[gate] @ x), -12, 12))
            cost += math.log1p(odds)
            slope[gate] += odds / (1 + odds) * sign * x
    return cost


def model(texts: list[str], train: int):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    counts = np.zeros(256, np.int64)
    for t in texts[:train]:
        counts += np.bincount(np.frombuffer(coded_bytes(t), np.uint8), minlength=256)
    tree = M.Tree(counts)
    (_, _, coded), = M._coded(data, offsets, 1 << 20)
    context, symbol, n, pair = M.pair_counts([(coded, np.arange(len(texts)) < train)])
    return tree, coded, M.Answers(symbol, pair, M.corpus_odds(context, symbol, n, tree), tree)


def test_costs_are_those_of_online_mixing_with_exact_counts():
    texts = [R.sentence(40, i) for i in range(6)] + ["ab ab ab", R.sentence(25, 3), "日本 " + R.sentence(12, 9), "", R.sentence(5, 77)]
    tree, coded, answers = model(texts, 8)
    counts = slow_odds(texts[:8])
    got = M.mixed_cost(coded, len(texts), tree, answers)
    assert got == pytest.approx([slow_cost(t, counts, tree) for t in texts], rel=1e-4)


def test_every_context_has_counts_of_its_own_however_many_there_are():
    pick = np.random.default_rng(5)
    texts = ["".join(chr(97 + c) for c in pick.integers(0, 26, 40_000)) for _ in range(8)] + ["zqxjkvzqxjkv"]
    _, coded, answers = model(texts, 8)
    counts = {coded_bytes(t)[i : i + 6] for t in texts[:8] for i in range(40_000)}
    starts = answers.starts(coded.pairs(M.ORDERS.index(6)))
    held = np.flatnonzero(coded.doc == 8)[6:]
    seen = [coded_bytes(texts[8])[i : i + 6] in counts for i in range(len(held))]
    assert (answers.odds[starts[held]] != 0).tolist() == seen


def test_a_place_with_unseen_long_contexts_is_still_predicted():
    tree, coded, answers = model([*["abababab cdcdcdcd"] * 5, "ba dc xa"], 5)
    starts = np.stack([answers.starts(coded.pairs(k)) for k in range(M.CONTEXTS)])
    own = np.flatnonzero(coded.doc == 5)[1:2]  # the second letter of a word that training has not
    seen = (answers.odds[starts[:, own]] != 0).ravel().tolist()
    assert seen[0] and not any(seen[2:])


def peak_bytes(work) -> int:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_counts_and_odds_of_a_group_take_little_memory():
    letters = np.random.default_rng(6)
    pool = [" ".join("".join(map(chr, letters.integers(97, 123, 6))) for _ in range(2000)) for _ in range(20)]
    texts = [f"{pool[i % 20]} {pool[(3 * i + 1) % 20]}" for i in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    train = np.arange(len(texts)) % 5 > 0
    counts = lambda: M.pair_counts((c, train[a:b]) for a, b, c in M._coded(data, offsets, 1 << 17))
    assert peak_bytes(counts) < 140 * len(data)
    pick = np.random.default_rng(3)
    context, symbol = pick.integers(0, 1 << 18, 1_000_000).astype(np.uint64), pick.integers(97, 107, 1_000_000).astype(np.uint8)
    n = pick.integers(0, 9, len(context)).astype(np.uint32)
    tree = M.Tree(np.bincount(data, minlength=256))
    assert peak_bytes(lambda: M.corpus_odds(context, symbol, n, tree)) < 160 * len(context)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_odds_do_not_depend_on_the_rows_worked_on_at_once(monkeypatch, rows):
    pick = np.random.default_rng(4)
    context, symbol = pick.integers(0, 60, 500).astype(np.uint64), pick.integers(97, 107, 500).astype(np.uint8)
    n = pick.integers(0, 9, 500).astype(np.uint32)
    tree = M.Tree(np.bincount(symbol, minlength=256))
    expected = M.corpus_odds(context, symbol, n, tree)
    monkeypatch.setattr(M, "ODDS_ROWS", rows)
    assert M.corpus_odds(context, symbol, n, tree).tolist() == expected.tolist()


def test_distinct_pairs_of_a_group_have_the_counts_of_plain_python(monkeypatch):
    texts = [R.sentence(30, i % 4) + (" naïve 日本 ab" if i % 3 else " ab") for i in range(12)] + ["", " \t"]
    train = np.arange(len(texts)) % 4 > 0
    expected = Counter()
    for text, learned in zip(texts, train.tolist(), strict=True):
        for symbol, contexts in slow_contexts(coded_bytes(text)):
            expected.update({(c, symbol): int(learned) for c in contexts})
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    results = []
    for places in (1, 500, 1 << 25):
        monkeypatch.setattr(M, "SORTED_PLACES", places)
        context, symbol, n, pair = M.pair_counts((c, train[a:b]) for a, b, c in M._coded(data, offsets, 300))
        assert len(np.unique(pair)) == len(pair)
        results.append(sorted(zip(context.tolist(), symbol.tolist(), n.tolist(), strict=True)))
    assert results[0] == results[1] == results[2]
    assert sorted((s, n) for _, s, n in results[0]) == sorted((s, n) for (_, s), n in expected.items())


def test_answers_are_not_written_and_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, R.sentence(40, i)) for i in range(50)], "doc_id long, text string")
    scored = M.score(docs, docs["doc_id"] % 5 != 1)
    assert len(scored.collect()) == 50
    assert not list(tmp_path.iterdir())
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()
