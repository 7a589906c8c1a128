"""Second-order boosting."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.models import boosting, explain, prep

INPUTS = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    values = np.column_stack([rng.normal(size=900).round(2), rng.integers(0, 6, 900), rng.exponential(5, 900).round(1)])
    label = (values[:, 0] + (values[:, 1] > 3) * 1.5 - values[:, 2] / 5 + rng.normal(scale=0.7, size=900) > 0).astype(int)
    table = [(i, int(y), *map(float, v)) for i, (y, v) in enumerate(zip(label, values, strict=True))]
    return spark.createDataFrame(table, f"{prep.ID} long, {prep.LABEL} int, a double, b double, c double")


def slow_tree(x, y, weight, cuts, settings):
    """Nodes of the first tree by trying every cut of every node on plain floats."""
    out = {}

    def grow(node, members, depth):
        w = np.where(y[members] == 1, weight, 1.0)
        g, h = ((0.5 - y[members]) * w).sum(), (0.25 * w).sum()
        out[node] = (None, h, -settings.learning_rate * g / (h + settings.penalty))
        best = None
        for j, name in enumerate(INPUTS):
            for cut in cuts[name]:
                left = x[members, j] <= cut
                gl, hl = ((0.5 - y[members]) * w)[left].sum(), (0.25 * w)[left].sum()
                if min(hl, h - hl) < settings.min_curvature:
                    continue
                gain = (gl**2 / (hl + settings.penalty) + (g - gl) ** 2 / (h - hl + settings.penalty) - g**2 / (h + settings.penalty)) / 2
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-6):
                    best = (gain, j, cut)
        if depth and best:
            _, j, cut = best
            out[node] = ((INPUTS[j], cut), *out[node][1:])
            grow(2 * node + 1, members[x[members, j] <= cut], depth - 1)
            grow(2 * node + 2, members[x[members, j] > cut], depth - 1)

    grow(0, np.arange(len(y)), settings.depth)
    return out


def test_first_tree_by_brute_force(spark, rows):
    settings = boosting.BoostingSettings(rounds=1, depth=3, row_share=1.0, column_share=1.0, max_bins=16)
    table = rows.orderBy(prep.ID).toPandas()
    cuts = boosting.quantile_cuts(rows, INPUTS, settings.max_bins)
    assert all(len(c) < settings.max_bins and (np.diff(c) > 0).all() for c in cuts.values())
    assert cuts["b"].tolist() == [0, 1, 2, 3, 4]
    model = boosting.fit(rows, 0.7, settings, INPUTS)
    want = slow_tree(table[list(INPUTS)].to_numpy(), table[prep.LABEL].to_numpy(), 0.7, cuts, settings)
    got = {r["node"]: r for r in model.nodes(spark).collect()}
    assert set(got) == set(want)
    for node, (split, cover, value) in want.items():
        assert (got[node]["feature"], got[node]["cut"]) == (split or (None, 0.0))
        assert got[node]["cover"] == pytest.approx(cover, abs=1e-4)
        assert got[node]["value"] == pytest.approx(value, abs=1e-6)


def test_the_same_trees_level_by_level_and_in_one_task(spark, rows, monkeypatch):
    settings = boosting.BoostingSettings(rounds=5, depth=3, max_bins=32, seed=9)
    alone = boosting.fit(rows, 1.3, settings, INPUTS)
    monkeypatch.setattr(boosting, "TASK_ROWS", 200)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    monkeypatch.setattr(boosting, "TREES_PER_WRITE", 2)
    spread = boosting.fit(rows.repartition(7), 1.3, settings, INPUTS)
    assert alone.nodes(spark).collect() == spread.nodes(spark).collect()


def test_boosting_separates_and_comes_back_from_disk(spark, rows, tmp_path):
    settings = boosting.BoostingSettings(rounds=40, depth=3)
    model = boosting.fit(rows, 1.0, settings, INPUTS)
    model.save(spark, str(tmp_path))
    again = boosting.BoostedModel.load(spark, str(tmp_path))
    assert (again.inputs, again.settings) == (model.inputs, model.settings)
    scored = model.score(rows, (prep.ID, prep.LABEL)).orderBy(prep.ID).toPandas()
    assert again.score(rows, (prep.ID, prep.LABEL)).orderBy(prep.ID).toPandas().equals(scored)
    assert ((scored["score"] > 0.5) == (scored[prep.LABEL] == 1)).mean() > 0.85
    importance = model.importance(spark).toPandas()
    assert importance["importance"].sum() == pytest.approx(1.0)
    parts = explain.ensemble_attributions(model.ensemble(), rows, INPUTS).orderBy(prep.ID).toPandas()
    total = parts[["base_value", *INPUTS]].sum(axis=1)
    assert total.to_numpy() == pytest.approx(scored["margin"].to_numpy(), abs=1e-9)


def test_nothing_to_learn(spark, rows):
    settings = boosting.BoostingSettings(rounds=2, depth=2)
    for some in (rows.limit(0), rows.withColumns({c: F.lit(1.0) for c in INPUTS})):
        model = boosting.fit(some, 1.0, settings, INPUTS)
        assert all(tree.feature.max() == -1 for tree in model.trees)
        assert model.score(rows).count() == 900
    assert set(model.importance(spark).toPandas()["importance"]) == {0.0}


def test_too_many_bins(rows):
    with pytest.raises(ValueError, match="256"):
        boosting.fit(rows, 1.0, boosting.BoostingSettings(max_bins=300), INPUTS)


def test_one_job_a_level_and_each_tree_is_added_once(spark, rows, monkeypatch):
    """The work of a round does not grow with the trees since the margins were last written."""
    monkeypatch.setattr(boosting, "TASK_ROWS", 200)
    jobs, walks = [], spark.sparkContext.accumulator(0)
    grow, node_of = boosting._grow, boosting.Tree.node_of

    def counted(tree, values, by_bin, depth):
        walks.add(int(depth == 3))
        return node_of(tree, values, by_bin, depth)

    def grown(number, *rest):
        spark.sparkContext.setJobGroup(f"round-{number}", "")
        tree = grow(number, *rest)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"round-{number}")))
        return tree

    monkeypatch.setattr(boosting.Tree, "node_of", counted)
    monkeypatch.setattr(boosting, "_grow", grown)
    settings = boosting.BoostingSettings(rounds=6, depth=3, max_bins=32)
    boosting.fit(rows.repartition(4), 1.0, settings, INPUTS)
    spark.sparkContext.setJobGroup("others", "")
    blocks = 5  # one in each of the five tasks of 200 rows
    assert len(jobs) == 6 and max(jobs) <= settings.depth
    assert walks.value <= blocks * (settings.rounds - 1)
