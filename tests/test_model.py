from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan, values
from tidemark import FEATURE_COLUMNS, ModelParams, classification_metrics, get_xy
from tidemark.operators import attribution
from tidemark.plans.model import INPUTS, ScoringModel, calibrate, fit_base

SMALL = ModelParams(n_estimators=6, max_depth=4, learning_rate=0.3)


@pytest.fixture(scope="module")
def rows(features):
    dated = features.where("emp_length_years is not null")
    return {s: dated.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")}


@pytest.fixture(scope="module")
def model(rows):
    return calibrate(fit_base(rows["train"], SMALL), rows["valid"])


def test_scores_are_probabilities_with_signal(model, rows):
    scored = model.score(rows["test"])
    assert scored.count() == rows["test"].count()
    assert scored.where("score is null or score < 0 or score > 1 or raw_score <= 0 or raw_score >= 1").isEmpty()
    assert scored.where(F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("raw_score")) > 1e-9).isEmpty()
    before, after = (
        classification_metrics(scored.select(F.col(s).alias("score"), "Default")).first() for s in ("raw_score", "score")
    )
    assert after["roc_auc"] > 0.55 and after["brier"] <= before["brier"] + 0.03


def test_saved_model_scores_alike(spark, model, rows, tmp_path):
    model.save(str(tmp_path / "model"))
    again = ScoringModel.load(spark, str(tmp_path / "model"))
    assert again.params == SMALL
    assert model.score(rows["test"]).select("id", "score").exceptAll(again.score(rows["test"]).select("id", "score")).isEmpty()


def test_missing_and_unseen_values_are_scored(spark, model):
    blank = spark.range(1).select("id", *[F.lit(None).cast("double" if i < 11 else "string").alias(c) for i, c in enumerate(FEATURE_COLUMNS)])
    blank = blank.fillna(0, ["has_desc", "desc_len", "has_title", "title_len"])
    assert 0 <= model.score(blank).first()["score"] <= 1


def test_isotonic_calibration_is_monotone(model, rows):
    points = model.score(rows["test"]).select("raw_score", "score").orderBy("raw_score").collect()
    steps = [r["score"] for r in points]
    assert all(b >= a - 1e-12 for a, b in zip(steps, steps[1:]))


def test_sigmoid_calibration_fits_softened_targets(model, rows):
    plain = ScoringModel(model.encoding, model.forest, None, ModelParams(**{**SMALL.__dict__, "calibration_method": "sigmoid"}))
    fitted = calibrate(plain, rows["valid"])
    held = plain.raw_scores(rows["valid"]).select("margin", "Default").toPandas()
    m, y = held["margin"].to_numpy(), held["Default"].to_numpy()
    pos, neg = y.sum(), len(y) - y.sum()
    soft = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    found = fitted.score(rows["valid"]).select("score").toPandas()["score"].to_numpy()
    # At the optimum the residuals are orthogonal to the constant and to the margin.
    assert abs((found - soft).mean()) < 1e-5 and abs(((found - soft) * m).mean()) < 1e-5
    with pytest.raises(ValueError, match="method"):
        ModelParams(calibration_method="beta")


def test_training_reads_features_only(rows):
    assert get_xy(rows["train"]).columns == [*FEATURE_COLUMNS, "Default"]
    assert "id" not in INPUTS and "Default" not in INPUTS


def test_scoring_does_not_shuffle(model, rows):
    plan = executed_plan(model.score(rows["test"]).select("id", "score"))
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "BatchEvalPython" not in plan


def test_contributions_add_up_to_the_margin(model, rows):
    explained = model.explain(rows["test"], keep=["id"])
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap"])
    both = explained.select("id", total.alias("total")).join(model.raw_scores(rows["test"]).select("id", "margin"), "id")
    assert both.count() == rows["test"].count()
    assert both.where(F.abs(F.col("total") - F.col("margin")) > 1e-9).isEmpty()


def tree_value(nodes, x, known):
    """Expected output of a tree when only the inputs in ``known`` are given, weighted by cover."""
    def walk(i):
        n = nodes[i]
        if n["left"] < 0:
            return n["prediction"]
        a, b = n["left"], n["right"]
        if n["feature"] in known:
            v = x[n["feature"]]
            return walk(a if (n["missing_left"] if np.isnan(v) else v <= n["threshold"]) else b)
        return (nodes[a]["cover"] * walk(a) + nodes[b]["cover"] * walk(b)) / n["cover"]

    return walk(0)


def leaf(p, c):
    return {"left": -1, "right": -1, "feature": -1, "threshold": None, "prediction": p, "cover": c}


def node(f, t, left, right, c, missing_left=False):
    return {"left": left, "right": right, "feature": f, "threshold": t, "prediction": 0.0, "cover": c, "missing_left": missing_left}


def shapley(nodes, row, inputs):
    for j in range(inputs):
        others = [k for k in range(inputs) if k != j]
        yield sum(
            factorial(size) * factorial(inputs - 1 - size) / factorial(inputs)
            * (tree_value(nodes, row, {*s, j}) - tree_value(nodes, row, set(s)))
            for size in range(inputs) for s in combinations(others, size)
        )


@pytest.mark.parametrize("table_inputs", [7, 0])
def test_contributions_equal_shapley_by_enumeration(monkeypatch, table_inputs):
    """A hand-made tree that splits twice on one input, against the definition over all subsets."""
    monkeypatch.setattr(attribution, "_TABLE_INPUTS", table_inputs)
    nodes = {
        0: node(0, 0.5, 1, 2, 100.0), 1: node(1, 0.3, 3, 4, 60.0, True), 2: node(0, 0.8, 5, 6, 40.0, True),
        3: leaf(1.0, 20.0), 4: node(2, 0.1, 7, 8, 40.0), 5: leaf(-2.0, 30.0), 6: leaf(4.0, 10.0),
        7: leaf(0.5, 15.0), 8: leaf(3.0, 25.0),
    }
    tables = attribution.tables_of([nodes], [1.0])
    assert tables.base_value == pytest.approx(tree_value(nodes, None, set()))
    x = np.random.default_rng(0).random((50, 3))
    x[0] = [0.5, 0.3, 0.1]  # exactly on the thresholds
    x[1:4] = [[np.nan, 0.2, 0.2], [0.4, np.nan, np.nan], [np.nan] * 3]
    for row, phi in zip(x, tables.contributions(x)):
        assert phi == pytest.approx(list(shapley(nodes, row, 3)), abs=1e-12)


def test_deep_trees_are_explained_without_tables():
    """Trees of depth 12 over 8 inputs: some rows by enumeration, all by what they add up to."""
    rng = np.random.default_rng(1)

    def grown(depth):
        nodes = {}

        def grow(at, d, cover):
            if d == depth or cover < 1.5:
                nodes[at] = leaf(rng.normal(), cover)
                return
            share = rng.uniform(0.2, 0.8)
            nodes[at] = node(int(rng.integers(8)), rng.random(), 2 * at + 1, 2 * at + 2, cover, bool(rng.integers(2)))
            grow(2 * at + 1, d + 1, cover * share)
            grow(2 * at + 2, d + 1, cover * (1 - share))

        grow(0, 0, 400.0)
        return nodes

    trees = [grown(12) for _ in range(3)]
    tables = attribution.tables_of(trees, [1.0] * 3, base=0.25)
    assert any(len(leaf.features) > 7 for tree in tables.trees for leaf in tree.leaves)
    x = rng.random((40, 8))
    x[rng.random(x.shape) < 0.1] = np.nan
    phi = tables.contributions(x)
    everything = set(range(8))
    margins = [0.25 + sum(tree_value(t, row, everything) for t in trees) for row in x]
    assert phi.sum(axis=1) + tables.base_value == pytest.approx(np.array(margins), abs=1e-9)
    for i in (0, 1):
        want = sum(np.array(list(shapley(t, x[i], 8))) for t in trees)
        assert phi[i] == pytest.approx(want, abs=1e-9)


def test_full_size_forest_of_depth_12_is_explained(spark):
    """400 trees of depth 12, at most 4,096 leaves each: no limit on what may be explained."""
    rng = np.random.default_rng(2)
    trees = []
    for _ in range(400):
        nodes, at = {}, 0
        for d in range(12):  # one long path with a leaf at every step
            nodes[at] = node(int(rng.integers(12)), rng.random(), at + 1, at + 2, 2.0 ** (12 - d))
            nodes[at + 1] = leaf(rng.normal(), 2.0 ** (11 - d))
            at += 2
        nodes[at] = leaf(rng.normal(), 1.0)
        trees.append(nodes)
    tables = attribution.tables_of(trees, [0.1] * 400)
    names = [f"x{i}" for i in range(12)]
    df = spark.range(200).select("id", *[F.rand(i).alias(c) for i, c in enumerate(names)])
    groups = [(c, (c,)) for c in names]
    explained = attribution.attribute_rows(df, tables, names, groups, keep=["id"]).collect()
    means = {r["feature"]: r["mean_abs_shap"] for r in attribution.mean_contributions(df, tables, names, groups).collect()}
    assert len(explained) == 200 and set(means) == set(names)
    for i, c in enumerate(names):
        assert means[c] == pytest.approx(np.mean([abs(r["contributions"][i]["shap"]) for r in explained]))


def test_top_contributors_and_directions(spark):
    df = spark.createDataFrame(
        [(1, 0.5, [("a", 0.1234), ("b", -0.9), ("c", 0.9), ("d", 0.0)])],
        "id int, base_value double, contributions array<struct<feature:string,shap:double>>",
    )
    row = attribution.directed(attribution.top_contributions(df, 3)).first()
    assert [tuple(c) for c in row["top_contributions"]] == [
        ("b", -0.9, "toward repaying"), ("c", 0.9, "toward default"), ("a", 0.123, "toward default"),
    ]
    assert row["n_features"] == 4
    top = attribution.global_attribution(df, ["a", "b", "c", "d"], top=2)
    assert values(top) == [("b", 0.9), ("c", 0.9)]


def test_global_attribution_covers_every_feature(model, rows):
    found = model.importance(rows["test"])
    assert {r["feature"] for r in found.collect()} == set(FEATURE_COLUMNS)
    assert found.first()["feature"] == "emp_length_years"
    again = attribution.global_attribution(model.explain(rows["test"]), FEATURE_COLUMNS)
    assert [r["feature"] for r in found.collect()] == [r["feature"] for r in again.collect()]


def test_missing_numbers_are_not_imputed(model, rows):
    """Rows that differ only in a missing input may score apart from those with any value of it."""
    row = rows["test"].where("fico_n is not null").limit(1)
    design = model.design(row.withColumn("fico_n", F.lit(None).cast("double")))
    assert design.first()["fico_n"] is None
    assert {t.missing_left.any() for t in model.forest.trees} <= {True, False}


def test_leaves_of_a_branch_share_a_look_up(monkeypatch):
    """Trees of depth 5 need at most 8 look-ups, and contributions are those of leaf by leaf."""
    rng = np.random.default_rng(5)

    def grow(nodes, at, d, cover):
        if d == 5 or (d > 2 and rng.random() < 0.1):
            nodes[at] = leaf(rng.normal(), cover)
            return nodes
        share = rng.uniform(0.2, 0.8)
        nodes[at] = node(int(rng.integers(6)), rng.random(), 2 * at + 1, 2 * at + 2, cover, bool(rng.integers(2)))
        grow(nodes, 2 * at + 1, d + 1, cover * share)
        return grow(nodes, 2 * at + 2, d + 1, cover * (1 - share))

    trees = [grow({}, 0, 0, 400.0) for _ in range(5)]
    x = rng.random((200, 6))
    x[rng.random(x.shape) < 0.1] = np.nan
    shared = attribution.tables_of(trees, [1.0] * 5)
    assert all(len(t.branches) + len(t.leaves) <= 8 for t in shared.trees)
    monkeypatch.setattr(attribution, "_BRANCH_SPLITS", 0)
    alone = attribution.tables_of(trees, [1.0] * 5)
    assert not any(t.branches for t in alone.trees)
    assert shared.contributions(x) == pytest.approx(alone.contributions(x), abs=1e-12)
