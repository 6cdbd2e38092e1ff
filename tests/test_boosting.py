from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import MISSING, Forest, TreeParams, best_splits, bin_of, boost, gradients, taken

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    """Rows whose target depends on a, on whether b is missing, and on nothing else."""
    x = spark.range(4000).select(
        F.col("id").alias("key"),
        F.round(F.rand(1) * 10, 1).alias("a"),
        F.when(F.rand(2) < 0.3, None).otherwise(F.round(F.rand(3), 2)).alias("b"),
        F.when(F.rand(4) < 0.05, float("nan")).otherwise(F.floor(F.rand(5) * 3).cast("double")).alias("c"),
    )
    chance = F.when(F.col("a") > 6, 0.7).otherwise(0.2) + F.when(F.col("b").isNull(), 0.25).otherwise(0.0)
    return x.withColumn("y", (F.rand(6) < chance).cast("int"))


@pytest.fixture(scope="module")
def table(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("boost") / "rows")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def arrays(table):
    pdf = table.toPandas()
    return pdf[INPUTS].to_numpy(float), pdf["y"].to_numpy(float)


def brute_split(x, g, h, cuts, p):
    """Every input, cut and side of missing rows, one after the other."""
    best = (1e-6, None)
    G, H = g.sum(), h.sum()
    for f, c in enumerate(cuts):
        for cut, missing_left in product(c, (False, True)):
            left = np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)
            gl, hl = g[left].sum(), h[left].sum()
            if hl < p.min_child_weight or H - hl < p.min_child_weight:
                continue
            gain = gl**2 / (hl + p.l2) + (G - gl) ** 2 / (H - hl + p.l2) - G**2 / (H + p.l2)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut, missing_left, left))
    return best[1]


def brute_tree(x, g, h, cuts, p, depth):
    found = brute_split(x, g, h, cuts, p) if depth else None
    if found is None:
        return -p.learning_rate * g.sum() / (h.sum() + p.l2)
    f, cut, missing_left, left = found
    inner = [brute_tree(x[s], g[s], h[s], cuts, p, depth - 1) for s in (left, ~left)]
    return (f, cut, missing_left, *inner)


def as_nested(tree, at=0):
    if tree.feature[at] < 0:
        return pytest.approx(tree.value[at], abs=1e-9)
    return (tree.feature[at], tree.threshold[at], bool(tree.missing_left[at]), as_nested(tree, tree.left[at]), as_nested(tree, tree.right[at]))


@pytest.mark.parametrize("task_rows", [1 << 20, 700])
def test_trees_equal_brute_force(table, task_rows):
    """Two rounds, grown in one task and by jobs over many."""
    p = TreeParams(trees=2, depth=3, learning_rate=0.5, min_child_weight=4.0, l2=1.5)
    x, y = arrays(table)
    forest = boost(table, INPUTS, p, label="y", id_column="key", task_rows=task_rows)
    cuts = boosting.bin_cuts(table, INPUTS, p.max_bins)
    margin = np.full(len(y), forest.base)
    assert forest.base == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    for tree in forest.trees:
        g, h = (v / boosting._UNIT for v in gradients(y, margin))
        assert as_nested(tree) == brute_tree(x, g, h, cuts, p, p.depth)
        margin = margin + tree.margins(x)


def test_one_task_and_many_grow_the_same_trees(table, monkeypatch):
    monkeypatch.setattr(boosting, "_TREES_PER_STATE", 2)
    monkeypatch.setattr(boosting, "_FAN_IN", 2)
    monkeypatch.setattr(boosting, "_BLOCK_ROWS", 300)
    p = TreeParams(trees=5, depth=3, learning_rate=0.3, subsample=0.7, colsample=0.67, min_child_weight=2.0)
    cuts = [np.arange(1, 10), [0.25, 0.5, 0.75], [0, 1]]
    one = boost(table, INPUTS, p, label="y", id_column="key", cuts=cuts)
    many = boost(table.repartition(9), INPUTS, p, label="y", id_column="key", cuts=cuts, task_rows=600)
    assert one.rows() == many.rows()
    assert any(t.missing_left.any() for t in one.trees)


def test_rows_are_drawn_by_id_alone():
    draw = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 100_000, dtype=np.int64)
    a, b = taken(draw, 0, 42, 0.8), taken(draw, 1, 42, 0.8)
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.01
    assert (taken(draw[::-1], 0, 42, 0.8) == a[::-1]).all() and taken(draw, 0, 42, 1.0).all()


def test_bins_and_cuts_agree():
    cuts = np.array([0.0, 1.0, 2.0])
    assert bin_of(np.array([-1, 0, 0.5, 1, 2, 3, np.nan]), cuts).tolist() == [0, 0, 1, 1, 2, 3, MISSING]


def test_no_split_without_gain_weight_or_cuts():
    p = TreeParams(trees=1, depth=1, learning_rate=1.0, min_child_weight=1.0, l2=0.0)
    sums = np.zeros((2, 2, 256, 2), np.int64)
    sums[0, :, 0] = sums[0, :, 1] = [boosting._UNIT, 2 * boosting._UNIT]  # both sides alike: nothing gained
    sums[1, :, 0] = [boosting._UNIT, boosting._UNIT // 2]  # too light
    sums[1, :, 1] = [-boosting._UNIT, 2 * boosting._UNIT]
    assert best_splits(sums, np.array([1, 0]), p).gain.tolist() == [0.0, 0.0]


def test_gamma_prunes_from_the_bottom_up(table):
    plain = TreeParams(trees=1, depth=4, learning_rate=0.3)
    full = boost(table, INPUTS, plain, label="y", id_column="key").trees[0]
    pruned = boost(table, INPUTS, TreeParams(**{**plain.__dict__, "gamma": 5.0}), label="y", id_column="key").trees[0]
    none = boost(table, INPUTS, TreeParams(**{**plain.__dict__, "gamma": 1e9}), label="y", id_column="key").trees[0]
    inner = [int((t.feature[: len(t.feature)] >= 0).sum()) for t in (full, pruned, none)]
    assert inner[0] > inner[1] > 0 and inner[2] == 0


def test_forest_survives_its_table(spark, table):
    p = TreeParams(trees=3, depth=3, learning_rate=0.3)
    forest = boost(table, INPUTS, p, label="y", id_column="key")
    again = Forest.of_table(forest.table(spark), INPUTS)
    assert again.rows() == forest.rows()
    x, _ = arrays(table)
    want = forest.base + sum(t.margins(x) for t in forest.trees)
    got = table.select(again.margin(spark).alias("m")).toPandas()["m"].to_numpy()
    assert np.allclose(got, want, atol=1e-12)


def test_degenerate_inputs(spark):
    p = TreeParams(trees=2, depth=2, learning_rate=0.3)
    same = spark.range(50).selectExpr("id as key", "1.0 as a", "cast(null as double) as b", "cast('nan' as double) as c", "int(id % 2) as y")
    forest = boost(same, INPUTS, p, label="y", id_column="key")
    assert all((t.feature < 0).all() for t in forest.trees)
    with pytest.raises(ValueError, match="no rows"):
        boost(same.limit(0), INPUTS, p, label="y", id_column="key")
    with pytest.raises(Exception, match="0 or 1"):
        boost(same.withColumn("y", F.lit(2)), INPUTS, p, label="y", id_column="key")


def random_block(n):
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 20, (4, n)).astype(np.uint8)
    bins[1][rng.random(n) < 0.2] = MISSING
    label = (rng.random(n) < np.where(bins[0] < 17, 0.2, 0.8) + np.where(bins[1] == MISSING, 0.1, 0)).astype(np.uint8)
    return boosting._Block(bins, label, rng.integers(-(1 << 62), 1 << 62, n), np.zeros(n))


@pytest.mark.parametrize("flat", [0, 128])
def test_rows_end_where_following_them_ends(flat, monkeypatch):
    monkeypatch.setattr(boosting, "_FLAT_NODES", flat)
    block, p = random_block(40_000), TreeParams(trees=3, depth=5, learning_rate=0.3)
    for tree in boosting._boosted(boosting._InTask(block, p), [np.arange(19.0)] * 4, p):
        at = np.zeros(block.bins.shape[1], np.int64)
        for _ in range(tree.depth):
            at = tree.step_bins(at, block.bins)
        assert len(tree.feature) > 40 and (tree.leaves_of_bins(block.bins) == at).all()


def test_the_lighter_of_two_siblings_is_counted():
    """No more than half of the weight of a level is counted again on the next."""
    weights = []

    class Source(boosting._InTask):
        def histograms(self, *asked):
            found = super().histograms(*asked)
            weights.append(found[:, 0, :, 1].sum())
            return found

    p = TreeParams(trees=1, depth=4, learning_rate=0.3)
    boosting.grow(Source(random_block(5_000), p), [np.arange(19.0)] * 4, 0, p)
    assert len(weights) == 4 and all(2 * w <= weights[0] for w in weights[1:])


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_tasks_boost_in_jobs_that_do_not_grow_with_the_trees(spark, table, monkeypatch):
    monkeypatch.setattr(boosting, "_BLOCK_ROWS", 300)

    def grown(trees):
        p = TreeParams(trees=trees, depth=3, learning_rate=0.3, subsample=0.7, colsample=0.67, min_child_weight=2.0)
        cuts = [np.arange(1, 10), [0.25, 0.5, 0.75], [0, 1]]
        return boost(table.repartition(9), INPUTS, p, label="y", id_column="key", cuts=cuts, task_rows=600)

    few, jobs_of_few = jobs_of(spark, "boost-2", lambda: grown(2))
    many, jobs_of_many = jobs_of(spark, "boost-7", lambda: grown(7))
    assert 0 < jobs_of_few == jobs_of_many and len(many.trees) == 7 and many.rows()[: len(few.rows())] == few.rows()
    # Where the tasks cannot run side by side, jobs of a level each grow the same trees.
    monkeypatch.setattr(boosting, "_side_by_side", lambda spark: 0)
    spread, jobs_of_spread = jobs_of(spark, "boost-spread", lambda: grown(7))
    assert spread.rows() == many.rows() and jobs_of_spread > jobs_of_many


def test_rows_ranked_once_get_the_margins_of_the_trees(spark, table, monkeypatch):
    p = TreeParams(trees=6, depth=4, learning_rate=0.3)
    forest = boost(table, INPUTS, p, label="y", id_column="key")
    rows = table.select(*INPUTS, forest.margin(spark).alias("m")).toPandas()
    expected = np.full(len(rows), forest.base)
    for tree in forest.trees:
        expected += tree.margins(rows[INPUTS].to_numpy(float))
    assert (rows["m"].to_numpy() == expected).all()
    thresholds, ranked = forest._by_rank()
    assert ranked is not None and max(map(len, thresholds)) > 3
    step = Forest((boosting.Tree(np.array([0, -1, -1]), np.array([0.5, 0, 0]), np.zeros(3, int), np.array([True, False, False]),
                                 np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0.0, 1.0, 2.0]), np.ones(3)),), 0.0, ("a",))
    wide = Forest(tuple(boosting.replace(step.trees[0], threshold=np.array([t, 0, 0])) for t in np.arange(300.0)), 0.0, ("a",))
    assert step._by_rank()[1] is not None and wide._by_rank()[1] is None  # more thresholds than a byte tells apart
    found = spark.createDataFrame([(0.0,), (150.5,), (None,)], "a double").select(wide.margin(spark).alias("m"))
    assert [r["m"] for r in found.collect()] == [300.0, 451.0, 300.0]
