"""Shapley attributions of boosted trees, path-dependent (Lundberg et al. 2018).

A leaf contributes to a row only through which inputs of its path the row satisfies. Short
paths have few such patterns, so each of their leaves gets a table from pattern to
contributions (Yang 2021). Leaves of a branch that few splits decide share one table from the
outcomes of these splits, so a row costs one look-up per branch. Long paths are extended and
unwound for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx

# How many rows of a report and how many contributors of a row are shown.
TOP_FEATURES = 20
TOP_CONTRIBUTIONS = 8
# Inputs on a path up to which a leaf has a table (of 2^inputs x inputs numbers).
_TABLE_INPUTS = 7
# Splits, on the path to a branch and in it, up to which its leaves share a table (of 2^splits x inputs numbers).
_BRANCH_SPLITS = 6


@dataclass(frozen=True)
class Leaf:
    features: tuple[int, ...]  # distinct inputs on the path
    turns: tuple[tuple[tuple[int, bool], ...], ...]  # of each input the splits on it: (split, goes left)
    zero: np.ndarray  # share of training rows that follow the path at the splits on an input
    value: float
    table: np.ndarray | None  # input x pattern -> contribution


@dataclass(frozen=True)
class Branch:
    """Leaves that the same few splits decide: what they add to each input by the outcomes of the splits."""

    splits: tuple[int, ...]
    features: tuple[int, ...]
    table: np.ndarray  # input x outcomes -> contribution


def _branch(leaves: Sequence[Leaf]) -> Branch:
    splits = sorted({split for leaf in leaves for turns in leaf.turns for split, _ in turns})
    features = sorted({f for leaf in leaves for f in leaf.features})
    table, outcomes = np.zeros((len(features), 1 << len(splits))), np.arange(1 << len(splits))
    for leaf in leaves:
        pattern = np.zeros(len(outcomes), np.int64)
        for j, turns in enumerate(leaf.turns):
            hit = np.ones(len(outcomes), bool)
            for split, goes_left in turns:
                hit &= (outcomes >> splits.index(split) & 1 == 1) == goes_left
            pattern |= hit.astype(np.int64) << j
        for f, column in zip(leaf.features, leaf.table):
            table[features.index(f)] += column[pattern]
    return Branch(tuple(splits), tuple(features), table)


def _branches(leaves: Sequence[Leaf]) -> tuple[list[Branch], list[Leaf]]:
    """Branches of neighbouring leaves that have tables, and the leaves that stay alone."""
    branches, alone, held, decided = [], [], [], set()
    for leaf in leaves:  # in order along the tree, so that neighbours share the most splits
        own = {split for turns in leaf.turns for split, _ in turns}
        if leaf.table is None or len(own) > _BRANCH_SPLITS:
            alone.append(leaf)
            continue
        if held and len(decided | own) > _BRANCH_SPLITS:
            branches.append(_branch(held))
            held, decided = [], set()
        held.append(leaf)
        decided |= own
    return branches + ([_branch(held)] if held else []), alone


@dataclass(frozen=True)
class TreePaths:
    """Leaves of one tree, and its splits: input, threshold and the side of missing values."""

    splits: tuple[tuple[int, float, bool], ...]
    leaves: tuple[Leaf, ...]
    branches: tuple[Branch, ...] = ()

    def add_contributions(self, x: np.ndarray, out: np.ndarray) -> None:
        """``x``, ``out``: inputs x rows."""
        left = []
        for feature, threshold, missing_left in self.splits:
            v = x[feature]
            goes = v <= threshold
            if missing_left:
                goes |= np.isnan(v)
            left.append(goes)
        bits = [goes.view(np.uint8) for goes in left]
        for branch in self.branches:
            pattern = np.zeros(x.shape[1], np.uint8)
            for j, split in enumerate(branch.splits):
                pattern |= bits[split] << np.uint8(j)
            index = pattern.astype(np.intp)  # once for all inputs
            for feature, column in zip(branch.features, branch.table):
                out[feature] += np.take(column, index)
        right = [~goes for goes in left] if self.leaves else []
        for leaf in self.leaves:
            hits = []
            for turns in leaf.turns:
                hit = None
                for split, goes_left in turns:
                    side = left[split] if goes_left else right[split]
                    hit = side if hit is None else hit & side
                hits.append(hit)
            if leaf.table is None:
                parts = unwound(leaf.value, leaf.zero, np.stack(hits))
            else:
                pattern = np.zeros(x.shape[1], np.uint8)
                for j, hit in enumerate(hits):
                    pattern |= hit.view(np.uint8) << np.uint8(j)
                index = pattern.astype(np.intp)  # once for all inputs
                parts = (np.take(column, index) for column in leaf.table)
            for feature, part in zip(leaf.features, parts):
                out[feature] += part


@dataclass(frozen=True)
class TreeTables:
    trees: tuple[TreePaths, ...]
    base_value: float

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Contribution of each input (rows x inputs, NaN for missing)."""
        columns = np.ascontiguousarray(x.T)
        out = np.zeros_like(columns)
        for tree in self.trees:
            tree.add_contributions(columns, out)
        return out.T


def _weights(d: int) -> np.ndarray:
    """Share of the orders of ``d`` inputs in which k given others come before one."""
    return np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])


def leaf_tables(values: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Contributions of each path input for every pattern of satisfied inputs: leaves x inputs x patterns.

    ``zero[l, j]`` is how the path of leaf l is weighted when its input j is unknown.
    """
    n, d = zero.shape
    one = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    table = np.empty((n, d, 1 << d))
    for j in range(d):
        sizes = np.zeros((n, 1 << d, d))  # summed products by number of known inputs
        sizes[:, :, 0] = 1.0
        for t in range(d):
            if t != j:
                known = np.roll(sizes, 1, axis=2) * one[None, :, t, None]
                known[:, :, 0] = 0.0
                sizes = sizes * zero[:, None, None, t] + known
        table[:, j] = values[:, None] * (one[None, :, j] - zero[:, None, j]) * (sizes @ _weights(d))
    return table


def unwound(value: float, zero: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The same for one leaf and many rows (inputs x rows of satisfied or not) without a table.

    The path is extended by one input after the other into sums of products by number of known
    inputs; taking an input out again leaves the sums over the others.
    """
    d, n = hits.shape
    sums = np.zeros((d + 1, n))
    sums[0] = 1.0
    for z, hit in zip(zero, hits):
        sums[1:] = sums[1:] * z + sums[:-1] * hit
        sums[0] *= z
    weights, out = _weights(d), np.empty((d, n))
    for j, (z, hit) in enumerate(zip(zero, hits)):
        with_it, without = np.zeros(n), np.zeros(n)
        rest = sums[d]
        for k in range(d - 1, -1, -1):
            with_it += weights[k] * rest
            without += weights[k] * sums[k]
            rest = sums[k] - z * rest
        out[j] = value * np.where(hit, with_it * (1 - z), -without)
    return out


def _paths(nodes: dict[int, dict], weight: float) -> tuple[list[tuple[int, float, bool]], list[tuple], float]:
    """Splits and leaves (path, value) of a tree, and its expected value."""
    splits, leaves, base = [], [], 0.0
    stack: list[tuple[int, dict[int, tuple[tuple, float]]]] = [(0, {})]
    while stack:
        at, path = stack.pop()
        node = nodes[at]
        if node["left"] < 0:
            value = weight * node["prediction"]
            base += value * node["cover"] / nodes[0]["cover"] if path else value
            if path:
                leaves.append((path, value))
            continue
        number, f = len(splits), node["feature"]
        splits.append((f, node["threshold"], node.get("missing_left", False)))
        turns, zero = path.get(f, ((), 1.0))
        for child, goes_left in ((node["right"], False), (node["left"], True)):
            share = zero * nodes[child]["cover"] / node["cover"]
            stack.append((child, {**path, f: ((*turns, (number, goes_left)), share)}))
    return splits, leaves, base


def tables_of(trees: Sequence[dict[int, dict]], weights: Sequence[float], base: float = 0.0) -> TreeTables:
    """What rows are explained with, of trees given by their nodes.

    A node has ``left``, ``right`` (-1 in a leaf), ``feature``, ``threshold``, ``prediction``, ``cover``
    and, where missing values go left, ``missing_left``. Size grows with leaves times their path.
    """
    splits, paths, owners = [], [], []
    for number, (tree, weight) in enumerate(zip(trees, weights)):
        own, leaves, expected = _paths(tree, weight)
        splits.append(tuple(own))
        paths += leaves
        owners += [number] * len(leaves)
        base += expected
    zeros = [np.array([share for _, share in path.values()]) for path, _ in paths]
    tables: list[np.ndarray | None] = [None] * len(paths)
    for d in range(1, _TABLE_INPUTS + 1):
        of_size = [i for i, z in enumerate(zeros) if len(z) == d]
        for start in range(0, len(of_size), 256):
            some = of_size[start : start + 256]
            made = leaf_tables(np.array([paths[i][1] for i in some]), np.stack([zeros[i] for i in some]))
            for i, table in zip(some, made):
                tables[i] = table
    leaves_of: list[list[Leaf]] = [[] for _ in splits]
    for owner, (path, value), zero, table in zip(owners, paths, zeros, tables):
        leaves_of[owner].append(Leaf(tuple(path), tuple(turns for turns, _ in path.values()), zero, value, table))
    made = []
    for own, leaves in zip(splits, leaves_of):
        branches, alone = _branches(leaves)
        made.append(TreePaths(own, tuple(alone), tuple(branches)))
    return TreeTables(tuple(made), base)


def _fold(inputs: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]]) -> np.ndarray:
    fold = np.zeros((len(inputs), len(groups)))
    for g, (_, members) in enumerate(groups):
        fold[[inputs.index(m) for m in members], g] = 1.0
    return fold


def _numbers(inputs: Sequence[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(f"__input_{i}") for i, c in enumerate(inputs)]


def _matrix(batch: pa.RecordBatch, n_inputs: int) -> np.ndarray:
    columns = batch.columns[len(batch.columns) - n_inputs :]
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def mean_contributions(
    df: DataFrame, tables: TreeTables, inputs: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]], top: int = TOP_FEATURES
) -> DataFrame:
    """(feature, mean_abs_shap) over all rows, largest first. Tasks hand on sums, not rows."""
    inputs = list(inputs)
    shared = df.sparkSession.sparkContext.broadcast((tables, _fold(inputs, groups)))
    names = [f"s{i}" for i in range(len(groups))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_tables, to_groups = shared.value
        n, total = 0, np.zeros(len(names))
        for batch in batches:
            total += np.abs(tree_tables.contributions(_matrix(batch, len(inputs))) @ to_groups).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([v]) for v in total]], ["n", *names])

    sums = df.select(*_numbers(inputs)).mapInArrow(add_up, "n bigint, " + ", ".join(f"{c} double" for c in names))
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    rows = [F.struct(F.lit(f).alias("feature"), (F.col(c) / F.col("n")).alias("mean_abs_shap")) for (f, _), c in zip(groups, names)]
    shown = total.where("n is not null").select(F.inline(F.array(*rows)))
    return shown.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)


def attribute_rows(
    df: DataFrame,
    tables: TreeTables,
    inputs: Sequence[str],
    groups: Sequence[tuple[str, Sequence[str]]],
    *,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` columns, ``base_value`` and ``contributions`` (feature, shap), on the log-odds scale.

    ``inputs`` are the model's input columns in order; ``groups`` names the reported features
    and the inputs whose contributions add up to each. base_value plus all contributions is
    the row's margin.
    """
    inputs, keep = list(inputs), list(keep)
    shared = df.sparkSession.sparkContext.broadcast((tables, _fold(inputs, groups)))
    names = [f"phi_{i}" for i in range(len(groups))]

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_tables, to_groups = shared.value
        for batch in batches:
            phi = tree_tables.contributions(_matrix(batch, len(inputs))) @ to_groups
            base = pa.array(np.full(batch.num_rows, tree_tables.base_value))
            columns = [*batch.columns[: len(keep)], base, *[pa.array(c) for c in np.ascontiguousarray(phi.T)]]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "base_value", *names])

    kept = df.select(*[f"`{c}`" for c in keep], *_numbers(inputs))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]
    raw = kept.mapInArrow(explain, ", ".join([*schema, "base_value double", *[f"{n} double" for n in names]]))
    named = F.array(
        *[F.struct(F.lit(name).alias("feature"), F.col(f"phi_{i}").alias("shap")) for i, (name, _) in enumerate(groups)]
    )
    return raw.select(*keep, "base_value", named.alias("contributions"))


def top_contributions(df: DataFrame, n: int = TOP_CONTRIBUTIONS) -> DataFrame:
    """Keep each row's ``n`` largest contributions by size, ties by name; adds ``n_features``."""
    by_size = "(a, b) -> case when abs(a.shap) > abs(b.shap) then -1 when abs(a.shap) < abs(b.shap) then 1 " \
        "when a.feature < b.feature then -1 when a.feature > b.feature then 1 else 0 end"
    return df.select(
        *[c for c in df.columns if c != "contributions"],
        F.expr(f"slice(array_sort(contributions, {by_size}), 1, {int(n)})").alias("top_contributions"),
        F.size("contributions").alias("n_features"),
    )


def directed(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round the shown contributions and say which way each one pushes."""
    shown = F.transform(
        "top_contributions",
        lambda c: F.struct(
            c["feature"].alias("feature"),
            F.round(c["shap"], digits).alias("shap"),
            fx.push_direction(c["shap"]).alias("pushes"),
        ),
    )
    return df.withColumn("top_contributions", shown)


def global_attribution(df: DataFrame, features: Sequence[str], top: int = TOP_FEATURES) -> DataFrame:
    """Mean absolute contribution per feature over all rows, largest first.

    ``features`` are the reported features in order. Rows are summed as they are, one number per feature.
    """
    means = df.agg(*[F.avg(F.abs(F.col("contributions")[i]["shap"])).alias(f"m{i}") for i in range(len(features))])
    rows = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs_shap")) for i, f in enumerate(features)]
    )
    shown = means.select(F.inline(rows)).where("mean_abs_shap is not null")
    return shown.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)
