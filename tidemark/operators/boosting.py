"""Boosted trees for a 0/1 target from histograms of gradients and hessians.

Inputs are cut into at most 255 bins once; a bin of its own stands for missing. Each level of a
tree is one pass over the binned rows: tasks add up gradients and hessians per node, input and
bin, the sums are merged in a tree of tasks, and the driver picks one split per node from them.
Gradients are whole numbers (fixed point), so that sums, splits and trees do not depend on how
rows are dealt out. Rows that are no more than a task is given anyway are boosted inside that
task, with the same sums and the same trees, since there is nothing to merge. Rows that the tasks
which can run side by side hold between them are boosted in one job: each task keeps its rows and
grows all trees, and the tasks exchange their sums through the shared folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, work_dir

# Values 0 to 254 of a bin are ranges between cuts, 255 is missing.
MISSING = 255
_BINS = 256
# One unit of a gradient or hessian; 2^42 rows of at most 1 stay within 64 bits.
_UNIT = 1 << 20
# Rows of a block (one row of the binned table) and of a task.
_BLOCK_ROWS = 1 << 14
_TASK_ROWS = 1 << 20
# Rows, of about 120 bytes, that each of several tasks keeps while they boost together.
_KEPT_ROWS = 1 << 22
# Sums of this many tasks are merged by one.
_FAN_IN = 32
# Margins are written after this many trees; those grown since are applied anew in each pass.
_TREES_PER_STATE = 8
# Seconds that a task waits for the sums of another.
_PATIENCE = 3600
# Rows below which one more task is not worth its start.
_FEWEST_ROWS = 1 << 16
# Nodes of a tree up to which all of its splits are decided for all rows, which costs less than to follow
# each row, and rows that are looked at together meanwhile.
_FLAT_NODES = 128
_AT_ONCE = 1 << 14


@dataclass(frozen=True)
class TreeParams:
    """Settings of one boosting run; ``l2`` is the penalty on leaf values."""

    trees: int
    depth: int
    learning_rate: float
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0
    l2: float = 1.0
    gamma: float = 0.0
    max_bins: int = 255
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first. ``feature`` is -1 in a leaf; values up to ``threshold`` go left."""

    feature: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray  # the bin that ``threshold`` ends
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # sum of hessians

    @property
    def depth(self) -> int:
        level, steps = np.zeros(1, np.int64), 0
        while (inner := level[self.feature[level] >= 0]).size:
            level, steps = np.concatenate((self.left[inner], self.right[inner])), steps + 1
        return steps

    def step(self, at: np.ndarray, goes_left) -> np.ndarray:
        """Move rows that stand at an inner node to a child; ``at`` is changed."""
        inner = np.nonzero(self.feature[at] >= 0)[0]
        here = at[inner]
        at[inner] = np.where(goes_left(inner, here), self.left[here], self.right[here])
        return at

    def step_bins(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The same for columns of ``bins`` (inputs x rows)."""

        def goes_left(rows: np.ndarray, here: np.ndarray) -> np.ndarray:
            b = bins[self.feature[here], rows]
            return np.where(b == MISSING, self.missing_left[here], b <= self.cut[here])

        return self.step(at, goes_left)

    def leaves_of_bins(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(bins.shape[1], np.int64)
        if len(self.feature) > _FLAT_NODES:
            for _ in range(self.depth):
                at = self.step_bins(at, bins)
            return at
        for start in range(0, len(at), _AT_ONCE):
            at[start : start + _AT_ONCE] = self._end(0, bins[:, start : start + _AT_ONCE])
        return at

    def _end(self, node: int, bins: np.ndarray) -> np.ndarray | np.uint8:
        """The node at which rows end that are taken to stand at ``node``."""
        if self.feature[node] < 0:
            return np.uint8(node)
        b = bins[self.feature[node]]
        goes_left = b <= np.uint8(self.cut[node])
        if self.missing_left[node]:
            goes_left |= b == np.uint8(MISSING)
        right = self._end(self.right[node], bins)
        # The difference may pass below zero and comes back: numbers of a byte wrap around.
        return right + goes_left.view(np.uint8) * np.subtract(self._end(self.left[node], bins), right, dtype=np.uint8)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Leaf values of rows of raw inputs (rows x inputs, NaN for missing)."""

        def goes_left(rows: np.ndarray, here: np.ndarray) -> np.ndarray:
            v = x[rows, self.feature[here]]
            return np.where(np.isnan(v), self.missing_left[here], v <= self.threshold[here])

        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = self.step(at, goes_left)
        return self.value[at]

    def nodes(self) -> dict[int, dict]:
        """Nodes as the attribution reads them."""
        return {
            i: {
                "left": int(self.left[i]),
                "right": int(self.right[i]),
                "feature": int(self.feature[i]),
                "threshold": float(self.threshold[i]),
                "missing_left": bool(self.missing_left[i]),
                "prediction": float(self.value[i]),
                "cover": float(self.cover[i]),
            }
            for i in range(len(self.feature))
        }


_NODE = (
    "tree int, node int, feature int, threshold double, cut int, missing_left boolean, `left` int, `right` int, "
    "value double, cover double"
)
_NODE_TYPES = {"tree": "int32", "node": "int32", "feature": "int32", "cut": "int32", "left": "int32", "right": "int32"}
_FIELDS = ("feature", "threshold", "cut", "missing_left", "left", "right", "value", "cover")


@dataclass(frozen=True)
class Forest:
    """Trees whose leaf values add up, with ``base``, to the log-odds."""

    trees: tuple[Tree, ...]
    base: float
    inputs: tuple[str, ...]

    def margin(self, spark: SparkSession) -> Column:
        """Log-odds as a column over the input columns (doubles; null is missing). Stays in the row's task."""
        shared = spark.sparkContext.broadcast((self, self._by_rank()))

        def add_up(*columns: pd.Series) -> pd.Series:
            forest, (thresholds, ranked) = shared.value
            total = np.full(len(columns[0]), forest.base)
            if ranked is None:
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                for tree in forest.trees:
                    total += tree.margins(x)
            else:
                bins = np.stack([bin_of(c.to_numpy(dtype=float), t) for c, t in zip(columns, thresholds)])
                for tree in ranked:
                    total += tree.value[tree.leaves_of_bins(bins)]
            return pd.Series(total)

        add_up.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return F.pandas_udf(add_up, "double")(*[F.col(f"`{c}`").cast("double") for c in self.inputs])

    def _by_rank(self) -> tuple[list[np.ndarray], tuple[Tree, ...] | None]:
        """Thresholds of each input and the trees with the rank of theirs as cut, so that rows can be ranked once
        for all trees; no trees where an input has more thresholds than bins."""
        inner = [tree.feature >= 0 for tree in self.trees]
        feature = np.concatenate([np.zeros(0, int), *[t.feature[i] for t, i in zip(self.trees, inner)]])
        threshold = np.concatenate([np.zeros(0), *[t.threshold[i] for t, i in zip(self.trees, inner)]])
        by_input = [np.unique(threshold[feature == f]) for f in range(len(self.inputs))]
        if any(len(t) >= MISSING for t in by_input):
            return by_input, None
        ranked = []
        for tree, some in zip(self.trees, inner):
            cut = np.zeros(len(tree.cut), np.int32)
            cut[some] = [np.searchsorted(by_input[f], t) for f, t in zip(tree.feature[some], tree.threshold[some])]
            ranked.append(replace(tree, cut=cut))
        return by_input, tuple(ranked)

    def rows(self) -> list[tuple]:
        """One row per node; the base value is that of a tree -1."""
        rows = [(-1, 0, -1, 0.0, 0, False, -1, -1, float(self.base), 0.0)]
        for number, tree in enumerate(self.trees):
            for i in range(len(tree.feature)):
                rows.append((number, i, *[getattr(tree, f)[i].item() for f in _FIELDS]))
        return rows

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), _NODE)

    @classmethod
    def of_table(cls, nodes: DataFrame, inputs: Sequence[str]) -> Forest:
        frame = nodes.toPandas().sort_values(["tree", "node"])  # trees x nodes rows, whatever the data
        base = frame.loc[frame["tree"] < 0, "value"].iloc[0]
        trees = [Tree(*[g[f].to_numpy() for f in _FIELDS]) for t, g in frame.groupby("tree") if t >= 0]  # in order
        return cls(tuple(trees), float(base), tuple(inputs))


# --- binning ---------------------------------------------------------------------------


def bin_cuts(df: DataFrame, inputs: Sequence[str], max_bins: int = 255) -> list[np.ndarray]:
    """Ascending cuts per input, near equal shares apart, from sketches that tasks merge."""
    if not 2 <= max_bins <= MISSING:
        raise ValueError("max_bins must be between 2 and 255")
    shares = np.arange(1, max_bins) / max_bins
    columns = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(inputs)]
    wide = df.select(*[F.when(~F.isnan(c), c).alias(f"c{i}") for i, c in enumerate(columns)])
    asked = F.array(*map(F.lit, shares.tolist()))
    found = wide.agg(*[F.percentile_approx(c, asked, 16 * max_bins).alias(c) for c in wide.columns]).first()
    return [np.unique(np.array(found[c] or [], float)) for c in wide.columns]


def bin_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin i holds values above the cut before it up to cut i."""
    return np.where(np.isnan(values), MISSING, np.searchsorted(cuts, values, side="left")).astype(np.uint8)


_BLOCK = "rows int, bins binary, label binary, draw binary, margin binary"


def binned(df: DataFrame, inputs: Sequence[str], cuts: list[np.ndarray], *, label: str, draw: Column, base: float) -> DataFrame:
    """Blocks of binned rows. ``draw``: a 64-bit hash that stands for the row in random choices."""
    columns = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(inputs)]
    rows = df.select(*columns, F.col(f"`{label}`").cast("double").alias("label"), draw.alias("draw"))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bins = [bin_of(table.column(f"c{i}").to_pandas().to_numpy(float), c) for i, c in enumerate(cuts)]
        y = table.column("label").to_pandas().to_numpy(float)
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("the target must be 0 or 1 and never missing")
        parts = [np.stack(bins), y.astype(np.uint8), table.column("draw").to_numpy().astype(np.int64), np.full(len(y), base)]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(y)], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
            ["rows", "bins", "label", "draw", "margin"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = held + [batch], n + batch.num_rows
            if n >= _BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(run, _BLOCK)


@dataclass
class _Block:
    bins: np.ndarray
    label: np.ndarray
    draw: np.ndarray
    margin: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("rows")[i].as_py()
            raw = {c: batch.column(c)[i].as_buffer() for c in ("bins", "label", "draw", "margin")}
            yield _Block(
                np.frombuffer(raw["bins"], np.uint8).reshape(-1, n),
                np.frombuffer(raw["label"], np.uint8),
                np.frombuffer(raw["draw"], np.int64),
                np.frombuffer(raw["margin"], np.float64),
            )


# --- gradients -------------------------------------------------------------------------


def gradients(label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - label) * _UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * _UNIT)


def taken(draw: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on: by a hash of the row and the tree."""
    if share >= 1:
        return np.ones(len(draw), bool)
    # The finaliser of a 64-bit generator (Steele et al. 2014) over row, tree and seed.
    salt = (tree * 1_000_003 + seed) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = draw.view(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


def _standing(rows: np.ndarray, at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given rows those that stand ``at`` one of ``nodes``, and which."""
    place = np.full(max(at.max(initial=0), nodes.max()) + 1, -1)
    place[nodes] = np.arange(len(nodes))
    slot = place[at[rows]]
    here = slot >= 0
    return rows[here], slot[here]


def _histogram(
    bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, slot: np.ndarray, nodes: np.ndarray, features: np.ndarray
) -> np.ndarray:
    """Sums of gradients and hessians (nodes x features x bins x 2) of the given rows; ``g``, ``h`` and ``slot``,
    the place of their node, are theirs."""
    slot = slot * _BINS
    out = np.empty((len(nodes), len(features), _BINS, 2))
    for k, f in enumerate(features):
        cell = slot + bins[f, rows]
        for side, weights in enumerate((g, h)):
            out[:, k, :, side] = np.bincount(cell, weights, len(nodes) * _BINS).reshape(len(nodes), _BINS)
    return out.astype(np.int64)


class _InTask:
    """Histograms of rows that are all at hand; what is known of a row is kept from level to level."""

    def __init__(self, block: _Block, p: TreeParams):
        self.block, self.p = block, p
        self.margin, self.number = block.margin.copy(), -1

    def histograms(self, grown: Tree, nodes: np.ndarray, features: np.ndarray, number: int) -> np.ndarray:
        if number != self.number:
            self.number, self.at = number, np.zeros(len(self.margin), np.int64)
            self.g, self.h = gradients(self.block.label, self.margin)
            self.rows = np.nonzero(taken(self.block.draw, number, self.p.seed, self.p.subsample))[0]
        else:
            self.at = grown.leaves_of_bins(self.block.bins)
        rows, slot = _standing(self.rows, self.at, nodes)
        return _histogram(self.block.bins, self.g[rows], self.h[rows], rows, slot, nodes, features)

    def add(self, tree: Tree) -> None:
        self.margin += tree.value[tree.leaves_of_bins(self.block.bins)]


class _Exchange:
    """Sums over the tasks of a barrier stage, by files in a folder that all of them reach.

    Up to ``_FAN_IN`` tasks read the sums of one another; of more, groups are added up by one of their tasks first.
    A task waits for files, not at a barrier, which Spark looks at only now and then.
    """

    def __init__(self, folder: str):
        self.task = BarrierTaskContext.get()
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        # Numbers that no other attempt has, so that files of a failed one are not taken for those of this.
        self.names = self.task.allGather(str(self.task.taskAttemptId()))
        self.place, self.round, self.old = self.task.partitionId(), 0, []

    def _put(self, kind: str, sums: np.ndarray) -> str:
        path = self._path(kind, self.place)
        with self.system.open_output_stream(f"{path}.part", compression=None) as sink:
            sink.write(sums.tobytes())
        self.system.move(f"{path}.part", path)
        return path

    def _path(self, kind: str, place: int) -> str:
        return f"{self.folder}/{kind}-{self.round}-{self.names[place]}"

    def _total(self, kind: str, places: range, shape: tuple[int, ...]) -> np.ndarray:
        total, left = np.zeros(shape, np.int64), [self._path(kind, place) for place in places]
        pause, until = 0.001, time.monotonic() + _PATIENCE
        while left:
            there = [x.path for x in self.system.get_file_info(left) if x.type == fs.FileType.File]
            for path in there:
                with self.system.open_input_file(path) as source:
                    total += np.frombuffer(source.read(), np.int64).reshape(shape)
            if there:
                left, pause = [path for path in left if path not in set(there)], 0.001
            elif time.monotonic() > until:
                raise TimeoutError(f"no sums of {len(left)} tasks, {left[0]} among them")
            else:
                time.sleep(pause)
                pause = min(2 * pause, 0.05)
        return total

    def add_up(self, sums: np.ndarray) -> np.ndarray:
        kind, step, tasks, written = "task", 1, len(self.names), [self._put("task", sums)]
        while -(-tasks // step) > _FAN_IN:
            wide = step * _FAN_IN
            if self.place % wide == 0:
                total = self._total(kind, range(self.place, min(self.place + wide, tasks), step), sums.shape)
                written.append(self._put(f"group{wide}", total))
            kind, step = f"group{wide}", wide
        total = self._total(kind, range(0, tasks, step), sums.shape)
        # These files hold sums of all tasks, each of which had read all of the round before.
        for path in self.old:
            self.system.delete_file(path)
        self.old, self.round = written, self.round + 1
        return total

    def close(self) -> None:
        self.task.barrier()
        for path in self.old:
            self.system.delete_file(path)


class _Together(_InTask):
    """Histograms of rows that several tasks keep; all of them get the same sums and grow the same trees."""

    def __init__(self, block: _Block, p: TreeParams, exchange: _Exchange):
        super().__init__(block, p)
        self.exchange = exchange

    def histograms(self, *asked) -> np.ndarray:
        return self.exchange.add_up(super().histograms(*asked))


def _summed(parts: DataFrame, tasks: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all tasks; while there are many, groups of them are added up by tasks first."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column("sums"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    while tasks > _FAN_IN:
        tasks = -(-tasks // _FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("part").applyInArrow(add, "part bigint, sums binary")
    total = np.zeros(shape, np.int64)
    for row in parts.select("sums").collect():  # at most _FAN_IN rows of one histogram each
        total += np.frombuffer(row["sums"], np.int64).reshape(shape)
    return total


class _Spread:
    """Histograms of a table of blocks: one job per level, sums merged by tasks."""

    def __init__(self, state: DataFrame, tasks: int, p: TreeParams):
        self.state, self.tasks, self.p = state, tasks, p
        self.since: list[Tree] = []

    def histograms(self, grown: Tree, nodes: np.ndarray, features: np.ndarray, number: int) -> np.ndarray:
        p, since = self.p, tuple(self.since)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for block in _blocks(batches):
                rows = np.nonzero(taken(block.draw, number, p.seed, p.subsample))[0]
                rows, slot = _standing(rows, grown.leaves_of_bins(block.bins), nodes)
                g, h = gradients(block.label[rows], _margin(block, since)[rows])
                found = _histogram(block.bins, g, h, rows, slot, nodes, features)
                total = found if total is None else total + found
            if total is not None:
                columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "sums"])

        parts = self.state.mapInArrow(run, "part bigint, sums binary")
        return _summed(parts, self.tasks, (len(nodes), len(features), _BINS, 2))

    def add(self, tree: Tree) -> None:
        self.since.append(tree)
        if len(self.since) == _TREES_PER_STATE:
            self.state, self.since = materialise(_with_margins(self.state, tuple(self.since)), "margins"), []


# --- splits ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Splits:
    """The best split of each node, ``gain`` 0 where there is none; sums are those of the left side."""

    gain: np.ndarray
    feature: np.ndarray  # place among the features of the histogram
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray  # nodes x 2, in units


def best_splits(sums: np.ndarray, n_cuts: np.ndarray, p: TreeParams) -> Splits:
    """Of each node the split of the highest gain, the first in order of input, cut and side of missing rows.

    ``sums``: nodes x features x bins x 2 in units; ``n_cuts``: cuts per feature. The gain is
    G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2); a side must have hessians of
    ``min_child_weight`` in all.
    """
    unit = float(_UNIT)
    total = sums[:, 0].sum(axis=1)
    below = np.cumsum(sums[:, :, :MISSING], axis=2)[:, :, :-1]  # nodes x features x cuts x 2
    left = np.stack((below, below + sums[:, :, MISSING:]), axis=3)  # missing rows right, left
    right = total[:, None, None, None] - left
    g_l, h_l, g_r, h_r = (side[..., k] / unit for side in (left, right) for k in (0, 1))
    g, h = total[:, 0] / unit, total[:, 1] / unit
    # Sides that hold no rows have no hessians; without a penalty they would divide by nothing.
    allowed = (h_l >= p.min_child_weight) & (h_r >= p.min_child_weight) & (h_l > 0) & (h_r > 0)
    allowed &= (np.arange(MISSING - 1)[None, :] < n_cuts[:, None])[None, :, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g_l**2 / (h_l + p.l2) + g_r**2 / (h_r + p.l2) - (g**2 / (h + p.l2))[:, None, None, None]
    gain = np.where(allowed, gain, -np.inf).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    feature, rest = np.divmod(best, (MISSING - 1) * 2)
    cut, side = np.divmod(rest, 2)
    found = gain[np.arange(len(sums)), best]
    return Splits(np.where(found > 1e-6, found, 0.0), feature, cut, side == 1, left[np.arange(len(sums)), feature, cut, side])


class _Growing:
    """A tree while its levels are added."""

    def __init__(self):
        self.rows: list[list] = []

    def node(self, sums: np.ndarray) -> int:
        self.rows.append([-1, 0.0, 0, False, -1, -1, 0.0, sums[1] / _UNIT, sums, 0.0])
        return len(self.rows) - 1

    def split(self, at: int, feature: int, threshold: float, cut: int, missing_left: bool, gain: float, left: int, right: int) -> None:
        self.rows[at][:6] = [feature, threshold, cut, missing_left, left, right]
        self.rows[at][9] = gain

    def prune(self, gamma: float) -> None:
        """Splits into two leaves that gain less than ``gamma`` are taken back, from the bottom up."""
        for row in reversed(self.rows):
            if row[0] >= 0 and row[9] < gamma and self.rows[row[4]][0] < 0 and self.rows[row[5]][0] < 0:
                row[:6] = [-1, 0.0, 0, False, -1, -1]

    def tree(self, p: TreeParams) -> Tree:
        for row in self.rows:
            g, h = row[8] / _UNIT
            row[6] = -p.learning_rate * g / (h + p.l2) if row[0] < 0 and h + p.l2 > 0 else 0.0
        columns = list(zip(*[row[:8] for row in self.rows]))
        kinds = (np.int32, float, np.int32, bool, np.int32, np.int32, float, float)
        return Tree(*[np.array(c, kind) for c, kind in zip(columns, kinds)])


def grow(source: _InTask | _Spread, cuts: Sequence[np.ndarray], number: int, p: TreeParams) -> Tree:
    """One tree, level by level; of two siblings one is counted and the other is what is left of the parent."""
    order = np.random.default_rng((p.seed, number)).permutation(len(cuts))
    features = np.sort(order[: max(1, round(p.colsample * len(cuts)))])
    n_cuts = np.array([len(cuts[f]) for f in features])
    growing = _Growing()
    root = growing.node(np.zeros(2, np.int64))
    counted, derived = np.array([root]), {}  # node -> (parent's histogram, counted sibling)
    for level in range(p.depth):
        found = source.histograms(growing.tree(p), counted, features, number)
        sums = dict(zip(counted.tolist(), found))
        sums |= {node: parent - sums[sibling] for node, (parent, sibling) in derived.items()}
        if level == 0:
            growing.rows[root][7:9] = [sums[root][0, :, 1].sum() / _UNIT, sums[root][0].sum(axis=0)]
        nodes = sorted(sums)
        splits = best_splits(np.stack([sums[i] for i in nodes]), n_cuts, p)
        counted_next, derived = [], {}
        for k, node in enumerate(nodes):
            if splits.gain[k] <= 0:
                continue
            f, cut = int(features[splits.feature[k]]), int(splits.cut[k])
            whole = growing.rows[node][8]
            left, right = growing.node(splits.left[k]), growing.node(whole - splits.left[k])
            growing.split(node, f, float(cuts[f][cut]), cut, bool(splits.missing_left[k]), float(splits.gain[k]), left, right)
            # The lighter one is counted, which is the one of fewer rows as a rule.
            light, heavy = (left, right) if 2 * splits.left[k][1] <= whole[1] else (right, left)
            counted_next.append(light)
            derived[heavy] = (sums[node], light)
        if not counted_next:
            break
        counted = np.sort(counted_next)
    growing.prune(p.gamma)
    return growing.tree(p)


def _margin(block: _Block, since: Sequence[Tree]) -> np.ndarray:
    margin = block.margin
    for tree in since:
        margin = margin + tree.value[tree.leaves_of_bins(block.bins)]
    return margin


def _with_margins(state: DataFrame, since: Sequence[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [_margin(block, since).tobytes() for block in _blocks([batch])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margins, pa.binary())], batch.schema.names)

    return state.mapInArrow(run, _BLOCK)


def _boosted(source: _InTask | _Spread, cuts: Sequence[np.ndarray], p: TreeParams) -> tuple[Tree, ...]:
    trees = []
    for number in range(p.trees):
        trees.append(grow(source, cuts, number, p))
        if number + 1 < p.trees:
            source.add(trees[-1])
    return tuple(trees)


_NAMES = [f.split()[0].strip("`") for f in _NODE.split(", ")]


def _whole(batches: Iterator[pa.RecordBatch], inputs: int) -> _Block:
    blocks = list(_blocks(batches))
    if not blocks:
        return _Block(*[np.zeros(shape, kind) for shape, kind in (((inputs, 0), np.uint8), (0, np.uint8), (0, np.int64), (0, float))])
    return _Block(*[np.concatenate([getattr(b, f) for b in blocks], axis=-1) for f in ("bins", "label", "draw", "margin")])


def _node_batch(trees: tuple[Tree, ...], inputs: Sequence[str]) -> pa.RecordBatch:
    rows = Forest(trees, 0.0, tuple(inputs)).rows()
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_NAMES).astype(_NODE_TYPES), preserve_index=False)


def _boosted_in_task(state: DataFrame, cuts: Sequence[np.ndarray], p: TreeParams, inputs: Sequence[str]) -> tuple[Tree, ...]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches, len(cuts))  # at most _TASK_ROWS rows of about 40 bytes
        if len(whole.label):
            yield _node_batch(_boosted(_InTask(whole, p), cuts, p), inputs)

    return Forest.of_table(state.mapInArrow(run, _NODE), inputs).trees


def _side_by_side(spark: SparkSession) -> int:
    """Tasks that run at once for certain; none while the cluster may give executors back."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _boosted_together(blocks: DataFrame, tasks: int, cuts: Sequence[np.ndarray], p: TreeParams, inputs: Sequence[str]) -> tuple[Tree, ...]:
    folder = f"{work_dir(blocks.sparkSession)}/sums-{uuid.uuid4().hex[:12]}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    system, place = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    system.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, exchange = _whole(batches, len(cuts)), _Exchange(folder.replace("s3a://", "s3://", 1))
        trees = _boosted(_Together(whole, p, exchange), cuts, p)
        exchange.close()
        if exchange.place == 0:
            yield _node_batch(trees, inputs)

    return Forest.of_table(blocks.repartition(tasks).mapInArrow(run, _NODE, barrier=True), inputs).trees


def boost(
    df: DataFrame,
    inputs: Sequence[str],
    p: TreeParams,
    *,
    label: str,
    id_column: str,
    cuts: Sequence[Sequence[float]] | None = None,
    base: float | None = None,
    task_rows: int = _TASK_ROWS,
) -> Forest:
    """Fit a forest to the 0/1 column ``label``; null and NaN inputs are missing.

    Rows of a tree are drawn by a hash of ``id_column``, columns by the tree's number. Besides
    trees, one histogram per node of a level is what reaches the driver, and none where the tasks exchange
    them. Up to ``task_rows`` rows are boosted within one task. ``cuts`` of the inputs and the ``base`` log-odds are found unless given.
    """
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(f"`{label}`").cast("double")).alias("pos")).first()
    if not sums["n"]:
        raise ValueError("cannot fit trees on no rows")
    share = min(max((sums["pos"] or 0) / sums["n"], 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share))) if base is None else float(base)
    cuts = bin_cuts(df, inputs, p.max_bins) if cuts is None else [np.unique(np.array(c, float)) for c in cuts]
    tasks = max(1, -(-sums["n"] // task_rows))
    if tasks > 1:  # all cores take part
        tasks = max(tasks, min(df.sparkSession.sparkContext.defaultParallelism, sums["n"] // _FEWEST_ROWS))
    blocks = binned(df, inputs, cuts, label=label, draw=F.xxhash64(F.col(f"`{id_column}`")), base=base)
    slots = _side_by_side(df.sparkSession) if tasks > 1 else 0
    if slots > 1 and sums["n"] <= slots * _KEPT_ROWS:
        return Forest(_boosted_together(blocks, min(tasks, slots), cuts, p, inputs), base, tuple(inputs))
    # Blocks are few and large; dealt out anew they keep all tasks busy in each of the many passes.
    state = materialise(blocks.repartition(tasks), "binned")
    if tasks == 1:
        return Forest(_boosted_in_task(state.coalesce(1), cuts, p, inputs), base, tuple(inputs))
    return Forest(_boosted(_Spread(state, tasks, p), cuts, p), base, tuple(inputs))
