"""Gradient boosting by second-order histograms, with a penalty on leaves and columns per tree.

Features are cut into quantile bins once. For each level of a tree, every task sums gradients and
Hessians per (node, column, bin) of its own rows; those sums are added up per node and block of
columns, where the best split is found too. Rows never leave Spark: one candidate split per node and
block, and one pair of losses per round, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.session import materialize

DEFAULTS = {"n_estimators": 500, "learning_rate": 0.05, "max_depth": 5, "subsample": 0.9, "colsample_bytree": 0.8,
            "reg_lambda": 1.0, "min_child_weight": 1.0, "max_bins": 64}
#: Bin of missing values; others count from 0.
MISSING = 255
#: Columns whose sums travel together.
BLOCK = 32
#: Values that a task goes over at a time; fewer make one task, whose start would cost more than its work.
CELLS_PER_TASK = 16_000_000
#: Rounds after which the scores so far are stored with the rows.
STORED_EVERY = 20
#: Columns whose quantiles are taken in one aggregate.
TOGETHER = 128
LEAST_GAIN = 1e-6
_FOLD = np.uint64(0x9E3779B97F4A7C15)


class Tree(NamedTuple):
    """Nodes as arrays; the children of a node are ``left`` and the one after it, leaves have feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def _leaves(self, rows: int, goes_left: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        node = np.zeros(rows, np.int64)
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return node
            node[inner] = self.left[node[inner]] + ~goes_left(np.flatnonzero(inner), node[inner])

    def leaves_of_bins(self, bins: np.ndarray) -> np.ndarray:
        def goes_left(rows: np.ndarray, node: np.ndarray) -> np.ndarray:
            found = bins[rows, self.feature[node]]
            return np.where(found == MISSING, self.missing_left[node], found <= self.bin[node])

        return self._leaves(len(bins), goes_left)

    def leaves(self, values: np.ndarray) -> np.ndarray:
        def goes_left(rows: np.ndarray, node: np.ndarray) -> np.ndarray:
            found = values[rows, self.feature[node]]
            return np.where(np.isnan(found), self.missing_left[node], found <= self.threshold[node])

        return self._leaves(len(values), goes_left)


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: start value and trees, whose leaves hold what they add."""

    base: float
    target_type: str
    trees: tuple[Tree, ...]

    def first(self, rounds: int) -> BoostedTrees:
        """The model as it was after so many rounds."""
        return BoostedTrees(self.base, self.target_type, self.trees[:rounds])

    def margins(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.base)
        for tree in self.trees:
            out += tree.value[tree.leaves(values)]
        return out

    def score(self, vector: Column) -> Column:
        """Predicted value, or chance of class 1, of a vector column."""
        chances = self.target_type == "classification"

        @F.arrow_udf("double")
        def scores(rows: pa.Array) -> pa.Array:
            margin = self.margins(_matrix(rows))
            return pa.array(chance(margin) if chances else margin)

        return scores(vector_to_array(vector))

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row per node, and one for the start value."""
        found = [(-1, 0, -1, -1, 0.0, -1, False, self.base, self.target_type)]
        for number, tree in enumerate(self.trees):
            found += [(number, node, *(x.item() for x in cells), self.target_type) for node, cells in enumerate(zip(*tree))]
        return spark.createDataFrame(found, "tree int, node int, feature int, bin int, threshold double, left int, "
                                            "missing_left boolean, value double, target_type string")

    def save(self, spark: SparkSession, folder: str) -> None:
        self.rows(spark).coalesce(1).write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> BoostedTrees:
        """A model written by ``save``: as many rows as it has nodes."""
        start, *nodes = sorted(spark.read.parquet(folder).collect(), key=lambda r: (r["tree"], r["node"]))
        trees: list[list] = []
        for row in nodes:
            if row["node"] == 0:
                trees.append([])
            trees[-1].append(row[2:8])
        kinds = (np.int64, np.int64, np.float64, np.int64, bool, np.float64)
        return BoostedTrees(start["value"], start["target_type"], tuple(
            Tree(*(np.array(c, k) for c, k in zip(zip(*tree), kinds))) for tree in trees))


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _matrix(rows: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; nulls as NaN."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)


def quantile_cuts(rows: DataFrame, column: str, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` different cuts for each entry of an array column; values up to a cut lie left of it."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cuts: list[np.ndarray] = []
    for at in range(0, width, TOGETHER):
        some = [F.percentile_approx(F.nullif(F.col(column)[k], F.lit(float("nan"))), shares, F.lit(10_000)).alias(f"q{k}")
                for k in range(at, min(at + TOGETHER, width))]
        cuts += [np.unique(np.array(q or [], np.float64)) for q in rows.agg(*some).first()]
    return cuts


def _binned(cuts: Sequence[np.ndarray]) -> Callable:
    schema = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("held", pa.bool_()), ("draw", pa.int64()), ("margin", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(0))
            bins = np.empty(values.shape, np.uint8)
            for k in range(values.shape[1] if len(values) else 0):
                column = values[:, k]
                bins[:, k] = np.where(np.isnan(column), MISSING, np.searchsorted(cuts[k], column, "left"))
            cells = [row.tobytes() for row in bins]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.binary()), *batch.columns[1:]], schema=schema)

    return run


def _bins_of(cells: pa.Array, width: int) -> np.ndarray:
    """The bytes of all cells side by side, without copying them one by one."""
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def tree_columns(seed: int, number: int, width: int, share: float) -> np.ndarray:
    """The columns that a tree may split on."""
    count = max(1, int(share * width))
    return np.sort(np.random.default_rng([seed, number]).permutation(width)[:count])


def _drawn(draw: np.ndarray, number: int, share: float) -> np.ndarray:
    """Rows that a tree learns from, by a hash of row and tree."""
    h = (draw.view(np.uint64) + np.uint64(number + 1)) * _FOLD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) / 2.0**64 < share


@dataclass(frozen=True)
class _Growing:
    """What tasks must know to sum up one level."""

    target_type: str
    width: int
    number: int
    subsample: float
    trees: tuple[Tree, ...]
    tree: Tree
    #: Place of each open node among the sums, -1 for others.
    open: np.ndarray
    columns: np.ndarray

    def sums(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, block, gradient and Hessian sums by column and bin); node -1 has the losses."""
        nodes = int(self.open.max()) + 1
        total = np.zeros((2, nodes * len(self.columns) * 256))
        losses = np.zeros(4)
        offsets = np.arange(len(self.columns)) * 256
        for batch in batches:
            if not len(batch):
                continue
            bins = _bins_of(batch.column(0), self.width)
            y, held, draw, margin = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            margin = margin.astype(np.float64)
            for tree in self.trees:
                margin += tree.value[tree.leaves_of_bins(bins)]
            if self.target_type == "classification":
                p = chance(margin)
                loss, gradient, hessian = -np.log(np.where(y > 0.5, p, 1 - p)), p - y, p * (1 - p)
            else:
                loss, gradient, hessian = (margin - y) ** 2, margin - y, np.ones(len(y))
            losses += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
            place = self.open[self.tree.leaves_of_bins(bins)]
            use = np.flatnonzero((place >= 0) & ~held & _drawn(draw, self.number, self.subsample))
            for at in range(0, len(use), 2048):
                some = use[at : at + 2048]
                cell = (bins[some][:, self.columns] + offsets + (place[some] * len(self.columns) * 256)[:, None]).ravel()
                for k, weight in enumerate((gradient, hessian)):
                    total[k] += np.bincount(cell, np.repeat(weight[some], len(self.columns)), total.shape[1])
        total = total.reshape(2, nodes, len(self.columns), 256)
        out = [(-1, 0, losses.tobytes())]
        for node in range(nodes):
            for block in range(0, len(self.columns), BLOCK):
                part = total[:, node, block : block + BLOCK]
                out.append((node, block, part.tobytes()))
        yield _rows(out, [pa.int32(), pa.int32(), pa.binary()], ["node", "block", "sums"])


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def best_split(gradient: np.ndarray, hessian: np.ndarray, penalty: float, least_weight: float) -> tuple:
    """(gain, column, bin, missing left, left sums, all sums) of sums by column and bin."""
    g, h = gradient[0].sum(), hessian[0].sum()
    own = g * g / (h + penalty)
    best = (0.0, -1, -1, True, 0.0, 0.0, g, h)
    for missing_left in (True, False):
        left_g, left_h = np.cumsum(gradient[:, :MISSING], axis=1), np.cumsum(hessian[:, :MISSING], axis=1)
        if missing_left:
            left_g, left_h = left_g + gradient[:, MISSING:], left_h + hessian[:, MISSING:]
        right_g, right_h = g - left_g, h - left_h
        fit = (left_h >= least_weight) & (right_h >= least_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fit, left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - own, -np.inf)
        at = int(gain.argmax())
        column, cut = divmod(at, MISSING)
        if gain[column, cut] > best[0]:
            best = (float(gain[column, cut]), column, cut, missing_left, float(left_g[column, cut]), float(left_h[column, cut]), g, h)
    return best


def _best(penalty: float, least_weight: float) -> Callable:
    names = ["node", "block", "gain", "column", "bin", "missing_left", "left_g", "left_h", "g", "h", "losses"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 4, pa.list_(pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []

        def close() -> None:
            if key is None:
                return
            if key[0] < 0:
                out.append((*key, 0.0, -1, -1, True, 0.0, 0.0, 0.0, 0.0, held.tolist()))
                return
            g, h = held.reshape(2, -1, 256)
            out.append((*key, *best_split(g, h, penalty, least_weight), None))

        for batch in batches:
            for node, block, data in zip(*[c.to_pylist() for c in batch.columns]):
                own = np.frombuffer(data)
                if (node, block) == key:
                    held = held + own
                else:
                    close()
                    key, held = (node, block), own
        close()
        yield _rows(out, kinds, names)

    return run


_SPLIT = ("node int, block int, gain double, column int, bin int, missing_left boolean, left_g double, left_h double, "
          "g double, h double, losses array<double>")


def fit_second_order(
    train: DataFrame, target_type: str, params: Mapping[str, Any] | None = None, seed: int = 42,
    vector: str = "feature_vector", validation: DataFrame | None = None,
    stop: Callable[[list[float]], bool] | None = None, groups: int = 1,
) -> tuple[BoostedTrees, list[tuple[int, float, float | None]]]:
    """A model and (round, train loss, validation loss), the losses squared errors or log losses.

    ``stop`` looks at the validation losses so far after each round. Parameters: n_estimators,
    learning_rate, max_depth, subsample (rows per tree), colsample_bytree, reg_lambda (penalty
    on squared leaves), min_child_weight (least Hessian sum of a child), max_bins. Missing values
    go where they gain more. Splits of no gain are not made. Ties go to the first column and bin.
    A vector may be ``groups`` rows of the same features end to end; bins are then cut by the last row.
    """
    p = {**DEFAULTS, **(params or {})}
    if not 2 <= p["max_bins"] <= MISSING:
        raise ValueError(f"2 to {MISSING} bins")
    penalty, rate = float(p["reg_lambda"]), float(p["learning_rate"])
    frames = [train.withColumn("held", F.lit(False))] + ([validation.withColumn("held", F.lit(True))] if validation is not None else [])
    rows = None
    for frame in frames:
        own = frame.select(vector_to_array(vector).alias("x"), F.col("target").cast("double").alias("y"), "held")
        rows = own if rows is None else rows.unionByName(own)
    rows = materialize(rows, "boosting")
    start = rows.where("not held").agg(
        F.avg("y").alias("mean"), F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("rows")).first()
    if start["mean"] is None:
        raise ValueError("no rows to learn from")
    width = start["width"]
    tasks = -(-start["rows"] * width // CELLS_PER_TASK)
    base = float(start["mean"])
    if target_type == "classification":
        share = min(max(base, 1e-6), 1 - 1e-6)
        base = float(np.log(share / (1 - share)))
    each = width // groups
    last = rows.where("not held").select(F.slice("x", width - each + 1, each).alias("x")) if groups > 1 else rows.where("not held")
    cuts = quantile_cuts(last, "x", each, p["max_bins"]) * groups
    kind = "bins binary, y double, held boolean, draw long, margin double"
    state = materialize(rows.select("x", "y", "held", F.xxhash64("x", "y").alias("draw"), F.lit(base).alias("margin")).mapInArrow(
        _binned(cuts), kind).coalesce(tasks), "binned")

    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def summed(growing: _Growing) -> list:
        return (
            state.mapInArrow(growing.sums, "node int, block int, sums binary")
            .repartition(min(tasks, wide), "node", "block").sortWithinPartitions("node", "block")
            .mapInArrow(_best(penalty, p["min_child_weight"]), _SPLIT).collect()
        )

    trees: list[Tree] = []
    stored, history = 0, []
    empty = Tree(np.array([-1]), np.array([-1]), np.array([0.0]), np.array([-1]), np.array([True]), np.array([0.0]))

    def noted(found: list) -> bool:
        """Writes down the losses of the trees so far; whether to stop."""
        a, n, b, m = next(r["losses"] for r in found if r["node"] < 0)
        if trees:
            history.append((len(trees), a / max(n, 1), b / m if m else None))
        return bool(trees and m and stop and stop([x[2] for x in history]))

    for number in range(p["n_estimators"]):
        columns = tree_columns(seed, number, width, p["colsample_bytree"])
        tree, opened, ended = empty, [0], False
        sums: dict[int, tuple[float, float]] = {}
        for level in range(p["max_depth"]):
            place = np.full(len(tree.feature), -1)
            place[opened] = np.arange(len(opened))
            found = summed(_Growing(target_type, width, number, p["subsample"], tuple(trees[stored:]), tree, place, columns))
            if level == 0 and noted(found):
                ended = True
                break
            best: dict[int, Any] = {}
            for r in sorted((r for r in found if r["node"] >= 0), key=lambda r: (r["node"], r["block"])):
                if r["node"] not in best or r["gain"] > best[r["node"]]["gain"]:
                    best[r["node"]] = r
            cells = [x.tolist() for x in tree]
            feature, bin_, threshold, left, missing, value = cells
            following = []
            for k, node in enumerate(opened):
                r = best[k]
                sums[node] = (r["g"], r["h"])
                if r["gain"] <= LEAST_GAIN:
                    continue
                column = int(columns[r["block"] + r["column"]])
                if r["bin"] >= len(cuts[column]):
                    # all known values lie left; only missing ones part
                    limit = float("inf")
                else:
                    limit = float(cuts[column][r["bin"]])
                feature[node], bin_[node], threshold[node], left[node], missing[node] = (
                    column, r["bin"], limit, len(feature), r["missing_left"])
                for g, h in ((r["left_g"], r["left_h"]), (r["g"] - r["left_g"], r["h"] - r["left_h"])):
                    sums[len(feature)] = (g, h)
                    following.append(len(feature))
                    for cell, entry in zip(cells, (-1, -1, 0.0, -1, True, 0.0)):
                        cell.append(entry)
            kinds = (np.int64, np.int64, np.float64, np.int64, bool, np.float64)
            tree = Tree(*(np.array(c, t) for c, t in zip(cells, kinds)))
            opened = following
            if not opened:
                break
        if ended:
            break
        values = np.array([0.0 if f >= 0 else -sums[n][0] / (sums[n][1] + penalty) * rate if sums[n][1] + penalty > 0 else 0.0
                           for n, f in enumerate(tree.feature)])
        trees.append(tree._replace(value=values))
        if len(trees) - stored >= STORED_EVERY:
            state = materialize(state.mapInArrow(_advanced(tuple(trees[stored:]), width), kind), "binned")
            stored = len(trees)
    else:
        if trees:
            noted(summed(_Growing(target_type, width, 0, 0.0, tuple(trees[stored:]), empty, np.array([0]), columns[:1])))
    return BoostedTrees(base, target_type, tuple(trees)), history


def _advanced(trees: tuple[Tree, ...], width: int) -> Callable:
    """Rows with the scores of further trees added."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bins = _bins_of(batch.column(0), width)
            margin = batch.column(4).to_numpy(zero_copy_only=False).copy()
            for tree in trees:
                margin += tree.value[tree.leaves_of_bins(bins)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], schema=batch.schema)

    return run
