"""A recurrent temporal model: a fixed random cell over each window, and a trained readout.

The cell's weights are drawn once from a seed and never trained; its state after the last row of
a window says what the window was like, in order. The readout is linear in that state. Regression needs
the data once: sums of products of states and targets are added up per split, and every epoch of
conjugate gradients, with its training and validation loss, follows from those sums alone.
Classification takes one pass of such sums per Newton step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.operators.boosting import chance
from panelgrid.session import materialize

DEFAULTS = {"iterations": 25, "hidden": 64, "radius": 0.9, "input_scale": 1.0, "reg_param": 0.1}
History = list[tuple[int, float, float | None]]


@dataclass(frozen=True)
class Cell:
    """state = tanh(inputs x row + recurrence x state before), from zero."""

    inputs: np.ndarray
    recurrence: np.ndarray

    @staticmethod
    def drawn(width: int, hidden: int, radius: float, input_scale: float, seed: int) -> Cell:
        """Recurrence of a given spectral radius; inputs scaled so that a row of unit variance drives states of about unit size."""
        rng = np.random.default_rng(seed)
        recurrence = rng.standard_normal((hidden, hidden))
        size = np.abs(np.linalg.eigvals(recurrence)).max()
        return Cell(rng.standard_normal((width, hidden)) * input_scale / np.sqrt(width), recurrence * (radius / size))

    def states(self, windows: np.ndarray) -> np.ndarray:
        """States after the last row of windows (number, rows, width)."""
        state = np.zeros((len(windows), len(self.recurrence)))
        for step in range(windows.shape[1]):
            state = np.tanh(windows[:, step] @ self.inputs + state @ self.recurrence)
        return state


def _windows(rows: pa.Array) -> np.ndarray:
    """Lists of lists of one size as (number, rows, width); nulls as zero, the mean of scaled features."""
    if not len(rows):
        return np.zeros((0, 0, 0))
    lines = rows.flatten()
    flat = np.nan_to_num(lines.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
    return flat.reshape(len(rows), len(lines) // len(rows), -1)


@dataclass(frozen=True)
class RecurrentModel:
    """Cell and readout; the last weight is the offset."""

    cell: Cell
    weights: np.ndarray
    target_type: str

    def score(self, windows: Column) -> Column:
        """Predicted value, or chance of class 1, of a column of windows (array of feature rows)."""
        chances = self.target_type == "classification"

        @F.arrow_udf("double")
        def scores(rows: pa.Array) -> pa.Array:
            found = self.cell.states(_windows(rows)) if len(rows) else np.zeros((0, len(self.weights) - 1))
            margin = found @ self.weights[:-1] + self.weights[-1]
            return pa.array(chance(margin) if chances else margin)

        return scores(windows)

    def save(self, spark: SparkSession, folder: str) -> None:
        parts = {"inputs": self.cell.inputs, "recurrence": self.cell.recurrence, "weights": self.weights}
        rows = [(name, list(x.shape), x.ravel().tolist(), self.target_type) for name, x in parts.items()]
        spark.createDataFrame(rows, "part string, shape array<int>, data array<double>, target_type string").coalesce(
            1).write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> RecurrentModel:
        rows = {r["part"]: r for r in spark.read.parquet(folder).collect()}
        parts = {name: np.array(r["data"]).reshape(r["shape"]) for name, r in rows.items()}
        return RecurrentModel(Cell(parts["inputs"], parts["recurrence"]), parts["weights"], rows["weights"]["target_type"])


def _with_states(windows: DataFrame, cell: Cell) -> DataFrame:
    @F.arrow_udf("array<double>")
    def states(rows: pa.Array) -> pa.Array:
        found = cell.states(_windows(rows)) if len(rows) else []
        return pa.array(list(found), pa.list_(pa.float64()))

    return windows.select("split", F.col("target").cast("double").alias("y"), states("features").alias("state"))


def _summer(weights: np.ndarray | None) -> Callable:
    """Sums of one task as (split, place, value): products of [state, 1, y], or a Newton step's gradient and Hessian."""
    schema = pa.schema([("split", pa.string()), ("place", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            split = np.array(batch.column(0).to_pylist())
            y = batch.column(1).to_numpy(zero_copy_only=False)
            state = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x = np.column_stack([state, np.ones(len(y))])
            for name in np.unique(split):
                own = split == name
                a, b = x[own], y[own]
                if weights is None:
                    both = np.column_stack([a, b])
                    found = (both.T @ both).ravel()
                else:
                    p = chance(a @ weights)
                    loss = -np.log(np.where(b > 0.5, p, 1 - p)).sum()
                    found = np.concatenate([((a * (p * (1 - p))[:, None]).T @ a).ravel(), a.T @ (p - b), [loss, len(b)]])
                total[str(name)] = total.get(str(name), 0) + found
        for name, values in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(values)), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], schema=schema)

    return run


def _sums(states: DataFrame, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Sums over all rows of each split; their number depends on the hidden units alone."""
    rows = states.mapInArrow(_summer(weights), "split string, place int, value double").groupBy("split", "place").agg(
        F.sum("value").alias("value")).orderBy("split", "place").collect()
    out: dict[str, list[float]] = {}
    for r in rows:
        out.setdefault(r["split"], []).append(r["value"])
    return {name: np.array(values) for name, values in out.items()}


def conjugate_epochs(products: np.ndarray, ridge: float, epochs: int) -> Iterator[np.ndarray]:
    """Weights after each epoch of conjugate gradients on the ridge problem of (state, 1, y) products.

    The offset is not penalised. The last epochs repeat once the exact solution is reached.
    """
    size = len(products) - 1
    rows = products[size - 1, size - 1]
    penalty = np.full(size, ridge)
    penalty[-1] = 0.0
    a, b = products[:size, :size] / rows + np.diag(penalty), products[:size, -1] / rows
    weights = np.zeros(size)
    rest = b.copy()
    way, square = rest.copy(), rest @ rest
    for _ in range(epochs):
        if square > 1e-24 * max(1.0, b @ b):
            image = a @ way
            step = square / (way @ image)
            weights = weights + step * way
            rest = rest - step * image
            following = rest @ rest
            way, square = rest + following / square * way, following
        yield weights


def squared_loss(products: np.ndarray, weights: np.ndarray) -> float:
    """Mean squared error of the readout, from the products alone."""
    w = np.append(weights, -1.0)
    size = len(products) - 1
    return float(max(w @ products @ w, 0.0) / products[size - 1, size - 1])


def fit_recurrent(
    windows: DataFrame, target_type: str, params: Mapping[str, Any] | None = None, seed: int = 42,
    best: Callable[[list[float]], tuple[int, int]] | None = None,
) -> tuple[RecurrentModel, History]:
    """A model and its history from windows with ``split``, ``features`` and ``target``.

    ``best`` says from the validation losses how many epochs were run and which one is kept;
    without validation windows the last one is. The data is read once for regression.
    """
    p = {**DEFAULTS, **(params or {})}
    shape = windows.where("split = 'train'").select(F.size(F.col("features")[0]).alias("width")).first()
    if shape is None:
        raise ValueError("no windows to learn from")
    cell = Cell.drawn(shape["width"], p["hidden"], p["radius"], p["input_scale"], seed)
    states = materialize(_with_states(windows.where("split in ('train', 'val')"), cell), "states")
    size = p["hidden"] + 1
    tried: list[np.ndarray] = []
    history: History = []
    if target_type != "classification":
        products = {k: v.reshape(size + 1, size + 1) for k, v in _sums(states).items()}
        for epoch, weights in enumerate(conjugate_epochs(products["train"], p["reg_param"], p["iterations"]), 1):
            tried.append(weights)
            history.append((epoch, squared_loss(products["train"], weights),
                            squared_loss(products["val"], weights) if "val" in products else None))
    else:
        weights = np.zeros(size)
        found = _sums(states, weights)
        penalty = np.diag(np.append(np.full(size - 1, p["reg_param"]), 0.0))
        for epoch in range(1, p["iterations"] + 1):
            sums, rows = found["train"], found["train"][-1]
            hessian = sums[: size * size].reshape(size, size) / rows + penalty + 1e-9 * np.eye(size)
            gradient = sums[size * size : -2] / rows + penalty @ weights
            weights = weights - np.linalg.solve(hessian, gradient)
            found = _sums(states, weights)
            tried.append(weights)
            history.append((epoch, float(found["train"][-2] / found["train"][-1]),
                            float(found["val"][-2] / found["val"][-1]) if "val" in found else None))
            if best and "val" in found and best([h[2] for h in history])[0] < epoch:
                break
    kept = len(tried)
    if best and history[0][2] is not None:
        epochs, kept = best([h[2] for h in history])
        history = history[:epochs]
    return RecurrentModel(cell, tried[kept - 1], target_type), history
