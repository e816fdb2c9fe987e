"""Quality scores by co-training a content view and a metadata view.

Two logistic models look at a page from different sides: one at its text, one at what is known
about it. Over some rounds each labels pages it is sure of for the other to learn from. Both are
calibrated on labels kept back, and their log-odds are added to score every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import fresh, materialize

#: Lower, upper, digit, space, line feed, sentence mark, other mark, anything else.
CLASSES = 8
CONTENT, LANGS, SOURCES = CLASSES * CLASSES + 8, 16, 64
METADATA = 3 + LANGS + SOURCES
#: Newton steps of a round at most, and the largest move of a weight that ends them sooner.
NEWTON_STEPS, NEWTON_MOVE = 12, 1e-4
#: Cells of odds by which held rows are counted for calibration.
ODDS_LIMIT, ODDS_STEP = 40.0, 0.02
SCORES = "struct<content:double,metadata:double,score:double>"
_SCORES = pa.struct([("content", pa.float64()), ("metadata", pa.float64()), ("score", pa.float64())])


def _classes() -> np.ndarray:
    table = np.full(1 << 16, 7, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            table[code] = 1 if c.isupper() else 0
        elif c.isdigit():
            table[code] = 2
        elif c == "\n":
            table[code] = 4
        elif c.isspace():
            table[code] = 3
        elif c in ".,;:?'\"-()":
            table[code] = 5
        elif code < 128:
            table[code] = 6
    return table


_CLASS = _classes()


def content_features(text: str | None) -> np.ndarray:
    """Shares of neighbouring character classes and measures of words and repetition."""
    out = np.zeros(CONTENT)
    words = text.split() if text else []
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _CLASS[np.minimum(codes, 0xFFFF)].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    out[:-8] = np.sqrt(pairs / max(1, pairs.sum()))
    counts = Counter(words)
    lines = text.split("\n")
    n = len(words)
    out[-8:] = [
        np.log1p(n) / 10, len(counts) / n, (max(counts.values()) - 1) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / len(lines),
        len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0, min(len(text) / n, 40) / 40, 1.0,
    ]
    return out


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Length as recorded, language and source by hash; unknown values have places of their own."""
    out = np.zeros(METADATA)
    out[:3] = np.log1p(max(0, n_chars or 0)) / 10, n_chars is None, 1.0
    out[3 + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANGS - 1))] = 1.0
    out[3 + LANGS + (0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCES - 1))] = 1.0
    return out


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


@dataclass(frozen=True)
class QualityModel:
    """Weights and calibration (slope, offset) of both views and the log-odds of the prior."""

    content: np.ndarray
    metadata: np.ndarray
    content_line: tuple[float, float]
    metadata_line: tuple[float, float]
    prior: float

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of the views and of both together, which share one prior."""
        a = content @ self.content * self.content_line[0] + self.content_line[1]
        b = metadata @ self.metadata * self.metadata_line[0] + self.metadata_line[1]
        return chance(a), chance(b), chance(a + b - self.prior)


def newton_step(weights: np.ndarray, hessian: np.ndarray, gradient: np.ndarray, rows: float, ridge: float) -> np.ndarray:
    """The next weights of a ridge-penalised logistic model, from sums over its rows."""
    penalty = ridge * rows
    return weights + np.linalg.solve(hessian + penalty * np.eye(len(weights)), gradient - penalty * weights)


def calibrated(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Platt's line through counts of good and bad rows by their odds, on targets drawn in a little
    so that separable views stay finite."""
    odds = (np.arange(len(good)) + 0.5) * ODDS_STEP - ODDS_LIMIT
    x = np.column_stack([odds, np.ones(len(odds))])
    up, down = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    n, y = good + bad, good * up + bad * down
    line = np.zeros(2)
    for _ in range(50):
        p = chance(x @ line)
        following = newton_step(line, (x * (n * p * (1 - p))[:, None]).T @ x, x.T @ (y - n * p), n.sum(), 1e-6)
        done = np.abs(following - line).max() < 1e-8
        line = following
        if done:
            break
    return float(max(line[0], 0.0)), float(line[1])


@dataclass(frozen=True)
class Round:
    """What both views know when a round begins: weights and lines of the round before."""

    weights: tuple[np.ndarray, np.ndarray] | None
    lines: tuple[tuple[float, float], tuple[float, float]] | None
    sure: float

    def targets(self, views: tuple[np.ndarray, np.ndarray], label: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
        """For either view the rows' targets, NaN where it does not learn from a row.

        Labels of rows that are not held; for rows without one what the other view is sure of.
        """
        own = np.where(held, np.nan, label)
        if self.weights is None:
            return [own, own]
        taught = []
        for other in (1, 0):
            p = chance(views[other] @ self.weights[other] * self.lines[other][0] + self.lines[other][1])
            sure = np.where(p >= self.sure, 1.0, np.where(p <= 1 - self.sure, 0.0, np.nan))
            taught.append(np.where(np.isnan(label), sure, own))
        return taught


def _summed(step: Callable) -> Callable:
    """Sums of ``step`` over the batches of a task, as (place, value)."""
    schema = pa.schema([("place", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                views = tuple(batch.column(c).flatten().to_numpy().reshape(len(batch), -1).astype(np.float64)
                              for c in ("content", "metadata"))
                label, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "held"))
                found = step(views, label, held)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=schema)

    return run


def _newton_sums(now: list[np.ndarray], known: Round) -> Callable:
    """Hessian, gradient and number of rows of both views."""
    def step(views: tuple[np.ndarray, np.ndarray], label: np.ndarray, held: np.ndarray) -> np.ndarray:
        parts = []
        for x, target, weights in zip(views, known.targets(views, label, held), now):
            use = ~np.isnan(target)
            a, y = x[use], target[use]
            p = chance(a @ weights)
            parts += [((a * (p * (1 - p))[:, None]).T @ a).ravel(), a.T @ (y - p), [len(y)]]
        return np.concatenate(parts)

    return step


def _held_counts(weights: list[np.ndarray]) -> Callable:
    """Good and bad held rows by the odds of either view."""
    cells = int(2 * ODDS_LIMIT / ODDS_STEP)

    def step(views: tuple[np.ndarray, np.ndarray], label: np.ndarray, held: np.ndarray) -> np.ndarray:
        parts = []
        for x, w in zip(views, weights):
            at = np.clip((x @ w + ODDS_LIMIT) / ODDS_STEP, 0, cells - 1).astype(np.int64)
            parts += [np.bincount(at[held & (label == y)], minlength=cells) for y in (1.0, 0.0)]
        return np.concatenate(parts).astype(np.float64)

    return step


def co_train(rows: DataFrame, rounds: int = 3, sure: float = 0.97, ridge: float = 1e-3) -> QualityModel | None:
    """Both views' models from stored rows (content, metadata, label, held); the label is NaN where there is none.

    In each round a view labels all unlabelled rows that it is sure of, by its calibrated chance, for
    the other view only. Held rows calibrate and are never trained on. Newton steps and
    calibrations are made from sums over all rows: some ten thousand numbers, added up in each task
    first. None without both classes among the rows to train on or those to calibrate on.
    """
    seen = {(r["held"], r["label"]): r["n"] for r in rows.where("not isnan(label)").groupBy("held", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 4:
        return None
    widths = rows.select(F.size("content"), F.size("metadata")).first()

    def sums(step: Callable) -> np.ndarray:
        found = rows.mapInArrow(_summed(step), "place int, value double").groupBy("place").agg(F.sum("value").alias("v")).collect()
        return np.array([r["v"] for r in sorted(found, key=lambda r: r["place"])])

    weights = [np.zeros(k) for k in widths]
    known = Round(None, None, sure)
    for _ in range(rounds + 1):
        for _ in range(NEWTON_STEPS):
            found, at, following = sums(_newton_sums(weights, known)), 0, []
            for w in weights:
                k = len(w)
                following.append(newton_step(
                    w, found[at : at + k * k].reshape(k, k), found[at + k * k : at + k * k + k], found[at + k * k + k], ridge))
                at += k * k + k + 1
            moved = max(float(np.abs(a - b).max()) for a, b in zip(following, weights))
            weights = following
            if moved < NEWTON_MOVE:
                break
        lines = tuple(calibrated(*view) for view in sums(_held_counts(weights)).reshape(2, 2, -1))
        known = Round(tuple(weights), lines, sure)
    share = seen[False, 1.0], seen[False, 0.0]
    return QualityModel(weights[0], weights[1], lines[0], lines[1], float(np.log(share[0] / share[1])))


def _features(text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    @F.arrow_udf("struct<content:array<float>,metadata:array<float>>")
    def features(texts: pa.Array, langs: pa.Array, sources: pa.Array, lengths: pa.Array) -> pa.Array:
        rows = [{"content": content_features(t), "metadata": metadata_features(a, b, n)} for t, a, b, n in zip(
            texts.to_pylist(), langs.to_pylist(), sources.to_pylist(), lengths.to_pylist())]
        kind = pa.list_(pa.float32())
        return pa.array(rows, pa.struct([("content", kind), ("metadata", kind)]))

    return features(text, lang.cast("string"), source.cast("string"), n_chars.cast("long"))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", seed: int = 3) -> DataFrame:
    """Features of every document with a text and a key, its label (NaN without one), and whether it is held.

    A document with several labels counts as good if at least half of them say so; labels that are
    null or of no document count nothing. A quarter of the labelled documents is held, by a hash of the key.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).cast(docs.schema[key].dataType).alias("key")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    pool = docs.where(F.col("text").isNotNull() & F.col(key).isNotNull())
    features = pool.select(F.col(key).alias("key"), _features(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")).alias("f"))
    held = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(4)) == 0
    return features.join(marks, "key", "left").select(
        F.col("f.content").alias("content"), F.col("f.metadata").alias("metadata"),
        F.coalesce("label", F.lit(float("nan"))).alias("label"), (held & F.col("label").isNotNull()).alias("held"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> QualityModel | None:
    """A model from the whole texts of all documents: those with a label teach both views, and all others
    take part in the exchange. What reaches the driver are sums whose number depends on the features alone."""
    return co_train(materialize(training_rows(docs, labels, key), "quality-features"))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", out: str = "quality") -> DataFrame:
    """``docs`` with (content, metadata, score) of every whole text in ``out``.

    Chances that a document is good, from 0 to 1. Texts that are null or have no words score 0.
    Where labels don't show both classes there is no model, and all other documents score 1. A
    column called ``out`` is replaced; the columns ``text``, ``lang``, ``source`` and
    ``n_chars`` may hold nulls. Rows that repeat count as often as they are there and score alike; ties of labels
    are good; texts are read whole; no rows give no rows.
    """
    model = train(docs, labels, key)

    @F.arrow_udf(SCORES)
    def scores(texts: pa.Array, langs: pa.Array, sources: pa.Array, lengths: pa.Array) -> pa.Array:
        content = np.array([content_features(t) for t in texts.to_pylist()]).reshape(-1, CONTENT)
        metadata = np.array([metadata_features(*r) for r in zip(
            langs.to_pylist(), sources.to_pylist(), lengths.to_pylist())]).reshape(-1, METADATA)
        worded = content[:, -1] > 0
        a, b, c = model.score(content, metadata) if model else (np.ones(len(texts)),) * 3
        return pa.StructArray.from_arrays([pa.array(np.where(worded, x, 0.0)) for x in (a, b, c)], fields=list(_SCORES))

    return docs.withColumn(out, scores(
        F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The documents that score at least ``least``, columns unchanged."""
    out = fresh(docs, "quality")
    return score_quality(docs, labels, key, out).where(F.col(out)["score"] >= least).select(*docs.columns)
