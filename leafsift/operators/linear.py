"""Sparse linear models: fit, store, score.

A model is a table ``(model, idx, weight)``; ``idx = -1`` holds the intercept. Its
size is bounded by the hash width, which makes it safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.operators.encoding import WIDTH
from leafsift.session import cut

MODEL_SCHEMA = "model string, idx int, weight double"
INTERCEPT = -1


# ---------------------------------------------------------------- scoring


def decision_values(rows: DataFrame, model: DataFrame, digits: int = 9) -> DataFrame:
    """``rows`` with ``score`` for their ``entries``: weights times values, plus the intercept.

    The weights are one array of WIDTH numbers, read once as a scalar, and the product is taken inside the
    row: nothing is shuffled. Rounded so that equal rows score equally whatever their entries' order.
    """
    spark = rows.sparkSession
    summed = model.groupBy("idx").agg(F.sum("weight").alias("weight"))  # at most WIDTH rows and the intercept
    slots = spark.range(WIDTH).select(F.col("id").cast("int").alias("idx"))
    filled = slots.join(summed, "idx", "left").select("idx", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weights = filled.agg(F.sort_array(F.collect_list(F.struct("idx", "weight")))["weight"].alias("w")).scalar()
    intercept = summed.filter(F.col("idx") == INTERCEPT).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).scalar()
    product = F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.get("_weights", e["idx"]), F.lit(0.0)))
    scored = rows.withColumn("_weights", weights).withColumn("score", F.round(product + intercept, digits))
    return scored.drop("entries", "_weights")


def predicted_class(score: Column) -> Column:
    return F.when(score > 0, 1).otherwise(-1)


def accuracy(scored: DataFrame) -> DataFrame:
    """Sample count and share of rows whose predicted class is ``y``."""
    hit = (predicted_class(F.col("score")) == F.col("y")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def nonzero_weights(model: DataFrame) -> DataFrame:
    """Weights that are not zero, cut to three decimals toward zero."""
    kept = model.filter((F.col("idx") >= 0) & (F.abs("weight") > 0))
    return kept.select("idx", ((F.col("weight") * 1e3).cast("int") / 1e3).alias("weight"))


# ---------------------------------------------------------------- storage


def save_model(model: DataFrame, path: str) -> None:
    model.select("model", "idx", "weight").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    model = spark.read.schema(MODEL_SCHEMA).parquet(path)
    return model if name is None else model.filter(F.col("model") == name)


# ---------------------------------------------------------------- fitting
#
# Minimise |w|_1 + C * sum(weight * max(0, 1 - y * (w.x))^2) with the intercept as
# one more penalised feature. Each round solves a second-order model on a working
# set: the features that violate the optimality conditions most and the held ones,
# never more than ``working_size``. Spark computes losses, gradients and the
# working set's curvature; the driver holds w and one matrix of that fixed size.


@dataclass(frozen=True)
class FitResult:
    weights: np.ndarray
    rounds: int
    objective: float
    violation: float
    converged: bool
    first_violation: float = 1.0

    def to_frame(self, spark: SparkSession, name: str) -> DataFrame:
        last = len(self.weights) - 1
        rows = [(name, INTERCEPT if i == last else int(i), float(self.weights[i])) for i in np.flatnonzero(self.weights)]
        return spark.createDataFrame(rows, MODEL_SCHEMA)


def _rows(batch: pa.RecordBatch, width: int):
    """Arrow batch to labels, row weights and coordinate triples with the intercept added."""
    y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    weight = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    n = len(y)
    row = np.concatenate([np.repeat(np.arange(n), sizes), np.arange(n)])
    idx = np.concatenate([lists.flatten().to_numpy(), np.full(n, width)])
    val = np.concatenate([batch.column(3).flatten().to_numpy(), np.ones(n)])
    return y, weight, row, idx, val


def _slack(w, y, row, idx, val):
    margins = np.bincount(row, weights=w[idx] * val, minlength=len(y))
    return np.maximum(0.0, 1.0 - y * margins)


def _loss_map(candidates: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates))
        for batch in batches:
            y, weight, row, idx, val = _rows(batch, width)
            for k, w in enumerate(candidates):
                total[k] += np.sum(weight * _slack(w, y, row, idx, val) ** 2)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "loss": pa.array(total)})

    return run


def _gradient_map(w: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            y, weight, row, idx, val = _rows(batch, width)
            pull = weight * _slack(w, y, row, idx, val) * y
            total -= np.bincount(idx, weights=2 * pull[row] * val, minlength=width + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"idx": pa.array(at, pa.int32()), "g": pa.array(total[at])})

    return run


def _curvature_map(w: np.ndarray, working: np.ndarray, width: int, chunk: int = 2048):
    place = np.full(width + 1, -1)
    place[working] = np.arange(len(working))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(working)
        total = np.zeros((size, size))
        for batch in batches:
            y, weight, row, idx, val = _rows(batch, width)
            active = (_slack(w, y, row, idx, val) > 0) * weight
            keep = (place[idx] >= 0) & (active[row] > 0)
            row, at, val = row[keep], place[idx[keep]], val[keep]
            for start in range(0, len(y), chunk):
                here = (row >= start) & (row < start + chunk)
                dense = np.zeros((min(chunk, len(y) - start), size))
                np.add.at(dense, (row[here] - start, at[here]), val[here])
                total += 2 * dense.T @ (dense * active[start : start + chunk, None])
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "h": pa.array(total[i, j])}
        )

    return run


def _solve_model(w: np.ndarray, g: np.ndarray, h: np.ndarray, sweeps: int = 500, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent on  g.d + d'Hd/2 + |w + d|_1 ; returns d.

    Features that stand together in the same rows make sweeps slow, so the features held after some of them are solved at once.
    """
    d = np.zeros_like(w)
    hd = np.zeros_like(w)
    diagonal = np.maximum(np.diag(h), 1e-12)
    for sweep in range(sweeps):
        moved = 0.0
        for j in range(len(w)):
            slope = g[j] + hd[j]
            current = w[j] + d[j]
            target = current - slope / diagonal[j]
            target = np.sign(target) * max(0.0, abs(target) - 1.0 / diagonal[j])
            step = target - current
            if step:
                d[j] += step
                hd += step * h[:, j]
                moved = max(moved, diagonal[j] * step * step)
        if moved <= tol:
            break
        if sweep % 3 == 0:
            d = _solve_held(w, g, h, d)
            hd = h @ d
    return d


def _solve_held(w: np.ndarray, g: np.ndarray, h: np.ndarray, d: np.ndarray, most: int = 50) -> np.ndarray:
    """``d`` moved to the model's optimum over the features that ``w + d`` holds, as far as their signs stay; one that meets zero is let go."""
    d = d.copy()
    for _ in range(most):
        held = np.flatnonzero(w + d)
        if not len(held):
            break
        now, part = (w + d)[held], h[np.ix_(held, held)]
        pull = -(g[held] + h[held] @ d + np.sign(now))
        step = np.linalg.solve(part + np.diag(1e-9 * np.maximum(np.diag(part), 1e-12)), pull)
        turns = now * step < 0
        reach = np.full(len(held), np.inf)
        reach[turns] = -now[turns] / step[turns]
        share = min(1.0, reach.min())
        if not (pull @ step) * share - share * share * (step @ part @ step) / 2 > 0:
            break
        d[held] += share * step
        if share == 1:
            break
        out = held[reach.argmin()]
        d[out] = -w[out]
    return d


def _working_set(w: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """The features that violate most and those held, ``size`` at most; half of them are violators, if there are as many."""
    worst = np.argsort(-off, kind="stable")[:size]
    worst = worst[off[worst] > 0]
    held = np.flatnonzero(w)
    held = held[np.argsort(-off[held], kind="stable")]
    lead = worst[: max(size // 2, size - len(held))]
    return np.concatenate([lead, held[~np.isin(held, lead)][: size - len(lead)]])


def violations(w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How far each coordinate is from optimal: zero everywhere at the optimum."""
    return np.where(w == 0, np.maximum(0.0, np.abs(g) - 1.0), np.abs(g + np.sign(w)))


#: A violation at which the duality gap is small as well.
CLOSE = 1e-4


def fit_l1_svm(
    examples: DataFrame,
    c: float,
    width: int = WIDTH,
    tol: float = 1e-6,
    max_rounds: int = 200,
    working_size: int = 256,
    inexact: bool = False,
) -> FitResult:
    """Fit on ``examples(y, idx, value[, weight])``; ``weight`` counts repeats of a row.

    Converged when no coordinate violates the optimality conditions by more than
    ``tol`` times the first round's largest violation; up to ten more rounds then bring it
    below ``CLOSE`` if they can, as slopes are measured against a penalty of 1. A fit that stops before that
    raises an error, unless ``inexact`` asks for it as it is, marked as not converged.
    """
    weight = F.col("weight") if "weight" in examples.columns else F.lit(1)
    data = cut(
        examples.select(
            F.col("y").cast("double"), weight.cast("double").alias("weight"),
            F.col("idx").cast("array<int>"), F.col("value").cast("array<double>"),
        )
    )
    classes = {r["y"] for r in data.select(F.signum("y").alias("y")).distinct().limit(3).collect()}
    if classes != {-1.0, 1.0}:
        raise ValueError(f"need examples of both classes, got {sorted(classes)}")

    def losses(points: list[np.ndarray]) -> list[float]:
        rows = data.mapInArrow(_loss_map(np.array(points), width), "k int, loss double").groupBy("k").sum("loss").collect()
        by_point = dict(map(tuple, rows))
        return [c * by_point[k] + float(np.abs(p).sum()) for k, p in enumerate(points)]

    def gradient(w: np.ndarray) -> np.ndarray:
        g = np.zeros(width + 1)
        for row in data.mapInArrow(_gradient_map(w, width), "idx int, g double").groupBy("idx").sum("g").collect():
            g[row[0]] = c * row[1]
        return g

    def curvature(w: np.ndarray, working: np.ndarray) -> np.ndarray:
        h = np.zeros((len(working), len(working)))
        parts = data.mapInArrow(_curvature_map(w, working, width), "i int, j int, h double")
        for i, j, value in parts.groupBy("i", "j").sum("h").collect():
            h[i, j] = h[j, i] = c * value
        return h

    w = np.zeros(width + 1)
    objective = losses([w])[0]
    first = worst = 0.0
    done, held = 0, []
    for done in range(max_rounds + 1):
        g = gradient(w)
        off = violations(w, g)
        worst = float(off.max())
        first = first or worst
        if worst <= tol * max(first, 1.0):
            held.append((worst, len(held), w, objective))
        if worst <= min(tol * max(first, 1.0), CLOSE) or len(held) > 10 or done == max_rounds:
            break
        working = _working_set(w, off, working_size)
        step = np.zeros(width + 1)
        step[working] = _solve_model(w[working], g[working], curvature(w, working))
        points = [w + step * 0.5**k for k in range(10)]
        values = losses(points)
        best = int(np.argmin(values))
        if values[best] >= objective - 1e-15 * max(1.0, abs(objective)):
            # the gain is below the objective's last digit: the conditions themselves still show it
            best = 0
            if violations(points[0], gradient(points[0])).max() >= worst:
                break
        w, objective = points[best], values[best]
    converged = bool(held)
    if converged:
        worst, _, w, objective = min(held)
    if not (converged or inexact):
        raise RuntimeError(f"not converged after {done} rounds: violation {worst:.3g}, asked for {tol * max(first, 1.0):.3g}")
    return FitResult(w, done, objective, worst, converged, first)


def duality_gap(examples: DataFrame, model: DataFrame, c: float) -> DataFrame:
    """``primal, dual, gap``: a bound on what any other weights could gain, from stored weights and ``examples(y, idx, value[, weight])`` alone.

    The dual of the fit is to maximise sum(a - a^2 / (4 C weight)) over a >= 0 with |sum(a y x)| <= 1 for every feature, the intercept among
    them. The slacks of the given weights, 2 C weight max(0, 1 - y w.x), scaled until they are feasible, are such a point, whatever the
    weights are; so no weights have an objective below ``dual``, and a gap of zero proves the optimum without the conditions the fit itself uses.
    """
    weight = F.col("weight") if "weight" in examples.columns else F.lit(1)
    rows = examples.select(
        F.col("y").cast("double").alias("y"), weight.cast("double").alias("n"),
        F.arrays_zip(F.col("idx").cast("array<int>").alias("idx"), F.col("value").cast("array<double>").alias("value")).alias("entries"),
    )
    scored = decision_values(rows.withColumn("kept", F.col("entries")), model, digits=15)
    slack = F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("score"))
    rows = scored.select("y", "n", "kept", slack.alias("slack"), (2 * c * F.col("n") * slack).alias("a"))
    # a^2 / (4 C weight) is C weight slack^2: the loss itself
    sums = rows.agg(F.coalesce(F.sum(c * F.col("n") * F.col("slack") * F.col("slack")), F.lit(0.0)).alias("loss"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"))
    ones = F.array(F.struct(F.lit(INTERCEPT).alias("idx"), F.lit(1.0).alias("value")))
    pulls = rows.select((F.col("a") * F.col("y")).alias("ay"), F.explode(F.concat("kept", ones)).alias("e"))
    pulls = pulls.groupBy("e.idx").agg(F.sum(F.col("ay") * F.col("e.value")).alias("pull")).agg(F.coalesce(F.max(F.abs("pull")), F.lit(0.0)).alias("steepest"))
    norm = model.agg(F.coalesce(F.sum(F.abs("weight")), F.lit(0.0)).alias("norm"))
    one = F.lit(1)  # three rows of one row each
    joined = sums.withColumn("_", one).join(pulls.withColumn("_", one), "_").join(norm.withColumn("_", one), "_")
    scale = F.when(F.col("loss") > 0, F.least(F.col("a") / (2 * F.col("loss")), 1 / F.greatest("steepest", F.lit(1e-300)))).otherwise(0.0)
    dual = scale * F.col("a") - scale * scale * F.col("loss")
    return joined.select((F.col("norm") + F.col("loss")).alias("primal"), dual.alias("dual"), (F.col("norm") + F.col("loss") - dual).alias("gap"))
