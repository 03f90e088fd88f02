"""Linear classifiers trained side by side: one pass over the rows serves a step of every model.

The models share the features and differ in their labels: each row has an array with one
entry per model, 1 or 0, or NULL where the row is not in the training set of that model (another
fold, another cohort, the test side). A pass computes all decisions as one product of the
rows and the matrix of points, and the gradients as one product back. Every partition adds up
its batches; the partial sums come to the driver if all of them together are few (`AT_ONCE`), and
are cut into chunks and added chunk by chunk behind a shuffle otherwise. The driver then moves
each model on its own quasi-Newton path. A model that has come to an end leaves
the matrix, so the rest cost less.

What the driver and a broadcast hold grows with models x features only, and `AT_ONCE` bounds
it: beyond that number of values, models are trained group after group.
"""

from __future__ import annotations

import logging
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Values (models x features) trained in one group, also the partial sums that are added without a shuffle; sums a chunk has.
AT_ONCE, CHUNK = 1 << 20, 1 << 15
#: Steps in a row without progress that end a fit.
STALLED = 5
#: Step lengths, after the first, that one pass tries together.
HALVINGS = (0.5, 0.25, 0.125)


@dataclass(frozen=True)
class Objective:
    """Mean of the weighted loss + lasso * |b|_1 + ridge / 2 * |b|^2, and when to stop.

    With `ridge` None, the ridge is 1 over the number of training rows. A fit ends when the
    subgradient is no longer than `flat` or `STALLED` steps in a row gain less than `tolerance`.
    """

    loss: str
    ridge: float | None = None
    lasso: float = 0.0
    max_iter: int = 1000
    tolerance: float = 1e-4
    flat: float = 1e-5


@dataclass(frozen=True)
class Minimum:
    coefficients: np.ndarray
    intercept: float
    objective: float
    passes: int
    converged: bool


def huber_loss(margin: np.ndarray) -> np.ndarray:
    """Loss at margin m = y * f(x): 0 from 1 up, (1 - m)^2 from -1 up, -4m below."""
    return np.where(margin >= 1, 0.0, np.where(margin >= -1, (1 - margin) ** 2, -4 * margin))


def huber_slope(margin: np.ndarray) -> np.ndarray:
    return np.where(margin >= 1, 0.0, np.where(margin >= -1, -2 * (1 - margin), -4.0))


def logistic_loss(margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, -margin)


def logistic_slope(margin: np.ndarray) -> np.ndarray:
    return -0.5 * (1.0 - np.tanh(margin / 2))


LOSSES = {"huber": (huber_loss, huber_slope), "logistic": (logistic_loss, logistic_slope)}


def probability(loss: str, decision: np.ndarray) -> np.ndarray:
    if loss == "logistic":
        return 0.5 * (1.0 + np.tanh(decision / 2))
    return (np.clip(decision, -1.0, 1.0) + 1.0) / 2


def csr(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column index and value of every stored entry of a vector column."""
    vectors = batch.column(batch.schema.get_field_index(name))
    kinds = vectors.field("type").to_numpy(zero_copy_only=False)
    values = vectors.field("values")
    lengths = np.diff(values.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if (kinds == 1).all():
        return rows, place, flat
    indices = vectors.field("indices")
    if (kinds == 0).all():
        return rows, indices.flatten().to_numpy(zero_copy_only=False), flat
    index = place.copy()
    index[(kinds == 0)[rows]] = indices.drop_null().flatten().to_numpy(zero_copy_only=False)
    return rows, index, flat


class _Rows:
    """The vectors of one batch, multiplied with many points from either side."""

    def __init__(self, batch: pa.RecordBatch, name: str, dim: int):
        self.n, self.dim = batch.num_rows, dim
        self.rows, self.index, self.value = csr(batch, name)
        self.dense = self.value.reshape(self.n, dim) if len(self.value) == self.n * dim else None

    def _entries(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if used.all():
            return self.rows, self.index, self.value
        inside = used[self.rows]
        return self.rows[inside], self.index[inside], self.value[inside]

    def times(self, points: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Rows x models from models x features; rows that a model does not use may stay 0."""
        if self.dense is not None:
            return self.dense @ points.T
        out = np.empty((self.n, len(points)))
        for j, point in enumerate(points):
            rows, index, value = self._entries(used[:, j])
            out[:, j] = np.bincount(rows, value * point[index], self.n)
        return out

    def back(self, pull: np.ndarray) -> np.ndarray:
        """Models x features from rows x models."""
        if self.dense is not None:
            return pull.T @ self.dense
        out = np.empty((pull.shape[1], self.dim))
        for j in range(pull.shape[1]):
            rows, index, value = self._entries(pull[:, j] != 0)
            out[j] = np.bincount(index, value * pull[rows, j], self.dim)
        return out


def _labels(batch: pa.RecordBatch, name: str, models: int) -> np.ndarray:
    entries = batch.column(batch.schema.get_field_index(name)).flatten()
    return entries.to_numpy(zero_copy_only=False).reshape(batch.num_rows, models)


def _entries(labels: str) -> Column:
    """One byte per model: 1, 0, or -1 outside of its rows."""
    return F.transform(labels, lambda y: F.coalesce(y.cast("tinyint"), F.lit(-1).cast("tinyint")))


def _losses_and_gradients(
    data: DataFrame,
    parts: int,
    dim: int,
    losses: Sequence[str],
    class_weights: np.ndarray,
    owner: np.ndarray,
    points: np.ndarray,
) -> np.ndarray:
    """Per point (of model `owner`): the slope along every feature and the intercept, and the loss, as sums over all rows."""
    spark = data.sparkSession
    width, models = dim + 2, len(class_weights)
    shared = spark.sparkContext.broadcast((owner, points, class_weights))
    places = {loss: np.flatnonzero([losses[i] == loss for i in owner]) for loss in set(losses)}

    def cut(sums: np.ndarray) -> pa.RecordBatch:
        flat = sums.ravel()
        chunks = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.list_(pa.float64()))], names=["chunk", "sums"]
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, points, class_weights = shared.value
        sums = np.zeros((len(points), width))
        for batch in batches:
            x, y = _Rows(batch, "x", dim), _labels(batch, "y", models)[:, owner]
            w = class_weights[owner, y] * batch.column(batch.schema.get_field_index("w")).to_numpy()[:, None]
            sign = 2.0 * y - 1.0
            margin = sign * (x.times(points[:, :dim], w != 0) + points[:, dim])
            lost, slope = np.empty_like(margin), np.empty_like(margin)
            for loss, at in places.items():
                of_margin, of_slope = LOSSES[loss]
                lost[:, at], slope[:, at] = of_margin(margin[:, at]), of_slope(margin[:, at])
            pull = w * sign * slope
            sums[:, :dim] += x.back(pull)
            sums[:, dim] += pull.sum(axis=0)
            sums[:, dim + 1] += (w * lost).sum(axis=0)
        yield cut(sums)

    def added(chunks: Sequence[int], arrays: Sequence[pa.ListScalar], totals: dict[int, np.ndarray]) -> None:
        for chunk, sums in zip(chunks, arrays):
            values = sums.values.to_numpy()
            totals[chunk] = totals[chunk] + values if chunk in totals else values

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            added(batch.column(0).to_pylist(), batch.column(1), totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))],
            names=["chunk", "sums"],
        )

    schema = "chunk int, sums array<double>"
    chunks = -(-len(points) * width // CHUNK)
    sums = data.mapInArrow(partial, schema)
    if parts * len(points) * width > AT_ONCE:
        tasks = min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        sums = sums.repartition(tasks, "chunk").mapInArrow(add, schema)
    table = sums.toArrow()
    shared.unpersist()
    found: dict[int, np.ndarray] = {}
    added(table["chunk"].to_pylist(), table["sums"], found)
    if not found:
        return np.zeros((len(points), width))
    return np.concatenate([found[i] for i in range(chunks)]).reshape(len(points), width)


Asked = list[np.ndarray]
Answers = list[tuple[float, np.ndarray]]


def descend(
    size: int, penalty: np.ndarray, max_passes: int, tolerance: float, flat: float, memory: int = 10
) -> Generator[Asked, Answers, tuple[np.ndarray, float, int, bool]]:
    """Minimise loss + penalty * |point| by quasi-Newton steps kept inside an orthant.

    Yields points and is sent the loss and gradient of each; so whoever drives it can
    evaluate many searches together. Returns the point, its objective, the passes, and
    whether the steps came to an end: a flat subgradient, or `STALLED` steps in a row that gained less
    than the tolerance.
    """

    def steepest(point: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """The subgradient of least length."""
        at_zero = np.sign(gradient) * np.maximum(np.abs(gradient) - penalty, 0.0)
        return np.where(point != 0, gradient + penalty * np.sign(point), at_zero)

    point = np.zeros(size)
    ((loss, gradient),) = yield [point]
    objective, passes, steps, stalled = loss + penalty @ np.abs(point), 1, [], 0
    while True:
        slope = steepest(point, gradient)
        if stalled >= STALLED or np.linalg.norm(slope) <= flat * max(1.0, np.linalg.norm(point)):
            return point, objective, passes, True
        direction, held = slope.copy(), []
        for s, y in reversed(steps):
            held.append((s @ direction) / (s @ y))
            direction -= held[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(held)):
            direction += (a - (y @ direction) / (s @ y)) * s
        direction = np.where(direction * slope > 0, -direction, 0.0)
        orthant = np.where(point != 0, np.sign(point), -np.sign(slope))
        step, lengths = 1.0 if steps else 1.0 / np.linalg.norm(slope), (1.0,)
        taken = None
        while taken is None:
            if passes >= max_passes:
                return point, objective, passes, False
            trials = [point + step * length * direction for length in lengths]
            trials = [np.where((t * orthant > 0) | (penalty == 0), t, 0.0) for t in trials]
            answers = yield trials
            passes += 1
            for moved, (loss, new_gradient) in zip(trials, answers):
                new_objective = loss + penalty @ np.abs(moved)
                if new_objective <= objective + 1e-4 * slope @ (moved - point):
                    taken = moved, new_gradient, new_objective
                    break
            if taken is None:
                step, lengths = step * lengths[-1], HALVINGS
                if step < 1e-12:
                    # no length lowers the objective any more: an end if rounding is all that is left
                    return point, objective, passes, bool(np.linalg.norm(slope) <= 10 * flat * max(1.0, np.linalg.norm(point)))
        moved, new_gradient, new_objective = taken
        s, y = moved - point, new_gradient - gradient
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[-memory + 1 :], (s, y)]
        stalled = stalled + 1 if objective - new_objective < tolerance else 0
        point, gradient, objective = moved, new_gradient, new_objective


def class_sums(df: DataFrame, labels: str, models: int, weight: Column) -> np.ndarray:
    """Models x (negative, positive) x (rows, weight); one row per model and class reaches the driver."""
    long = df.select(F.posexplode(labels).alias("model", "y"), weight.alias("w")).where("y IS NOT NULL")
    sums = np.zeros((models, 2, 2))
    for r in long.groupBy("model", F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect():
        if r.y not in (0, 1):
            raise ValueError("labels must be 0, 1 or NULL")
        sums[r.model, r.y] = r.n, r.w
    return sums


def fit_columns(
    df: DataFrame,
    objectives: Sequence[Objective],
    labels: str = "labels",
    features: str = "features",
    weight: str | None = None,
    balanced: bool = True,
) -> list[Minimum]:
    """One model per entry of the array `labels`, all trained together; `df` should be stored or cached.

    With `balanced`, a class weighs rows / (classes * rows of the class) in every model. A model without
    rows stays at zero. All vectors must have the same size.
    """
    row_weight = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    data = df.select(F.unwrap_udt(features).alias("x"), _entries(labels).alias("y"), row_weight.alias("w"))
    sums = class_sums(df, labels, len(objectives), row_weight)
    dim = data.agg(F.max(F.coalesce(F.col("x.size"), F.size("x.values")))).first()[0] or 0
    rows = sums[:, :, 0]
    class_weights = np.zeros((len(objectives), 3))  # the last entry is met by -1: outside
    class_weights[:, :2] = 1.0
    if balanced:
        present = np.maximum((rows > 0).sum(axis=1, keepdims=True), 1)
        class_weights[:, :2] = rows.sum(axis=1, keepdims=True) / (present * np.maximum(rows, 1))
    totals = (class_weights[:, :2] * sums[:, :, 1]).sum(axis=1)
    found: dict[int, Minimum] = {
        i: Minimum(np.zeros(dim), 0.0, 0.0, 0, True) for i in range(len(objectives)) if totals[i] == 0
    }
    todo = [i for i in range(len(objectives)) if i not in found]
    at_once, parts = max(1, AT_ONCE // (dim + 2)), data.rdd.getNumPartitions()
    ridges = [1.0 / max(n, 1) if o.ridge is None else o.ridge for o, n in zip(objectives, rows.sum(axis=1))]
    for start in range(0, len(todo), at_once):
        searches, asked = {}, {}
        for i in todo[start : start + at_once]:
            o = objectives[i]
            penalty = np.full(dim + 1, o.lasso)
            penalty[dim] = 0.0
            searches[i] = descend(dim + 1, penalty, o.max_iter, o.tolerance, o.flat)
            asked[i] = next(searches[i])
        while asked:
            owner = np.array([i for i, points in asked.items() for _ in points])
            points = np.stack([p for trial in asked.values() for p in trial])
            sums = _losses_and_gradients(data, parts, dim, [o.loss for o in objectives], class_weights, owner, points)
            ridge = np.array([ridges[i] for i in owner])
            gradients = sums[:, : dim + 1] / totals[owner, None]
            gradients[:, :dim] += ridge[:, None] * points[:, :dim]
            values = sums[:, dim + 1] / totals[owner] + ridge / 2 * (points[:, :dim] ** 2).sum(axis=1)
            at = 0
            for i, trial in list(asked.items()):
                answers = list(zip(values[at : at + len(trial)].tolist(), gradients[at : at + len(trial)]))
                at += len(trial)
                try:
                    asked[i] = searches[i].send(answers)
                except StopIteration as end:
                    point, value, passes, converged = end.value
                    found[i] = Minimum(point[:dim].copy(), float(point[dim]), float(value), passes, converged)
                    del asked[i], searches[i]
                    if not converged:
                        log.warning("model %d (%s) has not converged after %d passes", i, objectives[i].loss, passes)
    return [found[i] for i in range(len(objectives))]


def score_columns(
    df: DataFrame, names: Sequence[str], losses: Sequence[str], fits: Sequence[Minimum], labels: str = "labels", features: str = "features"
) -> DataFrame:
    """(name, label, probability) of every row and model whose entry in `labels` is not NULL, from one pass.

    The scored rows are not shuffled; models are applied in groups of at most `AT_ONCE` values.
    """
    spark = df.sparkSession
    dim = len(fits[0].coefficients)
    points = np.stack([np.append(f.coefficients, f.intercept) for f in fits])
    parts = []
    at_once = max(1, AT_ONCE // (dim + 1))
    for start in range(0, len(names), at_once):
        shared = spark.sparkContext.broadcast(points[start : start + at_once])
        of, kinds = np.array(names[start : start + at_once], dtype=object), losses[start : start + at_once]

        def run(batches, shared=shared, of=of, kinds=kinds, start=start):
            points = shared.value
            for batch in batches:
                y = _labels(batch, "y", len(names))[:, start : start + len(of)]
                decision = _Rows(batch, "x", dim).times(points[:, :dim], y >= 0) + points[:, dim]
                for j, kind in enumerate(kinds):
                    decision[:, j] = probability(kind, decision[:, j])
                row, model = np.nonzero(y >= 0)
                columns = [pa.array(of[model], pa.string()), pa.array(y[row, model].astype(np.int32)), pa.array(decision[row, model])]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "label", "probability"])

        source = df.select(F.unwrap_udt(features).alias("x"), _entries(labels).alias("y"))
        parts.append(source.mapInArrow(run, "name string, label int, probability double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
