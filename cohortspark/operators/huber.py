"""Linear classifier with modified Huber loss and elastic-net penalty.

Spark ML has no such loss. The fit is the one of `linear`, with a single model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.linear import Minimum, Objective, csr, fit_columns, huber_loss, huber_slope  # noqa: F401


def loss_column(margin):
    return F.when(margin >= 1, 0.0).when(margin >= -1, (1 - margin) * (1 - margin)).otherwise(-4 * margin)


def probability_column(decision):
    return (F.greatest(F.least(decision, F.lit(1.0)), F.lit(-1.0)) + 1) / 2


@dataclass(frozen=True)
class ModifiedHuberModel:
    coefficients: np.ndarray
    intercept: float
    objective: float
    iterations: int
    converged: bool = True

    @classmethod
    def of(cls, found: Minimum) -> "ModifiedHuberModel":
        return cls(found.coefficients, found.intercept, found.objective, found.passes, found.converged)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per non-zero coefficient, and the rest of the model under position -1."""
        used = np.flatnonzero(self.coefficients)
        rows = [(int(i), float(self.coefficients[i])) for i in used]
        rows += [(-1, self.intercept), (-2, float(len(self.coefficients))), (-3, float(self.objective))]
        rows += [(-4, float(self.iterations)), (-5, float(self.converged))]
        spark.createDataFrame(rows, "position int, value double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> "ModifiedHuberModel":
        spark = SparkSession.getActiveSession()
        found = {r.position: r.value for r in spark.read.parquet(path).collect()}  # bounded by the features
        coefficients = np.zeros(int(found[-2]))
        for i, value in found.items():
            if i >= 0:
                coefficients[i] = value
        return cls(coefficients, found[-1], found[-3], int(found[-4]), bool(found[-5]))

    def probability(self, features: Column) -> Column:
        """The probability as an expression of a dense vector column, for rows scored one by one."""
        weights = F.split(F.lit(",".join(map(repr, self.coefficients.tolist()))), ",").cast("array<double>")
        products = F.zip_with(vector_to_array(features), weights, lambda x, w: x * w)
        return probability_column(F.aggregate(products, F.lit(float(self.intercept)), lambda t, v: t + v))

    def transform(self, df: DataFrame, features: str = "features", probability: str = "probability") -> DataFrame:
        """Add the decision value and the probability (clip(f, -1, 1) + 1) / 2."""
        spark = df.sparkSession
        weights = spark.sparkContext.broadcast(self.coefficients)
        intercept = self.intercept
        columns = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, index, value = csr(batch, "_unwrapped")
                decision = np.bincount(rows, value * weights.value[index], batch.num_rows) + intercept
                kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(decision)], names=[*keep, "decision"])

        keep = [c for c in columns if c != features]
        source = df.select(*keep, F.unwrap_udt(features).alias("_unwrapped"))
        schema = df.select(*keep, F.lit(0.0).alias("decision")).schema
        return source.mapInArrow(run, schema).withColumn(probability, probability_column(F.col("decision")))


def huber_objective(
    alpha: float = 1e-4, l1_ratio: float = 0.15, max_iter: int = 1000, tolerance: float = 1e-4
) -> Objective:
    return Objective("huber", alpha * (1 - l1_ratio), alpha * l1_ratio, max_iter, tolerance)


def fit_modified_huber(
    df: DataFrame,
    label: str = "label",
    features: str = "features",
    weight: str | None = None,
    alpha: float = 1e-4,
    l1_ratio: float = 0.15,
    max_iter: int = 1000,
    tolerance: float = 1e-4,
) -> ModifiedHuberModel:
    """Minimise sum(w * loss) / sum(w) + alpha * (l1_ratio |b|_1 + (1 - l1_ratio) / 2 |b|^2).

    The intercept carries no penalty. Quasi-Newton steps on the driver, each a pass over the
    rows, until five in a row lower the objective by less than `tolerance` or nothing is left to
    descend. `converged` of the model tells whether that came within `max_iter` passes.
    `df` should be stored or cached.
    """
    row_weight = F.lit(1.0) if weight is None else F.col(weight)
    data = df.select(F.col(features).alias("features"), F.array(F.col(label).cast("int")).alias("labels"), row_weight.alias("w"))
    found = fit_columns(data, [huber_objective(alpha, l1_ratio, max_iter, tolerance)], weight="w", balanced=False)
    return ModifiedHuberModel.of(found[0])
