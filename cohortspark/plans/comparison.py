"""Feature sets compared: the same models on the same split, the difference per model, and the winners averaged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import metrics as M
from cohortspark.operators import training as T
from cohortspark.plans.align import check_invariants
from cohortspark.session import stored


@dataclass(frozen=True)
class Side:
    """What training on one feature set gave: a row per model, the name of the best one, that model, its test scores."""

    name: str
    results: DataFrame
    best: str
    model: object
    scores: DataFrame


def train_side(name: str, data: DataFrame, id_col: str, models: Mapping[str, T.Fit], label: str = "label") -> Side:
    """Fit every model on the train side of `data` (id, label, features, split) and measure it on both.

    The best model has the highest rounded test AUC, ties by name. All its scores are stored once and
    serve the table of results as well as the ensemble.
    """
    train, test = (data.where(F.col("split") == side).drop("split") for side in ("train", "test"))
    fitted = T.fit_models(train, models)
    scores = T.model_scores(fitted, train, test, label, keep=(id_col,))
    results = stored(T.split_results(scores, label), "results")
    best = M.model_selection(results).where("rank = 1").first().Model  # one row per model
    chosen = scores.where((F.col("Model") == best) & (F.col("side") == "test")).select(id_col, label, "probability")
    return Side(name, results, best, fitted[best], chosen)


@dataclass(frozen=True)
class Comparison:
    base: Side
    other: Side
    delta: DataFrame
    ensemble: DataFrame

    def summary(self) -> DataFrame:
        """Long form of both tables: every model on either set, then the winners and their mean."""
        models = self.delta.select(
            F.lit("models").alias("part"), "Model", "TF-IDF_AUC", "BERT_AUC", "Delta", "Winner", F.lit(None).cast("double").alias("AUC")
        )
        empty = [F.lit(None).cast("double").alias(c) for c in ("TF-IDF_AUC", "BERT_AUC", "Delta")]
        return models.unionByName(
            self.ensemble.select(F.lit("ensemble").alias("part"), "Model", *empty, F.lit(None).cast("string").alias("Winner"), "AUC")
        )


def compare(
    sides: Mapping[str, DataFrame], id_col: str, models: Mapping[str, Mapping[str, T.Fit]] | None = None, label: str = "label"
) -> Comparison:
    """Train on two feature sets, the base one first, and compare.

    Both tables must hold the same ids on the same side of the split; anything else raises. A model that
    only the second set has is listed with a missing base.
    """
    (base_name, base_data), (other_name, other_data) = sides.items()
    for side in ("train", "test"):
        check_invariants(*(d.where(F.col("split") == side).select(id_col) for d in (base_data, other_data)), id_col)
    chosen = models or {name: T.default_models() for name in sides}
    base, other = (train_side(name, data, id_col, chosen[name], label) for name, data in sides.items())
    names = tuple(f"{side.name} ({side.best})" for side in (base, other))
    ensemble = M.ensemble_comparison(base.scores, other.scores, id_col, label, "probability", names)
    return Comparison(base, other, M.model_delta(base.results, other.results), ensemble)
