"""Evaluation metrics as aggregations, each for the whole table or per group.

Metrics that need the order of scores (AUC, ROC curve) never sort a table or a
group in one task. Rows are first counted per distinct score; score cuts taken
from quantiles split the order into buckets; sums inside a bucket come from a
window over that bucket, and sums over earlier buckets from the bucket totals.
A group with most of the rows is spread over the buckets like everything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import values as V
from cohortspark.session import stored

def score_cuts(df: DataFrame, score: str, buckets: int | None = None) -> list[float]:
    """At most `buckets - 1` cut points that divide the rows of `df` about evenly (one narrow scan).

    Meant for rows that are distinct in their score: then ties, however many, cannot
    draw several cuts to one place. By default there are four buckets per shuffle
    partition, so that a session set up for more data also splits the scores more finely.
    """
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(score, quantiles, 1 / (4 * buckets))))


def _with_bucket(df: DataFrame, score: str, cuts: Sequence[float]) -> DataFrame:
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0))
    edges = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=edges, inputCol=score, outputCol="_bucket").transform(df)


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per (group, distinct score)."""
    positive = F.col(label).cast("long")
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .select(*by, F.col(score).cast("double").alias("score"), positive.alias("_y"))
        .groupBy(*by, "score")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )


def _bucketed_counts(
    df: DataFrame, label: str, score: str, by: Sequence[str], cuts: Sequence[float] | None
) -> DataFrame:
    """Counts per (group, distinct score), stored so that the input is evaluated once, and the bucket of each."""
    counts = stored(_score_counts(df, label, score, by), "scores")
    return _with_bucket(counts, "score", score_cuts(counts, "score") if cuts is None else cuts)


def auc(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """ROC AUC: the share of (positive, negative) pairs in the right order, ties counting half.

    Per group: auc, n_pos, n_neg; auc is NULL where a class is missing.
    """
    by = list(by)
    counts = _bucketed_counts(df, label, score, by, cuts)
    inside = Window.partitionBy(*by, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    cells = (
        counts.withColumn("_wins", F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
        .groupBy(*by, "_bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_wins").alias("_wins"))
    )
    # at most one row per (group, bucket) from here on
    group = by or [F.lit(0)]
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(across), F.lit(0))
    cells = cells.withColumn("_wins", F.col("_wins") + F.col("pos").cast("double") * below)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return cells.groupBy(*by).agg(
        (F.sum("_wins") / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
    )


def roc_curve(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    prune: bool = False,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """ROC points from high to low threshold, with the point (0, 0) first (threshold NULL).

    With `prune`, a point is left out if the step into it equals the step out of
    it, since it then lies on the straight line between its neighbours; the first
    and last score of a group always stay.
    """
    by = list(by)
    counts = _bucketed_counts(df, label, score, by, cuts)
    step = F.struct("pos", "neg")

    cells = counts.groupBy(*by, "_bucket").agg(
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), F.max_by(step, "score").alias("_first")
    )
    group = by or [F.lit(0)]
    across = Window.partitionBy(*group).orderBy(F.col("_bucket").desc())
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    offsets = cells.select(
        *by,
        "_bucket",
        (F.sum("_pos").over(upto) - F.col("_pos")).alias("_pos_before"),
        (F.sum("_neg").over(upto) - F.col("_neg")).alias("_neg_before"),
        F.lead("_first").over(across).alias("_next_first"),
        F.sum("_pos").over(whole).alias("n_pos"),
        F.sum("_neg").over(whole).alias("n_neg"),
    )

    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col("score").desc())
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = (
        counts.withColumn("_tp", F.sum("pos").over(running))
        .withColumn("_fp", F.sum("neg").over(running))
        .withColumn("_next", F.lead(step).over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn("tp", F.col("_tp") + F.col("_pos_before"))
        .withColumn("fp", F.col("_fp") + F.col("_neg_before"))
        .withColumn("_next", F.coalesce("_next", "_next_first"))
    )
    if prune:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        points = points.where(first | F.col("_next").isNull() | (F.col("_next") != step))
    points = points.select(*by, F.col("score").alias("threshold"), "fp", "tp", "n_pos", "n_neg")
    origin = cells.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    zero = F.lit(0).cast("long")
    origin = origin.select(*by, F.lit(None).cast("double").alias("threshold"), zero.alias("fp"), zero.alias("tp"), "n_pos", "n_neg")
    return origin.unionAll(points).select(
        *by,
        "threshold",
        "fp",
        "tp",
        (F.col("fp") / F.nullif(F.col("n_neg").cast("double"), F.lit(0.0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("n_pos").cast("double"), F.lit(0.0))).alias("tpr"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(((F.col(label) == y) & (F.col(prediction) == p)).cast("long")), F.lit(0)).alias(name)
            for name, (y, p) in cells.items()
        ]
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def binary_rates(confusion: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity and the two error rates; NULL where a class is missing."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sensitivity, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return (
        confusion.withColumn("accuracy", _ratio(tp + tn, tn + fp + fn + tp))
        .withColumn("sensitivity", sensitivity)
        .withColumn("specificity", specificity)
        .withColumn("fnr", 1 - sensitivity)
        .withColumn("fpr", 1 - specificity)
    )


def precision_recall_f1(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class; an empty denominator gives 0."""
    fp, fn, tp = (F.col(c) for c in ("fp", "fn", "tp"))
    zero = F.lit(0.0)
    return (
        confusion.withColumn("precision", F.coalesce(_ratio(tp, tp + fp), zero))
        .withColumn("recall", F.coalesce(_ratio(tp, tp + fn), zero))
        .withColumn("f1", F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), zero))
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted average."""
    cm = confusion_matrix(df, label, prediction)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)

    def scores(hit: Column, extra: Column, missed: Column) -> list[Column]:
        return [
            F.coalesce(_ratio(hit, hit + extra), zero),
            F.coalesce(_ratio(hit, hit + missed), zero),
            F.coalesce(_ratio(2 * hit, 2 * hit + extra + missed), zero),
        ]

    n_neg, n_pos, n = tn + fp, fn + tp, tn + fp + fn + tp
    negative, positive = scores(tn, fn, fp), scores(tp, fp, fn)
    accuracy = _ratio(tp + tn, n)
    macro = [(a + b) / 2.0 for a, b in zip(negative, positive)]
    weighted = [_ratio(a * n_neg + b * n_pos, n) for a, b in zip(negative, positive)]
    none = F.lit(None).cast("double")
    lines = [
        ("Non-Targetable", negative, n_neg),
        ("Targetable", positive, n_pos),
        ("accuracy", [none, none, accuracy], n),
        ("macro avg", macro, n),
        ("weighted avg", weighted, n),
    ]
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(name).alias("class"),
            V.round_even(p, 4).alias("precision"),
            V.round_even(r, 4).alias("recall"),
            V.round_even(f, 4).alias("f1"),
            support.alias("support"),
        )
        for i, (name, (p, r, f), support) in enumerate(lines)
    ]
    return cm.select(F.inline(F.array(*rows)))


def prediction_table(
    df: DataFrame, id_col: str, label: str, probability: str, predicted: Column | None = None
) -> DataFrame:
    """One row per patient: true label, predicted class text, rounded confidence, correct or not."""
    hard = (F.col(probability) > 0.5).cast("int") if predicted is None else predicted.cast("int")
    return df.select(
        F.col(id_col).alias("Patient_ID"),
        F.col(label).cast("int").alias("True_Label"),
        hard.alias("Predicted"),
        F.when(hard == 1, C.PREDICTED_POSITIVE).otherwise(C.PREDICTED_NEGATIVE).alias("Predicted_Class"),
        F.col(probability).alias("Probability"),
        V.round_even(F.col(probability), 4).alias("Confidence_Score"),
        (F.col(label) == hard).alias("Correct"),
    )


def soft_vote(scores: DataFrame, id_col: str, label: str, score: str) -> DataFrame:
    """Mean probability per id over long-form model scores."""
    return scores.groupBy(id_col, label).agg(F.avg(score).alias(score))


def ensemble_comparison(a: DataFrame, b: DataFrame, id_col: str, label: str, score: str, names: Sequence[str]) -> DataFrame:
    """AUC of two models and of their mean probability, on the ids both have scored."""
    both = a.select(id_col, label, F.col(score).alias("_a")).join(b.select(id_col, F.col(score).alias("_b")), id_col)
    mean = (F.col("_a") + F.col("_b")) / 2.0
    long = both.select(
        label,
        F.inline(
            F.array(
                F.struct(F.lit(names[0]).alias("Model"), F.col("_a").alias("p")),
                F.struct(F.lit(names[1]).alias("Model"), F.col("_b").alias("p")),
                F.struct(F.lit("Ensemble (avg)").alias("Model"), mean.alias("p")),
            )
        ),
    )
    return auc(long, label, "p", by=["Model"]).select("Model", V.round_even(F.col("auc"), 4).alias("AUC"))


def model_delta(base: DataFrame, other: DataFrame, key: str = "Model", score: str = "Test_AUC") -> DataFrame:
    """For every model of `other` the base score, its own, the difference and the winner."""
    joined = other.select(key, F.col(score).alias("BERT_AUC")).join(
        base.select(key, F.col(score).alias("TF-IDF_AUC")), key, "left"
    )
    delta = V.round_even(F.col("BERT_AUC") - F.col("`TF-IDF_AUC`"), 4)
    winner = F.when(F.col("Delta") > 0, "BERT").when(F.col("Delta") < 0, "TF-IDF").otherwise("TIE")
    return joined.withColumn("Delta", delta).withColumn("Winner", winner).select(
        key, "TF-IDF_AUC", "BERT_AUC", "Delta", "Winner"
    )


def model_selection(results: DataFrame) -> DataFrame:
    """Best model by test AUC, runner-up, and how well the best one generalises."""
    top = results.orderBy(F.col("Test_AUC").desc_nulls_last(), F.col("Model")).limit(2)
    ranked = top.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("Test_AUC").desc_nulls_last(), "Model"))
    )
    gap = F.col("Train_AUC") - F.col("Test_AUC")
    tier = F.when(gap > 0.10, "overfitting").when(gap > 0.05, "slight overfitting").otherwise("good generalization")
    return ranked.select(
        "rank",
        F.when(F.col("rank") == 1, "best").otherwise("runner-up").alias("role"),
        "Model",
        "Train_AUC",
        "Test_AUC",
        gap.alias("gap"),
        tier.alias("tier"),
    )
