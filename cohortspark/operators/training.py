"""Classifiers on Spark ML: training, cross-validation, per-gene and per-cohort models.

Frames that several fits read are expected to be stored or cached by the caller
(see `session.stored`). Linear models over the same features (folds, genes, cohorts) are
trained and scored side by side (`LinearFit`, see `linear`): a step of all of them is one
job. Loops on the driver run over forests and handed-in fits, never over rows; everything
measured comes back as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import values as V
from cohortspark.operators import metrics as M
from cohortspark.operators.aggregates import balanced_weights
from cohortspark.operators.dedup import ranked_limit
from cohortspark.operators.forest import StoredForest, fit_stored_forest, vector_width
from cohortspark.operators.huber import ModifiedHuberModel, fit_modified_huber, huber_objective
from cohortspark.operators.linear import Minimum, Objective, fit_columns, score_columns
from cohortspark.operators.splits import split_columns, stratified_folds, stratified_split
from cohortspark.session import scratch_path, stored

Fit = Callable[[DataFrame], object]


#: Rows, and rows x features, up to which a forest is grown by Spark's own trainer.
FOREST_ROWS, FOREST_CELLS = 1 << 12, 1 << 24


def _class_weights(train: DataFrame, label: str) -> tuple[dict, int]:
    """The balanced weight per class, and the number of rows."""
    classes = balanced_weights(train, label).limit(3).collect()
    if len(classes) > 2:
        raise ValueError(f"{label} has more than two classes")
    return {row[label]: row.weight for row in classes}, sum(row.n_class for row in classes)


def _weighted(train: DataFrame, label: str, features: str) -> tuple[DataFrame, int]:
    """The rows with their balanced class weight, and how many there are.

    The fits are binary: the two weights come to the driver and go back as a constant
    map, so that no iteration of a fit repeats a join.
    """
    weights, total = _class_weights(train, label)
    return train.select(label, features, V.value_map(F.col(label), weights).alias("weight")), total


def fit_logistic(train: DataFrame, label: str = "label", features: str = "features", c: float = 1.0, max_iter: int = 1000):
    """L2 logistic regression with balanced class weights and inverse regularisation strength c."""
    weighted, total = _weighted(train, label, features)  # balanced weights sum to the number of rows
    return LogisticRegression(
        labelCol=label,
        featuresCol=features,
        weightCol="weight",
        regParam=1.0 / (c * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
    ).fit(weighted)


def fit_forest(
    train: DataFrame,
    label: str = "label",
    features: str = "features",
    num_trees: int = 300,
    max_depth: int = 30,
    seed: int = C.SEED,
):
    """Random forest with balanced class weights.

    Spark's trainer keeps the nodes of all trees on the driver, an integer per row and feature, and a histogram of all bins
    per node. It grows small forests only (`FOREST_ROWS`, `FOREST_CELLS`); beyond, trees are grown by the same rules in one
    task each and stored (see `forest`). They draw other random numbers, as Spark's own trees do when rows are dealt otherwise.
    Of Spark's trainer rows keep the node they are at in every tree: deep trees take many passes, and
    without that each pass would send all trees to all tasks and walk them from the root again. The trees are the same.
    """
    weights, total = _class_weights(train, label)
    if total > FOREST_ROWS or total * vector_width(train, features) > FOREST_CELLS:
        return fit_stored_forest(train, weights, total, label, features, num_trees, max_depth, seed)
    weighted, _ = _weighted(train, label, features)
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # else the lineage of the kept nodes grows with every pass
        context.setCheckpointDir(scratch_path(train.sparkSession, "forest"))
    return RandomForestClassifier(
        labelCol=label,
        featuresCol=features,
        weightCol="weight",
        numTrees=num_trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        cacheNodeIds=True,
        seed=seed,
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_prediction",
    ).fit(weighted)


def fit_huber(train: DataFrame, label: str = "label", features: str = "features", **options) -> ModifiedHuberModel:
    """Modified Huber classifier with balanced class weights; every iteration reads the rows once."""
    weighted, _ = _weighted(train, label, features)
    return fit_modified_huber(weighted, label, features, weight="weight", **options)


@dataclass(frozen=True)
class LinearFit:
    """A linear fit with balanced class weights that can also be trained side by side with others.

    Called with rows it is `fit_logistic` or `fit_huber`; its objective is that of the same classifier.
    """

    loss: str = "logistic"
    max_iter: int = 1000

    def __call__(self, train: DataFrame):
        return {"logistic": fit_logistic, "huber": fit_huber}[self.loss](train, max_iter=self.max_iter)

    @property
    def objective(self) -> Objective:
        if self.loss == "huber":
            return huber_objective(max_iter=self.max_iter)
        return Objective("logistic", None, 0.0, self.max_iter, tolerance=1e-9, flat=1e-6)

    def model(self, found: Minimum):
        return ModifiedHuberModel.of(found) if self.loss == "huber" else _logistic_model(found)


def _logistic_model(found: Minimum) -> LogisticRegressionModel:
    """The coefficients as the model `fit_logistic` returns."""
    model = LogisticRegressionModel._create_from_java_class(
        "org.apache.spark.ml.classification.LogisticRegressionModel",
        LogisticRegressionModel._randomUID(),
        Vectors.dense(found.coefficients),
        found.intercept,
    )
    return model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")


def fit_side_by_side(df: DataFrame, fits: Mapping[str, LinearFit], labels: str = "labels", features: str = "features") -> dict[str, Minimum]:
    """One minimum per name; entry i of the array `labels` is the label of a row for the i-th name, or NULL."""
    found = fit_columns(df, [fit.objective for fit in fits.values()], labels, features)
    return dict(zip(fits, found))


def score_side_by_side(
    df: DataFrame, fits: Mapping[str, LinearFit], found: Mapping[str, Minimum], labels: str = "labels", features: str = "features"
) -> DataFrame:
    """(name, label, probability, prediction) of the rows that have a label for a name."""
    names = list(found)
    scored = score_columns(df, names, [fits[n].loss for n in names], [found[n] for n in names], labels, features)
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def score_all(model, df: DataFrame, features: str = "features") -> DataFrame:
    """Replace the features by `probability` of the positive class and the hard `prediction` (> 0.5)."""
    if isinstance(model, ModifiedHuberModel):
        scored = model.transform(df, features, "probability").drop("decision")
    elif isinstance(model, StoredForest):
        scored = model.transform(df, features, "probability")
    else:
        scored = model.transform(df).withColumn("probability", vector_to_array("_probability")[1])
        scored = scored.drop("_probability", "_raw", "_prediction", features)
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def default_models(num_trees: int = 300, max_depth: int = 30, max_iter: int = 1000) -> dict[str, Fit]:
    return {
        "Logistic Regression": LinearFit("logistic", max_iter),
        "Random Forest": lambda train: fit_forest(train, num_trees=num_trees, max_depth=max_depth),
        "SGD Classifier": LinearFit("huber", max_iter),
    }


def in_parallel(tasks: Mapping[str, Callable[[], object]], threads: int = 3) -> dict[str, object]:
    """Run independent Spark jobs from a few driver threads."""
    with ThreadPoolExecutor(threads) as pool:
        futures = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: future.result() for name, future in futures.items()}


def fit_models(train: DataFrame, models: Mapping[str, Fit], threads: int = 3) -> dict[str, object]:
    """Fit every named model on the same frame."""
    return in_parallel({name: (lambda fit=fit: fit(train)) for name, fit in models.items()}, threads)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def cv_scores(df: DataFrame, id_col: str, models: Mapping[str, Fit], label: str = "label", k: int = C.CV_FOLDS, threads: int = 3) -> DataFrame:
    """Out-of-fold scores (Model, fold, label, probability) of every model.

    The folds of all linear fits are trained in the same passes; the other fits run one by one.
    """
    folds = stored(stratified_folds(df, id_col, label, k), "folds")
    linear = {name: fit for name, fit in models.items() if isinstance(fit, LinearFit)}
    fits = {
        (name, fold): (lambda fit=fit, fold=fold: fit(folds.where(F.col("fold") != fold)))
        for name, fit in models.items()
        if name not in linear
        for fold in range(k)
    }
    fitted = in_parallel(fits, threads)
    parts = [
        score_all(model, folds.where(F.col("fold") == fold)).select(
            F.lit(name).alias("Model"), "fold", label, "probability"
        )
        for (name, fold), model in fitted.items()
    ]
    if linear:
        parts.append(_fold_scores(folds, linear, label, k))
    return stored(union_all(parts), "cv-scores")


def _fold_scores(folds: DataFrame, linear: Mapping[str, LinearFit], label: str, k: int) -> DataFrame:
    """Out-of-fold scores of linear fits, each entry of the labels being a (model, fold)."""
    cells = {f"{i}:{fold}": (name, fit, fold) for i, (name, fit) in enumerate(linear.items()) for fold in range(k)}
    fits = {cell: fit for cell, (_, fit, _) in cells.items()}
    y, at = F.col(label).cast("int"), F.col("fold")
    inside = folds.select("features", F.array(*[F.when(at != fold, y) for _, _, fold in cells.values()]).alias("labels"))
    outside = folds.select("features", F.array(*[F.when(at == fold, y) for _, _, fold in cells.values()]).alias("labels"))
    scores = score_side_by_side(outside, fits, fit_side_by_side(inside, fits))
    cell = F.split("name", ":")
    return scores.select(
        V.value_map(cell[0], {str(i): name for i, name in enumerate(linear)}).alias("Model"),
        cell[1].cast("int").alias("fold"),
        F.col("label").alias(label),
        "probability",
    )


def cv_auc(df: DataFrame, id_col: str, models: Mapping[str, Fit], label: str = "label", k: int = C.CV_FOLDS) -> DataFrame:
    """Per model the mean and population standard deviation of the fold AUCs."""
    per_fold = M.auc(cv_scores(df, id_col, models, label, k), label, "probability", by=["Model", "fold"])
    return cv_summary(per_fold)


def cv_summary(per_fold: DataFrame) -> DataFrame:
    mean, std = F.avg("auc"), F.stddev_pop("auc")
    return per_fold.groupBy("Model").agg(
        V.round_even(mean, 4).alias("CV_AUC_mean"), V.round_even(std, 4).alias("CV_AUC_std")
    ).withColumn("CV_AUC", V.mean_std_text(F.col("CV_AUC_mean"), F.col("CV_AUC_std")))


def model_scores(fitted: Mapping[str, object], train: DataFrame, test: DataFrame, label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """(Model, side, *keep, label, probability, prediction) of every fitted model on both sides of a split, stored."""
    parts = [
        score_all(model, part).select(
            F.lit(name).alias("Model"), F.lit(side).alias("side"), *keep, label, "probability", "prediction"
        )
        for name, model in fitted.items()
        for side, part in (("train", train), ("test", test))
    ]
    return stored(union_all(parts), "model-scores")


def split_results(scores: DataFrame, label: str = "label") -> DataFrame:
    """One row per model of `model_scores`: train and test AUC, F1, precision and recall on the test part."""
    aucs = M.auc(scores, label, "probability", by=["Model", "side"])
    wide = aucs.groupBy("Model").agg(
        *[
            V.round_even(F.max(F.when(F.col("side") == side, F.col("auc"))), 4).alias(name)
            for side, name in (("train", "Train_AUC"), ("test", "Test_AUC"))
        ]
    )
    confusion = M.confusion_matrix(scores.where("side = 'test'"), label, "prediction", by=["Model"])
    rates = M.precision_recall_f1(confusion).select(
        "Model",
        V.round_even(F.col("f1"), 4).alias("F1_Targetable"),
        V.round_even(F.col("precision"), 4).alias("Precision"),
        V.round_even(F.col("recall"), 4).alias("Recall"),
    )
    return wide.join(rates, "Model")


def model_results(
    train: DataFrame, test: DataFrame, id_col: str, models: Mapping[str, Fit], label: str = "label", k: int = C.CV_FOLDS
) -> DataFrame:
    """One row per model: train, test and cross-validated AUC, F1, precision and recall on the test part."""
    results = split_results(model_scores(fit_models(train, models), train, test, label), label)
    return results.join(cv_auc(train, id_col, models, label, k), "Model").select(
        "Model", "Train_AUC", "Test_AUC", "CV_AUC_mean", "CV_AUC_std", "F1_Targetable", "Precision", "Recall", "CV_AUC"
    )


def feature_importance(model, vocab: DataFrame, k: int = 30) -> DataFrame:
    """The k strongest features of either sign for a linear model, the k most important ones for a forest.

    `vocab` has term and term_idx; the model's coefficients number as many.
    """
    spark = vocab.sparkSession
    linear = hasattr(model, "coefficients")
    values = model.coefficients if linear else model.featureImportances
    rows = [(i, float(v)) for i, v in enumerate(values.toArray() if hasattr(values, "toArray") else values)]
    named = spark.createDataFrame(rows, "term_idx int, value double").join(vocab.select("term_idx", "term"), "term_idx")
    value, term = F.col("value"), F.col("term")

    def top(order: Column, direction: str | None, digits: int) -> DataFrame:
        return ranked_limit(named, [order, term], k).select(
            F.lit(direction).cast("string").alias("direction"),
            "rank",
            term.alias("feature"),
            V.round_even(value, digits).alias("value"),
        )

    if linear:
        return top(value.desc(), "Targetable", 6).unionAll(top(value.asc(), "Non-Targetable", 6))
    return top(value.desc(), None, 8)


def gene_label_counts(df: DataFrame, flags: Mapping[str, Column], min_positives: int = C.MIN_GENE_POSITIVES) -> DataFrame:
    """Positives and negatives of every gene label from one pass, and whether it is worth a model."""
    sums = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias(f"_{i}") for i, flag in enumerate(flags.values())],
    )
    rows = [
        F.struct(
            F.lit(gene).alias("Gene"),
            F.col(f"_{i}").alias("N_Positive"),
            (F.col("_n") - F.col(f"_{i}")).alias("N_Negative"),
            (F.col(f"_{i}") >= min_positives).alias("eligible"),
        )
        for i, gene in enumerate(flags)
    ]
    return sums.select(F.inline(F.array(*rows)))


def _binary_scores(df: DataFrame, id_col: str, name: str, fit: Fit) -> tuple[object, DataFrame]:
    """Fit on the train side of the split of this label; scores of the test side."""
    sides = stored(stratified_split(df, id_col, "label"), "sides")
    model = fit(sides.where("split = 'train'").drop("split"))
    test = score_all(model, sides.where("split = 'test'").drop("split"))
    return model, test.select(F.lit(name).alias("name"), "label", "probability", "prediction")


def _fit_each(frames: Mapping[str, DataFrame], id_col: str, fit: Fit, threads: int) -> tuple[dict, DataFrame | None]:
    tasks = {name: (lambda n=name, d=frame: _binary_scores(d, id_col, n, fit)) for name, frame in frames.items()}
    done = in_parallel(tasks, threads)
    scores = stored(union_all([scores for _, scores in done.values()]), "test-scores") if done else None
    return {name: model for name, (model, _) in done.items()}, scores


def _fit_columns(df: DataFrame, id_col: str, flags: Mapping[str, Column], features: str, fit: LinearFit) -> tuple[dict, DataFrame | None]:
    """As `_fit_each`, all together: a row belongs to the models whose flag is not NULL."""
    if not flags:
        return {}, None
    fits = {name: fit for name in flags}
    labelled = df.select(
        id_col, F.col(features).alias("features"), F.array(*[flag.cast("int") for flag in flags.values()]).alias("labels")
    )
    sides = stored(split_columns(labelled, id_col, "labels", len(flags)), "sides")
    found = fit_side_by_side(sides, fits, "train")
    scores = stored(score_side_by_side(sides, fits, found, "test"), "test-scores")
    return {name: fit.model(minimum) for name, minimum in found.items()}, scores


def _scores_table(scores: DataFrame) -> DataFrame:
    aucs = M.auc(scores, "label", "probability", by=["name"]).select("name", V.round_even(F.col("auc"), 4).alias("AUC"))
    f1 = M.precision_recall_f1(M.confusion_matrix(scores, "label", "prediction", by=["name"]))
    return aucs.join(f1.select("name", V.round_even(F.col("f1"), 4).alias("F1")), "name")


def per_gene_models(
    df: DataFrame,
    id_col: str,
    flags: Mapping[str, Column],
    features: str = "features",
    fit: Fit = LinearFit("logistic"),
    threads: int = 8,
) -> tuple[dict[str, object], DataFrame]:
    """One balanced classifier per gene with enough positives, and (Gene, N_Positive, N_Negative, AUC, F1).

    A `LinearFit` trains all genes side by side; any other fit is called once per gene. Rows of which a
    flag is NULL are left out of the model of that gene.
    """
    counts = gene_label_counts(df, flags).where("eligible").drop("eligible")
    eligible = [row.Gene for row in counts.select("Gene").collect()]  # bounded by the gene list
    if isinstance(fit, LinearFit):
        models, scores = _fit_columns(df, id_col, {gene: flags[gene] for gene in eligible}, features, fit)
    else:
        frames = {
            gene: df.select(id_col, F.col(features).alias("features"), flags[gene].cast("int").alias("label")).where("label IS NOT NULL")
            for gene in eligible
        }
        models, scores = _fit_each(frames, id_col, fit, threads)
    if scores is None:
        return {}, counts.select("Gene", "N_Positive", "N_Negative", F.lit(None).cast("double").alias("AUC"), F.lit(None).cast("double").alias("F1"))
    table = counts.join(_scores_table(scores).withColumnRenamed("name", "Gene"), "Gene")
    return models, table.select("Gene", "N_Positive", "N_Negative", "AUC", "F1")


def cohort_eligibility(
    df: DataFrame,
    cohort: str,
    label: str,
    min_size: int = C.MIN_COHORT_MODEL_SIZE,
    min_class: int = C.MIN_COHORT_MODEL_CLASS,
) -> DataFrame:
    """Per cohort its size, positives and whether a model of its own is worth while."""
    positives = F.sum(F.col(label).cast("long"))
    counts = df.groupBy(cohort).agg(F.count(F.lit(1)).alias("N_Patients"), positives.alias("N_Tgt"))
    enough = (
        (F.col("N_Patients") >= min_size)
        & (F.col("N_Tgt") >= min_class)
        & (F.col("N_Patients") - F.col("N_Tgt") >= min_class)
    )
    return counts.withColumn("eligible", enough)


def per_cohort_models(
    df: DataFrame,
    id_col: str,
    cohort: str,
    label: str,
    cohorts: Sequence[str],
    features: str = "features",
    fit: Fit = LinearFit("logistic"),
    threads: int = 8,
) -> tuple[dict[str, object], DataFrame]:
    """One classifier for each listed cohort that is large enough, and (Cohort, N_Patients, N_Tgt, AUC).

    A `LinearFit` trains all cohorts side by side; any other fit is called once per cohort.
    """
    listed = df.where(F.col(cohort).isin(list(cohorts)))
    counts = cohort_eligibility(listed, cohort, label).where("eligible").drop("eligible").withColumnRenamed(cohort, "Cohort")
    eligible = [row.Cohort for row in counts.select("Cohort").collect()]  # bounded by the cohort list
    if isinstance(fit, LinearFit):
        flags = {name: F.when(F.col(cohort) == name, F.col(label).cast("int")) for name in eligible}
        models, scores = _fit_columns(listed.where(F.col(cohort).isin(eligible)), id_col, flags, features, fit)
    else:
        frames = {
            name: listed.where(F.col(cohort) == name).select(
                id_col, F.col(features).alias("features"), F.col(label).cast("int").alias("label")
            )
            for name in eligible
        }
        models, scores = _fit_each(frames, id_col, fit, threads)
    if scores is None:
        return {}, counts.withColumn("AUC", F.lit(None).cast("double"))
    aucs = _scores_table(scores).select(F.col("name").alias("Cohort"), "AUC")
    return models, counts.join(aucs, "Cohort").select("Cohort", "N_Patients", "N_Tgt", "AUC")
