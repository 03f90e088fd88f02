"""Training, per-gene and per-cohort models, importance, bundle and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.catalog.metrics import gene_flags
from cohortspark.catalog.registry import query
from cohortspark.catalog.views import quoted, sql_words, with_views
from cohortspark.operators import embedding as E
from cohortspark.operators import metrics as M
from cohortspark.operators import splits as S
from cohortspark.operators import tfidf as TI
from cohortspark.operators import training as T
from cohortspark.operators.linear import Minimum
from cohortspark.plans import comparison as CO
from cohortspark.plans import scoring as SC
from cohortspark.session import scratch_path, stored
from cohortspark.sources import checkpoints as K

def _split_vectors(spark, sf):
    data = W.vectors(spark, sf).select("vec_id", "features", "label", "targetable_genes")
    return stored(S.stratified_split(data, "vec_id", "label"), "vectors")


def _sides(df):
    return tuple(df.where(F.col("split") == side).drop("split") for side in ("train", "test"))


def _labels(spark, sf):
    return W.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))


def _labelled_tfidf(spark, sf, clean=None):
    """Labelled documents as TF-IDF vectors, stored, with the fitted model; `clean` are these documents, cleaned and stored."""
    labels = _labels(spark, sf)
    labelled = (clean or W.stored_clean_documents(spark, sf, labels)).join(labels, "doc_id")
    model = TI.fit_tfidf(labelled, "clean_text")
    return model, model.stored_vectors(labelled, "clean_text")


@query("train_logistic")
def train_logistic(spark, sf):
    """Coefficients of the classifier on the vectors."""
    train, _ = _sides(_split_vectors(spark, sf))
    model = T.fit_logistic(train)
    rows = [(i, float(v)) for i, v in enumerate([*model.coefficients.toArray(), model.intercept])]
    return spark.createDataFrame(rows, "position int, coefficient double")


@query(
    "logistic_optimum",
    with_views(
        f"""WITH n AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM v_vectors)
        SELECT unnest(range(65))::INTEGER AS position, true AS optimal,
          (p - ceil(p * {C.TEST_FRACTION}::DOUBLE))::BIGINT AS n_pos, (q - ceil(q * {C.TEST_FRACTION}::DOUBLE))::BIGINT AS n_neg FROM n"""
    ),
)
def logistic_optimum(spark, sf):
    """Whether the objective is flat along every coefficient and the intercept, computed from the rows apart from the trainer."""
    train, _ = _sides(_split_vectors(spark, sf))
    model = T.fit_logistic(train)
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    x, y = vector_to_array("features"), F.col("label").cast("double")
    sizes = train.agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg"))
    margin = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda t, v: t + v)
    share = F.when(y == 1, 0.5 / F.col("n_pos")).otherwise(0.5 / F.col("n_neg"))  # balanced, adding up to one
    rows = train.crossJoin(F.broadcast(sizes)).select(
        x.alias("x"), "n_pos", "n_neg", (share * (1 / (1 + F.exp(-margin)) - y)).alias("pull")
    )
    dim = len(model.coefficients)
    slopes = [F.sum(F.col("pull") * F.col("x")[j]) for j in range(dim)] + [F.sum("pull")]
    totals = rows.agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.array(*slopes).alias("slopes"))
    penalty = F.array(*[F.lit(float(v)) for v in [*model.coefficients, 0.0]])  # over the number of rows, as c is 1
    long = totals.select("n_pos", "n_neg", F.posexplode(F.arrays_zip("slopes", penalty.alias("penalty"))).alias("position", "at"))
    flat = F.abs(F.col("at.slopes") + F.col("at.penalty") / (F.col("n_pos") + F.col("n_neg"))) < 1e-3
    return long.select("position", flat.alias("optimal"), "n_pos", "n_neg")


@query("train_forest")
def train_forest(spark, sf):
    """Test scores of the forest on the vectors."""
    train, test = _sides(_split_vectors(spark, sf))
    model = T.fit_forest(train)
    return T.score_all(model, test).select("vec_id", "label", "probability", "prediction")


@query("train_modified_huber")
def train_modified_huber(spark, sf):
    """Test scores of the Huber classifier on TF-IDF vectors."""
    _, vectors = _labelled_tfidf(spark, sf)
    train, test = _sides(S.stratified_split(vectors, "doc_id", "label"))
    model = T.fit_huber(stored(train, "train"))
    return T.score_all(model, test).select("doc_id", "label", "probability", "prediction")


@query(
    "score_all",
    with_views("SELECT vec_id, label, true AS in_range FROM v_vectors"),
)
def score_all(spark, sf):
    """A probability for every row, training rows included."""
    data = _split_vectors(spark, sf)
    train, _ = _sides(data)
    scored = T.score_all(T.fit_logistic(train), data.drop("split"))
    return scored.select("vec_id", "label", F.col("probability").between(0.0, 1.0).alias("in_range"))


def _fixed_coefficients(dim):
    return [((7 * j) % 11 - 5) / 10 for j in range(dim)]


_DECISION = "list_inner_product(embedding::DOUBLE[], [" + ", ".join(map(repr, _fixed_coefficients(64))) + "]::DOUBLE[]) + 0.1"


@query(
    "score_fixed_models",
    with_views(
        f"""WITH d AS (SELECT vec_id, label, {_DECISION} AS f FROM v_vectors),
        p AS (SELECT vec_id, label, 1 / (1 + exp(-f)) AS logistic, (greatest(least(f, 1.0), -1.0) + 1) / 2 AS huber FROM d)
        SELECT vec_id, label, round(logistic, 9) AS logistic, round(huber, 9) AS huber, (logistic > 0.5)::INTEGER AS hard_logistic,
          (huber > 0.5)::INTEGER AS hard_huber FROM p"""
    ),
)
def score_fixed_models(spark, sf):
    """Probabilities and hard predictions of both linear classifiers with given coefficients, for every row."""
    data = W.vectors(spark, sf).select("vec_id", "label", "features")
    given = Minimum(np.array(_fixed_coefficients(64)), 0.1, 0.0, 0, True)
    for loss in ("logistic", "huber"):
        data = T.score_all(T.LinearFit(loss).model(given), data.withColumn("_features", F.col("features")), "features").withColumnsRenamed(
            {"probability": loss, "prediction": f"hard_{loss}", "_features": "features"}
        )
    return data.drop("features").withColumns({loss: F.round(loss, 9) for loss in ("logistic", "huber")})


@query("cv_auc")
def cv_auc(spark, sf):
    train, _ = _sides(_split_vectors(spark, sf))
    return T.cv_auc(train.drop("targetable_genes"), "vec_id", T.default_models())


@query("model_results")
def model_results(spark, sf):
    train, test = (side.drop("targetable_genes") for side in _sides(_split_vectors(spark, sf)))
    return T.model_results(train, test, "vec_id", T.default_models())


@query("feature_importance")
def feature_importance(spark, sf):
    """Strongest terms of a linear model on TF-IDF vectors, strongest dimensions of a forest on dense ones."""
    model, vectors = _labelled_tfidf(spark, sf)
    train, _ = _sides(S.stratified_split(vectors, "doc_id", "label"))
    train = stored(train, "train")
    vocab = model.table(spark)
    linear = T.feature_importance(T.fit_logistic(train), vocab)
    dense, _ = _sides(_split_vectors(spark, sf))
    forest_model = T.fit_forest(dense)
    names = spark.range(forest_model.numFeatures).select(
        F.col("id").cast("int").alias("term_idx"), F.format_string("dimension %d", "id").alias("term")
    )
    forest = T.feature_importance(forest_model, names)
    return linear.withColumn("model", F.lit("logistic")).unionAll(forest.withColumn("model", F.lit("forest")))


@query("per_gene_models")
def per_gene_models(spark, sf):
    data = stored(W.vectors(spark, sf).select("vec_id", "features", "targetable_genes"), "vectors")
    return T.per_gene_models(data, "vec_id", gene_flags())[1]


@query("per_cohort_models")
def per_cohort_models(spark, sf):
    """One model per cohort; the cohort of a vector follows from its id as for patients."""
    named = W.vectors(spark, sf).withColumn("cohort", F.concat(F.lit("TCGA-"), F.lpad("class", 2, "0")))
    data = stored(named.select("vec_id", "features", "cohort", (F.col("embedding")[0] > 0).cast("int").alias("label")), "vectors")
    return T.per_cohort_models(data, "vec_id", "cohort", "label", [f"TCGA-{i:02d}" for i in range(10)])[1]


@query("ensemble_on_split")
def ensemble_on_split(spark, sf):
    """Classifiers on two feature sets, trained on the same split and averaged on its test side."""
    _, tfidf = _labelled_tfidf(spark, sf)
    embedded = E.embed(W.clean_documents(spark, sf, tfidf), "doc_id", "clean_text", E.HashedTokens(64))
    labels = tfidf.select("doc_id", "label")
    dense = embedded.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).join(labels, "doc_id")
    scores = []
    for name, features in (("tfidf", tfidf), ("dense", dense)):
        data = stored(S.stratified_split(features, "doc_id", "label"), name)
        train, test = _sides(data)
        scores.append(T.score_all(T.fit_logistic(train), test).select("doc_id", "label", "probability"))
    return M.ensemble_comparison(*scores, "doc_id", "label", "probability", ("TF-IDF (LR)", "Dense (LR)"))


def _bundle(spark, sf):
    """Classifier and gene models on hashed embeddings of the labelled documents, saved."""
    labels = W.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    vectors = E.embed(W.clean_documents(spark, sf, labels), "doc_id", "clean_text", E.HashedTokens(64))
    data = stored(
        vectors.join(labels, "doc_id").select(
            "doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label", "toxic"
        ),
        "bundle-data",
    )
    flags = {"KRAS": F.col("label"), "BRAF": 1 - F.col("label"), "EGFR": F.col("toxic")}
    genes, _ = T.per_gene_models(data, "doc_id", flags)
    path = scratch_path(spark, "bundle")
    K.Bundle(T.fit_logistic(data.select("doc_id", "features", "label")), genes, 64, E.HashedTokens(64).name).save(spark, path)
    return path


@query(
    "bundle_manifest",
    f"""WITH p AS (SELECT sum(quality) AS KRAS, sum(1 - quality) AS BRAF, sum(toxic) AS EGFR FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT gene FROM (SELECT unnest(['KRAS', 'BRAF', 'EGFR']) AS gene, unnest([KRAS, BRAF, EGFR]) AS n FROM p) WHERE n >= {C.MIN_GENE_POSITIVES})
    SELECT 'classifier' AS name, 'LogisticRegressionModel' AS kind, NULL::VARCHAR AS gene, 'classifier' AS path, 64::INTEGER AS dim, 'hashed-tokens-64' AS encoder
    UNION ALL SELECT 'gene_' || gene, 'LogisticRegressionModel', gene, 'genes/' || gene, 64, 'hashed-tokens-64' FROM g""",
)
def bundle_manifest(spark, sf):
    return K.bundle_manifest(spark, _bundle(spark, sf))


@query("score_reports")
def score_reports(spark, sf):
    """Every document scored as a new report with a stored bundle."""
    bundle = K.load_bundle(spark, _bundle(spark, sf))
    docs = W.spread(W.table(spark, sf, "documents").select("doc_id", "text"))
    scored = SC.score_reports(docs, "doc_id", "text", bundle, E.HashedTokens(64))
    genes = F.transform("top_likely_genes", lambda g: F.format_string("%s(%.3f)", g["gene"], g["probability"]))
    return scored.withColumn("top_likely_genes", F.array_join(genes, ", "))


@query("gene_probabilities")
def gene_probabilities(spark, sf):
    """Gene probabilities in long form, cut to the likely ones per report."""
    path = _bundle(spark, sf)
    bundle = K.load_bundle(spark, path)
    vectors = E.embed(W.clean_documents(spark, sf), "doc_id", "clean_text", E.HashedTokens(64))
    features = vectors.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return SC.likely_genes(SC.gene_probabilities(features, bundle.gene_models, "doc_id"), "doc_id")


#: Genes of the given bundle, more than a report may name.
GIVEN_GENES = ("ALK", "BRAF", "EGFR", "KRAS", "MET", "PIK3CA", "ROS1")


def _given_model(loss, number, dim=16):
    """A linear model whose coefficients follow from its number, so that SQL can apply it as well."""
    weights = np.array([((7 * j + 3 * number) % 11 - 5) * 3.0 for j in range(dim)])
    return T.LinearFit(loss).model(Minimum(weights, (number % 3 - 1) * 0.25, 0.0, 0, True))


def _given_decision(number):
    model = _given_model("huber", number)
    return " + ".join([f"x[{j + 1}] * ({w})::DOUBLE" for j, w in enumerate(model.coefficients.tolist())]) + f" + ({model.intercept})::DOUBLE"


_GIVEN_PAIRS = ", ".join(
    f"{{'gene': '{gene}', 'p': 1 / (1 + exp(-({_given_decision(i + 1)})))}}" for i, gene in enumerate(GIVEN_GENES)
)


@query(
    "score_reports_given",
    f"""WITH clean AS (SELECT doc_id, {W.sql_clean('text')} AS clean_text FROM documents),
    toks AS (SELECT doc_id, unnest({sql_words('clean_text')}) AS word FROM clean),
    bytes AS (SELECT doc_id, i, ('0x' || substr(md5(word), (2 * i + 1)::INTEGER, 2))::INTEGER AS b FROM toks, range(16) r(i)),
    means AS (SELECT doc_id, i, (sum(b)::DOUBLE / count(*) / 127.5::DOUBLE - 1)::FLOAT::DOUBLE AS m FROM bytes GROUP BY doc_id, i),
    vectors AS (SELECT doc_id, list(m ORDER BY i) AS x FROM means GROUP BY doc_id),
    v AS (SELECT doc_id, coalesce(x, list_transform(range(16), lambda i: 0::DOUBLE)) AS x FROM documents LEFT JOIN vectors USING (doc_id)),
    s AS (SELECT doc_id, (greatest(least({_given_decision(0)}, 1.0::DOUBLE), -1.0::DOUBLE) + 1) / 2 AS p, [{_GIVEN_PAIRS}] AS genes FROM v),
    g AS (SELECT doc_id, gene.gene AS gene, round_even(gene.p, 3) AS p FROM (SELECT doc_id, unnest(genes) AS gene FROM s)
      WHERE gene.p >= {C.GENE_PROBABILITY_MIN}::DOUBLE),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, gene) AS rn FROM g),
    likely AS (SELECT doc_id, string_agg(printf('%s(%.3f)', gene, p), ', ' ORDER BY rn) AS top FROM ranked WHERE rn <= {C.GENE_TOP_K} GROUP BY doc_id)
    SELECT doc_id, CASE WHEN p >= 0.5 THEN {quoted(C.PREDICTED_POSITIVE)} ELSE {quoted(C.PREDICTED_NEGATIVE)} END AS predicted_class,
      round_even(p, 4) AS confidence, coalesce(top, '') AS top_likely_genes,
      CASE WHEN p >= 0.5 THEN {quoted(C.FOLLOW_UP[C.TARGETABLE])} ELSE {quoted(C.FOLLOW_UP[C.NON_TARGETABLE])} END
        || CASE WHEN p BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN {quoted(C.LOW_CONFIDENCE_NOTE)} ELSE '' END AS follow_up,
      'hashed-tokens-16' AS model_used
    FROM s LEFT JOIN likely USING (doc_id)""",
)
def score_reports_given(spark, sf):
    """Every document cleaned, embedded and scored with a bundle of given coefficients that was saved and loaded.

    The classifier is a Huber model and the genes are logistic ones, so both kinds of linear model go through the files.
    """
    encoder = E.HashedTokens(16)
    genes = {gene: _given_model("logistic", i + 1) for i, gene in enumerate(GIVEN_GENES)}
    path = scratch_path(spark, "bundle")
    K.Bundle(_given_model("huber", 0), genes, 16, encoder.name).save(spark, path)
    docs = W.spread(W.table(spark, sf, "documents").select("doc_id", "text"))
    scored = SC.score_reports(docs, "doc_id", "text", K.load_bundle(spark, path), encoder)
    shown = F.transform("top_likely_genes", lambda g: F.format_string("%s(%.3f)", g["gene"], g["probability"]))
    return scored.withColumn("top_likely_genes", F.array_join(shown, ", "))


def _labelled_dense(spark, sf, clean=None):
    """Labelled documents as dense vectors, stored: the split reads them three times."""
    labels = _labels(spark, sf)
    docs = clean or W.clean_documents(spark, sf, labels)
    embedded = stored(E.embed(docs, "doc_id", "clean_text", E.HashedTokens(64)), "embedded")
    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    return embedded.select("doc_id", vector).join(labels, "doc_id").select("doc_id", "label", "features")


def _on_split(data, name):
    """Stored, with a split that follows from id and label, so that all feature sets share it."""
    return stored(S.stratified_split(data.select("doc_id", "label", "features"), "doc_id", "label"), name)


@query("compare_feature_sets")
def compare_feature_sets(spark, sf):
    """Every model on both feature sets, the difference, and the winners of both averaged."""
    clean = W.stored_clean_documents(spark, sf, _labels(spark, sf))
    sets = {"TF-IDF": _labelled_tfidf(spark, sf, clean)[1], "Dense": _labelled_dense(spark, sf, clean)}
    return CO.compare({name: _on_split(data, name.lower()) for name, data in sets.items()}, "doc_id").summary()


@query("score_with_winner")
def score_with_winner(spark, sf):
    """The best model on dense vectors, of whatever kind, saved in a bundle, loaded, and used on every document."""
    side = CO.train_side("Dense", _on_split(_labelled_dense(spark, sf), "dense"), "doc_id", T.default_models())
    path = scratch_path(spark, "bundle")
    K.Bundle(side.model, {}, 64, E.HashedTokens(64).name).save(spark, path)
    docs = W.spread(W.table(spark, sf, "documents").select("doc_id", "text"))
    scored = SC.score_reports(docs, "doc_id", "text", K.load_bundle(spark, path), E.HashedTokens(64))
    return scored.select("doc_id", F.lit(side.best).alias("best_model"), "predicted_class", "confidence", "follow_up", "model_used")
