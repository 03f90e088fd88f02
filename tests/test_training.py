import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.operators import embedding as E
from cohortspark.operators import huber as H
from cohortspark.operators import training as T
from cohortspark.plans import scoring as SC
from cohortspark.sources import checkpoints as K
from cohortspark.streaming.score_stream import score_stream
from helpers import SMALL


def blobs(n=240, dim=4, seed=1, shift=1.0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, dim))
    x[:, 0] += shift * y
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = blobs()
    rows = [(i, Vectors.dense(v), int(t)) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as t

    schema = t.StructType(
        [t.StructField("id", t.IntegerType()), t.StructField("features", VectorUDT()), t.StructField("label", t.IntegerType())]
    )
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def balanced(y):
    return np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))


def test_logistic_equals_newton(data):
    x, y = blobs()
    w, xs = balanced(y), np.hstack([x, np.ones((len(x), 1))])
    b, ridge = np.zeros(5), np.diag([1, 1, 1, 1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xs @ b))
        b -= np.linalg.solve(xs.T @ (xs * (w * p * (1 - p))[:, None]) + ridge, xs.T @ (w * (p - y)) + ridge @ b)
    model = T.fit_logistic(data)
    assert np.allclose([*model.coefficients, model.intercept], b, atol=1e-4)


def objective(b, x, y, w, alpha=1e-4, l1=0.15):
    margin = (2 * y - 1) * (x @ b[:-1] + b[-1])
    penalty = alpha * (l1 * np.abs(b[:-1]).sum() + (1 - l1) / 2 * b[:-1] @ b[:-1])
    return (w * H.huber_loss(margin)).sum() / w.sum() + penalty


def test_huber_loss_and_probability(spark):
    f = np.array([-2, -1, -0.5, 0, 0.5, 1, 2.0])
    assert H.huber_loss(f).tolist() == [8, 4, 2.25, 1, 0.25, 0, 0]
    df = spark.createDataFrame([(float(v),) for v in f], "f double")
    assert [r[0] for r in df.select(H.loss_column(F.col("f"))).collect()] == [8, 4, 2.25, 1, 0.25, 0, 0]
    assert [r[0] for r in df.select(H.probability_column(F.col("f"))).collect()] == [0, 0, 0.25, 0.5, 0.75, 1, 1]


def test_huber_reaches_the_optimum(data):
    x, y = blobs()
    w = balanced(y)
    b = np.zeros(5)
    for step in range(20000):  # plain subgradient descent on one machine
        margin = (2 * y - 1) * (x @ b[:-1] + b[-1])
        slope = w * (2 * y - 1) * H.huber_slope(margin) / w.sum()
        grad = np.append(x.T @ slope + 1e-4 * (0.85 * b[:-1] + 0.15 * np.sign(b[:-1])), slope.sum())
        b -= 0.1 * grad
    model = T.fit_huber(data, max_iter=80, tolerance=0.0)
    found = np.append(model.coefficients, model.intercept)
    assert math.isclose(model.objective, objective(found, x, y, w), rel_tol=1e-9)
    assert model.objective <= objective(b, x, y, w) + 1e-4


def test_huber_takes_sparse_dense_and_mixed_vectors(spark):
    pairs = [([1.0, 0.0, 2.0], 1), ([0.0, 0.0, -1.0], 0), ([0.5, 0.0, 0.0], 1), ([0.0, -3.0, 0.0], 0)] * 5
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as t

    schema = t.StructType([t.StructField("features", VectorUDT()), t.StructField("label", t.IntegerType())])

    def sparse(v):
        return Vectors.sparse(3, [(i, x) for i, x in enumerate(v) if x])

    kinds = {
        "dense": lambda i, v: Vectors.dense(v),
        "sparse": lambda i, v: sparse(v),
        "mixed": lambda i, v: sparse(v) if i % 2 else Vectors.dense(v),
    }
    fits = []
    for make in kinds.values():
        df = spark.createDataFrame([(make(i, v), y) for i, (v, y) in enumerate(pairs)], schema).coalesce(1)
        model = H.fit_modified_huber(df, max_iter=15)
        fits.append(np.append(model.coefficients, model.intercept))
        assert model.transform(df).select("decision").count() == 20
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])


def test_forest_separates(data):
    from cohortspark.operators.metrics import auc

    scored = T.score_all(T.fit_forest(data, num_trees=20, max_depth=6), data)
    assert auc(scored, "label", "probability").first().auc > 0.8


def test_importance_is_signed_for_linear_models(spark, data):
    vocab = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "term_idx int, term string")
    table = T.feature_importance(T.fit_logistic(data), vocab, k=2).collect()
    assert [(r.direction, r.rank) for r in table] == [
        ("Targetable", 1), ("Targetable", 2), ("Non-Targetable", 1), ("Non-Targetable", 2)
    ]
    assert table[0].feature == "t0"
    forest = T.feature_importance(T.fit_forest(data, num_trees=5, max_depth=3), vocab, k=2).collect()
    assert len(forest) == 2 and forest[0].direction is None and forest[0].value >= forest[1].value


def test_rare_genes_and_small_cohorts_are_skipped(data):
    flags = {"COMMON": F.col("label"), "RARE": (F.col("id") < 9).cast("int")}
    models, table = T.per_gene_models(data, "id", flags)
    assert list(models) == ["COMMON"] and [r.Gene for r in table.collect()] == ["COMMON"]
    named = data.withColumn("cohort", F.when(F.col("id") < 20, "small").otherwise("large"))
    models, table = T.per_cohort_models(named, "id", "cohort", "label", ["small", "large", "absent"])
    assert list(models) == ["large"] and table.first().N_Patients == 220


def test_masked_mean(spark):
    tokens = spark.createDataFrame(
        [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)],
        "doc string, v array<double>, m int",
    )
    assert {r.doc: r.embedding for r in E.masked_mean_pool(tokens, "doc", "v", "m").collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}


def test_hashed_tokens_average(spark):
    encode = E.HashedTokens(32).encode
    one, two, both, none = encode(["x", "y", "x y", ""])
    assert np.allclose(both, (one + two) / 2) and not none.any() and np.abs(one).max() <= 1
    df = spark.createDataFrame([(i, f"w{i % 3} x") for i in range(50)], "id int, t string")
    out = {r.id: r.embedding for r in E.embed(df, "id", "t", E.HashedTokens(32), batch_size=7).collect()}
    assert np.allclose(out[4], encode(["w1 x"])[0], atol=1e-6) and len(out) == 50


def test_encoder_is_chosen_once_and_named(spark):
    def broken():
        raise OSError("no model files")

    df = spark.createDataFrame([(1, "x")], "id int, t string")
    chain = [("big", broken), ("hashed", E.HashedTokens(16))]
    assert E.embed_with(df, "id", "t", chain).first().model_used == "hashed"
    with pytest.raises(RuntimeError, match="no model files"):
        E.choose_encoder(chain[:1])


def test_unit_length(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(E.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.fixture(scope="module")
def bundle(spark):
    encoder = E.HashedTokens(16)
    texts = [(i, f"word{i % 7} word{i % 5} word{i % 3}", int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(texts, "id int, t string, label int")
    from pyspark.ml.functions import array_to_vector

    vectors = E.embed(df, "id", "t", encoder).join(df, "id").select(
        "id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label"
    )
    vectors = vectors.cache()
    model = T.fit_logistic(vectors)
    genes = {g: T.fit_logistic(vectors.withColumn("label", (F.col("id") % (i + 2) == 0).cast("int"))) for i, g in enumerate(C.TOP_GENES[:7])}
    return K.Bundle(model, genes, 16, "hashed-tokens-16")


def test_bundle_roundtrip_and_scoring(spark, bundle, tmp_path):
    path = str(tmp_path / "bundle")
    bundle.save(spark, path)
    loaded = K.load_bundle(spark, path)
    assert sorted(loaded.gene_models) == sorted(bundle.gene_models) and loaded.dim == 16
    assert np.allclose(loaded.classifier.coefficients, bundle.classifier.coefficients)

    reports = spark.createDataFrame([(i, f"Word{i % 7}, word{i % 5}; WORD{i % 3}!") for i in range(40)], "id int, t string")
    scored = {r.id: r for r in SC.score_reports(reports, "id", "t", loaded, E.HashedTokens(16)).collect()}
    assert len(scored) == 40
    for r in scored.values():
        genes = r.top_likely_genes
        assert len(genes) <= C.GENE_TOP_K and all(g.probability >= 0.3 for g in genes)
        assert [g.probability for g in genes] == sorted((g.probability for g in genes), reverse=True)
        assert r.predicted_class == ("Targetable_Mutation" if r.confidence >= 0.5 else "Non_Targetable")
        assert r.follow_up.startswith("URGENT" if r.confidence >= 0.5 else "MONITOR")
        assert r.follow_up.endswith(C.LOW_CONFIDENCE_NOTE) == (0.4 <= r.confidence <= 0.6)

    reports.write.parquet(str(tmp_path / "in"))
    run = score_stream(
        spark, str(tmp_path / "in"), "id int, t string", "id", "t", loaded, E.HashedTokens(16),
        str(tmp_path / "out"), str(tmp_path / "state"),
    )
    run.awaitTermination(120)
    streamed = {r.id: r.confidence for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {i: r.confidence for i, r in scored.items()}


def test_cv_summary_uses_the_population_deviation(spark):
    folds = spark.createDataFrame([("m", 0, 0.7), ("m", 1, 0.8)], "Model string, fold int, auc double")
    assert tuple(T.cv_summary(folds).first()) == ("m", 0.75, 0.05, "0.7500+/-0.0500")


def test_forest_keeps_the_node_of_every_row_and_its_trees(spark, data):
    from pyspark.ml.classification import RandomForestClassifier

    model = T.fit_forest(data, num_trees=5, max_depth=6)
    assert model.getOrDefault("cacheNodeIds") and spark.sparkContext.getCheckpointDir()
    weighted, _ = T._weighted(data, "label", "features")
    plain = RandomForestClassifier(weightCol="weight", numTrees=5, maxDepth=6, featureSubsetStrategy="sqrt", seed=C.SEED).fit(weighted)
    assert model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_digests_are_taken_once_a_token(monkeypatch):
    taken, md5 = [], E.hashlib.md5
    monkeypatch.setattr(E.hashlib, "md5", lambda data: (taken.append(data), md5(data))[1])
    encode = E.HashedTokens(16)()
    first, again = encode(["a b a"]), encode(["b a", "c"])
    assert sorted(taken) == [b"a", b"b", b"c"]
    whole = E.HashedTokens(16).encode(["a b a", "b a", "c"])
    assert np.array_equal(np.vstack([first, again]), whole)


def test_tokens_beyond_those_remembered(monkeypatch):
    texts = ["a b", "c d e f g", "", "a c a", "h", "b"]
    whole = E.HashedTokens(32).encode(texts)
    monkeypatch.setattr(E, "REMEMBERED", 3)
    encode = E.HashedTokens(32)()
    assert np.array_equal(np.vstack([encode([t]) for t in texts]), whole)


def test_only_the_asked_documents_are_cleaned(spark):
    ids = W.table(spark, SMALL, "labels").select("doc_id")
    every = {r.doc_id: r.clean_text for r in W.clean_documents(spark, SMALL).collect()}
    asked = {r.doc_id: r.clean_text for r in W.clean_documents(spark, SMALL, ids).collect()}
    wanted = {r.doc_id for r in ids.collect()}
    assert 0 < len(asked) < len(every) and asked == {k: v for k, v in every.items() if k in wanted}


def test_word_vectors_read_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, "lung node lymph") for i in range(40)], "id int, t string")
    out = E.word2vec_embed(rows.select("id", counted("t").alias("t")), "id", "t", dim=4, partitions=2).collect()
    assert len(out) == 40 and all(len(r.embedding) == 4 for r in out) and read.value == 40
