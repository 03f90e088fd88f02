"""Forests whose trees are rows of a table: cuts, splits, trees, scores and files."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortspark import constants as C
from cohortspark.operators import forest as FO
from cohortspark.operators import training as T
from cohortspark.operators.metrics import auc
from cohortspark.plans import scoring as SC
from cohortspark.sources import checkpoints as K
from helpers import SMALL

SCHEMA = StructType([StructField("id", IntegerType()), StructField("features", VectorUDT()), StructField("label", IntegerType())])


def _rows(n=600, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 2)
    x[:, 3] = rng.integers(0, 3, n)  # few values
    x[rng.random((n, dim)) < 0.4] = 0.0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(np.uint8)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = _rows()
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(len(v), {j: a for j, a in enumerate(v.tolist()) if a}), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "id").localCheckpoint()


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(T, "FOREST_ROWS", 100)


def _binned(x, y):
    weight = np.ones(len(y))
    row, index = np.nonzero(x)
    cuts = {f: FO.cuts_of(v, c, float(len(y))) for f, v, c in FO.summary(index, x[row, index], weight[row])}
    bins = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(x.shape[1])], axis=1).astype(np.uint8)
    return bins, np.array([np.searchsorted(cuts[j], 0.0) for j in range(x.shape[1])], np.uint8)


def _sparse(bins, zero, y):
    row, feature = np.nonzero(bins != zero)
    return FO._Sparse(y, np.bincount(row, minlength=len(y)).astype(np.int32), feature.astype(np.uint16), bins[row, feature], zero)


def test_cuts_are_those_of_the_other_trainer(spark, data):
    weights, total = T._class_weights(data, "label")
    by_class = np.array([weights[0], weights[1]])
    stored = FO._stored_cuts(data.select(F.unwrap_udt("features").alias("x"), F.col("label").alias("y")), by_class, float(total), 3)
    cuts = {r.feature: np.frombuffer(bytes(r.cuts)) for r in stored.collect()}
    weighted, _ = T._weighted(data, "label", "features")
    plain = RandomForestClassifier(weightCol="weight", numTrees=30, maxDepth=8, featureSubsetStrategy="all", seed=C.SEED).fit(weighted)
    used = {(int(f), float(at)) for f, at in re.findall(r"feature (\d+) <= (\S+?)\)", plain.toDebugString)}
    assert len(used) > 60 and all(np.abs(cuts[f] - at).min() < 1e-9 for f, at in used)


def test_thinned_values_keep_their_weight(monkeypatch):
    monkeypatch.setattr(FO, "POINTS", 10)
    values, counts = FO._thinned(np.arange(100.0), np.ones(100))
    assert len(values) == 10 and counts.tolist() == [10.0] * 10 and values[-1] == 99


def test_every_split_is_the_best_one():
    x, y = _rows(80, 4)
    bins, _ = _binned(x, y)
    weights, total = np.array([1.5, 0.75]), np.bincount(y, minlength=2)[None]
    data, every = FO._Dense(y, bins), np.arange(4)[None]
    (pair, at, counts, _), = data.cells(np.arange(80), np.zeros(80, np.int64), np.ones(80, np.int32), every, total)
    node, feature, cut, gain = (v[0] for v in FO.best_splits(pair, at, counts, total, 4, weights))

    def impurity(side):
        mass = np.bincount(y[side], minlength=2) * weights
        return mass.sum() * (1 - ((mass / mass.sum()) ** 2).sum()) if side.any() else 0.0

    whole = np.ones(80, bool)
    gains = {(f, c): (impurity(whole) - impurity(bins[:, f] <= c) - impurity(bins[:, f] > c)) / (np.bincount(y) * weights).sum() for f in range(4) for c in range(31)}
    assert gain == pytest.approx(max(gains.values())) and gains[feature, cut] == pytest.approx(gain)


def test_sparse_and_dense_rows_grow_the_same_trees(monkeypatch):
    x, y = _rows(500, 9)
    bins, zero = _binned(x, y)
    weights = np.array([0.9, 1.2])
    dense, by_column, by_row = FO._Dense(y, bins), _sparse(bins, zero, y), _sparse(bins, zero, y)
    by_row.columns = None
    monkeypatch.setattr(FO, "ENTRIES", 64)
    monkeypatch.setattr(FO, "BLOCK", 45)
    monkeypatch.setattr(FO, "CELLS", 1 << 10)
    for tree in range(3):
        grown = [FO.grow(d, weights, 7, tree, 12) for d in (dense, by_column, by_row)]
        assert len(grown[0][0]) > 30
        for other in grown[1:]:
            assert all(np.array_equal(a, b) for a, b in zip(grown[0], other))


def test_wide_subsets_have_no_feature_twice():
    rng = np.random.default_rng(0)
    drawn = FO.subsets(rng, 400, 2000, 45)
    assert drawn.shape == (400, 45) and all(len(set(row)) == 45 for row in drawn.tolist())
    assert len(np.unique(drawn)) > 1990
    assert sorted(FO.subsets(rng, 1, 3, 3)[0]) == [0, 1, 2]


def test_many_rows_keep_no_tree_on_the_driver(spark, data, many):
    model = T.fit_forest(data, num_trees=20, max_depth=6)
    assert isinstance(model, FO.StoredForest) and not hasattr(model, "trees")
    assert spark.read.parquet(f"{model.path}/trees").count() == 20
    scored = T.score_all(model, data)
    assert scored.columns == ["id", "label", "probability", "prediction"] and scored.count() == 600
    plain = RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=6, featureSubsetStrategy="sqrt", seed=C.SEED).fit(T._weighted(data, "label", "features")[0])
    found, known = (auc(T.score_all(m, data), "label", "probability").first().auc for m in (model, plain.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")))
    assert found == pytest.approx(known, abs=0.02) and found > 0.9
    assert model.featureImportances.sum() == pytest.approx(1.0)
    assert np.allclose(model.featureImportances, plain.featureImportances.toArray(), atol=0.06)


def test_trees_do_not_depend_on_the_number_of_tasks(spark, data, many):
    def trees():
        rows = spark.read.parquet(f"{T.fit_forest(data, num_trees=9, max_depth=5).path}/trees").collect()
        return {r.tree: (bytes(r.feature), bytes(r.cut), bytes(r.probability)) for r in rows}

    assert trees() == trees() and len(set(trees().values())) == 9


def test_stored_forest_in_a_bundle(spark, data, many, tmp_path):
    model = T.fit_forest(data, num_trees=7, max_depth=5)
    K.Bundle(model, {"KRAS": T.fit_logistic(data)}, 6, "e").save(spark, str(tmp_path))
    loaded = K.load_bundle(spark, str(tmp_path))
    assert np.array_equal(loaded.classifier.featureImportances, model.featureImportances)
    vectors = data.withColumn("embedding", F.expr("transform(array_repeat(0, 6), (z, i) -> cast((id * (i + 3)) % 7 - 3 as float))"))
    direct = model.transform(vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    expected = {r.id: round(r.probability, 4) for r in direct.collect()}
    got = SC.score_vectors(vectors.select("id", "embedding"), "id", loaded).collect()
    assert {r.id: r.confidence for r in got} == pytest.approx(expected, abs=1e-4) and len(got) == 600
    vocab = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "term_idx int, term string")
    assert T.feature_importance(loaded.classifier, vocab, k=2).first().rank == 1


def test_wide_rows(spark, many):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = {int(j): float(1 + j % 3) for j in rng.choice(1500, 30, replace=False)}
        rows.append((i, Vectors.sparse(1500, words | ({1400: 2.0} if i % 2 else {})), i % 2))
    wide = spark.createDataFrame(rows, SCHEMA)
    model = T.fit_forest(wide, num_trees=60, max_depth=8)
    assert model.numFeatures == 1500 and int(model.featureImportances.argmax()) == 1400
    assert auc(T.score_all(model, wide), "label", "probability").first().auc > 0.95


def test_missing_vectors_and_other_labels_are_refused(spark, data, many):
    with pytest.raises(Exception, match="NULL"):
        T.fit_forest(data.withColumn("features", F.when(F.col("id") != 5, F.col("features"))), num_trees=2)
    with pytest.raises(ValueError, match="0 or 1"):
        T.fit_forest(data.withColumn("label", F.col("label") + 1), num_trees=2)


def test_one_class_gives_leaves(spark, data, many):
    model = T.fit_forest(data.withColumn("label", F.lit(1)), num_trees=3, max_depth=4)
    assert {r.probability for r in T.score_all(model, data).collect()} == {1.0}


def test_folds_and_sides_of_many_rows(spark, data, many):
    """Cross-validation, results and the comparison of feature sets with stored forests."""
    from cohortspark.operators.splits import stratified_split
    from cohortspark.plans import comparison as CO

    models = {"Random Forest": lambda train: T.fit_forest(train, num_trees=10, max_depth=6)}
    scores = T.cv_scores(data, "id", models, k=2)
    assert scores.count() == 600 and scores.where("probability is null").count() == 0
    assert T.cv_auc(data, "id", models, k=2).first().CV_AUC_mean > 0.85
    split = stratified_split(data, "id", "label").localCheckpoint()
    train, test = (split.where(F.col("split") == side).drop("split") for side in ("train", "test"))
    row = T.model_results(train, test, "id", models, k=2).first()
    assert row.Train_AUC > row.Test_AUC > 0.8 and row.CV_AUC_mean > 0.8
    found = CO.compare({"TF-IDF": split, "Dense": split}, "id", {name: models for name in ("TF-IDF", "Dense")})
    assert isinstance(found.base.model, FO.StoredForest) and found.delta.first().Delta == 0.0


def test_importance_names_the_strongest_features(spark, data, many):
    model = T.fit_forest(data, num_trees=30, max_depth=8)
    names = spark.range(model.numFeatures).select(F.col("id").cast("int").alias("term_idx"), F.format_string("dimension %d", "id").alias("term"))
    found = T.feature_importance(model, names, k=3).collect()
    assert {r.feature for r in found} == {"dimension 0", "dimension 1", "dimension 2"} and all(r.direction is None for r in found)
    assert [r.value for r in found] == sorted((r.value for r in found), reverse=True)


def test_labelled_documents_are_embedded_once(spark):
    from cohortspark.catalog import training as catalog

    plan = catalog._labelled_dense(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Scan parquet" in plan
