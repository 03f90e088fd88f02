"""Models trained side by side against the same models trained alone."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as t

from cohortspark.operators import linear as L
from cohortspark.operators import splits as S
from cohortspark.operators import training as T


def frame(spark, sparse, n=300, dim=5, parts=3):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, dim)) * (rng.random((n, dim)) < (0.5 if sparse else 1.0))
    y = (x[:, 0] + rng.normal(size=n) > 0.4).astype(int)

    def vector(v):
        return Vectors.sparse(dim, [(j, float(a)) for j, a in enumerate(v) if a]) if sparse else Vectors.dense(v)

    schema = t.StructType(
        [
            t.StructField("id", t.IntegerType()),
            t.StructField("features", VectorUDT()),
            t.StructField("label", t.IntegerType()),
            t.StructField("cohort", t.StringType()),
        ]
    )
    rows = [(i, vector(v), int(c), "ABBB"[i % 4]) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, schema).repartition(parts).cache()


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark, sparse=False, parts=2)


@pytest.fixture(scope="module")
def sparse(spark):
    return frame(spark, sparse=True, parts=2)


MASKS = {"all": "true", "even": "id % 2 = 0", "few": "id < 60"}


def masked(df):
    return df.withColumn("labels", F.array(*[F.when(F.expr(m), F.col("label")) for _ in range(2) for m in MASKS.values()]))


@pytest.mark.parametrize("kind", ["data", "sparse"])
def test_each_column_equals_its_separate_fit(kind, request):
    data = request.getfixturevalue(kind)
    fits = {f"{loss}-{m}": T.LinearFit(loss, 25) for loss in ("logistic", "huber") for m in MASKS}
    found = T.fit_side_by_side(masked(data), fits)
    for name, minimum in found.items():
        loss, mask = name.split("-")
        alone = T.LinearFit(loss, 25)(data.where(MASKS[mask]))
        if loss == "logistic":
            assert minimum.converged
            assert np.allclose(minimum.coefficients, alone.coefficients.toArray(), atol=2e-3)
            assert abs(minimum.intercept - alone.intercept) < 2e-3
        else:
            assert abs(minimum.objective - alone.objective) < 1e-9
            assert np.allclose(minimum.coefficients, alone.coefficients, atol=1e-9)


def test_groups_chunks_and_the_shuffle_change_nothing(sparse, monkeypatch):
    data = sparse
    fits = {f"{loss}-{m}": T.LinearFit(loss, 6) for loss in ("logistic", "huber") for m in MASKS}
    whole = T.fit_side_by_side(masked(data), fits)
    scores = T.score_side_by_side(masked(data), fits, whole).groupBy("name").agg(F.sum("probability")).collect()
    monkeypatch.setattr(L, "AT_ONCE", 15)
    monkeypatch.setattr(L, "CHUNK", 3)
    cut = T.fit_side_by_side(masked(data), fits)
    for name in fits:
        assert np.allclose(whole[name].coefficients, cut[name].coefficients, atol=1e-8)
    again = T.score_side_by_side(masked(data), fits, whole).groupBy("name").agg(F.sum("probability")).collect()
    assert np.allclose(sorted(r[1] for r in scores), sorted(r[1] for r in again))


def test_a_step_is_one_pass_for_all_models(data, monkeypatch):
    counted, real = [], L._losses_and_gradients

    def count(*args):
        counted.append(len(args[-1]))
        return real(*args)

    monkeypatch.setattr(L, "_losses_and_gradients", count)
    fits = {f"{loss}-{m}": T.LinearFit(loss, 40) for loss in ("logistic", "huber") for m in MASKS}
    found = T.fit_side_by_side(masked(data), fits)
    alone = [m.passes for m in found.values()]
    assert len(counted) == max(alone) < sum(alone)
    assert counted[0] == len(fits) and counted[-1] < len(fits) * 3  # models that have ended take no part


def test_split_of_many_models_equals_the_split_of_each(spark):
    df = spark.range(400).select("id", F.array(*[F.when(F.col("id") % (m + 2) > 0, (F.col("id") % 5 == m).cast("int")) for m in range(3)]).alias("labels"))
    both = S.split_columns(df, "id", "labels", 3).collect()
    for m in range(3):
        alone = S.stratified_split(df.select("id", F.col("labels")[m].alias("y")).where("y IS NOT NULL"), "id", "y")
        for side in ("train", "test"):
            expected = {(r.id, r.y) for r in alone.where(F.col("split") == side).collect()}
            assert {(r.id, r[side][m]) for r in both if r[side][m] is not None} == expected


def test_genes_and_cohorts_as_if_trained_alone(data):
    flags = {"A": F.col("label"), "B": (F.col("id") % 3 == 0).cast("int"), "C": F.when(F.col("id") > 50, 1 - F.col("label"))}
    flags["RARE"] = (F.col("id") < 4).cast("int")
    separate = lambda train: T.fit_logistic(train)
    together, table = T.per_gene_models(data, "id", flags)
    apart, expected = T.per_gene_models(data, "id", flags, fit=separate)
    assert set(together) == set(apart) == {"A", "B", "C"}
    for gene, model in together.items():
        assert type(model) is type(apart[gene])
        assert np.allclose(model.coefficients.toArray(), apart[gene].coefficients.toArray(), atol=2e-3)
    assert {r.Gene: r.AUC for r in table.collect()} == pytest.approx({r.Gene: r.AUC for r in expected.collect()}, abs=0.005)
    _, table = T.per_cohort_models(data, "id", "cohort", "label", ["A", "B", "absent"])
    _, expected = T.per_cohort_models(data, "id", "cohort", "label", ["A", "B", "absent"], fit=separate)
    assert {r.Cohort: r.AUC for r in table.collect()} == pytest.approx({r.Cohort: r.AUC for r in expected.collect()}, abs=0.005)


def test_folds_as_if_trained_alone(data):
    plain = {"lr": lambda train: T.fit_logistic(train), "sgd": lambda train: T.fit_huber(train, max_iter=25)}
    linear = {"lr": T.LinearFit("logistic"), "sgd": T.LinearFit("huber", 25)}
    narrow = data.select("id", "features", "label")
    expected = {r.Model: r.CV_AUC_mean for r in T.cv_auc(narrow, "id", plain, k=2).collect()}
    assert {r.Model: r.CV_AUC_mean for r in T.cv_auc(narrow, "id", linear, k=2).collect()} == pytest.approx(expected, abs=0.003)


def test_no_rows_and_one_class(data):
    labels = F.array(F.lit(None).cast("int"), F.lit(1), F.col("label"))
    fits = {"none": T.LinearFit("huber"), "ones": T.LinearFit("huber"), "both": T.LinearFit("huber")}
    found = T.fit_side_by_side(data.withColumn("labels", labels), fits)
    assert found["none"].passes == 0 and not found["none"].coefficients.any()
    assert found["ones"].intercept > 0.9 and found["both"].coefficients.any()
    empty = T.fit_side_by_side(data.withColumn("labels", labels).limit(0), fits)
    assert all(m.passes == 0 for m in empty.values())
    with pytest.raises(ValueError, match="labels must be"):
        T.fit_side_by_side(data.withColumn("labels", F.array(F.lit(2))), {"x": T.LinearFit()})
