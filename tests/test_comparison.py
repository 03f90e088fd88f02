"""Two feature sets compared, and the winner served whatever its kind."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortspark.operators import embedding as E
from cohortspark.operators import splits as S
from cohortspark.operators import training as T
from cohortspark.plans import comparison as CO
from cohortspark.plans import scoring as SC
from cohortspark.sources import checkpoints as K

MODELS = {
    "Logistic Regression": T.LinearFit("logistic"),
    "Random Forest": lambda train: T.fit_forest(train, num_trees=15, max_depth=4),
    "SGD Classifier": T.LinearFit("huber"),
}


def blobs(spark, dim, shift, seed):
    rng = np.random.default_rng(seed)
    y = (np.arange(200) % 3 == 0).astype(int)
    x = rng.normal(size=(200, dim))
    x[:, 0] += shift * y
    rows = [(i, int(t), v) for i, (t, v) in enumerate(zip(y, x.tolist()))]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    return S.stratified_split(df.select("id", "label", array_to_vector("v").alias("features")), "id", "label").cache()


def area(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])


def test_every_figure_follows_from_the_scores(spark):
    sides = {"TF-IDF": blobs(spark, 3, 1.0, 1), "Dense": blobs(spark, 5, 2.5, 2)}
    found = CO.compare(sides, "id", {name: MODELS for name in sides})
    delta = {r.Model: r for r in found.delta.collect()}
    assert sorted(delta) == sorted(MODELS)
    for column, (name, data) in (("TF-IDF_AUC", ("TF-IDF", sides["TF-IDF"])), ("BERT_AUC", ("Dense", sides["Dense"]))):
        train, test = (data.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
        scored = T.score_all(T.fit_logistic(train), test).select("label", "probability").collect()
        assert abs(delta["Logistic Regression"][column] - area(scored)) < 1e-4
    for row in delta.values():
        gap = round(row["BERT_AUC"] - row["TF-IDF_AUC"], 4)
        assert row.Delta == gap and row.Winner == ("BERT" if gap > 0 else "TF-IDF" if gap < 0 else "TIE")

    for side, column in ((found.base, "TF-IDF_AUC"), (found.other, "BERT_AUC")):
        assert delta[side.best][column] == max(row[column] for row in delta.values())
    a = {r.id: (r.label, r.probability) for r in found.base.scores.collect()}
    b = {r.id: (r.label, r.probability) for r in found.other.scores.collect()}
    assert a.keys() == b.keys() and len(a) == 14 + 27  # a fifth of 67 and of 133, rounded up
    ensemble = {r.Model: r.AUC for r in found.ensemble.collect()}
    assert ensemble.keys() == {f"TF-IDF ({found.base.best})", f"Dense ({found.other.best})", "Ensemble (avg)"}
    assert abs(ensemble["Ensemble (avg)"] - area([(y, (p + b[i][1]) / 2) for i, (y, p) in a.items()])) < 1e-4
    summary = found.summary().collect()
    assert [r.part for r in summary].count("models") == 3 and [r.part for r in summary].count("ensemble") == 3


def test_other_rows_or_another_split_are_refused(spark):
    whole = blobs(spark, 3, 1.0, 1)
    first = {side: whole.where(F.col("split") == side).agg(F.min("id")).first()[0] for side in ("train", "test")}
    swapped = F.when(F.col("id") == first["train"], "test").when(F.col("id") == first["test"], "train").otherwise(F.col("split"))
    for other in (whole.where(F.col("id") != first["train"]), whole.withColumn("split", swapped)):
        with pytest.raises(ValueError, match="line up"):
            CO.compare({"a": whole, "b": other}, "id", {"a": MODELS, "b": MODELS})


@pytest.mark.parametrize("name", list(MODELS))
def test_a_winner_of_any_kind_is_served_from_files(spark, name, tmp_path):
    encoder = E.HashedTokens(16)
    texts = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} word{i % 3}", int(i % 3 == 0)) for i in range(90)], "id int, t string, label int")
    vectors = E.embed(texts, "id", "t", encoder).join(texts, "id")
    data = vectors.select("id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    side = CO.train_side("Dense", S.stratified_split(data, "id", "label").cache(), "id", {name: MODELS[name]})
    assert side.best == name
    K.Bundle(side.model, {"KRAS": side.model}, 16, encoder.name).save(spark, str(tmp_path / "b"))
    loaded = K.load_bundle(spark, str(tmp_path / "b"))
    assert type(loaded.classifier) is type(side.model)
    served = {r.id: r for r in SC.score_reports(texts, "id", "t", loaded, encoder).collect()}
    direct = {r.id: r.probability for r in T.score_all(side.model, data).select("id", "probability").collect()}
    assert served.keys() == direct.keys()
    for i, row in served.items():
        assert abs(row.confidence - direct[i]) <= 0.5001e-4
        assert [g.gene for g in row.top_likely_genes] == (["KRAS"] if direct[i] >= 0.3 else [])
