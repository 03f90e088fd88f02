import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from cohortspark.operators import metrics as M
from cohortspark.operators import splits as S

GOLDEN = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.8), (1, 0.3), (0, 0.1)]


def frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "label int, score double")


def pair_auc(pairs):
    pos = np.array([s for y, s in pairs if y == 1])[:, None]
    neg = np.array([s for y, s in pairs if y == 0])[None, :]
    return float(((pos > neg) + 0.5 * (pos == neg)).mean())


def test_golden_auc_and_rates(spark):
    df = frame(spark, GOLDEN).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    assert math.isclose(M.auc(df, "label", "score").first().auc, 6 / 9)
    confusion = M.confusion_matrix(df, "label", "pred")
    assert tuple(confusion.first()) == (1, 2, 1, 2)
    scores = M.precision_recall_f1(confusion).first()
    assert (scores.precision, round(scores.recall, 9), round(scores.f1, 9)) == (0.5, round(2 / 3, 9), round(4 / 7, 9))


@pytest.mark.parametrize("cuts", [[], [0.5], [0.3, 0.8], [0.1, 0.2, 0.3, 0.8, 0.85, 0.9]])
def test_golden_roc_points_whatever_the_cuts(spark, cuts):
    df = frame(spark, GOLDEN)
    for prune in (False, True):
        points = M.roc_curve(df, "label", "score", prune=prune, cuts=cuts).collect()
        assert sorted((p.fp, p.tp) for p in points) == [(0, 0), (0, 1), (2, 2), (2, 3), (3, 3)]


def pruned(pairs):
    """Points kept by comparing second differences, on arrays."""
    scores = sorted({s for _, s in pairs}, reverse=True)
    tp = np.cumsum([sum(y for y, s in pairs if s == t) for t in scores])
    fp = np.cumsum([sum(1 - y for y, s in pairs if s == t) for t in scores])
    keep = np.ones(len(scores), bool)
    if len(scores) > 2:
        keep[1:-1] = (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0)
    return sorted([(0, 0), *((int(f), int(t)) for f, t, k in zip(fp, tp, keep) if k)])


PAIRS = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12).map(lambda i: i / 12)), min_size=2, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(PAIRS, st.sets(st.integers(0, 12).map(lambda i: i / 12), max_size=4))
def test_auc_and_roc_against_brute_force(spark, pairs, cuts):
    df, cuts = frame(spark, pairs), sorted(cuts)
    got = M.auc(df, "label", "score", cuts=cuts).first()
    if got.n_pos and got.n_neg:
        assert math.isclose(got.auc, pair_auc(pairs), abs_tol=1e-12)
    else:
        assert got.auc is None
    points = M.roc_curve(df, "label", "score", prune=True, cuts=cuts).collect()
    assert sorted((p.fp, p.tp) for p in points) == pruned(pairs)


def test_auc_per_group_with_one_dominant_group(spark):
    rng = np.random.default_rng(0)
    data = [("hot", int(y), float(s)) for y, s in zip(rng.integers(0, 2, 3000), rng.random(3000))]
    data += [("cold", 1, 0.2), ("cold", 0, 0.1), ("one class", 1, 0.5)]
    df = spark.createDataFrame(data, "grp string, label int, score double")
    got = {r.grp: r.auc for r in M.auc(df, "label", "score", by=["grp"]).collect()}
    assert math.isclose(got["hot"], pair_auc([(y, s) for g, y, s in data if g == "hot"]), abs_tol=1e-12)
    assert (got["cold"], got["one class"]) == (1.0, None)


def test_missing_scores_are_left_out_and_empty_input_is_fine(spark):
    df = frame(spark, GOLDEN).unionAll(spark.createDataFrame([(1, None)], "label int, score double"))
    assert math.isclose(M.auc(df, "label", "score").first().auc, 6 / 9)
    assert M.auc(df.where("false"), "label", "score", by=["label"]).count() == 0


def test_f1_without_positives_is_zero(spark):
    df = spark.createDataFrame([(0, 0)], "label int, pred int")
    out = M.precision_recall_f1(M.confusion_matrix(df, "label", "pred")).first()
    assert (out.precision, out.recall, out.f1) == (0.0, 0.0, 0.0)
    assert M.binary_rates(M.confusion_matrix(df, "label", "pred")).first().sensitivity is None


def test_winner_of_an_unknown_model_is_a_tie(spark):
    base = spark.createDataFrame([("a", 0.7), ("b", 0.7)], "Model string, Test_AUC double")
    other = spark.createDataFrame([("a", 0.8), ("b", 0.6), ("c", 0.9)], "Model string, Test_AUC double")
    assert rows(M.model_delta(base, other).select("Model", "Delta", "Winner")) == [
        ("a", 0.1, "BERT"),
        ("b", -0.1, "TF-IDF"),
        ("c", None, "TIE"),
    ]


def test_selection_takes_the_first_name_on_a_tie(spark):
    data = [("b", 0.95, 0.8), ("a", 0.87, 0.8), ("c", 0.8, 0.79)]
    out = M.model_selection(spark.createDataFrame(data, "Model string, Train_AUC double, Test_AUC double")).orderBy("rank").collect()
    assert [(r.Model, r.role, r.tier) for r in out] == [("a", "best", "slight overfitting"), ("b", "runner-up", "overfitting")]


def by_hand(ids, label, seed=42):
    import hashlib

    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))
    classes = {}
    for i in order:
        classes.setdefault(label(i), []).append(i)
    return classes


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_and_folds_equal_a_plain_ranking(spark, digits):
    def label(i):
        return None if i % 7 == 0 else "rare" if i % 50 == 1 else "common"

    df = spark.createDataFrame([(i, label(i)) for i in range(1000)], "id int, label string")
    classes = by_hand(range(1000), label)
    test = {i for ids in classes.values() for i in ids[: math.ceil(0.2 * len(ids))]}
    for parts in (1, 5):
        out = S.stratified_split(df.repartition(parts), "id", "label", digits=digits)
        assert out.count() == 1000
        assert {r.id for r in out.where("split = 'test'").collect()} == test
    known = df.where("label IS NOT NULL")
    folds = {r.id: r.fold for r in S.stratified_folds(known, "id", "label", 5, digits=digits).collect()}
    assert folds == {i: place % 5 for name, ids in classes.items() if name for place, i in enumerate(ids)}
