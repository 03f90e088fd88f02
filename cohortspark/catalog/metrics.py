"""Metrics, splits and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.catalog.registry import query
from cohortspark.catalog.views import with_views
from cohortspark.functions import values as V
from cohortspark.functions.ids import cohort
from cohortspark.functions.text import has_gene
from cohortspark.operators import huber as H
from cohortspark.operators import metrics as M
from cohortspark.operators import splits as S
from cohortspark.operators import training as T
from cohortspark.plans.scoring import likely_genes


def r6(col):
    return F.round(col, 6)


def sql_auc(by: str, source: str, label: str = "label", score: str = "score") -> str:
    """AUC per group by the rank formula; `by` is a comma-separated list or empty."""
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {cols}n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN
        (ranks - n_pos::DOUBLE * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg) END AS auc FROM
      (SELECT {cols}sum({label})::BIGINT AS n_pos, sum(1 - {label})::BIGINT AS n_neg, sum(CASE WHEN {label} = 1 THEN r END)::DOUBLE AS ranks
       FROM (SELECT {cols}{label}, rank() OVER ({part}ORDER BY {score})
               + (count(*) OVER (PARTITION BY {cols}{score}) - 1) / 2.0::DOUBLE AS r FROM {source}) {group})"""


def sql_confusion(by: str, source: str, label: str, pred: str) -> str:
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {cols}count(*) FILTER (WHERE {label} = 0 AND {pred} = 0) AS tn,
      count(*) FILTER (WHERE {label} = 0 AND {pred} = 1) AS fp, count(*) FILTER (WHERE {label} = 1 AND {pred} = 0) AS fn,
      count(*) FILTER (WHERE {label} = 1 AND {pred} = 1) AS tp FROM {source} {group}"""


def _hard(spark, sf):
    return W.scored(spark, sf).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


_HARD_SQL = "(SELECT *, (score > 0.5)::INTEGER AS prediction FROM v_scored)"


@query(
    "prediction_table",
    with_views("SELECT * EXCLUDE (Probability), round(Probability, 6) AS Probability FROM v_prediction_table"),
)
def prediction_table(spark, sf):
    out = M.prediction_table(W.predictions(spark, sf), "Patient_ID", "label", "probability")
    return out.withColumn("Probability", r6(F.col("Probability")))


@query("confusion_matrix", with_views(sql_confusion("grp", _HARD_SQL, "label", "prediction")))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_hard(spark, sf), "label", "prediction", by=["grp"])


@query("auc_global", with_views(f"SELECT round(auc, 6) AS auc, n_pos, n_neg FROM ({sql_auc('', 'v_scored')})"))
def auc_global(spark, sf):
    return M.auc(W.scored(spark, sf), "label", "score").withColumn("auc", r6(F.col("auc")))


@query("auc_by_group", with_views(f"SELECT grp, round(auc, 6) AS auc, n_pos, n_neg FROM ({sql_auc('grp', 'v_scored')})"))
def auc_by_group(spark, sf):
    return M.auc(W.scored(spark, sf), "label", "score", by=["grp"]).withColumn("auc", r6(F.col("auc")))


@query(
    "binary_rates",
    with_views(
        f"""WITH c AS ({sql_confusion('grp', _HARD_SQL, 'label', 'prediction')})
        SELECT grp, round((tp + tn)::DOUBLE / (tn + fp + fn + tp), 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sensitivity,
          round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round(1 - tp::DOUBLE / nullif(tp + fn, 0), 6) AS fnr,
          round(1 - tn::DOUBLE / nullif(tn + fp, 0), 6) AS fpr FROM c"""
    ),
)
def binary_rates(spark, sf):
    rates = M.binary_rates(M.confusion_matrix(_hard(spark, sf), "label", "prediction", by=["grp"]))
    return rates.select("grp", *[r6(F.col(c)).alias(c) for c in ("accuracy", "sensitivity", "specificity", "fnr", "fpr")])


@query(
    "precision_recall_f1",
    with_views(
        f"""WITH c AS ({sql_confusion('grp', _HARD_SQL, 'label', 'prediction')})
        SELECT grp, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
          round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""
    ),
)
def precision_recall_f1(spark, sf):
    out = M.precision_recall_f1(M.confusion_matrix(_hard(spark, sf), "label", "prediction", by=["grp"]))
    return out.select("grp", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


_ROC_SQL = """c AS (SELECT side, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM v_scored GROUP BY ALL),
  t AS (SELECT side, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM c GROUP BY side),
  p AS (SELECT side, score, pos, neg, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp,
          lead(pos) OVER (PARTITION BY side ORDER BY score DESC) AS next_pos, lead(neg) OVER (PARTITION BY side ORDER BY score DESC) AS next_neg,
          row_number() OVER (PARTITION BY side ORDER BY score DESC) AS rn
        FROM c WINDOW w AS (PARTITION BY side ORDER BY score DESC)),
  pts AS (SELECT side, NULL::DOUBLE AS threshold, 0 AS fp, 0 AS tp, true AS kept FROM t
          UNION ALL SELECT side, score, fp, tp, rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg FROM p)"""
_ROC_COLUMNS = """side, threshold, fp::BIGINT AS fp, tp::BIGINT AS tp, round(fp / n_neg::DOUBLE, 6) AS fpr, round(tp / n_pos::DOUBLE, 6) AS tpr
  FROM pts JOIN t USING (side)"""


def _roc(spark, sf, prune):
    out = M.roc_curve(W.scored(spark, sf), "label", "score", by=["side"], prune=prune)
    return out.withColumn("fpr", r6(F.col("fpr"))).withColumn("tpr", r6(F.col("tpr")))


@query("roc_curve", with_views(f"WITH {_ROC_SQL} SELECT {_ROC_COLUMNS}"))
def roc_curve(spark, sf):
    return _roc(spark, sf, prune=False)


@query("roc_curve_pruned", with_views(f"WITH {_ROC_SQL} SELECT {_ROC_COLUMNS} WHERE kept"))
def roc_curve_pruned(spark, sf):
    return _roc(spark, sf, prune=True)


@query(
    "classification_report",
    with_views(
        f"""WITH c AS ({sql_confusion('', _HARD_SQL, 'label', 'prediction')}),
        k AS (SELECT 0 AS ord, 'Non-Targetable' AS class, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS p,
                coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS r, coalesce(2 * tn::DOUBLE / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s FROM c
              UNION ALL SELECT 1, 'Targetable', coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0),
                coalesce(2 * tp::DOUBLE / nullif(2 * tp + fn + fp, 0), 0), fn + tp FROM c),
        a AS (SELECT * FROM k
              UNION ALL SELECT 2, 'accuracy', NULL, NULL, (tp + tn)::DOUBLE / (tn + fp + fn + tp), tn + fp + fn + tp FROM c
              UNION ALL SELECT 3, 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM k
              UNION ALL SELECT 4, 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM k)
        SELECT ord, class, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(f, 4) AS f1, s::BIGINT AS support FROM a"""
    ),
)
def classification_report(spark, sf):
    return M.classification_report(_hard(spark, sf), "label", "prediction")


@query(
    "stratified_split",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS rn,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM o""",
)
def stratified_split(spark, sf):
    orders = W.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_split(orders, "o_orderkey", "o_orderstatus")


@query(
    "stratified_folds",
    """SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus
      ORDER BY md5(o_orderkey || ':42'), o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders""",
)
def stratified_folds(spark, sf):
    orders = W.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_folds(orders, "o_orderkey", "o_orderstatus")


_PAIR_SQL = """pair AS (SELECT vec_id, quality AS label, 1 / (1 + exp(-10 * embedding[1]::DOUBLE)) AS a, 1 / (1 + exp(-10 * embedding[2]::DOUBLE)) AS b
  FROM embeddings JOIN labels ON vec_id = doc_id)"""


def _pair(spark, sf):
    """Two model scores per id that has a label."""
    vectors, labels = W.table(spark, sf, "embeddings"), W.table(spark, sf, "labels")
    sides = {"a": 0, "b": 1}
    joined = vectors.join(labels, F.col("vec_id") == F.col("doc_id")).select(
        "vec_id",
        F.col("quality").alias("label"),
        *[(1 / (1 + F.exp(-10 * F.col("embedding")[i].cast("double")))).alias(name) for name, i in sides.items()],
    )
    return [joined.select("vec_id", "label", F.col(name).alias("score")) for name in sides]


@query("soft_vote", f"WITH {_PAIR_SQL} SELECT vec_id, label, round((a + b) / 2, 6) AS score FROM pair")
def soft_vote(spark, sf):
    a, b = _pair(spark, sf)
    return M.soft_vote(a.unionAll(b), "vec_id", "label", "score").withColumn("score", r6(F.col("score")))


@query(
    "ensemble_comparison",
    f"""WITH {_PAIR_SQL}, s AS (SELECT 'TF-IDF (LR)' AS Model, label, a AS score FROM pair
        UNION ALL SELECT 'BERT (LR)', label, b FROM pair UNION ALL SELECT 'Ensemble (avg)', label, (a + b) / 2 FROM pair)
    SELECT Model, round_even(auc, 4) AS AUC FROM ({sql_auc('Model', 's')})""",
)
def ensemble_comparison(spark, sf):
    a, b = _pair(spark, sf)
    return M.ensemble_comparison(a, b, "vec_id", "label", "score", names=("TF-IDF (LR)", "BERT (LR)"))


def _results(spark, sf, score):
    """Train and test AUC of one "model" per line number, the train side being the open lines."""
    source = W.scored(spark, sf).select(F.concat(F.lit("model "), F.col("model")).alias("Model"), "side", "label", score)
    aucs = M.auc(source, "label", score, by=["Model", "side"])
    return aucs.groupBy("Model").agg(
        V.round_even(F.max(F.when(F.col("side") == "O", F.col("auc"))), 4).alias("Train_AUC"),
        V.round_even(F.max(F.when(F.col("side") == "F", F.col("auc"))), 4).alias("Test_AUC"),
    )


def _sql_results(source: str, score: str) -> str:
    return f"""(SELECT Model, round_even(max(auc) FILTER (WHERE side = 'O'), 4) AS Train_AUC, round_even(max(auc) FILTER (WHERE side = 'F'), 4) AS Test_AUC
      FROM ({sql_auc('Model, side', f"(SELECT 'model ' || model AS Model, side, label, score FROM {source})", score=score)}) GROUP BY Model)"""


@query(
    "model_selection",
    with_views(
        f"""WITH top AS (SELECT * FROM {_sql_results('v_scored', 'score')} ORDER BY Test_AUC DESC NULLS LAST, Model LIMIT 2),
        r AS (SELECT *, (row_number() OVER (ORDER BY Test_AUC DESC NULLS LAST, Model))::INTEGER AS rank, Train_AUC - Test_AUC AS g FROM top)
        SELECT rank, CASE WHEN rank = 1 THEN 'best' ELSE 'runner-up' END AS role, Model, Train_AUC, Test_AUC, round(g, 6) AS gap,
          CASE WHEN g > 0.10::DOUBLE THEN 'overfitting' WHEN g > 0.05::DOUBLE THEN 'slight overfitting' ELSE 'good generalization' END AS tier FROM r"""
    ),
)
def model_selection(spark, sf):
    return M.model_selection(_results(spark, sf, "score")).withColumn("gap", r6(F.col("gap")))


@query(
    "model_delta",
    with_views(
        f"""WITH o AS (SELECT * FROM {_sql_results('v_scored', 'score')}),
        b AS (SELECT * FROM {_sql_results("(SELECT CASE WHEN model = 7 THEN 'retired' ELSE model::VARCHAR END AS model, side, label, floor(score * 4) AS score FROM v_scored)", 'score')})
        SELECT Model, b.Test_AUC AS "TF-IDF_AUC", o.Test_AUC AS BERT_AUC, round(round_even(o.Test_AUC - b.Test_AUC, 4), 6) AS Delta,
          CASE WHEN round_even(o.Test_AUC - b.Test_AUC, 4) > 0 THEN 'BERT' WHEN round_even(o.Test_AUC - b.Test_AUC, 4) < 0 THEN 'TF-IDF' ELSE 'TIE' END AS Winner
        FROM o LEFT JOIN b USING (Model)"""
    ),
)
def model_delta(spark, sf):
    """A coarser score of the same models, one of which goes by another name there."""
    coarse = W.scored(spark, sf).withColumn("score", F.floor(F.col("score") * 4).cast("double"))
    name = F.when(F.col("model") == 7, "retired").otherwise(F.col("model").cast("string"))
    aucs = M.auc(coarse.withColumn("Model", F.concat(F.lit("model "), name)), "label", "score", by=["Model", "side"])
    base = aucs.groupBy("Model").agg(
        V.round_even(F.max(F.when(F.col("side") == "F", F.col("auc"))), 4).alias("Test_AUC")
    )
    return M.model_delta(base, _results(spark, sf, "score")).withColumn("Delta", r6(F.col("Delta")))


@query(
    "format_mean_std",
    with_views(
        f"""WITH f AS (SELECT 'model ' || model AS Model, auc FROM ({sql_auc('model, grp', 'v_scored')})),
        s AS (SELECT Model, round_even(avg(auc), 4) AS m, round_even(stddev_pop(auc), 4) AS d FROM f GROUP BY Model)
        SELECT Model, m AS CV_AUC_mean, d AS CV_AUC_std, printf('%.4f+/-%.4f', m, d) AS CV_AUC FROM s"""
    ),
)
def format_mean_std(spark, sf):
    named = W.scored(spark, sf).withColumn("Model", F.concat(F.lit("model "), "model"))
    return T.cv_summary(M.auc(named, "label", "score", by=["Model", "grp"]))


@query(
    "likely_genes_topk",
    """SELECT vec_id, Gene, probability, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, Gene)::INTEGER AS rank FROM
      (SELECT vec_id, 'G' || i AS Gene, round_even(1 / (1 + exp(-10 * x::DOUBLE)), 3) AS probability, 1 / (1 + exp(-10 * x::DOUBLE)) AS p
       FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) WHERE p >= 0.3) WHERE rank <= 5""",
)
def likely_genes_topk(spark, sf):
    dims = W.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    probability = 1 / (1 + F.exp(-10 * F.col("x").cast("double")))
    long = dims.select("vec_id", F.concat(F.lit("G"), "i").alias("Gene"), probability.alias("probability"))
    return likely_genes(long, "vec_id").select("vec_id", "Gene", "probability", "rank")


@query(
    "huber_loss_table",
    with_views(
        """WITH m AS (SELECT label, score, (2 * label - 1) * (6 * score - 3) AS m, 6 * score - 3 AS f, count(*) AS n FROM v_scored GROUP BY ALL)
        SELECT label, score, n, round(CASE WHEN m >= 1 THEN 0 WHEN m >= -1 THEN (1 - m) * (1 - m) ELSE -4 * m END, 6) AS loss,
          round((greatest(least(f, 1.0::DOUBLE), -1.0::DOUBLE) + 1) / 2, 6) AS probability FROM m"""
    ),
)
def huber_loss_table(spark, sf):
    counts = W.scored(spark, sf).groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    decision = 6 * F.col("score") - 3
    margin = (2 * F.col("label") - 1) * decision
    return counts.select(
        "label",
        "score",
        "n",
        r6(H.loss_column(margin)).alias("loss"),
        r6(H.probability_column(decision)).alias("probability"),
    )


@query(
    "gene_label_counts",
    with_views(
        f"""SELECT 'GENE' || class AS Gene, count(*) AS N_Positive, (SELECT count(*) FROM v_vectors) - count(*) AS N_Negative,
        count(*) >= {C.MIN_GENE_POSITIVES} AS eligible FROM v_vectors GROUP BY class"""
    ),
)
def gene_label_counts(spark, sf):
    return T.gene_label_counts(W.vectors(spark, sf), gene_flags())


def gene_flags():
    return {f"GENE{i}": has_gene(F.col("targetable_genes"), f"GENE{i}") for i in range(10)}


@query(
    "cohort_eligibility",
    with_views(
        f"""WITH c AS (SELECT substr(Patient_ID, 1, 7) AS cohort, count(*) AS N_Patients, sum(label)::BIGINT AS N_Tgt FROM v_predictions GROUP BY 1)
        SELECT *, N_Patients >= {C.MIN_COHORT_MODEL_SIZE} AND N_Tgt >= {C.MIN_COHORT_MODEL_CLASS}
          AND N_Patients - N_Tgt >= {C.MIN_COHORT_MODEL_CLASS} AS eligible FROM c"""
    ),
)
def cohort_eligibility(spark, sf):
    named = W.predictions(spark, sf).withColumn("cohort", cohort(F.col("Patient_ID")))
    return T.cohort_eligibility(named, "cohort", "label")
