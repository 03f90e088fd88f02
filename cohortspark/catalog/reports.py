"""Composite jobs: alignment, labels, and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.catalog.metrics import sql_auc, sql_confusion
from cohortspark.catalog.registry import query
from cohortspark.catalog.relational import _SUMMARY_SQL as SUMMARY_SQL
from cohortspark.catalog.views import quoted, sql_list, with_views
from cohortspark.operators import metrics as M
from cohortspark.plans import align as AL
from cohortspark.plans import labeling as L
from cohortspark.plans import reports as R


def r6(col):
    return F.round(col, 6)


def _predictions(spark, sf):
    return M.prediction_table(W.predictions(spark, sf), "Patient_ID", "label", "probability")


def _texts(spark, sf):
    """The cleaned report per patient; file names make the documents unique."""
    docs = W.clean_documents(spark, sf)
    return docs.select(W.pid("doc_id").alias("Patient_ID"), "clean_text")


@query(
    "align_merged",
    with_views(
        f"""WITH {SUMMARY_SQL}, first AS (SELECT patient_filename, Patient_ID, md5(text) AS digest FROM
          (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY row_order) AS rn FROM v_reports) WHERE rn = 1)
        SELECT *, substr(Patient_ID, 1, 7) AS Cohort FROM first JOIN summary USING (Patient_ID)"""
    ),
)
def align_merged(spark, sf):
    merged = AL.align(W.mutations(spark, sf), W.reports(spark, sf))
    return merged.withColumn("digest", F.md5("text")).drop("text")


@query(
    "patient_labels",
    with_views("SELECT Patient_ID, Mutation_Status, targetable_genes, n_mutations, all_mutated_genes FROM v_labels"),
)
def patient_labels(spark, sf):
    return L.stored_labels(W.labels(spark, sf))


_FOLLOW = " ".join(f"WHEN {quoted(s)} THEN {quoted(t)}" for s, t in C.FOLLOW_UP.items())


@query(
    "patient_report",
    with_views(
        f"""WITH j AS (SELECT * FROM v_prediction_table LEFT JOIN v_labels USING (Patient_ID)),
        m AS (SELECT max(n_mutations) AS largest FROM j)
        SELECT Patient_ID, Predicted_Class, Confidence_Score AS Confidence, Mutation_Status AS True_Mutation_Status,
          targetable_genes AS Targetable_Genes, n_mutations AS N_Mutations,
          CASE Mutation_Status {_FOLLOW} END || CASE WHEN Confidence_Score BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE
            THEN {quoted(C.LOW_CONFIDENCE_NOTE)} ELSE '' END AS Follow_Up_Decision,
          round_even(coalesce((Mutation_Status = '{C.TARGETABLE}')::INTEGER, 0) * 0.5::DOUBLE + Confidence_Score * 0.3::DOUBLE
            + n_mutations / largest::DOUBLE * 0.2::DOUBLE, 4) AS Priority_Score FROM j, m"""
    ),
)
def patient_report(spark, sf):
    return R.patient_report(_predictions(spark, sf), L.stored_labels(W.labels(spark, sf)))


_GENE_CASE = " ".join(f"WHEN '{g}' THEN '{d}'" for g, d in W.DRUGS.items())
_GENES_SQL = f"""cells AS (SELECT gene, substr(Patient_ID, 1, 7) AS cohort, count(*) AS n FROM v_genes
    WHERE gene IN {sql_list(W.TARGETABLE)} GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, cohort) AS rn FROM cells),
  genes AS (SELECT gene AS Gene, sum(n)::BIGINT AS N_Patients_Mutated,
      round(sum(n) * 100.0::DOUBLE / (SELECT count(*) FROM v_labels), 2) AS Pct_of_Cohort,
      string_agg(cohort || '(' || n || ')', ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS Top_3_Cancer_Types,
      CASE gene {_GENE_CASE} ELSE '{C.DEFAULT_DRUG}' END AS Recommended_Drug FROM best GROUP BY gene)"""


@query("gene_report", with_views(f"WITH {_GENES_SQL} SELECT * FROM genes"))
def gene_report(spark, sf):
    return R.gene_report(W.labels(spark, sf), W.DRUGS)


_COHORTS_SQL = f"""s AS (SELECT substr(Patient_ID, 1, 7) AS ct, True_Label AS label, Confidence_Score AS score,
      (Confidence_Score >= 0.5::DOUBLE)::INTEGER AS hard FROM v_prediction_table),
  a AS ({sql_auc('ct', 's')}), c AS ({sql_confusion('ct', 's', 'label', 'hard')}),
  cohorts AS (SELECT ct AS Cancer_Type, n_pos + n_neg AS N_Patients, n_pos AS N_Targetable, n_neg AS N_Non_Targetable,
      round(n_pos * 100.0::DOUBLE / (n_pos + n_neg), 1) AS Targetable_Rate, round(auc, 4) AS AUC,
      round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 4) AS F1_Targetable
    FROM a JOIN c USING (ct) WHERE n_pos + n_neg >= {C.MIN_COHORT_SIZE})"""


@query("cohort_report", with_views(f"WITH {_COHORTS_SQL} SELECT * FROM cohorts"))
def cohort_report(spark, sf):
    return R.cohort_report(_predictions(spark, sf))


_TOP_COHORTS_SQL = f"""top AS (SELECT Cancer_Type, Targetable_Rate, N_Patients,
    row_number() OVER (ORDER BY Targetable_Rate DESC, Cancer_Type)::INTEGER AS rank FROM
  (SELECT * FROM cohorts WHERE N_Patients >= {C.MIN_PREVALENCE_COHORT_SIZE} ORDER BY Targetable_Rate DESC, Cancer_Type LIMIT 10))"""


@query("top_prevalence", with_views(f"WITH {_COHORTS_SQL}, {_TOP_COHORTS_SQL} SELECT * FROM top"))
def top_prevalence(spark, sf):
    return R.top_prevalence(R.cohort_report(_predictions(spark, sf)))


_ERRORS_SQL = f"""errors AS (SELECT p.Patient_ID, CASE WHEN True_Label = 1 THEN {quoted(C.FALSE_NEGATIVE)} ELSE {quoted(C.FALSE_POSITIVE)} END AS Error_Type,
    Mutation_Status, targetable_genes, Confidence_Score, substr(p.Patient_ID, 1, 7) AS Cancer_Type, substr(clean_text, 1, 200) AS Report_Excerpt
  FROM v_prediction_table p LEFT JOIN v_labels l ON p.Patient_ID = l.Patient_ID
  LEFT JOIN (SELECT {W.sql_pid('doc_id')} AS Patient_ID, clean_text FROM v_clean) t ON p.Patient_ID = t.Patient_ID
  WHERE True_Label <> Predicted)"""


@query("error_report", with_views(f"WITH {_ERRORS_SQL} SELECT * FROM errors"))
def error_report(spark, sf):
    return R.error_report(_predictions(spark, sf), L.stored_labels(W.labels(spark, sf)), _texts(spark, sf))


@query(
    "worst_misses",
    with_views(
        f"""WITH {_ERRORS_SQL} SELECT Patient_ID, Confidence_Score, targetable_genes,
          row_number() OVER (ORDER BY Confidence_Score, Patient_ID)::INTEGER AS rank FROM
        (SELECT * FROM errors WHERE Error_Type = {quoted(C.FALSE_NEGATIVE)} ORDER BY Confidence_Score, Patient_ID LIMIT 5)"""
    ),
)
def worst_misses(spark, sf):
    errors = R.error_report(_predictions(spark, sf), L.stored_labels(W.labels(spark, sf)), _texts(spark, sf))
    return R.worst_misses(errors).select("Patient_ID", "Confidence_Score", "targetable_genes", "rank")


@query(
    "clinical_summary",
    with_views(
        f"""WITH {_GENES_SQL}, {_COHORTS_SQL}, {_TOP_COHORTS_SQL},
        o AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (WHERE Mutation_Status = '{C.TARGETABLE}'))::DOUBLE AS benefit FROM v_labels),
        k AS (SELECT count(DISTINCT substr(Patient_ID, 1, 7)) AS n_cohorts, count(*) FILTER (WHERE Confidence_Score BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE) AS low FROM v_prediction_table),
        q AS ({sql_confusion('', 'v_prediction_table', 'True_Label', 'Predicted')}),
        u AS ({sql_auc('', '(SELECT True_Label AS label, Probability AS score FROM v_prediction_table)')}),
        one AS (SELECT * FROM o, k, q, (SELECT auc FROM u)),
        figures AS (SELECT unnest([
          {{'section': 'COHORT OVERVIEW', 'ord': 0, 'metric': 'Total patients processed', 'value': total::DOUBLE}},
          {{'section': 'COHORT OVERVIEW', 'ord': 1, 'metric': 'Patients with targetable mutations', 'value': benefit::DOUBLE}},
          {{'section': 'COHORT OVERVIEW', 'ord': 2, 'metric': 'Patients without targetable muts', 'value': (total - benefit)::DOUBLE}},
          {{'section': 'COHORT OVERVIEW', 'ord': 3, 'metric': 'Targetable percentage', 'value': benefit * 100.0::DOUBLE / total}},
          {{'section': 'COHORT OVERVIEW', 'ord': 4, 'metric': 'Unique cancer types', 'value': n_cohorts::DOUBLE}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 5, 'metric': 'AUC-ROC', 'value': auc}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 6, 'metric': 'Accuracy', 'value': (tp + tn)::DOUBLE / (tn + fp + fn + tp)}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 7, 'metric': 'Sensitivity', 'value': tp::DOUBLE / (tp + fn)}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 8, 'metric': 'Specificity', 'value': tn::DOUBLE / (tn + fp)}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 9, 'metric': 'False Negative Rate', 'value': 1 - tp::DOUBLE / (tp + fn)}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 10, 'metric': 'False Positive Rate', 'value': 1 - tn::DOUBLE / (tn + fp)}},
          {{'section': 'CLINICAL IMPACT', 'ord': 11, 'metric': 'Patients correctly identified', 'value': tp::DOUBLE}},
          {{'section': 'CLINICAL IMPACT', 'ord': 12, 'metric': 'Identified percentage', 'value': tp * 100.0::DOUBLE / benefit}},
          {{'section': 'CLINICAL IMPACT', 'ord': 13, 'metric': 'Patients missed', 'value': fn::DOUBLE}},
          {{'section': 'CLINICAL IMPACT', 'ord': 14, 'metric': 'Unnecessary referrals', 'value': fp::DOUBLE}},
          {{'section': 'CLINICAL IMPACT', 'ord': 15, 'metric': 'Low-confidence predictions', 'value': low::DOUBLE}},
          {{'section': 'COHORT OVERVIEW', 'ord': 16, 'metric': 'Percentage without targetable muts', 'value': (total - benefit) * 100.0::DOUBLE / total}},
          {{'section': 'MODEL PERFORMANCE', 'ord': 17, 'metric': 'Model type', 'value': NULL::DOUBLE}}], recursive := true) FROM one)
        SELECT section, ord::INTEGER AS ord, metric, round_even(value, 4) AS value,
          CASE WHEN metric = 'Model type' THEN 'LogisticRegressionModel' END AS detail FROM figures
        UNION ALL SELECT 'TOP 5 MOST ACTIONABLE GENES IN COHORT', row_number() OVER (ORDER BY N_Patients_Mutated DESC, Gene)::INTEGER,
          Gene || ' -> ' || Recommended_Drug, N_Patients_Mutated::DOUBLE, printf('%.2f%%', Pct_of_Cohort) FROM (SELECT * FROM genes ORDER BY N_Patients_Mutated DESC, Gene LIMIT 5)
        UNION ALL SELECT 'TARGETABLE MUTATION PREVALENCE BY CANCER TYPE', rank, Cancer_Type, Targetable_Rate, 'n=' || N_Patients FROM top"""
    ),
)
def clinical_summary(spark, sf):
    labels, predictions = W.labels(spark, sf), _predictions(spark, sf)
    return R.clinical_summary(predictions, labels, R.gene_report(labels, W.DRUGS), R.cohort_report(predictions), "LogisticRegressionModel")
