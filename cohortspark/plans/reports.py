"""Patient, gene, cohort and error reports, and the summary over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import ids as I
from cohortspark.functions import text as X
from cohortspark.functions import values as V
from cohortspark.operators import metrics as M
from cohortspark.operators.dedup import ranked_limit, topk_per_group
from cohortspark.session import stored

STATUS_RANK = {status: i for i, status in enumerate(C.STATUS_ORDER)}


def patient_report(predictions: DataFrame, labels: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per prediction with status, genes, follow-up and priority; urgent and confident ones first.

    `labels` is the flat label table. A patient without label keeps NULL there.
    """
    joined = predictions.select("Patient_ID", "Predicted_Class", "Confidence_Score").join(
        labels.select("Patient_ID", "Mutation_Status", "targetable_genes", "n_mutations"), "Patient_ID", "left"
    )
    # the largest gene count among the reported patients: one row, broadcast
    largest = joined.agg(F.max("n_mutations").alias("_max"))
    status, confidence = F.col("Mutation_Status"), F.col("Confidence_Score")
    report = joined.crossJoin(F.broadcast(largest)).select(
        "Patient_ID",
        "Predicted_Class",
        confidence.alias("Confidence"),
        status.alias("True_Mutation_Status"),
        F.col("targetable_genes").alias("Targetable_Genes"),
        F.col("n_mutations").alias("N_Mutations"),
        V.follow_up(status, confidence).alias("Follow_Up_Decision"),
        V.priority_score(status, confidence, F.col("n_mutations"), F.col("_max")).alias("Priority_Score"),
    )
    if not ordered:
        return report
    rank = V.value_map(F.col("True_Mutation_Status"), STATUS_RANK)
    return report.orderBy(rank.asc_nulls_last(), F.col("Confidence").desc_nulls_last(), "Patient_ID")


def gene_report(labels: DataFrame, drugs: Mapping[str, str] = C.DRUG_MAP, top: int = 3) -> DataFrame:
    """Per target gene: patients, share of all patients, top cohorts as text, drug.

    `labels` has one row per patient with the array of target genes. Counting goes
    by (gene, cohort) first; everything after works on that small table.
    """
    total = labels.agg(F.count(F.lit(1)).alias("_total"))
    cells = (
        labels.select(I.cohort(F.col("Patient_ID")).alias("_cohort"), F.explode("targetable_genes").alias("Gene"))
        .groupBy("Gene", "_cohort")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    genes = cells.groupBy("Gene").agg(F.sum("_n").alias("N_Patients_Mutated"))
    best = topk_per_group(cells, "Gene", [F.col("_n").desc(), F.col("_cohort")], top, rank="_place")
    listed = F.sort_array(F.collect_list(F.struct("_place", F.format_string("%s(%d)", "_cohort", "_n").alias("text"))))
    texts = best.groupBy("Gene").agg(
        F.array_join(F.transform(listed, lambda c: c["text"]), ", ").alias("Top_3_Cancer_Types")
    )
    return (
        genes.join(texts, "Gene")
        .crossJoin(F.broadcast(total))
        .select(
            "Gene",
            "N_Patients_Mutated",
            F.round(V.percent(F.col("N_Patients_Mutated"), F.col("_total")), 2).alias("Pct_of_Cohort"),
            "Top_3_Cancer_Types",
            V.value_map(F.col("Gene"), drugs, F.lit(C.DEFAULT_DRUG)).alias("Recommended_Drug"),
        )
        .orderBy(F.col("N_Patients_Mutated").desc(), "Gene")
    )


def cohort_report(predictions: DataFrame, min_size: int = C.MIN_COHORT_SIZE) -> DataFrame:
    """Per cohort of at least `min_size` patients: sizes, rate, AUC and F1 on the rounded confidence."""
    scored = predictions.select(
        I.cohort(F.col("Patient_ID")).alias("Cancer_Type"),
        "True_Label",
        "Confidence_Score",
        (F.col("Confidence_Score") >= 0.5).cast("int").alias("_hard"),
    )
    scored = stored(scored, "cohort-scores")  # four narrow columns; both metrics read them, labels are made once
    confusion = M.precision_recall_f1(M.confusion_matrix(scored, "True_Label", "_hard", by=["Cancer_Type"]))
    # four-digit scores: a cohort has at most 10,001 distinct ones, so no cut is needed
    aucs = M.auc(scored, "True_Label", "Confidence_Score", by=["Cancer_Type"], cuts=[])
    n = F.col("n_pos") + F.col("n_neg")
    return (
        aucs.where(n >= min_size)
        .join(confusion.select("Cancer_Type", "f1"), "Cancer_Type")
        .select(
            "Cancer_Type",
            n.alias("N_Patients"),
            F.col("n_pos").alias("N_Targetable"),
            F.col("n_neg").alias("N_Non_Targetable"),
            F.round(V.percent(F.col("n_pos"), n), 1).alias("Targetable_Rate"),
            F.round("auc", 4).alias("AUC"),
            F.round("f1", 4).alias("F1_Targetable"),
        )
        .orderBy(F.col("N_Patients").desc(), "Cancer_Type")
    )


def top_prevalence(cohorts: DataFrame, min_size: int = C.MIN_PREVALENCE_COHORT_SIZE, k: int = 10) -> DataFrame:
    """The k cohorts of some size with the highest targetable rate."""
    large = cohorts.where(F.col("N_Patients") >= min_size).select("Cancer_Type", "Targetable_Rate", "N_Patients")
    return ranked_limit(large, [F.col("Targetable_Rate").desc(), F.col("Cancer_Type")], k)


def error_report(predictions: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Missed and over-referred patients with an excerpt of their report.

    Only the errors are joined, so the wide side of the text join is the text table alone.
    """
    wrong = predictions.where(F.col("True_Label") != F.col("Predicted"))
    kind = F.when(F.col("True_Label") == 1, C.FALSE_NEGATIVE).otherwise(C.FALSE_POSITIVE)
    excerpts = texts.select("Patient_ID", X.excerpt(F.col("clean_text")).alias("Report_Excerpt"))
    return (
        wrong.join(labels.select("Patient_ID", "Mutation_Status", "targetable_genes"), "Patient_ID", "left")
        .join(excerpts, "Patient_ID", "left")
        .select(
            "Patient_ID",
            kind.alias("Error_Type"),
            "Mutation_Status",
            "targetable_genes",
            "Confidence_Score",
            I.cohort(F.col("Patient_ID")).alias("Cancer_Type"),
            "Report_Excerpt",
        )
    )


def worst_misses(errors: DataFrame, k: int = 5) -> DataFrame:
    """The false negatives with the lowest confidence."""
    missed = errors.where(F.col("Error_Type") == C.FALSE_NEGATIVE)
    return ranked_limit(missed, [F.col("Confidence_Score").asc_nulls_last(), F.col("Patient_ID")], k)


def clinical_summary(
    predictions: DataFrame, labels: DataFrame, genes: DataFrame, cohorts: DataFrame, model_type: str | None = None
) -> DataFrame:
    """(section, ord, metric, value, detail): the figures of the summary report.

    `predictions` has probability, confidence and prediction; `labels` arrays or flat. `detail` is what
    stands beside a figure: the kind of the model, the share of patients of a gene, the size of a cohort.
    """
    overview = labels.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum((F.col("Mutation_Status") == C.TARGETABLE).cast("long")), F.lit(0)).alias("benefit"),
    )
    low = F.coalesce(F.sum(V.is_low_confidence(F.col("Confidence_Score")).cast("long")), F.lit(0))
    counted = predictions.agg(
        F.count_distinct(I.cohort(F.col("Patient_ID"))).alias("n_cohorts"), low.alias("low_confidence")
    )
    rates = M.binary_rates(M.confusion_matrix(predictions, "True_Label", "Predicted"))
    area = M.auc(predictions, "True_Label", "Probability").select("auc")
    one = overview.crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(area))
    figures = [
        ("COHORT OVERVIEW", "Total patients processed", F.col("total")),
        ("COHORT OVERVIEW", "Patients with targetable mutations", F.col("benefit")),
        ("COHORT OVERVIEW", "Patients without targetable muts", F.col("total") - F.col("benefit")),
        ("COHORT OVERVIEW", "Targetable percentage", V.percent(F.col("benefit"), F.col("total"))),
        ("COHORT OVERVIEW", "Unique cancer types", F.col("n_cohorts")),
        ("MODEL PERFORMANCE", "AUC-ROC", F.col("auc")),
        ("MODEL PERFORMANCE", "Accuracy", F.col("accuracy")),
        ("MODEL PERFORMANCE", "Sensitivity", F.col("sensitivity")),
        ("MODEL PERFORMANCE", "Specificity", F.col("specificity")),
        ("MODEL PERFORMANCE", "False Negative Rate", F.col("fnr")),
        ("MODEL PERFORMANCE", "False Positive Rate", F.col("fpr")),
        ("CLINICAL IMPACT", "Patients correctly identified", F.col("tp")),
        ("CLINICAL IMPACT", "Identified percentage", V.percent(F.col("tp"), F.col("benefit"))),
        ("CLINICAL IMPACT", "Patients missed", F.col("fn")),
        ("CLINICAL IMPACT", "Unnecessary referrals", F.col("fp")),
        ("CLINICAL IMPACT", "Low-confidence predictions", F.col("low_confidence")),
        ("COHORT OVERVIEW", "Percentage without targetable muts", V.percent(F.col("total") - F.col("benefit"), F.col("total"))),
        ("MODEL PERFORMANCE", "Model type", F.lit(None)),
    ]
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(i).alias("ord"),
            F.lit(metric).alias("metric"),
            V.round_even(value.cast("double"), 4).alias("value"),
            F.lit(model_type if metric == "Model type" else None).cast("string").alias("detail"),
        )
        for i, (section, metric, value) in enumerate(figures)
    ]
    share = F.format_string("%.2f%%", "Pct_of_Cohort") if "Pct_of_Cohort" in genes.columns else F.lit(None).cast("string")
    top_genes = ranked_limit(genes, [F.col("N_Patients_Mutated").desc(), F.col("Gene")], 5).select(
        F.lit("TOP 5 MOST ACTIONABLE GENES IN COHORT").alias("section"),
        F.col("rank").alias("ord"),
        F.concat_ws(" -> ", "Gene", "Recommended_Drug").alias("metric"),
        F.col("N_Patients_Mutated").cast("double").alias("value"),
        share.alias("detail"),
    )
    top_cohorts = top_prevalence(cohorts).select(
        F.lit("TARGETABLE MUTATION PREVALENCE BY CANCER TYPE").alias("section"),
        F.col("rank").alias("ord"),
        F.col("Cancer_Type").alias("metric"),
        F.col("Targetable_Rate").alias("value"),
        F.format_string("n=%d", "N_Patients").alias("detail"),
    )
    return one.select(F.inline(F.array(*rows))).unionAll(top_genes).unionAll(top_cohorts)


#: Sections of the summary in the order in which they are printed.
SECTIONS = (
    "COHORT OVERVIEW",
    "MODEL PERFORMANCE",
    "CLINICAL IMPACT",
    "TOP 5 MOST ACTIONABLE GENES IN COHORT",
    "TARGETABLE MUTATION PREVALENCE BY CANCER TYPE",
)


def summary_lines(summary: DataFrame) -> DataFrame:
    """The summary as lines of text in the order of its sections, for `sources.delimited.write_lines`."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    shown = F.when(F.col("value") == F.floor("value"), F.format_string("%.0f", "value")).when(
        F.col("value").isNotNull(), F.format_string("%.4f", "value")
    )
    both = F.concat(shown, F.lit(" ("), F.col("detail"), F.lit(")"))
    return summary.select(
        (place * 10_000 + F.col("ord")).alias("ord"),
        F.concat(F.col("section"), F.lit(" | "), F.col("metric"), F.lit(": "), F.coalesce(both, shown, F.col("detail"), F.lit("N/A"))).alias("line"),
    )
