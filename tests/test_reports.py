from helpers import rows
from cohortspark import constants as C
from cohortspark.plans import reports as R

LABELS = [
    ("TCGA-AA-0001", "Targetable_Mutation", "KRAS", 10),
    ("TCGA-AA-0002", "Targetable_Mutation", "EGFR|KRAS", 5),
    ("TCGA-AA-0003", "Non_Targetable_Mutation", "", 5),
    ("TCGA-BB-0004", "No_Mutation", "", 0),
]
PREDICTIONS = [
    ("TCGA-AA-0001", 1, 1, "Targetable_Mutation", 0.9),
    ("TCGA-AA-0002", 1, 0, "Non_Targetable", 0.6),
    ("TCGA-AA-0003", 0, 0, "Non_Targetable", 0.4),
    ("TCGA-BB-0004", 0, 1, "Targetable_Mutation", 0.2),
    ("TCGA-CC-0005", 0, 0, "Non_Targetable", 0.5),
]


def tables(spark):
    labels = spark.createDataFrame(LABELS, "Patient_ID string, Mutation_Status string, targetable_genes string, n_mutations int")
    predictions = spark.createDataFrame(
        PREDICTIONS, "Patient_ID string, True_Label int, Predicted int, Predicted_Class string, Confidence_Score double"
    )
    return predictions, labels


def test_patient_report_scores_notes_and_order(spark):
    out = R.patient_report(*tables(spark)).collect()
    assert [r.Patient_ID for r in out] == [p[0] for p in PREDICTIONS]
    assert [r.Priority_Score for r in out] == [0.97, 0.78, 0.22, 0.06, None]
    urgent, monitor, routine = (C.FOLLOW_UP[s] for s in C.STATUS_ORDER)
    note = C.LOW_CONFIDENCE_NOTE
    assert [r.Follow_Up_Decision for r in out] == [urgent, urgent + note, monitor + note, routine, None]


def test_errors_carry_kind_and_excerpt(spark):
    predictions, labels = tables(spark)
    texts = spark.createDataFrame([("TCGA-AA-0002", "x" * 300)], "Patient_ID string, clean_text string")
    out = R.error_report(predictions, labels, texts)
    assert rows(out.select("Patient_ID", "Error_Type", "Cancer_Type", "Report_Excerpt")) == [
        ("TCGA-AA-0002", C.FALSE_NEGATIVE, "TCGA-AA", "x" * 200),
        ("TCGA-BB-0004", C.FALSE_POSITIVE, "TCGA-BB", None),
    ]
    assert [r.Patient_ID for r in R.worst_misses(out).collect()] == ["TCGA-AA-0002"]


def test_gene_report_lists_top_cohorts_in_order(spark):
    data = [(f"TCGA-{c}-{i:04d}", ["KRAS"]) for c, n in (("AA", 2), ("BB", 3), ("CC", 2), ("DD", 1)) for i in range(n)]
    data += [("TCGA-EE-0000", []), ("TCGA-AA-0009", ["NOPE"])]
    out = R.gene_report(spark.createDataFrame(data, "Patient_ID string, targetable_genes array<string>")).collect()
    assert tuple(out[0]) == ("KRAS", 8, 80.0, "TCGA-BB(3), TCGA-AA(2), TCGA-CC(2)", "Sotorasib")
    assert tuple(out[1]) == ("NOPE", 1, 10.0, "TCGA-AA(1)", C.DEFAULT_DRUG)


def test_cohort_report_leaves_out_small_cohorts(spark):
    data = [(f"TCGA-AA-{i:04d}", i % 2, 0.1 * (i % 10)) for i in range(10)]
    data += [(f"TCGA-BB-{i:04d}", 1, 0.7) for i in range(12)] + [(f"TCGA-CC-{i:04d}", 1, 0.7) for i in range(9)]
    out = R.cohort_report(spark.createDataFrame(data, "Patient_ID string, True_Label int, Confidence_Score double")).collect()
    assert [(r.Cancer_Type, r.N_Patients, r.Targetable_Rate) for r in out] == [("TCGA-BB", 12, 100.0), ("TCGA-AA", 10, 50.0)]
    assert out[0].AUC is None and out[0].F1_Targetable == 1.0 and out[1].AUC == 0.6


def test_summary_as_text(spark):
    predictions, labels = tables(spark)
    predictions = predictions.withColumn("Probability", predictions.Confidence_Score)
    genes = spark.createDataFrame([("KRAS", 2, "Sotorasib")], "Gene string, N_Patients_Mutated long, Recommended_Drug string")
    summary = R.clinical_summary(predictions, labels, genes, R.cohort_report(predictions))
    lines = [r.line for r in R.summary_lines(summary).orderBy("ord").collect()]
    assert "COHORT OVERVIEW | Total patients processed: 4" in lines
    assert "MODEL PERFORMANCE | Sensitivity: 0.5000" in lines
    assert "TOP 5 MOST ACTIONABLE GENES IN COHORT | KRAS -> Sotorasib: 2" in lines


def test_summary_names_the_model_and_what_stands_beside_figures(spark):
    predictions, labels = tables(spark)
    predictions = predictions.withColumn("Probability", predictions.Confidence_Score)
    schema = "Gene string, N_Patients_Mutated long, Pct_of_Cohort double, Recommended_Drug string"
    genes = spark.createDataFrame([("KRAS", 2, 12.25, "Sotorasib")], schema)
    cohorts = spark.createDataFrame([("TCGA-AA", 25, 40.0), ("TCGA-BB", 19, 90.0)], "Cancer_Type string, N_Patients long, Targetable_Rate double")
    summary = R.clinical_summary(predictions, labels, genes, cohorts, "ModifiedHuberModel")
    lines = [r.line for r in R.summary_lines(summary).orderBy("ord").collect()]
    assert "MODEL PERFORMANCE | Model type: ModifiedHuberModel" in lines
    assert "TOP 5 MOST ACTIONABLE GENES IN COHORT | KRAS -> Sotorasib: 2 (12.25%)" in lines
    assert "TARGETABLE MUTATION PREVALENCE BY CANCER TYPE | TCGA-AA: 40 (n=25)" in lines
    assert not any("TCGA-BB" in line for line in lines)
    shares = [r.value for r in summary.where("metric IN ('Targetable percentage', 'Percentage without targetable muts')").collect()]
    assert sum(shares) == 100.0
