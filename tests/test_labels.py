"""Identifiers, overlap, dedup and labelling on small golden tables."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from cohortspark.catalog import views as W
from cohortspark.functions import ids as I
from cohortspark.functions import values as V
from cohortspark.operators import aggregates as A
from cohortspark.operators import dedup as D
from cohortspark.operators import overlap as O
from cohortspark.plans import align as AL
from cohortspark.plans import labeling as L


def test_identifiers(spark):
    values = ["TCGA-BH-A0B1.25c0", "TCGA-BH-A0B12.x", "x/TCGA-AA-0001.txt", "report7.txt", "TCGA-BH-A0B1\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    prefix, captured = I.patient_id_prefix(F.col("v")), I.patient_id_extract(F.col("v"))
    got = [tuple(r) for r in df.select(prefix, captured, I.is_valid_id(prefix), I.is_valid_id(captured), I.cohort(captured)).collect()]
    assert got == [
        ("TCGA-BH-A0B1", "TCGA-BH-A0B1", True, True, "TCGA-BH"),
        ("TCGA-BH-A0B1", "TCGA-BH-A0B12", True, False, "TCGA-BH"),
        ("x/TCGA-AA-00", "TCGA-AA-0001", False, True, "TCGA-AA"),
        ("report7.txt", None, False, None, None),
        ("TCGA-BH-A0B1", "TCGA-BH-A0B1", True, True, "TCGA-BH"),
    ]
    assert spark.createDataFrame([("TCGA-BH-A0B1\n",)], "v string").select(I.is_valid_id(F.col("v"))).first()[0]


def test_long_participants_stay_apart(spark):
    barcodes = ["TCGA-BH-A0B1-01A", "TCGA-BH-A0B12-01A", "TCGA-BH-A0B13-01A", "TCGA-BH-A0B1", "report7 without id", None]
    rows_ = spark.createDataFrame([(b, "G", "V") for b in barcodes], "Tumor_Sample_Barcode string, Hugo_Symbol string, Variant_Classification string")
    got = sorted(r.Patient_ID for r in AL.with_mutation_patient(rows_).collect())
    assert got == ["TCGA-BH-A0B1", "TCGA-BH-A0B1", "TCGA-BH-A0B12", "TCGA-BH-A0B13", "report7 with"]
    keys = [0, 36**4 - 1, 36**4, 36**4 + 36, 9_000_000]
    made = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", W.pid("k").alias("p")).orderBy("k").select("p").collect()]
    assert made == ["TCGA-00-0000", "TCGA-0F-ZZZZ", "TCGA-0G-10000", "TCGA-0C-10010", "TCGA-00-5CWG0"]


MUTATIONS = [
    ("A", "KRAS", "Missense_Mutation"),
    ("A", "KRAS", "Nonsense_Mutation"),
    ("A", "TP53", "Splice_Site"),
    ("A", "TTN", "Missense_Mutation"),
    ("B", "TP53", "Frame_Shift_Del"),
    ("C", "EGFR", "Silent"),
    ("D", "MUC16", "Missense_Mutation"),
    ("E", None, "Missense_Mutation"),
]


@pytest.fixture
def mutations(spark):
    return spark.createDataFrame(MUTATIONS, "Patient_ID string, Hugo_Symbol string, Variant_Classification string")


def test_labels(mutations):
    assert rows(L.stored_labels(L.label_patients(mutations))) == [
        ("A", "Targetable_Mutation", "KRAS", 2, "KRAS|TP53"),
        ("B", "Non_Targetable_Mutation", "", 1, "TP53"),
        ("C", "No_Mutation", "", 0, ""),
        ("D", "No_Mutation", "", 0, ""),
        ("E", "No_Mutation", "", 0, ""),
    ]


def test_filters_treat_missing_genes_and_variants_apart(mutations, spark):
    odd = mutations.unionAll(spark.createDataFrame([("F", "KRAS", None)], mutations.schema))
    assert "F" not in {r.Patient_ID for r in L.variant_filter(odd).collect()}
    assert "E" in {r.Patient_ID for r in L.artefact_gene_filter(odd).collect()}


def test_funnel_and_hits(mutations):
    assert rows(A.pipeline_funnel(mutations)) == [
        (0, "raw", 8, 0, 5),
        (1, "variant_filter", 7, 1, 4),
        (2, "artefact_filter", 5, 2, 3),
    ]
    assert rows(A.artefact_gene_hits(mutations)) == [("MUC16", 1), ("TTN", 1)]


def test_patient_summary_counts_rows_and_distinct_genes(mutations):
    summary = {r[0]: tuple(r)[1:] for r in A.patient_mutation_summary(mutations).collect()}
    assert summary["A"] == (4, 3, "Missense_Mutation|Nonsense_Mutation|Splice_Site")
    assert summary["E"] == (1, 0, "Missense_Mutation")


def test_hypermutator_threshold_is_strict(spark):
    df = spark.createDataFrame(
        [("A", 500, 0, "x"), ("B", 501, 1, "y"), ("C", 900, 2, "z")],
        "Patient_ID string, n_mutations int, n_targetable int, Mutation_Status string",
    )
    assert [(r.Patient_ID, r.rank) for r in L.hypermutators(df).orderBy("rank").collect()] == [("C", 1), ("B", 2)]


def test_dedup_rules(spark):
    data = [(1, "A", "ab"), (2, "A", "abcd"), (3, "A", "wxyz"), (4, "B", None), (5, "B", "z")]
    df = spark.createDataFrame(data, "ord int, id string, text string").repartition(4)
    assert rows(D.dedup_first(df, "id", "ord").select("ord")) == [(1,), (4,)]
    assert rows(D.dedup_longest(df, "id", "text", "ord").select("ord")) == [(2,), (5,)]


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    picks = [rows(D.seeded_sample(df.repartition(n), "id", 5, 42)) for n in (1, 3, 8)]
    assert picks[0] == picks[1] == picks[2]
    assert picks[0] != rows(D.seeded_sample(df, "id", 5, 43))


def test_overlap(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "Patient_ID string")
    b = spark.createDataFrame([("2",), ("3",), ("4",)], "Patient_ID string")
    assert tuple(O.overlap_summary(a, b).first()) == (2, 3, 1, 1, 2)
    assert rows(O.sample_mismatches(a, b, 1)) == [("only_a", "1"), ("only_b", "3")]
    empty = a.where("false")
    assert tuple(O.overlap_summary(empty, empty).first()) == (0, 0, 0, 0, 0)


def test_alignment(spark, mutations):
    reports = spark.createDataFrame(
        [("A.1", "first", 1, "A"), ("A.2", "second", 2, "A"), ("Z.1", "z", 3, "Z")],
        "patient_filename string, text string, row_order int, Patient_ID string",
    )
    merged = AL.align(mutations, reports).collect()
    assert [(r.Patient_ID, r.text, r.mutation_count) for r in merged] == [("A", "first", 4)]
    assert AL.mutations_matched(mutations, reports).count() == 4
    with pytest.raises(ValueError):
        AL.check_invariants(reports, mutations)
    AL.check_invariants(merged_ids := spark.createDataFrame([("A",)], "Patient_ID string"), merged_ids)


def test_class_distribution_shows_absent_classes(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    out = [tuple(r) for r in A.class_distribution(df, "c", ["x", "z", "y"]).collect()]
    assert [r[1:3] for r in out] == [("x", 2), ("z", 0), ("y", 1)]


def test_imbalance_tiers(spark):
    data = [("Targetable_Mutation",)] * 42 + [("Non_Targetable_Mutation",)] * 2 + [("No_Mutation",)] * 6
    out = {r.encoding: r for r in A.class_imbalance(spark.createDataFrame(data, "s string"), "s").collect()}
    assert (out["3-class"].ratio, out["3-class"].severity) == (21.0, "severe")
    assert (out["binary"].majority, out["binary"].minority, out["binary"].severity) == (42, 8, "moderate")


def test_gene_text_roundtrip(spark):
    df = spark.createDataFrame([(["A", "B"],), ([],)], "g array<string>").withColumn("t", V.join_genes(F.col("g")))
    assert all(r.g == r.back for r in df.withColumn("back", V.split_genes(F.col("t"))).collect())


def test_rounding(spark):
    df = spark.createDataFrame([(0.12345,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(V.round_even(F.col("x"), 4)).collect()][0] == 0.1234
    assert [r[0] for r in df.select(V.round_even(F.col("x"), 0)).collect()] == [0.0, 2.0, 0.0]
