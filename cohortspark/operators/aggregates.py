"""Counts, profiles and class statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import ids as I
from cohortspark.functions import text as X
from cohortspark.functions import values as V
from cohortspark.operators.dedup import topk_per_group


def source_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of rows and of distinct values of each column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns]
    )


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first; a missing value is not counted."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.col(name).desc(), F.col(col))


def variant_breakdown(df: DataFrame, keep: Iterable[str] = C.KEEP_VARIANTS) -> DataFrame:
    counts = value_counts(df, "Variant_Classification")
    return counts.withColumn(
        "decision", F.when(V.in_set(F.col("Variant_Classification"), keep), "KEEP").otherwise("DROP")
    )


def validate_ids(df: DataFrame, col: str, source: str, examples: int = 5) -> DataFrame:
    """One row: distinct identifiers, how many break the format, and the first few of those, sorted."""
    distinct = df.select(F.col(col).alias("id")).where(F.col(col).isNotNull()).distinct()
    bad = distinct.where(~I.is_valid_id(F.col("id")))
    counts = distinct.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.coalesce(F.sum((~I.is_valid_id(F.col("id"))).cast("long")), F.lit(0)).alias("n_invalid"),
    )
    shown = (
        bad.orderBy("id").limit(examples).agg(F.array_join(F.sort_array(F.collect_list("id")), "|").alias("examples"))
    )
    return counts.crossJoin(F.broadcast(shown)).select(F.lit(source).alias("source"), "n_ids", "n_invalid", "examples")


def patient_mutation_summary(mutations: DataFrame) -> DataFrame:
    """Per patient: rows, distinct genes, sorted distinct variant types.

    Rows are first counted per (patient, gene, variant), which spreads a patient
    with very many rows over all tasks; what then meets per patient is bounded by
    the number of gene and variant names.
    """
    fine = mutations.groupBy("Patient_ID", "Hugo_Symbol", "Variant_Classification").agg(
        F.count(F.lit(1)).alias("n")
    )
    return fine.groupBy("Patient_ID").agg(
        F.sum("n").alias("mutation_count"),
        F.size(F.collect_set("Hugo_Symbol")).cast("long").alias("unique_genes"),
        F.array_join(F.sort_array(F.collect_set("Variant_Classification")), "|").alias("variant_types"),
    )


def patient_gene_sets(mutations: DataFrame, gene: Column | str = "Hugo_Symbol") -> DataFrame:
    """Sorted distinct genes per patient; a patient whose genes are all missing keeps an empty array.

    The distinct on (patient, gene) comes first, so that no task collects raw rows.
    """
    pairs = mutations.select("Patient_ID", (F.col(gene) if isinstance(gene, str) else gene).alias("gene")).distinct()
    return pairs.groupBy("Patient_ID").agg(F.sort_array(F.collect_list("gene")).alias("mutated_genes"))


def class_distribution(df: DataFrame, col: str, classes: Sequence[str]) -> DataFrame:
    """Count and percentage of every listed class in list order; an absent class shows as zero."""
    # as many rows as classes are listed, whatever else the column holds
    counts = df.where(F.col(col).isin(list(classes))).groupBy(F.col(col).alias("_class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    listed = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], "ord int, class string")
    return (
        listed.join(counts, F.col("class") == F.col("_class"), "left")
        .crossJoin(F.broadcast(total))
        .select(
            "ord",
            "class",
            F.coalesce("n", F.lit(0)).alias("n"),
            V.percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("pct"),
        )
        .orderBy("ord")
    )


def top_targetable_genes(labels: DataFrame, k: int = 20) -> DataFrame:
    """The k genes found in most patients; the percentage is of all patients."""
    total = labels.agg(F.count(F.lit(1)).alias("total"))
    counts = (
        labels.select("Patient_ID", F.explode("targetable_genes").alias("gene"))
        .groupBy("gene")
        .agg(F.count_distinct("Patient_ID").alias("n_patients"))
    )
    return (
        counts.orderBy(F.col("n_patients").desc(), "gene")
        .limit(k)
        .crossJoin(F.broadcast(total))
        .select("gene", "n_patients", V.percent(F.col("n_patients"), F.col("total")).alias("pct"))
        .orderBy(F.col("n_patients").desc(), "gene")
    )


def artefact_gene_hits(mutations: DataFrame, genes: Iterable[str] = C.ARTEFACT_GENES) -> DataFrame:
    hits = mutations.where(F.col("Hugo_Symbol").isin(list(genes)))
    return hits.groupBy("Hugo_Symbol").agg(F.count(F.lit(1)).alias("n_removed")).orderBy("Hugo_Symbol")


def pipeline_funnel(
    mutations: DataFrame, keep: Iterable[str] = C.KEEP_VARIANTS, artefacts: Iterable[str] = C.ARTEFACT_GENES
) -> DataFrame:
    """Rows, rows lost and patients left after each filter, from one pass over the table."""
    kept = V.in_set(F.col("Variant_Classification"), keep)
    clean = kept & ~V.in_set(F.col("Hugo_Symbol"), artefacts)
    flags = {"raw": F.lit(True), "variant_filter": kept, "artefact_filter": clean}
    per_patient = mutations.groupBy("Patient_ID").agg(
        *[F.sum(flag.cast("long")).alias(stage) for stage, flag in flags.items()]
    )
    stages = list(flags)
    totals = per_patient.agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"rows_{s}") for s in stages],
        *[F.coalesce(F.sum(((F.col(s) > 0) & F.col("Patient_ID").isNotNull()).cast("long")), F.lit(0)).alias(f"patients_{s}") for s in stages],
    )
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(s).alias("stage"),
            F.col(f"rows_{s}").alias("n_rows"),
            (F.col(f"rows_{stages[max(i - 1, 0)]}") - F.col(f"rows_{s}")).alias("n_dropped"),
            F.col(f"patients_{s}").alias("n_patients"),
        )
        for i, s in enumerate(stages)
    ]
    return totals.select(F.inline(F.array(*rows)))


def text_length_stats(df: DataFrame, text: str) -> DataFrame:
    """Mean, exact median, least and most words per text.

    Texts are first counted per length, so the median works on the few distinct
    lengths and not on one row per text.
    """
    lengths = df.select(X.word_count(F.col(text)).cast("long").alias("words")).groupBy("words").agg(
        F.count(F.lit(1)).alias("n")
    )
    return lengths.agg(
        F.sum("n").alias("n_texts"),
        (F.sum(F.col("words") * F.col("n")).cast("double") / F.sum("n")).alias("mean_words"),
        F.percentile("words", F.lit(0.5), F.col("n")).alias("median_words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
    )


def class_imbalance(df: DataFrame, status: str) -> DataFrame:
    """Largest over smallest class, for the three classes and for targetable against the rest."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n") / F.nullif(F.min("n").cast("double"), F.lit(0.0))
    three = counts.where(V.in_set(F.col(status), C.STATUS_ORDER)).agg(
        F.max("n").alias("majority"), F.min("n").alias("minority"), ratio.alias("ratio")
    )
    pos = F.coalesce(F.sum(F.when(F.col(status) == C.TARGETABLE, F.col("n"))), F.lit(0))
    neg = F.coalesce(F.sum(F.when(F.col(status).isin(C.NON_TARGETABLE, C.NO_MUTATION), F.col("n"))), F.lit(0))
    two = counts.agg(pos.alias("pos"), neg.alias("neg")).select(
        F.greatest("pos", "neg").alias("majority"),
        F.least("pos", "neg").alias("minority"),
        (F.greatest("pos", "neg") / F.nullif(F.least("pos", "neg").cast("double"), F.lit(0.0))).alias("ratio"),
    )
    severity = F.when(F.col("ratio") > 20, "severe").when(F.col("ratio") > 5, "moderate").otherwise("mild")
    binary_severity = F.when(F.col("ratio") > 5, "moderate").otherwise("acceptable")
    return three.select(F.lit("3-class").alias("encoding"), "*", severity.alias("severity")).unionAll(
        two.select(F.lit("binary").alias("encoding"), "*", binary_severity.alias("severity"))
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class the weight n / (k * n_class), so that every class weighs the same in total."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(totals)).select(
        label, "n_class", (F.col("n") / (F.col("k") * F.col("n_class")).cast("double")).alias("weight")
    )


def with_balanced_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    weights = balanced_weights(df, label).select(label, F.col("weight").alias(weight))
    return df.join(weights, label)


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives, positives, and negatives per positive."""
    pos, neg = F.sum(F.col(label).cast("long")), F.sum(1 - F.col(label).cast("long"))
    return df.agg(
        pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.nullif(pos.cast("double"), F.lit(0.0))).alias("pos_weight")
    )


def top_unigrams(df: DataFrame, text: str, by: str, k: int = 20) -> DataFrame:
    """The k most frequent words per class, ties by word."""
    counts = (
        df.select(by, F.explode(X.words(F.col(text))).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    )
    return topk_per_group(counts, by, [F.col("n").desc(), F.col("word")], k, rank="rank")
