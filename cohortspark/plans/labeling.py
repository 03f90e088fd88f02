"""Mutation rows to one labelled row per patient."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import values as V
from cohortspark.operators.aggregates import patient_gene_sets
from cohortspark.operators.dedup import ranked_limit


def variant_filter(mutations: DataFrame, keep: Iterable[str] = C.KEEP_VARIANTS) -> DataFrame:
    return mutations.where(F.col("Variant_Classification").isin(list(keep)))


def artefact_gene_filter(mutations: DataFrame, artefacts: Iterable[str] = C.ARTEFACT_GENES) -> DataFrame:
    """Rows of artefact genes go; a row without a gene name stays."""
    return mutations.where(~V.in_set(F.col("Hugo_Symbol"), artefacts))


def label_patients(
    mutations: DataFrame,
    keep: Iterable[str] = C.KEEP_VARIANTS,
    artefacts: Iterable[str] = C.ARTEFACT_GENES,
    targetable: Iterable[str] = C.TARGETABLE_GENES,
) -> DataFrame:
    """Gene set, target genes, counts and status of every patient of the table.

    The filters blank out a gene instead of dropping its row, so that one scan
    yields both the gene sets and the patients that lose all their genes; no join
    back to the list of patients is needed.
    """
    survives = F.col("Variant_Classification").isin(list(keep)) & ~V.in_set(F.col("Hugo_Symbol"), artefacts)
    genes = patient_gene_sets(mutations, F.when(survives, F.col("Hugo_Symbol")))
    sized = genes.withColumn("targetable_genes", V.gene_intersect(F.col("mutated_genes"), targetable))
    sized = sized.withColumn("n_mutations", F.size("mutated_genes")).withColumn(
        "n_targetable", F.size("targetable_genes")
    )
    return sized.withColumn("Mutation_Status", V.mutation_status(F.col("n_targetable"), F.col("n_mutations")))


def stored_labels(labels: DataFrame) -> DataFrame:
    """The label table in its flat, delimited-text layout."""
    return labels.select(
        "Patient_ID",
        "Mutation_Status",
        V.join_genes(F.col("targetable_genes")).alias("targetable_genes"),
        "n_mutations",
        V.join_genes(F.col("mutated_genes")).alias("all_mutated_genes"),
    )


def hypermutators(labels: DataFrame, threshold: int = C.HYPERMUTATOR_THRESHOLD, k: int = 15) -> DataFrame:
    """Patients with more distinct genes than the threshold, the k largest first."""
    above = labels.where(F.col("n_mutations") > threshold)
    order = [F.col("n_mutations").desc(), F.col("Patient_ID")]
    return ranked_limit(above.select("Patient_ID", "n_mutations", "n_targetable", "Mutation_Status"), order, k)
