"""Identifiers, filters, joins, set operations, aggregates, windows, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.catalog.registry import query
from cohortspark.catalog.views import sql_list, with_views
from cohortspark.functions import ids as I
from cohortspark.functions import text as X
from cohortspark.functions import values as V
from cohortspark.operators import aggregates as A
from cohortspark.operators import dedup as D
from cohortspark.operators import overlap as O
from cohortspark.plans import align as AL
from cohortspark.plans import labeling as L
from cohortspark.plans.text_dataset import encode_labels

STATUS_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(C.STATUS_ORDER))


def r6(col):
    return F.round(col, 6)


# --- identifiers and filters -------------------------------------------------


@query("filter_not_null", with_views("SELECT Patient_ID, Hugo_Symbol FROM v_mutations WHERE Hugo_Symbol IS NOT NULL"))
def filter_not_null(spark, sf):
    return W.mutations(spark, sf).dropna(subset=["Hugo_Symbol"]).select("Patient_ID", "Hugo_Symbol")


@query(
    "patient_id_prefix",
    with_views("SELECT patient_filename, substr(patient_filename, 1, 12) AS Patient_ID FROM v_reports_raw"),
)
def patient_id_prefix(spark, sf):
    raw = W.raw_reports(spark, sf)
    return raw.select("patient_filename", I.patient_id_prefix(F.col("patient_filename")).alias("Patient_ID"))


@query(
    "patient_id_extract",
    with_views(
        f"""SELECT patient_filename, nullif(regexp_extract(patient_filename, '{C.ID_CAPTURE}', 1), '') AS Patient_ID
        FROM v_reports_raw"""
    ),
)
def patient_id_extract(spark, sf):
    raw = W.raw_reports(spark, sf)
    return raw.select("patient_filename", I.patient_id_extract(F.col("patient_filename")).alias("Patient_ID"))


_IDS_SQL = f"""ids AS (SELECT DISTINCT source, id, regexp_full_match(id, '{C.ID_FORMAT}') AS ok FROM (
      SELECT 'reports_by_prefix' AS source, substr(patient_filename, 1, 12) AS id FROM v_reports_raw
      UNION ALL SELECT 'reports_by_pattern', Patient_ID FROM v_reports
      UNION ALL SELECT 'mutations', Patient_ID FROM v_mutations)),
    bad AS (SELECT source, string_agg(id, '|' ORDER BY id) AS examples FROM
      (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM ids WHERE NOT ok) WHERE rn <= 5 GROUP BY source)"""


@query(
    "validate_ids",
    with_views(
        f"""WITH {_IDS_SQL} SELECT source, count(*) AS n_ids, (count(*) FILTER (WHERE NOT ok)) AS n_invalid,
          coalesce(any_value(examples), '') AS examples FROM ids LEFT JOIN bad USING (source) GROUP BY source"""
    ),
)
def validate_ids(spark, sf):
    raw = W.raw_reports(spark, sf).withColumn("prefix", I.patient_id_prefix(F.col("patient_filename")))
    return (
        A.validate_ids(raw, "prefix", "reports_by_prefix")
        .unionAll(A.validate_ids(W.reports(spark, sf), "Patient_ID", "reports_by_pattern"))
        .unionAll(A.validate_ids(W.mutations(spark, sf), "Patient_ID", "mutations"))
    )


@query(
    "cohort_projection",
    with_views("SELECT DISTINCT Patient_ID, substr(Patient_ID, 1, 7) AS Cohort FROM v_mutations"),
)
def cohort_projection(spark, sf):
    patients = W.mutations(spark, sf).select("Patient_ID").distinct()
    return patients.withColumn("Cohort", I.cohort(F.col("Patient_ID")))


@query(
    "variant_filter",
    with_views(
        f"""SELECT Patient_ID, Hugo_Symbol, Variant_Classification FROM v_mutations
        WHERE Variant_Classification IN {sql_list(W.KEEP)}"""
    ),
)
def variant_filter(spark, sf):
    return L.variant_filter(W.mutations(spark, sf), W.KEEP).select(
        "Patient_ID", "Hugo_Symbol", "Variant_Classification"
    )


@query(
    "artefact_gene_filter",
    with_views(
        f"""SELECT Patient_ID, Hugo_Symbol, Variant_Classification FROM v_mutations
        WHERE Hugo_Symbol IS NULL OR Hugo_Symbol NOT IN {sql_list(W.ARTEFACTS)}"""
    ),
)
def artefact_gene_filter(spark, sf):
    return L.artefact_gene_filter(W.mutations(spark, sf), W.ARTEFACTS).select(
        "Patient_ID", "Hugo_Symbol", "Variant_Classification"
    )


@query(
    "variant_breakdown",
    with_views(
        f"""SELECT Variant_Classification, count(*) AS n,
          CASE WHEN Variant_Classification IN {sql_list(W.KEEP)} THEN 'KEEP' ELSE 'DROP' END AS decision
        FROM v_mutations WHERE Variant_Classification IS NOT NULL GROUP BY Variant_Classification"""
    ),
)
def variant_breakdown(spark, sf):
    return A.variant_breakdown(W.mutations(spark, sf), W.KEEP)


_ODD_TEXT_SQL = """(SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL WHEN length(text) < 60 THEN chr(9) || ' ' || chr(160) || chr(10)
  WHEN length(text) < 80 THEN 'nan' ELSE text END AS text FROM conversations)"""


@query(
    "nonempty_text",
    f"""SELECT conv_id, turn, md5(text) AS digest FROM {_ODD_TEXT_SQL}
    WHERE text IS NOT NULL AND regexp_replace(text, '^{X.SPACE}+|{X.SPACE}+$', '', 'g') <> '' AND text <> 'nan'""",
)
def nonempty_text(spark, sf):
    turns = W.table(spark, sf, "conversations")
    odd = (
        F.when(F.col("role") == "system", F.lit(None))
        .when(F.length("text") < 60, "\t  \n")
        .when(F.length("text") < 80, "nan")
        .otherwise(F.col("text"))
    )
    kept = turns.withColumn("text", odd).where(X.is_nonempty_text(F.col("text")))
    return kept.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(
    "low_confidence_flag",
    with_views(
        """SELECT Patient_ID, round_even(probability, 4) AS Confidence_Score,
          round_even(probability, 4) BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE AS low_confidence FROM v_predictions"""
    ),
)
def low_confidence_flag(spark, sf):
    rounded = W.predictions(spark, sf).select("Patient_ID", V.round_even(F.col("probability"), 4).alias("Confidence_Score"))
    return rounded.withColumn("low_confidence", V.is_low_confidence(F.col("Confidence_Score")))


_DRUG_CASE = " ".join(f"WHEN Hugo_Symbol = '{g}' THEN '{d}'" for g, d in W.DRUGS.items())


@query(
    "value_map_default",
    with_views(
        f"""SELECT Patient_ID, Hugo_Symbol, CASE {_DRUG_CASE} ELSE '{C.DEFAULT_DRUG}' END AS drug,
        CASE {_DRUG_CASE} END AS drug_or_null FROM v_mutations"""
    ),
)
def value_map_default(spark, sf):
    gene = F.col("Hugo_Symbol")
    return W.mutations(spark, sf).select(
        "Patient_ID",
        "Hugo_Symbol",
        V.value_map(gene, W.DRUGS, F.lit(C.DEFAULT_DRUG)).alias("drug"),
        V.value_map(gene, W.DRUGS).alias("drug_or_null"),
    )


@query(
    "invariants",
    with_views(
        """WITH f AS (SELECT Patient_ID FROM v_reports), l AS (SELECT Patient_ID FROM v_labels)
        SELECT (SELECT count(*) FROM f) AS features_rows, (SELECT count(DISTINCT Patient_ID) FROM f) AS features_ids,
          (SELECT count(*) FROM l) AS labels_rows, (SELECT count(DISTINCT Patient_ID) FROM l) AS labels_ids,
          (SELECT count(*) FROM (SELECT Patient_ID FROM f EXCEPT SELECT Patient_ID FROM l)) AS only_features,
          (SELECT count(*) FROM (SELECT Patient_ID FROM l EXCEPT SELECT Patient_ID FROM f)) AS only_labels"""
    ),
)
def invariants(spark, sf):
    return AL.invariants(W.reports(spark, sf), W.labels(spark, sf))


# --- joins and set operations ------------------------------------------------

_SUMMARY_SQL = """summary AS (SELECT Patient_ID, count(*) AS mutation_count, count(DISTINCT Hugo_Symbol) AS unique_genes,
      string_agg(DISTINCT Variant_Classification, '|' ORDER BY Variant_Classification) AS variant_types
    FROM v_mutations GROUP BY Patient_ID)"""


@query(
    "align_inner",
    with_views(
        f"""WITH {_SUMMARY_SQL} SELECT patient_filename, Patient_ID, mutation_count, unique_genes FROM
          (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY row_order) AS rn FROM v_reports)
        JOIN summary USING (Patient_ID) WHERE rn = 1"""
    ),
)
def align_inner(spark, sf):
    summary = A.patient_mutation_summary(W.mutations(spark, sf))
    first = D.dedup_first(W.reports(spark, sf).drop("text"), "Patient_ID", "row_order")
    return first.join(summary, "Patient_ID").select(
        "patient_filename", "Patient_ID", "mutation_count", "unique_genes"
    )


@query(
    "mutations_matched",
    with_views(
        """SELECT Hugo_Symbol, Variant_Classification, Patient_ID FROM v_mutations
        WHERE Patient_ID IN (SELECT Patient_ID FROM v_reports)"""
    ),
)
def mutations_matched(spark, sf):
    return AL.mutations_matched(W.mutations(spark, sf), W.reports(spark, sf))


def _only(a: str, b: str) -> str:
    return with_views(f"SELECT Patient_ID FROM {a} EXCEPT SELECT Patient_ID FROM {b}")


@query("only_in_a", _only("v_mutations", "v_reports"))
def only_in_a(spark, sf):
    return O.only_in(W.mutations(spark, sf), W.reports(spark, sf))


@query("only_in_b", _only("v_reports", "v_mutations"))
def only_in_b(spark, sf):
    return O.only_in(W.reports(spark, sf), W.mutations(spark, sf))


@query("ids_intersect", with_views("SELECT Patient_ID FROM v_mutations INTERSECT SELECT Patient_ID FROM v_reports"))
def ids_intersect(spark, sf):
    return O.in_both(W.mutations(spark, sf), W.reports(spark, sf))


@query(
    "ids_except",
    with_views(
        """SELECT 'only_mutations' AS side, Patient_ID FROM (SELECT Patient_ID FROM v_mutations EXCEPT SELECT Patient_ID FROM v_reports)
        UNION ALL SELECT 'only_reports', Patient_ID FROM (SELECT Patient_ID FROM v_reports EXCEPT SELECT Patient_ID FROM v_mutations)"""
    ),
)
def ids_except(spark, sf):
    flags = O.membership(W.mutations(spark, sf), W.reports(spark, sf)).where("in_a <> in_b")
    side = F.when(F.col("in_a") == 1, "only_mutations").otherwise("only_reports")
    return flags.select(side.alias("side"), "Patient_ID")


@query("ids_union", with_views("SELECT Patient_ID FROM v_mutations UNION SELECT Patient_ID FROM v_reports"))
def ids_union(spark, sf):
    both = W.mutations(spark, sf).select("Patient_ID").union(W.reports(spark, sf).select("Patient_ID"))
    return O.distinct_ids(both, "Patient_ID")


@query("ids_distinct", with_views("SELECT DISTINCT Patient_ID FROM v_mutations"))
def ids_distinct(spark, sf):
    return O.distinct_ids(W.mutations(spark, sf), "Patient_ID")


# --- aggregates --------------------------------------------------------------


@query(
    "source_profile",
    with_views(
        """SELECT count(*) AS n_rows, count(DISTINCT Patient_ID) AS n_Patient_ID, count(DISTINCT Hugo_Symbol) AS n_Hugo_Symbol,
        count(DISTINCT Variant_Classification) AS n_Variant_Classification FROM v_mutations"""
    ),
)
def source_profile(spark, sf):
    return A.source_profile(W.mutations(spark, sf), ["Patient_ID", "Hugo_Symbol", "Variant_Classification"])


@query(
    "cohort_counts",
    with_views(
        """SELECT substr(Patient_ID, 1, 7) AS Cohort, count(*) AS n_patients FROM
          (SELECT DISTINCT Patient_ID FROM v_reports WHERE Patient_ID IN (SELECT Patient_ID FROM v_mutations)) GROUP BY ALL"""
    ),
)
def cohort_counts(spark, sf):
    matched = O.in_both(W.mutations(spark, sf), W.reports(spark, sf))
    return A.value_counts(matched.withColumn("Cohort", I.cohort(F.col("Patient_ID"))), "Cohort", "n_patients")


@query("patient_mutation_summary", with_views(f"WITH {_SUMMARY_SQL} SELECT * FROM summary"))
def patient_mutation_summary(spark, sf):
    return A.patient_mutation_summary(W.mutations(spark, sf))


@query(
    "patient_gene_sets",
    with_views(
        """SELECT Patient_ID, coalesce(string_agg(DISTINCT Hugo_Symbol, '|' ORDER BY Hugo_Symbol), '') AS genes,
        count(DISTINCT Hugo_Symbol)::INTEGER AS n_genes FROM v_mutations GROUP BY Patient_ID"""
    ),
)
def patient_gene_sets(spark, sf):
    sets = A.patient_gene_sets(W.mutations(spark, sf))
    return sets.select("Patient_ID", V.join_genes(F.col("mutated_genes")).alias("genes"), F.size("mutated_genes").alias("n_genes"))


@query(
    "class_distribution",
    with_views(
        f"""SELECT ord, class, count(Patient_ID) AS n, round(100.0::DOUBLE * count(Patient_ID) / (SELECT count(*) FROM v_labels), 6) AS pct
        FROM (VALUES {STATUS_VALUES}, (3, 'Unknown')) c(ord, class) LEFT JOIN v_labels ON Mutation_Status = class GROUP BY ord, class"""
    ),
)
def class_distribution(spark, sf):
    out = A.class_distribution(W.labels(spark, sf), "Mutation_Status", [*C.STATUS_ORDER, "Unknown"])
    return out.withColumn("pct", r6(F.col("pct")))


@query(
    "top_targetable_genes",
    with_views(
        f"""SELECT gene, count(*) AS n_patients, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM v_labels), 6) AS pct
        FROM v_genes WHERE gene IN {sql_list(W.TARGETABLE)} GROUP BY gene ORDER BY 2 DESC, 1 LIMIT 20"""
    ),
)
def top_targetable_genes(spark, sf):
    return A.top_targetable_genes(W.labels(spark, sf)).withColumn("pct", r6(F.col("pct")))


@query(
    "artefact_gene_hits",
    with_views(
        f"""SELECT Hugo_Symbol, count(*) AS n_removed FROM v_mutations
        WHERE Variant_Classification IN {sql_list(W.KEEP)} AND Hugo_Symbol IN {sql_list(W.ARTEFACTS)} GROUP BY Hugo_Symbol"""
    ),
)
def artefact_gene_hits(spark, sf):
    return A.artefact_gene_hits(L.variant_filter(W.mutations(spark, sf), W.KEEP), W.ARTEFACTS)


_KEPT = f"Variant_Classification IN {sql_list(W.KEEP)}"
_CLEAN = f"{_KEPT} AND (Hugo_Symbol IS NULL OR Hugo_Symbol NOT IN {sql_list(W.ARTEFACTS)})"


@query(
    "pipeline_funnel",
    with_views(
        f"""WITH s AS (
          SELECT 0 AS ord, 'raw' AS stage, count(*) AS n_rows, count(DISTINCT Patient_ID) AS n_patients FROM v_mutations
          UNION ALL SELECT 1, 'variant_filter', count(*), count(DISTINCT Patient_ID) FROM v_mutations WHERE {_KEPT}
          UNION ALL SELECT 2, 'artefact_filter', count(*), count(DISTINCT Patient_ID) FROM v_mutations WHERE {_CLEAN})
        SELECT ord, stage, n_rows, coalesce(lag(n_rows) OVER (ORDER BY ord) - n_rows, 0) AS n_dropped, n_patients FROM s"""
    ),
)
def pipeline_funnel(spark, sf):
    return A.pipeline_funnel(W.mutations(spark, sf), W.KEEP, W.ARTEFACTS)


@query(
    "class_imbalance",
    with_views(
        f"""WITH c AS (SELECT Mutation_Status, count(*) AS n FROM v_labels GROUP BY 1),
        r AS (SELECT '3-class' AS encoding, max(n) AS majority, min(n) AS minority FROM c
          UNION ALL SELECT 'binary', max(n), min(n) FROM
            (SELECT count(*) AS n FROM v_labels GROUP BY Mutation_Status = '{C.TARGETABLE}'))
        SELECT encoding, majority, minority, round(majority / minority::DOUBLE, 6) AS ratio,
          CASE WHEN encoding = 'binary' THEN CASE WHEN majority / minority::DOUBLE > 5 THEN 'moderate' ELSE 'acceptable' END
            WHEN majority / minority::DOUBLE > 20 THEN 'severe' WHEN majority / minority::DOUBLE > 5 THEN 'moderate'
            ELSE 'mild' END AS severity FROM r"""
    ),
)
def class_imbalance(spark, sf):
    return A.class_imbalance(W.labels(spark, sf), "Mutation_Status").withColumn("ratio", r6(F.col("ratio")))


@query(
    "balanced_weights",
    with_views(
        """WITH c AS (SELECT label, count(*) AS n_class FROM v_predictions GROUP BY label)
        SELECT label, n_class, round((SELECT sum(n_class) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n_class), 6) AS weight FROM c"""
    ),
)
def balanced_weights(spark, sf):
    return A.balanced_weights(W.predictions(spark, sf), "label").withColumn("weight", r6(F.col("weight")))


@query(
    "pos_weight",
    with_views(
        """SELECT sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg,
        round(sum(1 - label)::DOUBLE / sum(label), 6) AS pos_weight FROM v_predictions"""
    ),
)
def pos_weight(spark, sf):
    return A.pos_weight(W.predictions(spark, sf), "label").withColumn("pos_weight", r6(F.col("pos_weight")))


@query(
    "overlap_summary",
    with_views(
        """WITH a AS (SELECT DISTINCT Patient_ID FROM v_mutations), b AS (SELECT DISTINCT Patient_ID FROM v_reports)
        SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
          (SELECT count(*) FROM a JOIN b USING (Patient_ID)) AS n_common,
          (SELECT count(*) FROM a ANTI JOIN b USING (Patient_ID)) AS n_only_a,
          (SELECT count(*) FROM b ANTI JOIN a USING (Patient_ID)) AS n_only_b"""
    ),
)
def overlap_summary(spark, sf):
    return O.overlap_summary(W.mutations(spark, sf), W.reports(spark, sf))


@query(
    "alignment_summary",
    with_views(
        """WITH a AS (SELECT DISTINCT Patient_ID FROM v_mutations), b AS (SELECT DISTINCT Patient_ID FROM v_reports),
          m AS (SELECT Patient_ID FROM a JOIN b USING (Patient_ID))
        SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM m) AS n_common,
          (SELECT count(*) FROM a) - (SELECT count(*) FROM m) AS n_only_a,
          (SELECT count(*) FROM b) - (SELECT count(*) FROM m) AS n_only_b,
          (SELECT count(DISTINCT substr(Patient_ID, 1, 7)) FROM m) AS n_cohorts,
          (SELECT count(*) FROM v_mutations) AS n_mutation_rows"""
    ),
)
def alignment_summary(spark, sf):
    return AL.alignment_summary(W.mutations(spark, sf), W.reports(spark, sf))


# --- windows, limits, samples --------------------------------------------------


@query(
    "dedup_first",
    with_views(
        """SELECT Patient_ID, row_order, md5(text) AS digest FROM
        (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY row_order) AS rn FROM v_reports_multi) WHERE rn = 1"""
    ),
)
def dedup_first(spark, sf):
    kept = D.dedup_first(W.reports_multi(spark, sf), "Patient_ID", "row_order")
    return kept.select("Patient_ID", "row_order", F.md5("text").alias("digest"))


@query(
    "dedup_longest",
    with_views(
        """SELECT Patient_ID, row_order, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM
        (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY length(text) DESC NULLS LAST, row_order) AS rn
         FROM v_reports_multi) WHERE rn = 1"""
    ),
)
def dedup_longest(spark, sf):
    kept = D.dedup_longest(W.reports_multi(spark, sf), "Patient_ID", "text", "row_order")
    return kept.select("Patient_ID", "row_order", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "topk_per_group",
    with_views(
        """SELECT cohort, gene, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY n DESC, gene)::INTEGER AS rank
        FROM (SELECT substr(Patient_ID, 1, 7) AS cohort, Hugo_Symbol AS gene, count(*) AS n FROM v_mutations
              WHERE Hugo_Symbol IS NOT NULL GROUP BY ALL)) WHERE rank <= 3"""
    ),
)
def topk_per_group(spark, sf):
    counts = (
        W.mutations(spark, sf)
        .where(F.col("Hugo_Symbol").isNotNull())
        .groupBy(I.cohort(F.col("Patient_ID")).alias("cohort"), F.col("Hugo_Symbol").alias("gene"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return D.topk_per_group(counts, "cohort", [F.col("n").desc(), F.col("gene")], 3, rank="rank")


@query(
    "topk_hypermutators",
    with_views(
        """SELECT Patient_ID, n_mutations, n_targetable, Mutation_Status,
          row_number() OVER (ORDER BY n_mutations DESC, Patient_ID)::INTEGER AS rank FROM
        (SELECT * FROM v_labels WHERE n_mutations > 3 ORDER BY n_mutations DESC, Patient_ID LIMIT 15)"""
    ),
)
def topk_hypermutators(spark, sf):
    return L.hypermutators(W.labels(spark, sf), threshold=3)


@query(
    "sample_mismatches",
    with_views(
        """SELECT * FROM (SELECT 'only_a' AS side, Patient_ID FROM
           (SELECT Patient_ID FROM v_mutations EXCEPT SELECT Patient_ID FROM v_reports) ORDER BY Patient_ID LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'only_b' AS side, Patient_ID FROM
           (SELECT Patient_ID FROM v_reports EXCEPT SELECT Patient_ID FROM v_mutations) ORDER BY Patient_ID LIMIT 5)"""
    ),
)
def sample_mismatches(spark, sf):
    return O.sample_mismatches(W.mutations(spark, sf), W.reports(spark, sf))


@query(
    "seeded_sample",
    with_views(
        """SELECT Patient_ID, Mutation_Status FROM v_labels ORDER BY md5(Patient_ID || ':42'), Patient_ID LIMIT 3"""
    ),
)
def seeded_sample(spark, sf):
    return D.seeded_sample(W.labels(spark, sf).select("Patient_ID", "Mutation_Status"), "Patient_ID", 3, C.SEED)


# --- arrays and rounding -------------------------------------------------------


@query(
    "gene_set_intersect",
    with_views(
        "SELECT Patient_ID, targetable_genes AS genes, n_targetable AS n FROM v_labels"
    ),
)
def gene_set_intersect(spark, sf):
    survivors = L.artefact_gene_filter(L.variant_filter(W.mutations(spark, sf), W.KEEP), W.ARTEFACTS)
    sets = A.patient_gene_sets(survivors)
    universe = W.mutations(spark, sf).select("Patient_ID").distinct()
    found = V.gene_intersect(F.coalesce("mutated_genes", F.array().cast("array<string>")), W.TARGETABLE)
    joined = universe.join(sets, "Patient_ID", "left").withColumn("found", found)
    return joined.select("Patient_ID", V.join_genes(F.col("found")).alias("genes"), F.size("found").alias("n"))


@query(
    "array_join_split",
    with_views("SELECT Patient_ID, all_mutated_genes AS joined, n_mutations AS n FROM v_labels"),
)
def array_join_split(spark, sf):
    flat = L.stored_labels(W.labels(spark, sf))
    arrays = flat.withColumn("genes", V.split_genes(F.col("all_mutated_genes")))
    return arrays.select("Patient_ID", V.join_genes(F.col("genes")).alias("joined"), F.size("genes").alias("n"))


@query("explode_genes", with_views("SELECT Patient_ID, gene FROM v_genes"))
def explode_genes(spark, sf):
    return W.labels(spark, sf).select("Patient_ID", F.explode("mutated_genes").alias("gene"))


@query(
    "gene_flag",
    with_views(
        """SELECT Patient_ID, regexp_matches(all_mutated_genes, '\\bBrand#1\\b')::INTEGER AS has_1,
        regexp_matches(all_mutated_genes, '\\bBrand#11\\b')::INTEGER AS has_11 FROM v_labels"""
    ),
)
def gene_flag(spark, sf):
    flat = L.stored_labels(W.labels(spark, sf))
    genes = F.col("all_mutated_genes")
    return flat.select("Patient_ID", X.has_gene(genes, "Brand#1").alias("has_1"), X.has_gene(genes, "Brand#11").alias("has_11"))


@query(
    "round_half_even",
    """SELECT l_linenumber, l_quantity, n, CASE WHEN h - floor(h) = 0.5 THEN 2 * round(h / 2) ELSE round(h) END AS half_even,
      CASE WHEN h - floor(h) = 0.5 THEN floor(h) + 1 ELSE round(h) END AS half_up
    FROM (SELECT l_linenumber, l_quantity, count(*) AS n, l_quantity / 2.0::DOUBLE AS h FROM lineitem GROUP BY ALL)""",
)
def round_half_even(spark, sf):
    halves = (
        W.table(spark, sf, "lineitem")
        .groupBy("l_linenumber", "l_quantity")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", F.col("l_quantity") / 2.0)
    )
    return halves.select(
        "l_linenumber",
        "l_quantity",
        "n",
        V.round_even(F.col("h"), 0).alias("half_even"),
        F.round("h", 0).alias("half_up"),
    )


@query(
    "priority_score",
    with_views(
        f"""SELECT Patient_ID, round_even((Mutation_Status = '{C.TARGETABLE}')::INTEGER * 0.5::DOUBLE + round_even(probability, 4) * 0.3::DOUBLE
          + n_mutations / (SELECT max(n_mutations) FROM v_labels)::DOUBLE * 0.2::DOUBLE, 4) AS priority
        FROM v_labels JOIN v_predictions USING (Patient_ID)"""
    ),
)
def priority_score(spark, sf):
    labels = W.labels(spark, sf)
    largest = labels.agg(F.max("n_mutations").alias("largest"))
    joined = labels.join(W.predictions(spark, sf), "Patient_ID").crossJoin(F.broadcast(largest))
    confidence = V.round_even(F.col("probability"), 4)
    priority = V.priority_score(F.col("Mutation_Status"), confidence, F.col("n_mutations"), F.col("largest"))
    return joined.select("Patient_ID", priority.alias("priority"))


@query(
    "label_encode",
    with_views(
        f"""SELECT Patient_ID, CASE Mutation_Status WHEN '{C.TARGETABLE}' THEN 2 WHEN '{C.NON_TARGETABLE}' THEN 1 ELSE 0 END AS y_3class,
        (Mutation_Status = '{C.TARGETABLE}')::INTEGER AS y_binary FROM v_labels"""
    ),
)
def label_encode(spark, sf):
    return encode_labels(W.labels(spark, sf)).select("Patient_ID", "y_3class", "y_binary")
