"""Readers, writers and checkpoints, each through files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.catalog.registry import query
from cohortspark.catalog.relational import _SUMMARY_SQL as SUMMARY_SQL
from cohortspark.catalog.views import sql_list, with_views
from cohortspark.operators import aggregates as A
from cohortspark.plans import align as AL
from cohortspark.plans import labeling as L
from cohortspark.session import scratch_path
from cohortspark.sources import checkpoints as K
from cohortspark.sources import delimited as S
from cohortspark.sources.incremental import refresh


@query(
    "scan_mutations_tsv",
    with_views(
        """SELECT replace(Hugo_Symbol, '#', '') AS Hugo_Symbol, Variant_Classification, Patient_ID FROM v_mutations"""
    ),
)
def scan_mutations_tsv(spark, sf):
    """A wide table with comment lines, comments at line ends and written-out missing values."""
    rows = W.raw_mutations(spark, sf).select(
        F.coalesce(F.regexp_replace("Hugo_Symbol", "#", ""), F.lit("NA")).alias("Hugo_Symbol"),
        F.lit("unused").alias("Center"),
        F.col("Tumor_Sample_Barcode"),
        F.concat("Variant_Classification", F.when(F.col("Hugo_Symbol").isNull(), "#no symbol").otherwise("")).alias(
            "Variant_Classification"
        ),
    )
    comments = W.table(spark, sf, "region").select(
        F.concat(F.lit("#region "), "r_name").alias("Hugo_Symbol"),
        *[F.lit("").alias(c) for c in ("Center", "Tumor_Sample_Barcode", "Variant_Classification")],
    )
    path = scratch_path(spark, "mutations")
    S.write_tsv(comments.unionAll(rows), path)
    return AL.with_mutation_patient(S.read_mutations(spark, path)).select(
        "Hugo_Symbol", "Variant_Classification", "Patient_ID"
    )


@query(
    "scan_reports_csv",
    with_views(
        """SELECT patient_filename, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM
        (SELECT patient_filename, '"' || text || '", end' AS text FROM v_reports_raw)"""
    ),
)
def scan_reports_csv(spark, sf):
    """Free text with line breaks, quotes and commas."""
    path = scratch_path(spark, "reports")
    quoted = F.concat(F.lit('"'), "text", F.lit('", end')).alias("text")
    W.raw_reports(spark, sf).select("patient_filename", F.lit(1).alias("extra"), quoted).write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    back = S.read_reports(spark, path)
    return back.select("patient_filename", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


_NA_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'NA' ELSE o_orderstatus END"
_NA_PRIORITY = "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'N/A' WHEN '5-LOW' THEN '' WHEN '1-URGENT' THEN '<NA>' ELSE o_orderpriority END"


@query(
    "na_normalize",
    f"""SELECT o_orderkey, CASE WHEN s NOT IN {sql_list(C.NA_TOKENS)} THEN s END AS status,
      CASE WHEN p NOT IN {sql_list(C.NA_TOKENS)} THEN p END AS priority
    FROM (SELECT o_orderkey, {_NA_STATUS} AS s, {_NA_PRIORITY} AS p FROM orders)""",
)
def na_normalize(spark, sf):
    orders = W.table(spark, sf, "orders").select(
        "o_orderkey", F.expr(_NA_STATUS).alias("status"), F.expr(_NA_PRIORITY).alias("priority")
    )
    return S.normalize_na(orders)


_LABEL_SCHEMA = "Patient_ID string, Mutation_Status string, targetable_genes string, n_mutations int, all_mutated_genes string"


@query(
    "sink_tsv_roundtrip",
    with_views(
        """SELECT Patient_ID, Mutation_Status, nullif(targetable_genes, '') AS targetable_genes, n_mutations,
        nullif(all_mutated_genes, '') AS all_mutated_genes FROM v_labels"""
    ),
)
def sink_tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "labels")
    S.write_tsv(L.stored_labels(W.labels(spark, sf)), path)
    return S.read_tsv(spark, path, _LABEL_SCHEMA)


@query(
    "sink_parquet_roundtrip",
    """SELECT vec_id, label, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0::DOUBLE AS total FROM embeddings""",
)
def sink_parquet_roundtrip(spark, sf):
    stored = K.checkpoint(W.vectors(spark, sf).select("vec_id", F.col("class").alias("label"), "embedding", "features"), scratch_path(spark, "vectors"))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return stored.select("vec_id", "label", F.size("embedding").alias("n"), (F.round(total, 4) + 0.0).alias("total"))


@query("materialize_once", with_views(f"WITH {SUMMARY_SQL} SELECT * FROM summary"))
def materialize_once(spark, sf):
    """Built on the first call; the second finds it complete."""
    path = scratch_path(spark, "summary")
    K.materialize(spark, path, lambda: A.patient_mutation_summary(W.mutations(spark, sf)))

    def never():
        raise RuntimeError("a complete table was built again")

    return K.materialize(spark, path, never)


@query(
    "refresh_changed",
    """WITH d AS (SELECT coalesce(doc_id, 0) % 4 AS part, text FROM documents),
    n AS (SELECT count(*) AS n, count(*) FILTER (WHERE part <> 1) AS fewer FROM d WHERE text IS NOT NULL)
    SELECT unnest(['built', 'unchanged', 'file replaced', 'parameter changed']) AS step, unnest([4, 0, 1, 4])::INTEGER AS rebuilt,
      unnest([0, 4, 3, 0])::INTEGER AS kept, unnest([0, 0, 1, 0])::INTEGER AS removed, unnest([n, n, fewer, fewer]) AS n_rows FROM n""",
)
def refresh_changed(spark, sf):
    """Word counts of documents kept up to date with their files: those of one part are replaced by an empty one, then a parameter changes.

    A part has as many files as tasks write it; counted are the parts whose files were built, kept or removed.
    """
    docs = W.spread(W.table(spark, sf, "documents")).select((F.coalesce("doc_id", F.lit(0)) % 4).alias("part"), "doc_id", "text")
    folder, path = scratch_path(spark, "inputs"), scratch_path(spark, "refreshed")

    def write(part, rows):
        rows.drop("part").write.mode("overwrite").parquet(f"{folder}/part{part}")

    def build(rows):
        return rows.where("text IS NOT NULL").select("doc_id", F.size(F.split("text", " ")).alias("n_words"), "source")

    for part in range(4):
        write(part, docs.where(F.col("part") == part))
    steps = []

    def step(name, width):
        run = refresh(spark, folder, path, build, "1", {"width": width})
        parts = [len({path.rsplit("/", 2)[1] for path in paths}) for paths in (run.rebuilt_paths, run.kept_paths, run.removed_paths)]
        steps.append((name, *parts, run.table.count()))

    step("built", 1)
    step("unchanged", 1)
    write(1, docs.where("false"))
    step("file replaced", 1)
    step("parameter changed", 2)
    return spark.createDataFrame(steps, "step string, rebuilt int, kept int, removed int, n_rows bigint")
