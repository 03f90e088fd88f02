"""The domain tables, derived from the given ones: in Spark, and in SQL as CTEs.

Patients are orders, their mutations are the lines of the order (gene = brand of
the part, variant = type of the part), reports are the documents. The lists of
kept variants and special genes are replaced by brands and types to match.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import text as X
from cohortspark.plans import align as AL
from cohortspark.plans import labeling as L
from cohortspark.session import SPREAD, stored

KEEP = ("SMALL", "PROMO", "LARGE")
ARTEFACTS = ("Brand#1", "Brand#2")
TARGETABLE = ("Brand#5", "Brand#7", "Brand#9", "Brand#11", "Brand#13")
DRUGS = {"Brand#5": "Osimertinib", "Brand#7": "Vemurafenib", "Brand#9": "Sotorasib"}

# every abbreviation and every kind of boilerplate occurs around each report
REPORT_HEAD = (
    "Hx of CA, SCC with LVI/PNI; mets. Dx: adenoca (bx). Tx: chemo, RT, neoadj/adj. Dz, pathol, hem; CA CA ca-125.\n"
    "Copy No. 3 Page 1 / 2\nPrinted on 01/02 by lab\n"
)
REPORT_TAIL = (
    "\nDisclaimer: none\nReport generated today\nThis report was generated by X\nPathology report, page 4 of 5\n"
    "Electronic signature: A\nElectronically signed B\nThis is a confidential note\nEnd of report xyz"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out over as many partitions as the session asks for (`session.SPREAD`), by default not at all.

    For one machine with files that cannot be split; a cluster leaves the setting alone.
    """
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions)) if partitions else df


def pid(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key

    def base36(number: Column, width: int) -> Column:
        # lpad would cut longer numbers, and with them make one patient of several
        digits = F.conv(number.cast("string"), 10, 36)
        return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)

    return F.concat(F.lit("TCGA-"), base36(key % 40, 2), F.lit("-"), base36(key, 4))


def raw_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.nullif(F.col("p_brand"), F.lit("Brand#25")).alias("Hugo_Symbol"),
        F.concat(pid("l_orderkey"), F.lit("-01A")).alias("Tumor_Sample_Barcode"),
        F.col("p_type").alias("Variant_Classification"),
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.with_mutation_patient(raw_mutations(spark, sf_dir))


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    patient, digest = pid("doc_id"), F.md5(F.col("doc_id").cast("string"))
    name = (
        F.when(F.col("source") == "src7", F.concat(F.lit("scan_"), digest))
        .when(F.col("source") == "src5", F.concat(F.lit("x/"), patient, F.lit(".txt")))
        .when(F.col("source") == "src3", F.concat(patient, F.lit("Z."), digest))
        .otherwise(F.concat(patient, F.lit("."), digest))
    )
    return docs.select(
        name.alias("patient_filename"),
        F.concat(F.lit(REPORT_HEAD), F.col("text"), F.lit(REPORT_TAIL)).alias("text"),
        F.col("doc_id").alias("row_order"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.with_report_patient(raw_reports(spark, sf_dir))


def reports_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several reports per patient: the turns of a conversation."""
    return table(spark, sf_dir, "conversations").select(
        pid("conv_id").alias("Patient_ID"), "text", F.col("turn").alias("row_order")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_patients(mutations(spark, sf_dir), KEEP, ARTEFACTS, TARGETABLE)


def clean_documents(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Every document, or those of `ids` (doc_id), cleaned whole, with the report head and tail around it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if ids is not None:
        docs = docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    docs = spread(docs)
    framed = F.concat(F.lit(REPORT_HEAD), F.col("text"), F.lit(REPORT_TAIL))
    return docs.select("doc_id", X.clean_text(framed).alias("clean_text"))


def stored_clean_documents(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The same as a stored table, for jobs that read the cleaned text more than once."""
    return stored(clean_documents(spark, sf_dir, ids), "clean")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with ties and a label for every line, grouped by supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.floor(F.col("l_extendedprice") / 11.0) / 10000.0).alias("score"),
        F.col("l_linestatus").alias("side"),
        F.col("l_linenumber").alias("model"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probability per patient (orders without lines have no label row) and the true class."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).select(
        pid("o_orderkey").alias("Patient_ID"), (F.col("o_totalprice") / 550000.0).alias("probability")
    )
    status = labels(spark, sf_dir).select("Patient_ID", "Mutation_Status")
    return orders.join(status, "Patient_ID", "left").select(
        "Patient_ID",
        F.coalesce((F.col("Mutation_Status") == C.TARGETABLE).cast("int"), F.lit(0)).alias("label"),
        "probability",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").alias("class"),
        (F.col("label") < 5).cast("int").alias("label"),
        F.concat(F.lit("GENE"), F.col("label").cast("string")).alias("targetable_genes"),
    )


# --- the same views in SQL -------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def sql_pid(key: str) -> str:
    return f"('TCGA-' || to_base(({key}) % 40, 36, 2) || '-' || to_base({key}, 36, 4))"


def sql_clean_min(text: str) -> str:
    return f"trim(regexp_replace({text}, '[^a-z0-9.\\-]+', ' ', 'g'))"


def sql_clean(text: str) -> str:
    """RE2 knows no Unicode word boundary, so the neighbours are matched and put back, twice for shared ones."""
    out = f"lower({text})"
    for short, full in C.MEDICAL_ABBREVIATIONS.items():
        edge = r"[^\p{L}\p{N}_]"
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|{edge}){short}($|{edge})', '\\1{full}\\2', 'g')"
    for pattern in C.BOILERPLATE_PATTERNS:
        regex = pattern.replace("\\s", X.SPACE).replace("\\d", r"\p{Nd}")
        out = f"regexp_replace({out}, '{regex}', '', 'g')"
    return sql_clean_min(out)


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{X.SPACE}+'), lambda w: w <> '')"


def sql_framed(text: str) -> str:
    def literal(s: str) -> str:
        return " || chr(10) || ".join(quoted(part) for part in s.split("\n"))

    return f"({literal(REPORT_HEAD)} || {text} || {literal(REPORT_TAIL)})"


_SURVIVES = f"v IN {sql_list(KEEP)} AND (g IS NULL OR g NOT IN {sql_list(ARTEFACTS)})"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_mutations": (
        (),
        f"""SELECT nullif(p_brand, 'Brand#25') AS Hugo_Symbol, {sql_pid('l_orderkey')} || '-01A' AS Tumor_Sample_Barcode,
            p_type AS Variant_Classification, {sql_pid('l_orderkey')} AS Patient_ID
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "v_reports_raw": (
        (),
        f"""SELECT CASE WHEN source = 'src7' THEN 'scan_' || md5(doc_id::VARCHAR)
              WHEN source = 'src5' THEN 'x/' || {sql_pid('doc_id')} || '.txt'
              WHEN source = 'src3' THEN {sql_pid('doc_id')} || 'Z.' || md5(doc_id::VARCHAR)
              ELSE {sql_pid('doc_id')} || '.' || md5(doc_id::VARCHAR) END AS patient_filename,
            {sql_framed('text')} AS text, doc_id AS row_order FROM documents""",
    ),
    "v_reports": (
        ("v_reports_raw",),
        f"""SELECT * FROM (SELECT *, nullif(regexp_extract(patient_filename, '{C.ID_CAPTURE}', 1), '') AS Patient_ID
        FROM v_reports_raw) WHERE Patient_ID IS NOT NULL""",
    ),
    "v_reports_multi": (
        (),
        f"SELECT {sql_pid('conv_id')} AS Patient_ID, text, turn AS row_order FROM conversations",
    ),
    "v_genes": (
        ("v_mutations",),
        f"""SELECT DISTINCT Patient_ID, g AS gene FROM
          (SELECT Patient_ID, Hugo_Symbol AS g, Variant_Classification AS v FROM v_mutations)
        WHERE {_SURVIVES} AND g IS NOT NULL""",
    ),
    "v_labels": (
        ("v_mutations", "v_genes"),
        f"""SELECT Patient_ID, CASE WHEN n_targetable > 0 THEN '{C.TARGETABLE}'
              WHEN n_mutations > 0 THEN '{C.NON_TARGETABLE}' ELSE '{C.NO_MUTATION}' END AS Mutation_Status,
            targetable_genes, n_mutations, n_targetable, all_mutated_genes FROM
          (SELECT u.Patient_ID, count(gene)::INTEGER AS n_mutations,
             (count(gene) FILTER (WHERE gene IN {sql_list(TARGETABLE)}))::INTEGER AS n_targetable,
             coalesce(string_agg(gene, '|' ORDER BY gene) FILTER (WHERE gene IN {sql_list(TARGETABLE)}), '') AS targetable_genes,
             coalesce(string_agg(gene, '|' ORDER BY gene), '') AS all_mutated_genes
           FROM (SELECT DISTINCT Patient_ID FROM v_mutations) u LEFT JOIN v_genes USING (Patient_ID) GROUP BY u.Patient_ID)""",
    ),
    "v_clean": (
        (),
        f"SELECT doc_id, {sql_clean(sql_framed('text'))} AS clean_text FROM documents",
    ),
    "v_scored": (
        (),
        """SELECT l_suppkey AS grp, (l_returnflag = 'R')::INTEGER AS label,
            floor(l_extendedprice / 11.0::DOUBLE) / 10000.0::DOUBLE AS score,
            l_linestatus AS side, l_linenumber AS model FROM lineitem""",
    ),
    "v_predictions": (
        ("v_labels",),
        f"""SELECT Patient_ID, coalesce((Mutation_Status = '{C.TARGETABLE}')::INTEGER, 0) AS label, probability
        FROM (SELECT {sql_pid('o_orderkey')} AS Patient_ID, o_totalprice / 550000.0::DOUBLE AS probability FROM orders)
        LEFT JOIN v_labels USING (Patient_ID)""",
    ),
    "v_prediction_table": (
        ("v_predictions",),
        f"""SELECT Patient_ID, label AS True_Label, (probability > 0.5)::INTEGER AS Predicted,
            CASE WHEN probability > 0.5 THEN '{C.PREDICTED_POSITIVE}' ELSE '{C.PREDICTED_NEGATIVE}' END AS Predicted_Class,
            probability AS Probability, round_even(probability, 4) AS Confidence_Score,
            label = (probability > 0.5)::INTEGER AS Correct FROM v_predictions""",
    ),
    "v_vectors": (
        (),
        """SELECT vec_id, embedding, label AS class, (label < 5)::INTEGER AS label,
            'GENE' || label AS targetable_genes FROM embeddings""",
    ),
    "v_tokens": (
        ("v_clean",),
        f"SELECT doc_id, regexp_extract_all(clean_text, '{C.TOKEN_PATTERN}') AS t FROM v_clean",
    ),
    "v_grams": (
        ("v_tokens",),
        """SELECT doc_id, unnest(t) AS term FROM v_tokens
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM v_tokens
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM v_tokens""",
    ),
    "v_tf": (("v_grams",), "SELECT doc_id, term, count(*) AS tf FROM v_grams GROUP BY doc_id, term"),
    "v_vocab": (
        ("v_tf",),
        f"""SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_idx,
             ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1 AS idf FROM
          (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, (SELECT count(*) FROM documents) AS n_docs
           FROM v_tf GROUP BY term
           HAVING count(*) >= {C.TFIDF_MIN_DF} AND count(*) <= {C.TFIDF_MAX_DF}::DOUBLE * (SELECT count(*) FROM documents)
           ORDER BY sum(tf) DESC, term LIMIT {C.TFIDF_MAX_FEATURES})""",
    ),
    "v_weights": (
        ("v_tf", "v_vocab"),
        """SELECT doc_id, term_idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM
          (SELECT doc_id, term_idx, (1 + ln(v_tf.tf::DOUBLE)) * idf AS w FROM v_tf JOIN v_vocab USING (term))""",
    ),
}


def with_views(sql: str) -> str:
    """Prefix `sql` with the views it names, and the views those need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    words = set("".join(c if c.isalnum() or c == "_" else " " for c in sql).split())
    for name in VIEWS:
        if name in words:
            need(name)
    if not order:
        return sql
    ctes = ", ".join(f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
