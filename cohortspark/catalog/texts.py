"""Text functions, TF-IDF and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.catalog import views as W
from cohortspark.catalog.registry import query
from cohortspark.catalog.views import sql_clean, sql_clean_min, sql_words, with_views
from cohortspark.functions import text as X
from cohortspark.operators import aggregates as A
from cohortspark.operators import embedding as E
from cohortspark.operators import latent as LA
from cohortspark.operators import tfidf as TI
from cohortspark.plans.text_dataset import build_text_dataset
from cohortspark.session import stored


def r6(col):
    return F.round(col, 6)


def _documents(spark, sf):
    return W.spread(W.table(spark, sf, "documents").select("doc_id", "text"))


@query("clean_text", with_views("SELECT doc_id, length(clean_text)::INTEGER AS n_chars, md5(clean_text) AS digest FROM v_clean"))
def clean_text(spark, sf):
    out = W.clean_documents(spark, sf)
    return out.select("doc_id", F.length("clean_text").alias("n_chars"), F.md5("clean_text").alias("digest"))


@query("clean_text_min", f"SELECT doc_id, md5({sql_clean_min('lower(text)')}) AS digest FROM documents")
def clean_text_min(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(X.clean_text_min(F.col("text"))).alias("digest"))


@query("word_count", f"SELECT doc_id, len({sql_words('text')})::INTEGER AS n_words FROM documents")
def word_count(spark, sf):
    return _documents(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query(
    "truncate_words",
    f"SELECT doc_id, md5(array_to_string(list_slice({sql_words('text')}, 1, {C.MAX_WORDS}), ' ')) AS digest FROM documents",
)
def truncate_words(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(X.truncate_words(F.col("text"))).alias("digest"))


@query("report_excerpt", "SELECT doc_id, substr(text, 1, 200) AS excerpt FROM documents")
def report_excerpt(spark, sf):
    return _documents(spark, sf).select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query(
    "tokenize_pattern",
    with_views("SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM v_tokens"),
)
def tokenize_pattern(spark, sf):
    toks = W.clean_documents(spark, sf).select("doc_id", X.tokens(F.col("clean_text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("digest"))


@query(
    "word_ngrams",
    with_views("SELECT doc_id, count(term)::INTEGER AS n_grams, md5(coalesce(string_agg(term, '|' ORDER BY term), '')) AS digest FROM documents LEFT JOIN v_grams USING (doc_id) GROUP BY doc_id"),
)
def word_ngrams(spark, sf):
    grams = TI.with_ngrams(W.clean_documents(spark, sf), "clean_text")
    joined = F.array_join(F.sort_array("grams"), "|")
    return grams.select("doc_id", F.size("grams").alias("n_grams"), F.md5(joined).alias("digest"))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def strip_accents(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(X.strip_accents(F.col("text"))).alias("digest"))


@query(
    "text_length_stats",
    with_views(
        f"""WITH n AS (SELECT len({sql_words('clean_text')}) AS w FROM v_clean)
        SELECT count(*) AS n_texts, round(avg(w), 6) AS mean_words, quantile_cont(w, 0.5)::DOUBLE AS median_words,
          min(w)::BIGINT AS min_words, max(w)::BIGINT AS max_words FROM n"""
    ),
)
def text_length_stats(spark, sf):
    return A.text_length_stats(W.clean_documents(spark, sf), "clean_text").withColumn("mean_words", r6(F.col("mean_words")))


@query(
    "top_unigrams",
    with_views(
        f"""WITH w AS (SELECT quality, unnest({sql_words('clean_text')}) AS word FROM v_clean JOIN labels USING (doc_id)),
        c AS (SELECT quality, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT quality, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, word)::INTEGER AS rank FROM c) WHERE rank <= 20"""
    ),
)
def top_unigrams(spark, sf):
    labels = W.table(spark, sf, "labels").select("doc_id", "quality")
    return A.top_unigrams(W.clean_documents(spark, sf).join(labels, "doc_id"), "clean_text", by="quality")


_LABELLED_TEXT_SQL = f"""longest AS (SELECT Patient_ID, text FROM
    (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY length(text) DESC NULLS LAST, row_order) AS rn FROM v_reports) WHERE rn = 1),
  texts AS (SELECT Patient_ID, {sql_clean('text')} AS clean_text, Mutation_Status FROM longest JOIN v_labels USING (Patient_ID)
    WHERE text IS NOT NULL AND text <> 'nan')"""


@query(
    "text_dataset",
    with_views(
        f"""WITH {_LABELLED_TEXT_SQL} SELECT Patient_ID, md5(clean_text) AS digest, Mutation_Status FROM texts WHERE clean_text <> ''"""
    ),
)
def text_dataset(spark, sf):
    out = build_text_dataset(W.labels(spark, sf), W.reports(spark, sf))
    return out.select("Patient_ID", F.md5("clean_text").alias("digest"), "Mutation_Status")


# --- TF-IDF --------------------------------------------------------------------


@query("tfidf_vocab", with_views("SELECT term, df, tf, term_idx::INTEGER AS term_idx FROM v_vocab"))
def tfidf_vocab(spark, sf):
    return TI.fit_vocab(W.clean_documents(spark, sf), "clean_text").select("term", "df", "tf", "term_idx")


@query("tfidf_idf", with_views("SELECT term, n_docs, round(idf, 6) AS idf FROM v_vocab"))
def tfidf_idf(spark, sf):
    vocab = TI.fit_vocab(W.clean_documents(spark, sf), "clean_text")
    return vocab.select("term", "n_docs", r6(F.col("idf")).alias("idf"))


@query("tfidf_weights", with_views("SELECT doc_id, term_idx::INTEGER AS term_idx, round(weight, 6) AS weight FROM v_weights"))
def tfidf_weights(spark, sf):
    docs = W.stored_clean_documents(spark, sf)
    weights = TI.fit_tfidf(docs, "clean_text").weights(docs, "doc_id", "clean_text")
    return weights.withColumn("weight", r6(F.col("weight")))


@query(
    "tfidf_matrix_stats",
    with_views(
        """WITH n AS (SELECT count(*) AS nnz FROM v_weights), d AS (SELECT count(*) AS n_docs FROM documents), t AS (SELECT count(*) AS n_terms FROM v_vocab)
        SELECT n_docs, n_terms, nnz, round(1 - nnz / (n_docs::DOUBLE * n_terms), 6) AS sparsity FROM n, d, t"""
    ),
)
def tfidf_matrix_stats(spark, sf):
    docs = W.stored_clean_documents(spark, sf)
    model = TI.fit_tfidf(docs, "clean_text")
    stats = TI.matrix_stats(model.weights(docs, "doc_id", "clean_text"), docs, model.table(spark))
    return stats.withColumn("sparsity", r6(F.col("sparsity")))


_FIT_ON_LABELLED = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM v_grams GROUP BY ALL),
  fit AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM labels)),
  n AS (SELECT count(*) AS n_docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
  vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_idx, ln((1.0::DOUBLE + (SELECT n_docs FROM n)) / (1.0::DOUBLE + df)) + 1 AS idf FROM
    (SELECT term, count(*) AS df FROM fit GROUP BY term
     HAVING count(*) >= {C.TFIDF_MIN_DF} AND count(*) <= {C.TFIDF_MAX_DF}::DOUBLE * (SELECT n_docs FROM n)
     ORDER BY sum(tf) DESC, term LIMIT {C.TFIDF_MAX_FEATURES})),
  raw AS (SELECT doc_id, term_idx, (1 + ln(tf::DOUBLE)) * idf AS w FROM tf JOIN vocab USING (term)),
  weights AS (SELECT doc_id, term_idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _model_of_labelled(spark, sf, docs):
    """A model fitted on the documents that have a label, for use on all documents."""
    labelled = docs.join(W.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return TI.fit_tfidf(labelled, "clean_text")


@query(
    "tfidf_transform",
    with_views(f"WITH {_FIT_ON_LABELLED} SELECT doc_id, term_idx::INTEGER AS term_idx, round(weight, 6) AS weight FROM weights"),
)
def tfidf_transform(spark, sf):
    docs = W.stored_clean_documents(spark, sf)
    weights = _model_of_labelled(spark, sf, docs).weights(docs, "doc_id", "clean_text")
    return weights.withColumn("weight", r6(F.col("weight")))


@query(
    "tfidf_vectors",
    with_views(
        f"""WITH {_FIT_ON_LABELLED} SELECT doc_id, (SELECT count(*) FROM vocab)::INTEGER AS dim, count(term_idx)::INTEGER AS nnz,
          round(coalesce(sum(weight), 0), 6) AS total, md5(coalesce(string_agg(term_idx::VARCHAR, ',' ORDER BY term_idx), '')) AS digest
        FROM documents LEFT JOIN weights USING (doc_id) GROUP BY doc_id"""
    ),
)
def tfidf_vectors(spark, sf):
    docs = W.stored_clean_documents(spark, sf)
    vectors = _model_of_labelled(spark, sf, docs).stored_vectors(docs, "clean_text")
    parts = vectors.select("doc_id", F.unwrap_udt("features").alias("v"))
    total = F.aggregate("v.values", F.lit(0.0), lambda t, x: t + x)
    return parts.select(
        "doc_id",
        F.col("v.size").alias("dim"),
        F.size("v.indices").alias("nnz"),
        r6(total).alias("total"),
        F.md5(F.array_join("v.indices", ",")).alias("digest"),
    )


# --- embeddings ----------------------------------------------------------------

_HASHED_SQL = f"""toks AS (SELECT doc_id, unnest({sql_words('clean_text')}) AS word FROM v_clean),
  bytes AS (SELECT doc_id, i, ('0x' || substr(md5(word), (2 * i + 1)::INTEGER, 2))::INTEGER AS b FROM toks, range(16) r(i))"""


@query(
    "embed_documents",
    with_views(f"WITH {_HASHED_SQL} SELECT doc_id, i::INTEGER AS dim, sum(b)::BIGINT AS total FROM bytes GROUP BY ALL"),
)
def embed_documents(spark, sf):
    """Mean-pooled vectors, compared by the whole numbers that were averaged."""
    docs = W.stored_clean_documents(spark, sf)
    vectors = E.embed(docs, "doc_id", "clean_text", E.HashedTokens(16))
    n_words = X.word_count(F.col("clean_text"))
    long = vectors.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    counted = long.join(docs.select("doc_id", n_words.alias("n")), "doc_id")
    return counted.select("doc_id", "dim", F.rint((F.col("x") + 1.0) * 127.5 * F.col("n")).cast("long").alias("total"))


@query("word2vec_embeddings")
def word2vec_embeddings(spark, sf):
    return E.word2vec_embed(W.clean_documents(spark, sf), "doc_id", "clean_text")


@query(
    "masked_mean_pool",
    """SELECT label, dim::INTEGER AS dim, round(coalesce(sum(x) FILTER (WHERE m = 1), 0) / greatest(count(*) FILTER (WHERE m = 1), 1e-9), 6) AS x FROM
      (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim,
         CASE WHEN label = 9 THEN 0 ELSE (embedding[1] > 0)::INTEGER END AS m FROM embeddings) GROUP BY ALL""",
)
def masked_mean_pool(spark, sf):
    mask = F.when(F.col("label") == 9, 0).otherwise((F.col("embedding")[0] > 0).cast("int"))
    tokens = W.table(spark, sf, "embeddings").withColumn("mask", mask)
    pooled = E.masked_mean_pool(tokens, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", r6(F.col("x")))


@query(
    "l2_normalize",
    """SELECT vec_id, dim::INTEGER AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM
      (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)""",
)
def l2_normalize(spark, sf):
    unit = W.table(spark, sf, "embeddings").select("vec_id", E.l2_normalize(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("dim", "x")).withColumn("x", r6(F.col("x")))


def _latent(spark, sf):
    """The cleaned documents, stored, their TF-IDF rows, stored, and the encoder fitted on these."""
    docs = W.stored_clean_documents(spark, sf)
    model = TI.fit_tfidf(docs, "clean_text")
    vectors = model.stored_vectors(docs, "clean_text")
    return docs, vectors, *LA.fit_on_vectors(vectors, model)


@query(
    "latent_components",
    with_views(
        """SELECT unnest(range(8))::INTEGER AS component, true AS singular, true AS orthogonal,
          (SELECT count(*) FROM v_vocab) AS n_terms, (SELECT count(DISTINCT doc_id) FROM v_weights) AS n_docs"""
    ),
)
def latent_components(spark, sf):
    """Whether the leading eight components are singular vectors of the TF-IDF matrix, from its long form and by joins.

    A component v of value s is one if multiplying the matrix and its transpose gives s^2 v back.
    """
    _, vectors, encoder, found = _latent(spark, sf)
    rows = [(i, row[:8]) for i, row in enumerate(encoder.components.tolist())]
    parts = spark.createDataFrame(rows, "term_idx int, v array<double>")  # bounded by the features of the fit
    matrix = vectors.select("doc_id", F.unwrap_udt("features").alias("x"))

    def cells(rows, *keep):  # a row's cells stay in its task: what is shuffled are sums per document and per term
        return rows.select(*keep, F.inline(F.arrays_zip("x.indices", "x.values"))).toDF(*keep, "term_idx", "weight")

    sums = F.array(*[F.sum(F.col("weight") * F.col("v")[k]) for k in range(8)])
    placed = stored(cells(matrix, "doc_id").join(F.broadcast(parts), "term_idx").groupBy("doc_id").agg(sums.alias("u")), "placed")
    of_term = F.array(*[F.sum(F.col("weight") * F.col("u")[k]) for k in range(8)])
    back = cells(matrix.join(placed, "doc_id"), "u").groupBy("term_idx").agg(of_term.alias("back"))
    both = parts.join(back, "term_idx", "left")  # as many rows as the vocabulary has terms
    squares = (found.values[:8] ** 2).tolist()
    gaps = [F.sum(F.pow(F.coalesce(F.col("back")[k], F.lit(0.0)) - squares[k] * F.col("v")[k], F.lit(2.0))) for k in range(8)]
    dots = [F.array(*[F.sum(F.col("v")[j] * F.col("v")[k]) for j in range(8)]) for k in range(8)]
    checked = both.agg(F.count(F.lit(1)).alias("n_terms"), F.array(*gaps).alias("gaps"), F.array(*dots).alias("dots"))
    long = checked.select("n_terms", F.posexplode(F.arrays_zip("gaps", "dots")).alias("component", "at"))
    unit = F.transform("at.dots", lambda x, j: F.abs(x - (j == F.col("component")).cast("double")) < 1e-9)
    counted = placed.agg(F.count(F.lit(1)).alias("n_docs"))
    return long.crossJoin(F.broadcast(counted)).select(
        "component",
        (F.sqrt(F.col("at.gaps")) < 1e-4 * squares[0]).alias("singular"),
        F.forall(unit, lambda x: x).alias("orthogonal"),
        "n_terms",
        "n_docs",
    )


@query(
    "embed_with_fallback",
    with_views(
        """SELECT doc_id, 'latent' AS encoder, 64::INTEGER AS dim, doc_id IN (SELECT doc_id FROM v_weights) AS placed, true AS within
        FROM documents"""
    ),
)
def embed_with_fallback(spark, sf):
    """Vectors of the second candidate, learned from the documents, where the first has no model files.

    Unit TF-IDF rows are projected on orthogonal directions, so no vector is longer than 1.
    """
    docs, _, encoder, _ = _latent(spark, sf)

    def network():
        raise FileNotFoundError("no model files on this machine")

    vectors = E.embed_with(docs, "doc_id", "clean_text", [("network", network), (encoder.name, encoder)])
    squared = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return vectors.select(
        "doc_id",
        F.substring_index("model_used", "-", 1).alias("encoder"),
        F.size("embedding").alias("dim"),
        (squared > 0).alias("placed"),
        (squared <= 1 + 1e-6).alias("within"),
    )
