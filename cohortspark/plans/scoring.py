"""Scoring new reports with a stored bundle."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as C
from cohortspark.functions import text as X
from cohortspark.functions import values as V
from cohortspark.operators.dedup import topk_per_group
from cohortspark.operators.embedding import EncoderFactory, embed, encoder_name
from cohortspark.operators.forest import StoredForest
from cohortspark.operators.huber import ModifiedHuberModel
from cohortspark.sources.checkpoints import Bundle


def _probability(df: DataFrame, model, out: str) -> DataFrame:
    if isinstance(model, ModifiedHuberModel):
        return df.withColumn(out, model.probability(F.col("features")))
    if isinstance(model, StoredForest):  # rows leave Spark for it, and vectors do so as arrays
        held = df.withColumns({"_features": F.col("features"), "features": vector_to_array("features")})
        return model.transform(held, "_features", out).withColumn("features", array_to_vector("features"))
    scored = model.transform(df)
    produced = [model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol()]
    return scored.withColumn(out, vector_to_array(model.getProbabilityCol())[1]).drop(*produced)


def gene_probabilities(df: DataFrame, models: Mapping[str, object], id_col: str, features: str = "features") -> DataFrame:
    """Long form (id, Gene, probability) of every gene model."""
    names = {gene: f"_p{i}" for i, gene in enumerate(models)}
    scored = reduce(lambda d, g: _probability(d, models[g], names[g]), models, df.withColumn("features", F.col(features)))
    pairs = F.array(*[F.struct(F.lit(g).alias("Gene"), F.col(c).alias("probability")) for g, c in names.items()])
    return scored.select(id_col, F.inline(pairs))


def likely_genes(
    probabilities: DataFrame, id_col: str, minimum: float = C.GENE_PROBABILITY_MIN, k: int = C.GENE_TOP_K
) -> DataFrame:
    """The k most probable genes per report among those at or above the minimum."""
    likely = probabilities.where(F.col("probability") >= minimum).withColumn(
        "probability", V.round_even(F.col("probability"), 3)
    )
    return topk_per_group(likely, id_col, [F.col("probability").desc(), F.col("Gene")], k, rank="rank")


def score_vectors(vectors: DataFrame, id_col: str, bundle: Bundle, keep: tuple[str, ...] = ()) -> DataFrame:
    """Class, confidence, likely genes, follow-up and encoder for rows with an `embedding` array.

    Everything happens inside a row, so this holds for batch and stream alike. A vector
    of another width than the models were trained on fails the query.
    """
    width = F.when(F.size("embedding") == bundle.dim, F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"the bundle expects vectors of width {bundle.dim}")).cast("array<float>")
    )
    df = vectors.select(id_col, *keep, array_to_vector(width.cast("array<double>")).alias("features"))
    df = _probability(df, bundle.classifier, "probability")
    names = {gene: f"_p{i}" for i, gene in enumerate(bundle.gene_models)}
    for gene, model in bundle.gene_models.items():
        df = _probability(df, model, names[gene])
    pairs = F.array(
        *[
            F.struct((-V.round_even(F.col(c), 3)).alias("minus"), F.lit(g).alias("gene"), F.col(c).alias("p"))
            for g, c in names.items()
        ]
    ).cast("array<struct<minus:double,gene:string,p:double>>")
    likely = F.slice(F.sort_array(F.filter(pairs, lambda s: s["p"] >= C.GENE_PROBABILITY_MIN)), 1, C.GENE_TOP_K)
    predicted = F.when(F.col("probability") >= 0.5, C.PREDICTED_POSITIVE).otherwise(C.PREDICTED_NEGATIVE)
    texts = {C.PREDICTED_POSITIVE: C.FOLLOW_UP[C.TARGETABLE], C.PREDICTED_NEGATIVE: C.FOLLOW_UP[C.NON_TARGETABLE]}
    note = F.when(V.is_low_confidence(F.col("probability")), C.LOW_CONFIDENCE_NOTE).otherwise("")
    return df.select(
        id_col,
        *keep,
        predicted.alias("predicted_class"),
        V.round_even(F.col("probability"), 4).alias("confidence"),
        F.transform(
            likely, lambda s: F.struct(s["gene"].alias("gene"), (-s["minus"]).alias("probability"))
        ).alias("top_likely_genes"),
        F.concat(V.value_map(predicted, texts), note).alias("follow_up"),
        F.lit(bundle.encoder).alias("model_used"),
    )


def score_reports(reports: DataFrame, id_col: str, text: str, bundle: Bundle, encoder: EncoderFactory, batch_size: int = 64) -> DataFrame:
    """New reports end to end: clean as in training, embed, score. The encoder must be that of the bundle."""
    name = encoder_name(encoder)
    if name != bundle.encoder:
        raise ValueError(f"the bundle was trained on vectors of {bundle.encoder}, not of {name}")
    cleaned = reports.select(id_col, X.clean_text(F.col(text)).alias("clean_text"))
    return score_vectors(embed(cleaned, id_col, "clean_text", encoder, batch_size), id_col, bundle)
