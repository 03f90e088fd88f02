"""Scoring reports as their files arrive.

Scoring needs no state: a report is cleaned, embedded and scored on its own, so
there is neither watermark nor state store here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from cohortspark.operators.embedding import EncoderFactory
from cohortspark.plans.scoring import score_reports
from cohortspark.sources.checkpoints import Bundle


def score_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    id_col: str,
    text: str,
    bundle: Bundle,
    encoder: EncoderFactory,
    sink: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score Parquet files that land in `source` into Parquet files under `sink`, each exactly once."""
    reports = spark.readStream.schema(schema).parquet(source)
    scored = score_reports(reports, id_col, text, bundle, encoder)
    writer = scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
