"""Stored tables, models and the bundle that scoring loads."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.forest import StoredForest
from cohortspark.operators.huber import ModifiedHuberModel

MANIFEST = "name string, kind string, gene string, path string, dim int, encoder string"
_LOADERS = {m.__name__: m for m in (LogisticRegressionModel, RandomForestClassificationModel, ModifiedHuberModel, StoredForest)}


def checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and go on from the stored table."""
    df.write.mode("overwrite").parquet(path)
    return load(df.sparkSession, path, df)


def load(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read if like is None else spark.read.schema(like.schema)
    return reader.parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is at `path`: a job that died half-way left no success marker."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at `path`, built and written only if it is not there yet."""
    if overwrite or not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Bundle:
    """What batch scoring needs: the classifier, the gene models, and the vectors' width and encoder."""

    classifier: object
    gene_models: Mapping[str, object]
    dim: int
    encoder: str

    def manifest_rows(self) -> list[tuple]:
        rows = [("classifier", type(self.classifier).__name__, None, "classifier", self.dim, self.encoder)]
        for gene, model in sorted(self.gene_models.items()):
            rows.append((f"gene_{gene}", type(model).__name__, gene, f"genes/{gene}", self.dim, self.encoder))
        return rows

    def save(self, spark: SparkSession, path: str) -> None:
        """One directory per model, and a manifest table written last."""
        for _, _, gene, place, _, _ in self.manifest_rows():
            model = self.classifier if gene is None else self.gene_models[gene]
            if isinstance(model, ModifiedHuberModel | StoredForest):
                model.save(spark, f"{path}/{place}")
            else:
                model.write().overwrite().save(f"{path}/{place}")
        spark.createDataFrame(self.manifest_rows(), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def bundle_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    rows = bundle_manifest(spark, path).orderBy(F.col("gene").asc_nulls_first()).collect()  # one row per model
    models = {row.gene: _LOADERS[row.kind].load(f"{path}/{row.path}") for row in rows}
    return Bundle(models.pop(None), models, rows[0].dim, rows[0].encoder)
