"""Train/test split and folds by hash order.

The order of a row is the md5 of its id and a seed, so a split depends on ids
only: not on partitioning, feature set or engine. The exact rank inside a class
is found without sorting a class in one task: rows fall into buckets by the
leading hex digits of the hash, buckets are counted, and only ranks inside a
bucket need a sort. Buckets are even because the hash is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import constants as C

BUCKET_DIGITS = 4  # 65,536 buckets per class


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def _bucket_offsets(hashed: DataFrame, label: str) -> DataFrame:
    """Per (class, bucket): rows in it, rows in earlier buckets of the class, rows of the class."""
    cells = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    ordered = Window.partitionBy(label).orderBy("_bucket")
    return cells.withColumn(
        "_before", F.sum("_in").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_in")
    ).withColumn("_class", F.sum("_in").over(Window.partitionBy(label)))


def _hashed(df: DataFrame, id_col: str, seed: int, digits: int) -> DataFrame:
    return df.withColumn("_hash", hash_order(id_col, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))


def _cuts(df: DataFrame, id_col: str, label: str, test_fraction: float, seed: int, digits: int) -> DataFrame:
    """Per class the (hash, id) of its last test row."""
    keys = _hashed(df.select(id_col, label), id_col, seed, digits)
    cells = _bucket_offsets(keys, label).withColumn("_n_test", F.ceil(F.col("_class") * F.lit(test_fraction)))
    edge = cells.where("_before < _n_test AND _n_test <= _before + _in").select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_edge"), "_before", "_n_test"
    )
    in_edge = keys.join(edge, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_edge")))
    place = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", id_col))
    return (
        in_edge.withColumn("_place", place + F.col("_before"))
        .where("_place = _n_test")
        .select("_label", F.struct("_hash", F.col(id_col).alias("_id")).alias("_cut"))
    )


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    test_fraction: float = C.TEST_FRACTION,
    seed: int = C.SEED,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add `split`: of every class the first ceil(fraction * n) rows in hash order are 'test'.

    The cut between test and train is one (hash, id) per class, found from the bucket
    counts and the one bucket the cut falls into, and the rows are then compared with
    it: by a broadcast where Spark measures the cuts as small, else by a join whose
    skewed classes adaptive execution splits. Ids must be unique.
    """
    cut = _cuts(df, id_col, label, test_fraction, seed, digits)
    row_order = F.struct(hash_order(id_col, seed).alias("_hash"), F.col(id_col).alias("_id"))
    return (
        df.join(cut, F.col(label).eqNullSafe(F.col("_label")), "left")
        .withColumn("split", F.when(row_order <= F.col("_cut"), "test").otherwise("train"))
        .drop("_label", "_cut")
    )


def hash_rank(df: DataFrame, id_col: str, label: str, seed: int = C.SEED, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Add `rank`: the 1-based place of a row in the hash order of its class."""
    keys = _hashed(df, id_col, seed, digits)
    offsets = _bucket_offsets(keys.select(label, "_bucket"), label).select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_of"), "_before"
    )
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_hash", id_col))
    return (
        keys.withColumn("_place", place)
        .join(offsets, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_of")))
        .withColumn("rank", F.col("_place") + F.col("_before"))
        .select(*df.columns, "rank")
    )


def stratified_folds(
    df: DataFrame, id_col: str, label: str, k: int = C.CV_FOLDS, seed: int = C.SEED, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add `fold` 0..k-1: within a class, rows are dealt out in hash order."""
    ranked = hash_rank(df, id_col, label, seed, digits)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def split_columns(
    df: DataFrame,
    id_col: str,
    labels: str,
    models: int,
    test_fraction: float = C.TEST_FRACTION,
    seed: int = C.SEED,
    digits: int = 3,
) -> DataFrame:
    """Split the rows of many models at once: arrays `train` and `test` in place of the array `labels`.

    `labels` has one entry per model: 0, 1, or NULL where the row is not a row of that model. Every model
    gets the sides that `stratified_split` would give to its rows alone; an entry is NULL on the other side. Only
    (id, model, label) rows are shuffled for the cuts; two cuts a model come back to the rows, as one broadcast row.
    """
    long = df.select(id_col, F.posexplode(labels).alias("_model", "_y")).where("_y IS NOT NULL")
    classes = long.select(id_col, (2 * F.col("_model") + F.col("_y")).cast("int").alias("_code"))
    cuts = _cuts(classes, id_col, "_code", test_fraction, seed, digits)
    found = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_label", "_cut"))).alias("_cuts"))  # two entries a model
    table = found.select(F.transform(F.sequence(F.lit(0), F.lit(2 * models - 1)), lambda c: F.col("_cuts")[c]).alias("_cuts"))
    order = F.struct(hash_order(id_col, seed).alias("_hash"), F.col(id_col).alias("_id"))
    placed = df.withColumn("_order", order).crossJoin(F.broadcast(table))

    def side(test: bool) -> Column:
        def entry(y: Column, i: Column) -> Column:
            in_test = F.col("_order") <= F.get("_cuts", 2 * i + y.cast("int"))
            return F.when(in_test if test else ~in_test, y)

        return F.transform(labels, entry)

    return placed.withColumns({"train": side(False), "test": side(True)}).drop(labels, "_order", "_cuts")
