"""Centroid clustering over a VA-file.

A vector approximation has one cell number of `bits` bits for each dimension, cut at the quantiles of all
vectors. For a centroid and a dimension, a lookup table says how little and how much any value of a cell adds
to the squared distance (less a term common to all centroids, which keeps the intervals narrow); summed up they
give an interval of the distance to each centroid. Only where the interval of the nearest centroid overlaps
another one, or where a vector changed its cluster, is the full vector decoded. The sums of the clusters are
carried on by what moved in and out, so that vectors at rest are never touched after the first round.

Everything is whole numbers: components become floor(scale * x), so results do not depend on the order of sums.
What reaches the driver each round are the sums of the clusters, `clusters` times the dimension; what goes out to
the tasks are the tables, `clusters` times the dimension times 2**bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

DIMENSION = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
#: Bits of a cell. Share of vectors whose intervals overlap on 64 dimensions and 8 clusters of unit vectors with
#: little structure: 4 bits 0.97, 5 bits 0.82, 6 bits 0.53, 8 bits 0.12. A cell takes one byte.
BITS = 8
#: Whole numbers beyond this are set to it: squared distances of 64 such components still fit a long.
LIMIT = 1 << 26


def whole_numbers(vector: Column, scale: int, limit: int = LIMIT) -> Column:
    return F.transform(
        vector, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(limit))), F.lit(-float(limit)))).cast("int")
    )


def is_finite(vector: Column) -> Column:
    """No component is null, not a number, or infinite. A null vector is not finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def as_matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix, without copying them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), width)


def as_binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    size = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


@dataclass
class Cells:
    """The cells of every dimension: least and greatest whole number in each, and a middle of the dimension."""

    low: np.ndarray
    high: np.ndarray
    middle: np.ndarray

    @classmethod
    def cut(cls, least: list[int], greatest: list[int], edges: list[list[int]]) -> Cells:
        """`edges` has, for each dimension, the rising first values of all cells but the first."""
        inner = np.sort(np.array(edges, dtype=np.int64), axis=1)
        low = np.concatenate([np.array(least, dtype=np.int64)[:, None], inner], axis=1)
        high = np.concatenate([inner - 1, np.array(greatest, dtype=np.int64)[:, None]], axis=1)
        return cls(low, high, inner[:, inner.shape[1] // 2])

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(self.low[d, 1:], x[:, d], side="right")
        return out

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each centroid the least and the most that a cell adds, dimensions one after the other.

        What is added up is |x - c|^2 - |x - middle|^2: linear in x, so its ends lie at the ends of a cell.
        """
        away = (centroids - self.middle)[:, :, None]
        ends = [away * away - 2 * away * (end - self.middle[:, None])[None] for end in (self.low, self.high)]
        shape = (len(centroids), -1)
        return np.minimum(*ends).reshape(shape), np.maximum(*ends).reshape(shape)


def nearest_by_cells(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, open) for each approximation; where `open`, more than one interval reaches the nearest one."""
    width = tables[0].shape[1] // cells.shape[1]
    at = cells.astype(np.int64) + np.arange(cells.shape[1], dtype=np.int64) * width
    least = np.stack([table[at].sum(axis=1) for table in tables[0]], axis=1)
    most = np.stack([table[at].sum(axis=1) for table in tables[1]], axis=1)
    possible = least <= most.min(axis=1, keepdims=True)
    return possible.argmax(axis=1), possible.sum(axis=1) > 1


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(cells: np.ndarray, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray):
    """(centroid, looked) of each vector; `looked` tells whose full vector was needed. Ties go to the smaller number."""
    found, looked = nearest_by_cells(cells, tables)
    if looked.any():
        found[looked] = distances(x[looked], centroids).argmin(axis=1)
    return found, looked


def _encode(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(batch.num_rows, -1)
            if batch.num_rows:
                columns = [batch.column("vec_id"), as_binary(cells.encode(x)), as_binary(x)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cells", "vector"])

    return run


def _moves(cells: Cells, dimension: int, before: np.ndarray | None, now: np.ndarray):
    """What a task adds to the clusters: cluster, and its change in count and in every sum; then the vectors looked at."""
    tables = cells.tables(now)
    tables_before = None if before is None else cells.tables(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((len(now), dimension + 2), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            approximations = as_matrix(batch.column("cells"), np.uint8, dimension)
            x = as_matrix(batch.column("vector"), np.int32, dimension)
            to, looked = nearest(approximations, x, tables, now)
            if tables_before is None:
                moved = np.arange(len(x))
            else:
                origin, looked_before = nearest(approximations, x, tables_before, before)
                moved = np.flatnonzero(origin != to)
                looked |= looked_before
            looked[moved] = True
            change[0, -1] += int(looked.sum())
            full = x[moved].astype(np.int64)
            for cluster in range(len(now)):
                there = to[moved] == cluster
                change[cluster, 0] += int(there.sum())
                change[cluster, 1:-1] += full[there].sum(axis=0)
                if tables_before is not None:
                    left = origin[moved] == cluster
                    change[cluster, 0] -= int(left.sum())
                    change[cluster, 1:-1] -= full[left].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(now)), pa.int32()), pa.array(list(change), pa.list_(pa.int64()))], ["cluster", "change"]
        )

    return run


def _assign(cells: Cells, dimension: int, centroids: np.ndarray):
    tables = cells.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column("vector"), np.int32, dimension)
            found, _ = nearest(as_matrix(batch.column("cells"), np.uint8, dimension), x, tables, centroids)
            apart = ((x - centroids[found]) ** 2).sum(axis=1)
            columns = [batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(apart, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    """Final centroids, the stored VA-file (vec_id, cells, vector), and how many full vectors each round looked at."""

    centroids: np.ndarray
    cells: Cells | None
    file: DataFrame
    looked: list[int] = field(default_factory=list)

    def assign(self) -> DataFrame:
        """(vec_id, cluster, squared distance) of every vector."""
        kind = self.file.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, cluster int, distance long"
        if self.cells is None:
            return self.file.sparkSession.createDataFrame([], schema)
        run = _assign(self.cells, self.centroids.shape[1], self.centroids)
        return self.file.select("vec_id", "cells", "vector").mapInArrow(run, schema)


def kept_vectors(vectors: DataFrame, dimension: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the vectors with `dimension` components, all finite, as whole numbers."""
    vector = F.col(vector_col)
    good = vectors.where((F.size(vector) == dimension) & is_finite(vector))
    return good.select(F.col(id_col).alias("vec_id"), whole_numbers(vector.cast("array<double>"), scale).alias("x"))


def first_centroids(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose seeded hash of the id is smallest; of equal ids by the vector, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    return np.array([row["x"] for row in rows], dtype=np.int64)


def cut_cells(kept: DataFrame, bits: int) -> Cells | None:
    """Cells at the quantiles of each dimension over all vectors, in one aggregation of mergeable summaries."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    components = kept.select(F.posexplode("x").alias("d", "value")).groupBy("d")
    rows = components.agg(
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.percentile_approx("value", shares, 4 << bits).alias("edges")
    ).collect()  # one row a dimension
    if not rows:
        return None
    rows.sort(key=lambda row: row["d"])
    return Cells.cut([r["least"] for r in rows], [r["greatest"] for r in rows], [r["edges"] for r in rows])


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    seed: str = SEED,
    bits: int = BITS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clustering:
    """Lloyd's rounds over a VA-file of `vectors`.

    Vectors of another length than `dimension`, null ones, and those with a null or non-finite component take no
    part. Repeated rows count as often as they occur; a null id is kept and only comes last among the first
    centroids. Components are set to the range of `LIMIT`. With fewer vectors than clusters, each is a centroid;
    without any there are none. Other columns are ignored. Rounds end early once no centroid moves, since
    nothing would change after that.
    """
    if bits > 8:
        raise ValueError("a cell has one byte")
    kept = kept_vectors(vectors, dimension, scale, id_col, vector_col)
    kind = kept.schema["vec_id"].dataType.simpleString()
    cells = cut_cells(kept, bits)
    if cells is None:
        return Clustering(np.zeros((0, dimension), np.int64), None, kept.limit(0))
    centroids, before = first_centroids(kept, clusters, seed), None
    file = stored(kept.mapInArrow(_encode(cells), f"vec_id {kind}, cells binary, vector binary"), "va-file")
    out = Clustering(centroids, cells, file)
    sums = [[0] * (dimension + 1) for _ in centroids]
    for _ in range(rounds):
        moves = file.select("cells", "vector").mapInArrow(_moves(cells, dimension, before, centroids), "cluster int, change array<long>")
        totals = moves.select("cluster", F.posexplode("change").alias("at", "value"))
        totals = totals.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        for row in totals.collect():  # clusters times (dimension + 2) rows
            if row["at"] <= dimension:
                sums[row["cluster"]][row["at"]] += int(row["value"])
            elif row["cluster"] == 0:
                out.looked.append(int(row["value"]))
        means = [[s // n for s in rest] if n else old for (n, *rest), old in zip(sums, centroids.tolist())]
        before, centroids = centroids, np.array(means, dtype=np.int64)
        if (before == centroids).all():
            break
    out.centroids = centroids
    return out


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def cluster_table(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance of every kept vector, with the distances summed and the digest of the centroid."""
    found = cluster(vectors)
    assigned = found.assign()
    if found.cells is None:
        empty = {"cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return assigned.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])
    assigned = stored(assigned, "assigned")
    most = (1 << 63) - 1  # sums beyond a long stay at its end
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = centroid_digests(found.centroids)
    of_cluster = F.create_map(
        *[
            F.lit(v)
            for c, s in sorted(sums.items())
            for v in (c, F.struct(F.lit(min(s, most)).cast("long").alias("s"), F.lit(digests[c]).alias("sha")))
        ]
    )[F.col("cluster")]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster["s"].alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), most)).cast("long").alias("inertia"),
        of_cluster["sha"].alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The rounds unrolled, on the exact vectors."""
    apart = "list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
          list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
          WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, x) - 1)::INTEGER AS k, x AS c
          FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {CLUSTERS}))""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, k, d FROM (SELECT v.r, c.k, {apart} AS d FROM v, c{i} AS c)
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN
              (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS m FROM
                (SELECT k, t.i AS d, sum(x[t.i])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {DIMENSION + 1}) t(i) GROUP BY k, t.i)
               GROUP BY k) USING (k))"""
            )
    return f"""WITH {', '.join(steps)}
    SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
      (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)"""


ORACLE = _oracle()
