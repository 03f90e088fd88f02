"""Near duplicates among embeddings by a forest of random-projection trees with spill overlap.

Every tree splits the vectors of a label at the median of a random projection, level by level and all
nodes at once: the medians are one aggregation, and vectors within a margin of a median go to both
sides. Nodes of at most `leaf` vectors, or so tight that a split would only copy them, become leaves.
Inside a leaf all cosines are computed as a matrix product, in blocks where a leaf is large. A pair that
meets in several leaves is counted in the first of them only, so links are counted without being listed:
counts and a spanning forest leave a task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored
from cohortspark.llm.graph import connected_components

TREES = 3
LEAF = 256
#: Vectors compared with each other at a time.
BLOCK = 1024
#: Levels in a row at which a node may be too tight to split before it becomes a leaf.
STUCK = 2
SEED = 20240501


def directions(dim: int, trees: int, levels: int) -> np.ndarray:
    """Unit directions, one for each tree and level, the same on every machine."""
    out = np.random.default_rng([SEED, dim]).standard_normal((trees * levels, dim))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and very small components finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(trees: int, levels: int):
    """Per vector and tree the projections on all levels; vectors of one batch may differ in dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            for dim in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                projected = _unit([vectors[i] for i in at]) @ directions(dim, trees, levels).T
                rows = np.repeat(at, trees)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rep").take(pa.array(rows)),
                        batch.column("root").take(pa.array(rows)),
                        pa.array(np.tile(np.arange(trees, dtype=np.int32), len(at))),
                        pa.array(list(projected.reshape(-1, levels).astype(np.float32)), pa.list_(pa.float32())),
                    ],
                    ["rep", "root", "tree", "along"],
                )

    return run


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric adjacency matrix."""
    seen, edges = np.zeros(len(adjacent), dtype=bool), []
    for start in range(len(adjacent)):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(adjacent[i] & ~seen)
            seen[new] = True
            edges += [(i, int(j)) for j in new]
            front += new.tolist()
    return edges


def _compare(min_cosine: float):
    """Counts and a spanning forest for one leaf, one block of it, or one pair of blocks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaf = key[0]
        x = np.stack([np.frombuffer(b, dtype=np.float64) for b in rows["unit"]])
        ids, copies, side = rows["rep"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        near = x @ x.T >= min_cosine
        np.fill_diagonal(near, False)
        if side.any():
            near &= side[:, None] != side[None, :]
        # pairs that share an earlier leaf are counted there
        earlier = [np.array([other for other in leaves if other < leaf], dtype=np.int64) for leaves in rows["leaves"]]
        known, at = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(known):
            member = np.zeros((len(rows), len(known)), dtype=np.float32)
            member[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), at] = 1
            near &= member @ member.T == 0
        linked = np.flatnonzero(near.any(axis=1))
        edges = [(int(linked[a]), int(linked[b])) for a, b in spanning(near[np.ix_(linked, linked)])]
        counts = near[linked].astype(np.int64) @ copies
        ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
        none = [None] * len(linked)
        columns = {
            "a": [*ids[linked].tolist(), *ids[ends[:, 0]].tolist()],
            "b": [*none, *ids[ends[:, 1]].tolist()],
            "n_links": [*counts.tolist(), *[0] * len(ends)],
        }
        return pd.DataFrame({name: pd.array(values, dtype="Int64") for name, values in columns.items()})

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("embedding").to_pylist()
        units = [_unit([v])[0].tobytes() for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("copies"), pa.array(units, pa.binary())], ["rep", "copies", "unit"]
        )


def grow(reps: DataFrame, min_cosine: float, trees: int, leaf: int) -> DataFrame:
    """(rep, leaf, n): the leaves of every vector in all trees, and how many vectors a leaf has."""
    # vectors of different dimension never meet
    rooted = reps.withColumn("root", F.xxhash64("label", F.size("embedding")))
    largest = rooted.groupBy("root").count().agg(F.max("count").alias("n")).first()["n"] or 1
    levels = max(1, math.ceil(1.5 * math.log2(max(2.0, largest / leaf))) + 4)
    # half the expected distance of a linked pair along a random direction would split every sixth pair at
    # the median; the whole of it on both sides splits about one of 700
    distance = math.sqrt(2 - 2 * min_cosine)
    state = (
        rooted.select("rep", "root", "embedding")
        .mapInArrow(_project(trees, levels), "rep long, root long, tree int, along array<float>")
        .join(rooted.select("rep", F.size("embedding").alias("dim")), "rep")
        .withColumn("margin", F.lit(distance) / F.sqrt("dim"))
        .select("rep", F.xxhash64("root", "tree").alias("node"), "along", "margin", F.lit(0).alias("stuck"))
    )
    state, leaves = stored(state, "level"), None
    for level in range(levels + 1):
        x = F.element_at("along", min(level, levels - 1) + 1)
        nodes = state.withColumn("x", x).groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("x", [0.325, 0.5, 0.675], 200).alias("cut")
        )
        last = F.lit(level == levels)
        joined = state.withColumn("x", x).join(nodes, "node")
        done = (F.col("n") <= leaf) | (F.col("stuck") >= STUCK) | last
        tight = F.element_at("cut", 3) - F.element_at("cut", 1) <= 2 * F.col("margin")
        middle = F.element_at("cut", 2)
        stay = F.array(F.col("node"))
        left = F.when(F.col("x") <= middle + F.col("margin"), F.xxhash64("node", F.lit(0)))
        right = F.when(F.col("x") > middle - F.col("margin"), F.xxhash64("node", F.lit(1)))
        children = F.when(done | tight, stay).otherwise(F.array_compact(F.array(left, right)))
        after = stored(
            joined.select(
                "rep",
                F.explode(children).alias("node"),
                "along",
                "margin",
                F.when(tight, F.col("stuck") + 1).otherwise(0).alias("stuck"),
                done.alias("done"),
                "n",
            ),
            "level",
        )
        found = after.where("done").select("rep", F.col("node").alias("leaf"), "n")
        leaves = found if leaves is None else leaves.union(found)
        state = after.where("NOT done").drop("done", "n")
        if state.isEmpty():
            break
    return leaves


def embedding_classes(
    vectors: DataFrame,
    min_cosine: float = 0.98,
    trees: int = TREES,
    leaf: int = LEAF,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors have one dimension, and their
    cosine in double precision is at least `min_cosine`. Null, empty, zero vectors and those with null or
    non-finite components link with nothing, nor do rows without an id. Equal vectors count as linked
    with each other. Rows that repeat an id are counted as rows, and share the id's class. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    )
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False)
    )
    tagged = rows.withColumn("usable", usable)
    good = tagged.where("usable").select("id", "label", "embedding")
    # equal vectors collapse, by partial aggregation, before anything else: a group of copies becomes one vector
    reps = stored(
        good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors"
    )
    keyed = reps.withColumnRenamed("rep", "name").withColumn("rep", F.xxhash64("name", "label", "embedding"))
    keyed = stored(keyed, "keyed")

    leaves = stored(grow(keyed, min_cosine, trees, leaf), "leaves")
    # dealt by hash, as rows of a leaf that is too tight to split are not bounded
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK))
    big = leaves.where(F.col("n") > BLOCK).withColumn("block", block)
    blocks = big.groupBy("leaf").agg((F.max("block") + 1).alias("blocks"))
    big = big.join(blocks, "leaf").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    big = big.select(
        "rep",
        "leaf",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    zero = F.lit(0).cast("long")
    small = leaves.where(F.col("n") <= BLOCK).select(
        "rep", "leaf", zero.alias("first"), zero.alias("second"), F.lit(0).alias("side")
    )
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    units = keyed.select("rep", "copies", "embedding").mapInArrow(_units, "rep long, copies long, unit binary")
    dealt = big.union(small).join(units.join(lists, "rep"), "rep")
    found = stored(
        dealt.groupBy("leaf", "first", "second").applyInPandas(_compare(min_cosine), "a long, b long, n_links long"),
        "found",
    )

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    names = keyed.select("rep", "name")
    edges = found.where("b IS NOT NULL").select("a", "b")
    edges = edges.join(names.select(F.col("rep").alias("a"), F.col("name").alias("na")), "a")
    edges = edges.join(names.select(F.col("rep").alias("b"), F.col("name").alias("nb")), "b")
    # an id with several vectors is one node
    again = good.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    same_id = good.join(again, "id").join(reps, ["label", "embedding"]).select("id", "rep")
    components = connected_components(edges.select(F.col("na").alias("a"), F.col("nb").alias("b")).union(same_id))

    classes = (
        keyed.join(counts, "rep", "left")
        .join(components.select(F.col("id").alias("name"), "component"), "name", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "name").alias("component_id"),
        )
    )
    linked = good.join(classes, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = tagged.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
