"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern can send
its words to any of its sources once at no cost and a second time at a cost, never a third time; each
source takes its target. The cheapest flow says how many words of a pattern go to a source for the first
and for the second time, and documents are then taken in a seeded order until those words are reached.

Patterns of one source need no routing. Those of several are solved by connected component of the graph of
patterns and sources, on aggregated capacities, each component in its own task.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import WORD_PATTERN, stored
from cohortspark.llm.graph import connected_components

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: A document goes into the mix this often at most, and a target is at most this many times its source.
REPEATS = 2
SEED = "mix"
#: Hexadecimal digits of a document's order that name its bucket: running sums are taken inside buckets.
_DIGITS = 4


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, null a source like another.

    Weights repeat over the sources in order of code points, null last. A target is its weight times a
    common level, or `limit` times the source where that is less; the level makes the targets add up to
    `share` of all sizes. That is where resharing every excess by weight ends.
    """
    names = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit))
    # sources fill up in the order of the level at which they are full
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    so_far = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("goal", F.sum("source_size").over(everything) * float(share))
        .withColumn("spent", F.coalesce(F.sum("most").over(so_far), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("spent")) / F.col("open"))
    )
    # the first source whose fair part lies below its limit sets the level of all after it
    found = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("spent", "level"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(found["level"] * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", target.alias("target"))


def cheapest_flow(capacity: list[int], members: list[list[int]], demand: list[float], repeats: int) -> list[dict]:
    """Words that pattern i sends to source j in round r, as {(i, j, r): words}, by successive cheapest paths.

    Pattern i may send `capacity[i]` words in every round, at cost r; all demands are met as far as can be.
    """
    patterns, sources = len(capacity), len(demand)
    start, end = 0, 1 + patterns * repeats + sources
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: float, cost: float) -> list:
        forth, back = [b, room, cost, None], [a, 0.0, -cost, None]
        forth[3], back[3] = back, forth
        graph[a].append(forth)
        graph[b].append(back)
        return forth

    uses = {}
    for i in range(patterns):
        for r in range(repeats):
            node = 1 + i * repeats + r
            arc(start, node, float(capacity[i]), float(r))
            for j in members[i]:
                uses[i, j, r] = arc(node, 1 + patterns * repeats + j, float("inf"), 0.0)
    for j, d in enumerate(demand):
        arc(1 + patterns * repeats + j, end, float(d), 0.0)

    potential = [0.0] * (end + 1)
    while True:
        distance, came = [float("inf")] * (end + 1), [None] * (end + 1)
        distance[start] = 0.0
        queue = [(0.0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for edge in graph[a]:
                length = d + edge[2] + potential[a] - potential[edge[0]]
                if edge[1] > 1e-6 and length < distance[edge[0]] - 1e-9:
                    distance[edge[0]], came[edge[0]] = length, edge
                    heapq.heappush(queue, (length, edge[0]))
        if came[end] is None:
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, distance)]
        path, node = [], end
        while node != start:
            path.append(came[node])
            node = came[node][3][0]
        amount = min(edge[1] for edge in path)
        for edge in path:
            edge[1] -= amount
            edge[3][1] += amount
    return {key: edge[3][1] for key, edge in uses.items() if edge[3][1] > 1e-6}


def _solve(repeats: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pattern", "source"])
        patterns, sources = list(dict.fromkeys(rows["pattern"])), list(dict.fromkeys(rows["source"]))
        at = {s: j for j, s in enumerate(sources)}
        by = rows.groupby("pattern")
        capacity = by["capacity"].first().reindex(patterns).tolist()
        members = [[at[s] for s in by.get_group(p)["source"]] for p in patterns]
        demand = rows.groupby("source")["demand"].first().reindex(sources).tolist()
        flow = cheapest_flow([int(c) for c in capacity], members, demand, repeats)
        sent: dict = {}
        for (i, _, r), words in flow.items():
            sent[patterns[i], r] = sent.get((patterns[i], r), 0.0) + words
        return pd.DataFrame([(p, r, w) for (p, r), w in sent.items()], columns=["pattern", "round", "words"])

    return run


def route(memberships: DataFrame, demands: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(pattern, round, words): how many words of a pattern are taken for the first, second, ... time.

    `memberships` has pattern, capacity and the array sources; `demands` has source and demand.
    """
    edges = memberships.select("pattern", "capacity", F.explode("sources").alias("source")).join(demands, "source")
    alone = edges.join(
        edges.groupBy("source").agg(F.count(F.lit(1)).alias("patterns")), "source"
    ).join(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree")), "pattern")
    # one pattern and one source: the flow is the demand, round by round
    simple = alone.where("patterns = 1 AND degree = 1").select(
        "pattern",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(repeats - 1)),
                lambda r: F.least(
                    F.col("capacity").cast("double"),
                    F.greatest(F.lit(0.0), F.col("demand") - r * F.col("capacity")),
                ),
            )
        ).alias("round", "words"),
    )
    shared = stored(alone.where("patterns > 1 OR degree > 1").select("pattern", "capacity", "source", "demand"), "routes")
    if shared.isEmpty():
        return simple
    links = shared.select(F.concat(F.lit("p"), "pattern").alias("a"), F.concat(F.lit("s"), "source").alias("b"))
    component = connected_components(links, "routing").select(F.col("id").alias("a"), "component")
    solved = (
        shared.withColumn("a", F.concat(F.lit("p"), "pattern"))
        .join(component, "a")
        .groupBy("component")
        .applyInPandas(_solve(repeats), "pattern string, round int, words double")
    )
    return simple.union(solved)


def _taken(rows: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """Whole documents in seeded order, in each round of a pattern those whose middle lies before its words.

    `rows` has row identity columns, pattern, size and order (a hex digest). A bucket of the order lies
    inside, outside or across the quota; running sums of rows are taken in buckets only.
    """
    bucket = F.substring("order", 1, _DIGITS)
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(
        Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.select("pattern", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("order", "doc_id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_pattern = quotas.groupBy("pattern").agg(F.collect_list("words").alias("quotas"))
    middle = F.col("start") + F.col("upto") - F.col("size") / 2.0
    copies = F.aggregate(
        F.coalesce("quotas", F.array().cast("array<double>")), F.lit(0), lambda n, words: n + (middle < words).cast("int")
    )
    return (
        rows.withColumn("upto", upto)
        .join(starts, ["pattern", "bucket"])
        .join(per_pattern, "pattern", "left")
        .withColumn("copies", copies)
        .drop("bucket", "upto", "start", "quotas")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken.

    Size is the number of words, zero for null and empty texts, which are never taken. `source_col` is a
    string, null being a source of its own, or an array of strings for documents of several sources; then
    source_size and target are those of all its sources together. `taken` is size times copies (0 to
    `repeats`). The order is an MD5 of seed and id, ties by size, so reruns agree. Repeated rows count as
    rows. Other columns are ignored; an empty table gives an empty result.
    """
    several = docs.schema[source_col].dataType.typeName() == "array"
    of = F.col(source_col)
    sources = F.array_sort(F.array_distinct(of)) if several else F.array(of)
    sources = F.coalesce(sources, F.array(F.lit(None).cast("string")))
    # a name for every source and pattern, null kept apart from the empty string
    named = F.transform(sources, lambda s: F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s)))
    rows = stored(
        docs.select(
            "doc_id",
            word_count(F.col("text")).alias("size"),
            named.alias("sources"),
            F.to_json(named).alias("pattern"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("order"),
        ),
        "sizes",
    )
    patterns = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("capacity"))
    by_source = (
        patterns.withColumn("name", F.explode("sources")).groupBy("name").agg(F.sum("capacity").alias("source_size"))
    )
    known = targets(
        by_source.select(F.when(F.col("name") != "n", F.expr("substring(name, 2)")).alias("source"), "source_size"),
        weights,
        share,
        repeats,
    ).withColumn("name", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
    known = stored(known, "targets")
    demands = known.select(F.col("name").alias("source"), F.col("target").alias("demand"))
    quotas = route(patterns.where("capacity > 0"), demands, repeats)
    of_pattern = (
        patterns.select("pattern", F.explode("sources").alias("name"))
        .join(known, "name")
        .groupBy("pattern")
        .agg(F.sum("source_size").alias("source_size"), F.sum("target").alias("target"))
    )
    return (
        _taken(rows.drop("sources"), quotas, seed)
        .join(of_pattern, "pattern")
        .select(
            "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
        )
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    plan = mix(docs, **options).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    # rows that repeat an id are matched by their place among rows of that id and size
    place = Window.partitionBy("_id", "_size")
    plan = plan.withColumn("_place", F.row_number().over(place.orderBy("_copies")))
    tagged = docs.withColumn("_id", F.col("doc_id")).withColumn("_size", word_count(F.col("text")))
    tagged = tagged.withColumn("_place", F.row_number().over(place.orderBy(*docs.columns)))
    d, p = tagged.alias("d"), plan.alias("p")
    same = F.col("d._id").eqNullSafe(F.col("p._id"))
    same &= (F.col("d._size") == F.col("p._size")) & (F.col("d._place") == F.col("p._place"))
    joined = d.join(p, same).select("d.*", F.explode(F.sequence(F.lit(1), F.col("p._copies"))).alias("_copy"))
    return joined.select(*docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source)
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source)
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source)) AS k
  FROM sources),
goals AS (
  SELECT source, source_size, least(most, coalesce(w * (SELECT arg_min(level, k) FROM levels WHERE level * w < most), most)) AS target
  FROM levels)
SELECT doc_id, size, source_size, target,
  ((middle < least(target, source_size))::INTEGER
    + (middle < least(source_size, greatest(0, target - source_size)))::INTEGER) AS copies,
  size * ((middle < least(target, source_size))::INTEGER
    + (middle < least(source_size, greatest(0, target - source_size)))::INTEGER)::BIGINT AS taken
FROM (SELECT doc_id, size, source_size, target,
        sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
      FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
"""
