"""N-gram Jaccard join by parity sketches.

The shingles of a document are dealt by hash over the parts of a sketch, and every part holds the
XOR of its shingles' hashes. A shingle in only one of two sets changes only its own part, so the
number of unequal parts is a lower bound of the symmetric difference. For sizes a and b, a Jaccard
of p/q allows a symmetric difference of (q-p)(a+b)/(q+p) at most; a sketch with more parts than that
for its size band must agree in at least one part (pigeonhole), which is an equality join.

Exactness: a sketch has more parts than that by several, so a linked pair agrees in several parts. Order all
parts of all documents in any one way: of those the pair agrees in, the last one in that order is still left when
each document leaves out its first ones, as many as the pair must agree in beyond one. The order puts frequent
parts first, as counted on a bounded sample: they are those filled by passages that many documents share, and the
empty ones. In small bands several equal parts are demanded at once instead. What agrees in a part becomes a
candidate component. Inside it, in blocks of bounded size, pairs are first compared by length and by the Hamming
distance of bit sketches, a small part of the sets' bytes; what passes makes finer components, and inside
these the exact sets are compared. Only a spanning forest leaves a task each time, so a group of copies
never turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import discard, stored
from cohortspark.llm.graph import connected_components
from cohortspark.llm.shingles import mix, shingle_set

#: Shingles, and sets, that one block of a comparison holds at most (a larger set is a block by itself).
BLOCK_SHINGLES = 500_000
BLOCK_SETS = 1024
#: How many times as much a block of sketches holds.
SKETCHES_PER_SET = 8
#: Texts that the order of sketch parts is fitted on, about; and how many frequent parts it tells apart, each in
#: so many of these texts at least. They decide on cost alone: every order keeps every link.
ORDER_TEXTS = 50_000
ORDER_PARTS = 1 << 13
ORDER_LEAST = 10
#: Join keys that a task compares among themselves before it hands them on.
CHUNK_KEYS = 1 << 20
#: Candidates up to so many rows (some 50 bytes each) are broadcast to where texts and sketches lie.
BROADCAST_ROWS = 500_000
#: Equal parts demanded at once, by the largest symmetric difference of a band; one beyond these.
_TOGETHER = {1: 7, 2: 4, 3: 3, 4: 2, 5: 2, 6: 2}


@dataclass(frozen=True)
class Threshold:
    """Two sets link when q * intersection >= p * union."""

    p: int
    q: int

    def difference(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes add up to `total`."""
        return (self.q - self.p) * total // (self.q + self.p)

    def growth(self) -> float:
        """Ratio of the ends of a band. Wider bands need keys in two bands for fewer sets, but more parts a set;
        beyond 0.4 parts a shingle too many parts would be empty."""
        return min(1.45, 0.34 * (self.q + self.p) / (2 * (self.q - self.p)) * self.p / self.q)

    def bands(self, largest: int) -> list[int]:
        """Lower ends of the size bands: a set links with its own band and the two beside it only."""
        ends, growth = [1], self.growth()
        while ends[-1] <= largest:
            ends.append(max(ends[-1] * self.q // self.p + 1, int(ends[-1] * growth)))
        return ends


def band_parts(difference: int) -> tuple[int, int]:
    """Parts of a band's sketch, and how many of them are joined on at once."""
    if difference in _TOGETHER:
        return difference + _TOGETHER[difference], _TOGETHER[difference]
    return difference + max(3, -(-difference // 4)), 1


def band_spare(difference: int) -> int:
    """How many of its most frequent parts a set may leave out of the join: one less than a linked pair agrees in."""
    parts, together = band_parts(difference)
    return parts - difference - 1 if together == 1 else 0


def band_keys(hashes: np.ndarray, band: int, difference: int) -> np.ndarray:
    """The join keys of one set in one band."""
    parts, together = band_parts(difference)
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part, zobrist = part[order].astype(np.int64), mix(hashes[order] + np.uint64(1))
    counts = np.bincount(part, minlength=parts)
    sketch = np.zeros(parts, dtype=np.uint64)
    filled = np.flatnonzero(counts)
    sketch[filled] = np.bitwise_xor.reduceat(zobrist, np.concatenate(([0], np.cumsum(counts[filled])[:-1])))
    if together == 1:
        chosen, values = np.arange(parts), sketch
    else:
        picks = np.array(list(combinations(range(parts), together)))
        chosen, values = np.arange(len(picks)), np.zeros(len(picks), dtype=np.uint64)
        for column in picks.T:
            values = mix(values + sketch[column])
    return mix(values + mix(chosen.astype(np.uint64) + np.uint64(band << 32)))


def keys_by_band(hashes: np.ndarray, threshold: Threshold) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, join keys) of a set for its own band, and for the next, where it is the smaller one."""
    n = len(hashes)
    if not n:
        return []
    ends = threshold.bands(n * threshold.q // threshold.p + 1)
    own = int(np.searchsorted(ends, n, side="right")) - 1
    ends = threshold.bands(ends[own + 1]) if len(ends) < own + 3 else ends
    out = []
    for band in (own, own + 1):
        if band > own and n * threshold.q // threshold.p < ends[band]:
            continue  # a larger set that it could link with lies in its own band as well
        difference = threshold.difference(2 * (ends[band + 1] - 1))
        if difference:  # without any difference only equal sets link, and those are one set already
            out.append((band, band_spare(difference), np.unique(band_keys(hashes, band, difference))))
    return out


def set_keys(hashes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """All join keys of a set."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys for _, _, keys in keys_by_band(hashes, threshold))]))


def _summaries(words: int, threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                h = shingle_set(text, words)
                first = np.bitwise_xor.reduce(mix(h)) if len(h) else np.uint64(0)
                second = (mix(h ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64)
                rows.append((len(h), int(first.astype(np.int64)), int(second.astype(np.int64)), bit_sketch(h, threshold).tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kept = ["id", "text_key"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*kept, "n", "s1", "s2", "sketch"]
            )

    return run


def _all_keys(words: int, threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                keys = set_keys(shingle_set(text, words), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return run


@dataclass
class PartOrder:
    """Frequent parts, as rising join keys, and how often each was found; all others count as not found."""

    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def fit(cls, texts: DataFrame, rows: int, words: int, threshold: Threshold) -> PartOrder:
        """`texts` has text_key and text, and `rows` rows. A bounded number of keys reaches the driver."""
        share = F.pmod(F.xxhash64(F.lit("order"), "text_key"), F.lit(1 << 30)) < int(min(1.0, ORDER_TEXTS / max(rows, 1)) * (1 << 30))
        keys = texts.where(share).select("text").mapInArrow(_all_keys(words, threshold), "key long")
        often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_LEAST)
        found = often.orderBy(F.desc("n"), "key").limit(ORDER_PARTS).toArrow()
        keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
        order = np.argsort(keys)
        return cls(keys[order], counts[order])

    def without_first(self, keys: np.ndarray, spare: int) -> np.ndarray:
        """The rising `keys` of a set in one band without the first `spare` ones in this order."""
        if not spare:
            return keys
        found = np.zeros(len(keys), dtype=np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = np.where(self.keys[at] == keys, self.counts[at], 0)
        return keys[np.argsort(-found, kind="stable")[spare:]]


def _forest(hubs: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the edges between hubs and members, those that span the same components."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(hubs.tolist(), members.tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            yield a, b


def _keys(words: int, threshold: Threshold, order: PartOrder):
    """(key, id) for the join. Of the texts that share a key within a chunk of a task, one hands it on.

    The others are tied to it by a key of their own for each edge of a spanning forest, so a key that a third of
    all texts have leaves a task once a chunk, and texts with all keys in common leave it as one edge each.
    """

    def chunk(keys: np.ndarray, owner: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        by_key = np.argsort(keys, kind="stable")
        keys, owner = keys[by_key], owner[by_key]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        hub = owner[first][np.cumsum(first) - 1]
        rest = ~first & (hub != owner)
        pairs = np.unique(hub[rest] * len(ids) + owner[rest])
        edges = np.array(list(_forest(pairs // len(ids), pairs % len(ids))), dtype=np.int64).reshape(-1)
        own = mix(mix(keys[:1] + np.uint64(1)) + np.repeat(np.arange(len(edges) // 2, dtype=np.uint64), 2))
        columns = [np.concatenate([keys[first], own]).view(np.int64), np.concatenate([owner[first], edges])]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), ids.take(pa.array(columns[1]))], ["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owner, ids, size, count = [], [], [], 0, 0
        for batch in batches:
            begin = 0
            for at in range(batch.num_rows):
                hashes = shingle_set(batch.column("text")[at].as_py(), words)
                for _, spare, found in keys_by_band(hashes, threshold):
                    found = order.without_first(found, spare)
                    keys.append(found)
                    owner.append(np.full(len(found), count + at - begin, dtype=np.int64))
                    size += len(found)
                if size >= CHUNK_KEYS:
                    ids.append(batch.column("id").slice(begin, at + 1 - begin))
                    yield chunk(np.concatenate(keys), np.concatenate(owner), pa.concat_arrays(ids))
                    keys, owner, ids, size, count, begin = [], [], [], 0, 0, at + 1
            ids.append(batch.column("id").slice(begin))
            count += batch.num_rows - begin
        if size:
            yield chunk(np.concatenate(keys), np.concatenate(owner), pa.concat_arrays(ids))

    return run


def _candidate_links(keys: DataFrame) -> DataFrame:
    """(a, b) that tie each document to the least one with an equal key."""
    hub = F.min("id").over(Window.partitionBy("key"))
    return keys.select(F.col("id").alias("a"), hub.alias("b")).where("a <> b").distinct()


def _sets(words: int):
    """The sets of texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in kept),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                [*kept, "size", "payload"],
            )

    return run


def bit_sketch(hashes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Parity of the number of shingles at each position, packed; four positions and more per allowed difference.

    Halves XORed give the sketch of half the positions, so sketches of different lengths can be compared.
    """
    bits = min(1 << 16, max(256, 1 << int(4 * threshold.difference(2 * len(hashes))).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _folded(sketches: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every length of sketch: the rows that are as long or longer, and their sketches of that length."""
    lengths = np.array([len(s) for s in sketches])
    out = {}
    for length in sorted(set(lengths.tolist())):
        rows = np.flatnonzero(lengths >= length)
        matrix = np.empty((len(rows), length // 8), dtype=np.uint64)
        for k, row in enumerate(rows.tolist()):
            sketch = sketches[row]
            matrix[k] = np.bitwise_xor.reduce(sketch.reshape(-1, length), axis=0).view(np.uint64)
        out[length] = rows, matrix
    return out


def near_forest(
    sizes: np.ndarray, sketches: list[np.ndarray], threshold: Threshold, left: int | None = None
) -> list[tuple[int, int]]:
    """Edges that span the components of the graph of pairs whose lengths and sketches allow a link.

    Sizes rise, on either side of `left` for itself; with `left`, only pairs across it are compared. Two
    sketches are compared at the length of the shorter one, whichever side it is on.
    """
    n, levels = len(sizes), _folded(sketches)
    lengths = np.array([len(s) for s in sketches], dtype=np.int64)
    root, edges = np.arange(n), []
    for i in range(n if left is None else left):
        for length, (rows, matrix) in levels.items():
            if length > lengths[i]:
                break
            start = np.searchsorted(rows, i + 1 if left is None else left)
            rows = rows[start:]
            stop = np.searchsorted(sizes[rows], sizes[i] * threshold.q // threshold.p, side="right")
            if length < lengths[i]:  # longer ones are compared at a greater length
                stop = min(stop, np.searchsorted(lengths[rows], length, side="right"))
            rows, sketch = rows[:stop], matrix[start : start + stop]
            open_ = root[rows] != root[i]
            rows, sketch = rows[open_], sketch[open_]
            if not len(rows):
                continue
            own = np.bitwise_xor.reduce(sketches[i].reshape(-1, length), axis=0).view(np.uint64)
            allowed = (threshold.q - threshold.p) * (sizes[rows] + sizes[i]) // (threshold.q + threshold.p)
            near = np.bitwise_count(sketch ^ own).sum(axis=1, dtype=np.int64) <= allowed
            for j in rows[near].tolist():
                if root[i] != root[j]:
                    edges.append((i, j))
                    root[root == root[j]] = root[i]
    return edges


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def linked_forest(
    sets: list[np.ndarray], threshold: Threshold, left: int | None = None
) -> list[tuple[int, int]]:
    """Edges that span the components of the link graph on `sets`.

    With `left`, only pairs of one of the first `left` sets with one of the others are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    levels = _folded([bit_sketch(s, threshold) for s in sets])
    rows, matrix = levels[min(levels)] if levels else (None, None)  # the shortest sketch, of all sets
    root, edges = np.arange(n), []
    for i in range(n if left is None else left):
        others = np.arange(i + 1 if left is None else left, n)
        total = sizes[others] + sizes[i]
        allowed = (threshold.q - threshold.p) * total // (threshold.q + threshold.p)
        near = (np.abs(sizes[others] - sizes[i]) <= allowed) & (root[others] != root[i])
        others, total, allowed = others[near], total[near], allowed[near]
        if not len(others):
            continue
        near = np.bitwise_count(matrix[others] ^ matrix[i]).sum(axis=1, dtype=np.int64) <= allowed
        for j, both in zip(others[near].tolist(), total[near].tolist()):
            if root[i] != root[j]:
                shared = common(sets[i], sets[j])
                if threshold.q * shared >= threshold.p * (both - shared):
                    edges.append((i, j))
                    root[root == root[j]] = root[i]
    return edges


def _verify(threshold: Threshold, exact: bool, id_type):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in group.groupby("comp", sort=False):
            rows = rows.sort_values(["side", "size", "id"])
            payload = [np.frombuffer(b, dtype=np.uint64 if exact else np.uint8) for b in rows["payload"]]
            ids, left = rows["id"].tolist(), int((rows["side"] == 0).sum())
            crossing = left if left < len(ids) else None
            if exact:
                found = linked_forest(payload, threshold, crossing)
            else:
                found = near_forest(rows["size"].to_numpy(), payload, threshold, crossing)
            out += [(ids[a], ids[b]) for a, b in found]
        return pd.DataFrame(out, columns=["a", "b"]).astype(id_type)

    return run


def _links(docs: DataFrame, candidates: DataFrame, threshold: Threshold, words: int | None = None) -> DataFrame:
    """Links (a, b) inside the candidate components, a spanning forest for each block or pair of blocks.

    `candidates` has id, text_key, comp, n, one row for each text of an id. Blocks go by size, so blocks whose
    sizes cannot link never meet. With `words` the links are verified on the sets of the texts of `docs`
    (id, text_key, text); without, they are what its bit sketches (id, text_key, n, sketch) allow.
    """
    exact = words is not None
    scale = 1 if exact else SKETCHES_PER_SET
    # a block is a size class of a component and, of a large class, a share by the hash of the id
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(threshold.q / threshold.p))).cast("long")
    classed = candidates.select("id", "text_key", "comp", "n", size_class.alias("class"))
    shares = F.greatest(
        F.ceil(F.sum("n") / (scale * BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / (scale * BLOCK_SETS)), F.lit(1)
    )
    classes = classed.groupBy("comp", "class").agg(shares.cast("long").alias("shares"))
    block = F.shiftleft("class", 32) + F.pmod(F.xxhash64("id"), F.col("shares"))
    members = stored(classed.join(classes, ["comp", "class"]).select("id", "text_key", "comp", "n", block.alias("block")), "members")
    blocks = members.groupBy("comp", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("weight")
    )
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.comp") == F.col("b.comp")) & (F.col("a.block") <= F.col("b.block"))).where(
        F.col("b.least") * threshold.p <= F.col("a.most") * threshold.q
    )
    pairs = pairs.select(
        F.col("a.comp").alias("comp"),
        F.col("a.block").alias("first"),
        F.col("b.block").alias("second"),
        F.explode(
            F.when(
                F.col("a.block") == F.col("b.block"), F.array(F.struct(F.col("a.block").alias("block"), F.lit(0).alias("side")))
            ).otherwise(
                F.array(
                    F.struct(F.col("a.block").alias("block"), F.lit(0).alias("side")),
                    F.struct(F.col("b.block").alias("block"), F.lit(1).alias("side")),
                )
            )
        ).alias("part"),
    ).select("comp", "first", "second", "part.block", "part.side")

    # small components share a task: as many bins as their sets fill blocks
    alone = blocks.groupBy("comp").agg(F.count(F.lit(1)).alias("blocks"), F.sum("weight").alias("weight"))
    total = alone.where("blocks = 1").agg(F.sum("weight").alias("w")).first()["w"] or 0
    bins = max(1, int(total) // (scale * BLOCK_SHINGLES))
    single = alone.where("blocks = 1").select("comp", F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"))
    pairs = pairs.join(single, "comp", "left").withColumn(
        "task",
        F.when(F.col("bin").isNotNull(), F.concat(F.lit("s"), F.col("bin"))).otherwise(
            F.concat_ws("-", "comp", "first", "second")
        ),
    )

    kind = docs.schema["id"].dataType.simpleString()
    places = members.select("id", "text_key", "comp", "block")
    if members.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    placed = docs.join(places, ["id", "text_key"])
    if exact:
        schema = f"id {kind}, comp {kind}, block long, size long, payload binary"
        placed = placed.select("id", "comp", "block", "text").mapInArrow(_sets(words), schema)
    else:
        placed = placed.select("id", "comp", "block", F.col("n").alias("size"), F.col("sketch").alias("payload"))
    dealt = placed.join(pairs, ["comp", "block"]).select("task", "comp", "side", "id", "size", "payload")
    links = dealt.groupBy("task").applyInPandas(
        _verify(threshold, exact, "int64" if kind in ("bigint", "int") else "object"), f"a {kind}, b {kind}"
    )
    links = stored(links, "links")
    discard(members)
    return links


def jaccard_classes(
    docs: DataFrame, words: int, p: int, q: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link when q * |intersection| >= p * |union| of their sets of `words`-word shingles,
    A-Z lower-cased. Null and empty texts have no shingles and link with nothing. Rows that repeat an id
    count as one document with the links of all its texts; a row without id takes the class of equal
    texts and is never named itself. Other columns are ignored; an empty table gives an empty result.
    """
    threshold = Threshold(p, q)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # tells the texts of an id apart; two with one key would each be placed with the other as well, so nothing is lost
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    summary = stored(keyed.mapInArrow(_summaries(words, threshold), f"id {kind}, text_key long, n long, s1 long, s2 long, sketch binary"), "summary")
    sets = ["n", "s1", "s2"]
    filled = summary.where("n > 0")
    reps = filled.groupBy(*sets).agg(F.min("id").alias("rep")).where("rep IS NOT NULL")

    texts = keyed.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text_key", "text")
    order = PartOrder.fit(texts, summary.count(), words, threshold)
    keys = texts.select("id", "text").mapInArrow(_keys(words, threshold, order), f"key long, id {kind}")
    # of texts with equal sets, one is compared for all of them
    sizes = filled.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text_key", "n").distinct()

    def links_inside(edges: DataFrame, name: str, rows: DataFrame, *how) -> DataFrame:
        comps = connected_components(edges, name)
        found = _links(rows, comps.select("id", F.col("component").alias("comp")).join(sizes, "id"), threshold, *how)
        discard(comps)
        return found

    near = links_inside(_candidate_links(keys), "candidates", filled.select("id", "text_key", "n", "sketch"))
    links = links_inside(near, "near", keyed.where("text IS NOT NULL"), words)
    discard(near)

    repeated = filled.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 AND id IS NOT NULL")
    same_id = filled.join(repeated.select("id"), "id").join(reps, sets).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(links.union(same_id), "links")
    discard(links)

    classes = reps.join(components, F.col("rep") == F.col("id"), "left").select(
        *sets, F.coalesce("component", "rep").alias("component_id")
    )
    of_filled = filled.join(classes, sets, "left")
    empty = summary.where("n = 0").withColumn("component_id", F.col("id"))
    return of_filled.select("id", "n", "component_id").union(empty.select("id", "n", "component_id")).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, p: int = 8, q: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each class: the one its class is named after. Rows without an id cannot be named, and stay."""
    classes = jaccard_classes(docs, words, p, q, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
    names = classes.select(F.col(id_col).alias("_id")).distinct()
    named = docs.join(names, F.col(id_col) == F.col("_id"), "left_semi")
    others = [F.col(c) for c in docs.columns if c != id_col]
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(*others))
    named = named.withColumn("_copy", first).where("_copy = 1").select(*docs.columns)
    return named.union(docs.where(F.col(id_col).isNull()))
