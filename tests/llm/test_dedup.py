"""Exact and near duplicates of texts and vectors against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import exact_dedup, graph, jaccard_join, rp_forest
from cohortspark.llm.graph import connected_components
from cohortspark.llm.jaccard_join import Threshold, band_keys, band_parts, common, keys_by_band, linked_forest, set_keys
from cohortspark.llm.shingles import shingle_set, word_hashes
from cohortspark.session import stored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_of_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_duplicates_of_awkward_rows(awkward):
    rows = exact_dedup.exact_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows)
    assert by == sorted(
        [
            (False, 1, 2, 2, False),
            (False, 2, 2, 2, True),
            (False, 3, 4, 4, False),
            (False, 4, 4, 4, True),
            (False, 4, 4, 4, False),
            (False, 5, 5, 1, True),
            (True, 0, 4, 4, False),
            (True, 0, 0, 1, True),
            (False, 6, 6, 1, True),
            (False, 7, 7, 1, True),
        ]
    )
    assert {r.text_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}


def test_weak_hash_is_told_apart_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    weak = exact_dedup.exact_duplicates(docs, hashed=lambda t: F.length(t) % 2)
    assert {(r.doc_id, r.keep_id) for r in weak.collect()} == {(i, max(j for j in range(50) if j % 7 == i % 7)) for i in range(50)}


def test_exact_duplicates_keep_the_smallest_on_request(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(docs, keep="min").collect()} == {(1, 1), (2, 1), (3, 3)}


def test_exact_dedup_runs_without_python(awkward):
    plan = exact_dedup.exact_duplicates(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rows_that_stay(awkward, empty):
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "7", "None"]
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0


# --- shingles and sketches -------------------------------------------------


def slow_shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


@pytest.mark.parametrize("words", [1, 3, 5])
def test_shingle_sets_have_the_size_and_overlap_of_the_real_ones(words):
    rng = random.Random(words)
    texts = ["", None, " ", "a", "A b", "a b c", "x" * 3_000_000, "ß É é \U0001d400", "a b " * 700_000]
    texts += [" ".join(rng.choice(["ab", "Ab", "c", "é", "\x1c", "d,"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    real = [slow_shingles(t, words) for t in texts]
    fast = [shingle_set(t, words) for t in texts]
    assert [len(s) for s in fast] == [len(s) for s in real]
    for i in range(len(texts)):
        for j in range(i):
            assert common(fast[i], fast[j]) == len(real[i] & real[j])


def test_words_keep_their_hash_across_stretches():
    text = " ".join(f"w{i % 1000}" for i in range(400_000))
    hashes = word_hashes(text)
    assert len(hashes) == 400_000 and (hashes[:1000] == hashes[399_000:]).all()


@pytest.mark.parametrize("p, q", [(90, 100), (8, 10)])
def test_linked_sets_always_share_a_key(p, q):
    rng = np.random.default_rng(p)
    threshold = Threshold(p, q)
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            lost = rng.integers(0, n // 4 + 1)
            added = rng.integers(0, n // 4 + 2)
            a = np.unique(base)
            b = np.unique(np.concatenate([base[lost:], rng.integers(0, 1 << 63, added, dtype=np.uint64)]))
            shared = common(a, b)
            if len(b) and q * shared >= p * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
                assert len(np.intersect1d(set_keys(a, threshold), set_keys(b, threshold)))


@pytest.mark.parametrize("p, q", [(90, 100), (8, 10)])
def test_linked_sets_share_a_key_that_neither_leaves_out(p, q):
    rng = np.random.default_rng(p + 1)
    threshold = Threshold(p, q)
    passage = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    met = 0
    for n in [*range(20, 90, 3), 200, 700]:
        for _ in range(6):
            base = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), passage[: n // 2]]))
            lost = int(rng.integers(0, n * (q - p) // (q + p) + 1))
            a, b = base, np.unique(np.concatenate([base[lost:], rng.integers(0, 1 << 63, lost // 2, dtype=np.uint64)]))
            shared = common(a, b)
            if q * shared < p * (len(a) + len(b) - shared) or len(a) + len(b) == 2 * shared:
                continue
            # any order will do; here the keys of a third of all documents are as frequent as can be
            frequent = {k: int(k % 3 == 0) for s in (a, b) for _, _, keys in keys_by_band(s, threshold) for k in keys.tolist()}
            kept = []
            for s in (a, b):
                kept.append(set())
                for band, spare, keys in keys_by_band(s, threshold):
                    order = sorted(keys.tolist(), key=lambda k: (-frequent[k], k))
                    kept[-1] |= {(band, k) for k in order[spare:]}
            assert kept[0] & kept[1]
            met += 1
    assert met > 50


def test_unequal_parts_bound_the_difference():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    parts, together = band_parts(40)
    assert together == 1 and parts > 40
    keys = set(band_keys(base, 9, 40).tolist())
    other = np.unique(np.concatenate([base[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
    assert len(keys - set(band_keys(other, 9, 40).tolist())) <= 40 + 2


def test_forest_spans_the_link_graph():
    rng = random.Random(3)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(63) for _ in range(rng.randint(1, 80))]
        for _ in range(5):
            changed = [x if rng.random() > 0.06 else rng.getrandbits(63) for x in base]
            sets.append(np.unique(np.array(changed, dtype=np.uint64)))
    t = Threshold(8, 10)

    def linked(i, j):
        shared = common(sets[i], sets[j])
        return 10 * shared >= 8 * (len(sets[i]) + len(sets[j]) - shared)

    n = range(len(sets))
    real = least_of_components(n, [(i, j) for i in n for j in n if i < j and linked(i, j)])
    assert least_of_components(n, linked_forest(sets, t)) == real
    half = len(sets) // 2
    crossing = least_of_components(n, [(i, j) for i in n for j in n if i < half <= j and linked(i, j)])
    assert least_of_components(n, linked_forest(sets, t, half)) == crossing


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 7, 12, 30, 80, 250, 900]))
        texts += [base, base]
        for _ in range(4):
            at = [w if rng.random() > rng.choice([0.003, 0.01, 0.03]) else rng.choice(vocabulary) for w in base]
            texts.append(at + (rng.choices(vocabulary, k=1) if rng.random() < 0.3 else []))
        texts.append(shared + rng.choices(vocabulary, k=40))
    texts += [shared[:k] for k in range(40, 60)]
    return [(i, " ".join(t).replace("w1", "W1")) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words, p, q", [(3, 90, 100), (5, 8, 10)])
@pytest.mark.parametrize("blocks", [None, 7])
def test_classes_equal_brute_force(spark, monkeypatch, words, p, q, blocks):
    if blocks:  # groups are compared in several blocks and pairs of them
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", blocks)
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)
    rows = corpus()
    sets = {i: slow_shingles(t, words) for i, t in rows}
    edges = []
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if q * shared >= p * (len(sets[i]) + len(sets[j]) - shared):
                    edges.append((i, j))
    real = least_of_components(sets, edges)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_classes(docs, words, p, q).collect()
    assert {r.doc_id: r.component_id for r in found} == real
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in sets.items()}


def test_classes_of_awkward_rows(awkward, empty):
    found = jaccard_join.jaccard_classes(awkward, 3, 90, 100).collect()
    assert len(found) == awkward.count()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == sorted(
        [
            ("1", 0, "1"),
            ("2", 0, "2"),
            ("3", 4, "3"),
            ("4", 4, "3"),
            ("4", 4, "3"),
            ("5", 2, "5"),
            ("None", 4, "3"),
            ("None", 2, "None"),
            ("6", 1, "6"),
            ("7", 0, "7"),
        ]
    )
    assert jaccard_join.jaccard_classes(empty, 3, 90, 100).count() == 0
    kept = jaccard_join.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None", "None"]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(3, 3), (5, None)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(20, 60)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_run_no_round_for_stars_and_broadcast_nothing_in_one(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or stored(df, name))
    stars = spark.createDataFrame([(7, i) for i in range(20, 60)] + [(9, 8)], "a long, b long")
    found = graph.connected_components(stars, "stars").collect()
    assert {r.id: r.component for r in found} == {i: 7 for i in [7, *range(20, 60)]} | {8: 8, 9: 8}
    assert written == ["stars"] * 2  # the edges and the result
    chain = stored(spark.createDataFrame([(i + 1, i) for i in range(20)], "a long, b long"), "chain")
    plan = graph._small_star(stored(graph._large_star(chain), "tied"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


# --- vectors ---------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(30):
            centre = rng.standard_normal(16)
            for _ in range(6):
                rows.append((label, (centre + rng.standard_normal(16) * 0.07).tolist()))
        tight = rng.standard_normal(16)
        rows += [(label, (tight + rng.standard_normal(16) * 0.05).tolist()) for _ in range(70)]
    rows += [(1, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (None, rows[0][1])]
    rows += [(0, None), (0, []), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [float("inf")] + [0.0] * 15)]
    rows += [(0, [1e200, 1e200]), (0, [1e-200, 1e-200]), (0, [None] + [1.0] * 15)]
    return [(i, label, v) for i, (label, v) in enumerate(rows)]


def cosine(a, b):
    na, nb = max(map(abs, a)), max(map(abs, b))
    a, b = [x / na for x in a], [x / nb for x in b]
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


@pytest.mark.parametrize("leaf, block", [(1000, 1000), (16, 24)])
def test_vector_classes_equal_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(rp_forest, "BLOCK", block)
    rows = vectors()
    good = {
        i: (label, v)
        for i, label, v in rows
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    edges = [
        (i, j)
        for i in good
        for j in good
        if i < j and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and cosine(good[i][1], good[j][1]) >= 0.98
    ]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rep", F.lit("x"))
    found = rp_forest.embedding_classes(table, leaf=leaf).collect()
    assert len(found) == len(rows) and len(edges) > 2000
    links = sum(r.n_links for r in found) / 2
    assert links <= len(edges) and links >= (len(edges) if leaf == 1000 else 0.97 * len(edges))
    if leaf == 1000:
        real = least_of_components([r[0] for r in rows], edges)
        assert {r.vec_id: r.component_id for r in found} == real
        assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert rp_forest.embedding_classes(table.limit(0)).count() == 0


def test_repeated_and_missing_vector_ids(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [0.0, 1.0]), (None, 0, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in rp_forest.embedding_classes(table).collect()))
    assert found == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(7)
    for p, q in ((90, 100), (8, 10)):
        t = Threshold(p, q)
        for n in (5, 40, 300, 3000):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(0, n // 8, max(1, n // 30))]
            sets.sort(key=len)
            sizes = np.array([len(s) for s in sets])
            sketches = [jaccard_join.bit_sketch(s, t) for s in sets]
            for i in range(len(sets)):
                for j in range(i + 1, len(sets)):
                    shared = common(sets[i], sets[j])
                    linked = q * shared >= p * (len(sets[i]) + len(sets[j]) - shared)
                    pair = np.array([i, j])
                    passing = jaccard_join.near_forest(sizes[pair], [sketches[i], sketches[j]], t)
                    assert passing or not linked
                    assert passing == jaccard_join.near_forest(sizes[pair], [sketches[i], sketches[j]], t, left=1)


@pytest.mark.parametrize("p, q, change", [(90, 100, 608), (8, 10, 288), (8, 10, 576)])
def test_hash_shares_of_one_size_class_keep_every_link(p, q, change):
    # sketches grow at `change` shingles, inside a size class; its shares hold sizes on both sides of that
    rng = np.random.default_rng(change)
    t = Threshold(p, q)
    few, many = (len(jaccard_join.bit_sketch(np.arange(n, dtype=np.uint64), t)) for n in (change - 1, change))
    assert few < many
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, change + 6, dtype=np.uint64)
        sets += [np.unique(base[k:]) for k in (0, 5, 7, 12)]
    n = len(sets)
    links = [
        (i, j)
        for i in range(n)
        for j in range(n)
        if i < j and q * (shared := common(sets[i], sets[j])) >= p * (len(sets[i]) + len(sets[j]) - shared)
    ]
    assert len(links) == 30 * 6
    share = rng.integers(0, 2, n)
    order = sorted(range(n), key=lambda i: (share[i], len(sets[i])))
    at = {i: k for k, i in enumerate(order)}
    left = int((share == 0).sum())
    sizes = np.array([len(sets[i]) for i in order])
    found = jaccard_join.near_forest(sizes, [jaccard_join.bit_sketch(sets[i], t) for i in order], t, left)
    crossing = [(at[i], at[j]) for i, j in links if share[i] != share[j]]
    assert least_of_components(range(n), found) == least_of_components(range(n), crossing)


def test_every_text_of_an_id_is_placed_by_its_own_size(spark):
    text = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((40, 1002))]
    rows = [(5, text[0]), (5, text[1]), (6, text[0] + " more"), (7, text[1] + " more"), (8, "something else altogether")]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_no_task_orders_a_leaf(spark):
    import inspect

    assert "row_number" not in inspect.getsource(rp_forest.embedding_classes)


def test_chunks_hand_on_one_text_a_key_and_tie_the_rest(monkeypatch):
    """Whatever the chunks, equal keys connect the same texts, and copies leave a chunk as one edge each."""
    import pyarrow as pa

    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(120)) for _ in range(4)]
    texts = [base[i % 3] for i in range(60)] + [base[3], " ".join(base[3].split()[:-1]), "", base[0][:40]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    order = jaccard_join.PartOrder(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = []
    for chunk_keys in (1, 100, 1 << 20):
        monkeypatch.setattr(jaccard_join, "CHUNK_KEYS", chunk_keys)
        out = [b for b in jaccard_join._keys(5, Threshold(8, 10), order)(iter([batch, batch.slice(0, 7)]))]
        rows = [(k, i) for b in out for k, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist())]
        least = {}
        for k, i in rows:
            least[k] = min(i, least.get(k, i))
        found.append(least_of_components({i: None for i in range(len(texts))}, [(i, least[k]) for k, i in rows if i != least[k]]))
    assert found[0] == found[1] == found[2]
    assert found[0][3] == found[0][0] and found[0][60] == found[0][61] and found[0][62] == 62
    assert len(rows) < 4 * 60 + 2 * 70
