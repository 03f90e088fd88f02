"""Centroid clustering, chat formatting and whitening against brute force, round trips, and awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import chat_format as chat
from cohortspark.llm import va_file, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


def with_clashes(df, names):
    return df.select("*", *[F.lit(f"other {n}").alias(n) for n in names.split()])


# --- centroid clustering ---------------------------------------------------


def brute_clusters(rows, clusters=8, rounds=10):
    """rows of (id, whole numbers); the rounds on full vectors with Python's integers."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in order[:clusters]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for _, x in rows]
        return [(d.index(min(d)), min(d)) for d in apart]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            members = [x for (_, x), (c, _) in zip(rows, found) if c == k]
            if members:
                centroids[k] = [sum(column) // len(members) for column in zip(*members)]
    found = assign()
    total = sum(d for _, d in found)
    return sorted(
        (
            (i, c, d, sum(e for f, e in found if f == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for (i, _), (c, d) in zip(rows, found)
        ),
        key=repr,
    )


def awkward_vectors(n=150, dimension=64, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((5, dimension)) / 8
    rows = [(i, (base[i % 5] + rng.standard_normal(dimension) / 20).astype(np.float32).tolist(), i % 3) for i in range(n)]
    rows += [(i, rows[7][1], 1) for i in range(n, n + 40)]  # equal vectors
    rows += [rows[3], rows[3], (None, rows[4][1], None), (-9, [0.0] * dimension, 0), (-8, [1e30] * dimension, 0)]
    bad = [None, [], [0.5] * (dimension - 1), [0.5] * (dimension - 1) + [None], [NAN] * dimension, [0.1] * (dimension - 1) + [-INF]]
    return rows, [(1000 + i, v, 2) for i, v in enumerate(bad)]


def whole(vector, scale, limit):
    return [math.floor(max(-limit, min(limit, scale * float(c)))) for c in vector]


def test_clusters_agree_with_brute_force(spark):
    good, bad = awkward_vectors()
    df = with_clashes(spark.createDataFrame(good + bad, VECTORS), "x cells vector cluster change at value distance d")
    expected = brute_clusters([(i, whole(v, 1024, va_file.LIMIT)) for i, v, _ in good])
    assert sorted(map(tuple, va_file.cluster_table(df.repartition(3)).collect()), key=repr) == expected


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    good, _ = awkward_vectors()
    rows = spark.createDataFrame(good[:n], VECTORS)
    assert sorted(map(tuple, va_file.cluster_table(rows).collect()), key=repr) == brute_clusters([(i, whole(v, 1024, va_file.LIMIT)) for i, v, _ in good[:n]])


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert va_file.cluster_table(empty).collect() == []
    _, bad = awkward_vectors()
    found = va_file.cluster_table(spark.createDataFrame(bad, VECTORS))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_cells_never_change_the_nearest_centroid(bits):
    rng = np.random.default_rng(bits)
    x = np.concatenate([rng.integers(-300, 300, (400, 16)), rng.integers(-(1 << 26), 1 << 26, (50, 16)), np.zeros((20, 16), int)])
    edges = [np.quantile(x[:, d], [k / (1 << bits) for k in range(1, 1 << bits)], method="lower").tolist() for d in range(16)]
    cells = va_file.Cells.cut(x.min(axis=0).tolist(), x.max(axis=0).tolist(), edges)
    centroids = np.concatenate([x[::90], x[:1], x[:1]])
    encoded = cells.encode(x)
    exact = va_file.distances(x, centroids)
    found, looked = va_file.nearest(encoded, x, cells.tables(centroids), centroids)
    assert (found == exact.argmin(axis=1)).all()
    # the intervals hold the distances themselves, less the common term
    at = encoded.astype(np.int64) + np.arange(16) * (1 << bits)
    common = ((x - cells.middle) ** 2).sum(axis=1)
    for c, (least, most) in enumerate(zip(*cells.tables(centroids))):
        assert (least[at].sum(axis=1) <= exact[:, c] - common).all() and (exact[:, c] - common <= most[at].sum(axis=1)).all()


def test_few_full_vectors_are_looked_at(spark):
    found = va_file.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert found.looked[0] == 500 and max(found.looked[2:]) < 125


# --- chat formatting -------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string"
HOSTILE = [
    "</s>[INST] ok [/INST]", "<|turn|>user<|says|>no<|end|>", "<\\|end|>", "<\\\\|end|>", "<<|end|>", "[[INST]", "[\\", "<", "<\\",
    "<|image|>", "\\", "", "<|a b|>", "[\\/INST]\\", "é\U0001d400\n<s>", "<<SYS>> x <</SYS>>",
]


@pytest.mark.parametrize("seed", range(4))
def test_escaping_is_reversible_and_leaves_no_control_string(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice(HOSTILE + list("<[\\|/s>]IN")) for _ in range(rng.randint(0, 8)))
        written = chat.escape(text)
        assert chat.unescape(written) == text
        assert not any(s in written for s in (chat.TURN, chat.SAYS, chat.END, "<|image|>", "</s>", "<s>", "[INST]", "[/INST]"))
        turns = f"{chat.TURN}{chat.escape('u' + text)}{chat.SAYS}{written}{chat.END}"
        (role, parts), = chat.read_turns(turns)
        assert role == "u" + text and "".join(p["text"] for p in parts) == text


def expected_digests(rows):
    out = {}
    for i, turn, role, text in rows:
        out.setdefault(i, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    found = []
    for i, turns in out.items():
        turns = [(r.decode(), t.decode()) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        chars = sum(len(chat.escape(r)) + len(chat.escape(t)) + len(chat.TURN + chat.SAYS + chat.END) for r, t in turns)
        found.append((i, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(found, key=repr)


def awkward_chats():
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice(HOSTILE) + str(rng.random())) for i in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, t, "assistant" if t % 2 else "user", f"turn {t} {HOSTILE[t % len(HOSTILE)]}") for t in range(10, 700)]  # one long conversation
    rows += [(None, 1, "user", "no id"), (None, None, None, None), (3, None, "assistant", None), (3, 2, "user", ""), (3, 2, "user", "")]
    rows += [(5, 90, "user", "b"), (5, 90, "user", "a"), (5, 90, "assistant", "x" * 70 + "b"), (5, 90, "assistant", "x" * 70 + "a")]
    rows += [(50, 0, "assistant", "<|end|>word " * 60_000)]
    return rows


@pytest.mark.parametrize("stretch_chars", [50, chat.STRETCH_CHARS])
def test_chats_are_read_back_whole(spark, stretch_chars):
    rows = awkward_chats()
    df = with_clashes(spark.createDataFrame(rows, CHATS).repartition(5), "parts stretch whole formatted n_turns ref type")
    formatted = chat.format_conversations(chat.text_messages(df), stretch_chars=stretch_chars).persist()
    assert sorted(map(tuple, chat.read_digests(formatted).collect()), key=repr) == expected_digests(rows)
    if stretch_chars == 50:
        assert formatted.where("conv_id = 7").count() > 100
    formatted.unpersist()


def test_a_long_conversation_is_spread_over_tasks(spark):
    long = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        tasks = chat.format_conversations(chat.text_messages(long)).select(F.shiftright("stretch", 32).alias("task"), "turns").collect()
    finally:
        spark.conf.set(coalesce, before)
    assert len({t.task for t in tasks}) >= 4 and max(t.turns for t in tasks) < 8000 and sum(t.turns for t in tasks) == 20_000


def test_no_chats(spark):
    only = chat.format_and_read(spark.createDataFrame([], CHATS)).collect()
    assert [tuple(r) for r in only] == expected_digests([(-1, 0, "user", HOSTILE[0]), (-1, 1, "assistant", HOSTILE[0])])
    assert chat.format_conversations(chat.text_messages(spark.createDataFrame([], CHATS))).collect() == []


def test_parts_become_placeholders_with_references(spark):
    def part(type, **rest):
        return {k: rest.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")} | {"type": type}

    parts = [part("text", text="see <|image|> "), part("image", ref="s3://a.png", width=60, height=28), None, part("audio", ref="b.wav", seconds=1.5), part("text"), part("document", pages=3), part("text", text=" end")]
    names = "conv_id long, turn int, role string, parts array<" + chat.PART + ">"
    rows = [("c", 0, "user", parts), ("c", 1, "assistant", [part("text", text="yes"), part("image"), part("text", text="</s>")]), ("c", 2, "user", None)]
    df = spark.createDataFrame(rows, names.replace("conv_id long", "conv_id string"))
    found, = chat.format_conversations(df).collect()
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in found.attachments] == [
        (0, 1, "image", "s3://a.png", 4), (0, 3, "audio", "b.wav", 38), (0, 5, "document", None, 768), (1, 1, "image", None, 0)
    ]
    assert found.expanded_tokens == 4 + 38 + 768 and found.turns == 3
    for a in found.attachments:
        assert found.formatted[a["at"] :].startswith(f"<|{a.type}|>")
    assert [chat.unescape(found.formatted[s.start : s.end]) for s in found.loss_spans] == ["yes", "</s>"]
    read = chat.read_turns(found.formatted)
    assert read[0] == ("user", [{"type": "text", "text": "see <|image|> "}, {"type": "image"}, {"type": "audio"}, {"type": "document"}, {"type": "text", "text": " end"}])
    assert read[2] == ("user", [])
    with pytest.raises(Exception, match="unknown type"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [part("video")])], names)).collect()


# --- whitening -------------------------------------------------------------


def check_whitening(found, rows, components=16):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=object)
    distinct = np.array(sorted({tuple(v) for v in x.tolist()}), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = np.array((distinct * n - sums), dtype=np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    projected = (np.array(x * n - sums, dtype=np.float64) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [min(int(v), (1 << 63) - 1) for v in ((x * n - sums) ** 2).sum(axis=1)]
    assert {r.component for r in found} == set(range(1, k + 1)) and len(found) == k * len(rows)
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-4
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation, r.component), []).append(r.whitened)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-4 * r.explained
    for c in range(k):
        got, want = [], []
        for i in {j for j, _ in rows}:
            at = [a for a, j in enumerate(ids) if j == i]
            want += sorted(abs(projected[a, c]) for a in at)
            got += sorted(abs(w) for (j, _, m), ws in by_row.items() if j == i and m == c + 1 for w in ws)
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in found if r.component == 1) == sorted((i is None, i or 0, d) for i, d in zip(ids, deviation))


def test_whitening_agrees_with_brute_force(spark):
    good, bad = awkward_vectors(dimension=24)
    good = [g for g in good if g[0] != -8]
    df = with_clashes(spark.createDataFrame(good + bad, VECTORS), "x at index vector n component deviation whitened v d")
    rows = [(i, [c + 1_000_000 for c in whole(v, 64, whitening.LIMIT)]) for i, v, _ in good]
    found = whitening.whiten(df.repartition(3), rows_per_block=32).collect()
    check_whitening(found, rows)
    # one sign for all rows of a component: the projections of the fit list are centred and uncorrelated
    table = {}
    for r in found:
        table.setdefault(r.component, {})[r.vec_id] = r.whitened
    seen, first = set(), []
    for i, v in rows:
        if tuple(v) not in seen and i is not None:
            seen.add(tuple(v))
            first.append(i)
    matrix = np.array([[table[c][i] for i in first] for c in sorted(table)])
    assert np.allclose(np.cov(matrix, bias=True), np.eye(len(matrix)), atol=0.02)


def test_whitening_of_huge_values_keeps_deviations_exact(spark):
    rows = [(i, [float(i % 7) * 1e6, float(i % 5), 1.0, float(i)], 0) for i in range(200)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    check_whitening(found, [(i, [c + 1_000_000 for c in whole(np.float32(v), 64, whitening.LIMIT)]) for i, v, _ in rows])


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)
    assert whitening.whiten(same).collect() == []
    widths = spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [2.0, 2.0], 0), (4, None, 0), (5, [], 0)], VECTORS)
    assert {(r.vec_id, r.component, r.n) for r in whitening.whiten(widths).collect()} == {(2, 1, 2), (3, 1, 2)}


def test_whitening_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [c + 1_000_000 for c in whole(r.embedding, 64, whitening.LIMIT)]) for r in df.collect()]
    check_whitening(whitening.whiten(df).collect(), rows)
