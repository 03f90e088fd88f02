"""Toxicity by a learned lexicon, matched through Levenshtein automata, and by the context of every hit.

Terms are words, and word beginnings, that toxic training documents hold far more often than others. The lexicon
is a trie; a word of a text is matched by running its Levenshtein automaton along the trie, so that misspelled
terms are found without comparing the word with every term. A window around every hit says whether it stands
between quotation marks or next to words of reporting, as a quotation does, or next to other hits and words of
address, as abuse does. A logistic model over these counts gives the score.

Lexicon and model are learned on different folds of the labelled rows, each from a bounded sample
(`rows_per_class` rows a class), so that what is broadcast has a bound that does not grow with the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import bounded_sample, fold, held_out

ROWS_PER_CLASS = 5000
#: A term occurs in so many toxic documents of the sample, and so much more often (log odds) than in others.
MIN_DOCUMENTS = 4
MIN_LOG_ODDS = 3.0
#: Lengths of word beginnings that may be terms. A beginning stands for at least so many different words.
STEMS = range(4, 9)
MIN_WORDS = 4
MIN_STEM_DOCUMENTS = 8
#: Shortest terms that may be written with one and with two errors.
ONE_ERROR, TWO_ERRORS = 5, 9
WINDOW = 8
#: Words whose match a worker keeps at once; more only means that a word is matched again.
CACHE = 1_000_000

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»‘’'`]")
QUOTES = frozenset("\"“”„«»‘’'`")
#: Fixed lists: words that report speech, and words that address somebody.
REPORTING = frozenset(
    "said says say wrote writes write called calls call quote quoted quotes quoting word words term terms slur insult "
    "reported according sagte sagt schrieb nannte wort zitat dit disait écrit mot citation dijo dice escribió palabra cita".split()
)
ADDRESS = frozenset("you your yours you're u ya du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti usted vosotros".split())
FEATURES = ("exact", "stem", "misspelled", "weight", "dense", "quoted", "reported", "addressed")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(term: str) -> int:
    return 0 if len(term) < ONE_ERROR else 1 if len(term) < TWO_ERRORS else 2


def build_trie(terms: list[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return root


def nearest(root: dict, word: str, errors: int) -> tuple[int, str] | None:
    """The word's Levenshtein automaton run along a trie: (edits, term) of the nearest term, ties by term.

    A state holds the edits between what was read of the trie and every beginning of the word; more
    than `errors` places off the diagonal they exceed `errors`, so only that band is kept up.
    """
    size, over = len(word), errors + 1
    best: tuple[int, str] | None = None
    stack = [(root, 0, [min(i, over) for i in range(size + 1)])]
    while stack:
        node, depth, row = stack.pop()
        first, last = max(1, depth + 1 - errors), min(size, depth + 1 + errors)
        for c, child in node.items():
            if c == "":
                if row[size] <= allowed(child) and (best is None or (row[size], child) < best):
                    best = (row[size], child)
                continue
            after = [over] * (size + 1)
            after[0] = least = min(depth + 1, over)
            for i in range(first, last + 1):
                edits = row[i - 1] + (word[i - 1] != c)
                if row[i] + 1 < edits:
                    edits = row[i] + 1
                if after[i - 1] + 1 < edits:
                    edits = after[i - 1] + 1
                after[i] = edits
                if edits < least:
                    least = edits
            if least <= errors:
                stack.append((child, depth + 1, after))
    return best


class Trie:
    """Terms and beginnings with their weights, and the terms that may be misspelled as tries by their pieces.

    A term that allows e errors is cut into e + 1 pieces, of which any misspelling leaves one alone. So
    the automaton only runs along the small tries of the terms that share a piece with the word.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        heads, tails, middles = {}, {}, {}
        loose = [t for t in terms if allowed(t)]
        for term in loose:
            pieces = allowed(term) + 1
            cut = [len(term) * k // pieces for k in range(pieces + 1)]
            heads.setdefault(term[: cut[1]], []).append(term)
            tails.setdefault(term[cut[-2] :], []).append(term)
            for a, b in zip(cut[1:-2], cut[2:-1]):
                middles.setdefault(term[a:b], []).append(term)
        self.heads, self.tails, self.middles = (
            {piece: build_trie(of) for piece, of in by.items()} for by in (heads, tails, middles)
        )
        self.head_sizes, self.tail_sizes, self.middle_sizes = (
            sorted({len(piece) for piece in by}) for by in (heads, tails, middles)
        )
        self.shortest = min((len(t) - allowed(t) for t in loose), default=1 << 30)
        self.longest = max((len(t) + allowed(t) for t in loose), default=0)

    def near(self, word: str) -> tuple[str, int] | None:
        """The term nearest to the word within the term's allowed edits, ties by term."""
        size, errors = len(word), 2 if len(word) >= TWO_ERRORS - 2 else 1
        roots = [self.heads[word[:n]] for n in self.head_sizes if word[:n] in self.heads]
        roots += [self.tails[word[-n:]] for n in self.tail_sizes if word[-n:] in self.tails]
        if errors == 2:
            inside = {word[i : i + n] for n in self.middle_sizes for i in range(1, size - n)}
            roots += [self.middles[piece] for piece in sorted(inside) if piece in self.middles]
        found = [best for root in roots if (best := nearest(root, word, errors)) is not None]
        return (min(found)[1], min(found)[0]) if found else None

    def match(self, word: str) -> tuple[str, float] | None:
        """How a word hits the lexicon, and with what weight."""
        if word in self.terms:
            return "exact", self.terms[word]
        for n in STEMS:
            if word[:n] in self.stems:
                return "stem", self.stems[word[:n]]
        if not self.shortest <= len(word) <= self.longest:
            return None
        found = self.near(word)
        return ("misspelled", self.terms[found[0]] / (1 + found[1])) if found else None


@dataclass
class Model:
    trie: Trie
    weights: np.ndarray
    bias: float
    cache: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text:
            return out
        cache, distinct = self.cache, set(words(text))
        if len(cache) > CACHE:
            cache.clear()
        for w in distinct:
            if w not in cache:
                cache[w] = self.trie.match(w)
        if any(cache[w] is not None for w in distinct):
            self._contexts(text, out)
        return out

    def _contexts(self, text: str, out: np.ndarray) -> None:
        tokens = TOKEN.findall(text.lower())
        hits = [(i, self.cache.get(t)) for i, t in enumerate(tokens) if self.cache.get(t) is not None]
        for i, (kind, weight) in hits:
            around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            out[FEATURES.index(kind)] += 1
            if kind != "misspelled":
                out[3] += weight
                out[4] += sum((self.cache.get(t) or ("misspelled",))[0] != "misspelled" for t in around)
            out[5] += bool(QUOTES & set(before)) and bool(QUOTES & set(after))
            out[6] += bool(REPORTING & set(around))
            out[7] += bool(ADDRESS & set(around))
        np.log1p(out, out=out)

    def score(self, features: np.ndarray) -> float:
        z = float(self.weights @ features + self.bias)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and class: documents that hold a word or a beginning, and different words behind a beginning."""
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
            distinct = set(words(text))
            keys = {(0, w) for w in distinct} | {(1, w[:n]) for w in distinct for n in STEMS if len(w) > n}
            for k in keys:
                counts[k, toxic] += 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0][0] for k, _ in rows], pa.int32()),
                pa.array([k[0][1] for k, _ in rows], pa.string()),
                pa.array([k[1] for k, _ in rows], pa.int32()),
                pa.array([n for _, n in rows], pa.int64()),
            ],
            ["kind", "term", "toxic", "n"],
        )


def learn_lexicon(sample: DataFrame) -> Trie:
    """Terms and beginnings of a labelled sample (text, toxic)."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Trie({}, {})
    counts = sample.mapInArrow(_document_counts, "kind int, term string, toxic int, n long")
    of = counts.groupBy("kind", "term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = F.when(F.col("kind") == 0, MIN_DOCUMENTS).otherwise(MIN_STEM_DOCUMENTS)
    strong = of.where((F.col("toxic") >= least) & (odds >= MIN_LOG_ODDS))
    # a beginning must stand for several words, or it is just a word cut short
    distinct = of.where("kind = 0 AND toxic > clean").select("term")
    behind = (
        distinct.select(
            F.explode(F.filter(F.array(*[F.when(F.length("term") > n, F.substring("term", 1, n)) for n in STEMS]), lambda s: s.isNotNull())).alias("term")
        )
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("words"))
        .where(F.col("words") >= MIN_WORDS)
        .withColumn("kind", F.lit(1))
    )
    strong = strong.join(behind, ["kind", "term"], "left").where("kind = 0 OR words IS NOT NULL")
    rows = sorted(strong.collect(), key=lambda r: (r["kind"], r["term"]))  # bounded by the words of the sample
    found = {(r["kind"], r["term"]): _log_odds(r["toxic"], r["clean"], n_toxic, n_clean) for r in rows}
    toxic = {(r["kind"], r["term"]): r["toxic"] for r in rows}
    most: dict[str, int] = {}  # of the terms with a beginning, the documents of the most frequent one
    for (kind, term), n in toxic.items():
        for size in STEMS if kind == 0 else ():
            most[term[:size]] = max(n, most.get(term[:size], 0))
    stems: dict[str, float] = {}

    def covered(term: str) -> bool:
        return any(term[:size] in stems for size in STEMS)

    for kind, stem in sorted(found, key=lambda k: (len(k[1]), k[1])):
        # the shortest of nested beginnings counts; one that only cuts a frequent term short does not
        if kind and most.get(stem, 0) < 0.8 * toxic[kind, stem] and not covered(stem):
            stems[stem] = found[kind, stem]
    terms = {t: w for (kind, t), w in found.items() if not kind and not covered(t)}
    return Trie(terms, stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method on the ridge-penalised log loss, both classes of equal weight; the bias is not penalised."""
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ beta, -500, 500)))
        gradient = a.T @ (share * (p - y)) + penalty * beta
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def _feature_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], ["features", "toxic"]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """A model of the labelled rows outside the held-out fold: folds 1 to 3 for the lexicon, 4 for the weights.

    Rows without text, label or id are left out. Without labels of both classes every score is one half.
    """
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("fold", fold(F.col("doc_id")))
    # which rows are taken is decided before their texts are joined, so the join moves a bounded number of labels
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    first = bounded_sample(known.where("fold < 4"), "toxic", rows_per_class, "lexicon", ["doc_id"])
    second = bounded_sample(known.where("fold = 4"), "toxic", rows_per_class, "weights", ["doc_id"])

    def sample(chosen: DataFrame) -> DataFrame:
        return rows.drop("fold").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("text", "toxic")

    trie = learn_lexicon(sample(first))
    start = Model(trie, np.zeros(len(FEATURES)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(start)
    data = sample(second).mapInArrow(_feature_rows(shared), "features array<double>, toxic int").collect()
    y = np.array([r["toxic"] for r in data], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return start
    weights, bias = fit_logistic(np.array([r["features"] for r in data]), y)
    return Model(trie, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits for every row, from its whole text and nothing else.

    A null or empty text is scored as one without hits. Repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.features(t) for t in batch.column("text").to_pylist()]
            scores = [model.score(f) for f in found]
            hits = [int(round(float(np.expm1(f[:3]).sum()))) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(hits, pa.int64()),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits long")
