"""Language identification, words first: a known word scores by its log frequency per language,
an unseen one by the longest of its character n-grams that are known, down to single letters.

The model is learned from a bounded sample of labelled rows (`rows_per_language` for each language),
so its size has a bound that does not grow with the corpus; every row is scored on its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import bounded_sample, held_out, release_arrow

#: A word of letters. Digits, underscores and punctuation end it.
LETTERS = re.compile(r"[^\W\d_]+")
ROWS_PER_LANGUAGE = 2000
MIN_COUNT = 3
MAX_GRAM = 5
UNKNOWN = "und"
#: Scored words a worker keeps at once; more only means that a word is scored again.
CACHE = 400_000


def letter_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams with word edges; a word shorter than that has its whole self as one."""
    framed = f"^{word}$" if n > 1 else word
    return [framed[i : i + n] for i in range(max(1, len(framed) - n + 1))]


class Table:
    """Rows of a matrix by key. Keys travel as one Arrow array; what looks them up is only made where it is used."""

    def __init__(self, keys: pa.Array, rows: np.ndarray) -> None:
        self.keys, self.rows, self._at = keys, rows, None

    def __getstate__(self) -> tuple[pa.Array, np.ndarray]:
        return self.keys, self.rows

    def __setstate__(self, state: tuple[pa.Array, np.ndarray]) -> None:
        self.__init__(*state)

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, key: str) -> np.ndarray | None:
        if self._at is None:
            self._at = {k: i for i, k in enumerate(self.keys.to_pylist())}
        at = self._at.get(key)
        return None if at is None else self.rows[at]


def log_frequencies(counts: pa.Table, languages: list[str]) -> Table:
    """Per key the log frequency in each language, smoothed, less the mean over the languages.

    `counts` has lang, key and n, one row for each language and key.
    """
    coded = counts["key"].combine_chunks().dictionary_encode()
    keys, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    lang = pc.index_in(counts["lang"], pa.array(languages, pa.string())).to_numpy()
    found = np.zeros((len(keys), len(languages)), dtype=np.int64)
    found[place, lang] = counts["n"].to_numpy()
    rows = np.zeros(found.shape)
    for j, column in enumerate(found.T):
        total = int(column.sum()) + 0.1 * len(keys)
        kinds, kind = np.unique(column, return_inverse=True)
        rows[:, j] = np.array([math.log((n + 0.1) / total) for n in kinds.tolist()])[kind]
    return Table(keys, rows - rows.mean(axis=1, keepdims=True) if rows.size else rows)


@dataclass
class Model:
    """Log frequencies of words, and of n-grams by their length."""

    languages: list[str]
    words: Table
    grams: dict[int, Table]
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(MAX_GRAM, 0, -1):
            found = [row for row in map(self.grams[n].get, grams(word, n)) if row is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))

    def scores(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior; `und` and 0 without text, letters or learned languages."""
        words = Counter(letter_words(text)) if text else None
        if not words or not self.languages:
            return UNKNOWN, 0.0
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self.word(w)
        logits = np.array(list(words.values()), dtype=np.float64) @ np.array([cache[w] for w in words])
        best = int(np.argmax(logits))
        return self.languages[best], float(1.0 / np.exp(logits - logits[best]).sum())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text"))):
            for w, n in Counter(letter_words(text)).items():
                counts[lang, w] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang for lang, _ in counts], pa.string()),
                pa.array([w for _, w in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "word", "n"],
        )


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, count in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for n in range(1, MAX_GRAM + 1):
                for g in grams(word, n):
                    counts[lang, n, g] += count
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.int32()),
                pa.array([k[2] for k in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "size", "gram", "n"],
        )


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, min_count: int = MIN_COUNT) -> Model:
    """A model of the labelled rows of `docs` (doc_id, text, lang) outside the held-out fold.

    Rows without text or language are left out. Only words and n-grams seen `min_count` times in
    the sample are kept, so that what comes to the driver is bounded by the sample.
    """
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sample = bounded_sample(labelled, "lang", rows_per_language, "language", ["doc_id"])
    words = (
        sample.select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .persist()
    )
    try:
        known = words.where(F.col("n") >= min_count)
        of_words = known.select("lang", F.col("word").alias("key"), "n").toArrow()
        parts = (
            words.mapInArrow(_gram_counts, "lang string, size int, gram string, n long")
            .groupBy("lang", "size", "gram")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count)
        )
        of_grams = parts.select("lang", "size", F.col("gram").alias("key"), "n").toArrow()
    finally:
        words.unpersist()
    languages = sorted({*pc.unique(of_words["lang"]).to_pylist(), *pc.unique(of_grams["lang"]).to_pylist()})
    by_size = {n: of_grams.filter(pc.equal(of_grams["size"], n)) for n in range(1, MAX_GRAM + 1)}
    model = Model(languages, log_frequencies(of_words, languages), {n: log_frequencies(c, languages) for n, c in by_size.items()})
    del of_words, of_grams, by_size
    release_arrow()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its whole text and nothing else.

    `und` with score 0 where the text is null, empty or has no letter, or where nothing was learned.
    Repeated rows give repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.scores(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose text has a language, with all their columns, order and names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.scores(t)[0] != UNKNOWN for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
