"""Packing documents into training sequences by multiway differencing (Karmarkar-Karp).

A document is tokenised once and cut: whole sequences first, then its rest into pieces of at most
`piece` tokens. Whole sequences stand alone. The other pieces are dealt by hash into batches of bounded
size, and each batch is divided into windows by differencing: the two partial partitions of largest
imbalance merge with their loads opposed, until one is left, whose windows are nearly equal. If the
fullest exceeds the capacity, the number of windows rises and the batch is divided anew.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

CAPACITY = 1024
#: Tokens of a piece at most, where a document's rest is cut.
PIECE = 256
#: Pieces of a batch, on average.
BATCH = 512
END = 0

#: Splits text into words as the vocabulary expects. The second form lacks the look-ahead that only
#: matters in runs of white space, and is several times cheaper.
_SPLIT = public_tokenizers.PATTERN
_SPLIT_SINGLE = _SPLIT.replace(r"\s+(?!\S)|", "")
_RUN = re.compile(r"\s\s")


def _byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoders(vocabulary: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """Encoders of a byte-level tokenizer file: for any text, and for text without runs of white space."""
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    of = _byte_of_character()
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tuple(
        tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for name, pattern in ((vocabulary, _SPLIT), (f"{vocabulary}-single", _SPLIT_SINGLE))
    )


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """The ids of a whole text (null: none), then the id that ends a document."""
    text = text or ""
    anyhow, single = encoders(vocabulary)
    ids = (anyhow if _RUN.search(text) else single).encode_ordinary(text)
    ids.append(END)
    return np.array(ids, dtype="<u4")


def cuts(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences, then pieces of the rest, the last one as it comes."""
    whole = tokens - tokens % capacity
    starts = [*range(0, whole, capacity), *range(whole, tokens, piece)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], tokens])]


def _pieces(vocabulary: str, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = token_ids(text, vocabulary)
                for start, length in cuts(len(ids), capacity, piece):
                    at.append(i)
                    rows.append((start, length, zlib.crc32(ids[start : start + length]), len(ids)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    *(pa.array(c, pa.int64()) for c in columns),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """Multiway differencing: the window of every size, such that the windows' sums are nearly equal.

    A partial partition is a pair of arrays over the windows: loads in falling order, less the smallest,
    and the set of items behind each (-1: none). Sets are nodes of a forest; uniting two makes a parent.
    """
    n = len(sizes)
    heap, unions, nodes = [], [], n
    for i, size in enumerate(sizes):
        heap.append((-size, i, None))  # an item alone: its array is made when it is merged
    heapq.heapify(heap)

    def arrays(imbalance: int, tag: int, partition) -> tuple[np.ndarray, np.ndarray]:
        if partition is not None:
            return partition
        loads, sets = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
        loads[0], sets[0] = -imbalance, tag
        return loads, sets

    while len(heap) > 1:
        first = heapq.heappop(heap)
        a, of_a = arrays(*first)
        b, of_b = arrays(*heapq.heappop(heap))
        loads, other = a + b[::-1], of_b[::-1]  # heaviest of one against lightest of the other
        sets = np.where(of_a < 0, other, of_a)
        for k in np.flatnonzero((of_a >= 0) & (other >= 0)).tolist():
            unions.append((int(of_a[k]), int(other[k])))
            sets[k] = nodes
            nodes += 1
        order = np.argsort(-loads, kind="stable")
        loads, sets = loads[order], sets[order]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), first[1], (loads, sets)))
    window = np.full(nodes, -1, dtype=np.int64)
    if heap:
        _, sets = arrays(*heap[0])
        filled = np.flatnonzero(sets >= 0)
        window[sets[filled]] = filled
    for node in range(nodes - 1, n - 1, -1):
        left, right = unions[node - n]
        window[left] = window[right] = window[node]
    return window[:n]


def divide(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of every size, none fuller than `capacity`; the number of windows rises until that holds."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, windows)
        fullest = int(np.bincount(window, weights=sizes, minlength=1).max())
        if fullest <= capacity:
            return np.unique(window, return_inverse=True)[1]
        # as many windows as leave room for this deviation from the mean
        room = max(1, capacity - math.ceil(fullest - total / windows))
        windows = max(windows + 1, -(-total // room)) if room > capacity // 2 else windows + 1


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        identity = ["doc_id", "start", "ids_crc32", "doc_tokens"]
        rows = rows.sort_values(identity, ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        full = lengths == capacity
        sequence[full] = np.arange(full.sum())
        at = np.flatnonzero(~full)
        if len(at):
            window = divide(lengths[at].tolist(), capacity)
            order = np.argsort(window, kind="stable")
            window, at = window[order], at[order]
            ends = np.cumsum(lengths[at])
            opens = np.flatnonzero(np.diff(window, prepend=-1))
            before = (ends - lengths[at])[opens]
            sequence[at] = full.sum() + window
            offset[at] = ends - lengths[at] - np.repeat(before, np.diff(np.append(opens, len(at))))
        copy = rows.groupby(identity, dropna=False, sort=False).cumcount().astype("int64")
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset, copy=copy)

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, piece: int = PIECE, batch: int = BATCH
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy.

    A null or empty text is its end token alone. Rows that repeat an id are packed one by one; `copy`
    numbers those whose pieces are the same. Rows without an id are packed too. Other columns are
    ignored; an empty table packs nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity, piece), schema)
    pieces = stored(cut, "pieces")
    partial = pieces.where(F.col("length") < capacity).count()
    batches = max(1, -(-partial // batch))
    # whole sequences are dealt over the batches too: they need a number, nothing else
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(batches))
    return (
        pieces.withColumn("batch", spread)
        .groupBy("batch")
        .applyInPandas(_pack(capacity), f"{schema}, batch long, sequence_id long, offset long, copy long")
        .drop("batch")
    )
