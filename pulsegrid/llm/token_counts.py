"""Token counts by heap-and-linked-list byte-pair merging.

Each piece of text starts as a doubly linked list of bytes. A heap holds the ranks of
adjacent pairs; the lowest rank, leftmost first, is popped and merged, and the pairs at
both sides of the new symbol are pushed. The count is the initial symbols minus the
merges; no identifiers are made. A piece of n bytes takes O(n log n).

A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text count as
one token each, as the library does by default. Rows keep their ids, nulls and repeats
included; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.byte_pairs import BYTE_LEVEL_PATTERN, Vocabulary, vocabulary, vocabulary_path
from pulsegrid.llm.common import chunks, enter

#: Counts of short pieces are remembered, so many at most in each Python worker.
REMEMBERED, SHORT = 800_000, 48
CHUNK_BYTES = 4 << 20


def merged_length(vocab: Vocabulary, piece: bytes) -> int:
    """How many symbols are left of a piece when no pair can be merged."""
    n = len(piece)
    if n < 2:
        return n
    shift, ranks, made = vocab.SHIFT, vocab.rank, vocab.made
    symbol = [vocab.of_byte[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbol[i] << shift | symbol[i + 1])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        top = heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbol[i] < 0 or ranks.get(symbol[i] << shift | symbol[j]) != rank:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = made[rank], -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(symbol[i] << shift | symbol[k])) is not None:
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := ranks.get(symbol[h] << shift | symbol[i])) is not None:
            heappush(heap, r << 32 | h)
    return n - merges


class _Counts(dict):
    """Counts of pieces by piece; forgets all when full."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> int:
        n = merged_length(self.vocab, piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from text to its number of tokens."""
    vocab = vocabulary(path)
    counts, pieces = _Counts(vocab), regex.compile(BYTE_LEVEL_PATTERN).findall

    def count(text: str) -> int:
        total = 0
        for i, part in enumerate(vocab.split_special(text)):
            total += i % 2 or sum(map(counts.__getitem__, pieces(part)))
        return total

    return count


def _release() -> None:
    counter.cache_clear()
    vocabulary.cache_clear()


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_counts", _release)
        count = counter(path)
        for whole in batches:
            for batch in chunks(whole, 1, CHUNK_BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tokens = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
