"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one token that its encoding ends with. An automaton
over the vocabulary, whose suffix links list every token that ends at a position, gives
the candidates; a candidate is the one if it follows the last token of the prefix
before it, that is if merging the two side by side would leave them apart. The stored
last tokens are back-pointers: followed from the whole word, they spell its encoding.

Whether token b may follow token a is read off the merge table. While both grow from
single symbols, the symbols at the border are those on the right edge of a's merge tree
and on the left edge of b's; b follows a if no pair of them has a merge that comes
before the next merge on either side. At equal ranks the pair further left is first.

Texts are composed (NFC), white space runs become one space, letters lower case, and
then only words, single digits and runs of signs are encoded, as the vocabulary's own
settings say. Decoding joins the vocabulary's spellings with spaces, which is what the
library gives for a vocabulary that names no decoder.

A null text counts as empty: no tokens, digests of the empty string. Rows keep their
ids, nulls and repeats included; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.byte_pairs import BYTE_OF_LETTER, WORD_LEVEL_PATTERN, Vocabulary, vocabulary, vocabulary_path
from pulsegrid.llm.common import chunks, enter

#: Encodings of short words and verdicts on pairs that are remembered, so many at most in each Python worker.
REMEMBERED_WORDS, SHORT, REMEMBERED_PAIRS = 250_000, 40, 200_000
CHUNK_BYTES = 4 << 20
_END = "Ā"  # stands for the end-of-word suffix; bytes are spelled in Latin-1, so it is free
_NEVER = 1 << 62


class Encoder:
    """Encodes single words (after splitting) for one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        self._pairs: dict[int, bool] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        for text, token in vocab.id_of.items():
            ends = bool(vocab.suffix) and text.endswith(vocab.suffix)
            letters = text[: -len(vocab.suffix)] if ends else text
            spelled = "".join(chr(BYTE_OF_LETTER[c]) for c in letters) + _END * ends
            if len(spelled) > 255:
                raise ValueError("a token of more than 255 bytes does not fit the automaton's payload")
            self.automaton.add_word(spelled, token << 8 | len(spelled))
        self.automaton.make_automaton()
        self.whole: dict[int, bool] = {}
        for token in sorted(vocab.id_of.values(), key=lambda t: vocab.parts.get(t, (0, 0, -1))[2]):
            a, b, rank = vocab.parts.get(token, (None, None, -1))
            self.whole[token] = a is None or self.whole[a] and self.whole[b] and self._apart(a, b, rank)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at a token's left (0) or right (1) edge as it grows, each with its rank."""
        known = self._right if side else self._left
        if (edge := known.get(token)) is None:
            parts = self.vocab.parts.get(token)
            edge = known[token] = [*self._edge(parts[side], side), (token, parts[2])] if parts else [(token, -1)]
        return edge

    def _apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge before rank `until` crosses the border of a and b."""
        left, right, ranks, shift = self._edge(a, 1), self._edge(b, 0), self.vocab.rank, self.vocab.SHIFT
        i = j = 0
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1][1] if j + 1 < len(right) else _NEVER
            crossing = ranks.get(left[i][0] << shift | right[j][0], _NEVER)
            if crossing < until and crossing < next_left and crossing <= next_right:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def follows(self, a: int, b: int) -> bool:
        key = a << self.vocab.SHIFT | b
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The identifiers of a word's tokens, the last of them ending the word."""
        if not word:
            return []
        spelled = word.decode("latin-1") + (_END if self.vocab.suffix else "")
        n, whole, follows = len(spelled), self.whole, self.follows
        last, length = [-1] * (n + 1), [0] * (n + 1)
        for end, found in self.automaton.iter(spelled):
            at = end + 1
            if last[at] >= 0 or not whole[token := found >> 8]:
                continue
            size = found & 255
            start = at - size
            if start == 0 or (before := last[start]) >= 0 and follows(before, token):
                last[at], length[at] = token, size
        out, at = [], n
        while at > 0:
            if not length[at]:
                raise ValueError(f"the vocabulary has no token for a part of {spelled!r}")
            out.append(last[at])
            at -= length[at]
        return out[::-1]


class _Words(dict):
    """(identifiers as bytes, spellings) of words; forgets all when full."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.encoder.encode(word.encode())
        out = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.encoder.vocab.text_of.__getitem__, ids))
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = out
        return out


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.words = _Words(Encoder(self.vocab))
        self._find = regex.compile(WORD_LEVEL_PATTERN).findall

    def _pairs(self, text: str) -> list[tuple[bytes, str]]:
        out = []
        for i, part in enumerate(self.vocab.split_special(text)):
            if i % 2:
                out.append((struct.pack("<I", self.vocab.special[part]), part))
            else:
                # Letters are lowered one by one: the library has no rule for a final sigma.
                lowered = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.words.__getitem__, self._find(lowered))
        return out

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """Identifiers as little-endian 32-bit numbers, and the decoded text, in one go."""
        pairs = self._pairs(text)
        return b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])

    def encode(self, text: str) -> list[int]:
        packed = b"".join(p[0] for p in self._pairs(text))
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.vocab.text_of[i] for i in ids if i in self.vocab.text_of)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Built once in each Python worker."""
    return Codec(path)


def _release() -> None:
    codec.cache_clear()
    vocabulary.cache_clear()


def _map(docs: DataFrame, path: str | None, id_col: str, text_col: str, fields: list[T.StructField], columns) -> DataFrame:
    """id, n_tokens and the columns that `columns` makes of a batch's packed identifiers and decoded texts."""
    path = path or vocabulary_path("word_bpe_49k.json")
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe_codec", _release)
        encode = codec(path).encode_packed
        for whole in batches:
            for batch in chunks(whole, 1, CHUNK_BYTES):
                found = [encode(t or "") for t in batch.column(1).to_pylist()]
                packed, texts = [x[0] for x in found], [x[1] for x in found]
                counts = pa.array([len(x) // 4 for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, *columns(packed, texts)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _as_lists(packed: list[bytes], texts: list[str]) -> list[pa.Array]:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(texts, pa.string())]


def _as_digests(packed: list[bytes], texts: list[str]) -> list[pa.Array]:
    return [pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, token_ids (array of int), decoded text."""
    return _map(docs, path, id_col, text_col, [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], _as_lists)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256."""
    return _map(docs, path, id_col, text_col, [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], _as_digests)
