"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its byte runs of two to four inside and at the edges of words,
A-Z as a-z, hashed into BUCKETS. Their embeddings are averaged, and a linear layer with
a softmax gives the languages' probabilities. Both layers are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows: at most
SAMPLE_ROWS for each of the MOST_LANGUAGES most frequent labels, chosen by a hash of the
id, as long as their texts add up to SAMPLE_BYTES for a language at most, and to
TOTAL_BYTES for all, which languages have equal parts of; no text is cut, and one that
alone makes more than a LARGEST_PART-th of SAMPLE_BYTES, or more than its language's
part, isn't drawn. So the driver's memory has a bound that no labels change. A fifth of the sample is
kept from training and calibrates: a temperature makes probabilities match how often
they are right, but only ever softens them, as a sample without errors would ask for
endless sharpness. The rejection threshold lies halfway between chance and the score
that REJECTED of the rightly recognised texts are below. A softmax only tells learned
languages apart, so a text must also be familiar: the mean logarithm of its features'
shares in the sample of the language found. Of the texts kept from training, REJECTED
are below some familiarity; as far again below it as the middle is above, texts are
rejected as of no learned language.

Averaging and the linear layer commute, so the trained model is folded into one row of
scores and familiarities for each bucket, and a text takes one sum over those rows. The
model's size, BUCKETS times twice the number of languages, doesn't grow with the corpus.

Texts that are null or have no letter are `und` with score 0, and rejected. Labels that
are null are not learned; without labels all texts are `und`. Null ids count as the
empty id. Rows that repeat are predicted each; an empty table gives an empty result.
Extra columns are not read by `predict`, and pass through `drop_rejected`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import LOWER, as_bytes, chunks, enter

BUCKETS_BITS, WIDTH, GRAMS = 16, 16, (2, 3, 4)
SAMPLE_ROWS, SAMPLE_BYTES, TOTAL_BYTES, LARGEST_PART, MOST_LANGUAGES = 400, 4 << 20, 16 << 20, 16, 200
EPOCHS, RATE, PIECE_WORDS = 3, 0.5, 40
REJECTED, UNSEEN = 0.001, 1e-5
SEED = 77
CHUNK_BYTES, BLOCK = 4 << 20, 1 << 20

_SPACED = bytes(32 if b < 128 and not chr(b).isalpha() else LOWER[b] for b in range(256))
_ASCII_LETTER, _LETTER = regex.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or bool(_LETTER.search(text.decode("utf-8", "replace")))


def features(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's byte runs, in parts of bounded size."""
    b = np.frombuffer(b" " + text.translate(_SPACED) + b" ", dtype=np.uint8)
    longest = max(GRAMS)
    for start in range(0, len(b), BLOCK):
        part = b[start : start + BLOCK + longest - 1].astype(np.uint32)
        gap = part == 32
        for n in GRAMS:
            count = min(BLOCK, len(part) - n + 1)
            if count <= 0:
                continue
            h = np.full(count, n, dtype=np.uint32)
            inner = np.zeros(count, dtype=bool)
            for k in range(n):
                h = h * np.uint32(0x01000193) + part[k : k + count]
                if 0 < k < n - 1:
                    inner |= gap[k : k + count]
            whole = ~inner & ~(gap[:count] & gap[n - 1 : n - 1 + count])
            h = h[whole] * np.uint32(0x9E3779B1)
            yield (h >> np.uint32(32 - BUCKETS_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # a row for each bucket: scores, folded and divided by the temperature, then familiarities
    bias: np.ndarray
    threshold: float
    familiar: float

    def judge(self, text: bytes | None) -> tuple[str, float, bool]:
        """The language, its score, and whether it is rejected."""
        k = len(self.languages)
        if not k or not text or not has_letter(text):
            return "und", 0.0, True
        total, n = np.zeros(2 * k), 0
        for ids in features(text):
            total += self.scores[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        mean = total / max(n, 1)
        p = _softmax(mean[:k] + self.bias)
        best = int(p.argmax())
        score = float(min(max(p[best], 0.0), 1.0))
        return self.languages[best], score, bool(score < self.threshold or mean[k + best] < self.familiar)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[bytes, str]], seed: int = SEED) -> Model:
    """A calibrated model from (text, language) samples. Texts are also learned in pieces, so short ones are known too."""
    samples = [(t, lang) for t, lang in samples if t and has_letter(t)]
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0)
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    aside = set(order[: len(samples) // 5].tolist()) if len(samples) >= 10 * len(languages) else set()
    place = np.min_scalar_type((1 << BUCKETS_BITS) - 1)
    units: list[tuple[np.ndarray, np.ndarray, int]] = []
    shares = np.zeros((1 << BUCKETS_BITS, len(languages)))
    for i, (text, lang) in enumerate(samples):
        if i in aside:
            continue
        seen = np.zeros(1 << BUCKETS_BITS)
        for ids in features(text):
            seen += np.bincount(ids, minlength=len(seen))
        shares[:, number[lang]] += seen / max(seen.sum(), 1)
        words = text.split(b" ")
        for at in range(0, len(words), PIECE_WORDS):
            ids = np.concatenate([*features(b" ".join(words[at : at + PIECE_WORDS])), np.zeros(0, dtype=np.int64)])
            if len(ids):
                buckets, counts = np.unique(ids, return_counts=True)
                units.append((buckets.astype(place), (counts / counts.sum()).astype(np.float32), number[lang]))
    embed = rng.normal(0, 0.1, (1 << BUCKETS_BITS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), dtype=np.float32)
    steps, step = EPOCHS * len(units), 0
    for _ in range(EPOCHS):
        for u in rng.permutation(len(units)):
            buckets, share, answer = units[u]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ embed[buckets]
            error = _softmax(mean @ layer + bias)
            error[answer] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            embed[buckets] -= rate * np.outer(share, back) * len(buckets)
    folded = embed @ layer
    known = np.log(shares / np.maximum(shares.sum(axis=0), 1) + UNSEEN)
    logits, answers, near = [], [], []
    for i in sorted(aside) or range(len(samples)):
        ids = np.concatenate([*features(samples[i][0]), np.zeros(0, dtype=np.int64)])
        logits.append(folded[ids].mean(axis=0) + bias if len(ids) else bias)
        answers.append(number[samples[i][1]])
        near.append(known[ids, answers[-1]].mean() if len(ids) else 0.0)
    z, y = np.array(logits, dtype=np.float64), np.array(answers)
    rows = np.arange(len(y))
    loss = lambda t: -np.log(_softmax(z / t)[rows, y] + 1e-12).mean()
    temperature = min(np.geomspace(1, 20, 61), key=loss)
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    chance = 1 / len(languages)
    threshold = (chance + float(np.quantile(right, REJECTED))) / 2 if len(right) else chance
    familiar = 2 * float(np.quantile(near, REJECTED)) - float(np.median(near))
    return Model(languages, np.hstack([folded / temperature, known]).astype(np.float32), bias / temperature, threshold, familiar)


def fold_of(id_col: Column, folds: int = 4) -> Column:
    """The fold of an id: crc32 of its text modulo `folds`."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows outside the held-out fold, from at most `rows` of each language and within the bounds on bytes.

    Rows are drawn where a hash of the id falls below a share that makes about 1.5
    times as many, and the first by hash are taken, so the sample is the same in each run.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & (fold_of(F.col("id")) != held_out))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return train([])
    scale, part = 1 << 30, min(SAMPLE_BYTES, TOTAL_BYTES // len(counts))
    order = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(scale))
    limit = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(scale * min(1.0, (1.5 * rows + 50) / n)))))
    drawn = known.withColumn("order", order).filter((F.col("order") < limit[F.col("lang")]) & (size <= min(part, SAMPLE_BYTES // LARGEST_PART)))
    by_order = Window.partitionBy("lang").orderBy("order", "id")
    first = drawn.withColumn("place", F.row_number().over(by_order)).filter(F.col("place") <= rows)
    taken = first.withColumn("bytes", F.sum(size).over(by_order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("bytes") <= part).orderBy("lang", "place").select(F.col("text").cast("binary").alias("text"), "lang")
    return train([(bytes(r["text"] or b""), r["lang"]) for r in taken.toLocalIterator()])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        for whole in batches:
            for batch in chunks(whole, 1, CHUNK_BYTES):
                found = [shared.value.judge(t) for t in as_bytes(batch.column(1))]
                columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is recognised, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        for whole in batches:
            for batch in chunks(whole, at, CHUNK_BYTES):
                yield batch.filter(pa.array([not shared.value.judge(t)[2] for t in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
