"""Collocations against plain Python, with small shards, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import collocations


def model(rows, support, most):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for p in range(len(w) - k + 1):
                    f[lang, tuple(w[p : p + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    best = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for p in range(len(w) - k + 1):
                best[lang, w[p : p + k]] = max(best[lang, w[p : p + k]], a)
    out = []
    for lang in n:
        mine = []
        for (of, w), a in found.items():
            if of == lang and 100 * best[lang, w] < 100 * a:
                score, _, left, right = min(((1000 * a * n[lang]) // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                mine.append((lang, " ".join(w), a, left, right, n[lang], score))
        mine.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


SCHEMA = "text string, lang string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["ab", "ba", "Ñu", "x y", "c", "C", "z\x00", "日本"]
    ends = [" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "\x0b", "\x1c", "!?"]
    made = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)]
    return [*made, (None, "en"), ("", "en"), (None, None), (" .. ", "fr"), *[("one two three four five six. one two", "en")] * 40, ("ab " * 5000, "de")]


@pytest.mark.parametrize("shard_bytes", [collocations.SHARD_BYTES, 700, 40])
def test_counts_equal_plain_python(spark, texts, monkeypatch, shard_bytes):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard_bytes)
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    assert rows_of(collocations.collocations(docs, support=12, most=25)) == model(texts, 12, 25)


@pytest.mark.parametrize("shard_bytes", [10_000_000, 2000, 300])
def test_shards_find_every_frequent_phrase(texts, monkeypatch, shard_bytes):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SHARD_BYTES", shard_bytes)
    rows = [(lang or "und", t or "") for t, lang in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["lang", "text"])
    total, support = sum(len(t.encode()) for _, t in rows), 12
    reached, unseen = Counter(), 0
    for shard in collocations.shards(iter([batch])):
        least = collocations.local_support(shard.weight, total, support)
        unseen += least - 1
        for size, places, counts, bits in shard.frequent(least):
            assert ((0 <= bits) & (bits < 1 << collocations.FILTER_BITS)).all() and (counts >= least).all()
            langs, phrases = shard.phrases(places, size)
            for k, c in zip(zip(langs.to_pylist(), phrases.to_pylist(), strict=True), counts.tolist(), strict=True):
                reached[k] += c - least + 1
    exact = Counter()
    for shard in collocations.shards(iter([batch])):
        for size, places, counts, _ in shard.frequent(1):
            langs, phrases = shard.phrases(places, size)
            for k, c in zip(zip(langs.to_pylist(), phrases.to_pylist(), strict=True), counts.tolist(), strict=True):
                exact[k] += c
    assert unseen < support / collocations.SLACK
    import numpy as np

    packed = collocations._packed(np.array([5, 1 << 20, 7, 5]), np.array([3, 1, 2, 4]), 6).to_pylist()
    assert [(r["part"], r["unseen"]) for r in packed] == [(None, 6), (0, None), (32, None)] and np.frombuffer(packed[1]["places"], np.uint16).tolist() == [5, 5, 7]
    assert all(reached[k] + unseen >= c for k, c in exact.items())
    assert {k for k, c in exact.items() if c >= support} <= set(reached)


def test_odd_tables(spark, texts):
    docs = spark.createDataFrame(texts, SCHEMA)
    clashing = docs
    for name in ("phrase", "size", "n", "place", "extra", "part", "rank", "a", "l", "r", "k", "w", "score"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    assert rows_of(collocations.collocations(clashing, support=12)) == model(texts, 12, 2000)
    assert collocations.collocations(docs.filter("false")).count() == 0
    assert collocations.collocations(docs.filter("text IS NULL")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    got = spark.sql("SELECT (cast(1234567890123 AS decimal(19,0)) * cast(98765432109876 AS decimal(19,0)) * 1000) div (cast(1234567890124 AS decimal(19,0)) * cast(12345678901 AS decimal(19,0))) AS x").head()["x"]
    assert got == (1234567890123 * 98765432109876 * 1000) // (1234567890124 * 12345678901)


@pytest.mark.parametrize("combined", [1, 40, 1 << 19])
def test_counts_of_parts_are_added_up(monkeypatch, combined):
    """However few rows are held at a time, and over however many batches a part goes."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "COMBINED", combined)
    rng = random.Random(1)
    rows = [(part, rng.choice(["de", "en"]), f"p{part} {rng.randrange(9)}", 2, rng.randrange(1, 50)) for part in range(12) for _ in range(rng.randrange(1, 60))] + [(0, "de", "", 0, 3), (0, "de", "", 0, 4)]
    columns = [*collocations.KEYS, "n"]
    table = lambda some: pa.table({c: pa.array([r[i] for r in some], t) for i, (c, t) in enumerate(zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True))})
    tasks = [collocations._by_part(collocations._added([table(rows[n::3])])) for n in range(3)]
    lists = sorted((r for t in tasks for r in t.to_pylist()), key=lambda r: r["part"])
    batches = [pa.RecordBatch.from_pylist(lists[n : n + 5], schema=tasks[0].schema) for n in range(0, len(lists), 5)]
    got = sorted(tuple(r.values()) for b in collocations._sums(iter(batches), 100) for r in b.to_pylist())
    exact = Counter()
    for _, *key, n in rows:
        exact[tuple(key)] += n
    assert got == sorted((*k, n) for k, n in exact.items() if n >= 100 or k[2] == 0)
