"""Ranked search against plain Python, its bounds and thresholds, and odd tables."""

import glob
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import lexical_search as search
from pulsegrid.llm.common import Scratch, one_by_one

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def model(docs, items, top):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, length in docs:
            m = 75 + (25 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "日本", "naïve", "a_b", "x" * 40]
    docs = [(rng.choice([i, i, 7, None]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 200])))) for i in range(160)]
    docs += [(900, "w1 " * 700 + "w2"), (901, None), (902, "?! .."), (903, "W3 w3 w3"), (904, "W3 w3 w3"), (903, "W3 w3 w3")]
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(25)] + [(3, "w1 w1 w2"), (None, "w3"), (77, ""), (78, None), (79, "nowhere")]
    return docs, items


def rows_of(df):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def frames(spark, made):
    return spark.createDataFrame(made[0], "doc_id long, text string").repartition(3), spark.createDataFrame(made[1], "item_id long, text string")


@pytest.mark.parametrize("block_terms, at_once", [(1 << 18, 256), (30, 2)])
def test_ranks_equal_plain_python(spark, made, monkeypatch, block_terms, at_once):
    monkeypatch.setattr(search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", at_once)
    docs, items = frames(spark, made)
    assert rows_of(search.rank_documents(docs, items)) == model(*made, 20)
    assert rows_of(search.rank_documents(docs, items, top=3)) == model(*made, 3)


def test_odd_tables(spark, made):
    docs, items = frames(spark, made)
    for name in ("ids", "n", "n_terms", "term", "part", "row", "rank", "score", "item", "document", "item_id"):
        docs = docs.withColumn(name, F.lit("mine"))
    for name in ("doc_id", "row", "item", "score"):
        items = items.withColumn(name, F.lit("mine"))
    assert rows_of(search.rank_documents(docs, items)) == model(*made, 20)
    assert search.rank_documents(docs.filter("false"), items).count() == 0
    assert search.rank_documents(docs, items.filter("false")).count() == 0
    assert search.rank_documents(docs.filter("text IS NULL"), items).count() == 0
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    wanted = model([(None if i is None else str(i), t) for i, t in made[0]], made[1], 200)
    got = rows_of(search.rank_documents(named, items, top=200))
    assert sorted(re.sub("'", "", x) for x in got) == sorted(re.sub("'", "", x) for x in wanted)


def segment_of(texts, items):
    n, arrays = search._segment([t.encode() for t in texts])
    row = dict(zip(("terms", "df", "counts", "places", "tf", "sketches"), arrays, strict=True), ids=list(range(len(texts))), n_terms=n)
    return search.Segment(row, items, (len(texts), sum(n)))


def test_bounds_hold_and_leave_most_documents_unscored():
    rng = random.Random(5)
    words = [f"t{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(1500)]
    texts[40:70] = [t + " " + " ".join(words[:30]) for t in texts[40:70]]
    texts[5] = "t1 " * 400
    rows = [(0, 0, search.word_hashes(" ".join(words[:30]).encode(), search.SIGNS)), (1, 1, search.word_hashes(b"t1 t2 t3 t1", search.SIGNS))]
    items = search.Items(rows)
    segment = segment_of(texts, items)
    df = Counter(w for t in texts for w in set(t.split()))
    names = {int(search.word_hashes(w.encode(), search.SIGNS)[0]): w for w in words}
    weights = np.array([search.weight_of(len(texts), df[names[int(v)]]) for v in items.vocabulary])
    best = search.Best(items, weights, 20)
    greatest = segment.greatest(slice(0, len(texts)))
    for i, (place, _) in enumerate(items.terms):
        lookup = np.zeros(search.COORDINATES)
        np.add.at(lookup, items.coordinate[place], best.weights[i])
        exact = segment.scores(np.arange(len(texts)), place, best.weights[i])
        assert (greatest @ lookup >= exact).all()
    rescored = best.take(segment)
    exact = segment.scores(np.arange(len(texts)), items.terms[0][0], best.weights[0])
    assert [x[2] for x in best.lists[0]] == sorted(range(len(texts)), key=lambda d: (-exact[d], d))[:20]
    assert rescored < len(texts)  # of two items


def test_index_holds_every_row(spark, made):
    docs, _ = frames(spark, made)
    index = Scratch(spark, "test").save(search.build_index(docs), "index")
    assert index.select(F.explode("ids")).count() == len(made[0])


def test_a_task_holds_one_segment_however_many_it_reads(spark, made, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT_BYTES", 2000)
    docs, items = frames(spark, made)
    files = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/search-*/index/*.parquet"
    before = set(glob.glob(files))
    assert rows_of(search.rank_documents(docs, items)) == model(*made, 20)
    stored = [pq.ParquetFile(p).metadata for p in set(glob.glob(files)) - before]
    assert max(m.num_row_groups for m in stored) > 3
    groups = [m.row_group(i) for m in stored for i in range(m.num_row_groups)]
    assert {g.num_rows for g in groups} == {1}  # the reader decodes a row group at once
    assert not any(g.column(i).is_stats_set for g in groups for i in range(g.num_columns))  # the writer holds them until the file ends


def test_rows_one_by_one(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([sum(batch.column(0).to_pylist())], pa.int64())], names=["rows", "sum"])

    table = spark.range(0, 40, 1, 2)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert len(table.mapInArrow(sizes, "rows long, sum long").collect()) == 2
    apart = one_by_one(table)
    assert apart.collect() == table.collect()
    assert sorted(map(tuple, apart.mapInArrow(sizes, "rows long, sum long").collect())) == [(1, i) for i in range(40)]
    assert len(table.mapInArrow(sizes, "rows long, sum long").collect()) == 2 and spark.conf.get(most) == "10000"
