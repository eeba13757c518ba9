"""Ranked lexical search with hashed max-sketches.

The index is a table of segments of documents. A segment holds, for each document, its
terms with their frequencies, and a sketch of COORDINATES places: each term falls on one
place by its hash, and a place keeps the greatest impact of the terms that fall on it. A
document's impacts grow with the frequency and else depend on its length only, so the
greatest frequency stands for the greatest impact, and the index doesn't go stale when
the corpus' totals change.

Test items come in blocks. For a block, the tasks look up all items in all sketches of
some documents at once, as one product of matrices. A place's impact is at least that of
each term on it, and weights are not negative, so the sum over an item's terms is an
upper bound of its score. A task then takes each item's documents by descending bound
and computes exact scores from the frequencies, until no bound is left that reaches the
lowest of the item's best scores so far. Every task returns its best documents for each
item; the best of those are found in two steps.

Terms are maximal runs of characters other than ASCII signs and controls, A-Z in lower
case, as 64-bit hashes (`words`). The score is as in `score_of`. Equal scores go by
ascending id, null ids last.

Null texts have no terms, and a document without terms is in no list and not counted. Each
row of a repeated document is a document, each row of a repeated item an item with its
own ranks; an item without an id is listed under null. Items without terms have no rows. Empty
tables give empty results. Columns beside ids and texts are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.common import Scratch, as_bytes, chunks, enter, one_by_one
from pulsegrid.llm.words import SIGNS, word_hashes

TOP = 20
SEGMENT_BYTES = 4 << 20
COORDINATE_BITS = 10
COORDINATES = 1 << COORDINATE_BITS
#: A sketch's place holds frequencies to this; it stands for this one and all greater ones.
MOST_TF = 255
#: Terms of items in one pass over the index; more take more passes. Items and documents in one product of matrices.
BLOCK_TERMS, ITEMS_AT_ONCE, DOCUMENTS_AT_ONCE = 1 << 18, 256, 1024
#: Fixed values of the score: the scale, and the constants of saturation and length.
SCALE, K, LENGTH, BASE = 1_000_000_000, 12, 25, 100
LIST_PARTS = 64


def weight_of(documents: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_of(n: int, documents: int, terms: int) -> int:
    """What a document's length does to its impacts."""
    return BASE - LENGTH + (LENGTH * n * documents) // terms


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The impact of terms by frequency and their document's length."""
    tf = tf.astype(np.int64)
    return (SCALE * tf) // np.maximum(1000 * tf + K * length, 1)


def _index_schema(kind: T.DataType) -> T.StructType:
    arrays = [T.StructField("ids", T.ArrayType(kind)), T.StructField("n_terms", T.ArrayType(T.LongType()))]
    return T.StructType([*arrays, *(T.StructField(n, T.BinaryType()) for n in ("terms", "df", "counts", "places", "tf", "sketches"))])


def _segment(texts: list[bytes | None]) -> tuple[list[int], list[bytes]]:
    """The number of terms of each text, and the segment's arrays."""
    words = [word_hashes(t or b"", SIGNS) for t in texts]
    n = [len(w) for w in words]
    terms, place = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *words]), return_inverse=True)
    size = max(len(terms), 1)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + place, return_counts=True)
    document, place = key // size, key % size
    coordinate = (terms >> np.uint64(64 - COORDINATE_BITS)).astype(np.int64)[place]
    sketches = np.zeros((len(n), COORDINATES), dtype=np.uint8)
    np.maximum.at(sketches, (document, coordinate), np.minimum(tf, MOST_TF).astype(np.uint8))
    arrays = [terms, np.bincount(place, minlength=len(terms)).astype(np.uint32), np.bincount(document, minlength=len(n)).astype(np.uint32), place.astype(np.uint32), tf.astype(np.uint32), sketches]
    return n, [a.tobytes() for a in arrays]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the documents, to be stored."""
    schema = _index_schema(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lexical_search")
        for whole in batches:
            for batch in chunks(whole, 1, SEGMENT_BYTES):
                n, arrays = _segment(as_bytes(batch.column(1)))
                ids = pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n], pa.list_(pa.int64())), *(pa.array([a], pa.binary()) for a in arrays)], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


class Items:
    """A block of items: their rows' numbers and ids, and their terms as places in the block's vocabulary, with how often they occur."""

    def __init__(self, rows: list[tuple[int, Any, np.ndarray]]):
        self.rows, self.ids = [r[0] for r in rows], [r[1] for r in rows]
        self.vocabulary, place = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(r[2] for r in rows)]), return_inverse=True)
        ends = np.cumsum([len(r[2]) for r in rows])
        self.terms = [np.unique(p, return_counts=True) for p in np.split(place, ends[:-1])] if rows else []
        self.coordinate = (self.vocabulary >> np.uint64(64 - COORDINATE_BITS)).astype(np.int64)


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The items with terms, in blocks of at most BLOCK_TERMS terms or one item, fetched one partition at a time."""
    block, size = [], 0
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    for number, row in enumerate(rows.toLocalIterator()):
        terms = word_hashes(bytes(row["text"]), SIGNS)
        if block and size + len(terms) > BLOCK_TERMS:
            yield Items(block)
            block, size = [], 0
        if len(terms):
            block.append((number, row["item"], terms))
            size += len(terms)
    if block:
        yield Items(block)


def document_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each term of a sorted vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lexical_search")
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, df in zip(batch.column(0), batch.column(1), strict=True):
                terms, df = np.frombuffer(terms.as_py(), dtype=np.uint64), np.frombuffer(df.as_py(), dtype=np.uint32)
                place = _places(terms, vocabulary)
                total[place >= 0] += df[place[place >= 0]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    found = one_by_one(index.select("terms", "df")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for row in found.toLocalIterator():  # at most one for each term of the block
        out[row["term"]] = row["df"]
    return out


def _places(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in a sorted array, -1 for those not in it."""
    if not len(terms):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


class Segment:
    """One segment, opened for a block of items."""

    def __init__(self, row: dict, items: Items, totals: tuple[int, int]):
        of = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.ids, self.n_terms = row["ids"], row["n_terms"]
        self.length = np.array([length_of(n, *totals) for n in self.n_terms], dtype=np.int64)
        self.size = max(len(row["terms"]) // 8, 1)
        self.place = _places(of("terms", np.uint64), items.vocabulary)
        self.counts, self.places, self.tf = of("counts", np.uint32), of("places", np.uint32), of("tf", np.uint32)
        self.sketches = of("sketches", np.uint8).reshape(len(self.ids), COORDINATES)
        self.keys = None  # (document, term) of every frequency, ascending

    def greatest(self, documents: slice) -> np.ndarray:
        """The greatest impact on each place of documents' sketches."""
        tf = self.sketches[documents]
        out = impacts(tf, self.length[documents, None])
        out[tf == MOST_TF] = SCALE // 1000  # no impact reaches this
        return out.astype(np.float64)

    def scores(self, documents: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents for the terms of an item."""
        if self.keys is None:
            self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.size + self.places
        place = self.place[terms]
        place, weights = place[place >= 0], weights[place >= 0]
        wanted = documents[:, None] * self.size + place
        if not len(place) or not len(self.keys):
            return np.zeros(len(documents), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        tf = np.where(self.keys[at] == wanted, self.tf[at], 0)
        return (impacts(tf, self.length[documents, None]) * weights).sum(axis=1)


class Best:
    """The best documents so far for each item of a block."""

    def __init__(self, items: Items, weights: np.ndarray, top: int):
        self.items, self.top = items, top
        self.weights = [weights[terms] * counts for terms, counts in items.terms]
        self.lists: list[list[tuple[int, bool, Any]]] = [[] for _ in items.rows]

    def least(self, item: int) -> int:
        """A document with a lower score isn't in the item's list."""
        found = self.lists[item]
        return -found[-1][0] if len(found) == self.top else 1

    def take(self, segment: Segment) -> int:
        """Consider a segment's documents; how many exact scores that took."""
        rescored = 0
        for at in range(0, len(segment.ids), DOCUMENTS_AT_ONCE):
            documents = slice(at, min(at + DOCUMENTS_AT_ONCE, len(segment.ids)))
            greatest = segment.greatest(documents)
            for low in range(0, len(self.weights), ITEMS_AT_ONCE):
                some = range(low, min(low + ITEMS_AT_ONCE, len(self.weights)))
                lookup = np.zeros((COORDINATES, len(some)))
                for i in some:
                    np.add.at(lookup[:, i - low], self.items.coordinate[self.items.terms[i][0]], self.weights[i])
                bounds = (greatest @ lookup).T * (1 + 1e-9)  # sums beyond 2^53 may have been rounded
                for i in some:
                    rescored += self._rescore(segment, i, at, bounds[i - low])
        return rescored

    def _rescore(self, segment: Segment, item: int, first: int, bounds: np.ndarray) -> int:
        """Exact scores by descending bound, until no bound reaches the least score that counts."""
        open_ = np.flatnonzero(bounds >= self.least(item))
        open_ = open_[np.argsort(-bounds[open_], kind="stable")]
        at, step = 0, 32
        while at < len(open_) and bounds[open_[at]] >= self.least(item):
            some = open_[at : at + step]
            scores = segment.scores(first + some, self.items.terms[item][0], self.weights[item])
            good = np.flatnonzero(scores >= self.least(item))
            found = [(-int(scores[g]), segment.ids[first + some[g]] is None, segment.ids[first + some[g]]) for g in good]
            # Of equal scores without id one is like the other, and None isn't comparable.
            self.lists[item] = sorted(self.lists[item] + found, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[: self.top]
            at, step = at + step, min(2 * step, 512)
        return min(at, len(open_))


def _search(index: DataFrame, items: Items, weights: np.ndarray, totals: tuple[int, int], top: int, schema: T.StructType) -> DataFrame:
    """Every task's best documents for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lexical_search")
        best = Best(items, weights, top)
        for batch in batches:
            for at in range(batch.num_rows):
                best.take(Segment(batch.slice(at, 1).to_pylist()[0], items, totals))
        part = TaskContext.get().partitionId() % LIST_PARTS
        arrow = to_arrow_schema(schema)
        for low in range(0, len(items.rows), 1024):
            out = [(items.rows[i], items.ids[i], part, x[2], -x[0]) for i in range(low, min(low + 1024, len(items.rows))) for x in best.lists[i]]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=schema.names)

    return one_by_one(index.select("ids", "n_terms", "terms", "counts", "places", "tf", "sketches")).mapInArrow(run, schema)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The `top` highest-scoring documents of each item: item, rank, document, score."""
    scratch = Scratch(docs.sparkSession, "search")
    index = scratch.save(build_index(docs, id_col, text_col), "index", group_rows=1)
    return search(index, items, scratch, top, item_col, item_text_col).select(F.col("item").alias(item_col), "rank", F.col("document").alias(id_col), "score")


def search(index: DataFrame, items: DataFrame, scratch: Scratch, top: int = TOP, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank, document, score from a stored index."""
    fields = [("row", T.LongType()), ("item", items.schema[item_col].dataType), ("part", T.IntegerType()), ("document", index.schema["ids"].dataType.elementType), ("score", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    each = index.select(F.explode("n_terms").alias("n")).filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).head()
    totals = (each["documents"], each["terms"] or 1)
    found, passes = None, 0
    for block in item_blocks(items, item_col, text_col) if each["documents"] else ():
        df = document_frequencies(index, block.vocabulary)
        weights = np.array([weight_of(totals[0], int(x)) for x in df], dtype=np.int64)
        found = scratch.save(_search(index, block, weights, totals, top, schema), "found", append=passes > 0)
        passes += 1
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    order = [F.desc("score"), F.asc_nulls_last("document")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("item", "rank", "document", "score")


def oracle_sql() -> str:
    """The same ranks by scoring every document that shares a term."""
    words = lambda table, key: rf"SELECT {key}, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM {table}"
    return f"""
WITH d AS ({words("documents", "doc_id")}), q AS ({words("benchmark", "item_id")}), asked AS (
    SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term
), lengths AS (
    SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), totals AS (
    SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
