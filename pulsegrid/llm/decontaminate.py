"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment covers some documents of one task, and
holds their inverted index: a sorted dictionary of terms, and for each term the
ascending list of positions where it stands, positions running through the segment with
a gap after every document. So a term that is in every document is spread over all
segments, and no list has to be gathered anywhere.

A phrase is looked up in a segment by intersecting lists adjusted by the terms' offsets
in the phrase: the list of its rarest term there gives the possible starts, and each
next rarer term keeps those where it stands at its own offset. A phrase with a term
that the segment lacks is out at once. Proximity looks for all terms of a phrase within
a stretch of words, in any order, beginning with the rarest too.

Terms are words in lower case (A-Z only), as 64-bit hashes. Test items travel to the
segments in blocks of at most BLOCK_WORDS words, and a larger item in pieces that share
all but one word of a window. A test set of several blocks takes several passes over the
stored index. A pass stores its hits before the next block is fetched, so the driver and
a task hold one block at a time, and the hits of all passes are merged per document.

Null texts have no words. A benchmark row without an id hits words like any other; all
such rows are one item without name, a null at the end of a document's items, which counts as one of them. A
benchmark row without words has no phrase. Ids that repeat count once in a document's items.
Rows of documents that repeat, or have null ids, are each matched and reported. With an
empty benchmark nothing is hit. Extra columns are not read by `contamination`, and pass
through `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.common import Scratch, as_bytes, chunks, enter
from pulsegrid.llm.words import SIGNS, word_hashes

WINDOW = 13
#: A document is contaminated if a twentieth of its words is hit.
SHARE = 20
SEGMENT_BYTES = 8 << 20
#: Words of test items in one pass over the index, eight bytes each. More than a window.
BLOCK_WORDS = 1 << 20
#: Possible starts, and windows, held at a time within one segment.
STARTS, PART = 1 << 20, 1 << 15
#: A pass's hits: a document as (segment, place in it), its stretches of hit words, and the items they come from.
HITS = "segment long, place int, hit_from array<long>, hit_to array<long>, items array<string>"


def _segment(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; the dictionary, the lists' lengths, and the lists as gaps between positions."""
    words = [word_hashes(t or b"", SIGNS) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    all_words = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
    order = np.argsort(all_words, kind="stable")
    terms, starts, counts = np.unique(all_words[order], return_index=True, return_counts=True)
    # One position is left free after every document, so no phrase reaches into the next.
    positions = (np.arange(len(all_words)) + np.repeat(np.arange(len(n)), n))[order]
    gaps = np.diff(positions, prepend=0)
    gaps[starts] = positions[starts]
    return n, terms, counts.astype(np.uint32), gaps.astype(np.uint32)


def _segment_schema(kind: T.DataType) -> T.StructType:
    """One segment: its number, its documents, and their index."""
    return T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("keys", T.ArrayType(T.LongType())),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("gaps", T.BinaryType()),
        ]
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index. `keys` are hashes of the texts, to find rows again."""
    schema = _segment_schema(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        segment = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in chunks(whole, 2, SEGMENT_BYTES):
                n, terms, counts, gaps = _segment(as_bytes(batch.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment], pa.int64()),
                        pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)),
                        pa.array([batch.column(1).to_pylist()], pa.list_(pa.int64())),
                        pa.array([n], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts, gaps)),
                    ],
                    names=schema.names,
                )
                segment += 1

    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(run, schema)


class Segment:
    """One segment, opened for lookups."""

    def __init__(self, row: dict):
        self.ids, self.n_words = row["ids"], np.array(row["n_words"], dtype=np.int64)
        self.terms = np.frombuffer(row["terms"], dtype=np.uint64)
        self.counts = np.frombuffer(row["counts"], dtype=np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        gaps = np.frombuffer(row["gaps"], dtype=np.uint32).astype(np.int64)
        total = np.cumsum(gaps)
        before = total[self.starts[:-1]] - gaps[self.starts[:-1]] if len(self.terms) else total[:0]
        self.positions = total - np.repeat(before, self.counts)
        # All lists in one ascending array: term in the high bits, position in the low.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) << 40 | self.positions
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])[: len(self.n_words)]  # of each document

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Places of terms in the dictionary, -1 for those that are not in it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def stands(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        key = term << 40 | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0)

    def document(self, position: np.ndarray) -> np.ndarray:
        """Which document a position lies in."""
        return np.searchsorted(self.first, position, side="right") - 1

    def phrases(self, phrases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of all occurrences of phrases, the rows of a matrix of places in the dictionary, in parts."""
        place = phrases
        order = np.argsort(self.counts[place], axis=1, kind="stable")  # rarest first
        rarest = np.take_along_axis(place, order[:, :1], axis=1)[:, 0]
        lengths = self.counts[rarest]
        for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(lengths) // STARTS)) + 1):
            which = np.repeat(part, lengths[part])
            within = np.arange(len(which)) - np.repeat(np.cumsum(lengths[part]) - lengths[part], lengths[part])
            start = self.positions[self.starts[rarest[which]] + within] - order[which, 0]
            for k in range(1, phrases.shape[1]):
                offset = order[which, k]
                left = self.stands(place[which, offset], start + offset)
                which, start = which[left], start[left]
            left = start >= 0
            yield which[left], start[left]

    def near(self, place: np.ndarray, span: int) -> list[tuple[int, int, int]]:
        """(document, first position, last position + 1) of the shortest stretches, at most `span` words long, that hold all terms, given as places.

        Positions are counted within the document. Stretches that hold another are not listed.
        """
        place = np.unique(place)
        place = place[np.argsort(self.counts[place], kind="stable")]
        lists = [self.positions[self.starts[p] : self.starts[p + 1]] for p in place]
        documents = None  # those that hold all terms so far, from the rarest on
        for one in lists:
            found = np.unique(self.document(one))
            documents = found if documents is None else np.intersect1d(documents, found, assume_unique=True)
        out = []
        for d in documents:
            low, high = self.first[d], self.first[d] + self.n_words[d]
            parts = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
            at = np.concatenate(parts)
            kind = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            order = np.argsort(at, kind="stable")
            last = np.full(len(parts), -1, dtype=np.int64)
            previous = -1
            for position, k in zip(at[order], kind[order], strict=True):
                last[k] = position
                start = last.min()
                if start >= 0 and position - start < span and start > previous:
                    out.append((int(d), int(start - low), int(position - low + 1)))
                    previous = start
        return out


class Items:
    """A block of test items as words, one item's after the other's. None is without words; a name can be None."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]]):
        self.names = [name for name, _ in items]
        self.words = np.concatenate([np.zeros(0, dtype=np.uint64), *(words for _, words in items)])
        self.starts = np.concatenate([[0], np.cumsum([len(words) for _, words in items])]).astype(np.int64)

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words in a window, where windows start, whose they are): WINDOW words each, or the whole of a shorter item."""
        sizes = np.diff(self.starts)
        for size in np.unique(np.minimum(sizes, WINDOW)):
            of = np.flatnonzero(np.minimum(sizes, WINDOW) == size)
            counts = sizes[of] - size + 1
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield int(size), np.repeat(self.starts[of], counts) + within, np.repeat(of, counts)


def _hits(segment: Segment, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """(document, its stretches' first words, and ends, items) of the documents that a window stands in."""
    place = segment.lookup(items.words)
    absent = np.concatenate([[0], np.cumsum(place < 0)])
    edges = np.zeros(int(segment.first[-1] + segment.n_words[-1]) + 2 if len(segment.n_words) else 2, dtype=np.int64)
    pairs = []
    for size, starts, owners in items.windows():
        here = np.flatnonzero(absent[starts + size] == absent[starts])
        for at in range(0, len(here), PART):
            some = here[at : at + PART]
            for which, start in segment.phrases(place[starts[some][:, None] + np.arange(size)]):
                np.add.at(edges, start, 1)
                np.add.at(edges, start + size, -1)
                pairs.append(np.unique(segment.document(start) << 32 | owners[some[which]]))
    found = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pairs]))
    if not len(found):  # all words of a window can be there, and the window not
        return
    marks = (np.cumsum(edges) > 0).view(np.int8)
    documents, first = np.unique(found >> 32, return_index=True)
    for d, of in zip(documents.tolist(), np.split(found & 0xFFFFFFFF, first[1:]), strict=True):
        low = segment.first[d]
        edge = np.diff(marks[low : low + segment.n_words[d]], prepend=np.int8(0), append=np.int8(0))
        yield d, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), sorted({items.names[i] for i in of}, key=lambda name: (name is None, name or ""))


def _pass(index: DataFrame, items: Items) -> DataFrame:
    """HITS of one block of test items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = list(zip(*_hits(Segment(row), items), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(found[0]), pa.int64()),
                        pa.array(found[0], pa.int32()),
                        pa.array(found[1], pa.list_(pa.int64())),
                        pa.array(found[2], pa.list_(pa.int64())),
                        pa.array(found[3], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "hit_from", "hit_to", "items"],
                )

    return index.drop("keys").mapInArrow(run, HITS)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, pieces: bool = True) -> Iterator[Items]:
    """The test items in blocks of bounded size, fetched one partition at a time. Without `pieces`, an item larger than a block is a block."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = word_hashes(bytes(row["text"]), SIGNS)
        most = BLOCK_WORDS if pieces else max(BLOCK_WORDS, len(words))
        for at in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), most - WINDOW + 1):
            piece = words[at : at + most]
            if block and size + len(piece) > BLOCK_WORDS:
                yield Items(block)
                block, size = [], 0
            block.append((row["name"], piece))
            size += len(piece)
    yield Items(block)


def _merged(found: DataFrame) -> DataFrame:
    """HITS of several passes, once for each document: stretches that meet become one."""
    key = ["segment", "place"]
    each = found.select(*key, F.explode(F.arrays_zip("hit_from", "hit_to")).alias("s")).select(*key, F.col("s.hit_from").alias("low"), F.col("s.hit_to").alias("high"))
    order = Window.partitionBy(*key).orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(F.col("low") <= reached, 0).otherwise(1)).withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = each.groupBy(*key, "n").agg(F.min("low").alias("hit_from"), F.max("high").alias("hit_to"))
    stretches = stretches.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("hit_from", "hit_to"))).alias("s"))
    nameless = F.when(F.max(F.col("item").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    items = found.select(*key, F.explode("items").alias("item")).groupBy(*key).agg(F.concat(F.array_sort(F.collect_set("item")), nameless).alias("items"))
    return stretches.join(items, key).select(*key, F.col("s.hit_from").alias("hit_from"), F.col("s.hit_to").alias("hit_to"), "items")


def phrase_matches(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key, n_words, hit_from and hit_to (its stretches of hit words), items.

    Words count from 0 and `hit_to` is exclusive; `items` are the ids of items with a
    window in the document, sorted as strings, each once, null last. `index` is a stored table.
    """
    scratch, passes = Scratch(index.sparkSession, "phrases"), 0
    for block in item_blocks(benchmark, item_col, text_col):
        found = scratch.save(_pass(index, block), "hits", append=passes > 0)
        passes += 1
    if passes > 1:
        found = scratch.save(_merged(found), "merged")
    each = index.select("segment", F.posexplode(F.arrays_zip("ids", "keys", "n_words")).alias("place", "d"))
    none = lambda name: F.coalesce(name, F.array().cast(found.schema[name].dataType)).alias(name)
    return each.join(found, ["segment", "place"], "left").select(
        F.col("d.ids").alias("id"), F.col("d.keys").alias("key"), F.col("d.n_words").alias("n_words"), none("hit_from"), none("hit_to"), none("items")
    )


def proximity_matches(index: DataFrame, benchmark: DataFrame, span: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item, word_from, word_to): stretches of at most `span` words that hold all words of an item, in any order.

    A block's words are looked up together, and only items whose words a segment all has are looked for in it.
    """
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("item", T.StringType()), T.StructField("word_from", T.LongType()), T.StructField("word_to", T.LongType())])
    scratch, passes = Scratch(index.sparkSession, "proximity"), 0
    for block in item_blocks(benchmark, item_col, text_col, pieces=False):

        def run(batches: Iterator[pa.RecordBatch], items=block) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row)
                    place = segment.lookup(items.words)
                    here = np.flatnonzero(np.minimum.reduceat(place, items.starts[:-1]) >= 0) if len(place) else []
                    near = lambda i: segment.near(place[items.starts[i] : items.starts[i + 1]], span)  # noqa: B023, E731
                    found = [(segment.ids[d], items.names[i], a, b) for i in here for d, a, b in near(i)]
                    columns = list(zip(*found, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], names=schema.names)

        out = scratch.save(index.mapInArrow(run, schema), "near", append=passes > 0)
        passes += 1
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """phrase_matches over a stored index of the documents, with n_hit and contaminated."""
    index = Scratch(docs.sparkSession, "postings").save(build_index(docs, id_col, text_col), "segments")
    found = phrase_matches(index, benchmark, item_col, item_text_col)
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda a, b: a - b), F.lit(0).cast("long"), lambda x, y: x + y)
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns. Rows are found again by id and text."""
    scratch = Scratch(docs.sparkSession, "clean")
    bad = scratch.save(contamination(docs, benchmark, id_col, text_col).filter("contaminated").select("id", "key").distinct(), "bad")
    same = [docs[id_col].eqNullSafe(bad["id"]), F.xxhash64(docs[text_col]) == bad["key"]]
    return docs.join(bad, same, "left_anti")
