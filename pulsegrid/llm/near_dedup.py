"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the hashes of its distinct runs of five words. Two permutations
make all coordinates of its signature: the first scatters the set over a domain of
2^20 places; the second, shifted circularly by 0, 1, 2, ... places, gives each
coordinate's values, of which the least over the set is kept. Six coordinates make a
band, 40 bands a signature, so two sets with a Jaccard similarity of 0.85 meet in no
band with a probability of (1 - 0.85^6)^40, about 6e-9; at 0.8 it is 5e-6. Lower
similarities than 0.8 are refused.

Documents with the same set are one class, and only classes are compared. No pairs are
listed within a bucket. Instead:

1. Uniqueness bound. A shingle that no other class in any bucket has cannot be shared.
   With v shared shingles left of n, and a similarity of s per cent wanted, a class can
   be linked with nothing if 100 v < s n, and two classes only if
   (100 + s) min(v1, v2) >= s (n1 + n2). Both follow from the definition, so no link is
   lost, and most members of a large bucket of loosely related texts leave here.
2. Stars. In each bucket all members are compared with one hub, the member with the
   largest share of shared shingles. Verified links are contracted to components.
3. The rest. A bucket whose members are still in different components has one component
   that most of its members are in. Only the others, where they pass the bound, are
   compared, with the members that are not in their own component, in the first bucket
   a pair shares. The largest component's members never meet each other, so a bucket
   of thousands and an outsider takes thousands of comparisons, not their square.

A run of words is known by a digest of 128 bits that different runs can't be made to
share. Its first half serves for signatures, bounds and a first look at a pair; classes are equal, and links
confirmed on the full sets, by whole digests. The sets are made anew from the texts of
the classes in step 1; a bitmap of fixed size of their keys lets other rows go before
texts are shuffled.

Nulls and texts without words have an empty set, are linked with nothing and keep their
own id as component. Null ids never win over others. Rows that repeat fall into one
class. An empty table gives an empty result. `drop_near_duplicates` passes all columns
through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, as_bytes, chunks, enter
from pulsegrid.llm.components import components
from pulsegrid.llm.words import SPACES, mixed, shingle_set, word_digests

WORDS = 5
SIMILARITY = 85  # per cent, unless a call says otherwise
LEAST_SIMILARITY = 80
BANDS, ROWS = 40, 6
DOMAIN_BITS = 20
SEED = 4_051
CHUNK_BYTES = 4 << 20
#: Bits of the bitmap of wanted keys, 8 MB whatever the number of rows; more keys than that let more rows pass.
FILTER_BITS = 26


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the shifted one as a view whose row x holds its values at x, x + 1, ..."""
    rng = np.random.default_rng(SEED)
    size, width = 1 << DOMAIN_BITS, BANDS * ROWS
    scatter = rng.permutation(size).astype(np.int64)
    shifted = rng.permutation(size).astype(np.uint32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([shifted, shifted[: width - 1]]), width)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate over a set that is not empty."""
    scatter, shifted = _permutations()
    places = scatter[(shingles >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)]
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 256):
        np.minimum(least, shifted[places[at : at + 256]].min(axis=0), out=least)
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return h.view(np.int64)


def _set(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return shingle_set(word_digests(text or b"", SPACES), WORDS)


def _name(shingles: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(b"".join(half.tobytes() for half in shingles), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to (id, key, n_shingles, name, buckets)."""
    enter("near_dedup", _permutations.cache_clear)
    for whole in batches:
        for batch in chunks(whole, 2, CHUNK_BYTES):
            sizes, names, keys = [], [], []
            for text in as_bytes(batch.column(2)):
                s = _set(text)
                sizes.append(len(s[0]))
                names.append(_name(s) if len(s[0]) else None)
                keys.append(buckets(signature(s[0])) if len(s[0]) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "key", "n", "name", "buckets"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, name, text) to (node, shingles, second): the halves of the digests, for rows whose text has the named set."""
    enter("near_dedup", _permutations.cache_clear)
    for whole in batches:
        for batch in chunks(whole, 2, CHUNK_BYTES):
            nodes, sets, seconds = [], [], []
            for node, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                s = _set(text)
                if len(s[0]) and _name(s) == name:
                    nodes.append(node)
                    sets.append(s[0].view(np.int64))
                    seconds.append(s[1].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (sets, seconds))], names=["node", "shingles", "second"])


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of (a, b) whose full sets are similar enough.

    `b` can be in very many pairs. So pairs get the set of `a` first: rows of a hot `b`
    are then as large as they are many, and Spark splits them by size.
    """
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"), F.col("second").alias(f"{side}_second"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    # Halves that occur twice in a set count once here, so this may be less than what whole digests share, by what the sets' sizes are more.
    more = F.size("a_set") - F.size(F.array_distinct("a_set"))
    alike = both.filter(100 * (shared + more) >= similarity * (F.size("a_set") + F.size("b_set") - shared - more))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup", _permutations.cache_clear)
        for batch in batches:
            halves = [[x.values.to_numpy() for x in batch.column(name)] for name in ("a_set", "a_second", "b_set", "b_second")]
            good = np.array([links(*four, similarity) for four in zip(*halves, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(side).filter(pa.array(good, pa.bool_())) for side in ("a", "b")], names=["a", "b"])

    return alike.mapInArrow(confirmed, "a long, b long")


def links(a: np.ndarray, a_second: np.ndarray, b: np.ndarray, b_second: np.ndarray, similarity: int) -> bool:
    """Whether two sets, as halves of digests, are similar enough."""
    both = np.concatenate([a, b]), np.concatenate([a_second, b_second])
    order = np.lexsort(both[::-1])
    first, second = both[0][order], both[1][order]
    shared = int(np.count_nonzero((first[1:] == first[:-1]) & (second[1:] == second[:-1])))
    return 100 * shared >= similarity * (len(a) + len(b) - shared)


def _could_link(n1, v1, n2, v2, similarity: int):
    """The bound on two classes' sizes and shared shingles."""
    return (100 + similarity) * F.least(v1, v2) >= similarity * (n1 + n2)


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose `key` is among `keys`, and a few more: those whose bit in a bitmap of the keys is set.

    The bitmap has 2^FILTER_BITS bits in parts of 4 KB, so it is small enough to broadcast whatever the tables' sizes.
    """
    bit = F.pmod(F.col("key"), F.lit(1 << FILTER_BITS))
    part, at = F.shiftright(bit, 15).cast("int"), F.pmod(bit, F.lit(1 << 15))
    bitmap = keys.select(part.alias("part"), at.alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return rows.withColumn("part", part).join(F.broadcast(bitmap), "part").filter(there).select(*rows.columns)


def _rest(named: DataFrame, alive: DataFrame, scratch: Scratch, similarity: int) -> DataFrame:
    """(a, b) of one bucket that are under different labels and could be linked, from (bucket, node, n, v, label)."""
    each = named.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    most = each.groupBy("bucket").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("most"), F.count("*").alias("labels"))
    mixed_up = scratch.save(most.filter("labels > 1").select("bucket", "most"), "mixed")
    open_ = scratch.save(named.join(mixed_up, "bucket").join(alive.select("node", "buckets"), "node"), "open")
    x, y = open_.filter("label <> most").alias("x"), open_.alias("y")
    apart = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
        & _could_link(F.col("x.n"), F.col("x.v"), F.col("y.n"), F.col("y.v"), similarity)
        & (F.get(F.array_intersect("x.buckets", "y.buckets"), F.lit(0)) == F.col("x.bucket"))
    )
    # The outsider can be in as many pairs as its bucket has members.
    return x.join(y, apart).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))


def _labels(classes: DataFrame, rows: DataFrame, scratch: Scratch, similarity: int) -> DataFrame:
    """(node, label) of the classes that are linked with others."""
    exploded = classes.select("node", F.explode("buckets").alias("bucket"))
    # Keys alone are counted first; most buckets have one member and go no further.
    shared = scratch.save(exploded.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket"), "shared")
    members = scratch.save(exploded.join(shared, "bucket"), "members")
    involved = classes.join(members.select("node").distinct(), "node").select("node", "name", "n", "buckets", F.col("least").alias("id"), "key")
    involved = scratch.save(involved, "involved")

    some = _with_keys(rows, involved)
    on = [some["key"] == involved["key"], some["id"].eqNullSafe(involved["id"])]
    texts = some.join(involved.select("key", "id", "node", "name"), on).select("node", "name", "text")
    sets = scratch.save(texts.mapInArrow(_sets, "node long, shingles array<long>, second array<long>").dropDuplicates(["node"]), "sets")

    # A shingle counted once has the least of its nodes as its only one.
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    alone = alone.filter("c = 1").groupBy("node").agg(F.count("*").alias("u"))
    alive = involved.select("node", "n", "buckets").join(alone, "node", "left").withColumn("v", F.col("n") - F.coalesce("u", F.lit(0)))
    alive = scratch.save(alive.filter(f"100 * v >= {similarity} * n").select("node", "n", "v", "buckets"), "alive")
    sets = scratch.save(sets.join(alive.select("node"), "node", "left_semi"), "alive_sets")
    members = scratch.save(members.join(alive.select("node", "n", "v"), "node"), "alive_members")
    scratch.drop("sets", "members", "shared", "involved")

    best = F.max(F.struct((F.col("v") / F.col("n")).alias("share"), (-F.col("node")).alias("order"), "n", "v")).alias("h")
    hubs = scratch.save(members.groupBy("bucket").agg(best, F.count("*").alias("m")).filter("m > 1").select("bucket", (-F.col("h.order")).alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.v").alias("hub_v")), "hubs")
    spokes = members.join(hubs, "bucket").filter((F.col("node") != F.col("hub")) & _could_link(F.col("n"), F.col("v"), F.col("hub_n"), F.col("hub_v"), similarity))
    pairs = scratch.save(spokes.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "spokes")
    links = scratch.save(_linked(pairs, sets, similarity), "links")
    first = scratch.save(components(links, scratch, "first"), "first")

    # What is left: members of one bucket under different labels.
    named = members.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.save(named.select("bucket", "node", "n", "v", "label"), "named")
    rest = scratch.save(_rest(named, alive, scratch, similarity), "rest")
    links = scratch.save(links.unionByName(_linked(rest, sets, similarity)), "all_links")
    return components(links, scratch, "second")


def _grouped(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, name) of every row, and (name, component, winner) of every class with words."""
    if not LEAST_SIMILARITY <= similarity <= 100:
        raise ValueError(f"a similarity is a percentage, {LEAST_SIMILARITY} at least")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = scratch.save(rows.mapInArrow(_signatures, f"id {kind}, key long, n long, name binary, buckets array<long>"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "key")).alias("first")
    classes = signed.filter("n > 0").groupBy("name").agg(first, F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "name", "n", "buckets", F.col("first.id").alias("least"), F.col("first.key").alias("key"))
    classes = scratch.save(classes, "classes")
    labels = scratch.save(_labels(classes, rows, scratch, similarity), "labels")
    linked = classes.select("node", "name", "least", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    winner = F.min(F.struct(F.col("least").isNull().alias("null_id"), F.col("least").alias("id"), "key")).alias("winner")
    named = linked.groupBy("label").agg(winner)
    of = linked.join(scratch.save(named, "components"), "label").select("name", F.col("winner.id").alias("component"), "winner")
    return signed.select("id", "key", "n", "name"), scratch.save(of, "of")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (its id is component_id)."""
    signed, of = _grouped(docs, Scratch(docs.sparkSession, "near"), id_col, text_col, similarity)
    out = signed.join(of.select("name", "component"), "name", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns: one of each component, and all without words."""
    scratch = Scratch(docs.sparkSession, "near")
    _, of = _grouped(docs, scratch, id_col, text_col, similarity)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column of the input clashes
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).withColumn("key", F.xxhash64(names[text_col]))
    back = [F.col(n).alias(c) for c, n in names.items()]
    has_words = F.coalesce(F.col(names[text_col]).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = scratch.save(of.select("winner.key", "winner.id").distinct(), "stay")
    on = [rows["key"] == stay["key"], rows[names[id_col]].eqNullSafe(stay["id"])]
    kept = scratch.save(rows.filter(has_words).join(stay, on, "left_semi"), "rows")
    # Rows that repeat both id and text have all stayed; one is enough.
    again = kept.groupBy("key", names[id_col]).count().filter("count > 1").select(F.col("key"), F.col(names[id_col]).alias("id"))
    out = kept
    if not again.isEmpty():
        same = [kept["key"] == again["key"], kept[names[id_col]].eqNullSafe(again["id"])]
        out = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["key", names[id_col]]))
    return out.select(*back).unionByName(rows.filter(~has_words).select(*back))
