"""Phrase collocations by SON partitioning: local mining, union, one exact global count.

A text is split into pieces at sentence signs and line ends, a piece into words at
blanks and tabs; only A-Z are put in lower case. Phrases are runs of one to LONGEST
words of a piece, and all counts are those of one language.

1. Local mining. A task takes its texts in shards of about SHARD_BYTES and mines each
   completely, level by level: a run is looked at where both runs that are one word
   shorter are frequent. In a shard with a share w of all bytes, the wanted support s is
   lowered to t = ceil(w s / SLACK). What a phrase can have in shards where it isn't
   frequent, t - 1 each, is less than s / SLACK in all, so a phrase with s occurrences
   is frequent in some shard.
2. Union. A phrase's local counts and what the other shards can add bound its count
   from above, and only phrases whose bound reaches s are candidates. With SLACK 1, the
   usual choice, the bound would let nearly everything pass. Phrases are known by their
   places in a bitmap of 2^FILTER_BITS bits here, a few bytes each, and each task adds
   up some of its places.
3. Global count. The candidates go to the tasks as that bitmap, whatever their number.
   Another run over the texts counts every run of words whose bits are set, in each
   shard, and the counts are added up by the phrases themselves, in tasks and then over all. Phrases that share a
   place can make each other a candidate; that costs a count that is dropped in the end, and changes
   no result.

Steps 1 and 2 are taken in ROUNDS, for words, then for pairs of the words that are left,
and then for the longer phrases of the pairs that are left. So where there are so
many shards that t is 1, a shard doesn't name all its phrases.

Scores are taken from exact decimals of 38 digits. A language's list is cut in two
steps, first in LIST_PARTS parts of the language, so no task sorts a whole language.

A null text has no words, a null language is `und`. Repeated rows count each time. Ids
are not read. An empty table gives an empty result. Columns beside text and language
are not read, whatever their names. A text longer than a shard is cut between pieces; a
shard is as large as the longest piece, if that is larger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import LOWER, Scratch, as_bytes, enter
from pulsegrid.llm.words import mixed, separators

SUPPORT = 100
LONGEST = 5
MOST = 2000
UNKNOWN = "und"
SHARD_BYTES = 12 << 20
SLACK = 8
#: The sizes of phrases that are mined together, from the first to the last.
ROUNDS = ((1, 1), (2, 2), (3, LONGEST))
#: Rows of counts that a task adds up before they leave it.
COMBINED = 1 << 19
#: Bits of the candidates' bitmap: 16 MB, whatever the number of candidates.
FILTER_BITS = 27
#: Parts in which a language's list is cut first, and over which its word count is spread for joining.
LIST_PARTS = 64

#: What ends a piece, and what stands between words.
PIECES = r"[.,;:!?\x0A-\x0D]"
STOPS = separators((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
BLANKS = STOPS | separators((0x09, 0x09), (0x20, 0x20))

#: Places are shared out in parts of so many; a row of a shard holds those of one part, in 2 and 4 bytes each.
PART_BITS = 15
MINED = "part int, places binary, extra binary, unseen long"
COUNTED = "lang string, phrase string, size int, n long"


class Shard:
    """The words of some texts, as numbers that stand for (language, word)."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        self.weight = sum(len(t) for _, t in texts)
        self.langs = sorted({lang for lang, _ in texts})
        data = b"\n".join(t for _, t in texts).translate(LOWER)
        chars = np.frombuffer(data, dtype=np.uint8)
        inside = np.zeros(len(chars) + 2, dtype=bool)
        np.logical_not(BLANKS[chars], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        #: The piece that each word lies in; a text's end is a piece's end.
        self.piece = np.searchsorted(np.flatnonzero(STOPS[chars]), starts).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars[inside[1:-1]])])
        words = words.dictionary_encode()
        number = {lang: i for i, lang in enumerate(self.langs)}
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in texts])])[:-1]
        of_text = np.diff(np.searchsorted(starts, firsts), append=len(starts))
        lang = np.repeat(np.array([number[x] for x, _ in texts], dtype=np.int64), of_text)
        self.words_of = np.bincount(lang, minlength=len(self.langs))
        kinds = max(len(words.dictionary), 1)
        tokens, token = np.unique(lang * kinds + words.indices.to_numpy(), return_inverse=True)
        self.token = token.astype(np.int32)
        self.lang, self.text = tokens // kinds, words.dictionary.take(pa.array(tokens % kinds))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each language and for each token's word."""
        of = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")
        return np.array([of(x.encode()) for x in self.langs], dtype=np.uint64), np.array([of(x) for x in self.text.to_pylist()], dtype=np.uint64)

    def frequent(self, least: int, seen: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, first places, counts, bits in the bitmap) of the runs of words that occur `least` times; of those only that `seen` keeps, by size and bits."""
        lang_hash, word_hash = self.hashes()
        n = len(self.token)
        counts = np.bincount(self.token, minlength=len(self.text))
        places = np.zeros(len(self.text), dtype=np.int32)
        places[self.token[::-1]] = np.arange(n, dtype=np.int32)[::-1]
        bits = self.bits(places, 1, lang_hash, word_hash)
        good = counts >= least
        if seen:
            good &= seen(1, bits)
        now = np.full(n + 1, -1, dtype=np.int32)  # number of the kept run that begins at each place, -1: none
        now[:n] = np.where(good, np.cumsum(good) - 1, -1)[self.token]
        if not good.any():
            return
        yield 1, places[good], counts[good], bits[good]
        here = np.arange(n, dtype=np.int32)
        for size in range(2, LONGEST + 1):
            here = here[here + size - 1 < n]
            here = here[(now[here] >= 0) & (now[here + 1] >= 0)]
            here = here[self.piece[here] == self.piece[here + size - 1]]
            if seen and len(here):
                here = here[seen(size, self.bits(here, size, lang_hash, word_hash))]
            _, first, which, counts = np.unique(now[here].astype(np.int64) * len(self.text) + self.token[here + size - 1], return_index=True, return_inverse=True, return_counts=True)
            kept = np.cumsum(counts >= least) - 1
            kept[counts < least] = -1
            now.fill(-1)
            now[here] = kept[which]
            places = here[first[counts >= least]]
            if not len(places):
                return
            yield size, places, counts[counts >= least], self.bits(places, size, lang_hash, word_hash)

    def bits(self, places: np.ndarray, size: int, lang_hash: np.ndarray, word_hash: np.ndarray) -> np.ndarray:
        """Where in the bitmap each run stands."""
        h = lang_hash[self.lang[self.token[places]]]
        for i in range(size):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word_hash[self.token[places + i]])
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def phrases(self, places: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
        """The language and the text of each run."""
        tokens = self.token[places]
        words = [self.text.take(pa.array(self.token[places + i])) for i in range(size)]
        text = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if size > 1 else words[0]
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[tokens])), text.cast(pa.binary()).cast(pa.string())


_STOP = re.compile(PIECES.encode())


def _cut(text: bytes) -> Iterator[bytes]:
    """The text, one longer than a shard cut between pieces."""
    while len(text) > SHARD_BYTES:
        stop = _STOP.search(text, SHARD_BYTES)
        if not stop:
            break
        yield text[: stop.start()]
        text = text[stop.end() :]
    yield text


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards of a task's rows (language, text)."""
    texts, size = [], 0
    for batch in batches:
        for lang, whole in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            for text in _cut(whole):
                if texts and size + len(text) > SHARD_BYTES:
                    yield Shard(texts)
                    texts, size = [], 0
                texts.append((lang, text))
                size += len(text)
    if size:
        yield Shard(texts)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))


def _tester(sent: Broadcast) -> Callable[[np.ndarray], np.ndarray]:
    """Whether places are set in a bitmap that was sent."""
    table = np.frombuffer(sent.value, dtype=np.uint8)
    return lambda place: (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def mine_shards(rows: DataFrame, total_bytes: int, support: int = SUPPORT, sizes: tuple[int, int] = (1, LONGEST), shorter: Broadcast | None = None) -> DataFrame:
    """MINED of every shard's locally frequent phrases of some sizes, made of the candidates among the shorter ones.

    `extra` is by how much the local count passes the most that the shard could have
    had unseen, t - 1. A row without places holds a shard's t - 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("collocations")
        kept = _tester(shorter) if shorter else None
        seen = (lambda size, place: kept(place) if size < sizes[0] else np.ones(len(place), dtype=bool)) if kept else None
        for shard in shards(batches):
            least = local_support(shard.weight, total_bytes, support)
            place, extra = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for size, _, counts, bits in shard.frequent(least, seen):
                if size >= sizes[0]:
                    place.append(bits)
                    extra.append(np.minimum(counts - (least - 1), support))
                if size == sizes[1]:
                    break
            yield _packed(np.concatenate(place), np.concatenate(extra), least - 1)

    return rows.mapInArrow(run, MINED)


def local_support(weight: int, total: int, support: int) -> int:
    """What a phrase must have in a shard to be frequent there."""
    return max(1, -(-support * weight // (SLACK * total)))


def _packed(place: np.ndarray, extra: np.ndarray, unseen: int) -> pa.RecordBatch:
    """A shard's rows of MINED."""
    order = np.argsort(place)
    place, extra = place[order], extra[order].astype(np.uint32)
    parts, first = np.unique(place >> PART_BITS, return_index=True)
    edges = [*first.tolist(), len(place)]
    at = (place & ((1 << PART_BITS) - 1)).astype(np.uint16)
    cut = lambda x: [None, *(x[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False))]
    columns = [pa.array([None, *parts.tolist()], pa.int32()), pa.array(cut(at), pa.binary()), pa.array(cut(extra), pa.binary()), pa.array([unseen] + [None] * len(parts), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "places", "extra", "unseen"])


def union(mined: DataFrame, support: int = SUPPORT) -> np.ndarray:
    """The candidates as a bitmap: what was mined, as far as the counts at its place can reach the support."""
    unseen = mined.agg(F.sum("unseen").alias("n")).head()["n"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("collocations")
        part, total = None, np.zeros(1 << PART_BITS, dtype=np.int64)
        found = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total + unseen >= support, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])
        for batch in batches:
            for p, places, extra in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if part is not None:
                        yield found()
                    part = p
                    total.fill(0)
                np.add.at(total, np.frombuffer(places, dtype=np.uint16), np.frombuffer(extra, dtype=np.uint32))
        if part is not None:
            yield found()

    parts = mined.filter("part IS NOT NULL").select("part", "places", "extra").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, bits binary")
    out, size = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8), 1 << (PART_BITS - 3)
    for row in parts.collect():  # at most 2^(FILTER_BITS - PART_BITS) rows of 4 KB
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def count_candidates(rows: DataFrame, bits: Broadcast, support: int = SUPPORT) -> DataFrame:
    """(lang, phrase, size, n) of the runs of words whose bits are set and that occur `support` times; with size 0 and no phrase, a language's number of words.

    Counts leave a task by parts of the bitmap, a row for each, and the parts are added up one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("collocations")
        kept = _tester(bits)
        seen = lambda size, place: kept(place)
        held: list[pa.Table] = []
        for shard in shards(batches):
            held += _counted(shard, seen)
            if sum(len(x) for x in held) >= COMBINED:
                yield _by_part(_added(held))
                held = []
        if held:
            yield _by_part(_added(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("collocations")
        yield from _sums(batches, support)

    parts = rows.mapInArrow(run, "part int, lang array<string>, phrase array<string>, size array<int>, n array<long>")
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(add, COUNTED)


#: Columns of a task's counts.
COUNTS = ["lang", "phrase", "size", "n"]
KEYS = ["part", "lang", "phrase", "size"]


def _counted(shard: Shard, seen: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[pa.Table]:
    """(part, lang, phrase, size, n) of one shard."""
    table = lambda part, langs, phrases, size, n: pa.table({"part": pa.array(part, pa.int32()), "lang": langs, "phrase": phrases, "size": pa.array(np.full(len(n), size), pa.int32()), "n": pa.array(n, pa.int64())})
    yield table(np.zeros(len(shard.langs)), pa.array(shard.langs, pa.string()), pa.array([""] * len(shard.langs), pa.string()), 0, shard.words_of)
    for size, places, counts, bits in shard.frequent(1, seen):
        for at in range(0, len(places), 1 << 18):
            some = slice(at, at + (1 << 18))
            yield table(bits[some] >> PART_BITS, *shard.phrases(places[some], size), size, counts[some])


def _added(held: list[pa.Table]) -> pa.Table:
    """Counts of one phrase added up."""
    found = pa.concat_tables(held).group_by(KEYS).aggregate([("n", "sum")])
    return found.select([*KEYS, "n_sum"]).rename_columns([*KEYS, "n"]).combine_chunks()


def _by_part(table: pa.Table) -> pa.RecordBatch:
    """A row for each part, with lists of what is in it."""
    table = table.sort_by("part").combine_chunks()
    parts, first = np.unique(table["part"].to_numpy(), return_index=True)
    offsets = pa.array(np.append(first, len(table)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, table[c].combine_chunks()) for c in COUNTS]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *lists], names=["part", *COUNTS])


def _flat(batch: pa.RecordBatch) -> pa.Table:
    """The rows of such lists."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy()
    part = pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int32())
    return pa.table({"part": part} | {c: batch.column(i + 1).flatten() for i, c in enumerate(COUNTS)})


def frequent_phrases(docs: DataFrame, scratch: Scratch, support: int = SUPPORT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, size, n), stored: all phrases of 1 to LONGEST words that occur `support` times in a language, counted exactly, and with size 0 each language's number of words."""
    rows = _rows(docs, text_col, lang_col)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    send = lambda bits: docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for sizes in ROUNDS:
        mined = scratch.save(mine_shards(rows, max(total, 1), support, sizes, send(bits)), f"mined-{sizes[0]}")
        bits |= union(mined, support)
        scratch.drop(f"mined-{sizes[0]}")
    return scratch.save(count_candidates(rows, send(bits), support), "frequent")


def _sums(batches: Iterator[pa.RecordBatch], support: int) -> Iterator[pa.RecordBatch]:
    """COUNTED that reach the support, of lists in the order of their parts; about COMBINED rows and the phrases of one part are held."""
    held: list[pa.Table] = []
    good = (pc.field("n") >= support) | (pc.field("size") == 0)
    for batch in batches:
        held.append(_flat(batch))
        if sum(len(x) for x in held) >= COMBINED:
            # The last part may go on in the next batch.
            table, last = _added(held), batch.column(0)[-1]
            yield from table.filter((pc.field("part") != last) & good).select(COUNTS).to_batches()
            held = [table.filter(pc.field("part") == last)]
    if held:
        yield from _added(held).filter(good).select(COUNTS).to_batches()


def first_of_each(rows: DataFrame, most: int, key: str, *order: Column) -> DataFrame:
    """The first rows of each key with their rank, first cut within LIST_PARTS parts of a key."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(LIST_PARTS))
    some = rows.withColumn("part", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))).filter(F.col("rank") <= most)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `most` best collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = frequent_phrases(docs, scratch, support, text_col, lang_col)
    phrases = counts.filter("size > 0").select("lang", "phrase", "size", F.col("n").alias("f"))
    several = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # A phrase is dropped for a longer one that holds it as often as it occurs.
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda p: F.struct(p.alias("p"), k.alias("k"))))))
    inner = several.filter("size > 2").select("lang", "a", "w", at.alias("at")).select("lang", "a", F.array_join(F.slice("w", F.col("at.p"), F.col("at.k")), " ").alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = several.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a").drop("longer")

    cuts = left.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    head, tail = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", head.alias("head"), tail.alias("tail"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # A language can hold most phrases, so its word count is repeated and each phrase takes one of the copies.
    totals = counts.filter("size = 0").select("lang", F.col("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LIST_PARTS - 1).cast("long"))).alias("part"))
    cuts = cuts.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(LIST_PARTS))).join(totals, ["lang", "part"])
    whole = lambda name: f"cast({name} AS decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"({whole('a')} * {whole('n')} * 1000) div ({whole('l')} * {whole('r')})"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    out = first_of_each(scored, most, "lang", F.desc("score"), F.desc("a"), F.asc("phrase"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same rows by counting every phrase."""
    runs = " UNION ALL ".join(f"SELECT lang, list_aggregate(w[p : p + {k - 1}], 'string_agg', ' ') AS phrase, {k} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS p FROM pieces WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
    return rf"""
WITH texts AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PIECES}')) AS piece FROM documents
), pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM texts
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), counts AS (
    SELECT lang, phrase, size, count(*) AS f FROM ({runs}) GROUP BY lang, phrase, size HAVING count(*) >= {SUPPORT}
), candidates AS (
    SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1
), inner_runs AS (
    SELECT lang, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS p FROM (SELECT *, unnest(range(2, size)) AS k FROM candidates WHERE size > 2)) GROUP BY 1, 2
), kept AS (
    SELECT lang, phrase, size, a, w FROM candidates LEFT JOIN inner_runs USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
    SELECT lang, phrase, a, k, list_aggregate(w[1:k], 'string_agg', ' ') AS head, list_aggregate(w[k + 1:size], 'string_agg', ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, CAST((CAST(a AS HUGEINT) * n * 1000) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head JOIN counts y ON y.lang = cuts.lang AND y.phrase = tail JOIN totals ON totals.lang = cuts.lang
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {MOST}
"""
