"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of candidates are found in every text: assignments of a value to a
credential's name, access keys, and runs of hexadecimal digits. Each candidate's value
is hashed, and the hashes are aggregated over the whole corpus by distinct
repositories and owners. A value that more than MOST_OWNERS owners or more than
MOST_REPOSITORIES repositories carry is a copied example: nobody's working credential is
in so many places, even all of one owner's. Any other value that looks random is marked
as live.

Two kinds of spans are added by that verdict, over the value alone: `live` and
`example`. The spans of the three base kinds always stay.

Null texts count as empty and have no spans. A null owner or repository counts as one
unknown owner or repository. Rows that repeat are scanned each; they add no owners. An
empty table gives an empty result. Only the named columns are read, so others can have
any names. A value that a large part of all candidates has meets its verdict without a
shuffle, any other by its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, bound, totals_before

#: The kinds in their order, their patterns and least lengths. Within a
#: run of one class of characters, the least length can stand in the pattern itself.
KINDS = ("assign", "access", "hex", "live", "example")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

#: A value that more owners, or more repositories of whatever owners, than these carry is an example.
MOST_OWNERS, MOST_REPOSITORIES = 1, 100
#: Values with more than this part of all candidates meet their verdict by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Live-looking: at least so long, with so many different characters, and both letters and digits.
LIVE_LENGTH, LIVE_CHARACTERS = 16, 8


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, match) for the leftmost matches that do not overlap; code points, end exclusive.

    What stands between matches and the matches themselves add up to each match's
    start. A text is matched and split once, and the sums take time in proportion.
    """

    def placed(hits: Column, gaps: Column) -> Column:
        before = totals_before(F.transform(hits, lambda match, i: F.get(gaps, i) + F.length(match)))

        def spans(at: Column) -> Column:
            def span(match: Column, i: Column) -> Column:
                start = (F.get(at, i) + F.get(gaps, i)).cast("int")
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("end"), match.alias("match"))

            return F.transform(hits, span)

        return bound(before, spans)

    gaps = F.transform(F.split(text, pattern), F.length)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    found = lambda hits: F.when(F.size(hits) > 0, bound(gaps, lambda g: placed(hits, g))).otherwise(none)
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds, by start and then kind, each with its value and the value's start."""
    value = lambda s: F.regexp_extract(s["match"], ASSIGN, 2)
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(value(s)) >= LEAST_VALUE)

    def with_value(s: Column, v: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value"))

    return F.array_sort(
        F.concat(
            F.transform(assign, lambda s: with_value(s, value(s))),
            F.transform(spans_of(text, ACCESS, 1), lambda s: with_value(s, s["match"])),
            F.transform(spans_of(text, HEX, 2), lambda s: with_value(s, s["match"])),
        )
    )


def live_looking(value: Column) -> Column:
    """Whether a value could be a working credential: long, varied, letters and digits."""
    return (
        (F.length(value) >= LIVE_LENGTH)
        & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
        & value.rlike("[A-Za-z]")
        & value.rlike("[0-9]")
        & ~F.lower(value).rlike("example|changeme|placeholder|your[_-]|xxxx")
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each hash, from (hash, owner, repository).

    Counted in two steps, distinct triples first, so a hash that a third of all rows
    carry is combined inside each task before it is shuffled.
    """
    triples = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"))
    owners = triples.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("uses").alias("n_uses"))


def with_ownership(candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """candidates.join(owned, "hash"), without moving the candidates of a hot hash.

    All uses add up to the number of candidates, so fewer than HOT_SHARE hashes can have
    more than that share of them, at any size of the corpus.
    """
    share = F.lit((owned.agg(F.sum("n_uses").alias("n")).head()["n"] or 0) // HOT_SHARE)
    hot, rest = owned.filter((F.col("n_uses") > share) & (F.col("n_uses") > 1)), owned.filter((F.col("n_uses") <= share) | (F.col("n_uses") <= 1))
    cold = candidates.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(rest, "hash")
    return candidates.join(F.broadcast(hot), "hash").unionByName(cold)


def scan_secrets(
    docs: DataFrame,
    owner_col: str,
    repository_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """One row per document: id, counts by kind, n_live, n_example, and `found`.

    `found` is an array of (start, kind, end, value_hash, n_owners, n_repositories) by
    start and kind, kind being a place in KINDS.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\0unknown")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("\0unknown")).alias("repository"),
        base_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Without the texts the table is small; it is read three times and fixes the row numbers.
    scanned = scratch.save(scanned, "scanned")
    each = scanned.filter(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s"))
    each = each.select(
        "row",
        "owner",
        "repository",
        F.col("s.start").alias("start"),
        F.col("s.kind").alias("kind"),
        F.col("s.end").alias("end"),
        # An assignment ends with its value or the value's quotes; the value ends the match.
        (F.col("s.end") - F.length("s.value")).alias("value_start"),
        F.sha2(F.col("s.value").cast("binary"), 256).alias("hash"),
        live_looking(F.col("s.value")).alias("looks_live"),
    )
    owned = scratch.save(ownership(each), "owned")
    copied = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    judged = with_ownership(each, owned).withColumn("verdict", F.when(copied, KINDS.index("example")).when(F.col("looks_live"), KINDS.index("live")))
    of = lambda start, kind: F.struct(start.alias("start"), kind.cast("int").alias("kind"), F.col("end"), F.col("hash"), F.col("n_owners"), F.col("n_repositories"))
    both = F.array(of(F.col("start"), F.col("kind")), F.when(F.col("verdict").isNotNull(), of(F.col("value_start"), F.col("verdict"))))
    # One value can be found by two kinds; its verdict is one span. A set of spans is hashed, distinct elements of an array are compared in pairs.
    spans = judged.select("row", F.explode(F.array_compact(both)).alias("span"))
    found = spans.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    out = scanned.select("id", "row").join(found, "row", "left").withColumn("found", F.coalesce("found", none))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return out.select(F.col("id").alias(id_col), *(count(k).alias(f"n_{k}") for k in KINDS), "found")


def span_text(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the given kinds, comma-joined."""
    wanted = [KINDS.index(k) for k in kinds]
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.filter(found, lambda s: s["kind"].isin(wanted)), one), ",")
