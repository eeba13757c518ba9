"""Licence scans by canonical digests.

A text is brought to a canonical form: lines that state a copyright gone, lower case,
every run of other signs than letters and digits as one space, and equivalent spellings
as one, in an entire text also where a line ends inside of one. Running text that only
begins a line with the word copyright stays. The digest of an entire canonical text is joined with the digests of
known licences; so is that of each entire line, which finds one-line notices. Nothing
is compared but digests of entire units, so a licence inside a longer line isn't found.

The known licences are a table of any size. Their digests are stored and counted: up to
MOST_BROADCAST of them go to every task, so that only hits are shuffled and gathered per
document; more meet the units by an equi-join, with the same result. The built-in list has entire texts of
MIT, ISC, BSD and the files in the folder texts; AGPL and CC licences other than CC0
are known by one-line notices only.

Null texts count as empty, and empty units match nothing. Rows are found again by id
and a hash of the text; rows that repeat both have the same result, once for each row.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch
from pulsegrid.llm.licence_texts import END, HEADERS, LICENCES, SPELLINGS, entire_files, entire_texts

#: What follows the word where it is part of a sentence or a heading.
_SENTENCE = r"[ \t]+(?i:notices?|holders?|owners?|owned|laws?|treat(?:y|ies)|acts?|licen[cs]es?|statements?|interests?|protections?|permissions?|directives?|office|infringements?|rights?|status|disclaimers?|and|or|in|on|of|to|is|are|as|for|if|under|that|with)\b"
_RUNNING = rf"(?!{_SENTENCE})"
_YEAR = r"[^\n]*(?<!\d)(?:19|20)\d\d(?!\d)"
#: A line that states a copyright: by a year, a sign, a placeholder or a name after the word.
STATEMENT = (
    rf"(?m)^[ \t]*(?:(?i:copyright\b{_RUNNING}|\(c\)){_YEAR}|(?i:copyright[ \t:,]*(?:\(c\)|©|[<\[{{]))|(?i:\(c\)[ \t]*(?:copyright\b|[<\[{{]))|©"
    rf"|(?:Copyright|COPYRIGHT)\b{_RUNNING}[ \t:,]+(?:[Bb]y[ \t]+)?[A-Z]|(?i:all rights reserved)[.!]?[ \t]*$)[^\n]*$"
)
#: Digests that are broadcast, about 150 bytes each.
MOST_BROADCAST = 100_000
#: In lower case; line ends stay.
SIGNS = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"


def _words(text: Column) -> Column:
    """Lines of words in lower case, parted by one space, without those that state a copyright."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), STATEMENT, "")), SIGNS, " ")


def _spelt(words: Column) -> Column:
    for variant, to in SPELLINGS:
        words = F.replace(words, F.lit(variant), F.lit(to))
    return words


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends, words parted by one space; lines may have a space at either end."""
    return _spelt(_words(text))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return F.trim(_spelt(F.regexp_replace(_words(text), r"[ \n]+", " ")))


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text.cast("binary"), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text) of the built-in list."""
    return spark.createDataFrame(LICENCES + HEADERS + entire_texts(), "licence string, text string")


def scan_licences(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, licence (of the entire text, or null), notices (of entire lines, sorted), n_lines (lines that are notices)."""
    known = licences.select("licence", canonical(F.col("text")).alias("form")).filter("form <> ''").select("licence", digest(F.col("form")).alias("digest")).distinct()
    known = Scratch(docs.sparkSession, "licences").save(known, "known")
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    lines = F.split(canonical_lines(F.col("text")), r" *\n[ \n]*")
    lines = F.transform(lines, lambda x: F.struct(F.lit("line").alias("kind"), F.trim(x).alias("form")))
    whole = F.array(F.struct(F.lit("text").alias("kind"), canonical(F.col("text")).alias("form")))
    units = rows.select("id", "key", F.explode(F.concat(whole, lines)).alias("unit")).filter("unit.form <> ''")
    hits = units.select("id", "key", "unit.kind", digest(F.col("unit.form")).alias("digest")).join(known, "digest")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("licence"))
    # Rows that repeat add their lines up; the number of rows divides them again.
    found = hits.groupBy("id", "key").agg(
        F.min(of("text")).alias("licence"), F.array_sort(F.collect_set(of("line"))).alias("notices"), F.count(of("line")).alias("lines")
    )
    copies = rows.select("id", "key").groupBy("id", "key").agg(F.count("*").alias("copies"))
    same = lambda a, b: (a["key"] == b["key"]) & a["id"].eqNullSafe(b["id"])
    found = found.join(copies, same(found, copies)).select(found["id"].alias("hit_id"), found["key"].alias("hit_key"), "licence", "notices", (F.col("lines") / F.col("copies")).cast("long").alias("n_lines"))
    each = rows.select("id", "key")
    out = each.join(found, (each["key"] == found["hit_key"]) & each["id"].eqNullSafe(found["hit_id"]), "left")
    return out.select(F.col("id").alias(id_col), "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def oracle_sql() -> str:
    """The same over table documents, in DuckDB's SQL.

    Its patterns can't look ahead or behind. So a mark goes before the word copyright where a
    sentence follows it, and each line is then searched for one that starts a statement.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ends = r"[\r\x{85}\x{2028}\x{2029}]"  # where a line begins for Spark's patterns but not for these
    sentence = rf"(?i)(^|{ends})([ \t]*)(copyright)({_SENTENCE})"
    year = r"(?:19|20)[0-9][0-9](?:[^0-9]|$)"
    statement = (
        rf"(^|{ends})[ \t]*(?:(?i:copyright)\b.*[^0-9]{year}|(?i:\(c\))(?:.*[^0-9])?{year}|(?i:copyright)[ \t:,]*(?:\([cC]\)|©|[<\[{{])"
        rf"|(?i:\(c\))[ \t]*(?:(?i:copyright)\b|[<\[{{])|©|(?:Copyright|COPYRIGHT)\b[ \t:,]+(?:[Bb]y[ \t]+)?[A-Z]|(?i:all rights reserved)[.!]?[ \t]*(?:$|{ends})).*$"
    )

    def spelt(text: str) -> str:
        for variant, to in SPELLINGS:
            text = f"replace({text}, {quote(variant)}, {quote(to)})"
        return text

    words = rf"regexp_replace(lower(regexp_replace(regexp_replace(x, {quote(sentence)}, '\1\2' || chr(1) || '\3\4', 'g'), {quote('(?s)' + statement)}, '\1')), {quote(SIGNS)}, ' ', 'g')"
    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {words})"
    entire = "trim(" + spelt("regexp_replace(array_to_string(ls, ' '), ' +', ' ', 'g')") + ")"
    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    terms = f"split_part(text, {quote(END)}, 1)"
    return rf"""
WITH files AS (
    SELECT * FROM (VALUES {values(entire_files())}) v(licence, text)
), texts AS (
    SELECT * FROM (VALUES {values(LICENCES + HEADERS)}) v(licence, text) UNION ALL SELECT licence, text FROM files
    UNION ALL SELECT licence, {terms} FROM files WHERE contains(text, {quote(END)}) UNION ALL SELECT licence, {terms} || {quote(END)} FROM files WHERE contains(text, {quote(END)})
), known AS (
    SELECT DISTINCT licence, {entire} AS form FROM (SELECT licence, {lines} AS ls FROM texts)
), forms AS (
    SELECT doc_id, {lines} AS ls FROM documents
), whole AS (
    SELECT doc_id, min(licence) AS licence FROM (SELECT doc_id, {entire} AS form FROM forms) JOIN known USING (form) WHERE form <> '' GROUP BY doc_id
), parts AS (
    SELECT doc_id, licence FROM (SELECT doc_id, trim({spelt('x')}) AS form FROM (SELECT doc_id, unnest(ls) AS x FROM forms)) JOIN known USING (form) WHERE form <> ''
), notices AS (
    SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_lines FROM parts GROUP BY doc_id
)
SELECT doc_id, licence, coalesce(notices, '') AS notices, coalesce(n_lines, 0) AS n_lines
FROM documents LEFT JOIN whole USING (doc_id) LEFT JOIN notices USING (doc_id)
"""
