"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of ASCII white space is replaced by one
space. Three combines find the groups, and each has the whole content in its grouping
key, so a digest only routes rows and never decides that two texts are equal:

1. within a task, before the shuffle (Spark's partial aggregate), so a text that makes
   up a third of all rows leaves each task as one row;
2. across tasks within (digest, salt), the salt being the task's number modulo SALTS,
   so no reducer gets more than a share of a hot group;
3. the salt winners within a digest.

Rows then find their group by a join on the digest and a salt. A group of more than a
HOT_SHARE-th of all rows, of which there are at most HOT_SHARE, is joined in as many
parts as it has such shares: its digest is broadcast, its rows draw a part, and its winner is
repeated for each. A digest that more than one content shares would make the join
ambiguous; such digests are looked for, and their rows are joined on the content as well.

Nulls count as the empty text. Null ids never win over others; a group with null ids
only has a null keep_id. An empty table gives an empty result. Extra columns pass
through `drop_exact_duplicates` untouched, whatever their names; `exact_groups` reads
the two named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch

SALTS = 16
HOT_SHARE = 1000
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def combine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, keep_id, group_size, content and how many contents share the digest."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(F.col(text_col)).alias("content"),
        (F.spark_partition_id() % salts).alias("salt"),
    ).withColumn("digest", digest(F.col("content")))
    local = rows.groupBy("digest", "salt", "content").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return local.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def winners(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, group_size) of digests with one content, and those with several as (digest, content, keep_id, group_size), None if there are none.

    Counting the contents of a digest needs digests only, so the contents are dropped
    from the stored table, and read again only where a digest turns out to be shared.
    """
    found = combine(docs, id_col, text_col)
    groups = scratch.save(found.drop("content"), "groups")
    shared = groups.groupBy("digest").count().filter("count > 1").select("digest")
    if shared.isEmpty():
        return groups, None
    twins = found.join(F.broadcast(shared) if shared.count() < 1000 else shared, "digest", "left_semi")
    return groups.join(shared, "digest", "left_anti"), scratch.save(twins, "twins")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    `kept` marks the rows whose id is keep_id; rows that repeat both id and text are
    all marked, and `drop_exact_duplicates` leaves one of them.
    """
    return _membership(docs.select(F.col(id_col), F.col(text_col)), Scratch(docs.sparkSession, "exact"), id_col, text_col).select(
        id_col, "keep_id", "group_size", "kept", "text_sha256"
    )


def _membership(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    one, several = winners(docs, scratch, id_col, text_col)
    rows = docs.select(F.col(id_col), normalised(F.col(text_col)).alias("content")).withColumn("digest", digest(F.col("content")))
    out = _salted_join(rows.drop("content"), one)
    if several is not None:
        out = out.unionByName(rows.join(several, ["digest", "content"]).drop("content"))
    return out.withColumns({"kept": F.col(id_col).eqNullSafe(F.col("keep_id")), "text_sha256": F.lower(F.hex("digest"))})


def _salted_join(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows.join(one, "digest"), hot digests in parts."""
    share = -(-(one.agg(F.sum("group_size").alias("n")).head()["n"] or 0) // HOT_SHARE)
    parts = F.greatest(F.ceil(F.col("group_size") / F.lit(max(share, 1))), F.lit(1)).cast("int")
    hot = one.filter(F.col("group_size") > share).select("digest", parts.alias("parts"))
    # At most HOT_SHARE groups are larger than that share of all rows.
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(F.lit(0)).cast("long")).drop("parts")
    ones = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("group_size") > share, parts).otherwise(1).cast("long") - 1)))
    return rows.join(ones, ["digest", "salt"]).drop("salt")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one row of each group."""
    scratch = Scratch(docs.sparkSession, "exact")
    one, several = winners(docs, scratch, id_col, text_col)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column of the input clashes
    key = names[id_col]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).withColumn("content", normalised(F.col(names[text_col])))
    rows = rows.withColumn("digest", digest(F.col("content")))
    back = [F.col(n).alias(c) for c, n in names.items()]
    kept = F.col(key).eqNullSafe(F.col("keep_id"))
    # Several rows of a group can carry its keep_id; how many is known from a count without texts.
    ids = rows.select("digest", key).groupBy("digest", key).agg(F.count("*").alias("same"))
    of = scratch.save(one.join(ids, "digest").filter(kept).select("digest", "keep_id", "same"), "kept")
    on = [rows["digest"] == of["digest"], rows[key].eqNullSafe(of["keep_id"])]
    out = rows.join(of.filter("same = 1"), on, "left_semi").select(*back)
    more = of.filter("same > 1")
    if not more.isEmpty():
        out = out.unionByName(rows.join(more, on, "left_semi").dropDuplicates(["digest"]).select(*back))
    if several is not None:
        twins = rows.join(several.select("digest", "content", "keep_id"), ["digest", "content"]).filter(kept)
        out = out.unionByName(twins.dropDuplicates(["digest", "content"]).select(*back))
    return out
