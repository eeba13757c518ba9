"""The registered queries of this subpackage and the SQL for those that SQL can express.

Every query applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe_codec, collocations, decontaminate, exact_dedup, language_id, lexical_search, licences, near_dedup, pii, secrets, sharding, token_counts, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in windows of the benchmark, and the items they come from."""
    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_join("items", ",").cast("binary")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated"
    )


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, if it is one, and the licences its lines state."""
    out = licences.scan_licences(_documents(spark, sf_dir), licences.known_licences(spark))
    return out.select("doc_id", "licence", F.array_join("notices", ",").alias("notices"), "n_lines")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return token_counts.token_counts(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's credentials, told apart by who else carries them; a source is an owner, a document a repository."""
    out = secrets.scan_secrets(_documents(spark, sf_dir), owner_col="source", repository_col="doc_id")
    base = secrets.span_text(F.col("found"), secrets.KINDS[:3])
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"), "n_live", "n_example"
    )


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, under a fixed key; in production the key is a secret of the caller."""
    out = pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), key="registered-query")
    spans = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["was_valid"])), ",")
    return out.select("doc_id", *(pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS), spans.alias("spans"), "text")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the labelled documents outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    held_out = (language_id.fold_of(F.col("doc_id")) == 2).alias("held_out")
    out = language_id.predict(docs, language_id.fit(docs))
    return out.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among eight shards, and its shard if there were nine."""
    tree = sharding.Tree.even(8)
    out = sharding.shard_rows(_documents(spark, sf_dir), tree, tree.grow())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token identifiers and their decoding, as digests."""
    return bpe_codec.encode_digests(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's best documents."""
    return lexical_search.rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as it is read from the archives."""
    out = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    page = lambda name: F.col(name).cast("long")
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's best collocations of two to five words."""
    return collocations.collocations(_documents(spark, sf_dir))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_licence_scan": op2_licence_scan,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_near_dedup": op6_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_bpe": op10_bpe,
    "op11_ranked_search": op11_ranked_search,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}



def _secrets_sql() -> str:
    """Spans by adding up the lengths of matches and of what stands between them."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = (secrets.ASSIGN, secrets.ACCESS, secrets.HEX)
    each = " UNION ALL ".join(
        f"SELECT doc_id, source, {kind} AS kind, regexp_extract_all(t, {quote(p)}) AS hits, regexp_split_to_array(t, {quote(p)}) AS gaps FROM texts" for kind, p in enumerate(patterns)
    )
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END"
    total = lambda of, upto: f"coalesce(list_sum(list_transform({of}[1:{upto}], lambda x: length(x))), 0)"
    return f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), found AS ({each}), placed AS (
    SELECT doc_id, source, kind, hits[i] AS hit, CAST({total('gaps', 'i')} + {total('hits', 'i - 1')} AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0)
), valued AS (
    SELECT *, start + length(hit) AS stop, CASE WHEN kind = 0 THEN regexp_extract(hit, {quote(secrets.ASSIGN)}, 2) ELSE hit END AS v FROM placed
), base AS (SELECT * FROM valued WHERE kind <> 0 OR length(v) >= {secrets.LEAST_VALUE}), owned AS (
    SELECT v, count(DISTINCT coalesce(source, chr(1))) > {secrets.MOST_OWNERS} OR count(DISTINCT (coalesce(source, chr(1)), doc_id)) > {secrets.MOST_REPOSITORIES} AS copied FROM base GROUP BY v
), added AS (
    SELECT DISTINCT doc_id, CASE WHEN copied THEN 4 ELSE 3 END AS kind, stop - length(v) AS start, stop FROM base JOIN owned USING (v)
    WHERE copied OR (length(v) >= {secrets.LIVE_LENGTH} AND len(list_distinct(string_split(v, ''))) >= {secrets.LIVE_CHARACTERS}
        AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(lower(v), 'example|changeme|placeholder|your[_-]|xxxx'))
), spans AS (
    SELECT doc_id, kind, start, stop, {names} || ':' || start || ':' || stop AS span FROM (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, kind, start, stop FROM added)
), joined AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
           count(*) FILTER (WHERE kind = 3) AS n_live, count(*) FILTER (WHERE kind = 4) AS n_example,
           string_agg(span, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS base_text, string_agg(span, ',' ORDER BY start, kind, stop) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN joined USING (doc_id)
"""


ORACLE_SQL = {
    "op11_ranked_search": lexical_search.oracle_sql(),
    "op12_warc": warc.ORACLE_SQL,
    "op13_collocations": collocations.oracle_sql(),
    "op2_licence_scan": licences.oracle_sql(),
    "op1_decontamination": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), i AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, list_aggregate(w[p : p + least(len(w), 13) - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)
), starts AS (
    SELECT doc_id, size, p, list_aggregate(w[p : p + size - 1], 'string_agg', ' ') AS phrase
    FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
    )
), found AS (
    SELECT doc_id, item_id, p, size FROM starts JOIN windows USING (size, phrase)
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op4_secret_scan": _secrets_sql(),
    "op6_near_dedup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, list_aggregate(w[p : p + 4], 'string_agg', ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), groups AS (
    SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY content
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM texts JOIN groups USING (content)
""",
}
