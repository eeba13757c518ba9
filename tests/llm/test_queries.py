"""The registered queries against DuckDB, and the pipeline against its stages done by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import language_id
from pulsegrid.llm.queries import ORACLE_SQL, QUERIES


def plain(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in at) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert plain(found.columns, found.collect()) == plain(wanted.columns, wanted.fetchall())


def test_licences_match_sql_on_whole_texts(spark, tmp_path):
    """All known texts, wrapped, spelt otherwise and under statements of a copyright; and lines that only look like one."""
    import random
    import textwrap

    from pulsegrid.llm import licences

    rng, texts = random.Random(5), [None, "", "\n", "© \n", "Copyright law\nSPDX-License-Identifier: MIT"]
    whole = [x for x in licences.LICENCES + licences.entire_texts() if len(x[1]) > 200]
    heads = ["", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n", "Copyright The Some Authors\n\n", "Copyright [yyyy] [name]\r\n", "© Someone\n", "\tCOPYRIGHT BY Someone\n", "(C) copyright someone\n", "(c)2020 x\n", "copyright 1999\n"]
    heads += ["copyright in 2020\n", "Copyright laws 2020\n", "copyright 20201\n", "(c) 12020 x\n", "copyrighted 2020\n", "Copyright\n", "All rights reserved by x\n", "x\rCopyright 2020 y\n", "All Rights Reserved. \r\n", "copyright notice (c) 2020\n"]
    for name, text in whole:
        for head in heads:
            paragraphs = "\n\n".join(textwrap.fill(p, rng.randrange(20, 100)) for p in text.split("\n\n")) if rng.random() < 0.5 else text
            texts.append(head + (paragraphs.replace("license", "licence") if rng.random() < 0.3 else paragraphs.upper() if rng.random() < 0.2 else paragraphs))
    texts += [head + f"{rng.choice(['', '* ', '# '])}{notice}\r\n{rng.choice(heads)}{notice.lower()}" for _, notice in licences.LICENCES + licences.HEADERS if len(notice) <= 200 for head in heads]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found, wanted = QUERIES["op2_licence_scan"](spark, str(tmp_path)), con.sql(ORACLE_SQL["op2_licence_scan"])
    rows = plain(found.columns, found.collect())
    assert rows == plain(wanted.columns, wanted.fetchall())
    assert {r[1] for r in rows} > {name for name, _ in whole} and any(r[2] not in ("None", "0") for r in rows)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_by_hand(spark, sf_dir):
    import re

    from test_text_operators import components_of, contamination_model
    from tokenizers import Tokenizer

    from pulsegrid.llm.byte_pairs import vocabulary_path

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(table)
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    docs = {k: t for k, t in docs.items() if not model.judge(t.encode())[2]}
    first = {}
    for k in sorted(docs):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", docs[k]), k)
    docs = {k: docs[k] for k in first.values()}
    docs = {k: docs[k] for k in set(components_of(docs, 80)[0].values())}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {k: t for k, t in docs.items() if not [1 for _, n, hit, _ in contamination_model([(k, t)], bench) if hit and 20 * hit >= n]}
    lib = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    wanted = {k: lib.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == wanted


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_nulls_and_repeated_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    none = docs.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    odd = docs.unionByName(docs.limit(5)).unionByName(none).unionByName(docs.limit(3).withColumn("text", F.lit(" ")))
    for _, stage in corpus_pipeline.STAGES:
        odd = spark.createDataFrame(stage(spark, odd, sf_dir).collect(), stage(spark, odd, sf_dir).schema)
    ids = [r["doc_id"] for r in odd.collect()]
    assert len(ids) == len(set(ids)) > 0 and None not in ids  # texts that are null or without letters have no language


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
