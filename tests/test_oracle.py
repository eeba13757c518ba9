"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from pulsegrid.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return str(value)


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in at] for r in data), key=repr)


def numbers(value):
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def same(spark, sf_dir, query, sql):
    found = query(spark, sf_dir)
    mine = [tuple(map(numbers, r)) for r in found.collect()]
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = con.sql(sql)
    names, theirs = wanted.columns, [tuple(map(numbers, map(as_float, r))) for r in wanted.fetchall()]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, mine) == rows(names, theirs)


def as_float(value):
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert os.system(f"cd {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))} && python -c '{code}'") == 0
