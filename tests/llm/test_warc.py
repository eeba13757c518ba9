"""WARC archives: round trips, members on their own, other kinds of streams, faults, and odd tables."""

import gzip
import hashlib
import io
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import warc
from pulsegrid.llm.common import Scratch

BIG = "ä line\r\n\r\nWARC/1.1\r\n" * 80
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (5, "http://a/5\r\nX-Evil: 1", BIG), (5, "http://a/5b", BIG), (3, None, "short"), (4, "http://a/4", "short"), (6, "http://a/6", None),
    (7, "http://ü/7", ""), (None, "http://none", BIG), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (None, "n1", "z" * 2000), (None, "n2", "z" * 2000), (12, "u", "\x00" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string"


def model(pages):
    groups = defaultdict(list)
    for i, _, html in pages:
        if i is not None:
            groups[html or ""].append(i)
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        first = max(groups[html or ""], default=None)
        revisit = len(b) >= 1000 and first is not None and first != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def rows_of(df):
    number = lambda x: None if x is None else int(x)
    return sorted(str((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))) for r in df.collect())


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA).repartition(3)


def test_round_trip(pages):
    assert rows_of(warc.round_trip(pages)) == model(PAGES)
    got = {r["record_id"]: r for r in warc.round_trip(pages, payload=True).collect() if r["record_type"] == "response" and r["record_id"]}
    assert {int(k): bytes(r["payload"]).decode() for k, r in got.items()} == {i: h or "" for i, _, h in PAGES if i in (3, 4, 5, 6, 7, 8, 9, 11, 12)}
    assert got["7"]["target_uri"] == "http://ü/7" and got["3"]["target_uri"] is None


def test_members_stand_alone_and_together_give_the_stream(spark, pages, tmp_path):
    scratch = Scratch(spark, "test")
    whole, members = f"file://{tmp_path}/whole", f"file://{tmp_path}/members"
    warc.write_archives(warc.plan_records(pages), whole)
    index = scratch.save(warc.normalise(spark, whole, members), "index").collect()
    assert len(index) == len(PAGES)
    by_file = defaultdict(list)
    for r in index:
        by_file[r["archive"].removeprefix("file://")].append(r)
    originals = sorted(gzip.open(f"{tmp_path}/whole/{n}").read() for n in os.listdir(tmp_path / "whole") if n.endswith(".gz"))
    made = []
    for path, rows in by_file.items():
        data = open(path, "rb").read()
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *(r["offset"] + r["length"] for r in rows)][:-1] and rows[-1]["offset"] + rows[-1]["length"] == len(data)
        parts = [gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in rows]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        assert len(open(f"{path}.index").read().splitlines()) == len(rows)
        made.append(b"".join(parts))
    assert sorted(made) == [o for o in originals if o]
    assert not [n for n in os.listdir(tmp_path / "members") if n.startswith("_")]
    again = scratch.save(warc.normalise(spark, whole, members), "again").collect()  # as a task that is run twice
    assert sorted(map(str, again)) == sorted(map(str, index))


def record(body, kind="resource", extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{len(body)}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_other_streams(spark, tmp_path):
    records = [record(b"one"), record(b"second" * 1000, "metadata"), record(b"", "warcinfo")]
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "in" / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "in" / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    index = Scratch(spark, "test").save(warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out"), "index")
    assert index.groupBy("record_type").count().orderBy("record_type").collect() == [("metadata", 3), ("resource", 3), ("warcinfo", 3)]
    got = warc.read_archives(index, payload=True).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted([b"one", b"second" * 1000, b""] * 3)


@pytest.mark.parametrize("data", [gzip.compress(record(b"abc" * 5000))[:-30], b"not a record\r\n", record(b"abc")[:-6], b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n", gzip.compress(record(b"x"))[:-8] + b"12345678"])
def test_faulty_streams_are_named(data):
    with pytest.raises(ValueError, match="part-7"):
        list(warc.rewrite(io.BytesIO(data), "part-7", io.BytesIO()))


def test_changed_payloads_are_found():
    good = record(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", "response", f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'abc').hexdigest()}\r\n")
    assert warc.read_record(gzip.compress(good), "here")[4:6] == (3, hashlib.sha1(b"abc").hexdigest())
    with pytest.raises(ValueError, match="here"):
        warc.read_record(gzip.compress(good.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")), "here")


def test_odd_tables(spark, pages):
    assert warc.round_trip(pages.filter("false")).count() == 0
    clashing = pages
    for name in ("id", "payload", "digest", "first", "group_size", "salt", "record", "refers_to", "archive"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    assert rows_of(warc.round_trip(clashing)) == model(PAGES)
    names = spark.createDataFrame([("a b/ü>", "u", BIG), ("z\r\nx", "u", BIG), ("", "u", "s")], "page_id string, url string, html string")
    got = sorted((r["record_id"] or "", r["refers_to"]) for r in warc.round_trip(names).collect())
    assert got == [("", None), ("a b/ü>", "z\r\nx"), ("z\r\nx", None)]
