"""WARC archives: writing pages, normalising whole-file gzip, and reading by an index.

Writing. Every page is a `response` record, or a `revisit` where another page has the
same payload of LEAST_REVISIT bytes or more and a larger id; revisits hold HTTP headers
only and name the page they refer to. Payloads are equal when their SHA-256 digests are; the
groups are joined with hot ones in parts, as in `exact_dedup`. Spark's text writer makes
the files, records ended by two line ends, under Spark's own commit. Its compression
makes each file one gzip stream: nothing in it can be found without inflating all before.

Normalising. A task inflates each such stream once, from front to back, and writes every
record anew as a gzip member of its own, with a sidecar index of offsets and lengths
beside the archive. Streams of several members and plain files are taken too. It holds
a piece of PIECE bytes of one record at a time, whatever the sizes. Both files get
their names when they are whole, the index last; a task that is run again replaces them.
A file that is cut short, isn't gzip or isn't WARC fails with its name in the message.

Reading. The index is a table. Ranges of about RANGE_BYTES of an archive go to one
task, so an archive is read by many, and each record is fetched by its offset. The
digest of a response's payload is computed anew and compared with the record's header.

A null html is an empty payload. A null url leaves its header out, line ends in a url are
escaped. Ids become part of a record's name as text; a null id has an empty one, is never referred to, and
is null again when read. Rows that repeat an id that others refer to are all
responses. An empty table gives no records. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, enter
from pulsegrid.llm.exact_dedup import _salted_join as salted_join

LEAST_REVISIT = 1000
RECORDS_PER_FILE = 100_000
PIECE = 1 << 20
RANGE_BYTES = 32 << 20
LEVEL = 6
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"
DATE = "2000-01-01T00:00:00Z"

INDEX = "archive string, offset long, length long, record_type string, record_id string"
RECORDS = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, refers_to): what each page's record will be; `refers_to` is null for responses."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    some = rows.filter(large).withColumn("digest", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    groups = Scratch(pages.sparkSession, "payloads").save(some.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("group_size")), "groups")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    found = salted_join(some, groups).select("id", "url", "payload", refers)
    return found.unionByName(rows.filter(~large).withColumn("refers_to", F.lit(None).cast(rows.schema["id"].dataType)))


def _name(id_: Column) -> Column:
    """A record's name from an id; escaped as in addresses, but with blanks as such."""
    return F.concat(F.lit(f"<{NAME}"), F.replace(F.url_encode(F.coalesce(id_.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20")), F.lit(">"))


def _record(date: str) -> Column:
    """A record without its end."""
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), _name(F.col("id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(F.col("payload").cast("binary")),
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.when(F.col("refers_to").isNotNull(), _name(F.col("refers_to")))), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END),
    )
    return F.concat(head, http, body)


def write_archives(records: DataFrame, folder: str, date: str = DATE) -> None:
    """The records as files of one gzip stream each."""
    text = records.select(_record(date).alias("record"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Stream:
    """The records of one stream, from front to back."""

    def __init__(self, source, path: str):
        self.path = path
        raw = io.BufferedReader(source, PIECE)
        self.file = io.BufferedReader(gzip.GzipFile(fileobj=raw), PIECE) if raw.peek(2)[:2] == b"\x1f\x8b" else raw

    @contextmanager
    def _named(self) -> Iterator[None]:
        """Faults of the stream, with its name."""
        try:
            yield
        except (OSError, EOFError, KeyError, ValueError, zlib.error) as error:
            raise ValueError(f"{self.path}: {error!r}") from error

    def __iter__(self) -> Iterator[tuple[bytes, dict[str, str], int]]:
        """(head, its fields in lower case, size of the block) of each record; the block is to be read before the next."""
        while True:
            with self._named():
                head, fields = self._head()
                size = int(fields["content-length"]) if head else 0
            if not head:
                return
            yield head, fields, size

    def _head(self) -> tuple[bytes, dict[str, str]]:
        line = self.file.readline(PIECE)
        while line and not line.strip():  # between records
            line = self.file.readline(PIECE)
        if line and not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head, fields = line, {}
        while line and (line := self.file.readline()).strip():
            head += line
            name, _, value = line.partition(b":")
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        return head and head + b"\r\n", fields

    def block(self, size: int) -> Iterator[bytes]:
        """The block of a record, in pieces."""
        while size:
            with self._named():
                piece = self.file.read(min(size, PIECE))
                if not piece:
                    raise EOFError("the last record is cut short")
            size -= len(piece)
            yield piece


def rewrite(source, path: str, out) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Write every record of a stream as a member of its own; (offset, length, fields) of each."""
    at, stream = 0, Stream(source, path)
    for head, fields, size in stream:
        member, start = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at
        for part in chain((head,), stream.block(size), (END.encode(),)):
            at += out.write(member.compress(part))
        at += out.write(member.flush())
        yield start, at - start, fields


def normalise(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """INDEX of the archives written to `out`; each holds the records of one file of `folder`, a member each.

    Running the frame writes the files, so it is to be stored once, as `Scratch.save` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("warc")
        attempt = TaskContext.get().taskAttemptId()
        there, root = _opened(out)
        there.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                new, rows = f"{root}/_{name}.{attempt}", []
                files, at = _opened(path)
                with files.open_input_file(at) as source, there.open_output_stream(new, compression=None) as archive, there.open_output_stream(f"{new}.index", compression=None) as sidecar:
                    for offset, length, fields in rewrite(source, path, archive):
                        rows.append((offset, length, fields.get("warc-type"), fields.get("warc-record-id", "").strip("<>")))
                        sidecar.write(json.dumps({"offset": offset, "length": length, "type": rows[-1][2], "id": rows[-1][3]}).encode() + b"\n")
                        if len(rows) == 1 << 14:
                            yield _index_rows(f"{out}/{name}", rows)
                            rows = []
                there.move(new, f"{root}/{name}")
                there.move(f"{new}.index", f"{root}/{name}.index")
                yield _index_rows(f"{out}/{name}", rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path").mapInArrow(run, INDEX)


def _index_rows(archive: str, rows: list[tuple[int, int, str | None, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["archive", "offset", "length", "record_type", "record_id"])


def read_record(member: bytes, where: str, payload: bool = False) -> tuple:
    """A row of RECORDS from one member; its payload only if asked for."""
    stream = Stream(io.BytesIO(member), where)
    _, fields, size = next(iter(stream))
    http, digest, length, kept, said = b"", hashlib.sha1(), 0, [], None
    inside = not fields.get("content-type", "").startswith("application/http")  # then the whole block is payload
    for piece in stream.block(size):
        if not inside:
            http += piece
            head, found, piece = http.partition(END.encode())
            if not found:
                continue
            inside = True
            said = next((int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
        digest.update(piece)
        length += len(piece)
        if payload:
            kept.append(piece)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = fields.get("warc-type") == "revisit"
    if not revisit and stated not in (None, digest.hexdigest()):
        raise ValueError(f"{where}: the payload of {fields.get('warc-record-id')} isn't what its digest says")
    name = lambda field: unquote(fields[field].strip("<>").removeprefix(NAME)) or None if field in fields else None
    body = b"".join(kept) if payload and not revisit else None
    sizes = (said if revisit else length, stated if revisit else digest.hexdigest())
    return fields.get("warc-type"), name("warc-record-id"), fields.get("warc-target-uri"), name("warc-refers-to"), *sizes, body


def read_archives(index: DataFrame, payload: bool = False) -> DataFrame:
    """RECORDS of a stored index; `payload` is null unless asked for, and always for revisits."""
    total = index.agg(F.sum("length").alias("n")).head()["n"] or 0
    ranges = index.repartition(max(1, -(-total // RANGE_BYTES)), "archive", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("warc")
        path, file, rows, size = None, None, [], 0
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != path:
                    if file:
                        file.close()
                    files, at = _opened(archive)
                    path, file = archive, files.open_input_file(at)
                rows.append(read_record(file.read_at(length, offset), f"{archive} at {offset}", payload))
                size += length
                if len(rows) >= 4096 or payload and size > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        if file:
            file.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.select("archive", "offset", "length").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payload: bool = False) -> DataFrame:
    """Pages written to archives, normalised, and read back: RECORDS."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(plan_records(pages, id_col, url_col, html_col), f"{scratch.root}/whole")
    index = scratch.save(normalise(pages.sparkSession, f"{scratch.root}/whole", f"{scratch.root}/members"), "index")
    scratch.drop("whole")
    return read_archives(index, payload)


ORACLE_SQL = f"""
WITH sized AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS size FROM pages
), firsts AS (
    SELECT payload, max(page_id) AS winner FROM sized WHERE size >= {LEAST_REVISIT} GROUP BY payload
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM sized LEFT JOIN firsts USING (payload)
"""
