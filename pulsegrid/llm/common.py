"""What the operators share: tables in the shared scratch folder, and byte-level views of Arrow text columns."""

from __future__ import annotations

import atexit
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.shared import new_path

#: bytes.translate table: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Scratch:
    """Intermediate tables of one operator call, written as Parquet and read back.

    Reading a written table cuts the lineage: a lost executor costs a task that reads
    the table again, not the stages that made it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_path(spark, name)
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str, append: bool = False, group_rows: int = 0) -> DataFrame:
        """The table, written; with `append` under what is there, with `group_rows` in row groups of so many rows.

        Rows of megabytes need it: Spark's reader decodes up to 4,096 rows of a row group at
        once, and the writer holds a hundred before it looks at their size. It also holds
        each group's least and greatest values until a file ends, so such tables have none.
        """
        path = f"{self.root}/{name}"
        out = df.write.mode("append" if append else "overwrite").option("compression", "zstd")
        if group_rows:
            out = out.options(**{"parquet.block.row.count.limit": group_rows, "parquet.column.statistics.enabled": False})
        out.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no DataFrame in use reads any more."""
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is not None:  # the session may have ended before
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def one_by_one(df: DataFrame) -> DataFrame:
    """The same table, whose rows go to Python one at a time: for rows of megabytes, of which a batch holds 10,000 or 64 MB else.

    It belongs to a copy of the session, so no setting changes for other tables or threads.
    """
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().logical()), spark)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def totals_before(sizes: Column, block: int = 64) -> Column:
    """For each place of an array of numbers, the sum of those before it.

    A fold that appends to an array copies it at each step. Here it appends within blocks,
    and once a block; so an array of n numbers takes about block * n / 2 + (n / block)^2 / 2 copies.
    """

    def fold(numbers: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("before"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before"))
        return F.aggregate(numbers, first, step, lambda s: s["before"])

    def of_block(s: Column, b: Column) -> Column:
        return F.slice(s, b * block + 1, F.lit(block))

    def whole(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(of_block(s, b), F.lit(0).cast("long"), lambda x, y: x + y))
        starts = fold(sums, F.lit(0))
        return F.flatten(F.transform(starts, lambda start, b: fold(of_block(s, b), start)))

    return bound(F.coalesce(sizes, F.array().cast("array<bigint>")), lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(F.array().cast("array<bigint>")))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of each text, or None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(batch: pa.RecordBatch, text_at: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


_large: dict[str, Callable[[], None]] = {}


def enter(operator: str, release: Callable[[], None] | None = None) -> None:
    """Called at the start of a task in a Python worker: frees what other operators remember there.

    Workers live on from stage to stage, so a pipeline's stages would otherwise add up
    their caches. `release` is how to free this operator's own, when another comes.
    """
    others = [name for name in _large if name != operator]
    for name in others:
        _large.pop(name)()
    if others:
        gc.collect()
    if release:
        _large[operator] = release
