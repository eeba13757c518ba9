"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws
-ln(u) / weight from a hash of (child, key), and the smallest draw wins, which picks
children in proportion to their weights. A draw depends on its own child only, so a
changed weight moves keys only into or out of that child's subtree.

A node's weight is the sum of its shards' weights. To add a shard without touching any
other subtree, `grow` hangs it under a region and rack of its own: all keys that move
go to it. Adding it to an existing rack (`place`) changes the weights on the path to
it, and confines the movement to keys that enter that region.

Null keys hash as a fixed token, so all rows with a null id share a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch

#: Mixed into every draw.
SEED = 20_240_607


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @staticmethod
    def even(count: int = 8, racks: int = 2, per_rack: int = 2) -> Tree:
        """Shards 0 to count - 1 of weight 1, dealt out to regions of `racks` racks of `per_rack` shards."""
        return Tree(tuple(Shard(f"r{i // (racks * per_rack)}", f"k{i // per_rack}", i) for i in range(count)))

    def grow(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        n = max((s.number for s in self.shards), default=-1) + 1
        return Tree((*self.shards, Shard(f"grown-{n}", f"grown-{n}", n, weight)))

    def place(self, region: str, rack: str, weight: float = 1.0) -> Tree:
        """With one more shard in a given rack."""
        n = max((s.number for s in self.shards), default=-1) + 1
        return Tree((*self.shards, Shard(region, rack, n, weight)))

    def shard_of(self, key: Column) -> Column:
        """The shard's number for a key, as a Column of built-in functions."""
        regions = _grouped(self.shards, lambda s: s.region)

        def in_rack(shards: list[Shard]) -> Column:
            return _pick(key, [(f"shard/{s.number}", s.weight, F.lit(s.number)) for s in shards])

        def in_region(shards: list[Shard]) -> Column:
            racks = _grouped(shards, lambda s: s.rack)
            return _pick(key, [(f"rack/{s[0].region}/{name}", sum(x.weight for x in s), in_rack(s)) for name, s in racks.items()])

        return _pick(key, [(f"region/{name}", sum(x.weight for x in s), in_region(s)) for name, s in regions.items()])


def _grouped(shards, name) -> dict[str, list[Shard]]:
    out: dict[str, list[Shard]] = {}
    for s in shards:
        out.setdefault(name(s), []).append(s)
    return out


def draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash of the node and the key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(node), F.coalesce(key.cast("string"), F.lit("\0null"))), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; of equal draws the earlier child's."""
    children = [c for c in children if c[1] > 0]
    if not children:
        raise ValueError("a level of the tree has no child with a positive weight")
    if len(children) == 1:
        return children[0][2]
    least = F.least(*(draw(key, node, w) for node, w, _ in children))
    out = children[-1][2]
    for node, w, value in reversed(children[:-1]):
        out = F.when(draw(key, node, w) == least, value).otherwise(out)
    return out


def shard_rows(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot and, if a grown tree is given, grown_shard.

    `size` is the text's UTF-8 bytes plus 1 (null: no bytes). `slot` numbers a shard's
    rows from 0 without gaps, in input order: rows are numbered within (shard, input
    partition), and each such block starts where the counts of the blocks before it
    end, so no task holds more of a shard than one input partition brought.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        key,
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        tree.shard_of(key).cast("int").alias("shard"),
        (grown.shard_of(key) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Written once, so that row numbers stay as they are when a task runs again.
    light = Scratch(docs.sparkSession, "shards").save(light, "rows").withColumn("_part", F.shiftright("_row", 33))
    from pyspark.sql import Window

    counts = light.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "_part").orderBy("_row")
    return (
        light.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_part"])
        .withColumn("slot", (F.col("start") + F.col("at")).cast("long"))
        .select(id_col, "size", "text_crc32", "shard", "slot", "grown_shard")
    )
