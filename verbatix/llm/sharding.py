"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions and racks; an inner node weighs as much as its shards. From the
root down, each child draws ``-ln(u) / weight`` with u in (0, 1) hashed from the row's key and the child's
name, and the smallest draw wins: a child wins in proportion to its weight. A weight that changes moves
rows only into or out of the child that has it, so movement stays in that subtree. A new region takes rows
only into itself.

``slot`` numbers a shard's rows without gaps, in the order of key, size and checksum inside hash buckets:
buckets are numbered in parallel and offset by a table of bounded size, so no task holds a whole shard.

Defined results: a null text has no bytes; a null key draws as the empty string; repeated rows get the
same shard and slots of their own; an empty table gives an empty table; added columns replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a shard in which slots are numbered; their table has shards times BUCKETS rows.
BUCKETS = 256


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: Sequence[Node] = ()
    shard: int = -1


#: Racks of a region and shards of a rack.
RACKS, SHARDS_PER_RACK = 2, 4


def topology(shards: int, racks: int = RACKS, shards_per_rack: int = SHARDS_PER_RACK) -> Node:
    """Regions of ``racks`` racks of ``shards_per_rack`` equal shards; the last ones may be smaller.
    Adding a shard to a full tree opens a region."""

    def inner(name: str, children: list[Node]) -> Node:
        return Node(name, sum(c.weight for c in children), tuple(children))

    leaves = [Node(f"shard{i}", 1.0, (), i) for i in range(shards)]
    full = [inner(f"rack{i // shards_per_rack}", leaves[i : i + shards_per_rack]) for i in range(0, shards, shards_per_rack)]
    return inner("root", [inner(f"region{i // racks}", full[i : i + racks]) for i in range(0, len(full), racks)])


def draw(key: Column, name: str, weight: float) -> Column:
    """The first 13 hexadecimal digits of an MD5 make u."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(name)).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((digits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def place(key: Column, node: Node) -> Column:
    """The shard of a key: a nested choice, of which only the branch taken is computed."""
    if node.shard >= 0:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = F.array(*(F.struct(draw(key, c.name, c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)))
    won = F.array_min(draws)["i"]
    # a one-element transform names the winner, so that the draws of a node are made once
    choice = lambda w: _choose(w, [place(key, c) for c in node.children])
    return F.element_at(F.transform(F.array(won), choice), 1)


def _choose(won: Column, options: list[Column]) -> Column:
    out = F.when(won == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(won == i, option)
    return out


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, shard, grown_shard (with one shard more) and slot. ``shards`` fill whole
    regions: only then does one more open a region of its own and take rows only into itself."""
    if shards <= 0 or shards % (RACKS * SHARDS_PER_RACK):
        raise ValueError(f"shards must be a multiple of {RACKS * SHARDS_PER_RACK}")
    placed = docs.withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
            "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
            "shard": place(F.col(key), topology(shards)).cast("int"),
            "grown_shard": place(F.col(key), topology(shards + 1)).cast("int"),
        }
    )
    return number_slots(placed, key)


def number_slots(placed: DataFrame, key: str) -> DataFrame:
    bucketed = placed.withColumn("_bucket", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = bucketed.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(key, "size", "text_crc32"))
    numbered = bucketed.withColumn("_rank", rank)
    # shards times BUCKETS rows at most
    return numbered.join(F.broadcast(firsts), ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_first", "_rank")
