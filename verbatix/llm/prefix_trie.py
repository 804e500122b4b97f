"""Prefix trie of conversations, measured by heavy-path decomposition.

A conversation is its turns in order; every distinct sequence of first turns is a node, and the root stands for
none. Nodes are named by sums of digests of (place, turn), so prefixes are running sums: a conversation is cut into
blocks of bounded size, windows run inside blocks and over their totals, and no long conversation is one task.

Sums over subtrees do not walk the tree. The child with most members (ties: smallest member) continues its parent's
path; every other child begins a path of its own. A light child has at most half of its parent's members, so no node
lies below more than log2(conversations) light edges. Paths are finished from the lowest level up: the total of a
path is that of its nodes and of the paths attached to them, and is added to the node above its first. Then a suffix
sum along each path, in blocks as well, gives every node the sum over its subtree.

Defined results: a null role or text is empty; turns are ordered by ``turn`` (null first), equal ones by the digest of
role and text; repeated rows are turns of their own; rows without ``conv_id`` belong to no conversation and take no
part; a table without conversations has no nodes, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Places of a conversation, or of a path, in a block.
BLOCK = 1024
_LANES = tuple(f"s{k}" for k in range(4))
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, at: str, folds: dict[str, tuple[str, Column]], last_first: bool = False) -> DataFrame:
    """``rows`` with, for each ``name: (kind, value)``, the sum or max ("sum", "max") of the values of its key's rows up
    to itself in order of ``at``, which counts from 0 or 1. Windows run over the rows of a block and over the
    totals of a key's earlier blocks."""
    apply = {"sum": F.sum, "max": F.max}
    place = F.col(at) * (-1 if last_first else 1)
    cut = rows.withColumn("_block", F.floor(F.col(at) / BLOCK)).withColumns({f"_v_{n}": v for n, (_, v) in folds.items()})
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(key, "_block").agg(*(apply[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in folds.items()))
    earlier = Window.partitionBy(key).orderBy(F.col("_block") * (-1 if last_first else 1)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_block", F.count("*").over(earlier).alias("_n"), *(apply[kind](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (kind, _) in folds.items()))
    out = cut.withColumns({n: apply[kind](f"_v_{n}").over(inside) for n, (kind, _) in folds.items()}).join(before.filter("_n > 0").drop("_n"), [key, "_block"], "left")
    both = {n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) if kind == "sum" else F.greatest(n, f"_b_{n}") for n, (kind, _) in folds.items()}
    return out.withColumns(both).drop("_block", *(f"_{x}_{n}" for x in "vb" for n in folds))


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 1), digest (of role and text) and text_bytes of every turn. Rows are sorted by ranges
    that cut through long conversations; a place is the number in the range and the turns in the ranges before."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("text_bytes"), F.monotonically_increasing_id().alias("_row"))
    numbered = scratch.table(rows, "turns")  # the sort looks at its input twice
    order = ("conv_id", F.col("turn").asc_nulls_first(), "digest", "_row")
    ranges = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = scratch.table(ranges.select("conv_id", "digest", "text_bytes", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    parts = ranges.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before)
    placed = ranges.join(parts, ["conv_id", "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return scratch.table(placed.select("conv_id", "place", "digest", "text_bytes"), "places")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(".", depth.cast("string"), *(s.cast("string") for s in sums))))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent and text_bytes of every prefix of every conversation but the empty one."""
    own = F.sha2(F.concat_ws(":", F.col("place").cast("string"), "digest"), 256)
    lanes = {f"l{k}": F.conv(F.substring("_own", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(len(_LANES))}
    cut = turns.withColumn("_own", own).select("conv_id", F.col("place").alias("depth"), "text_bytes", *(v.alias(n) for n, v in lanes.items()))
    summed = running(cut, "conv_id", "depth", {s: ("sum", F.col(lane)) for s, lane in zip(_LANES, lanes, strict=True)})
    above = [F.col(s) - F.col(lane) for s, lane in zip(_LANES, lanes, strict=True)]
    return summed.select("conv_id", "depth", _key(F.col("depth"), [F.col(s) for s in _LANES]).alias("key"), _key(F.col("depth") - 1, above).alias("parent"), "text_bytes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, first and ids (decimal, joined by commas) of each run of rows of one key in a batch."""
    for batch in batches:
        keys, ids, out, start = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), [], 0
        for stop in range(1, len(keys) + 1):
            if stop == len(keys) or keys[stop] != keys[start]:
                out.append((keys[start], ids[start], ",".join(map(str, ids[start:stop]))))
                start = stop
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and ends_sha256: the runs of a key come in order and go through one hash, none of them is kept."""
    key = state = None
    for batch in batches:
        done = []
        for now, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if now != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield _hashed(done)
    if state is not None:
        yield _hashed([(key, state.hexdigest())])


def _hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of ``ends`` (key, conv_id): a node that a large share of all conversations end at is
    cut into runs by ranges; only the runs meet in one task, and pass through it as a stream."""
    runs = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key binary, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


def trie(turns: DataFrame, talks: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of last
    texts that members share) and ends_sha256 of every node. ``turns`` has conv_id, place, digest and text_bytes,
    ``talks`` a row for each conversation, with turns or without."""
    zero = F.lit(0).cast("long")
    root_key = _key(F.lit(0), [zero] * len(_LANES))
    walks = scratch.table(prefixes(turns), "walks")
    root = talks.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(root_key.alias("key"), "conv_id", zero.alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", zero.alias("text_bytes"))
    nodes = walks.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("text_bytes").alias("text_bytes"))
    nodes = scratch.table(nodes.unionByName(root), "nodes")

    # the heavy child of each node, and whether a node is light
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"), "key"))
    kids = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), largest["key"].alias("heavy")).withColumnRenamed("parent", "key")
    known = scratch.table(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", zero)), "known")
    above = known.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "heavy")
    tree = known.drop("heavy").join(above, "parent", "left").withColumn("light", F.col("heavy").isNull() | (F.col("heavy") != F.col("key"))).drop("heavy")
    tree = scratch.table(tree, "tree")

    # the path of a node: the last light node on the way to it, on any member's walk
    lights = tree.filter("light and depth > 0").select("key", F.lit(True).alias("light"))
    flagged = walks.select("conv_id", "depth", "key").join(lights, "key", "left")
    head = F.when(F.col("light"), F.struct("depth", "key"))
    walked = running(flagged, "conv_id", "depth", {"head": ("max", head), "level": ("sum", F.col("light").isNotNull().cast("long"))})
    of_node = walked.groupBy("key").agg(F.max("head").alias("head"), F.max("level").alias("level"))
    saved, leaf = (F.col("n_convs") - 1) * F.col("text_bytes"), (F.col("n_children") == 0).cast("long")
    placed = tree.join(of_node, "key", "left").select(
        *(c for c in tree.columns if c != "text_bytes"),
        F.coalesce("head.key", root_key).alias("head"),
        (F.col("depth") - F.coalesce("head.depth", zero)).alias("at"),
        F.coalesce("level", zero).alias("level"),
        saved.alias("saved"),
        leaf.alias("leaves"),
    )
    placed = scratch.table(placed, "placed")

    # totals of paths, the lowest level first; each is added to the node above its first one
    heads = placed.filter("at = 0").select("head", "parent", "level")
    upper = placed.select(F.col("key").alias("parent"), F.col("head").alias("up"))
    own = placed.groupBy("head").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = scratch.table(own.join(heads, "head").join(upper, "parent", "left"), "paths")
    lowest = paths.agg(F.max("level")).first()[0] or 0
    attached = None
    for level in range(lowest, 0, -1):
        here = paths.filter(F.col("level") == level)
        if attached is not None:
            below = given.groupBy(F.col("up").alias("head")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
            here = here.join(below, "head", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("saved", "leaves")})
        given = scratch.table(here.select("up", "parent", "saved", "leaves"), f"level{level}")
        attached = given if attached is None else attached.unionByName(given)
    if attached is not None:
        gained = attached.groupBy(F.col("parent").alias("key")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        placed = placed.join(gained, "key", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("saved", "leaves")})
    summed = running(placed, "head", "at", {"saved_tokens": ("sum", F.col("saved")), "n_leaves": ("sum", F.col("leaves"))}, last_first=True)

    last = walks.groupBy("conv_id").agg(F.max(F.struct("depth", "key"))["key"].alias("key"))
    ends = talks.select("conv_id").join(last, "conv_id", "left").withColumn("key", F.coalesce("key", root_key))
    hashes = ends_hashes(scratch.table(ends, "ends"))
    out = summed.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def mixed(turns: DataFrame, start: Callable[[Column], tuple[Column, Column]], most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns, talks) of conversations rebuilt from two: ``start`` gives, for a conv_id, the conversation whose first
    turns come first and how many (``most`` at most); the own turns after as many follow."""
    counts = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    source, wanted = start(F.col("conv_id"))
    talks = counts.select("conv_id", source.alias("source"), wanted.cast("long").alias("wanted"))
    there = counts.select(F.col("conv_id").alias("source"), F.col("n").alias("n_source"))
    talks = scratch.table(talks.join(there, "source", "left").withColumn("taken", F.least("wanted", F.coalesce("n_source", F.lit(0)))).drop("n_source"), "talks")
    kept = turns.join(talks.drop("source"), "conv_id").filter("place > wanted").withColumn("place", F.col("place") - F.col("wanted") + F.col("taken"))
    # a conversation lends a bounded number of turns
    lent = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "source").join(talks, "source").filter("place <= wanted")
    columns = ("conv_id", "place", "digest", "text_bytes")
    return kept.select(*columns).unionByName(lent.select(*columns)), talks.select("conv_id")
