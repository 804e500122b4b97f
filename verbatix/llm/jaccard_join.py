"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the groups they form.

1. Each text becomes a set of 64-bit n-gram hashes; equal sets become one node. In the same pass all n-grams are
   counted in a fixed table of counters.
2. A sieve finds nodes that may have a partner. Sets are ordered by these counts, rarest first (ties by hash): one
   order for all sets. Two linked sets share at least L of their first p + L - 1 n-grams, p being the length
   of the usual prefix; a node that shares fewer with all others together has none. N-grams met twice in a
   block of texts are credited there, so a frequent one sends a row a block.
3. The n-grams of the nodes left are counted exactly. An n-gram of one node only is in no intersection: what
   remains of a set is its core, in order of the magnitudes of these counts, rarest first. Nodes of equal core and equal size have
   the same links to all others and form a class; they are linked to each other if the core is large enough.
4. Prefix postings of the classes' cores are joined to candidate pairs under a length, a positional and a suffix
   filter, and each pair is verified once by counting the intersection.
5. Only groups are asked for, so a pair within one group needs no check. A round compares the members of each
   posting list with some of them, its new centres, and merges what is linked. The members of a list become centres
   in one order, eight times as many with each round, until no list spans two groups or all members of every list have
   been centres; a list meets a pair once, when the first of the two is a new centre. A pair is met in the first list
   that it has in common: postings carry the n-grams before them, ``CARRIED`` at most, and where those tell that
   nothing before is shared, the positional and the suffix filter count from there. Pairs of longer prefixes may meet
   again; those that were refused are not verified again. No candidate is left out.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A text with fewer words than n is one
n-gram; one without words has the empty set and no links.

Defined results: a null text has no words; equal texts share a node; rows with equal ids are grouped by
their own texts, each row giving a row; a null id is grouped as well, its group named by the smallest
non-null id, if any; an empty table gives an empty table; other columns are ignored. The tables of a run stand
in one folder below the shared one; those that the result does not read are deleted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, blocks_of, mix, word_hashes

#: Equal ranges of the hash space in which the suffix filter compares counts.
RANGES = 16
#: Counters for n-grams (four bytes each), in slices that are summed apart: a table of 4 MB at any input.
COUNTERS, SLICES = 1 << 20, 256
#: A posting carries so many n-grams (8 bytes each) of the lists that its class has before.
CARRIED = 32
#: So many ids (8 bytes each) and pairs (two ids each) are sent to all executors; more are joined by shuffle.
FEW_IDS, FEW_PAIRS = 500_000, 200_000


@dataclass(frozen=True)
class Likeness:
    """Sets a and b are linked when 100 * |a & b| >= percent * |a | b|."""

    words: int = 5
    percent: int = 80

    def least_overlap(self, n):
        """With any partner a set of n has so much in common: ceil(percent * n / 100)."""
        return (n * self.percent + 99) // 100

    def prefix(self, n, core=None):
        """A partner shares one of so many first n-grams of a set of n, or of its core."""
        return (n if core is None else core) - self.least_overlap(n) + 1

    def early(self, n, core):
        """A partner of n or more shares one of so many first n-grams of the core: with it, a set of n has ceil(2 * percent * n / (100 + percent)) in common."""
        return core - (2 * self.percent * n + 99 + self.percent) // (100 + self.percent) + 1

    def extra(self, n):
        """L of the sieve, growing with n."""
        return (self.prefix(n) + 3) // 4


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's n-gram hashes, ascending and distinct."""
    lower = [t.lower() for t in texts]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lower])))[:-1]
    hashes, starts, _ = word_hashes(b"\n".join(lower))
    border = np.searchsorted(starts, np.concatenate((first, [np.iinfo(np.int64).max])))
    out = []
    with np.errstate(over="ignore"):
        rolling = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for j in range(words):
            rolling = rolling * np.uint64(0xD6E8FEB86659FD93) + hashes[j : len(hashes) - words + 1 + j]
        rolling = mix(rolling)
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolling[a : b - words + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for h in hashes[a:b]:
                    one = one * np.uint64(0x9FB21C651E98DF25) + h
                out.append(mix(np.array([one], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal for equal sets."""
    with np.errstate(over="ignore"):
        h = mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(h.view(np.int64)[0])


def _text_blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of bounded text with their sets."""
    for batch in batches:
        for at, texts in blocks_of(batch["text"]):
            yield batch.slice(at, len(texts)), shingle_sets(texts, words)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list array of 64-bit numbers."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


PRINTS = "id long, n long, node long, slice int, part int, counts binary"


def fingerprints(docs: DataFrame, id: str, like: Likeness) -> DataFrame:
    """A row of id, n and node (the set's name) for each text. Every task adds its counts of all n-grams, in rows of
    their own (slice, part, counts)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, schema = np.zeros(COUNTERS, np.int64), arrow_schema(PRINTS)
        for some, sets in _text_blocks(rows, like.words):
            items = np.concatenate([*sets, np.zeros(0, np.uint64)])
            counts += np.bincount(counter_of(items), minlength=COUNTERS)
            none = [pa.nulls(len(sets), schema.field(c).type) for c in ("slice", "part", "counts")]
            yield pa.RecordBatch.from_arrays([some["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.int64()), *none], schema=schema)
        if counts.any():
            task = TaskContext.get().partitionId()
            frame = pd.DataFrame({"slice": np.arange(SLICES), "part": task % 1024, "counts": [_narrow(c) for c in counts.reshape(SLICES, -1)]})
            yield pa.RecordBatch.from_pandas(frame.reindex(columns=schema.names), schema, preserve_index=False)

    return docs.select(F.col(id).cast("long").alias("id"), F.col("text")).mapInArrow(batches, PRINTS)


def counter_of(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def summed_counts(prints: DataFrame) -> np.ndarray:
    """The counters over all texts. Slices are summed in two steps, so that no group holds more than the square
    root of all tasks; the table that reaches the driver has a fixed size."""

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([_wide(c) for c in group["counts"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["part"].iloc[:1], "counts": [_narrow(total)]})

    schema = "slice int, part int, counts binary"
    sums = prints.filter("slice IS NOT NULL").select("slice", "part", "counts")
    sums = sums.groupBy("slice", "part").applyInPandas(summed, schema).groupBy("slice").applyInPandas(summed, schema)
    out = np.zeros((SLICES, COUNTERS // SLICES), "<u4")
    for r in sums.select("slice", "counts").collect():
        out[r["slice"]] = _wide(r["counts"])
    return out.reshape(-1)


def _narrow(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, np.iinfo(np.uint32).max).astype("<u4").tobytes(), 1)


def _wide(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), "<u4")


def rare_first(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``items`` (ascending) in the common order."""
    return items[np.argsort(counts[counter_of(items)], kind="stable")]


def overlap_of(n: Column, like: Likeness) -> Column:
    return F.floor((n * like.percent + 99) / 100)


# ---------------------------------------------------------------------------------------------
# the sieve


def sieve_rows(docs: DataFrame, like: Likeness, counts) -> DataFrame:
    """item, node and credit. A node sends the first n-grams of its set with credit 0. An n-gram of two or
    more nodes of one block is credited to them on the spot (in a row of their own) and sent once."""
    schema = "item long, node long, credit int"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _text_blocks(rows, like.words):
            sets = {_set_key(s): s for s in found if len(s)}
            if not sets:
                continue
            nodes = np.array(list(sets), np.int64)
            first = [rare_first(s, counts.value)[: like.prefix(len(s)) + like.extra(len(s)) - 1] for s in sets.values()]
            items, owner = np.concatenate(first), np.repeat(np.arange(len(nodes)), [len(f) for f in first])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            fresh = np.concatenate(([True], items[1:] != items[:-1]))
            shared = ~fresh | np.concatenate((~fresh[1:], [False]))
            credit = np.bincount(owner[shared], minlength=len(nodes))
            some = np.flatnonzero(credit)
            columns = (
                np.concatenate([items[fresh].view(np.int64), nodes[some]]),
                np.concatenate([nodes[owner[fresh]], nodes[some]]),
                np.concatenate([np.zeros(int(fresh.sum()), np.int32), credit[some].astype(np.int32)]),
            )
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=arrow_schema(schema))

    return docs.select("text").mapInArrow(batches, schema)


def sieve(docs: DataFrame, nodes: DataFrame, like: Likeness, counts) -> DataFrame:
    """id and node of the nodes (node, n, id) that may have a partner; id stands for the node."""
    item = Window.partitionBy("item")
    met = sieve_rows(docs, like, counts).withColumns({"low": F.min("node").over(item), "high": F.max("node").over(item)})
    credit = F.when(F.col("credit") > 0, F.col("credit")).when(F.col("low") != F.col("high"), 1).otherwise(0)
    credits = met.select("node", credit.alias("credit")).filter("credit > 0").groupBy("node").agg(F.sum("credit").alias("k"))
    partner = overlap_of(F.col("n"), like)
    least = F.floor((partner - overlap_of(partner, like) + 1 + 3) / 4)
    return credits.join(nodes, "node").filter(F.col("k") >= least).select("id", "node")


# ---------------------------------------------------------------------------------------------
# cores and classes


def sets_of(docs: DataFrame, like: Likeness) -> DataFrame:
    """node, n and items of each text's set."""
    schema = "node long, n long, items array<long>"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _text_blocks(rows, like.words):
            sets = [s for s in found if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], schema=arrow_schema(schema))

    return docs.select("text").mapInArrow(batches, schema)


def cores(sets: DataFrame, like: Likeness) -> DataFrame:
    """node, n and core of the nodes whose core can be most of a partner. An n-gram is named here by the magnitude of its
    count and 58 bits of its hash, so that an ascending core is rarest first."""
    rows = sets.select("node", F.explode("items").alias("item"))
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("item"))).filter("df > 1")
    key = F.shiftleft(F.floor(F.log2("df")).cast("long"), 58).bitwiseOR(F.shiftrightunsigned("item", 6))
    of_node = counted.select("node", key.alias("key")).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("core"))
    return of_node.join(sets.select("node", "n"), "node").filter(F.size("core") >= overlap_of(F.col("n"), like)).select("node", "n", "core")


def members(cored: DataFrame) -> DataFrame:
    """node, n, core and cls: the smallest node of equal core and size."""
    keyed = cored.select("node", "n", F.xxhash64("core").alias("x"), F.xxhash64(F.lit(1), "core").alias("y"))
    first = keyed.groupBy("n", "x", "y").agg(F.min("node").alias("cls"))
    return keyed.join(first, ["n", "x", "y"]).select("node", "n", "cls")


POSTINGS = "item long, cls long, n long, m long, pos long, early boolean, suffix array<int>"


def prefix_postings(classes: DataFrame, like: Likeness) -> DataFrame:
    """item, cls, n, m (size of the core), pos (from 0), early (whether that is enough for partners of n or more) and
    suffix (counts of the n-grams after pos in ranges of the hash space) of the prefixes."""
    shift = np.uint64(64 - RANGES.bit_length() + 1)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for cls, n, core in zip(batch["cls"].to_pylist(), batch["n"].to_pylist(), batch["core"], strict=True):
                items = core.values.to_numpy()
                p = like.prefix(n, len(items))
                kind = (mix(items.view(np.uint64)) >> shift).astype(np.int64)
                upto = np.cumsum(kind[:p, None] == np.arange(RANGES), axis=0)
                suffix = np.bincount(kind, minlength=RANGES) - upto
                columns = [pa.array(items[:p]), *(pa.array(np.full(p, x, np.int64)) for x in (cls, n, len(items))), pa.array(np.arange(p)), pa.array(np.arange(p) < like.early(n, len(items))), pa.ListArray.from_arrays(pa.array(np.arange(p + 1) * RANGES, pa.int32()), pa.array(suffix.reshape(-1).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(POSTINGS))

    return classes.select("cls", "n", "core").mapInArrow(batches, POSTINGS)


def distinct_lists(postings: DataFrame) -> DataFrame:
    """Postings without n-grams that no other prefix has. Of n-grams that the very same classes have, one stands
    for all: every pair of theirs meets there. It is the first in the order of cores, so its places are the earliest."""
    lists = postings.groupBy("item").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    kept = lists.filter("df > 1").groupBy("df", "x", "y").agg(F.min("item").alias("item")).select("item")
    return postings.join(kept, "item", "left_semi")


def ranked(postings: DataFrame) -> DataFrame:
    """``postings`` with rank (from 1, the turn of a member to be a centre of its list), before (the last ``CARRIED`` n-grams
    that the class has before) and unseen (how many come before those)."""
    own = Window.partitionBy("cls").orderBy("item")
    return postings.withColumns(
        {
            "rank": F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64("cls"), "cls")),
            "before": F.collect_list("item").over(own.rowsBetween(-CARRIED, -1)),
            "unseen": F.greatest(F.row_number().over(own) - 1 - CARRIED, F.lit(0)),
        }
    )


# ---------------------------------------------------------------------------------------------
# pairs


def _linked(common: Column, like: Likeness) -> Column:
    return common * 100 >= (F.col("na") + F.col("nb") - common) * like.percent


def _bounds(like: Likeness) -> Column:
    """Length, positional and suffix filter of a pair (a, b) that share an n-gram at their positions, and none of those
    carried from before; that of the smaller set, by id if they are equal, is an early one."""
    after = F.least(F.col("ma") - F.col("pa") - 1, F.col("mb") - F.col("pb") - 1)
    alike = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    head = F.least("pa", "pb", F.col("ua") + F.col("ub")) + 1
    length = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * like.percent
    early = F.when(F.struct("na", "a") < F.struct("nb", "b"), F.col("ea")).otherwise(F.col("eb"))
    return early & length & _linked(head + after, like) & ~F.arrays_overlap("ba", "bb") & _linked(head + alike, like)


def candidates(lists: DataFrame, done: int, centres: int, like: Likeness) -> DataFrame:
    """Each list's members against those of its centres that come before them and were none so far (``done`` were), as
    pairs a < b of two labels."""
    columns = ("n", "m", "pos", "early", "suffix", "label", "rank", "before", "unseen")
    side = lambda df, x: df.select("item", F.col("cls").alias(x), *(F.col(c).alias(f"{c[0]}{x}") for c in columns))
    new = lists.filter((F.col("rank") > done) & (F.col("rank") <= centres))
    met = side(lists.filter(F.col("rank") > done + 1), "a").join(side(new, "b"), "item").filter((F.col("ra") > F.col("rb")) & (F.col("la") != F.col("lb"))).filter(_bounds(like))
    swap = F.col("a") > F.col("b")
    ordered = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = met.select(ordered("a", "b", "a"), ordered("b", "a", "b"), ordered("la", "lb", "la"), ordered("lb", "la", "lb"))
    return pairs.dropDuplicates(["a", "b"])


def _sent(df: DataFrame, few: bool) -> DataFrame:
    """``df`` for all executors, if it has been counted as small."""
    return F.broadcast(df) if few else df


def verify(pairs: DataFrame, classes: DataFrame, like: Likeness, few: bool) -> DataFrame:
    """``pairs`` (a, b, la, lb) with linked, by their intersection. Classes of no pair stay where they are if pairs are few."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("core").alias(f"i{x}"))
    second = side("b").join(F.broadcast(pairs.select("b")), "b", "left_semi") if few else side("b")
    joined = side("a").join(_sent(pairs, few), "a").join(second, "b")
    return joined.select("a", "b", "la", "lb", _linked(F.size(F.array_intersect("ia", "ib")), like).alias("linked"))


def components(links: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """node and label (the smallest node reachable) of all nodes in ``links`` (la, lb). A turn spreads the
    smallest labels to neighbours three times, which is all that stars need, and then replaces every label
    by its own label, which halves the longest chains; turns end when the last spreading changed nothing. Few links
    are one partition, which nothing has to be shuffled for."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        table = scratch.table(df, name)
        return table.coalesce(1) if few else table

    pairs = links.coalesce(1) if few else links
    edges = kept(pairs.select(F.col("la").alias("u"), F.col("lb").alias("v")).union(pairs.select("lb", "la")).distinct(), "edges")
    gathered = lambda df: df.coalesce(1) if few else df
    labels = edges.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        before = labels
        for _ in range(3):
            before, sent = labels, edges.join(labels, edges.v == labels.node).select(F.col("u").alias("node"), "label")
            labels = gathered(labels.union(sent)).groupBy("node").agg(F.min("label").alias("label"))
        compared = kept(labels.join(before.withColumnRenamed("label", "old"), "node"), "labels")
        if compared.filter("label <> old").limit(1).count() == 0:
            return compared.select("node", "label")
        now = compared.select("node", "label")
        further = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = kept(now.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")


def group_classes(classes: DataFrame, postings: DataFrame, like: Likeness, scratch: Scratch) -> DataFrame:
    """cls, label of all classes in ``postings``; classes with one label are linked."""
    labels = scratch.table(postings.select("cls").distinct().withColumn("label", F.col("cls")), "groups")
    few_labels = labels.count() <= FEW_IDS
    postings = scratch.table(ranked(postings), "ranked")
    refused: DataFrame | None = None
    n_refused = turn = 0
    done: list[DataFrame] = [postings]  # tables of the round before, which the next lists are made of
    while True:
        # groups only grow: a list within one group is done with
        named = postings.join(_sent(labels, few_labels), "cls")
        spanning = named.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low <> high").select("item", "size")
        lists = scratch.table(named.join(spanning, "item"), "lists")
        scratch.drop(*done)
        longest = lists.agg(F.max("size")).first()[0]
        if longest is None:
            return labels
        pairs = candidates(lists, 8 ** (turn - 1) if turn else 0, 8**turn, like)
        if refused is not None:
            pairs = pairs.join(_sent(refused, n_refused <= FEW_PAIRS), ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, "pairs")
        done = [lists, pairs]
        n_pairs = pairs.count()
        if n_pairs:
            few = n_pairs <= FEW_PAIRS
            checked = scratch.table(verify(pairs, classes, like, few), "checked")
            now = checked.filter("NOT linked").select("a", "b")
            refused, n_refused = now if refused is None else refused.union(now), n_refused + n_pairs
            links = checked.filter("linked").select("la", "lb")
            if links.limit(1).count():
                merged = components(links, scratch, few).select(F.col("node").alias("label"), F.col("label").alias("new"))
                done.append(labels)
                labels = scratch.table(labels.join(_sent(merged, few), "label", "left").select("cls", F.coalesce("new", "label").alias("label")), "groups")
        if 8**turn >= longest:  # all members were centres
            scratch.drop(*done)
            return labels
        postings = lists.drop("label", "size")
        turn += 1


def jaccard_groups(docs: DataFrame, id: str = "doc_id", like: Likeness = Likeness()) -> DataFrame:
    """One row for each row of ``docs``: id (named as there), n_shingles, component_id (the smallest id that
    links reach, itself included)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    written = scratch.table(fingerprints(docs, id, like), "prints")
    prints = written.filter("slice IS NULL").select("id", "n", "node")
    counts = docs.sparkSession.sparkContext.broadcast(summed_counts(written))
    nodes = prints.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    keep = scratch.table(sieve(docs, nodes, like, counts), "sieve")
    ids = keep.select("id").distinct()
    left = docs.select(F.col(id).cast("long").alias("id"), "text")
    # a node of null ids alone has no id to be found by: its rows are all taken
    n_keep = keep.count()
    left = left.join(F.broadcast(ids) if n_keep <= FEW_IDS else ids, left["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = scratch.table(sets_of(left, like), "sets")
    if sets.count() > n_keep:  # ids repeat: rows of one set are brought together
        sets = scratch.table(sets.dropDuplicates(["node"]), "sets")
    cored = scratch.table(cores(sets, like), "cores")
    scratch.drop(sets)
    member = scratch.table(members(cored), "members")
    classes = scratch.table(cored.join(member.select("cls").distinct(), F.col("node") == F.col("cls")).select("cls", "n", "core"), "classes")
    scratch.drop(cored)
    postings = scratch.table(prefix_postings(classes, like), "postings")
    labels = group_classes(classes, distinct_lists(postings), like, scratch)
    # members of a class that is linked to itself or to another one share its label
    whole = F.size("core") * 100 >= (2 * F.col("n") - F.size("core")) * like.percent
    known = classes.select("cls", whole.alias("whole")).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    grown = known.groupBy("label").agg(F.count("*").alias("size"))
    known = known.join(grown, "label").filter(F.col("whole") | (F.col("size") > 1)).select("cls", "label")
    of_node = scratch.table(member.join(known, "cls").select("node", "label"), "labels")
    named = nodes.join(of_node, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min("id").alias("component_id"))
    found = scratch.table(named.join(groups, "label").select("node", "component_id"), "found")
    for table in (keep, member, classes, postings, of_node):
        scratch.drop(table)
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return prints.join(found, "node", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), own.alias("component_id"))
