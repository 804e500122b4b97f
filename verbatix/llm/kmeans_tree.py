"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

1. A tree is fitted on a sample of at most ``sample_rows`` vectors (those of smallest hash; the bound is
   documented and does not grow, and with it the number of leaves) by k-means in every node, until leaves stand for ``leaf_rows`` rows.
2. Every vector descends to one leaf; the table of vectors by leaf is the index.
3. A query walks the tree through a priority queue: the node of largest inner product with the query comes
   first, inner nodes push their children, leaves are visited in the order in which they come.
4. Calibration: for ``calibration_queries`` vectors that the tree was not fitted on the true neighbours are found by brute force over all
   rows, and leaf visits are widened until the neighbours found reach ``recall`` of the true ones.
5. Queries meet the rows of the leaves they visit in blocks (bin, part of its rows, part of its queries). A
   bin is some neighbouring leaves with a bounded number of rows together, or one larger leaf; both parts
   are bounded, so that a leaf with a third of all rows or of all visits is spread over tasks. Each block
   gives its best rows for each query, rescored in double precision in a fixed order; a window by query
   keeps the best of all.

Defined results: vectors that are null, of no or another length than the most common one, zero, or that
hold null or non-finite components take no part, nor do rows with a null id; rows with equal ids count as
one, with the smallest array; ties go to the smaller id; a query with fewer candidates gets them all; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

RESULT = "query_id long, vec_id long, score double"
#: Scores closer than this by BLAS are compared again in a fixed order of summation.
CLOSE = 1e-9


@dataclass(frozen=True)
class Settings:
    k: int = 20
    sample_rows: int = 1 << 14
    leaf_rows: int = 256
    branch: int = 8
    calibration_queries: int = 128
    recall: float = 0.97
    block_rows: int = 8192
    block_queries: int = 2048


@dataclass
class Tree:
    """centres[i] are the centres of node i's children; children[i] the nodes, or -1 - leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    n_leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the nearest centre."""
        leaf, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = nearest(x[rows], self.centres[node])
            for j, child in enumerate(self.children[node]):
                if len(own := rows[near == j]):
                    if child < 0:
                        leaf[own] = -1 - child
                    else:
                        todo.append((child, own))
        return leaf

    def visit(self, q: np.ndarray, leaves: int, size_of: np.ndarray, rows: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first; more until they hold ``rows`` rows."""
        if not self.centres:
            return [0]
        out: list[int] = []
        queue, held = [(0.0, 0)], 0
        while queue and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            if node < 0:
                if size_of[-1 - node]:
                    out.append(-1 - node)
                    held += int(size_of[-1 - node])
                continue
            for score, child in zip((self.centres[node] @ q).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-score, child))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        for j in range(k):
            if (own := near == j).any():
                centres[j] = x[own].mean(axis=0)
    return centres


def fit(sample: np.ndarray, n_rows: int, s: Settings) -> Tree:
    """A leaf is split while it stands for more than ``leaf_rows`` rows and has sample rows for its children."""
    tree, rng, share = Tree(), np.random.default_rng(7), n_rows / max(1, len(sample))

    def splits(rows: np.ndarray) -> bool:
        return len(rows) * share > s.leaf_rows and len(rows) >= 4 * s.branch

    if not splits(sample):
        tree.n_leaves = 1
        return tree
    tree.centres.append(None)
    tree.children.append([])
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        centres = kmeans(sample[rows], s.branch, rng)
        near = nearest(sample[rows], centres)
        used = [j for j in range(s.branch) if (near == j).any()]
        tree.centres[node] = centres[used]
        for j in used:
            own = rows[near == j]
            if splits(own) and len(used) > 1:
                tree.centres.append(None)
                tree.children.append([])
                tree.children[node].append(len(tree.centres) - 1)
                todo.append((len(tree.centres) - 1, own))
            else:
                tree.children[node].append(-1 - tree.n_leaves)
                tree.n_leaves += 1
    return tree


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v) for v in vectors]).astype(np.float64)


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    one = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    lengths = one.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return one.filter(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def best_rows(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the ids and exact scores of its best k rows, nearest first. ``allowed`` tells which
    rows a query may take."""
    rough = q @ x.T
    if allowed is not None:
        rough[~allowed] = -np.inf
    for i, scores in enumerate(rough):
        scores[x_ids == q_ids[i]] = -np.inf
        slack = CLOSE * (1 + np.abs(scores[np.isfinite(scores)]).max(initial=0.0))
        least = np.partition(scores, len(scores) - k)[len(scores) - k] - slack if len(scores) > k else -np.inf
        keep = np.flatnonzero((scores >= least) & (scores > -np.inf))
        exact = (x[keep] * q[i]).sum(axis=1)
        order = np.lexsort((x_ids[keep], -exact))[:k]
        yield i, x_ids[keep][order], exact[order]


def _frame(found) -> pd.DataFrame:
    found = [(np.full(len(ids), query), ids, scores) for query, ids, scores in found]
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def brute_force(queries: pd.DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score and leaf of the true neighbours of a stated, bounded set of queries."""
    q_ids, q = queries["vec_id"].to_numpy(), stack(queries["embedding"])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                ids = frame["vec_id"].to_numpy()
                yield _frame((int(q_ids[i]), own, s) for i, own, s in best_rows(q, q_ids, stack(frame["embedding"]), ids, k))

    return top(index.select("vec_id", "embedding").mapInPandas(batches, RESULT), k)


@dataclass
class Index:
    """Vectors by leaf (vec_id, embedding, leaf), their tree, and the visits that reached the recall."""

    rows: DataFrame
    tree: Tree
    sizes: np.ndarray
    visits: int
    recall: float
    settings: Settings


def build(vectors: DataFrame, s: Settings = Settings()) -> Index:
    good = materialise(clean(vectors), "vectors")
    n_rows = good.count()
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample_rows + s.calibration_queries).toPandas()
    held = min(s.calibration_queries, len(drawn) // 2)
    sample, queries = drawn.head(len(drawn) - held), drawn.tail(held)
    tree = fit(stack(sample["embedding"]), n_rows, s) if n_rows else Tree(n_leaves=1)
    shared = good.sparkSession.sparkContext.broadcast(tree)

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(leaf=shared.value.assign(stack(frame["embedding"])).astype(np.int32))

    kind = good.schema["embedding"].dataType.simpleString()
    rows = materialise(good.mapInPandas(leaves, f"vec_id long, embedding {kind}, leaf int"), "leaves")
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    visits, recall = calibrate(queries, rows, tree, sizes, s) if held else (1, 1.0)
    return Index(rows, tree, sizes, visits, recall, s)


def calibrate(queries: pd.DataFrame, rows: DataFrame, tree: Tree, sizes: np.ndarray, s: Settings) -> tuple[int, float]:
    """(leaf visits, recall reached): visits are widened by one until the recall is reached."""
    true = brute_force(queries, rows, s.k).select("query_id", "vec_id")
    found = true.join(rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()  # calibration_queries * k rows
    position = {int(i): {leaf: p for p, leaf in enumerate(tree.visit(q, tree.n_leaves, sizes, 0))} for i, q in zip(queries["vec_id"], stack(queries["embedding"]), strict=True)}
    needed = np.sort([position[i][leaf] + 1 for i, leaf in zip(found["query_id"].tolist(), found["leaf"].tolist(), strict=True)])
    visits = 1
    while (recall := np.searchsorted(needed, visits, "right") / len(needed)) < s.recall:
        visits += 1
    return visits, float(recall)


def bins_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bin of each leaf: leaves next to each other (numbered as the tree was split) while they have at
    most ``most`` rows together."""
    out, held, number = np.zeros(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            number, held = number + 1, 0
        out[leaf] = number
        held += n
    return out


def search(index: Index, queries: Column) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the neighbours of the index's rows for which ``queries`` holds."""
    s, spark = index.settings, index.rows.sparkSession
    bins = bins_of(index.sizes, s.block_rows)
    shared = spark.sparkContext.broadcast((index.tree, index.sizes, bins))
    visits, least, k = index.visits, 2 * index.settings.k + 1, index.settings.k
    kind = index.rows.schema["embedding"].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sizes, bins = shared.value
        for frame in frames:
            rows = []
            for query_id, query, q in zip(frame["vec_id"].tolist(), frame["embedding"], stack(frame["embedding"]) if len(frame) else [], strict=True):
                met = np.array(tree.visit(q, visits, sizes, least), np.int32)
                rows += [(query_id, query, int(b), met[bins[met] == b]) for b in np.unique(bins[met])]
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "query", "bin", "leaves"])

    walked = index.rows.filter(queries).select("vec_id", "embedding").mapInPandas(walk, f"query_id long, query {kind}, bin int, leaves array<int>")
    walked = materialise(walked, "visits")
    # a row for each bin, and one for each leaf: of bounded number
    asked = {r["bin"]: r["count"] for r in walked.groupBy("bin").count().collect()}
    held = np.bincount(bins, weights=index.sizes)
    parts = {b: (-(-int(held[b]) // s.block_rows), -(-n // s.block_queries)) for b, n in asked.items()}
    by_leaf = F.broadcast(spark.createDataFrame([(leaf, int(b), *parts[b]) for leaf, b in enumerate(bins.tolist()) if b in parts], "leaf int, bin int, row_parts int, query_parts int"))
    by_bin = F.broadcast(spark.createDataFrame([(int(b), *n) for b, n in parts.items()], "bin int, row_parts int, query_parts int"))
    part = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    all_parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.rows.join(by_leaf, "leaf").select("bin", part("vec_id", F.col("row_parts")).alias("r"), all_parts("query_parts").alias("q"), "vec_id", "embedding", "leaf")
    right = walked.join(by_bin, "bin").select("bin", part("query_id", F.col("query_parts")).alias("q"), all_parts("row_parts").alias("r"), "query_id", "query", "leaves")

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return _frame([])
        x, x_ids = stack(rows["embedding"]), rows["vec_id"].to_numpy()
        here, leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        found = []
        for at in range(0, len(asks), 128):
            some = asks.iloc[at : at + 128]
            ids = some["query_id"].to_numpy()
            visited = np.stack([np.isin(here, leaves) for leaves in some["leaves"]])
            found += [(int(ids[i]), own, scores) for i, own, scores in best_rows(stack(some["query"]), ids, x, x_ids, k, visited[:, leaf])]
        return _frame(found)

    block = ["bin", "r", "q"]
    met = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(meet, RESULT)
    return top(met, k).select("query_id", "rank", "vec_id", "score")
