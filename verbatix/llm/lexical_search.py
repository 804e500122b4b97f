"""Ranked lexical search, a document at a time, over compressed postings.

Documents are cut into shards of bounded size where they are read: no text is shuffled. In a shard they are numbered by
doc_id, and a term's postings (number, occurrences) are sorted by it, as differences in bytes of seven bits. A row of
the index holds the postings of a run of the shard's sorted terms.

A search takes queries in blocks. Their terms are looked up in all rows, document frequencies are summed, and the lists
of a shard meet in one task. Each query has a cursor for each of its terms; a heap gives the cursor that stands at the
smallest document, which moves on by a block of postings. Documents before all cursors are complete: their scores
are whole, and go to a heap of the best ``k``, by score, then doc_id. A task keeps these heaps over its shards; the best
of all tasks are merged by query. Integers throughout, but for the logarithm of a weight.

Defined results: a null text has no terms and is not counted; a row is a document, also where its doc_id repeats or is
null (after all others of the same score); a query row is a query, and one without terms finds nothing; without
documents nothing is found; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, give_back
from .terms import counted_terms

#: Bytes of text in a shard, one document at least, and most documents in one.
SHARD_BYTES, SHARD_DOCS = 1 << 23, 1 << 16
#: Terms and bytes of postings in a row of the index.
ROW_TERMS, ROW_BYTES = 1 << 14, 1 << 18
#: Postings by which a cursor moves on, and documents that are completed at once.
STEP, WINDOW = 512, 4096
#: Terms of the queries that are searched together.
BLOCK_TERMS = 1 << 17
INDEX = "shard long, part int, first string, last string, terms array<string>, counts array<int>, sizes array<int>, data binary, n_docs long, n_terms long"


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits, the lowest first and the last one below 128, and how many each value takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[has] + k] = part.astype(np.uint8) | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint8)
    return out, sizes


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = data < 128
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    parts = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return (np.add.reduceat(parts, starts) if len(data) else parts).astype(np.int64)


def _shard_rows(shard: int, ids: list, texts: pa.Array) -> Iterator[dict]:
    """The index rows of a shard: that of its documents (part -1), then those of its terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    texts = texts.take(pa.array(order, pa.int64()))
    terms, term, doc, count = counted_terms(texts)
    lengths = np.bincount(doc, count, minlength=len(ids)).astype(np.int64)
    known = np.array([[0 if ids[i] is None else ids[i] for i in order], [ids[i] is None for i in order], lengths], np.int64)
    empty = {"first": None, "last": None, "terms": [], "counts": [], "sizes": []}
    yield {**empty, "shard": shard, "part": -1, "data": known.tobytes(), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}
    if not len(term):
        return
    by_name = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[by_name] = np.arange(len(terms))
    sort = np.argsort(rank[term], kind="stable")
    term, doc, count = rank[term][sort], doc[sort], count[sort]
    begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    step = np.diff(doc, prepend=0)
    step[begins] = doc[begins]
    data, widths = pack_numbers(np.stack([step, count], 1).ravel())
    sizes = np.add.reduceat(widths, 2 * begins)
    counts, names = np.diff(np.append(begins, len(term))), terms.take(pa.array(by_name[term[begins]]))
    ends, start, part = np.cumsum(sizes), 0, 0
    while start < len(begins):
        before = ends[start - 1] if start else 0
        stop = min(start + ROW_TERMS, max(start + 1, int(np.searchsorted(ends, before + ROW_BYTES, "right"))))
        own = names.slice(start, stop - start)
        yield {"shard": shard, "part": part, "first": own[0].as_py(), "last": own[-1].as_py(), "terms": own, "counts": counts[start:stop], "sizes": sizes[start:stop], "data": data[before : ends[stop - 1]].tobytes(), "n_docs": 0, "n_terms": 0}
        start, part = stop, part + 1


_INDEX_TYPES = {"shard": pa.int64(), "part": pa.int32(), "first": pa.string(), "last": pa.string(), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "data": pa.binary(), "n_docs": pa.int64(), "n_terms": pa.int64()}


def _index_batch(row: dict) -> pa.RecordBatch:
    as_list = lambda c, t: pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c].cast(t.value_type) if isinstance(row[c], pa.Array) else pa.array(row[c], t.value_type))
    return pa.RecordBatch.from_arrays([as_list(c, t) if pa.types.is_list(t) else pa.array([row[c]], t) for c, t in _INDEX_TYPES.items()], list(_INDEX_TYPES))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId() << 32, 0
    ids: list = []
    texts: list[pa.Array] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ids, texts, held, made
        if ids:
            yield from map(_index_batch, _shard_rows(task + made, ids, pa.concat_arrays(texts)))
            ids, texts, held, made = [], [], 0, made + 1
            give_back()

    for batch in batches:
        names, column = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string())
        upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(names):
            before = upto[start - 1] if start else 0
            stop = min(start + SHARD_DOCS - len(ids), int(np.searchsorted(upto, before + SHARD_BYTES - held, "right")))
            stop = max(stop, start + (not ids))  # a document larger than a shard is one of its own
            if stop > start:
                # a copy, so that the batch does not stay
                ids, held = ids + names[start:stop], held + int(upto[stop - 1] - before)
                texts.append(pa.concat_arrays([column.slice(start, stop - start)]))
                start = stop
            if start < len(names) or len(ids) >= SHARD_DOCS:
                yield from flush()
    yield from flush()


@dataclass
class Index:
    """``rows`` has the columns of INDEX: a table in the shared folder, or one that was read from a folder."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, scratch: Scratch) -> Index:
    """The index of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_indexed, INDEX)
    with bounded_batches(docs.sparkSession):
        return opened(scratch.table(rows, "index"))


def opened(rows: DataFrame) -> Index:
    n, total = rows.filter("part = -1").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(rows, n or 0, total or 0)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(queries: DataFrame) -> Iterator[tuple[list[tuple], list[str]]]:
    """Blocks of (query number, {term number: occurrences}) and the terms, of bounded size, one query at least."""
    block, names = [], {}
    for row in queries.select("_no", "text").toLocalIterator():
        terms, numbers, _, counts = counted_terms(pa.array([row["text"]], pa.string()))
        wanted = {names.setdefault(terms[int(t)].as_py(), len(names)): int(c) for t, c in zip(numbers, counts, strict=True)}
        block.append((row["_no"], wanted))
        if len(names) >= BLOCK_TERMS:
            yield block, list(names)
            block, names = [], {}
    if block:
        yield block, list(names)


def _looked_up(names: list[str]):
    wanted = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard, part = batch.column("shard")[i].as_py(), batch.column("part")[i].as_py()
                data = batch.column("data")[i].as_buffer()
                if part < 0:
                    yield _found([shard], [-1], [0], [data.to_pybytes()])
                    continue
                numbers = pc.index_in(batch.column("terms")[i].values, wanted)
                at = np.flatnonzero(pc.is_valid(numbers).to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                sizes, counts = (batch.column(c)[i].values.to_numpy() for c in ("sizes", "counts"))
                ends = np.cumsum(sizes, dtype=np.int64)
                yield _found([shard] * len(at), numbers.take(pa.array(at)).to_pylist(), counts[at].tolist(), [data[int(ends[j] - sizes[j]) : int(ends[j])].to_pybytes() for j in at])

    return run


def _found(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "term", "df", "data"])


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, nameless: np.ndarray, best: list[tuple], k: int) -> None:
    """Merges the cursors of one query: ``lists`` has documents (ascending) and what the term adds to their scores.
    ``best`` is a heap of (score, not nameless, -doc_id), the worst first; the shard's best go there."""
    scores = np.zeros(len(names), np.int64)
    heap = [(int(docs[0]), i, 0) for i, (docs, _) in enumerate(lists)]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, at = heap[0]
        docs, adds = lists[i]
        scores[docs[at : at + STEP]] += adds[at : at + STEP]
        at += STEP
        if at < len(docs):
            heapq.heapreplace(heap, (int(docs[at]), i, at))
        else:
            heapq.heappop(heap)
        complete = heap[0][0] if heap else len(names)
        if complete - done >= WINDOW or not heap:
            offer(scores, done, complete, names, nameless, best, k)
            done = complete


def offer(scores: np.ndarray, start: int, stop: int, names: np.ndarray, nameless: np.ndarray, best: list[tuple], k: int) -> None:
    least = best[0][0] if len(best) == k else 1
    at = start + np.flatnonzero(scores[start:stop] >= max(least, 1))
    if len(at) > k:  # those of the k-th largest score or more
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    for j in at:
        entry = (int(scores[j]), not nameless[j], -int(names[j]))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)


def _searched(block: list[tuple], weights: dict[int, int], n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {no: [] for no, _ in block}
        shard = names = nameless = norm = None
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def finish() -> None:
            for no, wanted in block:
                own = [(lists[t][0], lists[t][1] * (weights[t] * c)) for t, c in wanted.items() if t in lists and weights[t]]
                if own:
                    best_of_shard(own, names, nameless, best[no], k)

        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "term", "data"))
            for here, term, data in zip(*columns, strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                if here.as_py() != shard:  # the row of its documents comes first
                    if shard is not None:
                        finish()
                    shard, lists = here.as_py(), {}
                    names, nameless, lengths = raw.view(np.int64).reshape(3, -1).copy()
                    norm = 12 * (75 + 25 * lengths * n_docs // max(n_terms, 1))
                    continue
                steps, tf = unpack_numbers(raw).reshape(-1, 2).T
                docs = np.cumsum(steps)
                lists[term.as_py()] = docs, 1_000_000_000 * tf // (1000 * tf + norm[docs])
        if shard is not None:
            finish()
        rows = [(no, None if not named else -minus, score) for no, heap in best.items() for score, named, minus in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["_no", "doc_id", "score"])
        give_back()

    return run


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = 20) -> DataFrame:
    """``queries`` (with a column text) joined to rank, doc_id and score of each query's ``k`` best documents; columns of
    these names are replaced."""
    numbered = scratch.table(queries.drop("rank", "doc_id", "score").withColumn("_no", F.monotonically_increasing_id()), "queries")
    out = None
    for block, names in _blocks(numbered):
        with bounded_batches(numbered.sparkSession):
            found = scratch.table(index.rows.mapInArrow(_looked_up(names), "shard long, term int, df long, data binary"), "found")
            # one row for each term of the block
            weights = {t: weight(index.n_docs, df) for t, df in found.filter("term >= 0").groupBy("term").agg(F.sum("df")).collect()}
            lists = found.select("shard", "term", "data").repartition("shard").sortWithinPartitions("shard", "term")
            hits = scratch.table(lists.mapInArrow(_searched(block, weights, index.n_docs, index.n_terms, k), "_no long, doc_id long, score long"), "hits")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = numbered.select("_no", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).filter("false")
    order = Window.partitionBy("_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return numbered.join(top, "_no").drop("_no")
