"""Toxicity of texts by their nearest labelled examples.

A term is a word or the beginning of one (3, 4 or 6 characters), at least once, twice or four times in a text. Terms that
are typical of toxic texts are found on a bounded sample of labelled rows: far more toxic texts hold them than chance
gives over as many terms (G statistic), and more than half of the texts that hold them are toxic, even at the lower
bound of the interval. A text is the vector of these terms' tf-idf weights; document frequencies are counted over
all documents. The nearest examples by cosine are found exactly with a block-max index: examples are numbered and cut into
blocks, a term keeps its largest weight in each block, blocks are visited by the bound that these give, and the search
ends at the first block that cannot change the result. Examples vote, the nearer the heavier. Rows that are neither
examples nor held out calibrate the votes (isotonic), and the texts that no example is near to.

Defined results: a null or empty text has no terms, and the score of texts without neighbours; repeated rows are scored
each; of labels that contradict each other for a doc_id, and of null ones, none counts; without any label all scores are
0; equally near examples go by their number (heaviest terms, then doc_id); a null doc_id is held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, give_back, spans
from .terms import counted_terms

#: The most labelled rows that are learnt from (those of the smallest hash), and the most terms that are kept.
LEARN_ROWS, TERMS = 20_000, 1024
#: Characters of the beginnings of words that are terms (0: the whole word), and how often they have to stand in a text.
KINDS, LEVELS = (0, 3, 4, 6), (1, 2, 4)
#: Chance of keeping a term that is not typical; the bound of the share of toxic texts is that of 95 %.
CHANCE, Z = 0.05, 1.96
NEIGHBOURS = 16
#: Examples in a block of the index.
BLOCK = 32


def fold(doc_id: Column) -> Column:
    """0 is held out, 1 to 3 are examples, 4 calibrates."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)).cast("int")


def learning_rows(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic and fold of at most ``most`` rows that may be learnt from."""
    known = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_other")).filter("toxic = _other")
    return known.withColumn("fold", fold(F.col("doc_id"))).filter("fold > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic", "fold")


def beginnings(words: pa.Array, kind: int) -> pa.Array:
    """The first ``kind`` characters, null of shorter words; whole words for 0."""
    return words if kind == 0 else pc.if_else(pc.greater_equal(pc.utf8_length(words), kind), pc.utf8_slice_codeunits(words, 0, kind), pa.scalar(None, words.type))


def summed(number: np.ndarray, text: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, text, sum of counts) for each pair; numbers below 0 do not count."""
    kept = number >= 0
    keys, at = np.unique(number[kept] * texts + text[kept], return_inverse=True)
    return keys // texts, keys % texts, np.bincount(at, count[kept], minlength=len(keys)).astype(np.int64)


_BY_TERM = {"kind": pa.int32(), "name": pa.string(), "level": pa.int32(), "n_toxic": pa.int64(), "n_clean": pa.int64()}


def _texts_by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, name and level of a term, and how many toxic and clean texts of a block hold it."""
    for batch in batches:
        texts, toxic = batch.column("text"), batch.column("toxic").to_numpy()
        for start, stop in spans(texts, 1 << 22):
            words, word, text, count = counted_terms(texts.slice(start, stop - start))
            for kind in KINDS:
                coded = beginnings(words, kind).dictionary_encode()
                number, of_text, total = summed(pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[word], text, count, stop - start)
                for level in LEVELS:
                    has = total >= level
                    n = np.bincount(number[has], minlength=len(coded.dictionary))
                    n_toxic = np.bincount(number[has], toxic[start:stop][of_text[has]], minlength=len(n)).astype(np.int64)
                    there = np.flatnonzero(n)
                    same = [pa.array(np.full(len(there), x), pa.int32()) for x in (kind, level)]
                    names = coded.dictionary.take(pa.array(there)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([same[0], names, same[1], pa.array(n_toxic[there]), pa.array((n - n_toxic)[there], pa.int64())], list(_BY_TERM))
    give_back()


Term = tuple[int, str, int]


def typical_terms(learn: DataFrame, most: int, scratch: Scratch) -> list[Term]:
    """At most ``most`` terms as (kind, name, level), the most telling first. ``learn`` has text and toxic; equal texts count once."""
    once = scratch.table(learn.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "learn")
    n = once.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = n[0], n[1] - n[0]
    if not toxic or not clean:
        return []
    counts = scratch.table(once.mapInArrow(_texts_by_term, "kind int, name string, level int, n_toxic long, n_clean long").groupBy("kind", "name", "level").agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("b")), "counts")
    least = 2 * math.log(max(counts.count(), 1) / CHANCE)
    a, b, share = F.col("a"), F.col("b"), toxic / (toxic + clean)
    both = a + b
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    g = 2 * (part(a, both * share) + part(b, both * (1 - share)) + part(toxic - a, toxic - both * share) + part(clean - b, clean - both * (1 - share)))
    p, zz = a / both, Z * Z
    lower = (p + zz / (2 * both) - Z * F.sqrt(p * (1 - p) / both + zz / (4 * both * both))) / (1 + zz / both)
    kept = counts.filter("a > 1").withColumn("g", F.round(g, 6)).filter((F.col("g") >= least) & (lower > 0.5))
    return [(r["kind"], r["name"], r["level"]) for r in kept.orderBy(F.col("g").desc(), "kind", "name", "level").limit(most).collect()]


def term_counts(docs: DataFrame, terms: list[Term], text: str = "text") -> DataFrame:
    """``docs`` without its text, with numbers and counts of the terms that it holds."""
    wanted = {kind: sorted({name for k, name, _ in terms if k == kind}) for kind in KINDS}
    number_of = {term: n for n, term in enumerate(terms)}
    # by kind and level: the term of each name, or -1
    numbers = {(kind, level): np.array([number_of.get((kind, name, level), -1) for name in wanted[kind]], np.int64) for kind in KINDS for level in LEVELS}

    @F.arrow_udf("struct<terms: array<int>, counts: array<int>>")
    def counted(texts: pa.Array) -> pa.Array:
        parts = []
        for start, stop in spans(texts, 1 << 22):
            words, word, of_word, count = counted_terms(texts.slice(start, stop - start))
            found = [(np.zeros(0, np.int64),) * 3]
            for kind, names in wanted.items():
                if names:
                    name = pc.fill_null(pc.index_in(beginnings(words, kind), pa.array(names, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    name, text, total = summed(name[word], of_word, count, stop - start)
                    for level in LEVELS:
                        term = numbers[kind, level][name]
                        has = (total >= level) & (term >= 0)
                        found.append((term[has], text[has], total[has]))
            term, text, total = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((term, text))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=stop - start)))), pa.int32())
            parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (term, total)], ["terms", "counts"]))
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    base = docs.drop("terms", "counts")
    found = base.withColumn("_found", counted.asNondeterministic()(F.col(f"`{text}`")))
    return found.select(*(F.col(f"`{c}`") for c in base.columns if c != text), "_found.*")


@dataclass
class BlockMax:
    """Unit vectors of numbered examples: postings by term, and each term's largest weight in each block."""

    size: int
    firsts: np.ndarray  # by term and block: where its postings begin
    places: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # by term and block

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMax:
        blocks = -(-len(vectors) // BLOCK)
        lengths = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        place = np.repeat(np.arange(len(vectors)), lengths)
        order = np.lexsort((place, term))
        term, weight, place = term[order], weight[order], place[order]
        cells = term * blocks + place // BLOCK
        most = np.zeros(n_terms * blocks)
        np.maximum.at(most, cells, weight)
        firsts = np.searchsorted(cells, np.arange(n_terms * blocks + 1))
        return cls(len(vectors), firsts, place, weight, most.reshape(n_terms, blocks))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of the ``k`` examples of largest cosine above 0, ties to the smaller number. Bounds are summed in
        the order of the scores, and rounding keeps order, so no bound is below a score of its block."""
        blocks = self.most.shape[1]
        bound = np.zeros(blocks)
        for t, w in zip(terms, weights, strict=True):
            bound += w * self.most[t]
        numbers, scores = np.zeros(0, np.int64), np.zeros(0)
        for block in np.lexsort((np.arange(blocks), -bound)):
            full = len(numbers) == k
            if bound[block] <= 0 or (full and (bound[block] < scores[-1] or (bound[block] == scores[-1] and block > numbers[-1] // BLOCK))):
                if bound[block] <= 0 or bound[block] < scores[-1]:
                    break
                continue
            if visited is not None:
                visited.append(int(block))
            here = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                start, stop = self.firsts[t * blocks + block], self.firsts[t * blocks + block + 1]
                here[self.places[start:stop] - block * BLOCK] += w * self.weights[start:stop]
            found = np.flatnonzero(here > 0)
            numbers, scores = np.concatenate((numbers, found + block * BLOCK)), np.concatenate((scores, here[found]))
            best = np.lexsort((numbers, -scores))[:k]
            numbers, scores = numbers[best], scores[best]
        return numbers, scores


@dataclass
class Model:
    terms: list[Term]
    idf: np.ndarray
    index: BlockMax
    examples: np.ndarray  # doc_id by number
    toxic: np.ndarray
    #: Votes and the scores that they stand for, and the score of a text that no example is near to.
    votes: np.ndarray
    scores: np.ndarray
    alone: float

    def vector(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return unit_vector(terms, counts, self.idf)

    def vote(self, terms: list[int], counts: list[int]) -> tuple[float | None, np.ndarray, np.ndarray]:
        """(toxic votes, of all and one more, or None; numbers and cosines of the nearest examples). An example votes with
        its cosine: far ones, however alike in their label, do not outweigh the one vote that is always clean."""
        if not len(terms):
            return None, np.zeros(0, np.int64), np.zeros(0)
        numbers, near = self.index.nearest(*self.vector(terms, counts), NEIGHBOURS)
        return float((near * self.toxic[numbers]).sum() / (near.sum() + 1)) if len(numbers) else None, numbers, near

    def score(self, vote: float | None) -> float:
        return self.alone if vote is None else float(np.interp(vote, self.votes, self.scores))


def unit_vector(terms: list[int], counts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = np.asarray(terms, np.int64)
    weight = (1 + np.log(np.asarray(counts, np.float64))) * idf[number]
    return number, weight / np.sqrt((weight * weight).sum())


def heaviest_first(terms: np.ndarray, weights: np.ndarray) -> list[int]:
    """The order by which examples are numbered: those of the same heaviest terms share blocks, so that few blocks have high bounds."""
    return terms[np.lexsort((terms, -weights))].tolist()


def isotonic(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising scores of votes: neighbours that are out of order are pooled. A clean row of vote 0 and a toxic one of vote 1 are
    added, so that without rows a score is its vote."""
    votes, toxic = np.append(votes, (0.0, 1.0)), np.append(toxic, (0.0, 1.0))
    pools: list[list[float]] = []  # rows, sum of votes, toxic rows
    for v in np.unique(votes):
        own = votes == v
        pools.append([float(own.sum()), float(v * own.sum()), float(toxic[own].sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    n, v, t = np.array(pools).T
    return v / n, np.clip(t / n, 0.001, 0.999)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, learn_rows: int = LEARN_ROWS, most_terms: int = TERMS) -> tuple[Model, DataFrame]:
    """The model, and all ``docs`` (doc_id, text) as doc_id, terms and counts."""
    learn = scratch.table(learning_rows(labels, learn_rows), "sample")
    # at most learn_rows rows
    own = docs.join(F.broadcast(learn), "doc_id")
    terms = typical_terms(own.filter("fold < 4"), most_terms, scratch)
    counted = scratch.table(term_counts(docs.select("doc_id", "text"), terms), "counted")
    n_docs = counted.count()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most most_terms rows
    idf = np.array([1 + math.log((1 + n_docs) / (1 + df.get(t, 0))) for t in range(len(terms))])
    # at most learn_rows rows of labels, with all rows of documents that bear their numbers
    near = scratch.table(counted.filter(F.size("terms") > 0).join(F.broadcast(learn), "doc_id"), "near")
    rows = near.filter("fold < 4").orderBy("doc_id", "terms", "counts").limit(learn_rows).collect()
    rows.sort(key=lambda r: heaviest_first(*unit_vector(r["terms"], r["counts"], idf)))  # stable: equal ones by doc_id
    vectors = [unit_vector(r["terms"], r["counts"], idf) for r in rows]
    examples, toxic = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.float64)
    model = Model(terms, idf, BlockMax.of(vectors, len(terms)), examples, toxic, np.zeros(0), np.zeros(0), 0.0)

    share = learn.agg(F.avg("toxic")).first()[0] or 0.0
    judged = near.filter("fold = 4").orderBy("doc_id", "terms", "counts").limit(learn_rows).mapInArrow(_voted(model), "doc_id long, vote double").join(F.broadcast(learn), "doc_id").filter("vote IS NOT NULL")
    judged = np.array([(r["vote"], r["toxic"]) for r in judged.select("vote", "toxic").collect()], np.float64).reshape(-1, 2)
    model.votes, model.scores = isotonic(judged[:, 0], judged[:, 1])
    alone = counted.filter(F.size("terms") == 0).join(F.broadcast(learn), "doc_id").filter("fold = 4").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    model.alone = min(0.999, (alone[0] + share) / (alone[1] + 1))
    return model, counted


def _voted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda key: model.vote(*key)[0], 50_000)
        for batch in batches:
            keys = zip(map(tuple, batch.column("terms").to_pylist()), map(tuple, batch.column("counts").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([known[k] for k in keys], pa.float64())], ["doc_id", "vote"])

    return run


SCORED = "doc_id long, score double, evidence array<long>, nearness array<double>, terms array<string>"


def shown(term: Term) -> str:
    kind, name, level = term
    return name + "*" * (kind > 0) + f" x{level}" * (level > 1)


def _scored(model: Model):
    def judge(key: tuple) -> tuple:
        vote, numbers, near = model.vote(*key)
        return model.score(vote), model.examples[numbers].tolist(), near.tolist(), [shown(model.terms[t]) for t in key[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(judge, 50_000)
        kinds = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()))
        for batch in batches:
            keys = zip(map(tuple, batch.column("terms").to_pylist()), map(tuple, batch.column("counts").to_pylist()), strict=True)
            rows = [known[k] for k in keys]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["doc_id", "score", "evidence", "nearness", "terms"])

    return run


def score(model: Model, counted: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and what speaks for it: numbers of the nearest examples, their cosines, and the typical
    terms that the text holds."""
    scored = counted.select("doc_id", "terms", "counts").mapInArrow(_scored(model), SCORED)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "nearness", "terms")
