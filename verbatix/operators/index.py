"""Inverted index over passages: postings, lengths and statistics, and matching of query terms.

A passage is a row of (passage_id, document_id, group_id, ord, text, heading, is_navigation). Passages are
exploded into words, which are stemmed in place and counted by passage and term: one shuffle, with counts
combined before it, and no key that grows with the corpus.

A saved index keeps with each posting what a search needs of its passage (length, document, group, navigation),
sorted by term. The terms of one query are literals of its plan, so a search reads the row groups of these terms
and joins nothing. A table of queries is joined to the terms.

Where the queries are known before, ``of_texts`` makes the part of the index that they read: every word of every passage is
counted, by one pattern, but only words that can match become postings.

Null texts and headings have no words. A repeated passage_id counts as one passage with all the words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LEAST_PREFIX, is_term_col, n_terms_col, query_stems, query_stems_col, stem_col, stems, strip_accents_col, words_col, words_of_stems
from ..shared import materialise, spread


def words_of(passages: DataFrame) -> DataFrame:
    """passage_id, word and in_heading of every word that is a term."""
    fields = F.array(F.struct(F.coalesce("text", F.lit("")).alias("t"), F.lit(0).alias("in_heading")), F.struct(F.coalesce("heading", F.lit("")).alias("t"), F.lit(1).alias("in_heading")))
    rows = passages.select("passage_id", F.inline(fields)).filter("t <> ''")
    return rows.select("passage_id", "in_heading", F.explode(words_col(F.col("t"))).alias("word")).filter(is_term_col(F.col("word")))


def vocabulary(words: DataFrame) -> DataFrame:
    """word and term (its stem), one row for each distinct word."""
    return words.select("word").distinct().withColumn("term", stem_col(F.col("word")))


def postings(passages: DataFrame) -> DataFrame:
    """passage_id, term, in_text and in_heading (counts)."""
    count = lambda field: F.sum((F.col("in_heading") == field).cast("long"))
    return words_of(spread(passages)).groupBy("passage_id", stem_col(F.col("word")).alias("term")).agg(count(0).alias("in_text"), count(1).alias("in_heading"))


def passage_lengths(posted: DataFrame) -> DataFrame:
    """passage_id and dl, the tokens of text and heading."""
    return posted.groupBy("passage_id").agg(F.sum(F.col("in_text") + F.col("in_heading")).alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """term, df (passages that hold it) and p5 (its first five characters, by which prefixes are joined)."""
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("p5", F.substring("term", 1, LEAST_PREFIX))


def corpus_stats(passages: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: n_passages, n_tokens, avgdl. Passages without terms count."""
    n = passages.agg(F.countDistinct("passage_id").alias("n_passages"))
    total = lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
    return n.crossJoin(total).withColumn("avgdl", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_passages")))


LOCATED = ("dl", "document_id", "group_id", "is_navigation")


@dataclass
class Index:
    """The tables of an index. ``save`` and ``load`` keep them as Parquet. ``postings`` may have the columns LOCATED."""

    passages: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame

    TABLES = ("passages", "postings", "lengths", "terms", "stats")

    def located(self) -> DataFrame:
        """The postings with LOCATED."""
        if set(LOCATED) <= set(self.postings.columns):
            return self.postings
        places = self.passages.select("passage_id", "document_id", "group_id", "is_navigation").dropDuplicates(["passage_id"])
        return self.postings.join(self.lengths, "passage_id").join(places, "passage_id")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            table = self.located() if name == "postings" else getattr(self, name)
            if name in ("postings", "terms"):  # row groups of a narrow range of terms: scans skip the others
                table = table.repartitionByRange("term").sortWithinPartitions("term")
            elif name == "passages":  # so that the passages of a result are found by their ids
                table = table.repartitionByRange("passage_id").sortWithinPartitions("passage_id")
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))


def build(passages: DataFrame) -> Index:
    """Postings are written once and read by everything that derives from them."""
    posted = materialise(postings(passages), "postings")
    lengths = passage_lengths(posted)
    return Index(passages, posted, lengths, term_stats(posted), corpus_stats(passages, lengths))


def of_texts(passages: DataFrame, queries: Sequence[str], keywords: Sequence[str] = ()) -> Index:
    """The index of the terms that ``queries`` match and of the stems of ``keywords``: the same postings as those of ``build``
    for these terms, with LOCATED, and the lengths and statistics of all words. Texts are read once, and a row for each
    passage is shuffled: its length and the words that may match."""
    asked = {s for query in queries for s in query_stems(query)}
    prefixes = {s for s in asked if len(s) >= LEAST_PREFIX}
    exact = (asked - prefixes) | {s for keyword in keywords for s in stems(keyword)}
    pattern = words_of_stems(exact, prefixes)
    plain = lambda c: strip_accents_col(F.lower(F.coalesce(c, F.lit(""))))
    near = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0)) if pattern else F.array().cast("array<string>")
    texts = spread(passages).select("passage_id", "document_id", "group_id", "is_navigation", plain("text").alias("t"), plain("heading").alias("h"))
    rows = texts.select("passage_id", F.struct("document_id", "group_id", "is_navigation").alias("_place"), (n_terms_col(F.col("t")) + n_terms_col(F.col("h"))).alias("dl"), near("t").alias("_text"), near("h").alias("_heading"))
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    whole = rows.groupBy("passage_id").agg(F.min("_place").alias("_place"), F.sum("dl").alias("dl"), joined("_text"), joined("_heading"))
    whole = materialise(whole.select("passage_id", "_place.*", "dl", "_text", "_heading"), "scanned")
    stats = whole.agg(F.count("passage_id").alias("n_passages"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
    stats = materialise(stats.withColumn("avgdl", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_passages"))), "stats")
    # stems are made within the array: a filter over rows of words would be moved below them, with a copy of the rules for each stem
    stemmed = lambda c: F.transform(F.filter(c, is_term_col), stem_col)
    fields = F.array(*(F.struct(stemmed(c).alias("_terms"), F.lit(field).alias("field")) for field, c in enumerate(("_text", "_heading"))))
    found = whole.filter("passage_id IS NOT NULL AND size(_text) + size(_heading) > 0").select("passage_id", *LOCATED, F.inline(fields))
    meets = [F.col("term").isin(sorted(exact)), *(F.col("term").startswith(s) for s in sorted(prefixes))]
    terms = found.select("passage_id", *LOCATED, "field", F.explode("_terms").alias("term")).filter(reduce(or_, meets))
    count = lambda field: F.sum((F.col("field") == field).cast("long"))
    posted = terms.groupBy("passage_id", "term", *LOCATED).agg(count(0).alias("in_text"), count(1).alias("in_heading"))
    posted = materialise(posted, "postings")
    return Index(passages, posted, whole.filter("dl > 0").select("passage_id", "dl"), term_stats(posted), stats)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, q (position), stem, is_prefix and n_terms of the queries (query_id, query); queries
    without terms have no rows."""
    analysed = queries.select("query_id", query_stems_col(F.col("query")).alias("stems"))
    rows = analysed.select("query_id", F.size("stems").alias("n_terms"), F.posexplode("stems").alias("q", "stem"))
    return rows.select("query_id", "q", "stem", (F.length("stem") >= LEAST_PREFIX).alias("is_prefix"), "n_terms")


def expand(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, q, n_terms and every term of the vocabulary that the query term matches. Short stems
    match themselves; a prefix is joined on its first five characters, then compared."""
    exact = asked.filter("not is_prefix").join(terms, F.col("stem") == F.col("term")).select("query_id", "q", "n_terms", "term")
    prefix = asked.filter("is_prefix").withColumn("p5", F.substring("stem", 1, LEAST_PREFIX)).join(terms, "p5").filter(F.expr("startswith(term, stem)"))
    return exact.unionByName(prefix.select("query_id", "q", "n_terms", "term"))


def literal_hits(located: DataFrame, queries: Sequence[tuple]) -> DataFrame:
    """The postings of a few queries (query_id, query): their terms are literals that reach the scan, and nothing is joined."""
    meets = []
    for query_id, query in queries:
        asked = query_stems(query)
        for q, stem in enumerate(asked):
            meet = F.col("term").startswith(stem) if len(stem) >= LEAST_PREFIX else F.col("term") == stem
            meets.append((meet, F.struct(F.lit(query_id).alias("query_id"), F.lit(q).alias("q"), F.lit(len(asked)).alias("n_terms"))))
    none = F.struct(F.lit(queries[0][0]).alias("query_id"), F.lit(0).alias("q"), F.lit(0).alias("n_terms"))
    places = F.array_compact(F.array(*(F.when(m, place) for m, place in meets))) if meets else F.slice(F.array(none), 1, 0)
    found = located.filter(reduce(or_, [m for m, _ in meets], F.lit(False)))
    return found.select("passage_id", "in_text", "in_heading", *LOCATED, F.inline(places))


def joined_hits(located: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    return located.join(expand(terms, query_terms(queries)), "term")


#: Terms of a list of queries that are literals of a plan; longer lists are joined as a table.
MOST_LITERALS = 100


def as_table(spark: SparkSession, queries: Sequence[tuple]) -> DataFrame:
    kind = "string" if queries and isinstance(queries[0][0], str) else "int"
    return spark.createDataFrame(list(queries), f"query_id {kind}, query string")


def match(index: Index, queries: DataFrame | Sequence[tuple], heading_weight: float = 2.0) -> DataFrame:
    """query_id, passage_id, score (BM25, k1 1.2, b 0.75, two weighted fields), coverage (query terms
    found in the text itself), n_terms and LOCATED without dl, for every passage that holds a query term in any
    field. ``queries`` is a table (query_id, query), or a list of a few such pairs.

    A query term's document frequency counts passages that hold any of its expansions; one held by half of
    the passages or more weighs 1e-6."""
    located = index.located()
    if not isinstance(queries, DataFrame) and sum(len(query_stems(query)) for _, query in queries) > MOST_LITERALS:
        queries = as_table(located.sparkSession, queries)
    table = isinstance(queries, DataFrame)
    hits = joined_hits(located, index.terms, queries) if table else literal_hits(located, queries)
    # a passage has one place and a query one number of terms: as keys they cost no sort
    found = hits.groupBy("query_id", "passage_id", "q", "n_terms", *LOCATED).agg(
        F.sum(F.col("in_text") + heading_weight * F.col("in_heading")).alias("tf"),
        F.max((F.col("in_text") > 0).cast("int")).alias("covers"),
    )
    n = found.groupBy("query_id", "q").agg(F.count("*").alias("n"))
    # one row of statistics; the query side has a row for each query term
    weights = n.crossJoin(F.broadcast(index.stats.select("n_passages", "avgdl")))
    raw = F.ln((F.col("n_passages") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = weights.select("query_id", "q", F.greatest(raw, F.lit(1e-6)).alias("idf"), "avgdl")
    weights = weights if table else F.broadcast(weights)  # a row for each literal
    tf, k1 = F.col("tf"), 1.2
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = found.join(weights, ["query_id", "q"]).withColumn("part", part)
    return scored.groupBy("query_id", "passage_id", "n_terms", *LOCATED[1:]).agg(F.sum("part").alias("score"), F.sum("covers").cast("int").alias("coverage"))
