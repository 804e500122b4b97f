"""Block-max index: the best passages of many queries without scoring every posting.

Terms are numbered in sorted order. The dictionary keeps them front-coded, a row for each run of terms; a few of the runs'
first terms separate ranges, and a query term meets only the runs of its range. A prefix becomes an interval of term
numbers, however many terms it covers.

Passages are numbered by document. A row of ``blocks`` holds the postings of one term in one block of passages, with
the largest counts and the smallest length among them. Tables are bucketed (``blocks`` by ranges of term numbers, ``places`` by
block), so that a batch of any number of queries joins without a shuffle of either.

A search goes twice over the blocks that hold a query's terms. First their bounds are summed; those of the highest bounds
are scored, and the score of the last candidate is a limit. Then only the blocks whose bound reaches it are scored. A
single term is bounded by what its blocks store, and its postings are not looked at before. Those of a prefix have to be
merged, once for all queries, as the passages that hold any of its terms are counted; its bound is then exact.

Null texts and headings have no words; a repeated passage_id counts as one passage, with the metadata of its smallest row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import Scratch
from .index import Index, query_terms

#: Passages in a block, terms in a run of the dictionary, term numbers in a bin, and the most separators.
BLOCK, RUN, BIN, SEPARATORS = 64, 256, 1024, 1024
#: Blocks that are scored for the limit, beside one for each candidate: the best may lie apart.
FIRST_BLOCKS = 2


def numbered(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with their number in the order, from 0 and without gaps: the number in the range and the rows of the ranges
    before, of which there is a row for each task."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = scratch.table(ranges.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    parts = ranges.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", (before - F.col("_first")).alias("_shift"))
    return ranges.join(parts, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def front_coded(terms: Column) -> Column:
    """array<struct<shared, rest>>: how many characters a term shares with the one before, and what follows."""

    def coded(term: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(terms, F.greatest(i, F.lit(1)))).otherwise("")
        lengths = F.sequence(F.lit(0), F.least(F.length(term), F.length(before)))
        shared = F.array_max(F.filter(lengths, lambda k: F.substr(term, F.lit(1), k) == F.substr(before, F.lit(1), k)))
        return F.struct(shared.alias("shared"), F.substr(term, shared + 1).alias("rest"))

    return F.transform(terms, coded)


def decoded(rests: Column) -> Column:
    """The terms of a run."""
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("terms"))

    def step(acc: Column, x: Column) -> Column:
        term = F.concat(F.substr(acc["last"], F.lit(1), x["shared"]), x["rest"])
        return F.struct(term.alias("last"), F.array_append(acc["terms"], term).alias("terms"))

    return F.aggregate(rests, start, step, lambda acc: acc["terms"])


def dictionary(terms: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(runs, separators) of numbered terms (term, term_no)."""
    run = F.floor(F.col("term_no") / RUN).cast("long")
    gathered = terms.groupBy(run.alias("run")).agg(F.min("term").alias("first"), F.max("term").alias("last"), F.min("term_no").alias("first_no"), F.sort_array(F.collect_list("term")).alias("_terms"))
    runs = scratch.table(gathered.withColumn("rests", front_coded(F.col("_terms"))).drop("_terms"), "runs")
    step = F.greatest(F.lit(1), F.ceil(F.count("*") / SEPARATORS)).cast("long")
    step = runs.agg(step.alias("step"))  # one row
    runs = runs.join(F.broadcast(step)).withColumn("range", F.floor(F.col("run") / F.col("step")).cast("int"))
    separators = runs.filter("run % step = 0").agg(F.sort_array(F.collect_list("first")).alias("separators"))
    return scratch.table(runs.drop("step", "run"), "dictionary"), scratch.table(separators, "separators")


def posting_blocks(posted: DataFrame, terms: DataFrame, places: DataFrame) -> DataFrame:
    """bin, term_no, block, n, most_text, most_heading, least_dl and hits (by passage number in the block)."""
    rows = posted.join(terms, "term").join(places.select("passage_id", "block", "no"), "passage_id")
    hit = F.struct("no", F.col("in_text").cast("int").alias("in_text"), F.col("in_heading").cast("int").alias("in_heading"), F.col("dl").cast("int").alias("dl"))
    grouped = rows.withColumn("_hit", hit).groupBy("term_no", "block")
    most = [F.max(c).cast("int").alias(f"most_{c[3:]}") for c in ("in_text", "in_heading")]
    cut = grouped.agg(F.count("*").cast("int").alias("n"), *most, F.min("dl").cast("int").alias("least_dl"), F.sort_array(F.collect_list("_hit")).alias("hits"))
    return cut.withColumn("bin", F.floor(F.col("term_no") / BIN).cast("long"))


_BUCKETED = {"blocks": ("bin", "term_no"), "places": ("block", "no")}


@dataclass
class BlockIndex:
    """The tables of a block-max index; ``save`` and ``load`` keep them as Parquet, bucketed where _BUCKETED says so."""

    passages: DataFrame
    dictionary: DataFrame
    separators: DataFrame
    blocks: DataFrame
    places: DataFrame
    stats: DataFrame

    TABLES = ("passages", "dictionary", "separators", "blocks", "places", "stats")

    @classmethod
    def of(cls, index: Index) -> BlockIndex:
        scratch = Scratch(index.postings.sparkSession, "blockmax")
        terms = numbered(index.terms.select("term"), ["term"], "term_no", scratch)
        meta = F.min(F.struct("document_id", "group_id", "is_navigation")).alias("_meta")
        places = numbered(index.passages.groupBy("passage_id").agg(meta).select("passage_id", "_meta.*"), ["document_id", "passage_id"], "place", scratch)
        places = scratch.table(places.select(F.floor(F.col("place") / BLOCK).cast("long").alias("block"), (F.col("place") % BLOCK).cast("int").alias("no"), "passage_id", "document_id", "group_id", "is_navigation"), "places")
        posted = index.postings if "dl" in index.postings.columns else index.postings.join(index.lengths, "passage_id")
        blocks = scratch.table(posting_blocks(posted.select("passage_id", "term", "in_text", "in_heading", "dl"), terms, places), "blocks")
        return cls(index.passages, *dictionary(terms, scratch), blocks, places, index.stats)

    def save(self, path: str, buckets: int | None = None) -> None:
        spark = self.blocks.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name in self.TABLES:
            table = getattr(self, name)
            if name in _BUCKETED:
                by, then = _BUCKETED[name]
                own = f"saved_{uuid.uuid4().hex}"
                table.repartition(n, by).write.bucketBy(n, by).sortBy(then).option("path", f"{path}/{name}").mode("overwrite").format("parquet").saveAsTable(own)
                spark.sql(f"DROP TABLE {own}")  # the files stay
            else:
                table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(n,)], "buckets int").write.mode("overwrite").parquet(f"{path}/buckets")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        n = spark.read.parquet(f"{path}/buckets").first()[0]
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}
        for name, (by, then) in _BUCKETED.items():
            own = f"loaded_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables[name].schema.fields)
            spark.sql(f"CREATE TABLE {own} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{then}`) INTO {n} BUCKETS LOCATION '{path}/{name}'")
            tables[name] = spark.table(own)
        return cls(**tables)

    def intervals(self, stems: DataFrame) -> DataFrame:
        """stem, low and high: the numbers of the terms that a stem (stem, is_prefix) matches, ``high`` excluded. Stems that
        match nothing have no row."""
        stem = F.col("stem")
        upto = lambda text: F.size(F.filter("separators", lambda s: s <= text))
        # terms are of a-z and 0-9: all that begin with a stem lie below it and a brace
        last = F.when(F.col("is_prefix"), upto(F.concat(stem, F.lit("{")))).otherwise(upto(stem))
        ranges = stems.join(F.broadcast(self.separators)).withColumn("range", F.explode(F.sequence(F.greatest(upto(stem), F.lit(1)), F.greatest(last, F.lit(1))))).withColumn("range", F.col("range") - 1).drop("separators")
        near = ranges.join(self.dictionary, "range").filter((F.col("last") >= stem) & ((F.col("first") <= stem) | (F.col("is_prefix") & F.startswith("first", stem))))
        terms = near.withColumn("_terms", decoded(F.col("rests")))
        matches = lambda t: F.when(F.col("is_prefix"), F.startswith(t, stem)).otherwise(t == stem)
        low = F.col("first_no") + F.size(F.filter("_terms", lambda t: t < stem))
        pieces = terms.select("stem", low.alias("_low"), F.size(F.filter("_terms", matches)).alias("_n")).filter("_n > 0")
        return pieces.groupBy("stem").agg(F.min("_low").alias("low"), F.max(F.col("_low") + F.col("_n")).alias("high"))


@dataclass
class Search:
    """The state of one batch: ``asked`` terms, ``found`` blocks of single terms, the ``merged`` postings of prefixes, ``weights``
    of stems, and the ``bounds`` of the blocks of each query."""

    index: BlockIndex
    scratch: Scratch
    heading_weight: float
    asked: DataFrame
    found: DataFrame
    merged: DataFrame
    weights: DataFrame
    bounds: DataFrame

    @classmethod
    def of(cls, index: BlockIndex, queries: DataFrame, heading_weight: float) -> Search:
        scratch = Scratch(index.blocks.sparkSession, "search")
        asked = scratch.table(query_terms(queries), "asked")
        bins = index.intervals(asked.select("stem", "is_prefix").distinct()).withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))))
        rows = matching_blocks(index, bins)
        single = F.col("high") - F.col("low") == 1
        found = scratch.table(rows.select("stem", "block", single.alias("single"), "n", "most_text", "most_heading", "least_dl", "hits"), "found")
        several = found.filter("not single").select("stem", "block", F.inline("hits"))
        merged = several.groupBy("stem", "block", "no").agg(F.sum(weighed(heading_weight)).alias("tf"), F.max((F.col("in_text") > 0).cast("int")).alias("covers"), F.first("dl").alias("dl"))
        merged, found = scratch.table(merged, "merged"), found.filter("single").drop("single")
        stats = index.stats.select("n_passages", "avgdl")  # one row
        n = found.groupBy("stem").agg(F.sum("n").alias("n")).unionByName(merged.groupBy("stem").agg(F.count("*").alias("n"))).join(F.broadcast(stats))
        idf = F.greatest(F.ln((F.col("n_passages") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
        weights = scratch.table(n.select("stem", idf.alias("idf"), "avgdl"), "weights")
        most = found.select("stem", "block", (F.col("most_text") + heading_weight * F.col("most_heading")).alias("tf"), F.col("least_dl").alias("dl"))
        per_stem = most.unionByName(merged.select("stem", "block", "tf", "dl")).join(weights, "stem").groupBy("stem", "block").agg(F.max(part()).alias("bound"))
        bounds = asked.join(per_stem, "stem").groupBy("query_id", "block").agg(F.sum("bound").alias("bound"))
        return cls(index, scratch, heading_weight, asked, found, merged, weights, scratch.table(bounds, "bounds"))

    def scored(self, pairs: DataFrame, group_id: str | None, tagged: DataFrame | None) -> DataFrame:
        """query_id, score, coverage, n_terms and the metadata of every passage of ``pairs`` (query_id, block) that holds a
        term of the query and passes the filters."""
        wanted = pairs.select("query_id", "block").join(self.asked.select("query_id", "stem", "n_terms"), "query_id")
        blocks = wanted.select("stem", "block").distinct()
        single = self.found.join(blocks, ["stem", "block"], "left_semi").select("stem", "block", F.inline("hits"))
        single = single.select("stem", "block", "no", weighed(self.heading_weight).alias("tf"), (F.col("in_text") > 0).cast("int").alias("covers"), "dl")
        tf = single.unionByName(self.merged.join(blocks, ["stem", "block"], "left_semi"))
        parts = tf.join(self.weights, "stem").select("stem", "block", "no", "covers", part().alias("part"))
        sums = wanted.join(parts, ["stem", "block"]).groupBy("query_id", "block", "no").agg(F.sum("part").alias("score"), F.sum("covers").cast("int").alias("coverage"), F.first("n_terms").alias("n_terms"))
        places = self.index.places if group_id is None else self.index.places.filter(F.col("group_id") == group_id)
        out = sums.join(places, ["block", "no"]).drop("block", "no")
        return out if tagged is None else out.join(tagged.select("passage_id").distinct(), "passage_id", "left_semi")

    def survivors(self, k: int, rank, group_id: str | None, tagged: DataFrame | None) -> DataFrame:
        """The blocks (query_id, block, bound) that may hold one of the ``k`` best passages. ``rank`` takes hits and
        gives the k best with their place, ``candidate``; it may lower scores, but not raise them."""
        first = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
        tried = self.bounds.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= FIRST_BLOCKS + k)
        limits = rank(self.scored(tried, group_id, tagged)).filter(F.col("candidate") == k).select("query_id", F.col("score").alias("_least"))
        # sums are taken in any order: what differs by rounding alone stays
        return self.bounds.join(limits, "query_id", "left").filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 1e-6)).select("query_id", "block", "bound")


def matching_blocks(index: BlockIndex, bins: DataFrame) -> DataFrame:
    """The blocks of the terms of intervals (stem, low, high, bin). They are bucketed by bin: only the intervals move."""
    return index.blocks.join(bins, "bin").filter((F.col("term_no") >= F.col("low")) & (F.col("term_no") < F.col("high")))


def weighed(heading_weight: float) -> Column:
    return F.col("in_text") + heading_weight * F.col("in_heading")


def part() -> Column:
    """What a query term adds to the score; it rises with tf and falls with dl."""
    tf, k1 = F.col("tf"), 1.2
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))


def top_hits(index: BlockIndex, queries: DataFrame, k: int, rank, heading_weight: float = 2.0, group_id: str | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """What ``rank`` makes of the hits of ``queries`` (query_id, query): the same rows as if all had been scored."""
    one = Search.of(index, queries, heading_weight)
    return rank(one.scored(one.survivors(k, rank, group_id, tagged), group_id, tagged))
