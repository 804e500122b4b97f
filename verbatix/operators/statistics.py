"""Counts over a corpus: groups, topics, documents, imbalance, metadata, and checks of its invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMBALANCE = 3.0
LEAST_COVERAGE = 0.95


def group_counts(passages: DataFrame) -> DataFrame:
    """group_id, n_passages and n_documents of every group that has passages."""
    return passages.groupBy("group_id").agg(F.countDistinct("passage_id").alias("n_passages"), F.countDistinct("document_id").alias("n_documents"))


def group_stats(passages: DataFrame, tags: DataFrame) -> DataFrame:
    """group_id, n_passages, n_documents and topics (sorted) of every group that has passages."""
    counts = group_counts(passages)
    topics = tags.join(passages.select("passage_id", "group_id"), "passage_id").groupBy("group_id").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return counts.join(topics, "group_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def topic_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("topic").agg(F.count("*").alias("n"))


def topic_counts_of_group(tags: DataFrame, passages: DataFrame, group_id: str) -> DataFrame:
    return topic_counts(tags.join(passages.filter(F.col("group_id") == group_id).select("passage_id"), "passage_id", "left_semi"))


def topic_group_crosstab(tags: DataFrame, passages: DataFrame, group_ids: Sequence[str]) -> DataFrame:
    """topic, a count for each group, total, and missing (groups without a passage, in order)."""
    ids = list(group_ids)
    table = tags.join(passages.select("passage_id", "group_id"), "passage_id").groupBy("topic").pivot("group_id", ids).count().fillna(0)
    total = sum((F.col(f"`{g}`") for g in ids), F.lit(0)).cast("long")
    missing = F.concat_ws(",", *(F.when(F.col(f"`{g}`") == 0, F.lit(g)) for g in ids))
    return table.withColumns({"total": total, "missing": missing})


def untagged(passages: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: n_passages and n_untagged."""
    tagged = tags.select("passage_id").distinct().withColumn("tagged", F.lit(1))
    return passages.select("passage_id").join(tagged, "passage_id", "left").agg(F.count("*").alias("n_passages"), F.count_if(F.col("tagged").isNull()).alias("n_untagged"))


def coverage_imbalance(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """One row, or none: ratio (one decimal), best_covered and least_covered of the groups (group_id,
    ordinal) asked for that have passages, two at least, if the ratio reaches 3. The earlier group wins ties."""
    counted = groups.join(stats.select("group_id", "n_passages"), "group_id").filter("n_passages > 0")
    order = lambda n: F.struct(n, F.col("ordinal"))
    ends = counted.agg(F.count("*").alias("k"), F.min_by("group_id", order(-F.col("n_passages"))).alias("best_covered"), F.min_by("group_id", order(F.col("n_passages"))).alias("least_covered"), F.max("n_passages").alias("most"), F.min("n_passages").alias("least"))
    ratio = F.try_divide(F.col("most"), F.col("least"))
    return ends.filter((F.col("k") >= 2) & (ratio >= IMBALANCE)).select(F.round(ratio, 1).alias("ratio"), "best_covered", "least_covered")


def corpus_meta(meta: DataFrame, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: corpus_version and generated_at (with defaults), document_count and passage_count."""
    value = lambda key, default: F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default))
    values = meta.agg(value("corpus_version", "inconnue").alias("corpus_version"), value("generated_at", "").alias("generated_at"))
    return values.crossJoin(documents.agg(F.count("*").alias("document_count"))).crossJoin(passages.agg(F.count("*").alias("passage_count")))


def list_documents(documents: DataFrame, passages: DataFrame, group_id: str | None = None) -> DataFrame:
    """``documents`` with passage_count, of one group or all."""
    if group_id is not None:
        documents = documents.filter(F.col("group_id") == group_id)
    counts = passages.groupBy("document_id").agg(F.count("*").alias("passage_count"))
    return documents.drop("passage_count").join(counts, "document_id", "left").withColumn("passage_count", F.coalesce("passage_count", F.lit(0).cast("long")))


def document_summary(passages: DataFrame, sections: DataFrame, short: int = 120) -> DataFrame:
    """document_id, n_passages, avg_chars, n_short and n_sections."""
    of_passages = passages.groupBy("document_id").agg(F.count("*").alias("n_passages"), F.avg(F.length("text")).alias("avg_chars"), F.count_if(F.length("text") < short).alias("n_short"))
    return sections.groupBy("document_id").agg(F.count("*").alias("n_sections")).join(of_passages, "document_id", "left").fillna(0, ["n_passages", "n_short"])


# ---------------------------------------------------------------------------------------------
# invariants


def slice_violations(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages whose text is not the slice of its document that they claim, or is blank."""
    joined = passages.join(documents.select("document_id", F.col("text").alias("whole")), "document_id", "left")
    exact = F.substr("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return joined.filter(~F.col("text").eqNullSafe(exact) | (F.trim("text") == "")).select("passage_id", "document_id")


def text_coverage(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, n_chars, covered, ratio and is_low (less than 95 %)."""
    lengths = passages.groupBy("document_id").agg(F.sum(F.length("text")).alias("covered"))
    joined = documents.select("document_id", F.length("text").cast("long").alias("n_chars")).join(lengths, "document_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    return joined.withColumn("ratio", F.try_divide(F.col("covered").cast("double"), F.col("n_chars"))).withColumn("is_low", F.col("ratio") < LEAST_COVERAGE)


def orphans(passages: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """passage_id and missing ('document' or 'section') of passages that refer to what is not there."""
    no_document = passages.join(documents.select("document_id"), "document_id", "left_anti").select("passage_id", F.lit("document").alias("missing"))
    no_section = passages.join(sections.select("section_id"), "section_id", "left_anti").select("passage_id", F.lit("section").alias("missing"))
    return no_document.unionByName(no_section)


def empty_groups(passages: DataFrame, groups: DataFrame) -> DataFrame:
    return groups.join(passages.select("group_id").distinct(), "group_id", "left_anti")


def document_problems(documents: DataFrame) -> DataFrame:
    """document_id and problem of documents without a checksum or an https address."""
    problems = F.array_compact(F.array(F.when(F.coalesce("checksum", F.lit("")) == "", "no checksum"), F.when(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "insecure address")))
    return documents.select("document_id", F.explode(problems).alias("problem"))


def stem_convergence(variants: DataFrame) -> DataFrame:
    """group_no, stems (sorted, distinct) and converges of groups of variants (group_no, word)."""
    from ..functions.text import stem_col

    found = variants.withColumn("stem", stem_col(F.col("word"))).groupBy("group_no").agg(F.sort_array(F.collect_set("stem")).alias("stems"))
    return found.select("group_no", F.concat_ws("+", "stems").alias("stems"), (F.size("stems") == 1).alias("converges"))
