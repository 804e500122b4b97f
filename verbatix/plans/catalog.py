"""What a corpus holds: groups, sources, profiles and the topic catalogue, each as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import TOPICS, Topic
from ..operators import statistics

ARCHIVED = "Le site de campagne d'origine n'est plus accessible : la source citée est l'archive Wayback du document."


def list_groups(groups: DataFrame, passages: DataFrame, tags: DataFrame) -> DataFrame:
    """Every group in order with n_passages and topics; zero and none where it has no passages."""
    stats = statistics.group_stats(passages, tags).select("group_id", "n_passages", "topics")
    joined = groups.join(stats, "group_id", "left")
    return joined.withColumns({"n_passages": F.coalesce("n_passages", F.lit(0).cast("long")), "topics": F.coalesce("topics", F.array().cast("array<string>"))})


def list_sources(documents: DataFrame, passages: DataFrame, group_id: str | None = None) -> DataFrame:
    """Documents with passage_count and, for archived ones, a note."""
    listed = statistics.list_documents(documents, passages, group_id)
    return listed.withColumn("archive_note", F.when(F.col("original_url").isNotNull(), ARCHIVED)) if "original_url" in documents.columns else listed


def group_profile(group_id: str, groups: DataFrame, documents: DataFrame, passages: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: the group, n_passages, n_sources and topic_coverage (a map with an entry for each topic); none for an
    unknown group. The sources themselves are rows of ``group_sources``."""
    own = passages.filter(F.col("group_id") == group_id)
    topics = statistics.topic_counts(tags.join(own.select("passage_id"), "passage_id", "left_semi")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "n")))).alias("topic_coverage"))
    sources = documents.filter(F.col("group_id") == group_id).agg(F.count("*").alias("n_sources"))
    counted = own.agg(F.count("*").alias("n_passages"))
    # one row each
    return groups.filter(F.col("group_id") == group_id).crossJoin(counted).crossJoin(topics).crossJoin(sources)


def group_sources(group_id: str, documents: DataFrame) -> DataFrame:
    """The documents of a group, a row each."""
    shown = [c for c in ("document_id", "title", "source_type", "source_url", "checksum") if c in documents.columns]
    return documents.filter(F.col("group_id") == group_id).select(*shown)


def topic_catalog(tags: DataFrame, topics: Sequence[Topic] = TOPICS) -> DataFrame:
    """topic, ordinal, label, description, keywords and n_passages of every topic."""
    rows = [(t.id, n, t.label, t.description, list(t.keywords)) for n, t in enumerate(topics)]
    table = tags.sparkSession.createDataFrame(rows, "topic string, ordinal int, label string, description string, keywords array<string>")
    return table.join(statistics.topic_counts(tags), "topic", "left").withColumnRenamed("n", "n_passages").fillna(0, ["n_passages"])


def resolve_labels(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """label and group_id of free labels: a group's id first, then aliases in group order; null if unknown."""
    from ..functions.text import normalize_label_col

    names = groups.select("group_id", "ordinal", F.lit(0).alias("kind"), F.col("group_id").alias("name")).unionByName(groups.select("group_id", "ordinal", F.lit(1).alias("kind"), F.explode("aliases").alias("name")))
    keys = names.withColumn("key", normalize_label_col(F.col("name"))).groupBy("key").agg(F.min_by("group_id", F.struct("kind", "ordinal")).alias("group_id"))
    return labels.withColumn("key", normalize_label_col(F.col("label"))).join(keys, "key", "left").select("label", "group_id")
