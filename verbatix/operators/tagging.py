"""Topic tags: a keyword is present if all of its stems are among the stems of the text (exactly, no
prefixes); a passage has a topic if two keywords of it are present. Inflections of one word share a stem,
so one word can stand for several keywords; ``distinct_stems`` counts each set of stems once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Topic
from ..functions.text import stems

LEAST_KEYWORDS = 2


def keyword_terms(spark: SparkSession, topics: Sequence[Topic], distinct_stems: bool = False) -> DataFrame:
    """topic, keyword, no (its place), term and n_terms: one row for each distinct stem of a keyword."""
    rows, seen = [], set()
    for topic in topics:
        for no, keyword in enumerate(topic.keywords):
            own = frozenset(stems(keyword))
            if distinct_stems and (topic.id, own) in seen:
                continue
            seen.add((topic.id, own))
            rows += [(topic.id, keyword, no, term, len(own)) for term in sorted(own)]
    return spark.createDataFrame(rows, "topic string, keyword string, no int, term string, n_terms int")


def keyword_matches(posted: DataFrame, keywords: DataFrame) -> DataFrame:
    """passage_id, topic and matched_keywords (in taxonomy order). The taxonomy is a parameter of a few
    hundred rows; Spark broadcasts it by its size."""
    found = posted.filter("in_text > 0").select("passage_id", "term").join(keywords, "term")
    whole = found.groupBy("passage_id", "topic", "no", "keyword", "n_terms").agg(F.count("*").alias("n")).filter("n = n_terms")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("no", "keyword"))), lambda x: x["keyword"])
    return whole.groupBy("passage_id", "topic").agg(ordered.alias("matched_keywords"))


def tags(posted: DataFrame, keywords: DataFrame) -> DataFrame:
    """passage_id and topic, the bridge table."""
    return keyword_matches(posted, keywords).filter(F.size("matched_keywords") >= LEAST_KEYWORDS).select("passage_id", "topic")


def tag_arrays(passages: DataFrame, bridge: DataFrame) -> DataFrame:
    """``passages`` with topic_tags, sorted; empty where there is none."""
    gathered = bridge.groupBy("passage_id").agg(F.sort_array(F.collect_set("topic")).alias("topic_tags"))
    return passages.drop("topic_tags").join(gathered, "passage_id", "left").withColumn("topic_tags", F.coalesce("topic_tags", F.array().cast("array<string>")))
