"""Searches over an index: free queries, one or many at a time, comparison of groups on a topic, and
reading a passage with its neighbours.

Every search is one plan. A table of queries runs as a whole: ranking is partitioned by query. Nothing
found is a valid answer; a query without terms has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import GROUPS, TOPICS, Group, Topic, require_group, require_groups, require_int, require_query, require_topic
from ..functions.text import fixed_col, query_stems_col
from ..operators import ranking, statistics, tagging
from ..operators.blockmax import BlockIndex, top_hits
from ..operators.index import Index, as_table, match
from ..shared import materialise

HIT = ("query_id", "rank", "passage_id", "document_id", "group_id", "score", "coverage")


def candidates(index: Index | BlockIndex, queries: DataFrame | Sequence[tuple], limit: int, group_id: str | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """The best ``4 * limit`` passages of each query after the filters on group and topic. Term statistics
    are those of the whole index. A block-max index scores only the blocks that can hold one of them."""
    k = limit * ranking.CANDIDATES
    rank = lambda hits: ranking.top(ranking.penalise_navigation(hits), k, name="candidate")
    if isinstance(index, BlockIndex):
        if not isinstance(queries, DataFrame):
            queries = as_table(index.blocks.sparkSession, queries)
        return top_hits(index, queries, k, rank, group_id=group_id, tagged=tagged)
    hits = match(index, queries)
    if group_id is not None:
        hits = hits.filter(F.col("group_id") == group_id)
    if tagged is not None:
        hits = hits.join(tagged.select("passage_id").distinct(), "passage_id", "left_semi")
    return rank(hits)


def search_batch(index: Index | BlockIndex, queries: DataFrame | Sequence[tuple], limit: int = 10, group_id: str | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """HIT columns for each query of ``queries`` (query_id, query), a table or a list of a few: candidates, coverage, floor, then
    the cap by group (unless one group is asked for) and the limit. Queries of a table that have the same terms are answered once."""
    require_int("limit", limit, 1, 25)
    if not isinstance(queries, DataFrame):
        return _ranked(index, queries, limit, group_id, tagged)
    asked = materialise(queries.select("query_id", "query", query_stems_col(F.col("query")).alias("_stems")), "asked")
    same = asked.groupBy("_stems").agg(F.min("query_id").alias("_first"))
    first = asked.join(same.select(F.col("_first").alias("query_id")), "query_id", "left_semi").select("query_id", "query")
    found = _ranked(index, first, limit, group_id, tagged).withColumnRenamed("query_id", "_first")
    return found.join(asked.join(same, "_stems").select("_first", "query_id"), "_first").select(*HIT)


def _ranked(index: Index | BlockIndex, queries: DataFrame | Sequence[tuple], limit: int, group_id: str | None, tagged: DataFrame | None) -> DataFrame:
    found = ranking.above_floor(ranking.covered(candidates(index, queries, limit, group_id, tagged)))
    if group_id is None:
        found = ranking.cap_groups(found, limit)
    return ranking.top(found, limit).select(*HIT)


def search(index: Index | BlockIndex, query: str, limit: int = 10, group: str | None = None, topic: str | None = None, tags: DataFrame | None = None, groups: tuple[Group, ...] = GROUPS, topics: tuple[Topic, ...] = TOPICS) -> DataFrame:
    """One query by a person: labels are resolved, and an unknown one is an error."""
    require_query(query)
    group_id = require_group(group, groups) if group else None
    tagged = None
    if topic:
        topic_id = require_topic(topic, topics).id
        tagged = tags.filter(F.col("topic") == topic_id)
    return search_batch(index, [(0, query)], limit, group_id, tagged)


def full_hits(index: Index | BlockIndex, hits: DataFrame, documents: DataFrame, sections: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """``hits`` with all that is known of them: the passage (text, place and offsets), its section (heading, and
    ``section_ord``, 0 where there is none), its document's columns and its topic tags, joined by commas, null without any.
    Spark chooses the joins by the size of ``hits``, which grows with the number of queries; they are searched once, and written."""
    hits = materialise(hits, "hits")
    documents = documents.join(hits.select("document_id"), "document_id", "left_semi")
    out = index.passages.join(hits.select("query_id", "rank", "passage_id", "score", "coverage"), "passage_id")
    if sections is not None and "section_id" in out.columns:
        out = out.join(sections.select("section_id", F.col("ord").alias("section_ord")), "section_id", "left")
    else:
        out = out.withColumn("section_ord", F.lit(None).cast("int"))
    known = [c for c in documents.columns if c not in ("text", "group_id") and (c == "document_id" or c not in out.columns)]
    out = out.join(documents.select(*known), "document_id")
    if tags is not None:
        own = tags.join(hits.select("passage_id").distinct(), "passage_id", "left_semi")
        out = out.join(own.groupBy("passage_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("topic"))).alias("topic_tags")), "passage_id", "left")
    return out.withColumn("section_ord", F.coalesce("section_ord", F.lit(0)))


def topic_queries(topics: Sequence[Topic]) -> list[tuple[str, str]]:
    return [(t.id, " ".join(t.keywords)) for t in topics]


def topic_search(index: Index, topics: Sequence[Topic], per_group: int, group_ids: Sequence[str] | None = None) -> DataFrame:
    """topic, rank, passage_id, document_id, group_id, score and matched_keywords: for each topic and group
    the best passages on the topic's keywords, boosted by the keywords that they hold. There is no coverage
    rule here, and the floor is each group's own."""
    spark = index.postings.sparkSession
    hits = match(index, topic_queries(topics))
    if group_ids is not None:
        hits = hits.filter(F.col("group_id").isin(list(group_ids)))
    by = ("query_id", "group_id")
    best = ranking.top(ranking.penalise_navigation(hits), max(ranking.TOPIC_CANDIDATES, per_group * ranking.CANDIDATES), by, "candidate")
    keywords = tagging.keyword_matches(index.postings, tagging.keyword_terms(spark, topics)).withColumnRenamed("topic", "query_id")
    known = best.join(keywords, ["query_id", "passage_id"], "left").withColumn("matched_keywords", F.coalesce("matched_keywords", F.array().cast("array<string>")))
    kept = ranking.top(ranking.above_floor(ranking.boost_keywords(known), by), per_group, by)
    return kept.select(F.col("query_id").alias("topic"), "rank", "passage_id", "document_id", "group_id", "score", "matched_keywords")


def compare(index: Index, tags: DataFrame, topic: str, groups_asked: list[str] | None = None, passages_per_group: int = 2, groups: tuple[Group, ...] = GROUPS, topics: tuple[Topic, ...] = TOPICS) -> DataFrame:
    """One row for each group asked for, in that order (``position``; duplicates stay): evidence_level, its
    explanation, matched_keywords of the best passage, passages (rank, id, text, heading and score), the group's
    n_passages and n_documents, and coverage_warning, the same text for all, null where groups are about alike. None of
    them hangs on ``tags``, which are not read."""
    require_int("passages_per_group", passages_per_group, 1, 5)
    wanted = require_topic(topic, topics)
    ids = require_groups(groups_asked, groups)
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(n, g) for n, g in enumerate(ids)], "position int, group_id string")
    hits = topic_search(index, [wanted], passages_per_group, sorted(set(ids)))
    # at most so many passages for each group asked for
    shown = index.passages.select("passage_id", "text", "heading").join(F.broadcast(hits.drop("text")), "passage_id")
    best = shown.groupBy("group_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "passage_id", "text", "heading", fixed_col(F.col("score")).alias("score")))).alias("passages"),
        F.min_by("matched_keywords", "rank").alias("matched_keywords"),
    )
    stats = materialise(statistics.group_counts(index.passages), "counts")  # read twice, a row for each group
    joined = asked.join(best, "group_id", "left").join(stats, "group_id", "left")
    level = ranking.evidence_level(F.when(F.col("passages").isNotNull(), F.size("matched_keywords")))
    none = F.array().cast("array<string>")
    named = spark.createDataFrame([(g.id, n, g.short_name) for n, g in enumerate(groups) if g.id in ids], "group_id string, ordinal int, short_name string")
    # one row, or none
    warned = coverage_warning(statistics.coverage_imbalance(stats, named), named)
    return joined.join(F.broadcast(warned), F.lit(True), "left").select(
        "position",
        "group_id",
        level.alias("evidence_level"),
        ranking.evidence_explanation(level).alias("evidence_explanation"),
        F.coalesce("matched_keywords", none).alias("matched_keywords"),
        F.coalesce("passages", F.array().cast("array<struct<rank: int, passage_id: string, text: string, heading: string, score: double>>")).alias("passages"),
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"),
        "coverage_warning",
    )


# The text around the names and the ratio.
WARNING = (
    "Le corpus est inégalement fourni selon les partis : ",
    " y est documenté ",
    " fois plus que ",
    ". Les partis n'ont pas publié le même volume en 2022. Un parti peu couvert peut donc paraître plus vague ou ressortir en `not_found` sans que cela "
    "signifie qu'il n'avait pas de position : le signaler dans la réponse plutôt que de conclure à un silence politique.",
)


def coverage_warning(imbalance: DataFrame, groups: DataFrame) -> DataFrame:
    """The text of an imbalance (no row without one); ``groups`` has group_id and short_name."""
    name = lambda c: groups.select(F.col("group_id").alias(c), F.col("short_name").alias(f"{c}_name"))
    both = imbalance.join(name("best_covered"), "best_covered").join(name("least_covered"), "least_covered")
    ratio = F.regexp_replace(F.col("ratio").cast("string"), r"\.0$", "")
    return both.select(F.concat(F.lit(WARNING[0]), "best_covered_name", F.lit(WARNING[1]), ratio, F.lit(WARNING[2]), "least_covered_name", F.lit(WARNING[3])).alias("coverage_warning"))


def passage_with_context(passages: DataFrame, wanted: DataFrame, radius: int = 1) -> DataFrame:
    """For each passage_id of ``wanted``: the passages of its document at most ``radius`` places away,
    itself included, with their position. Section borders do not count. Places are joined by equality, one
    row for each offset, so no two passages of a document meet that are not neighbours."""
    require_int("radius", radius, 0, 3)
    centre = passages.join(wanted.select("passage_id").distinct(), "passage_id", "left_semi").select(F.col("passage_id").alias("wanted_id"), "document_id", "ord")
    offsets = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    places = centre.withColumn("offset", offsets).select("wanted_id", "document_id", (F.col("ord") + F.col("offset")).alias("ord"), "offset")
    position = F.when(F.col("offset") == 0, "self").when(F.col("offset") < 0, "before").otherwise("after")
    return passages.join(places, ["document_id", "ord"]).select("wanted_id", "passage_id", "document_id", "ord", position.alias("position"), "text")


def neighbour_windows(passages: DataFrame, radius: int = 1) -> DataFrame:
    """Every passage with its neighbours at once: passage_id, ord and context (passage ids in order). One
    sort by document; the frame is bounded."""
    from pyspark.sql import Window

    frame = Window.partitionBy("document_id").orderBy("ord").rowsBetween(-require_int("radius", radius, 0, 3), radius)
    return passages.select("document_id", "passage_id", "ord", F.collect_list("passage_id").over(frame).alias("context"))
