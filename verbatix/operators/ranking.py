"""Ranking rules over scored hits (query_id, passage_id, group_id, score, ...).

Scores are compared at nine decimals and ties go to the smaller passage_id, so that a ranking does not
hang on the order in which a sum was taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import required_coverage_col

NAVIGATION_PENALTY = 0.3
FLOOR = 0.25
CANDIDATES = 4
TOPIC_CANDIDATES = 15
KEYWORD_BOOST = 0.15


def best_first(score: str = "score") -> tuple[Column, Column]:
    return F.round(score, 9).desc(), F.col("passage_id")


def penalise_navigation(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.col("score") * F.when(F.col("is_navigation"), NAVIGATION_PENALTY).otherwise(1.0))


def top(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    """The k best hits of each key; ``name`` is their rank from 1."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*best_first()))).filter(F.col(name) <= k)


def covered(hits: DataFrame) -> DataFrame:
    """Hits whose text holds enough of the query: all of one or two terms, else half of them, three at most."""
    return hits.filter(F.col("coverage") >= required_coverage_col(F.col("n_terms")))


def above_floor(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits of a quarter or more of the largest score among those given."""
    best = F.max("score").over(Window.partitionBy(*by))
    return hits.withColumn("_best", best).filter(F.col("score") >= F.col("_best") * FLOOR).drop("_best")


def cap_groups(hits: DataFrame, limit: int) -> DataFrame:
    """At most max(2, ceil(limit / 3)) hits of one group. Walking down the list and skipping a full group
    keeps just each group's best, so the rank inside the group decides."""
    return top(hits, max(2, -(-limit // 3)), ("query_id", "group_id"), "_in_group").drop("_in_group")


def boost_keywords(hits: DataFrame) -> DataFrame:
    """``matched_keywords`` (an array) raises the score by 15 % for each keyword."""
    return hits.withColumn("score", F.col("score") * (1 + KEYWORD_BOOST * F.size("matched_keywords")))


EVIDENCE = {  # fixed values: level and what it means
    "direct_quote": "Le passage cité traite explicitement le thème (plusieurs termes du thème y figurent).",
    "clear_paraphrase": "Le passage aborde le thème sans lui être entièrement consacré.",
    "weak_inference": "Le lien avec le thème repose seulement sur une proximité lexicale : à interpréter avec prudence.",
    "not_found": "Aucun passage du corpus ne traite ce thème pour ce parti. Ne pas inférer de position.",
}


def evidence_level(n_keywords: Column) -> Column:
    """By the keywords that the first hit holds; null (no hit) is not_found."""
    return F.when(n_keywords >= 2, "direct_quote").when(n_keywords == 1, "clear_paraphrase").when(n_keywords == 0, "weak_inference").otherwise("not_found")


def evidence_explanation(level: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in EVIDENCE.items() for x in pair))[level]
