"""Citations and passage payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import GROUPS, Group
from ..functions.text import collapse_space_col, fixed_col

# Fixed value: the notice that goes with every result.
NOTICE = (
    "Ces extraits proviennent des programmes officiels de la présidentielle française de 2022. "
    "Ne citer que le champ `quote`, mot à mot, en joignant `citation`. "
    "Ne rien affirmer qui ne figure pas dans les extraits : en l'absence de passage, répondre "
    "que le corpus ne le documente pas."
)


def group_table(spark: SparkSession, groups: Sequence[Group] = GROUPS) -> DataFrame:
    """One row for each group, with its place in the output order."""
    rows = [(g.id, n, g.name, g.short_name, g.representative, g.bloc, list(g.aliases)) for n, g in enumerate(groups)]
    return spark.createDataFrame(rows, "group_id string, ordinal int, group_name string, short_name string, representative string, bloc string, aliases array<string>")


def citation(short_name: Column, representative: Column, title: Column, heading: Column, occasion: Column, url: Column) -> Column:
    """The parts that are there, joined by dashes; the heading in guillemets."""
    some = lambda c: F.when(c != "", c)
    who = F.concat(short_name, F.lit(" ("), representative, F.lit(")"))
    quoted = F.when(heading != "", F.concat(F.lit("« "), collapse_space_col(heading), F.lit(" »")))
    return F.concat_ws(" — ", who, some(title), quoted, some(occasion), some(url))


def payload(hits: DataFrame, groups: DataFrame, occasion: str = "présidentielle 2022") -> DataFrame:
    """The shape in which a passage is returned. ``hits`` has passage_id, group_id, text, heading,
    topic_tags, title, source_url, source_type and, if ranked, score (three decimals)."""
    joined = hits.join(F.broadcast(groups), "group_id", "left")  # one row for each group
    columns = [
        F.col("passage_id"),
        F.col("group_name"),
        F.col("group_id"),
        F.col("representative"),
        F.col("text").alias("quote"),
        F.col("heading"),
        F.col("topic_tags"),
        F.col("title").alias("document_title"),
        F.col("source_url"),
        F.col("source_type"),
        citation(F.col("short_name"), F.col("representative"), F.col("title"), F.col("heading"), F.lit(occasion), F.col("source_url")).alias("citation"),
    ]
    if "score" in hits.columns:
        columns.append(fixed_col(F.col("score")).alias("score"))
    return joined.select(*columns)


def to_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row; fields that are null are left out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("json"))
