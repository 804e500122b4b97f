"""The driver's tables seen as a corpus: documents grouped by language, passages of them, topics of the
words that occur there, and pages laid out from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import Group, Topic
from .operators.chunking import is_navigation_col, lines

GROUPS = (
    Group("en", "English", "EN", "Reader E", "west", ("english", "anglais")),
    Group("fr", "Français", "FR", "Reader F", "west", ("french", "français", "francais")),
    Group("de", "Deutsch", "DE", "Reader D", "middle", ("german", "allemand")),
    Group("es", "Español", "ES", "Reader S", "south", ("spanish", "español", "espagnol")),
)
TOPICS = (
    Topic("things", "Things", "English words", ("thing", "things", "attion", "ering", "thing ering", "thand")),
    Topic("moments", "Moments", "French words", ("ement", "etion", "eauou", "ouier", "ouier ement", "laque")),
    Topic("units", "Units", "German words", ("nicht", "ersch", "enheit", "nicht ersch", "der berung")),
    Topic("actions", "Actions", "Spanish words", ("cioni", "cionado", "cionados", "cioni ciones", "mente")),
)
SEARCHES = ((0, "thing attion"), (1, "ement etion ouier"), (2, "nicht ersch"), (3, "cionado cioni mente"), (4, "the attion and thering erable"), (5, "blockchain cryptomonnaies"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, group_id, title (six words of the first line), text and the metadata of a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = F.substring_index("text", "\n", 1)
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("lang").alias("group_id"),
        F.array_join(F.slice(F.split(first, " "), 1, 6), " ").alias("title"),
        "text",
        F.col("source").alias("collection"),
        F.concat(F.lit("https://corpus.example/"), "source", F.lit("/"), "doc_id").alias("source_url"),
        F.lit("official_webpage").alias("source_type"),
        F.sha2("text", 256).alias("checksum"),
        F.length("text").alias("char_count"),
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """Passages by line: the plain unit that SQL can cut as well."""
    cut = lines(docs, "group_id", "title")
    return cut.select(F.concat_ws(":", "document_id", "ord").alias("passage_id"), "document_id", "group_id", "ord", "text", F.col("title").alias("heading"), is_navigation_col(F.col("text")).alias("is_navigation"))


def whole_documents(docs: DataFrame) -> DataFrame:
    """Passages that are whole documents, without headings."""
    return docs.select(F.col("document_id").alias("passage_id"), "document_id", "group_id", F.lit(0).alias("ord"), "text", F.lit("").alias("heading"), F.lit(False).alias("is_navigation"))


def paged(docs: DataFrame, lines_a_page: int = 3) -> DataFrame:
    """Documents as paged text: so many lines a page, under a running header and above a page number."""
    lines = F.split("text", "\n", -1)
    count = F.ceil(F.size(lines) / lines_a_page).cast("int")
    header = F.concat(F.lit("CORPUS OF "), F.upper("collection"), F.lit(" READER"))
    page = lambda i: F.concat_ws("\n", F.array(header), F.slice(lines, (i - 1) * lines_a_page + 1, lines_a_page), F.array(F.concat(F.lit("- "), i.cast("string"), F.lit(" -"))))
    return docs.select("document_id", F.array_join(F.transform(F.sequence(F.lit(1), count), page), "\f").alias("text"))
