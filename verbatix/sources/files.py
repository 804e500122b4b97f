"""Raw files, the source catalog, and the tables of a corpus as files.

A catalog row is (id, group_id, title, source_url, original_url, source_type, format, pdf_mode, file_name,
collection). Nothing is downloaded: a folder of files that are there is the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "id string, group_id string, title string, source_url string, original_url string, source_type string, format string, pdf_mode string, file_name string, collection string"
LEAST_HTML_BYTES = 2048
PDF_MAGIC = "%PDF-"


def catalog_from_slugs(slugs: DataFrame, group_id: str, base_url: str, source_type: str = "official_webpage", collection: str | None = None) -> DataFrame:
    """Catalog rows of web pages listed by slug: ids and file names from group and slug, titles from its words."""
    slug = F.col("slug")
    words = F.regexp_replace(slug, "-", " ")
    return slugs.select(
        F.concat_ws("-", F.lit(group_id), slug).alias("id"),
        F.lit(group_id).alias("group_id"),
        F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))).alias("title"),
        F.concat(F.lit(base_url.rstrip("/") + "/"), slug).alias("source_url"),
        F.lit(None).cast("string").alias("original_url"),
        F.lit(source_type).alias("source_type"),
        F.lit("html").alias("format"),
        F.lit(None).cast("string").alias("pdf_mode"),
        F.concat(F.lit(f"{group_id}-"), slug, F.lit(".html")).alias("file_name"),
        F.lit(collection).cast("string").alias("collection"),
    )


def catalog(parts: Sequence[DataFrame]) -> DataFrame:
    """Catalogs laid end to end; columns are matched by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, content, bytes and sha256 of all files of a folder. File names are percent-decoded."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file_name"), "content", F.col("length").alias("bytes"), checksum(F.col("content")).alias("sha256"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """document_id and text of the text files of a folder, each one value."""
    files = spark.read.text(folder, wholetext=True)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return files.select(F.regexp_replace(name, r"\.txt$", "").alias("document_id"), F.col("value").alias("text"))


def checksum(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def has_format(content: Column, kind: Column) -> Column:
    """Whether bytes are what they should be: a PDF begins with its magic, an HTML page has 2048 bytes."""
    data = content.cast("binary")
    pdf = F.substring(data, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC.encode())
    return F.when(kind == "pdf", pdf).otherwise(F.octet_length(data) >= LEAST_HTML_BYTES)


def checksum_manifest(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """id, sha256, bytes and source_url of every source of a catalog whose file is there. ``raw`` is ``read_raw``."""
    return sources.select("id", "source_url", "file_name").join(raw.select("file_name", "sha256", "bytes"), "file_name").select("id", "sha256", "bytes", "source_url")


def missing_files(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Catalog rows whose file is not there."""
    return sources.join(raw.select("file_name"), "file_name", "left_anti")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object a line, in files that Spark commits together."""
    manifest.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, sha256 string, bytes long, source_url string").json(path)


def with_checksums(documents: DataFrame, checksums: DataFrame) -> DataFrame:
    """``documents`` with the checksum recorded for their id; empty where none is."""
    known = checksums.select(F.col("id").alias("document_id"), F.col("sha256").alias("checksum"))
    return documents.drop("checksum").join(known, "document_id", "left").withColumn("checksum", F.coalesce("checksum", F.lit("")))


def write_texts(documents: DataFrame, path: str) -> None:
    """document_id and text as a table; every text ends with one line feed."""
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n+\z", ""), F.lit("\n"))
    documents.select("document_id", text.alias("text")).write.mode("overwrite").parquet(path)


def size_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, kilobytes and longest_row (bytes) of the tables' rows as JSON."""
    parts = []
    for name, table in tables.items():
        size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in table.columns))))
        report = table.select(size.cast("long").alias("size")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("longest_row"))
        parts.append(report.select(F.lit(name).alias("table"), "n_rows", F.round(F.col("bytes") / 1024).cast("long").alias("kilobytes"), "longest_row"))
    return reduce(DataFrame.unionByName, parts)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The names of the files of a folder, which are numbers."""
    place, files = _folder(spark, path)
    return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []


def _create(spark: SparkSession, path: str) -> bool:
    """Whether an empty file could be made: of several that try, one can."""
    place, files = _folder(spark, path)
    return files.createNewFile(place)


def write_corpus(tables: dict[str, DataFrame], path: str) -> int:
    """Writes the tables of a corpus as a new snapshot and returns its number; chunks are parted by group, so that a group
    filter prunes files. A number is claimed first, so two writers never share a folder. When all tables are written, one
    empty file makes the snapshot the one that is read: readers see all of it or none, and what fails on the way
    leaves the corpus as it was."""
    spark = next(iter(tables.values())).sparkSession
    number = max([0, *_numbers(spark, f"{path}/claimed")]) + 1
    while not _create(spark, f"{path}/claimed/{number}"):
        number += 1
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        (writer.partitionBy("group_id") if name == "chunks" and "group_id" in table.columns else writer).parquet(f"{path}/snapshots/{number}/{name}")
    _create(spark, f"{path}/complete/{number}")
    return number


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete snapshots, the one that is read last."""
    return _numbers(spark, f"{path}/complete")


def read_corpus(spark: SparkSession, path: str, names: Sequence[str] = ("documents", "sections", "chunks", "chunk_topics", "corpus_meta"), snapshot: int | None = None) -> dict[str, DataFrame]:
    """The tables of one snapshot, the latest complete one by default: tables read together belong together."""
    known = snapshots(spark, path)
    number = snapshot if snapshot is not None else max(known, default=None)
    if number not in known:
        raise FileNotFoundError(f"no complete snapshot {number if number is not None else ''} at {path}")
    return {name: spark.read.parquet(f"{path}/snapshots/{number}/{name}") for name in names}


def expire_snapshots(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Drops all complete snapshots but the ``keep`` latest, and what was left unfinished before these; returns the numbers of
    those that are gone. No reader finds a snapshot any more before its files go; one that has just resolved it needs ``keep`` to be
    two or more."""
    kept = snapshots(spark, path)[-max(1, keep) :]
    gone = [n for n in _numbers(spark, f"{path}/snapshots") if kept and n < kept[0]]
    for folder in ("complete", "snapshots"):
        for number in gone:
            place, files = _folder(spark, f"{path}/{folder}/{number}")
            files.delete(place, True)
    return gone
