"""Secret scans: an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content (its blob). The ledger holds one
row for each blob and rule version that has been scanned, with the spans found. A scan takes only the
pairs that the ledger lacks, appends them, and joins the findings back to all paths with that content.

Rules (fixed values): ``assign`` is a keyword, a separator and a value of 6 or more characters;
``access`` is AKIA and 16 or more capitals or digits; ``hex`` is 24 or more lower-case hexadecimal
digits. Matches are leftmost and do not overlap within a rule. Positions are code points, ends exclusive.

Defined results: a null text is the empty blob; equal paths and repeated rows are kept, each with its
findings; an empty table gives no findings and leaves the ledger as it is; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.arrays import cut, let, sums_before, text_blocks
from .common import new_path


@dataclass(frozen=True)
class Rule:
    """``group`` and ``least``: a match counts if that group has so many characters. ``gate`` is a cheaper
    pattern that every text with a match satisfies."""

    name: str
    pattern: str
    gate: str
    version: int = 1
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", rf"""({_KEYS})["']?\x20*[:=]""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
LEDGER = "blob string, rule string, rule_version int, spans array<struct<start: int, end: int>>"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches: the texts between matches and the matches
    themselves, laid end to end, give every position."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.zip_with(F.split(text, rule.pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"))), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (F.length(v) >= rule.least).alias("ok")))
    steps = F.filter(steps, lambda x: x["len"].isNotNull())

    def placed(steps: Column) -> Column:
        starts = sums_before(F.transform(steps, lambda x: x["gap"] + x["len"]))
        return F.array_compact(F.zip_with(steps, starts, lambda x, at: F.when(x["ok"], F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end")))))

    return F.when(text.rlike(rule.gate), let(steps, placed)).otherwise(F.array().cast("array<struct<start: int, end: int>>"))


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, rep (one path that has it) and todo (names of rules whose present version it lacks)."""
    blobs = versions.groupBy("blob").agg(F.min("path").alias("rep"))
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules))
    pairs = blobs.select("blob", "rep", F.inline(wanted))
    return pairs.join(ledger.select("blob", "rule", "rule_version"), ["blob", "rule", "rule_version"], "left_anti").groupBy("blob", "rep").agg(F.collect_set("rule").alias("todo"))


def scan_unseen(versions: DataFrame, todo: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """New ledger rows. ``versions``: path, blob, text. Each unseen blob is scanned once, in the row of
    its representative path."""
    one = versions.join(todo.select(F.col("rep").alias("path"), "blob", "todo"), ["path", "blob"])
    found = [F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    rows = one.select("blob", F.explode(F.array_compact(F.array(*found))).alias("x")).select("blob", "x.*")
    # rows that repeat path and content have found the same
    return rows.dropDuplicates(["blob", "rule", "rule_version"])


def findings_by_blob(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob and findings, array<struct<start, kind, rule, end>> by start, then rule order; blobs with none are left out."""
    order = F.array(*(F.lit(r.name) for r in rules))
    present = F.array(*(F.lit(f"{r.name}:{r.version}") for r in rules))
    hits = ledger.filter(F.size("spans") > 0).filter(F.array_contains(present, F.concat_ws(":", "rule", "rule_version")))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, F.col("rule")).cast("int").alias("kind"), F.col("rule").alias("rule"), s["end"].alias("end")))
    # a set of each rule's findings: a retried append may have left a pair twice
    return hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_set(one))).alias("findings"))


def scan(spark: SparkSession, versions: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scans ``versions`` (path, text and any other columns) against the Parquet ledger at ``ledger_path``
    (a new one in the shared folder if None), appends what it lacked, and returns every row of
    ``versions`` with ``blob`` and ``findings``."""
    path = ledger_path or new_path(spark, "secret-ledger")
    old = read_ledger(spark, path)
    # a null path is the empty one here: both name rows of one content, of which any may be scanned
    name = F.coalesce(F.col("path").cast("string"), F.lit(""))
    hashed = versions.select(name.alias("path"), F.coalesce("text", F.lit("")).alias("text"), blob(F.col("text")).alias("blob"))
    scan_unseen(hashed, unseen(hashed, old, rules), rules).write.mode("append").parquet(path)
    found = findings_by_blob(read_ledger(spark, path), rules)
    empty = F.array().cast("array<struct<start: int, kind: int, rule: string, end: int>>")
    kept = versions.drop("blob", "findings").withColumn("blob", blob(F.col("text")))
    return kept.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", empty))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; an empty one where none has been written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every finding replaced by ``mark``; overlapping findings are replaced as one. ``findings`` are in
    order of their starts."""

    def cleared(blocks: Column) -> Column:
        ends = arrays.scan(F.transform(findings, lambda f: f["end"]), F.lit(0), F.greatest)
        parts = F.zip_with(findings, ends, lambda f, at: F.when(f["start"] >= at, F.concat(cut(blocks, at, f["start"]), F.lit(mark))))
        last = F.array_max(F.transform(findings, lambda f: f["end"]))
        return F.concat(F.array_join(F.array_compact(parts), ""), cut(blocks, last, F.length(text)))

    return F.when(F.size(findings) > 0, let(text_blocks(text), cleared)).otherwise(text)
