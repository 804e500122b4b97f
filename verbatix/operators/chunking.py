"""Quotable passages with exact offsets: blocks, headings, and the fold that cuts a document into chunks.

A block is a non-blank line. A heading opens a section and closes the chunk before it once that has 120
characters; text closes a chunk at 600; a block of more than 1100 characters is cut after sentences first.
A chunk is the slice of its text from the start of its first piece to the end of its last, and belongs to
the section in which it began. Positions count code points.

The fold works on one document at a time, a row in and rows out, without a shuffle. A null text has no
blocks but its opening section; a null title is empty; repeated documents are cut each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, sums_before
from ..functions.text import SPACE, normalize_label, normalize_label_col

TARGET_CHARS, MAX_CHARS, MIN_CHARS = 600, 1100, 120

# Forms of headings, and of short lines that are none. Case and letters are spelled out so
# that Java and Python agree.
_END = r"(?![A-Za-z0-9_])"
NUMBERED = r"^[0-9]{1,3}\s*[_.)\]–-]\s+\S"
NAMED = rf"^(?iu:chapitre|partie|axe|thème|theme|pacte|proposition|mesure){_END}|^(?iu:priorité)(?=[A-Za-z0-9_])"
NOT_HEADINGS = (
    r"^©",
    r"^(?iu:cr[ée]dits?)\s+(?iu:photos?|images?|iconographi)",
    r"^(?iu:photos?|illustrations?)\s*[:—-]",
    rf"(?<![A-Za-z0-9_])(?iu:adobe stock|istock|shutterstock|getty|unsplash|flickr|wikimedia){_END}",
    rf"^(?iu:sommaire|table des matières|introduction|édito|editorial|remerciements){_END}",
    r"^\p{Lu}[\p{L}'’-]+ \p{Lu}[\p{L}'’-]+, [a-zà-ÿ]",
    r"^\p{Lu}[\p{L}'’-]+ \p{Lu}[\p{L}'’-]+,? ?(20[0-9][0-9])$",
)
# JavaScript's white space, of which SPACE is the class
_STRIP = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
INLINE_ITEM = r"[0-9]{1,3}\s*_\s*[A-ZÀ-Ý]"


def _java(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE).replace("$", r"\z")


# ---------------------------------------------------------------------------------------------
# Column forms


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_STRIP))


def lines(documents: DataFrame, *carried: str) -> DataFrame:
    """``blocks`` without their places: document_id, ord, text and the ``carried`` columns."""
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _trimmed)
    return documents.select("document_id", *carried, F.posexplode(F.filter(cut, lambda line: line != "")).alias("ord", "_line")).select("document_id", "ord", F.col("_line").alias("text"), *carried)


def blocks(documents: DataFrame, *carried: str) -> DataFrame:
    """document_id, ord, text (trimmed), start and end (of the untrimmed line) of every non-blank line, and the
    ``carried`` columns of its document. No shuffle; the work grows with the number of lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def placed(lines: Column) -> Column:
        starts = sums_before(F.transform(lines, lambda line: F.length(line) + 1))
        return F.zip_with(lines, starts, lambda line, at: F.struct(_trimmed(line).alias("text"), at.alias("start"), (at + F.length(line)).alias("end")))

    kept = F.filter(let(lines, placed), lambda x: x["text"] != "")
    return documents.select("document_id", *carried, F.posexplode(kept).alias("ord", "b")).select("document_id", "ord", "b.text", "b.start", "b.end", *carried)


def is_heading_col(text: Column, title: Column) -> Column:
    label = normalize_label_col(text)
    words = F.size(F.split(text, " ", -1))
    letters = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", ""))
    capitals = F.length(F.regexp_replace(text, "[^A-ZÀ-Ý]", ""))
    possible = F.length(text).between(4, 110) & (words <= 16) & ~text.rlike(r"[.!?;]\z") & ~text.rlike(rf"^[•▪●–—-]{SPACE}") & ~text.rlike("^[a-zà-ÿ]")
    for pattern in NOT_HEADINGS:
        possible = possible & ~text.rlike(_java(pattern))
    possible = possible & ~((F.length(label) > 6) & F.contains(normalize_label_col(F.coalesce(title, F.lit(""))), label))
    short = (F.length(text) <= 70) & (words <= 9)
    return possible & (text.rlike(_java(NUMBERED)) | text.rlike(_java(NAMED)) | ((letters >= 4) & ((capitals / letters > 0.7) | short)))


def is_navigation_col(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_java(INLINE_ITEM))) >= 2


# ---------------------------------------------------------------------------------------------
# the fold

_SPACES = re.compile(SPACE + "+")
_SENTENCES = re.compile(f"(?<=[.!?]){SPACE}+")


def _python(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace("(?iu:", "(?i:").replace(r"\s", SPACE).replace("$", r"\Z"))


_NOT_HEADINGS = [_python(p) for p in NOT_HEADINGS]
_NUMBERED, _NAMED = _python(NUMBERED), _python(NAMED)


def is_heading(text: str, title: str) -> bool:
    if not 4 <= len(text) <= 110 or text.count(" ") > 15 or text[-1] in ".!?;":
        return False
    if re.match(rf"[•▪●–—-]{SPACE}", text) or re.match("[a-zà-ÿ]", text) or any(p.search(text) for p in _NOT_HEADINGS):
        return False
    label = normalize_label(text)
    if len(label) > 6 and label in normalize_label(title):
        return False
    if _NUMBERED.search(text) or _NAMED.search(text):
        return True
    letters = len(re.sub("[^A-Za-zÀ-ÿ]", "", text))
    if letters < 4:
        return False
    return len(re.sub("[^A-ZÀ-Ý]", "", text)) / letters > 0.7 or (len(text) <= 70 and text.count(" ") <= 8)


def sentence_pieces(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a block: itself, or runs of sentences of 600 characters or more."""
    if stop - start <= MAX_CHARS:
        return [(start, stop)]
    out, first, at = [], None, start
    for gap in [*_SENTENCES.finditer(text, start, stop), None]:
        end = gap.start() if gap else stop
        first = at if first is None else first
        if end - first >= TARGET_CHARS:
            out.append((first, end))
            first = None
        at = gap.end() if gap else stop
    if first is not None and text[first:stop].strip(_STRIP):
        out.append((first, stop))
    return out


def fold(text: str, title: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
    """(sections as (ord, heading), chunks as (section, start, end))."""
    sections, chunks, pending, home = [(0, title)], [], [], 0

    def span() -> int:
        return pending[-1][1] - pending[0][0] if pending else 0

    def close() -> None:
        if pending and text[pending[0][0] : pending[-1][1]].strip(_STRIP):
            chunks.append((home, pending[0][0], pending[-1][1]))
        pending.clear()

    def add(piece: tuple[int, int]) -> None:
        nonlocal home
        home = home if pending else len(sections) - 1
        pending.append(piece)

    at = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        block = line.strip(_STRIP)
        if not block:
            continue
        if is_heading(block, title):
            if span() >= MIN_CHARS:
                close()
            sections.append((len(sections), block))
            add((start, start + len(line)))
            continue
        lead = len(line) - len(line.lstrip(_STRIP))
        inner = sentence_pieces(text, start + lead, start + lead + len(block))
        for piece in inner if len(block) > MAX_CHARS else [(start, start + len(line))]:
            add(piece)
            if span() >= TARGET_CHARS:
                close()
    close()
    return sections, chunks


CHUNKS = "passage_id string, document_id string, section_id string, ord int, text string, char_start int, char_end int, heading string"
SECTIONS = "section_id string, document_id string, heading string, ord int"


def _documents(documents: DataFrame, *more: Column) -> DataFrame:
    return documents.select(F.col("document_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("title", F.lit("")).alias("title"), *more)


def chunks(documents: DataFrame) -> DataFrame:
    """Chunks of documents (document_id, title, text, and group_id if there), with is_navigation."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, title, group in frame.itertuples(index=False):
                sections, found = fold(text, title)
                rows += [(f"{doc}#c{n}", doc, f"{doc}#s{home}", n, text[a:b], a, b, sections[home][1], group) for n, (home, a, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (CHUNKS + ", group_id string").split(", ")])

    group = F.col("group_id").cast("string") if "group_id" in documents.columns else F.lit(None).cast("string")
    cut = _documents(documents, group.alias("group_id")).mapInPandas(batches, CHUNKS + ", group_id string")
    return cut.withColumn("is_navigation", is_navigation_col(F.col("text")))


def sections(documents: DataFrame) -> DataFrame:
    """Sections of documents; the opening one bears the title."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f"{doc}#s{n}", doc, heading, n) for doc, text, title in frame.itertuples(index=False) for n, heading in fold(text, title)[0]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    return _documents(documents).mapInPandas(batches, SECTIONS)
