"""Text of paged documents: cleaning of lines, removal of running headers, and reflow into paragraphs.

A line is a row of (document_id, n_pages, page, n, line), and every step is an operation on such rows: a document may
have more pages than one row, or one task, holds. Line rewrites are Column expressions. Running headers are word sequences
that stand on 40 % of a document's pages: hashes of three words are counted first, and longer sequences are made up only
where neighbouring ones are common. Paragraphs are runs of lines between breaks; as a break needs no more than the
line before, and every page ends a paragraph, they are numbered by a running sum within a page.

Pages come from texts with form feeds, or from files that are read page by page.

A null text has no pages; a document of fewer than four pages has no running headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import SPACE, collapse_space_col
from ..shared import materialise, spread

PAGE_SHARE, LEAST_PAGES, LEAST_COUNT = 0.4, 4, 3
NGRAM_WORDS = (3, 14)

# Rewrites of a line, in order.
REWRITES = (
    (r"�+", " "),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "),
    (r"[\u00a0\u2002\u2003\u2009\u200a\u200b\u202f]", " "),
    (r"ﬁ", "fi"),
    (r"ﬂ", "fl"),
    (r"[‘’]", "'"),
    (r"[“”]", '"'),
    (r"[–—]", "–"),
    (r"(?<![A-Za-z0-9_])f ([ilr][a-zà-ÿ]+)", "f$1"),
    (rf"(?:{SPACE}*\.){{4,}}{SPACE}*", " "),
    (rf"p\.{SPACE}?[0-9]{{1,3}}(?![A-Za-z0-9_])", " "),
    (rf"(?<![A-Za-z0-9_])PAGE{SPACE}+[0-9]{{1,3}}(?![A-Za-z0-9_])", " "),
    (r"^[0-9]{1,3}(?=[A-ZÀ-Ý]{2})", ""),
    (rf"{SPACE}+([.,])", "$1"),
)

# Short words that may stand alone in a line of capitals.
SHORT_CAPITALS = """
A AU AUX CE DE DES DU EN EST ET IL ILS LA LE LES MA MES MON NE NI NON NOS NOTRE ON ONT OR OU OÙ PAR PAS PLUS POUR
QUE QUI SA SANS SE SES SI SON SUR TOUS TOUT UN UNE VOS VOTRE Y À
""".split()


def normalize_line_col(line: Column) -> Column:
    for pattern, to in REWRITES:
        line = F.regexp_replace(line, pattern, to)
    return collapse_space_col(line)


def is_letter_spaced_col(line: Column) -> Column:
    tokens = F.filter(F.split(line, " "), lambda t: t != "")
    return (F.size(tokens) >= 6) & (F.size(F.filter(tokens, lambda t: F.length(t) == 1)) / F.size(tokens) > 0.5)


def is_page_number_col(line: Column) -> Column:
    return line.rlike(rf"^(?:[-–—]|{SPACE})*[0-9]{{1,3}}(?:[-–—]|{SPACE})*\z")


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda t: t != "")


def _capitals(line: Column, least: int, share: float) -> Column:
    """Whether a line has ``least`` letters and ``share`` of them, more than half, are capitals. Then two letters in a row
    are, which most lines do not have: they are not looked at further."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-zÀ-ÿ]+", ""))
    counted = (letters >= least) & (F.length(F.regexp_replace(line, "[^A-ZÀ-Ý]+", "")) >= share * letters)
    return line.rlike("[A-ZÀ-Ý][^A-Za-zÀ-ÿ]*[A-ZÀ-Ý]") & counted


def join_spaced_capitals_col(line: Column) -> Column:
    """In lines of capitals: a fragment of one or two capitals that is no word joins the next token, or, where the
    next is a word of its own, the one before. A token that a fragment has joined is no fragment any more."""
    is_short = lambda t: t.isin(SHORT_CAPITALS)

    def step(acc: Column, x: Column) -> Column:
        token, follower, none = x["token"], x["next"], acc["text"] == ""
        fragment = ~acc["joined"] & token.rlike("^[A-ZÀ-Ý]{1,2}$") & ~is_short(token)
        joins = fragment & follower.isNotNull() & ~is_short(follower)
        glued = acc["joined"] | (fragment & ~joins) | none
        return F.struct(F.concat(acc["text"], F.when(glued, "").otherwise(" "), token).alias("text"), joins.alias("joined"))

    def joined(tokens: Column) -> Column:
        followers = F.array_append(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.lit(None).cast("string"))
        pairs = F.zip_with(tokens, followers, lambda t, x: F.struct(t.alias("token"), x.alias("next")))
        return F.aggregate(pairs, F.struct(F.lit("").alias("text"), F.lit(False).alias("joined")), step, lambda acc: acc["text"])

    return F.when(_capitals(line, 4, 0.8) & (F.size(_words(line)) >= 3), let(_words(line), joined)).otherwise(line)


def collapse_doubled_capitals_col(line: Column) -> Column:
    """In lines mostly of capitals: a token that is one string twice is halved, a repeated token dropped."""
    half = lambda t: F.substr(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))
    halved = F.transform(_words(line), lambda t: F.when((F.length(t) >= 6) & (t == F.concat(half(t), half(t))), half(t)).otherwise(t))
    # of equal neighbours the first one stays; place i counts from 0, element_at from 1
    single = lambda tokens: F.filter(tokens, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.element_at(tokens, F.greatest(i, F.lit(1))))))
    return F.when(_capitals(line, 6, 0.6), F.array_join(let(halved, single), " ")).otherwise(line)


def pages_of(documents: DataFrame) -> DataFrame:
    """document_id, n_pages, page and text of documents whose text has a form feed between pages."""
    pages = documents.filter(F.col("text").isNotNull()).select("document_id", F.split("text", "\f", -1).alias("pages"))
    return pages.select("document_id", F.size("pages").alias("n_pages"), F.posexplode("pages").alias("page", "text"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the text files of a folder, whose names without ``.txt`` are the documents. The scan cuts at form feeds and
    splits files by bytes: no file is one value, and one file may be read by many tasks. Pages are numbered by their
    order in a split and the pages of the splits before. Spark lists no file without bytes: it is no document."""
    file = F.col("_metadata.file_path").alias("_file")
    rows = spark.read.option("lineSep", "\f").text(folder).select(file, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    rows = materialise(rows, "pages")
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.sum(F.octet_length("text")).alias("_bytes"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialise(splits.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")), "splits")
    placed = rows.join(splits.select("_file", "_start", "_shift"), ["_file", "_start"]).select("_file", (F.col("_id") + F.col("_shift")).cast("int").alias("page"), "text")
    # a last page without text has no row in the scan: that of a file which is as long as its pages and a feed for each,
    # but for a byte order mark
    listed = spark.read.format("binaryFile").load(folder).select(file, F.col("length").alias("_length"))
    sizes = splits.groupBy("_file").agg(F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"))
    sizes = listed.join(sizes, "_file")
    ends = (F.col("_bytes") + F.col("_n")).isin(F.col("_length"), F.col("_length") - 3)
    sizes = sizes.select("_file", (F.col("_n") + ends.cast("long")).cast("int").alias("n_pages"), ends.alias("_ends"), "_n")
    last = sizes.filter("_ends").select("_file", F.col("_n").cast("int").alias("page"), F.lit("").alias("text"))
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("_file", "/"), -1)), r"\.txt$", "")
    return placed.unionByName(last).join(sizes.select("_file", "n_pages"), "_file").select(name.alias("document_id"), "n_pages", "page", "text")


def paged_lines(pages: DataFrame) -> DataFrame:
    """document_id, n_pages, page, n and line of pages, or of documents whose text has form feeds. Lines are cleaned,
    letter-spaced ones dropped, blank ones kept, and a blank one ends every page. They are cleaned once, into a table
    that all later steps read."""
    pages = spread(pages if "page" in pages.columns else pages_of(pages))
    # within the array, as a filter over rows would be moved below the rewrites and make them twice
    clean = F.transform(F.transform(F.split("text", "\n", -1), normalize_line_col), collapse_doubled_capitals_col)
    kept = F.filter(clean, lambda line: ~is_letter_spaced_col(line))
    lines = pages.select("document_id", "n_pages", "page", F.posexplode(F.array_append(kept, F.lit(""))).alias("n", "line"))
    return materialise(lines, "lines")


def _hashed(bits: int, *values: str | Column) -> Column:
    """A hash of so many bits: the others would be shuffled for nothing, as what meets by chance does no harm."""
    return F.xxhash64(*values).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def common_sequences(lines: DataFrame, least: Column) -> DataFrame:
    """document_id, ngram, n_words and n_pages of the sequences of 3 to 14 words within lines that stand on ``least`` pages
    or more of their document. A sequence is common only where all of its three words in a row are.

    Three words go as a hash with their document, with the hash of their line and their place in it, in one shuffle; the text
    of lines goes once, to the places that are common. Where hashes meet by chance, a place is looked at in vain: sequences are
    counted as they are written. Nothing is gathered by document."""
    first, most = NGRAM_WORDS
    # no sequence stands on more pages than there are
    lines = lines.withColumns({"_least": least, "_line": _hashed(40, "document_id", "page", "n")}).filter(F.col("n_pages") >= F.col("_least"))
    word = lambda i, k: F.element_at("_words", i + k)
    tokens = lines.select("document_id", "page", "_line", "_least", _words(F.col("line")).alias("_words")).filter(F.size("_words") >= first)
    threes = F.transform(F.sequence(F.lit(1), F.size("_words") - (first - 1)), lambda i: _hashed(48, "document_id", word(i, 0), word(i, 1), word(i, 2)))
    starts = tokens.select("page", "_line", "_least", F.posexplode(threes).alias("_i", "_hash"))
    same = Window.partitionBy("_hash")
    several = starts.withColumns({"_from": F.min("page").over(same), "_to": F.max("page").over(same)}).filter("_from < _to OR _least < 2").drop("_from", "_to")
    ranked = several.withColumn("_rank", F.dense_rank().over(same.orderBy("page"))).withColumn("_pages", F.max("_rank").over(same)).filter("_pages >= _least")
    marks = ranked.groupBy("_line").agg(F.sort_array(F.collect_set("_i")).alias("_at"))
    common = lines.select("document_id", "page", "_least", "_line", "line").join(marks, "_line").withColumn("_words", _words(F.col("line")))
    # up to twelve common starts from each one on; those that follow it without a gap make up longer sequences
    run = lambda i, j: F.size(F.filter(F.sequence(F.lit(0), F.lit(most - first)), lambda d: F.get("_at", j + d) == i + d))
    runs = F.transform("_at", lambda i, j: F.slice("_words", i + 1, run(i, j) + (first - 1)))
    own = common.select("document_id", "page", "_least", F.explode(runs).alias("_own"))
    sequences = F.transform(F.sequence(F.lit(first), F.size("_own")), lambda k: F.struct(k.alias("n_words"), F.array_join(F.slice("_own", F.lit(1), k), " ").alias("ngram")))
    rows = own.filter(F.size("_own") >= first).select("document_id", "page", "_least", F.inline(sequences)).repartition("document_id", "ngram").distinct()
    counted = rows.groupBy("document_id", "ngram", "n_words").agg(F.count("*").alias("n_pages"), F.first("_least").alias("_least"))
    return counted.filter("n_pages >= _least").drop("_least")


def page_ngrams(lines: DataFrame, least: Column) -> DataFrame:
    return common_sequences(lines, least).drop("n_words")


def maximal(sequences: DataFrame) -> DataFrame:
    """Those (document_id, ngram) that no other one of the document contains as text. Of two, the inner words of the
    one stand in the other between words that end and begin like its outer ones: they meet on these, not all with all."""
    some = sequences.select("document_id", "ngram", F.split("ngram", " ").alias("_w"))
    last_of, first_of = (lambda t: F.right(t, F.lit(1))), (lambda t: F.left(t, F.lit(1)))
    key = lambda before, inner, after: F.concat_ws(" ", last_of(before), inner, first_of(after))
    at = lambda i: F.element_at("_w", i)
    within = lambda i, j: F.array_join(F.slice("_w", i, j - i + 1), " ")
    size = F.size("_w")
    inner = some.select("document_id", "ngram", key(at(F.lit(1)), within(F.lit(2), size - 1), at(size)).alias("_key"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: key(at(i - 1), within(i, j), at(j + 1)))))
    outer = some.select("document_id", F.col("ngram").alias("_longer"), F.explode(F.array_distinct(spans)).alias("_key"))
    inside = inner.join(outer, ["document_id", "_key"]).filter((F.col("_longer") != F.col("ngram")) & F.contains("_longer", "ngram"))
    return sequences.select("document_id", "ngram").join(inside.select("document_id", "ngram"), ["document_id", "ngram"], "left_anti")


def boilerplate(lines: DataFrame) -> DataFrame:
    """document_id and furniture (running headers, longest first) of the documents that have any: maximal sequences
    on 40 % of four pages or more."""
    least = F.greatest(F.lit(LEAST_COUNT), F.ceil(F.col("n_pages") * PAGE_SHARE).cast("int"))
    headers = maximal(common_sequences(lines.filter(F.col("n_pages") >= LEAST_PAGES), least))
    longest_first = F.sort_array(F.collect_list(F.struct((-F.length("ngram")).alias("size"), "ngram")))
    return headers.groupBy("document_id").agg(F.transform(longest_first, lambda x: x["ngram"]).alias("furniture"))


def strip_furniture_col(line: Column, furniture: Column) -> Column:
    """``line`` without the headers that stand in it, each replaced before the next one."""
    here = F.filter(furniture, lambda ngram: F.contains(line, ngram))
    return F.when(furniture.isNull(), line).otherwise(collapse_space_col(F.aggregate(here, line, lambda text, ngram: F.replace(text, ngram, F.lit(" ")))))


def reflow(lines: DataFrame) -> DataFrame:
    """document_id, page, paragraph (number) and text of cleaned lines. A blank line ends a paragraph, as does a finished
    sentence before a bullet, capital or digit; a hyphen between small letters joins two lines without a space. Paragraphs
    of blank lines are empty."""
    page = Window.partitionBy("document_id", "page").orderBy("n")
    before, line = F.col("_before"), F.col("line")
    finished = before.rlike("[.!?:»]$") & line.rlike(rf"^[•▪●–—-]{SPACE}|^[A-ZÀ-Ý0-9]")
    begins = before.isNull() | (before == "") | (line == "") | finished
    rows = lines.withColumn("_before", F.lag("line").over(page)).withColumn("_begins", begins)
    rows = rows.withColumn("_joined", ~F.col("_begins") & before.rlike("[a-zà-ÿ]-$") & line.rlike("^[a-zà-ÿ]"))
    rows = rows.withColumns({"paragraph": F.sum(F.col("_begins").cast("int")).over(page), "_gives": F.coalesce(F.lead("_joined").over(page), F.lit(False))})
    part = F.concat(F.when(F.col("_begins") | F.col("_joined"), "").otherwise(" "), F.when(F.col("_gives"), F.regexp_replace("line", "-$", "")).otherwise(line))
    texts = F.sort_array(F.collect_list(F.struct("n", part.alias("part"))))
    return rows.groupBy("document_id", "page", "paragraph").agg(F.trim(F.array_join(F.transform(texts, lambda x: x["part"]), "")).alias("text"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """document_id, page, paragraph and text of pages, or of documents whose text has form feeds; empty paragraphs
    included. What documents of any length are read as; ``extract`` puts each together."""
    lines = paged_lines(pages)
    stripped = lines.join(boilerplate(lines), "document_id", "left")
    clean = F.array(let(strip_furniture_col(F.col("line"), F.col("furniture")), lambda x: let(join_spaced_capitals_col(x), collapse_doubled_capitals_col)))
    left = F.filter(clean, lambda x: (F.col("line") == "") | ((x != "") & ~is_page_number_col(x)))
    kept = stripped.select("document_id", "page", "n", F.explode(left).alias("line"))
    return reflow(kept).withColumn("text", collapse_doubled_capitals_col(F.col("text")))


def extract(pages: DataFrame) -> DataFrame:
    """document_id and text (a paragraph a line) of pages, or of documents whose text has form feeds."""
    parts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("page", "paragraph", "text"))))
    whole = paragraphs(pages).groupBy("document_id").agg(F.transform(parts, lambda x: x["text"]).alias("_parts"))
    return whole.select("document_id", F.concat(F.array_join("_parts", "\n"), F.lit("\n")).alias("text"))
