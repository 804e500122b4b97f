"""Editorial text of HTML pages: title, and a line for each block of the main content.

Template elements (navigation, headers, forms, embeds) are dropped. The content is the first of a list of
containers whose first instance holds more than 400 characters, else the body. A block that contains other
blocks is descended into; a blank line follows headings.

Pages are relations of tokens: one row for each element and each run of text, numbered in document order,
an element with the number of its last token. A Python cutter only names the tokens and where elements end;
what lies inside what is a comparison of numbers, found by windows within a page. All steps share one shuffle
by page, and each takes time linear in a page's tokens after its sort.

Defined results: a null or empty page has an empty title and text; repeated pages are read each; an empty
table gives an empty table; columns named html, title and text are replaced, others kept under any name.
References to surrogates or beyond Unicode become U+FFFD; a broken declaration is a comment.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import SPACE

# What is dropped, where content is looked for, and what counts as a block.
DROP_TAGS = "script style noscript svg iframe form button nav header footer aside".split()
DROP_ROLES = "navigation banner contentinfo".split()
DROP_CLASSES = """
menu nav navbar navigation breadcrumb sidebar footer header cookie cookies newsletter share social partage
skip-link screen-reader-text twitter-tweet instagram-media fb-post wp-block-embed
""".split()
CONTAINERS = ("main article", "article", "main", "[role=main]", ".entry-content", ".post-content", ".page-content", ".content", "#content")
BLOCKS = "h1 h2 h3 h4 h5 h6 p li blockquote dt dd td th figcaption pre".split()
LEAST_CONTENT = 400
NOISE = (
    r"(?<![A-Za-z0-9_])(?:pic\.twitter\.com|t\.co)/\S+",
    r"(?iu)^Retrouvez ce passage à la page [0-9]+ du livre-programme",
    r"(?iu)^Vous pouvez aussi l['’]obtenir dans des magasins",
    r"(?iu)^\*?\s*dans l['’]édition de .{0,40}ISBN",
)
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#0?39;|&apos;|&rsquo;|&#8217;", "'"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…"), ("&(?:ndash|mdash);", "–"),
)
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: An opening tag closes an open element of these kinds.
CLOSED_BY = {"li": {"li"}, "p": {"p", "div"}, "td": {"td", "th"}, "th": {"td", "th"}, **{f"h{i}": {f"h{i}"} for i in range(1, 7)}}



# ---------------------------------------------------------------------------------------------
# tokens

_STRINGS = ("tag", "role", "id", "class", "text")
_TOKEN = ", ".join([*(f"{c}: string" for c in _STRINGS), "last: int"])


class _Cutter(HTMLParser):
    """Tokens of one page, as columns: elements have a tag, runs of text have a text. Token 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.strings, self.last = {c: [] for c in _STRINGS}, []
        self.open, self.depth = [], Counter()  # numbers of the open elements, and how many there are of a tag
        self.token(tag="")
        self.open.append(0)

    def token(self, **values: str | None) -> int:
        for c, column in self.strings.items():
            column.append(values.get(c))
        self.last.append(len(self.last))
        return len(self.last) - 1

    def element(self, tag, attrs) -> int:
        named = dict(attrs)
        return self.token(tag=tag, **{c: named[c] or "" for c in ("role", "id", "class") if c in named})

    def innermost(self) -> str:
        return self.strings["tag"][self.open[-1]]

    def leave(self) -> str:
        tag = self.innermost()
        self.depth[tag] -= 1
        self.last[self.open.pop()] = len(self.last) - 1
        return tag

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY.get(self.innermost(), ()):
            self.leave()
        at = self.element(tag, attrs)
        if tag not in VOID:
            self.open.append(at)
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.element(tag, attrs)

    def handle_endtag(self, tag):
        if self.depth[tag]:  # else it closes nothing
            while self.leave() != tag:
                pass

    def handle_data(self, data):
        self.token(text=data)

    def handle_entityref(self, name):
        self.token(text=f"&{name};")

    def handle_charref(self, name):
        self.token(text=f"&#{name};")

    def cut(self, page: str) -> int:
        """The number of tokens."""
        self.feed(page)
        self.close()
        while self.open:
            self.leave()
        return len(self.last)


def tokens_col(html: Column) -> Column:
    """array<struct<tag, role, id, class, text, last>>; a token's number is its place."""

    @F.arrow_udf(f"array<struct<{_TOKEN}>>")
    def cut(pages: pa.Array) -> pa.Array:
        columns, last, sizes = {c: [] for c in _STRINGS}, [], [0]
        for page in pages:
            one = _Cutter()
            sizes.append(one.cut(page.as_py() or ""))
            last.append(np.array(one.last, np.int32))
            for c in _STRINGS:
                columns[c].append(pa.array(one.strings[c], pa.string()))
        fields = {c: pa.concat_arrays(parts or [pa.array([], pa.string())]) for c, parts in columns.items()}
        fields["last"] = pa.array(np.concatenate([*last, np.zeros(0, np.int32)]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return cut(html)


# ---------------------------------------------------------------------------------------------
# texts


def _character(point: Column) -> Column:
    """U+FFFD for a surrogate, for what lies beyond Unicode and for null."""
    there = point.between(0, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return F.when(there, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _decode_numbers(text: Column, pattern: str, base: int) -> Column:
    """Each match of ``pattern``, whose group 1 holds digits, becomes its character."""

    def character(digits: Column) -> Column:
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        return _character(F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("long")))

    def decoded(text: Column) -> Column:
        pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        joined = F.array_join(F.zip_with(pieces, F.transform(found, character), lambda piece, c: F.concat(piece, F.coalesce(c, F.lit("")))), "")
        return F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)

    return let(text, decoded)


def decode_entities_col(text: Column) -> Column:
    """Named ones first, in the order of ENTITIES, so that what they leave is decoded again."""
    for pattern, to in ENTITIES:
        text = F.regexp_replace(text, pattern, to)
    return _decode_numbers(_decode_numbers(text, "&#([0-9]+);", 10), "(?i)&#x([0-9a-f]+);", 16)


def tidy_col(text: Column) -> Column:
    """Entities decoded, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(decode_entities_col(text), SPACE + "+", " "))


def _is_noise(line: Column) -> Column:
    return reduce(Column.__or__, (line.rlike(p) for p in NOISE))


# ---------------------------------------------------------------------------------------------
# elements


def _so_far(last: int = 0) -> WindowSpec:
    """A page's tokens up to the present one, or up to so many before it."""
    return Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, last)


def _has_class(*names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.split("class", SPACE + "+", -1), F.array(*map(F.lit, names))), F.lit(False))


def _selected(selector: str) -> Column:
    if " " in selector:
        outer, inner = selector.split(" ")
        return (F.col("tag") == inner) & (F.max(F.when(F.col("tag") == outer, F.col("last"))).over(_so_far(-1)) >= F.col("at"))
    if selector[0] == ".":
        return _has_class(selector[1:])
    if selector[0] == "#":
        return F.col("id") == selector[1:]
    if selector[0] == "[":
        name, value = selector[1:-1].split("=")
        return F.col(name) == value
    return F.col("tag") == selector


def _inside(element: str) -> Column:
    """Whether a token lies in an element (a struct of at and last), itself included."""
    return F.coalesce(F.col("at").between(F.col(f"{element}.at"), F.col(f"{element}.last")), F.lit(False))


def visible(tokens: DataFrame) -> DataFrame:
    """Tokens outside dropped elements."""
    dropped = F.col("tag").isin(DROP_TAGS) | F.coalesce(F.col("role").isin(DROP_ROLES), F.lit(False)) | _has_class(*DROP_CLASSES)
    gone = tokens.withColumn("gone_to", F.max(F.when(dropped, F.col("last"))).over(_so_far()))
    return gone.filter("gone_to is null or gone_to < at").drop("gone_to")


def with_content(tokens: DataFrame) -> DataFrame:
    """Visible tokens with ``title`` and ``content``, elements of their page as struct<at, last>."""
    text, upto = F.col("text"), F.sum(F.length("text")).over(_so_far())
    bare = F.regexp_replace(text, rf"^{SPACE}+", "")
    right = F.length(text) - F.length(F.regexp_replace(text, rf"{SPACE}+\z", ""))
    page = Window.partitionBy("_row")
    selectors = {f"c{k}": s for k, s in enumerate(CONTAINERS)}
    # what is left of an element's text when white space at its ends goes, as places in the page's text
    placed = tokens.withColumns({"starts": F.when(bare != "", upto - F.length(bare)), "ends": F.when(bare != "", upto - right), **{f"is_{c}": _selected(s) for c, s in selectors.items()}})
    first = lambda test: F.min(F.when(test, F.struct("at", "last"))).over(page)
    found = placed.withColumns({**{c: first(F.col(f"is_{c}")) for c in selectors}, "body": first(F.col("tag") == "body"), "title": first(F.col("tag") == "title"), "page": first(F.col("at") == 0)})
    sized = found.withColumns({f"size_{c}": F.max(F.when(_inside(c), F.col("ends"))).over(page) - F.min(F.when(_inside(c), F.col("starts"))).over(page) for c in selectors})
    content = F.coalesce(*(F.when(F.col(f"size_{c}") > LEAST_CONTENT, F.col(c)) for c in selectors), "body", "page")
    return sized.select("_row", "_page", "at", "last", "tag", "text", "title", content.alias("content"))


def with_lines(tokens: DataFrame) -> DataFrame:
    """The same with ``line``, the innermost block of the content that a token lies in, if no other block lies in it."""
    blocks = tokens.withColumn("is_block", F.coalesce(F.col("tag").isin(BLOCKS), F.lit(False)))
    following = blocks.withColumn("next_at", F.lead("at").over(Window.partitionBy("_row", "is_block").orderBy("at")))
    leaf = F.col("is_block") & _inside("content") & (F.col("at") > F.col("content.at")) & (F.col("next_at").isNull() | (F.col("next_at") > F.col("last")))
    lined = following.withColumn("line", F.last(F.when(leaf, F.struct("at", "last", "tag")), ignorenulls=True).over(_so_far()))
    return lined.withColumn("line", F.when(_inside("line"), F.col("line")))


def _texts(test: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(test & F.col("text").isNotNull(), F.struct("at", "text"))))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: x["text"]), "")


def extract(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """``pages`` with title and text in place of their HTML."""
    kept = [c for c in pages.columns if c.lower() not in ("html", "title", "text")]
    carried = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)))
    cut = pages.select(F.monotonically_increasing_id().alias("_row"), carried.alias("_page"), tokens_col(F.col("html") if html is None else html).alias("_tokens"))
    rows = cut.select("_row", "_page", F.posexplode("_tokens").alias("at", "token"))
    tokens = rows.select("_row", F.when(F.col("at") == 0, F.col("_page")).alias("_page"), "at", "token.*")
    lined = with_lines(with_content(visible(tokens)))
    by_line = lined.groupBy("_row", "line").agg(
        F.first("_page", ignorenulls=True).alias("_page"),
        _texts(F.col("line").isNotNull()).alias("parts"),
        _texts(_inside("title")).alias("titled"),
    )
    text = by_line.withColumn("tidy", tidy_col(_joined(F.col("parts"))))
    shown = F.when(F.col("line.tag").rlike("^h[1-6]$"), F.concat("tidy", F.lit("\n"))).otherwise(F.col("tidy"))
    by_page = text.groupBy("_row").agg(
        F.first("_page", ignorenulls=True).alias("_page"),
        F.array_sort(F.flatten(F.collect_list("titled"))).alias("titled"),
        F.array_sort(F.collect_list(F.when((F.col("tidy") != "") & ~_is_noise(F.col("tidy")), F.struct("line.at", shown.alias("text"))))).alias("lines"),
    )
    whole = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), "\n{3,}", "\n\n")
    names = [F.col(f"_page.k{i}").alias(c) for i, c in enumerate(kept)]
    return by_page.select(*names, tidy_col(_joined(F.col("titled"))).alias("title"), F.regexp_replace(whole, rf"^{SPACE}+|{SPACE}+\z", "").alias("text"))
