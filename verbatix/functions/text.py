"""Text analysis as Column expressions, each with a plain Python twin for short strings on the driver.

Words are runs of a-z and 0-9 after lower-casing and accent removal. Terms are words of two characters or
more that are not stopwords and not numbers of more than four digits, brought to a light French stem.
Passages are analysed word by word in joins and aggregates; the array forms serve short texts (queries,
keywords, labels). Null texts have no words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords, in alphabetical order; words of negation and opposition are terms.
STOPWORDS = """
a afin ai ainsi alors apres as au aussi autre autres aux avant avez avoir avons bien car ce cela ces cet cette
ceux chaque comme d dans de des donc dont du elle elles en entre est et etaient etait ete etre eux il ils j je l
la le les leur leurs lui m ma mais me meme mes moins mon n ne ni nos notre nous on ont or ou par plus pour puis
qu quand que qui quoi s sa se sera seront ses si soit son sont sur t ta te tel telle tes toi ton tous tout toute
toutes tres tu un une vos votre vous y
""".split()

# Suffix rules in order; the first whose result differs and keeps four characters is taken.
SUFFIXES = (
    ("issements?$", ""),
    ("(?:atrice|ateur)s?$", ""),
    ("ations?$", ""),
    ("(alit|ilit|ivit|osit)es?$", "$1"),
    ("ements?$", ""),
    ("(?:ance|ence)s?$", ""),
    ("(?:able|ible)s?$", ""),
    ("(?:iste|isme)s?$", ""),
    ("(?:euse|eur)s?$", ""),
    ("(?:iere|ier)s?$", ""),
    ("aux$", "al"),
    ("(?:ees|ee|es|s|x)$", ""),
)
LEAST_STEM = 4
#: Stems of this length or more match by prefix.
LEAST_PREFIX = 5
MOST_TERMS = 60
#: JavaScript's white space as a Java character class; \s alone is ASCII there.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that lose marks U+0300 to U+036F by canonical decomposition, and what is left of each;
    the marks themselves come last and have no counterpart."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    drop = str.maketrans("", "", marks)
    bare = {c: b for c in map(chr, range(0x80, 0x2000)) if len(b := unicodedata.normalize("NFD", c).translate(drop)) == 1 and b != c}
    return "".join(bare) + marks, "".join(bare.values())


def strip_accents(text: str) -> str:
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text))


def strip_accents_col(text: Column) -> Column:
    """Letters outside the basic tables (below U+2000) stay as they are; none of them is a-z inside."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, *_accents())).otherwise(text)


def normalize_label(label: str) -> str:
    return strip_accents(label.strip().lower())


def normalize_label_col(label: Column) -> Column:
    return strip_accents_col(F.lower(F.regexp_replace(label, rf"^{SPACE}+|{SPACE}+\z", "")))


def collapse_space_col(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def truncate_col(text: Column, most: int) -> Column:
    """At most ``most`` characters and an ellipsis, cut at the last space if that stands beyond 60 %."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(last > most * 0.6, F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, rf"{SPACE}+\z", ""), F.lit("…")))


def fixed_col(number: Column, digits: int = 3) -> Column:
    """A double at so many decimals, as its exact binary value rounds: half up, away from zero for negative numbers. (SQL's
    ``round`` works on the shortest decimal form: it makes 1.005 of 1.0045, which is less than that.)

    Below one, a double that does not round to zero has no bit beyond the 66th. These are taken in three parts,
    all by exact operations, and the rest is whole numbers."""
    size, part = F.abs(number), float(1 << 22)
    first = (size - F.floor(size)) * part
    second = (first - F.floor(first)) * part
    third = (second - F.floor(second)) * part
    whole = lambda x: x.cast("decimal(38,0)")
    exact = lambda n: whole(F.lit(str(n)))
    bits = (whole(F.floor(first)) * exact(1 << 44)) + (whole(F.floor(second)) * exact(1 << 22)) + whole(F.floor(third))
    half_up = F.call_function("div", bits * exact(10**digits) + exact(1 << 65), exact(1 << 66))
    rounded = (F.floor(size) * 10**digits + half_up).cast("double") / float(10**digits)
    return F.when(size < float(1 << 42), F.when(number < 0, -rounded).otherwise(rounded)).otherwise(number)


# ---------------------------------------------------------------------------------------------
# words, terms, stems


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", strip_accents(text.lower())) if w]


def words_col(text: Column) -> Column:
    """array<string>; may hold empty strings at either end, which are no terms."""
    return F.split(strip_accents_col(F.lower(text)), "[^a-z0-9]+")


def stem(word: str) -> str:
    if len(word) < 5:
        return word
    for pattern, to in SUFFIXES:
        shorter = re.sub(pattern.replace("$", r"\Z"), to.replace("$1", r"\1"), word)
        if shorter != word and len(shorter) >= LEAST_STEM:
            word = shorter
            break
    if len(word) > 4 and word.endswith("e"):
        word = word[:-1]
    if len(word) > 4 and word[-1] == word[-2]:
        word = word[:-1]
    return word


def stem_col(word: Column) -> Column:
    rules = []
    for pattern, to in SUFFIXES:
        shorter = F.regexp_replace(word, pattern, to)
        rules.append(F.when((shorter != word) & (F.length(shorter) >= LEAST_STEM), shorter))
    # most words end in none of the suffixes
    any_suffix = "|".join(pattern for pattern, _ in SUFFIXES)
    cut = F.when(word.rlike(any_suffix), F.coalesce(*rules, word)).otherwise(word)
    no_e = F.regexp_replace(cut, "^(.{4,})e$", "$1")
    single = F.regexp_replace(no_e, r"^(.{3,})(.)\2$", "$1$2")
    return F.when(F.length(word) < 5, word).otherwise(single)


def any_of(words: Iterable[str]) -> str:
    """A pattern of ``words`` (of a-z and 0-9) in which common beginnings are tried once, the longer word first."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [c + pattern(rest) for c, rest in sorted(at.items()) if c]
        inner = ways[0] if len(ways) == 1 and "" not in at else f"(?:{'|'.join(ways)})" if ways else ""
        return inner + "?" if ways and "" in at else inner

    return pattern(tree)


def n_terms_col(plain: Column) -> Column:
    """How many words of a text without capitals and accents are terms. A count by one pattern, which makes no words."""
    stop = any_of(w for w in STOPWORDS if len(w) >= 2)
    return F.regexp_count(plain, F.lit(f"(?<![a-z0-9])(?!(?:{stop}|[0-9]{{5,}})(?![a-z0-9]))[a-z0-9]{{2,}}+"))


def words_of_stems(stems: Iterable[str], prefixes: Iterable[str]) -> str | None:
    """A pattern of the words whose stem may be one of ``stems`` or begin with one of ``prefixes``; None if there is none.
    A stem is the beginning of its word, but for -al of -aux."""
    wanted = {*stems, *prefixes}
    short = {s for s in wanted if len(s) < LEAST_STEM}  # of the word itself
    whole = short | {s[:-2] + "aux" for s in wanted if s.endswith("al")}
    ways = [any_of(wanted - short) + "[a-z0-9]*+"] if wanted - short else []
    ways += [any_of(whole) + "(?![a-z0-9])"] if whole else []
    return f"(?<![a-z0-9])(?:{'|'.join(ways)})" if ways else None


def is_term(word: str) -> bool:
    return len(word) >= 2 and word not in STOPWORDS and not (word.isdigit() and len(word) > 4)


def is_term_col(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(STOPWORDS) & ~word.rlike("^[0-9]{5,}$")


def stems(text: str) -> list[str]:
    return [stem(w) for w in words(text) if is_term(w)]


def stems_col(text: Column) -> Column:
    """The stems of a short text, in order and with repeats."""
    return F.transform(F.filter(words_col(F.coalesce(text, F.lit(""))), is_term_col), stem_col)


def query_stems(query: str) -> list[str]:
    return list(dict.fromkeys(stems(query)))[:MOST_TERMS]


def query_stems_col(query: Column) -> Column:
    return F.slice(F.array_distinct(stems_col(query)), 1, MOST_TERMS)


def match_expression(query: str) -> str | None:
    """The query in full-text notation, for display; None if no term is left."""
    parts = [f'"{s}"*' if len(s) >= LEAST_PREFIX else f'"{s}"' for s in query_stems(query)]
    return " OR ".join(parts) or None


def required_coverage(n: int) -> int:
    return n if n <= 2 else min(3, -(-n // 2))


def required_coverage_col(n: Column) -> Column:
    return F.when(n <= 2, n).otherwise(F.least(F.lit(3), F.ceil(n / 2).cast("int")))
