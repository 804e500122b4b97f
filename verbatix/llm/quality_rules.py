"""Quality rules by repetition coverage.

Words are hashed with a rolling polynomial over a whole block of texts; windows of several lengths get
rolling hashes of their words. A window found twice or more in a text is duplicated, and the characters
of all words inside duplicated windows of a length, over the characters of all words, are that length's
coverage. Of the shortest windows the most frequent one counts as well, as any long text repeats pairs of
words: its number of places times its characters, over the characters of all words and at most 1. Lines are
measured alike. A document is kept if it passes the base rules and no measure exceeds its limit.

Defined results: a null or empty text has no words and fails; ties do not arise; repeated rows are judged
each; an empty table gives an empty table; added columns replace columns of the same name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, mix, word_hashes

#: Window length in words, and the most of a text's word characters that its duplicated windows may cover. From 5
#: words on the limits lie at or below the base rule's 20 % of words; below that, above what long clean texts repeat.
COVERAGE_LIMITS = {2: 0.80, 3: 0.50, 4: 0.35, 5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: The most of a text's word characters that the places of one repeated window may have.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: The most of a text's characters that may stand in lines equal to an earlier line.
LINE_LIMIT = 0.20
BASE_WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = {
    **dict.fromkeys(_COUNTS, "long"), "base_failed": "boolean", **{f"coverage_{n}": "double" for n in COVERAGE_LIMITS}, **{f"top_{n}": "double" for n in TOP_LIMITS}, "line_coverage": "double", "kept": "boolean",
}


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def duplicated_words(words: np.ndarray, text_of: np.ndarray, n: int, chars: np.ndarray | None = None, top: np.ndarray | None = None) -> np.ndarray:
    """Which words stand in a window of ``n`` words that their text holds twice or more. Into ``top``, by text,
    goes the largest product of such a window's places and ``chars``."""
    inside = np.zeros(len(words), bool)
    if len(words) < n:
        return inside
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            rolling = rolling * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - n + 1 + j]
        begin = np.flatnonzero(text_of[n - 1 :] == text_of[: len(words) - n + 1])
        keys = mix(rolling[begin] ^ mix(text_of[begin].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    if top is not None and same.any():
        edge = np.flatnonzero(np.concatenate(([True], ~same)))
        places = np.diff(np.append(edge, len(keys)))
        first, places = begin[order[edge[places > 1]]], places[places > 1]
        upto = np.concatenate(([0], np.cumsum(chars)))
        np.maximum.at(top, text_of[first], places * (upto[first + n] - upto[first]))
    change = np.zeros(len(words) + 1, np.int64)
    change[begin[twice]] += 1
    np.add.at(change, begin[twice] + n, -1)
    return np.cumsum(change[:-1]) > 0


def duplicated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line: how many, and how many characters they have."""
    lines = text.split(b"\n")
    if len(lines) == 1 or len(lines) == len(set(lines)):
        return 0, 0
    again = [(line, n - 1) for line, n in Counter(lines).items() if n > 1 and line.split()]
    return sum(n for _, n in again), sum(n * _code_points(line) for line, n in again)


def _code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "surrogatepass"))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for a block of encoded texts."""
    size = np.array([len(t) for t in texts], np.int64)
    data = b"\n".join(texts)
    first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    words, starts, ends = word_hashes(data)
    text_of = np.searchsorted(first, starts, "right") - 1
    points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    per_text = lambda weights: np.bincount(text_of, weights, minlength=len(texts)).astype(np.int64)
    out = {"n_words": per_text(None), "word_chars": per_text(chars)}
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    lines = [duplicated_lines(t) for t in texts]
    out["n_dup_lines"] = np.array([n for n, _ in lines], np.int64)
    kept = np.ones(len(texts), bool)
    for n, limit in COVERAGE_LIMITS.items():
        top = np.zeros(len(texts), np.int64) if n in TOP_LIMITS else None
        inside = duplicated_words(words, text_of, n, chars, top)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_text(inside)
        out[f"coverage_{n}"] = per_text(chars * inside) / np.maximum(out["word_chars"], 1)
        kept &= out[f"coverage_{n}"] <= limit
        if top is not None:
            out[f"top_{n}"] = np.minimum(top / np.maximum(out["word_chars"], 1), 1.0)
            kept &= out[f"top_{n}"] <= TOP_LIMITS[n]
    text_chars = points[first + size] - points[first]
    out["line_coverage"] = np.array([c for _, c in lines], np.int64) / np.maximum(text_chars, 1)
    kept &= out["line_coverage"] <= LINE_LIMIT
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = kept & ~out["base_failed"]
    return out


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of COLUMNS. Only the texts go to Python, in blocks of bounded size."""
    kind = ", ".join(f"{c}: {t}" for c, t in COLUMNS.items())

    @F.arrow_udf(f"struct<{kind}>")
    def measures(texts: pa.Array) -> pa.Array:
        found = [measure(block) for _, block in blocks_of(texts)]
        columns = [pa.array(np.concatenate([f[c] for f in found]) if found else [], _ARROW[t]) for c, t in COLUMNS.items()]
        return pa.StructArray.from_arrays(columns, list(COLUMNS))

    # measured once, though the verdict may be asked for before the other columns
    base = docs.drop(*COLUMNS)
    measured = base.withColumn("_measures", measures.asNondeterministic()(F.col(text)))
    return measured.select(*(F.col(f"`{c}`") for c in base.columns), "_measures.*")
