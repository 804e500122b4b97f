"""Folds over long arrays, as Column expressions.

An array that a fold appends to is copied at every step. Here the values are cut into chunks, each chunk is
folded into a short array of its own, and chunks start from the folded totals of those before: the work
grows in proportion to the length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
#: Code points in a block of ``text_blocks``.
BLOCK = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    start = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(step(acc["at"], x).cast(kind).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def _chunks(values: Column) -> Column:
    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(values) > 0, cut).otherwise(F.array(values))


def scan(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each of ``values`` the fold of those before it. ``step`` is associative."""

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero.cast(kind), lambda a, x: step(a, x).cast(kind)))
        starts = let(totals, lambda t: _fold(t, zero, step, kind))
        return F.flatten(F.zip_with(chunks, starts, lambda c, s: _fold(c, s, step, kind)))

    return let(values, lambda v: let(_chunks(v), of_chunks))


def sums_before(values: Column, kind: str = "int") -> Column:
    return scan(values, F.lit(0), lambda a, x: a + x, kind)


def text_blocks(text: Column) -> Column:
    """``text`` in blocks of BLOCK code points, from which ``cut`` takes parts without a walk from the beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` (from 0) to ``stop`` of the text in ``blocks``."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor(stop / BLOCK).cast("int") - first + 1), "")
    return F.substr(near, start - first * BLOCK + 1, stop - start)
