"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..shared import Scratch, materialise, new_path, shared_dir

__all__ = ["Scratch", "materialise", "new_path", "shared_dir"]

_LIBC = ctypes.CDLL(None)

# ---------------------------------------------------------------------------------------------
# Word hashing on whole Arrow batches

_SEED = np.random.default_rng(20240229)
_BYTE_HASH = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are hashed at once; a longer word is hashed by tables of its own.
_PIECE = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        one, two = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (_BASE, inverse))
    return one, two


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * _PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby values spread over all 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``, and their byte starts and ends."""
    raw = np.frombuffer(data, dtype=np.uint8)
    parts, start = [], 0
    while start < len(raw) or not parts:
        stop = len(raw)
        if stop - start > 2 * _PIECE:  # up to the next white space
            stop = start + _PIECE
            while stop < len(raw) and not (gaps := np.flatnonzero(_GAP[raw[stop : stop + _PIECE]])).size:
                stop += _PIECE
            stop = min(len(raw), stop + int(gaps[0])) if stop < len(raw) else len(raw)
        hashes, starts, ends = _piece_hashes(raw[start:stop])
        parts.append((hashes, starts + start, ends + start))
        start = stop
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A polynomial rolling hash over all bytes: the hash of a word is the difference of two prefix sums, brought
    back to position 0 by the inverse power of its start."""
    gap = np.concatenate(([True], _GAP[raw], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _usual_powers() if len(raw) <= 2 * _PIECE else _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        prefix = np.empty(len(raw) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE_HASH[raw] * power[: len(raw)], dtype=np.uint64, out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h), starts, ends


def spans(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive rows of about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def blocks_of(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows as (first row, encoded texts), of about ``most`` bytes; a null text is empty."""
    for start, stop in spans(texts, most):
        yield start, pc.fill_null(texts.slice(start, stop - start).cast(pa.binary()), b"").to_pylist()
    give_back()


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 1 << 22


def bound_batches(spark: SparkSession) -> None:
    """Spark counts the rows of a batch and lets it grow to 64 MB, twice over: texts are long, so it ends sooner here."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """The same while a block of code runs its jobs; then the session is as it was."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def give_back() -> None:
    """Returns to the system what a process has freed: idle workers stay beside the next stage."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_LIBC, "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


class Memo(dict):
    """Remembers ``make(key)`` for at most ``most`` keys; those before go when as many new ones have come,
    unless they were asked for again. Bounded memory, same results."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, name type, ..." with plain types."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name


def load_tokenizer(file: str):
    """A tokenizer that takes the strings of special tokens as ordinary text. Spark's tasks are the
    parallelism: the library starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path(file))
    one.encode_special_tokens = True
    return one
