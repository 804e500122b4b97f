"""Terms of many texts at once: maximal runs of ASCII letters, digits and all that is not ASCII, with only A-Z
made small. One table maps the bytes of a block; Arrow splits at the spaces that are left and numbers the terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import as_text

_MAP = np.arange(256, dtype=np.uint8)
_MAP[:0x80] = [ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(0x80)]


def lowered(texts: pa.Array) -> pa.Array:
    """``texts`` with separators as spaces; UTF-8 stays valid, as only ASCII bytes change."""
    one = as_text(texts)
    offsets = np.frombuffer(one.buffers()[1], np.int64)[one.offset : one.offset + len(one) + 1] if len(one) else np.zeros(1, np.int64)
    data = one.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(_MAP[raw])])


def numbered_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, term of each occurrence by its number, text of each occurrence). A null text has none."""
    lists = pc.ascii_split_whitespace(lowered(pc.fill_null(as_text(texts), "")))
    text_of = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = lists.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(terms, pa.scalar("", terms.type)).as_py()
    if empty >= 0:  # before the first term, or behind the last
        kept = codes != empty
        codes, text_of = codes[kept], text_of[kept]
    return terms, codes, text_of


def counted_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, then by term and text: term number, text number, occurrences)."""
    terms, codes, text_of = numbered_terms(texts)
    keys, counts = np.unique(codes * max(len(texts), 1) + text_of, return_counts=True)
    return terms, keys // max(len(texts), 1), keys % max(len(texts), 1), counts
