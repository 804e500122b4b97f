"""Token ids of many texts at once: Arrow splits and numbers the words, each distinct word is encoded once, and
Arrow lays the ids of all words end to end. Words of letters are remembered with their ids up to a number of
bytes; then those of the last block are what is left."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22
#: Bytes of remembered words and ids.
MEMO_BYTES = 1 << 25
# Letters of the Latin blocks, on whose class all libraries agree and whose lower case is one letter: not U+0130, not U+0149.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-įıĲ-ňŊ-ſ"
# Marks of ASCII that end a word are a piece of their own; an apostrophe may be more.
_MARKS = r"(?P<mark>[!-&(-/:-@\[-`{-~]*)"
_BARE = rf"\A(?P<stem>[{_LETTERS}]+){_MARKS}\z"
_AFTER_SPACE = rf"\A(?P<stem>[ \n][{_LETTERS}]+){_MARKS}\z"
_CHUNK = 2048


def as_text(texts: pa.Array) -> pa.Array:
    """``texts`` as one large string array."""
    one = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return one.cast(pa.large_string())


def packed(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array whose rows hold ``sizes`` ids each, little-endian unsigned 32-bit."""
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def pack_lists(lists: list[list[int]]) -> pa.Array:
    flat = np.fromiter((i for ids in lists for i in ids), "<u4")
    return packed(flat, np.fromiter(map(len, lists), np.int64, len(lists)))


def chunked(words: pa.Array, between: str = "") -> list[str]:
    """The words in long strings."""
    firsts = np.append(np.arange(0, len(words), _CHUNK, dtype=np.int64), len(words))
    lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), words.cast(pa.string()))
    return pc.binary_join(lists, between).to_pylist()


class Words:
    """Ids of words: ``plain`` takes an array of distinct words of letters (each after a space or line feed if
    ``after_space``), ``other`` a list of any other words or marks; both give an array of packed ids."""

    def __init__(self, plain: Callable[[pa.Array], pa.Array], other: Callable[[list[str]], pa.Array], after_space: bool = False):
        self.plain, self.other, self.pattern = plain, other, _AFTER_SPACE if after_space else _BARE
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def remembered(self, words: pa.Array) -> pa.Array:
        """``plain`` of the words that are not known yet."""
        place = pc.index_in(words, self.known)
        missing = pc.is_null(place)
        fresh = words.filter(missing)
        ids = pa.concat_arrays([self.known_ids, self.plain(fresh)]) if len(fresh) else self.known_ids
        index, new = place.fill_null(0).to_numpy().astype(np.int64), missing.to_numpy(zero_copy_only=False)
        index[new] = len(self.known) + np.arange(len(fresh))
        out = ids.take(pa.array(index))
        if self.known.nbytes + fresh.nbytes + ids.nbytes <= MEMO_BYTES:
            self.known, self.known_ids = pa.concat_arrays([self.known, fresh]), ids
        else:
            self.known, self.known_ids = words, out
        return out

    def table(self, words: pa.Array) -> pa.Array:
        """Packed ids of each of ``words``, which are distinct."""
        parts = pc.extract_regex(words, self.pattern)
        is_plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(is_plain))
        stems = parts.field("stem").dictionary_encode()
        known, rest = self.remembered(stems.dictionary), self.other(words.filter(pa.array(~is_plain)).to_pylist())
        piece = np.empty(len(words), np.int64)
        piece[is_plain] = stems.indices.to_numpy()
        piece[~is_plain] = len(known) + np.arange(len(rest))
        marks = parts.field("mark").dictionary_encode()
        mark = np.full(len(words), len(marks.dictionary), np.int64)
        mark[is_plain] = marks.indices.to_numpy()
        pieces, ends = pa.concat_arrays([known, rest]), self.other([*marks.dictionary.to_pylist(), ""])
        return pc.binary_join_element_wise(pieces.take(pa.array(piece)), ends.take(pa.array(mark)), pa.scalar(b"", pa.large_binary()))

    def lists(self, words: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The packed ids of all words of a list array, end to end, and where each list begins in them (in
        bytes, one more at the end). A null list has no words."""
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        flat = self.table(coded.dictionary).take(coded.indices)
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = flat.buffers()[2]
        return memoryview(data if data is not None else b"").cast("B"), offsets[np.concatenate(([0], np.cumsum(lengths)))]
