"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding: the token whose
pair with the last token of the shorter prefix is stable under the merges. A table of these last tokens
gives the encoding by walking back from the end, takes appended bytes by adding entries, and after an
edit needs new entries only until they agree with the old ones.

Texts are first cut by the vocabulary's pattern, and every match is encoded by itself, so results equal
those of a merge loop over each match. Decoding joins the tokens' bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each;
an empty table gives an empty table; other columns are kept as they are. Ids are little-endian unsigned
32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, give_back, spans, tokenizer_path
from .words import BLOCK_BYTES, Words, as_text, pack_lists

RANKS = "byte_bpe_50k.tiktoken"


class PrefixEncoder:
    """Encodes byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.size_of = {r: len(b) for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.texts = pa.array([self.bytes_of.get(i) for i in range(max(ranks.values()) + 1)], pa.large_binary())
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[int, bool] = Memo(lambda pair: self._pair_is_stable(pair >> 32, pair & 0xFFFFFFFF), 1_000_000)
        self._tokens = ahocorasick.Automaton()
        for data, rank in ranks.items():
            if self.halves(rank) is not None:
                self._tokens.add_word(data.decode("latin-1"), rank)
        self._tokens.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges join last to make ``token``; (token, token) for a single byte;
        None if the merges never make it."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < token]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (token, token) if len(data) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _pair_is_stable(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that make both tokens.

        Undoes the later of the two tokens' last merges again and again; each time, the parts that then
        meet at the border must not merge earlier than what was undone."""
        before = 1 << 62
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            left_half, right_half = self.halves(left)[1], self.halves(right)[0]
            if left_half == left and right_half == right:
                return True
            # of equal tokens the left one is made first: the right one is undone first
            if right_half == right or (left > right and left_half != left):
                before, left = left, left_half
            else:
                before, right = right + 1, right_half

    def extend(self, data: bytes, last: list[int], until: int) -> None:
        """Adds to ``last`` the entries of the prefixes up to ``until`` bytes. An automaton names the tokens
        that end at each byte."""
        stable, size_of = self._stable, self.size_of
        base = max(0, len(last) - self.longest)
        for at, token in self._tokens.iter(data[base:until].decode("latin-1")):
            end = base + at + 1
            if end > len(last):
                start = end - size_of[token]
                if start == 0 or start > 0 and stable[last[start - 1] << 32 | token]:
                    last.append(token)
        if len(last) < until:
            raise ValueError("the vocabulary lacks a byte")

    def walk_back(self, last: list[int]) -> list[int]:
        out, end, size_of = [], len(last), self.size_of
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size_of[token]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.encode_all([data])[0]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """In sorted order, a piece keeps the entries of the prefix that it shares with the one before."""
        out: list[list[int]] = [[]] * len(pieces)
        last: list[int] = []
        before = b""
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            data = pieces[k]
            whole = self.ranks.get(data)
            if whole is not None:
                out[k] = [whole]
                continue
            shared = len(commonprefix((before, data)))
            del last[shared:]
            self.extend(data, last, len(data))
            out[k], before = self.walk_back(last), data
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, rows: pa.Array) -> Iterator[bytes]:
        """The bytes of each row of packed ids."""
        for start, stop in spans(rows, BLOCK_BYTES):
            some = rows.slice(start, stop - start).fill_null(b"")
            sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            flat = self.texts.take(pa.array(np.frombuffer(b"".join(some.to_pylist()), "<u4")))
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset :] if len(flat) else np.zeros(1, np.int64)
            data, at = memoryview(flat.buffers()[2] or b"").cast("B"), offsets[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield bytes(data[a:b])


class EditableEncoding:
    """The encoding of one byte string that takes appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, []
        encoder.extend(data, self.last, len(data))
        self.recomputed = len(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last, len(self.data))
        self.recomputed = len(more)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Replaces bytes ``start`` to ``stop``. Entries before the edit stay; those after it are made anew
        until as many in a row as the longest token agree with the old ones: from there on all agree."""
        old_tail, tail_at = self.last[stop:], start + len(new)
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start:]
        self.encoder.extend(self.data, self.last, tail_at)
        alike = at = 0
        while at < len(old_tail) and alike < self.encoder.longest:
            self.encoder.extend(self.data, self.last, tail_at + at + 1)
            alike = alike + 1 if self.last[-1] == old_tail[at] else 0
            at += 1
        self.recomputed = len(new) + at
        self.last += old_tail[at:]

    def ids(self) -> list[int]:
        return self.encoder.walk_back(self.last)


# A run of white space is cut before its last character. Cutting a text before every space therefore gives the
# pattern's own pieces, unless a space has white space on both sides, or before it and the end after it. The
# same holds for a line feed without white space beside it, which is a piece of its own.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHOLE = rf"{_SPACE} (?:{_SPACE}|\z)|\x00"
_WIDE = rf"\n{_SPACE}|{_SPACE}\n"


class SpacedText:
    """Encodes texts cut before spaces and line feeds. ``plain`` gives the packed ids of words of letters, each after
    a space or line feed, ``whole`` those of a list of any strings."""

    def __init__(self, plain: Callable[[pa.Array], pa.Array], whole: Callable[[list[str]], pa.Array]):
        self.whole, self.words = whole, Words(plain, whole, after_space=True)

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        for start, stop in spans(texts, BLOCK_BYTES):
            block = texts.slice(start, stop - start)
            as_whole = pc.fill_null(pc.match_substring_regex(block, _WHOLE), False)
            spaced = pc.replace_substring(block, " ", "\x00 ")
            both = pc.if_else(pc.match_substring_regex(block, _WIDE), spaced, pc.replace_substring(spaced, "\n", "\x00\n"))
            data, at = self.words.lists(pc.split_pattern(pc.if_else(as_whole, None, both), "\x00"))
            whole = iter(self.whole(block.filter(as_whole).to_pylist()).to_pylist())
            for one, a, b in zip(as_whole.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield next(whole) if one else bytes(data[a:b])
        give_back()


def white_space_pattern(pattern: str) -> regex.Pattern:
    """The vocabulary's pattern, with ``\\s`` as the Unicode property White_Space."""
    space, other = r"\p{White_Space}", r"\P{White_Space}"
    return regex.compile(pattern.replace(r"[^\s", rf"[^{space}").replace(r"\S", other).replace(r"\s", space))


@lru_cache(maxsize=2)
def encoder(file: str = RANKS) -> PrefixEncoder:
    with open(tokenizer_path(file), "rb") as lines:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def text_encoder(file: str = RANKS, pattern: str | None = None) -> SpacedText:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    one, cut = encoder(file), white_space_pattern(pattern).findall

    def whole(texts: list[str]) -> pa.Array:
        parts = [cut(t) for t in texts]
        pieces = list({p for ps in parts for p in ps})
        ids = dict(zip(pieces, one.encode_all([p.encode() for p in pieces]), strict=True))
        return pack_lists([[i for p in ps for i in ids[p]] for ps in parts])

    def plain(words: pa.Array) -> pa.Array:
        """A line feed is a piece of its own."""
        pieces = words.to_pylist()
        ids = one.encode_all([p.removeprefix("\n").encode() for p in pieces])
        feed = one.encode(b"\n")
        return pack_lists([feed + i if p[0] == "\n" else i for p, i in zip(pieces, ids, strict=True)])

    return SpacedText(plain, whole)


def encode(df: DataFrame, file: str = RANKS, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each text in ``out``."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(list(text_encoder(file).ids(as_text(texts))), pa.binary())

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, file: str = RANKS, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each row's ids in ``out``; null ids have no bytes."""

    @F.arrow_udf("binary")
    def data(rows: pa.Array) -> pa.Array:
        return pa.array(list(encoder(file).decode_all(rows)), pa.binary())

    return df.withColumn(out, data(F.col(ids)))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
