"""Packing of examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has room for a number of tokens, of segments and of loss-bearing tokens. An example too large
for a sequence is cut into full ones first. What is left is placed bin by bin: of the pieces that fit in
all three dimensions, the next one has the largest dot product with the bin's remaining room. Where none
fits, the largest piece left is cut to fill the bin.

Every Spark task packs its own rows in blocks of bounded size, without a shuffle; at most the last
sequence of each block has padding for want of pieces.

Defined results: a null text or null ids make no tokens besides the end id; examples without tokens have
no piece; a null doc_id stays null; repeated rows are packed each; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, give_back, load_tokenizer, spans
from .words import BLOCK_BYTES, Words, as_text, chunked, pack_lists, packed

FILE = "word_bpe_49k.json"
END_ID = 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long, segment int, sequence_length long, padded_length long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


@lru_cache(maxsize=2)
def words_of(file: str) -> Words:
    """This vocabulary's tokenizer drops white space and never looks across it, nor from letters to
    punctuation. A plain word ends with the one token that ends a word."""
    one = load_tokenizer(file)
    ends = np.zeros(one.get_vocab_size(), bool)
    ends[[i for token, i in one.get_vocab().items() if token.endswith("</w>")]] = True

    def plain(words: pa.Array) -> pa.Array:
        ids = [np.array(e.ids, np.uint32) for e in one.encode_batch_fast(chunked(words, " "), add_special_tokens=False)]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        last = np.flatnonzero(ends[flat])
        return packed(flat, np.diff(last, prepend=-1))

    def other(words: list[str]) -> pa.Array:
        return pack_lists([e.ids for e in one.encode_batch_fast(words, add_special_tokens=False)])

    return Words(plain, other)


def encode_texts(texts: pa.Array, file: str, end_id: int) -> Iterator[bytes]:
    """Ids of each text (little-endian unsigned 32-bit integers, the end id last)."""
    words, end, texts = words_of(file), int(end_id).to_bytes(4, "little"), as_text(texts)
    for start, stop in spans(texts, BLOCK_BYTES):
        data, at = words.lists(pc.ascii_split_whitespace(texts.slice(start, stop - start)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield bytes(data[a:b]) + end
    give_back()


def tokenise(docs: DataFrame, file: str = FILE, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids of each text."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(list(encode_texts(texts, file, end_id)), pa.binary())

    return docs.select("doc_id", ids("text").alias("ids"))


def plan_bins(sizes: np.ndarray, losses: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, start, stop). ``losses``: each example's last so many tokens bear loss."""
    lost_from = sizes - losses
    room = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    bins: list[list[tuple[int, int, int]]] = []
    large = np.flatnonzero((sizes >= limits.tokens) | (losses >= limits.loss_tokens)).tolist()
    sizes, losses, lost_from, begin = sizes.tolist(), losses.tolist(), lost_from.tolist(), [0] * len(sizes)

    def furthest(i: int, tokens: int, loss: int) -> int:
        """Where a piece of example i, from its present begin, has to end at such limits."""
        return min(sizes[i], begin[i] + tokens, max(begin[i], lost_from[i]) + loss)

    for i in large:
        while (stop := furthest(i, limits.tokens, limits.loss_tokens)) - begin[i] == limits.tokens or (begin[i] < sizes[i] and stop < sizes[i]):
            bins.append([(i, begin[i], stop)])
            begin[i] = stop
    order = sorted((i for i in range(len(sizes)) if begin[i] < sizes[i]), key=lambda i: begin[i] - sizes[i])
    waiting = _Waiting(room)
    for place, i in enumerate(order):
        waiting.add(place, sizes[i] - begin[i], losses[i])
    while (k := waiting.first()) is not None:
        left, pieces = room.copy(), []
        while True:
            place = waiting.take(k)
            i = order[place]
            stop = furthest(i, int(left[0]), int(left[2]))
            pieces.append((i, begin[i], stop))
            left -= (stop - begin[i], 1, max(0, stop - max(begin[i], lost_from[i])))
            begin[i] = stop
            if stop < sizes[i]:
                waiting.add(place, sizes[i] - stop, losses[i])
            if left.min() < 1 or (k := waiting.best(left)) is None:
                break
            if waiting.needs[k][0] > left[0] or waiting.needs[k][2] > left[2]:  # none fits whole: the largest is cut
                i = order[waiting.heaps[k][0]]
                if furthest(i, int(left[0]), int(left[2])) == begin[i]:
                    break
        bins.append(pieces)
    return bins


class _Waiting:
    """Examples by their demand. All of one demand have one score, so a choice looks at each demand once, and then
    takes its example of the first place. Places are those of the order by size."""

    def __init__(self, room: np.ndarray):
        self.room, self.number, self.heaps = room, {}, []
        self.needs, self.heads = np.zeros((64, 3)), np.zeros(64, np.int64)

    def add(self, place: int, tokens: int, loss: int) -> None:
        need = (int(tokens), 1, int(min(tokens, loss)))
        k = self.number.setdefault(need, len(self.heaps))
        if k == len(self.heaps):
            self.heaps.append([])
            if k == len(self.heads):
                self.needs, self.heads = np.concatenate([self.needs, np.zeros_like(self.needs)]), np.concatenate([self.heads, np.zeros_like(self.heads)])
            self.needs[k] = need
        heapq.heappush(self.heaps[k], place)
        self.heads[k] = self.heaps[k][0]

    def take(self, k: int) -> int:
        place = heapq.heappop(self.heaps[k])
        self.heads[k] = self.heaps[k][0] if self.heaps[k] else _NOBODY
        return place

    def first(self) -> int | None:
        """The demand of the example of the first place."""
        heads = self.heads[: len(self.heaps)]
        k = int(heads.argmin()) if len(heads) else 0
        return k if len(heads) and heads[k] < _NOBODY else None

    def best(self, left: np.ndarray) -> int | None:
        """The demand that fits and has the largest dot product with the room that is left, or that of most tokens if none
        fits; of equal ones that of the first place."""
        if len(self.heaps) <= _FEW:
            return self._best_of_few(*left.tolist())
        needs, heads = self.needs[: len(self.heaps)], self.heads[: len(self.heaps)]
        share, free = needs / self.room, left / self.room
        score = share[:, 0] * free[0] + share[:, 1] * free[1] + share[:, 2] * free[2]
        there = heads < _NOBODY
        fits = there & (needs <= left).all(axis=1)
        value = np.where(fits, score, -1.0) if fits.any() else np.where(there, needs[:, 0], -1.0)
        if not len(value) or value.max() < 0:
            return None
        return int(np.where(value == value.max(), heads, _NOBODY).argmin())

    def _best_of_few(self, tokens: float, segments: float, loss: float) -> int | None:
        """The same by a plain loop."""
        a, b, c = self.room.tolist()
        found = None
        for (n, one, lossy), k in self.number.items():
            if self.heaps[k]:
                fits = n <= tokens and one <= segments and lossy <= loss
                rank = (fits, (n / a) * (tokens / a) + (one / b) * (segments / b) + (lossy / c) * (loss / c) if fits else n, -self.heaps[k][0])
                if found is None or rank > found[0]:
                    found = rank, k
        return found[1] if found else None


#: A place behind all others, and so many demands that a loop looks at sooner than arrays do.
_NOBODY, _FEW = 1 << 62, 8


def padded(length: int, most: int) -> int:
    """A sequence is padded to ``most``, or to no more than the next power of two if that is less."""
    return min(most, 1 << (length - 1).bit_length())


#: Sequences in a frame that goes to Spark.
_FRAME = 512


class _Block:
    """Examples of one task that wait to be packed together."""

    def __init__(self, limits: Limits, most_tokens: int, most_examples: int):
        self.limits, self.most_tokens, self.most_examples = limits, most_tokens, most_examples
        self.sequence = TaskContext.get().partitionId() << 33
        self._empty()

    def _empty(self) -> None:
        self.docs, self.parts, self.losses, self.size = [], [], [], 0

    def add(self, doc: int | None, data: bytes, loss: int) -> bool:
        """Whether the block is full."""
        self.docs.append(doc)
        self.parts.append(data)
        self.losses.append(min(loss, len(data) // 4))
        self.size += len(data) // 4
        return self.size >= self.most_tokens or len(self.parts) >= self.most_examples

    def sequences(self) -> Iterator[pd.DataFrame]:
        sizes, losses = np.array([len(p) // 4 for p in self.parts], np.int64), np.array(self.losses, np.int64)
        bins = plan_bins(sizes, losses, self.limits)
        for first in range(0, len(bins), _FRAME):
            rows = []
            for found in bins[first : first + _FRAME]:
                total, offset = sum(stop - start for _, start, stop in found), 0
                for segment, (i, start, stop) in enumerate(found):
                    loss = max(0, stop - max(start, int(sizes[i] - losses[i])))
                    rows.append((self.docs[i], start, stop - start, self.parts[i][4 * start : 4 * stop], int(sizes[i]), loss, self.sequence, offset, segment, total, padded(total, self.limits.tokens)))
                    offset += stop - start
                self.sequence += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})
        self._empty()


def _pack(rows: Iterator[tuple[int | None, bytes, int]], block: _Block) -> Iterator[pd.DataFrame]:
    for row in rows:
        if block.add(*row):
            yield from block.sequences()
    if block.parts:
        yield from block.sequences()


def _doc_ids(batch: pd.DataFrame) -> list[int | None]:
    return [None if d is pd.NA else int(d) for d in batch["doc_id"].astype("Int64")]


def pack(examples: DataFrame, limits: Limits = Limits(), block_tokens: int = 1 << 22, block_examples: int = 1 << 13) -> DataFrame:
    """Packs ``examples`` (doc_id, ids and, if there, loss_tokens: so many at the end bear loss, else all)."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((doc, data or b"", int(loss)) for batch in batches for doc, data, loss in zip(_doc_ids(batch), batch["ids"], batch["loss_tokens"], strict=True))
        yield from _pack(rows, _Block(limits, block_tokens, block_examples))

    loss = F.coalesce(F.col("loss_tokens"), F.lit(0)) if "loss_tokens" in examples.columns else F.octet_length("ids") / 4
    return examples.select("doc_id", "ids", F.greatest(F.coalesce(loss.cast("long"), F.lit(0)), F.lit(0)).alias("loss_tokens")).mapInPandas(pieces, PIECES)


def pack_texts(docs: DataFrame, file: str = FILE, end_id: int = END_ID, limits: Limits = Limits(), block_tokens: int = 1 << 22, block_examples: int = 1 << 13) -> DataFrame:
    """``pack(tokenise(docs))`` with all tokens bearing loss, in one Python process a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, ids, len(ids) // 4) for batch in batches for doc, ids in zip(batch["doc_id"].to_pylist(), encode_texts(batch["text"], file, end_id), strict=True))
        for frame in _pack(rows, _Block(limits, block_tokens, block_examples)):
            yield pa.RecordBatch.from_pandas(frame, arrow_schema(PIECES), preserve_index=False)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)
