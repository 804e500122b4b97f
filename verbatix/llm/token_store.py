"""Token ids in files, compressed by a Re-Pair grammar for each shard.

Documents are ordered by doc_id. A task writes a range of doc_id (``shard``) as blocks, cut at document borders,
of about 2^19 ids; each block is a shard of the grammar. There the most frequent adjacent id pairs are replaced by
nonterminals, round after round, until no pair pays for its rule. A block keeps the rules, the expansion length of
every rule, the remaining sequence (rules and sequence in 16 bits a symbol, or 32 where there are more symbols), anchors (the number of ids before every
1024th symbol) and each document's id and length, so that any range of ids is decoded from the symbols that
cover it.

The container is Parquet, one row for each block: written by Spark's committer, readable from any store.

Defined results: a null or empty text has only the end id; a null doc_id comes first; equal doc_ids are
neighbours in any order; an empty table gives a store without blocks; other columns are ignored. A document
lies in one block, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from operator import or_
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import SpacedText
from .common import arrow_schema, load_tokenizer
from .words import as_text, chunked, pack_lists, packed

FILE = "byte_bpe_50k.json"
END_ID = 2
#: A rule takes two symbols of 16 bits and a length of 32; a replacement saves one symbol: a pair pays from here.
LEAST = 5
#: So many symbols fit into 16 bits; a pair of them is a key of 32 bits, of others one of 64.
NARROW = 1 << 16
#: Pairs with this share of the occurrences of the most frequent one are replaced in the same round.
SHARE = 1 / 8
#: Symbols between two anchors, which hold the number of ids before them.
ANCHOR = 1024
SCHEMA = "shard int, block int, n_docs int, n_ids long, vocabulary int, first_doc long, last_doc long, doc_ids binary, null_docs int, doc_lengths binary, rules binary, rule_lengths binary, width int, symbols binary, anchors binary"


@lru_cache(maxsize=2)
def text_encoder(file: str) -> SpacedText:
    """A word of letters after a space is one piece of the vocabulary's pattern, and its first token alone
    begins with the space; a line feed before a word of letters is a piece of one token."""
    one = load_tokenizer(file)
    starts = np.zeros(one.get_vocab_size(), bool)
    starts[[i for token, i in one.get_vocab().items() if token.startswith("\u0120") or token == "\u010a"]] = True

    def plain(words: pa.Array) -> pa.Array:
        ids = [np.array(e.ids, np.uint32) for e in one.encode_batch_fast(chunked(words), add_special_tokens=False)]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        return packed(flat, np.diff(np.append(np.flatnonzero(starts[flat]), len(flat))))

    def whole(texts: list[str]) -> pa.Array:
        return pack_lists([e.ids for e in one.encode_batch_fast(texts, add_special_tokens=False)])

    return SpacedText(plain, whole)


def grammar(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, their expansion lengths, symbols). Rule k, for symbol ``vocabulary + k``, is a pair of symbols.

    A round counts all pairs that can still pay, takes those with at least SHARE of the occurrences of the most
    frequent one, and replaces their occurrences from left to right: of two that overlap the first one stands,
    and a pair left with too few is counted again in the next round. If all are left with too few, pairs that
    cannot overlap each other are taken, the most frequent ones first. Rounds end when no pair pays for its rule.
    Pairs are keys of 32 bits as long as symbols have 16, then of 64. A pair that does not pay never will, as only pairs with a new symbol
    become more frequent: its places are not looked at again until a neighbour is replaced."""
    seq, rules, last = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), len(ids)
    # neighbours of every place; a replaced pair leaves its second place out
    after, before = np.arange(1, last + 2, dtype=np.int32), np.arange(-1, last, dtype=np.int32)
    open_, left = np.ones(last, bool), np.ones(last, bool)
    open_[-1:] = False
    spent: set[int] = set()
    kind, bits = np.uint32, 16
    while True:
        room = NARROW - vocabulary - len(rules)
        if room <= 0:
            room = (1 << 32) - vocabulary - len(rules)
            if bits == 16:
                kind, bits = np.uint64, 32
                spent = {(pair >> 16) << 32 | pair & 0xFFFF for pair in spent}
        at = np.flatnonzero(open_)
        keys = (seq[at].astype(kind, copy=False) << kind(bits)) | seq[after[at]]
        pairs, seen = _counted(keys, spent)
        if not len(pairs):
            break
        pays = _member(pairs, keys)
        open_[at[~pays]] = False
        at, keys = at[pays], keys[pays]
        chosen = _most_frequent(pairs, seen, max(LEAST, SHARE * seen.max()), room)
        places, hit, made = _replaceable(at, keys, chosen, after)
        if not len(made):
            chosen = _apart(pairs, seen, room, bits)
            places, hit, made = _replaceable(at, keys, chosen, after)
            if not len(made):  # runs of one symbol that overlap themselves
                spent.update(chosen.tolist())
                continue
        seq[places] = vocabulary + len(rules) + hit
        rules = np.concatenate([rules, np.stack([chosen[made] >> kind(bits), chosen[made] & kind((1 << bits) - 1)], axis=1).astype(np.uint32)])
        gone = after[places]
        after[places] = after[gone]
        before[after[gone]] = places
        open_[places] = open_[np.maximum(before[places], 0)] = True
        open_[gone] = left[gone] = False
        open_[places[after[places] >= last]] = False
    return rules, _lengths(rules, vocabulary), seq[left]


def _counted(keys: np.ndarray, spent: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that pay for a rule, ascending, and how often each occurs."""
    ordered = np.sort(keys)
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    edge = np.concatenate(([0], edge, [len(ordered)])) if len(ordered) else np.zeros(1, np.int64)
    seen = np.diff(edge)
    pays = seen >= LEAST
    pairs, seen = ordered[edge[:-1][pays]], seen[pays]
    if spent:
        left = ~np.isin(pairs, np.fromiter(spent, pairs.dtype, len(spent)))
        pairs, seen = pairs[left], seen[left]
    return pairs, seen


def _most_frequent(pairs: np.ndarray, seen: np.ndarray, least: float, room: int) -> np.ndarray:
    pairs, seen = pairs[seen >= least], seen[seen >= least]
    return np.sort(pairs[np.argsort(-seen, kind="stable")[:room]])


def _apart(pairs: np.ndarray, seen: np.ndarray, room: int, bits: int) -> np.ndarray:
    """Pairs of which none begins with a symbol that another ends with, the most frequent ones first."""
    out, begins, ends = [], set(), set()
    for pair in pairs[np.argsort(-seen, kind="stable")].tolist():
        a, b = pair >> bits, pair & ((1 << bits) - 1)
        if a not in ends and b not in begins and (a != b or a not in begins and a not in ends):
            out.append(pair)
            begins.add(a)
            ends.add(b)
    return np.sort(np.array(out[:room], pairs.dtype))


def _member(pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among the pairs, by one bit of their hashes: few others are."""
    slot = (lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(12)) if keys.dtype == np.uint32 else (lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44))
    table = np.zeros(1 << 20, bool)
    table[slot(pairs)] = True
    return table[slot(keys)]


def _replaceable(at: np.ndarray, keys: np.ndarray, chosen: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the new rule at each, indices of the chosen pairs that become rules)."""
    maybe = _member(chosen, keys)
    at, keys = at[maybe], keys[maybe]
    hit = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
    same = chosen[hit] == keys
    at, hit = at[same], hit[same]
    # of a run of neighbouring places every other one is free
    run = np.flatnonzero(np.concatenate(([True], at[1:] != after[at[:-1]]))[: len(at)])
    free = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
    at, hit = at[free], hit[free]
    made = np.flatnonzero(np.bincount(hit, minlength=len(chosen)) >= LEAST)
    number = np.full(len(chosen), -1, np.int64)
    number[made] = np.arange(len(made))
    good = number[hit] >= 0
    return at[good], number[hit[good]], made


def _lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Expansion lengths: a rule's symbols come before it."""
    out = np.ones(vocabulary + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[vocabulary + k] = out[a] + out[b]
    return out[vocabulary:]


def unfold(symbols: np.ndarray, rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``symbols``, and which symbol each comes from. Only the rules that these need are opened."""
    flat, owner = symbols.astype(np.int64), np.arange(len(symbols))
    while (inner := flat >= vocabulary).any():
        twice = np.repeat(np.arange(len(flat)), np.where(inner, 2, 1))
        second = np.concatenate(([False], twice[1:] == twice[:-1]))
        flat, owner = flat[twice], owner[twice]
        nested = flat >= vocabulary
        flat[nested] = rules[flat[nested] - vocabulary, second[nested].astype(int)]
    return flat, owner


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of a whole block: every rule is opened once, and its ids are copied."""
    if not len(rules):
        return symbols.astype("<u4")
    flat, owner = unfold(vocabulary + np.arange(len(rules)), rules, vocabulary)
    begin = np.searchsorted(owner, np.arange(len(rules)))
    table = np.concatenate([flat, np.arange(vocabulary)])
    offset = np.concatenate([len(flat) + np.arange(vocabulary), begin])
    size = np.concatenate([np.ones(vocabulary, np.int64), lengths.astype(np.int64)])[symbols]
    until = np.cumsum(size)
    index = np.repeat(offset[symbols] - (until - size), size) + np.arange(until[-1] if len(until) else 0)
    return table[index].astype("<u4")


def all_ids(row) -> np.ndarray:
    """The ids of a block."""
    rules, lengths, symbols = _grammar_of(row)
    return expand(symbols.astype(np.int64), rules, lengths, row.vocabulary)


def some_ids(row, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block: the anchors name the symbols that hold them, and only the rules
    that these symbols need are opened."""
    rules, lengths, symbols = _grammar_of(row)
    anchors = np.frombuffer(row.anchors, "<u8").astype(np.int64)
    stop = min(stop, row.n_ids)
    if start >= stop:
        return np.zeros(0, "<u4")
    first = int(np.searchsorted(anchors, start, "right")) - 1
    near = symbols[first * ANCHOR : int(np.searchsorted(anchors, stop, "left")) * ANCHOR].astype(np.int64)
    inner = near >= row.vocabulary
    size = np.ones(len(near), np.int64)
    size[inner] = lengths[near[inner] - row.vocabulary]
    until = anchors[first] + np.cumsum(size)
    a, b = int(np.searchsorted(until, start, "right")), int(np.searchsorted(until, stop, "left")) + 1
    skipped = start - int(until[a] - size[a])
    return unfold(near[a:b], rules, row.vocabulary)[0][skipped : skipped + stop - start].astype("<u4")


def _grammar_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.rules, f"<u{row.width}").astype(np.uint32).reshape(-1, 2), np.frombuffer(row.rule_lengths, "<u4"), np.frombuffer(row.symbols, f"<u{row.width}")


def _pack_block(shard: int, block: int, docs: list, parts: list[bytes], vocabulary: int) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), "<u4")
    rules, lengths, symbols = grammar(ids, vocabulary)
    width = 2 if vocabulary + len(rules) <= NARROW else 4
    nulls = sum(d is None for d in docs)  # they come first
    size = np.concatenate([np.ones(vocabulary, np.int64), lengths.astype(np.int64)])[symbols]
    row = {
        "shard": shard, "block": block, "n_docs": len(docs), "n_ids": len(ids), "vocabulary": vocabulary, "first_doc": docs[nulls] if nulls < len(docs) else None, "last_doc": docs[-1],
        "doc_ids": np.array(docs[nulls:], "<i8").tobytes(), "null_docs": nulls, "doc_lengths": np.array([len(p) // 4 for p in parts], "<i8").tobytes(),
        "rules": rules.astype(f"<u{width}").tobytes(), "rule_lengths": lengths.astype("<u4").tobytes(), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes(),
        "anchors": (np.cumsum(size) - size)[::ANCHOR].astype("<u8").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], arrow_schema(SCHEMA))


def write_store(docs: DataFrame, path: str, file: str = FILE, end_id: int = END_ID, vocabulary: int = 50257, block_ids: int = 1 << 19) -> None:
    """Encodes doc_id and text of ``docs`` and writes the store at ``path``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, shard, end = text_encoder(file), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        ids, parts, size, block = [], [], 0, 0
        for batch in batches:
            for doc, coded in zip(batch["doc_id"].to_pylist(), one.ids(as_text(batch["text"])), strict=True):
                ids.append(doc)
                parts.append(coded + end)
                size += len(parts[-1]) // 4
                if size >= block_ids:
                    yield _pack_block(shard, block, ids, parts, vocabulary)
                    ids, parts, size, block = [], [], 0, block + 1
        if ids:
            yield _pack_block(shard, block, ids, parts, vocabulary)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a store, with ``first_id``: the number of ids in all blocks before."""
    store = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_first"))
    blocks = store.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_first"))
    firsts = blocks.join(shards, "shard").select("shard", "block", (F.col("shard_first") + F.col("block_first")).alias("first_id"))
    return store.join(firsts, ["shard", "block"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's ids."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, sizes = memoryview(all_ids(row).tobytes()), np.frombuffer(row.doc_lengths, "<i8")
                until = np.cumsum(sizes)
                known = [None] * row.null_docs + np.frombuffer(row.doc_ids, "<i8").tolist()
                sums = [crc32(ids[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), until.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(known, "Int64"), "start": row.first_id + until - sizes, "n_tokens": sizes, "ids_crc32": np.array(sums, np.int64)})

    return read_store(spark, path).mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_some(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id and ids (packed, the end id included) of the stored documents with one of a few ids: blocks of other
    ranges are not read, and of a block only the symbols that hold a document are opened."""
    wanted = sorted(set(doc_ids))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                until = np.cumsum(np.frombuffer(row.doc_lengths, "<i8"))
                known = np.frombuffer(row.doc_ids, "<i8")
                begin = np.concatenate(([0], until))[row.null_docs :]
                here = np.flatnonzero(np.isin(known, wanted))
                yield pd.DataFrame({"doc_id": known[here], "ids": [some_ids(row, int(begin[i]), int(begin[i + 1])).tobytes() for i in here]})

    near = [(F.col("first_doc") <= i) & (F.col("last_doc") >= i) for i in wanted]
    blocks = spark.read.schema(SCHEMA).parquet(path).filter(reduce(or_, near, F.lit(False)))
    return blocks.mapInPandas(documents, "doc_id long, ids binary")
