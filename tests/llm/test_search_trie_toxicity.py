"""Ranked search, toxicity and the prefix trie: brute force, odd rows, long inputs."""

import collections
import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatix.llm import lexical_search, prefix_trie, toxicity
from verbatix.llm.common import Scratch
from verbatix.llm.queries import QUERIES
from verbatix.llm.terms import counted_terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


# ranked search


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_terms_of_any_text(texts):
    names, term, text, count = counted_terms(pa.array(texts, pa.string()))
    got = collections.Counter()
    for t, i, c in zip(term, text, count, strict=True):
        got[int(i), names[int(t)].as_py()] += int(c)
    assert got == collections.Counter((i, w) for i, t in enumerate(texts) for w in terms_of(t))


@given(st.lists(st.integers(0, 2**62), max_size=50))
def test_numbers_round_trip(values):
    data, sizes = lexical_search.pack_numbers(np.array(values, np.int64))
    assert lexical_search.unpack_numbers(data).tolist() == values and len(data) == sizes.sum()


def brute_search(docs, items, k=20):
    counts = [collections.Counter(terms_of(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, length in zip(docs, counts, lengths, strict=True):
            if length:
                m = 75 + 25 * length * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
                if score > 0:
                    found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k])]
    return out


def test_search_odd_rows(spark):
    rng = random.Random(4)
    words = ["a", "B", "c3", "é", "𝄞", "_", "x-y", "the"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(7, docs[3][1]), (None, docs[3][1]), (-5, docs[3][1]), (400, None), (401, ""), (402, "..."), (403, "w1 " * 20_000)]
    items = [(1, "the W1 w1 é"), (1, "the W1 w1 é"), (None, "c3 _ x"), (3, None), (4, ""), (5, "unknown"), (6, " ".join(words * 3))]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, shard int, part int").repartition(5)
    queries = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in items], "item_id long, text string, rank int, score long, term int")
    scratch = Scratch(spark, "test")
    got = lexical_search.search(lexical_search.build(rows, scratch), queries, scratch).select("item_id", "rank", "doc_id", "score").collect()
    key = lambda r: tuple(-(10**9) if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_search(docs, items), key=key)
    none = lexical_search.build(rows.limit(0), scratch)
    assert lexical_search.search(none, queries, scratch).count() == 0
    assert lexical_search.search(lexical_search.build(rows, scratch), queries.limit(0), scratch).count() == 0


def test_shards_and_blocks_do_not_show(monkeypatch):
    """The same best documents with tiny shards, rows, steps and windows, over many shards."""
    rng = random.Random(5)
    docs = [(rng.choice([None, *range(50)]), " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))) for _ in range(200)]
    for name, value in {"STEP": 2, "WINDOW": 3, "ROW_TERMS": 2, "ROW_BYTES": 7}.items():
        monkeypatch.setattr(lexical_search, name, value)
    rows = [r for s in range(0, 200, 40) for r in lexical_search._shard_rows(s, [i for i, _ in docs[s : s + 40]], pa.array([t for _, t in docs[s : s + 40]], pa.large_string()))]
    n, total = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    df = collections.Counter()
    for r in rows:
        df.update(dict(zip(map(str, r["terms"]), map(int, r["counts"]), strict=True)))
    wanted = {"a": 2, "c": 1, "h": 1}
    batches = []
    for s in range(0, 200, 40):
        own = [r for r in rows if r["shard"] == s]
        batches.append(lexical_search._found([s], [-1], [0], [own[0]["data"]]))
        for r in own[1:]:
            ends = np.cumsum(r["sizes"])
            for t, size, end in zip(map(str, r["terms"]), r["sizes"], ends, strict=True):
                if t in wanted:
                    batches.append(lexical_search._found([s], [list(wanted).index(t)], [0], [r["data"][end - size : end]]))
    weights = {k: lexical_search.weight(n, df[t]) for k, t in enumerate(wanted)}
    run = lexical_search._searched([(0, {k: c for k, c in enumerate(wanted.values())})], weights, n, total, 20)
    found = [(s, i) for b in run(iter(batches)) for i, s in zip(b.column("doc_id").to_pylist(), b.column("score").to_pylist(), strict=True)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    assert sorted(found, key=key) == [(s, i) for _, _, i, s in brute_search(docs, [(0, "a a c h")])]


# toxicity


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    for n in (0, 1, 31, 32, 4000):
        vectors = []
        for _ in range(n):
            terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False, p=np.arange(40, 0, -1) / 820))
            w = rng.integers(1, 4, len(terms)).astype(float)
            vectors.append((terms, w / np.sqrt((w * w).sum())))
        vectors.sort(key=lambda v: toxicity.heaviest_first(*v))
        index = toxicity.BlockMax.of(vectors, 40)
        seen = 0
        for q in vectors[:: max(1, n // 60)] + [(np.array([3, 39]), np.array([0.6, 0.8]))]:
            exact = np.zeros(n)
            for k, (terms, w) in enumerate(vectors):
                own = dict(zip(terms, w, strict=True))
                for t, x in zip(*q, strict=True):
                    exact[k] += x * own.get(t, 0.0)
            want = [k for k in np.lexsort((np.arange(n), -exact))[:16] if exact[k] > 0]
            visited = []
            numbers, near = index.nearest(*q, 16, visited)
            assert numbers.tolist() == want and near.tolist() == exact[want].tolist()
            seen += len(visited)
        assert n < 4000 or seen < 0.6 * 61 * -(-n // toxicity.BLOCK)


def test_isotonic_rises():
    votes, scores = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.9, 0.8]), np.array([0, 1, 0, 1, 0]))
    assert (np.diff(votes) > 0).all() and (np.diff(scores) > 0).all() and 0 < scores.min() and scores.max() < 1
    votes, scores = toxicity.isotonic(np.zeros(0), np.zeros(0))
    assert np.interp(0.5, votes, scores) == pytest.approx(0.5)


def made_up(n=600):
    """Texts of which one in four is toxic by one of three words; every label is right."""
    rng, rows = random.Random(2), []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"word{rng.randint(0, 80)}" for _ in range(rng.randint(5, 40))] + toxic * rng.choices(["vile", "foulest", "rotten"], k=3)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_and_does_not_look_at_held_out_labels(spark):
    rows = made_up()
    odd = [(None, "vile rotten thing"), (700, None), (701, ""), (702, "vile " * 50_000), (3, "rotten foulest"), (3, "rotten foulest")]
    docs = spark.createDataFrame([(i, t, 5, 5) for i, t, _ in rows] + [(i, t, 5, 5) for i, t in odd], "doc_id long, text string, terms int, counts int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scored = lambda labels: sorted(map(tuple, toxicity.score(*toxicity.fit(docs, labels, Scratch(spark, "test"))).collect()), key=repr)
    got = scored(labels)
    assert len(got) == len(rows) + len(odd)
    by_doc = collections.defaultdict(list)
    for doc, held_out, score, predicted, evidence, nearness, terms in got:
        assert held_out == (doc is None or crc32(str(doc).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.5)
        assert all(crc32(str(e).encode()) % 5 in (1, 2, 3) for e in evidence) and sorted(nearness, reverse=True) == nearness
        by_doc[doc].append((predicted, score, terms))
    wrong = [i for i, _, y in rows if by_doc[i][0][0] != y and i != 3]
    assert len(wrong) <= 6
    assert [p for p, *_ in by_doc[None]] == [1] and by_doc[702][0][0] == 1 and by_doc[700] == by_doc[701] and by_doc[700][0][0] == 0
    assert {t for _, _, terms in by_doc[702] for t in terms} & {"vile", "vil*"}
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert scored(turned) == got
    nothing = toxicity.score(*toxicity.fit(docs, labels.limit(0), Scratch(spark, "test"))).collect()
    assert {r["score"] for r in nothing} == {0.0} and len(nothing) == len(got)
    assert toxicity.score(*toxicity.fit(docs.limit(0), labels, Scratch(spark, "test"))).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in QUERIES["op12_toxicity"](spark, sf_dir).filter("held_out").collect() if r["doc_id"] in truth]
    toxic, clean = [s for s, _, y in got if y], [s for s, _, y in got if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.8
    assert np.mean([p == y for _, p, y in got]) > 0.95 and np.mean([p for _, p, y in got if not y]) < 0.03


# prefix trie


def brute_trie(rows, mix=None):
    """rows: (conv_id, turn, role, text); mix: conv_id -> (source, how many)."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, digest(role or "", text or ""), len((text or "").encode())))
    own = {c: [x[2:] for x in sorted(t)] for c, t in talks.items()}
    built = {c: (own.get(mix(c)[0], [])[: mix(c)[1]] + t[mix(c)[1] :] if mix else t) for c, t in own.items()}
    members, size = collections.defaultdict(list), {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            name = (d, hash(tuple(t[:d])))
            members[name].append(c)
            size[name] = (t[d - 1][1] if d else 0), ((d - 1, hash(tuple(t[: d - 1]))) if d else None)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for name in members:
        kids[size[name][1]] += 1
    for name in sorted(members, reverse=True):
        leaves[name] += not kids[name]
        saved[name] += (len(members[name]) - 1) * size[name][0]
        if size[name][1] is not None:
            leaves[size[name][1]] += leaves[name]
            saved[size[name][1]] += saved[name]
    ends = collections.defaultdict(list)
    for c, t in built.items():
        ends[len(t), hash(tuple(t))].append(c)
    least = {name: min(m) for name, m in members.items()}
    hashed = lambda name: hashlib.sha256(",".join(map(str, sorted(ends[name]))).encode()).hexdigest()
    return sorted((least[n], n[0], -(10**9) if n[0] == 0 else least[size[n][1]], len(m), kids[n], leaves[n], saved[n], hashed(n)) for n, m in members.items())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, mix=None, most=0, extra=None):
    scratch = Scratch(spark, "test")
    table = spark.createDataFrame(rows, CONVERSATIONS)
    turns = prefix_trie.ordered_turns(table if extra is None else table.withColumns(extra), scratch)
    both = (turns, turns.select("conv_id").distinct()) if mix is None else prefix_trie.mixed(turns, mix, most, scratch)
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in prefix_trie.trie(*both, scratch).collect())


def test_trie_of_odd_rows(spark):
    rng = random.Random(9)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "é𝄞", None, "", "bye"])) for c in rng.choices(range(-30, 60), k=700)]
    rows += [(None, 0, "user", "lost"), (99, 1, "u", "same"), (99, 1, "u", "same")]
    mix = lambda c: (c - math.fmod(c, 5), crc32(str(c).encode()) % 9)
    start = lambda c: (c - c % 5, F.crc32(c.cast("string")) % 9)
    assert trie_of(spark, rows, start, 8, {"key": F.lit(1), "depth": F.lit(2), "place": F.lit(3)}) == brute_trie(rows, lambda c: (int(mix(c)[0]), mix(c)[1]))
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == []


def test_trie_of_long_conversations(spark):
    """Conversations and paths of several blocks, and a node that many conversations end at."""
    long = prefix_trie.BLOCK * 2 + 300
    rows = [(c, t, "user", f"turn {t}" if t < at else f"own {c} {t}") for c, at, n in ((1, long, long), (2, 1500, long), (3, 1500, 1600), (4, 0, 1100), (5, long, long - 7)) for t in range(n)]
    rows += [(c, 0, "user", "turn 0") for c in range(100, 400)]
    assert trie_of(spark, rows) == brute_trie(rows)
