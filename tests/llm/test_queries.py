"""The registered queries over whole tables against brute force or SQL, on the driver's sf0.01 tables."""

import base64
import hashlib
import re
import struct
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from verbatix.llm import license_scan, sharding
from verbatix.llm.queries import QUERIES, SQL

DOCS = ["documents", "conversations", "embeddings", "benchmark", "labels"]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in DOCS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(db):
    return db.execute("SELECT doc_id, coalesce(text, ''), source, lang FROM documents ORDER BY doc_id").fetchall()


def rows_of(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def ids_hash(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, map(tuple, want.fetchall())))


def test_byte_bpe(spark, sf_dir, docs):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op2_byte_bpe")}
    assert len(got) == len(docs)
    for doc, text, *_ in docs:
        ids = one.encode_ordinary(text)
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), ids_hash(ids), hashlib.sha256(text.encode()).hexdigest())


SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute_secrets(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(SECRETS.items()) for m in p.finditer(text) if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_secrets(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op3_secret_scan")}
    some = 0
    for doc, text, *_ in docs:
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_secrets(text))
        some += bool(spans)
        assert got[doc]["spans"] == spans and got[doc]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert got[doc]["n_assign"] == spans.count("assign:") and got[doc]["n_hex"] == spans.count("hex:") and got[doc]["n_access"] == spans.count("access:")
    assert some > 10


def test_licences(spark, sf_dir, docs):
    """Vectors, the best template of every line and the nearest directory, all in plain Python."""
    vocabulary = {t for _, text in license_scan.TEMPLATES for t in license_scan.terms_of(text)}
    df = dict.fromkeys(vocabulary, 0)
    for _, text, *_ in docs:
        for t in vocabulary & set(license_scan.terms_of(text)):
            df[t] += 1
    w = license_scan.Weights(license_scan.TEMPLATES, df, len(docs), license_scan.THRESHOLD)
    own, granted, path_of = {}, {}, {}
    for doc, text, source, lang in docs:
        path_of[doc] = "/".join([source, lang, *str(doc)[:-2], str(doc)])
        best = None
        for n, line in enumerate(text.split("\n"), 1):
            counts = {}
            for t in license_scan.terms_of(line):
                if t in vocabulary:
                    counts[t] = counts.get(t, 0) + w.idf[t]
            norm = sum(x * x for x in counts.values()) ** 0.5
            for k, v in enumerate(w.vectors):
                score = sum(x * v.get(t, 0) for t, x in counts.items()) / norm if norm else 0
                if score >= w.threshold and (best is None or score > best[0] + 1e-9):
                    best = (score, w.templates[k][0], n)
        own[doc] = best
        if best and best[2] == 1:
            above = path_of[doc].rpartition("/")[0]
            granted[above] = min(granted.get(above, (9,)), (round(-best[0], 9), path_of[doc], best[1]))
    seen = set()
    for r in rows_of(spark, sf_dir, "op4_license_scan"):
        doc, best = r["doc_id"], own[r["doc_id"]]
        if best:
            want = (best[1], "file", path_of[doc], best[2])
        else:
            above = path_of[doc].rpartition("/")[0]
            while above and above not in granted:
                above = above.rpartition("/")[0]
            want = (granted[above][2], "directory", granted[above][1], None) if above else (None, None, None, None)
        assert (r["licence"], r["licence_via"], r["licence_from"], r["licence_line"]) == want
        seen.add((want[0], want[1]))
    assert {("MIT", "file"), ("Apache-2.0", "file"), (None, None)} <= seen


def test_token_store(spark, sf_dir, docs):
    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op5_token_store")}
    start = 0
    for doc, text, *_ in docs:
        ids = [*one.encode(text, add_special_tokens=False).ids, 2]
        assert got[doc] == {"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": crc32(struct.pack(f"<{len(ids)}I", *ids))}
        start += len(ids)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_quality(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op6_quality_rules")}
    for doc, text, *_ in docs:
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(text)
        assert not (r["kept"] and r["base_failed"])
    assert 0.7 < sum(r["kept"] for r in got.values()) / len(got) < 1


def test_sharding(spark, sf_dir, docs):
    rows = rows_of(spark, sf_dir, "op7_sharding")
    text_of = {d: t for d, t, *_ in docs}
    slots = {}
    for r in rows:
        data = text_of[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, crc32(data), "key")
        assert r["shard"] == brute_shard(r["doc_id"], sharding.topology(24))
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 10 < sum(r["grown_shard"] == 24 for r in rows) < 80


def brute_shard(key, node):
    while node.children:
        def draw(child):
            u = (int(hashlib.md5(f"{key}:{child.name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -np.log(u) / child.weight
        node = min(node.children, key=draw) if len(node.children) > 1 else node.children[0]
    return node.shard


def test_packing(spark, sf_dir, docs):
    one = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    one.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows_of(spark, sf_dir, "op8_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, text, *_ in docs:
        ids = [*one.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), crc32(struct.pack(f"<{len(part)}I", *part)))
            at += p["length"]
        assert at == len(ids)
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padded, total = padded + (2048 if at & (at - 1) else at), total + at
    assert total / padded > 0.98


def brute_sets(texts, n):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    return out


def brute_groups(keys, sets, percent):
    """Links by an inverted index and exact counting; groups by union-find."""
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in index.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            index[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(keys[i]), find(keys[j])
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_jaccard_join(spark, sf_dir, docs):
    sets, keys = brute_sets([t for _, t, *_ in docs], 4), [d for d, *_ in docs]
    groups = brute_groups(keys, sets, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(spark, sf_dir, "op9_jaccard_join")}
    assert got == {k: (len(s), groups[k]) for k, s in zip(keys, sets, strict=True)}
    assert len(set(groups.values())) < len(keys) - 20


def test_nearest_neighbours(spark, sf_dir, db):
    rows = db.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in rows_of(spark, sf_dir, "op10_kmeans_tree"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for query, found in got.items():
        at = int(np.flatnonzero(ids == query)[0])
        scores = (x * x[at]).sum(axis=1)
        true = [i for i in np.lexsort((ids, -scores)) if i != at][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(scores[np.flatnonzero(ids == f[1])[0]], abs=1e-12) for f in found)
        hits += len({f[1] for f in found} & set(ids[true].tolist()))
    assert hits >= 0.95 * 20 * len(got)
