"""Odd rows for every operator and stage: nulls, empty and very long texts, ties, repeats, empty tables,
extra columns with clashing names."""

import hashlib
import random
import re
import textwrap
import time
from importlib.metadata import distribution
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_queries import brute_groups, brute_quality, brute_sets, brute_shard
from verbatix.llm import byte_bpe, chat_format, jaccard_join, kmeans_tree, license_scan, packing, quality_rules, secret_ledger, sharding, token_store, words
from verbatix.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "null id words " * 3), (5, "a b c d e"), (5, "a b c d e"), (7, LONG), (8, LONG), (9, "é́𝄞 ß  x \n\n  y  "), (10, "password: hunter22 AKIA" + "Z" * 16 + " " + "ab" * 12)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "\\b \\e \\c ### x", None, "", "</turn", "### ", "a: b\n</turn>\n###"]
    turns = [(1, i, ("assistant", "user", None, "a:b")[i % 4], t, 9) for i, t in enumerate(texts)] + [(None, 0, "user", "x", 1), (None, 1, "assistant", "y", 1), (2, None, "assistant", "y", 1), (2, None, "assistant", "y", 1)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pieces int")
    examples = chat_format.prefix_target_examples(rows)
    got = examples.select("*", chat_format.read_turns(F.col("text")).alias("turns"), chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    for r in got:
        if r["conv_id"] == 1:
            want = [(t[2] or "", t[3] or "") for t in turns[: r["target_turn"]]]
            assert [(t["role"], t["text"]) for t in r["turns"]] == want
            assert r["loss"] == (want[-1][1] if want[-1][0] == "assistant" else "")
    assert [r["target_turn"] for r in got if r["conv_id"] == 1] == [1, 5, 7]
    assert len([r for r in got if r["conv_id"] == 2]) == 2 and sorted((r["n_turns"], r["loss"]) for r in got if r["conv_id"] is None) == [(1, ""), (1, "y")]
    assert chat_format.prefix_target_examples(rows.limit(0)).count() == 0


# 2


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("abcdefghi thing,.'\n\t 0123é  ß́𝄞s")), max_size=50))
def test_bpe_equals_tiktoken(text):
    import base64

    import public_tokenizers as P
    import tiktoken

    if not hasattr(test_bpe_equals_tiktoken, "one"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
        test_bpe_equals_tiktoken.one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = test_bpe_equals_tiktoken.one.encode_ordinary(text)
    assert np.frombuffer(next(byte_bpe.text_encoder().ids(pa.array([text], pa.large_string()))), "<u4").tolist() == want
    assert byte_bpe.encoder().decode(want) == text.encode()


@settings(max_examples=60, deadline=None)
@given(first=st.binary(max_size=60), more=st.binary(max_size=30), at=st.integers(0, 60), cut=st.integers(0, 20))
def test_appends_and_edits_are_exact(first, more, at, cut):
    one = byte_bpe.encoder()
    kept = byte_bpe.EditableEncoding(one, first)
    kept.append(more)
    assert kept.ids() == byte_bpe.EditableEncoding(one, first + more).ids()
    at = min(at, len(first))
    stop = min(at + cut, len(first + more))
    kept.replace(at, stop, b"edited words")
    data = (first + more)[:at] + b"edited words" + (first + more)[stop:]
    assert kept.data == data and kept.ids() == byte_bpe.EditableEncoding(one, data).ids()


def test_an_edit_stays_near():
    kept = byte_bpe.EditableEncoding(byte_bpe.encoder(), LONG.encode())
    kept.replace(1000, 1003, b"xyz")
    assert kept.recomputed < 1000 and kept.ids() == byte_bpe.EditableEncoding(byte_bpe.encoder(), kept.data).ids()


def test_bpe_rows(odd, none):
    got = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert [bytes(r["decoded"]).decode() for r in got] == [t or "" for _, t in ODD]
    assert byte_bpe.encode(none).count() == 0


ODD_LETTERS = st.text(alphabet=st.sampled_from(list("abz İıŉßéÀ.,;!$'\n\t 09\x00\x1c\xa0 \u0301ǅ中🙂<|>_-s")) | st.sampled_from("abc, \n"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(ODD_LETTERS | st.sampled_from([None, "", "İ.", "İ, x", "foo.\nBar", "a  b", " x", "x ", "<|endoftext|>", "it's 'sx"]), min_size=1, max_size=20))
def test_words_equal_the_library(texts):
    """Both vocabularies of the tokenizers library, text by text as a whole."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    for file, got in (("byte_bpe_50k.json", token_store.text_encoder(token_store.FILE).ids(pa.array(texts, pa.large_string()))), ("word_bpe_49k.json", packing.encode_texts(pa.array(texts, pa.large_string()), packing.FILE, 1))):
        one = LIBRARY.setdefault(file, Tokenizer.from_file(P.path(file)))
        one.encode_special_tokens = True
        for text, ids in zip(texts, got, strict=True):
            end = [1] if file == packing.FILE else []
            assert np.frombuffer(ids, "<u4").tolist() == one.encode(text or "", add_special_tokens=False).ids + end


LIBRARY = {}


def test_remembered_words_stay_few(monkeypatch):
    monkeypatch.setattr(words, "MEMO_BYTES", 4000)
    one = packing.words_of(packing.FILE)
    for block in range(5):
        text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + block)}" for i in range(400))
        want = [i for w in text.split() for i in np.frombuffer(bytes(one.other([w])[0].as_py()), "<u4")]
        assert np.frombuffer(next(packing.encode_texts(pa.array([text]), packing.FILE, 1)), "<u4").tolist() == [*want, 1]
        assert len(one.known) <= 800


# 3


def test_ledger_scans_only_what_is_unseen(spark, odd):
    path = new_path(spark, "ledger-test")
    versions = odd.withColumn("path", F.col("doc_id")).withColumns({"blob": F.lit("x"), "findings": F.lit(1)})
    first = secret_ledger.scan(spark, versions, path)
    assert first.count() == len(ODD)
    rows = secret_ledger.read_ledger(spark, path)
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD}
    assert rows.count() == 3 * len(blobs) and {r["blob"] for r in rows.collect()} == blobs
    found = {r["doc_id"]: [(f["rule"], f["start"], f["end"]) for f in r["findings"]] for r in first.collect()}
    assert found[10] == [("assign", 0, 18), ("access", 19, 39), ("hex", 40, 64)]
    secret_ledger.scan(spark, versions, path)
    assert secret_ledger.read_ledger(spark, path).count() == 3 * len(blobs)
    secret_ledger.read_ledger(spark, path).filter("rule = 'hex'").limit(100).write.mode("append").parquet(path)  # as a retry may
    twice = {r["doc_id"]: len(r["findings"]) for r in secret_ledger.scan(spark, versions, path).collect()}
    assert twice == {i: len(f) for i, f in found.items()}
    path = new_path(spark, "ledger-test")
    secret_ledger.scan(spark, versions, path)
    newer = [secret_ledger.RULES[0], *(secret_ledger.Rule("hex", r"[0-9a-f]{30,}", r"[0-9a-f]{30}", version=2),)]
    again = {r["doc_id"]: [f["rule"] for f in r["findings"]] for r in secret_ledger.scan(spark, versions, path, newer).collect()}
    assert again[10] == ["assign"]
    assert secret_ledger.read_ledger(spark, path).count() == 4 * len(blobs)
    assert secret_ledger.scan(spark, versions.limit(0), path).count() == 0


def test_many_matches_in_one_text(spark):
    """A hundred thousand matches are placed and masked within seconds."""
    text = " ".join(f"é password: hunter{i}" for i in range(100_000))
    rows = spark.createDataFrame([(1, text)], "path int, text string")
    began = time.monotonic()
    found = secret_ledger.scan(spark, rows)
    got = found.select("findings", secret_ledger.redact(F.col("text"), F.col("findings")).alias("masked")).first()
    assert time.monotonic() - began < 60
    assert [(f["start"], f["end"]) for f in got["findings"]] == [m.span() for m in re.finditer("password: [a-z0-9]+", text)]
    assert got["masked"] == re.sub("password: [a-z0-9]+", "[SECRET]", text)


def test_masking_takes_overlaps_as_one(spark):
    spans = [(2, 5), (3, 4), (4, 9), (9, 10), (12, 3000), (2999, 3001)]
    text = "".join(chr(0x1F600 + i % 40) if i % 3 else chr(97 + i % 26) for i in range(5000))
    rows = spark.createDataFrame([(text, [(a, b) for a, b in spans])], "text string, findings array<struct<start: int, end: int>>")
    masked = rows.select(secret_ledger.redact(F.col("text"), F.col("findings"), "#")).first()[0]
    assert masked == text[:2] + "#" + "#" + text[10:12] + "#" + text[3001:]


# 4


def test_licences_come_down_the_tree(spark):
    apache = license_scan.TEMPLATES[2][1]
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", "# " + apache + "\nmore code"), ("a/b/z.py", None),
        ("a/c/COPYING", apache), ("a/c/d/e/f.py", ""), ("top.py", "text about a license of the kind"), (None, "Released under the MIT License."), (None, "x"), ("a/x.py", "code"),
    ]
    rows = spark.createDataFrame([(p, t, "mine") for p, t in files], "path string, text string, licence string")
    scanned = license_scan.inherit(license_scan.scan(rows, license_scan.corpus_weights(rows)))
    got = sorted((str(r["path"]), str(r["licence"]), str(r["licence_via"]), str(r["licence_from"])) for r in scanned.collect())
    assert got == sorted([
        ("a/LICENSE", "MIT", "file", "a/LICENSE"), ("a/x.py", "MIT", "directory", "a/LICENSE"), ("a/x.py", "MIT", "directory", "a/LICENSE"),
        ("a/b/y.py", "Apache-2.0", "file", "a/b/y.py"), ("a/b/z.py", "MIT", "directory", "a/LICENSE"), ("a/c/COPYING", "Apache-2.0", "file", "a/c/COPYING"),
        ("a/c/d/e/f.py", "Apache-2.0", "directory", "a/c/COPYING"), ("top.py", "None", "None", "None"), ("None", "MIT", "file", "None"), ("None", "None", "None", "None"),
    ])
    empty = rows.limit(0)
    assert license_scan.inherit(license_scan.scan(empty, license_scan.corpus_weights(empty))).count() == 0


HEADERS = {  # as projects write them, wrapped
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
}
PROSE = "The state of the house was such that any person could see it from the road, and in the end we had to sell the whole of it.\n" * 30


def test_wrapped_headers_and_licence_texts(spark):
    """Headers over several lines, behind comment marks and in prose; whole licence texts, by name or by opening."""
    want, files = {}, []
    for name, text in HEADERS.items():
        for width in (40, 72, 80):
            lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""])]
            for mark in ("", "# ", " * "):
                path = f"{name}/{width}{mark.strip()}.py"
                files.append((path, "import os\nimport re\n" + "".join(mark + line + "\n" for line in lines) + "\n" + "def f(x): return x + 1\n" * 40))
                want[path] = (name, 3)
    for name, text in license_scan.TEXTS:
        holder = "Copyright (c) 2019-2024 Ada Example <ada@example.org> and others\n\n"
        for path, body in ((f"whole/{name}/LICENSE", text), (f"whole/{name}/17", text), (f"whole/{name}/18", holder + text), (f"whole/{name}/19", textwrap.fill(text, 50))):
            files.append((path, body))
            want[path] = (name, 0)
    for path, text in (("prose/LICENSE", PROSE), ("prose/1", "Permission and copyright are words.\n" + PROSE), ("prose/2", PROSE + "the license"), ("prose/3", "license\n" * 50)):
        files.append((path, text))
        want[path] = (None, None)
    rows = spark.createDataFrame(files, "path string, text string").repartition(8)
    got = {r["path"]: (r["licence"], r["licence_line"]) for r in license_scan.scan(rows, license_scan.corpus_weights(rows)).collect()}
    assert got == want


def test_licence_texts_below_other_lines(spark):
    """A full text is found wherever it begins: below blank lines, or below notes without any word of a licence."""
    want, files = {}, []
    for name, text in license_scan.TEXTS:
        for kind, above in (("blank", "\n" * 25), ("notes", "see below\n" * 60)):
            files.append((f"{kind}/{name}", above + text))
            want[f"{kind}/{name}"] = (name, 0)
    files.append(("prose", PROSE + "the license"))
    want["prose"] = (None, None)
    rows = spark.createDataFrame(files, "path string, text string").repartition(4)
    got = {r["path"]: (r["licence"], r["licence_line"]) for r in license_scan.scan(rows, license_scan.corpus_weights(rows)).collect()}
    assert got == want


def test_licence_files_of_packages(spark):
    """Licence files as published, of packages that these tests use: by name and by opening."""
    want = {"pytest": "MIT", "duckdb": "MIT", "tiktoken": "MIT", "hypothesis": "MPL-2.0", "psutil": "BSD-3-Clause"}
    text = {p: next(f for f in distribution(p).files if f.name.startswith("LICENSE") and ".dist-info" in str(f)).locate().read_text() for p in want}
    rows = spark.createDataFrame([(f"{p}/{name}", t) for p, t in text.items() for name in ("LICENSE", "7")], "path string, text string")
    got = {r["path"]: r["licence"] for r in license_scan.scan(rows, license_scan.corpus_weights(rows)).collect()}
    assert got == {f"{p}/{name}": licence for p, licence in want.items() for name in ("LICENSE", "7")}


# 5


def test_store_of_odd_rows(spark, odd, none):
    path = new_path(spark, "store-test")
    token_store.write_store(odd, path)
    got = token_store.read_documents(spark, path).collect()
    assert len(got) == len(ODD) and sorted(r["n_tokens"] for r in got)[:3] == [1, 1, 4]
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = lambda text: [*LIBRARY_OF_STORE().encode(text or "", add_special_tokens=False).ids, 2]
    want = sorted((len(ids(t)), crc32(np.array(ids(t), "<u4").tobytes())) for _, t in ODD)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    some = token_store.read_some(spark, path, [5, 9, 10, 11]).collect()
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in some) == sorted((i, ids(t)) for i, t in ODD if i in (5, 9, 10))
    token_store.write_store(none, path := new_path(spark, "store-test"))
    assert token_store.read_documents(spark, path).count() == 0


def LIBRARY_OF_STORE():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    one = LIBRARY.setdefault(token_store.FILE, Tokenizer.from_file(P.path(token_store.FILE)))
    one.encode_special_tokens = True
    return one


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 6), max_size=400), times=st.sampled_from([1, 8, 40]), a=st.integers(0, 16000), b=st.integers(0, 16000))
def test_grammar_decodes_any_range(ids, times, a, b):
    """Exact round trips, no paying pair left, and any range from the symbols and rules that it needs."""
    ids = np.array(ids * times, np.uint32)
    packed = token_store._pack_block(0, 0, [1], [ids.astype("<u4").tobytes()], 10).to_pylist()[0]
    row = type("Row", (), packed)
    assert token_store.all_ids(row).tolist() == ids.tolist()
    a, b = min(a, b), max(a, b)
    assert token_store.some_ids(row, a, b).tolist() == ids[a:b].tolist()
    rules, _, symbols = token_store._grammar_of(row)
    symbols, left = symbols.tolist(), {}
    at = 0
    while at < len(symbols) - 1:  # places of a pair that do not overlap
        pair = (symbols[at], symbols[at + 1])
        left.setdefault(pair, []).append(at)
        at += 1
    for (x, y), places in left.items():
        apart = len(places)
        if x == y:
            apart, last = 0, -2
            for p in places:
                if p > last + 1:
                    apart, last = apart + 1, p
        assert apart < token_store.LEAST, (x, y, apart)


def test_a_range_opens_few_rules():
    ids = np.random.default_rng(3).integers(0, 50, 200_000).astype(np.uint32)
    row = type("Row", (), token_store._pack_block(0, 0, [1], [ids.astype("<u4").tobytes()], 50).to_pylist()[0])
    opened = []
    real = token_store.unfold
    token_store.unfold = lambda symbols, *rest: opened.append(len(symbols)) or real(symbols, *rest)
    try:
        assert token_store.some_ids(row, 150_000, 150_010).tolist() == ids[150_000:150_010].tolist()
    finally:
        token_store.unfold = real
    assert sum(opened) <= 10


def test_grammar_shrinks_repeats():
    rules, _, symbols = token_store.grammar(np.tile(np.arange(50, dtype=np.uint32), 400), 100)
    assert len(symbols) < 20_000 / 8 and len(rules)


# 6, 7, 8


def test_quality_of_odd_rows(odd, none):
    got = quality_rules.quality(odd.withColumn("kept", F.lit("x"))).collect()
    assert [r["kept"] for r in got] == [False] * 6 + [True, True, False, False]
    assert quality_rules.quality(none).count() == 0
    repeated = "one two three four five six seven eight nine ten " * 4
    measured = quality_rules.measure([repeated.encode(), b"", LONG.encode()])
    assert measured["coverage_10"].tolist()[0] == 1.0 and not measured["kept"][0] and measured["kept"][2]


def brute_measures(text):
    """coverage, top and line_coverage, window by window."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    total, out = max(sum(map(len, words)), 1), {}
    for n in quality_rules.COVERAGE_LIMITS:
        at = {}
        for i in range(len(words) - n + 1):
            at.setdefault(tuple(words[i : i + n]), []).append(i)
        again = {w: places for w, places in at.items() if len(places) > 1}
        out[f"coverage_{n}"] = sum(len(words[i]) for i in {i + j for places in again.values() for i in places for j in range(n)}) / total
        if n in quality_rules.TOP_LIMITS:
            out[f"top_{n}"] = min(1.0, max((len(places) * sum(map(len, w)) for w, places in again.items()), default=0) / total)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += len(line) * (line in seen)
            seen.add(line)
    return out | {"line_coverage": lines / max(len(text), 1)}


def brute_kept(text, m):
    limits = {f"coverage_{n}": x for n, x in quality_rules.COVERAGE_LIMITS.items()} | {f"top_{n}": x for n, x in quality_rules.TOP_LIMITS.items()} | {"line_coverage": quality_rules.LINE_LIMIT}
    return not brute_quality(text)[-1] and all(m[k] <= x for k, x in limits.items())


def test_quality_measures_against_brute_force(spark, sf_dir):
    """Every measure and the verdict, on the table and on documents that pass the base rule and no more."""
    changing = [f"w{i}" for i in range(1000)]
    one = {n: " ".join(" ".join(["buy", "cheap", "pills", "now"][:n]) + " " + w for w in changing[:60]) for n in (2, 3, 4)}
    many = {n: " ".join(" ".join(f"phrase{i % 12}part{j}" for j in range(n)) + " " + w for i, w in enumerate(changing[:120])) for n in (2, 3, 4)}
    lines = "\n".join(x for i, w in enumerate(changing[:60]) for x in (f"menu {'x' * 40}{i % 15}", w))
    long_words = " ".join([*changing[:160], *["q" * 30 + str(i) for i in range(12)], *changing[160:300], *["q" * 30 + str(i) for i in range(12)]])
    only = [*one.values(), *many.values(), lines, long_words]
    plain = [" ".join(changing), "a few words that do not come twice in this small text here"]
    for text in only:
        assert not brute_quality(text)[-1] and not brute_kept(text, brute_measures(text))
    docs = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [*only, *plain, "", *docs]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in quality_rules.quality(rows).collect()}
    for i, text in enumerate(texts):
        want = brute_measures(text)
        assert {k: got[i][k] for k in want} == pytest.approx(want, abs=1e-12)
        assert got[i]["kept"] == brute_kept(text, want)
    assert [got[i]["kept"] for i in range(len(only) + 3)] == [False] * len(only) + [True, True, False]


def test_sharding_of_odd_rows(odd, none):
    got = sharding.shard(odd.withColumns({"shard": F.lit(1), "slot": F.lit(2)})).collect()
    assert len(got) == len(ODD)
    slots = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == crc32((r["text"] or "").encode())
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("shards", [8, 16, 24, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    got = sharding.shard(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards).select("shard", "grown_shard").collect()
    assert all(r["grown_shard"] in (r["shard"], shards) for r in got) and any(r["grown_shard"] == shards for r in got)
    with pytest.raises(ValueError, match="multiple"):
        sharding.shard(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards + 1)


def test_weights_move_rows_inside_their_subtree(spark):
    def tree(weight):
        racks = [sharding.Node(f"r{k}", 2 + (weight if k == 0 else 1), tuple(sharding.Node(f"s{3 * k + i}", weight if (k, i) == (0, 0) else 1.0, (), 3 * k + i) for i in range(3))) for k in range(2)]
        return sharding.Node("root", sum(r.weight for r in racks), tuple(racks))

    placed = spark.range(3000).select("id", sharding.place(F.col("id"), tree(1.0)).alias("a"), sharding.place(F.col("id"), tree(3.0)).alias("b")).collect()
    assert all((r["a"], r["b"]) == (brute_shard(r["id"], tree(1.0)), brute_shard(r["id"], tree(3.0))) for r in placed)
    moved = [(r["a"], r["b"]) for r in placed]
    assert all(a == b or b == 0 or (b < 3) for a, b in moved)
    assert 0.3 < sum(b == 0 for _, b in moved) / len(moved) < 0.45


def test_packing_keeps_three_limits(spark, none):
    rng = random.Random(5)
    rows = [(i, np.arange(n, dtype="<u4").tobytes(), rng.randint(0, n)) for i, n in enumerate(rng.choice([0, 1, 3, 20, 64, 100, 257]) for _ in range(400))]
    rows += [(None, b"\1\0\0\0", 1), (5, None, None), (7, b"\1\0\0\0" * 3, -4)]
    examples = spark.createDataFrame(rows, "doc_id long, ids binary, loss_tokens long").repartition(3)
    limits = packing.Limits(64, 5, 40)
    got = packing.pack(examples, limits).collect()
    sequences, total = {}, 0
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        total += r["length"]
    assert total == sum(len(b or b"") // 4 for _, b, _ in rows)
    for parts in sequences.values():
        assert sum(p["length"] for p in parts) <= 64 and len(parts) <= 5 and sum(p["loss_tokens"] for p in parts) <= 40
    assert packing.pack(packing.tokenise(none)).count() == 0


# 9


@pytest.mark.parametrize(("percent", "words"), [(80, 5), (85, 4), (50, 2)])
def test_jaccard_groups_lose_no_link(spark, percent, words):
    rng = random.Random(percent)
    vocabulary = [f"t{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 120]))] + (common if rng.random() < 0.3 else [])
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        for _ in range(rng.choice([0, 2, 6])):
            changed = list(base)
            for _ in range(rng.choice([1, 1, 2, 5])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed).upper() if rng.random() < 0.2 else " ".join(changed))
    texts += ["", None, " \n", "one", "one", "one two"]
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"node": F.lit(1), "n": F.lit(2)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(rows, like=jaccard_join.Likeness(words, percent)).collect()}
    sets = brute_sets(texts, words)
    groups = brute_groups(list(range(len(texts))), sets, percent)
    assert got == {i: (len(sets[i]), groups[i]) for i in range(len(texts))}


def test_a_large_group_of_near_copies(spark):
    """Every copy has a word of its own; most pairs are not linked, and few of them are looked at."""
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(600):
        own = list(base)
        own[(k * 7) % 60] = f"own{k}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    asked, real = [], jaccard_join.verify
    jaccard_join.verify = lambda pairs, *rest: asked.append(pairs.count()) or real(pairs, *rest)
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(rows, like=jaccard_join.Likeness(4, 85)).collect()}
    finally:
        jaccard_join.verify = real
    assert got == brute_groups(list(range(600)), brute_sets(texts, 4), 85)
    assert sum(asked) <= 60 * 59 / 2


def test_near_copies_meet_once(spark, monkeypatch):
    """Copies that differ in a few words of a common stock share many lists, and a pair comes out of one of them."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for _ in range(400):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(90)] = f"own{rng.randrange(12)}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    met, pairs, real = [], [], type(rows).dropDuplicates

    def counted(self, subset=None):
        out = real(self, subset)
        if subset == ["a", "b"]:
            met.append(self.count())
            pairs.append(out)
        return out

    monkeypatch.setattr(type(rows), "dropDuplicates", counted)
    monkeypatch.setattr(jaccard_join.Scratch, "drop", lambda *tables: None)  # pairs are read again below
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(rows).collect()}
    found = [tuple(r) for p in pairs for r in p.select("a", "b").collect()]
    assert sum(met) == len(found) == len(set(found)) > 50
    assert got == brute_groups(list(range(400)), brute_sets(texts, 5), 80)


def test_jaccard_of_odd_rows(odd, none):
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard_join.jaccard_groups(odd).collect())
    assert got == sorted([("1", 1), ("2", 2), ("3", 3), ("None", None), ("5", 5), ("5", 5), ("7", 7), ("8", 7), ("9", 9), ("10", 10)], key=lambda x: (x[0], x[1] or 0))
    assert jaccard_join.jaccard_groups(none).count() == 0


# 10


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=4).astype("f4").tolist()) for i in range(70)]
    vectors += [(70, None), (71, [0.0] * 4), (72, [1.0, None, 0.0, 0.0]), (73, [float("nan"), 1.0, 0.0, 0.0]), (74, [float("inf"), 1.0, 0.0, 0.0]), (75, [1.0]), (None, [1.0] * 4), (76, []), (5, vectors[5][1])]
    vectors += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)]
    rows = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, leaf string")
    index = kmeans_tree.build(rows, kmeans_tree.Settings(leaf_rows=8, branch=4, block_rows=7, block_queries=3))
    got = {}
    for r in kmeans_tree.search(index, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)}
    assert sorted(got) == sorted(i for i in good if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        true = sorted((-(good[i] * good[q]).sum(), i) for i in good if i != q)[:20]
        assert len(found) == 20 and all(s == pytest.approx((good[i] * good[q]).sum(), abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for _, i in true})
    assert hits >= 0.9 * 20 * len(got) and index.recall >= 0.9
    few = kmeans_tree.search(kmeans_tree.build(rows.filter("vec_id < 3")), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert kmeans_tree.search(kmeans_tree.build(rows.limit(0)), F.col("vec_id") == 0).count() == 0
    assert kmeans_tree.search(kmeans_tree.build(rows.filter("vec_id = 3")), F.col("vec_id") == 3).count() == 0


# pipeline


def test_stages_take_odd_rows(spark, odd, none):
    assert corpus_pipeline.pack_sequences(spark, none, "").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd.withColumns({"path": F.lit("p"), "kept": F.lit(True), "_row": F.lit(1)}), "")
        assert got.columns == list(corpus_pipeline.COLUMNS) and got.count() <= len(ODD)
        assert stage(spark, none, "").count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, odd, "").count() == len(ODD) - 2
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, odd, "").collect()}
    assert masked[10]["text"] == "[SECRET] [SECRET] [SECRET]" and masked[10]["n_chars"] == 26 and masked[1]["text"] is None
    assert corpus_pipeline.pack_sequences(spark, odd, "").select("doc_id").distinct().count() == 9


def test_pipeline_against_brute_force(spark, sf_dir):
    """Stage by stage on the whole table: what quality keeps, one row of each group, secrets masked."""
    from tests.llm.test_queries import brute_secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    groups = brute_groups(sorted(texts), brute_sets([texts[i] for i in sorted(texts)], 5), 80)
    single = {i for i, g in groups.items() if i == g}
    unique = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    assert {r["doc_id"] for r in unique.collect()} == single
    for r in corpus_pipeline.mask_secrets(spark, unique, sf_dir).collect():
        want, at = "", 0
        for _, a, b in brute_secrets(texts[r["doc_id"]]):
            want += texts[r["doc_id"]][at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert r["text"] == want + texts[r["doc_id"]][at:]
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert packed == single
