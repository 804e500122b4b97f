"""Chunking, paged text and HTML."""

import hashlib
import random
import re
import time

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatix.operators import chunking
from verbatix.sources import files, html, pages

from .html_by_tree import html_to_text

WORD = st.text(alphabet="abcdeé", min_size=1, max_size=9)
LINE = st.lists(WORD, max_size=200).map(" ".join).map(lambda x: re.sub("e ", "e. ", x)) | st.sampled_from(["", "  ", "Une Section", "12 _ Santé", "PARTIE DEUX", " x. "])


@settings(max_examples=60, deadline=None)
@given(lines=st.lists(LINE, max_size=20))
def test_fold_keeps_every_character(lines):
    text = "\n".join(lines)
    sections, chunks = chunking.fold(text, "titre")
    assert [n for n, _ in sections] == list(range(len(sections)))
    at = 0
    for home, a, b in chunks:
        assert at <= a < b <= len(text) and text[a:b].strip() and 0 <= home < len(sections)
        assert not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_long_blocks():
    sentences = " ".join(f"Phrase {i} de longueur moyenne." for i in range(60))
    pieces = chunking.sentence_pieces(sentences, 0, len(sentences))
    assert len(pieces) > 1 and all(b - a >= 600 for a, b in pieces[:-1]) and pieces[-1][1] == len(sentences)
    whole = "a" * 1500
    assert chunking.sentence_pieces(whole, 0, 1500) == [(0, 1500)]


def test_headings_close_from_120():
    for n, chunks in ((119, 1), (120, 2)):
        body = "b" * (n - 1) + "."
        assert len(chunking.fold(f"{body}\nUne Section\ntexte final.", "t")[1]) == chunks
    sections, chunks = chunking.fold("Titre du document\nTexte.", "Le titre du document")
    assert len(sections) == 1 and len(chunks) == 1


def test_chunks_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", None, None, "g", 1), ("b", "t", "", None, 2), ("c", "t", "Bonjour le monde.", "g", 3), ("c", "t", "Bonjour le monde.", "g", 3)], "document_id string, title string, text string, group_id string, ord int")
    assert [(r["passage_id"], r["text"], r["group_id"]) for r in chunking.chunks(rows).collect()] == [("c#c0", "Bonjour le monde.", "g")] * 2
    assert chunking.sections(rows).count() == 4
    assert chunking.chunks(rows.limit(0)).count() == 0
    assert chunking.blocks(rows).filter("document_id = 'a'").count() == 0


def test_normalize_line(spark):
    cases = {
        "ﬁn  de ﬂot": "fin de flot",
        "des f rontières": "des frontières",
        "Sommaire ....... 12": "Sommaire 12",
        "voir p. 12 et PAGE 7 fin": "voir et fin",
        "12LE TITRE": "LE TITRE",
        "fin , et . ": "fin, et.",
        "l’été “beau” — oui": "l'été \"beau\" – oui",
        "a\x07b � c": "a b c",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in rows.select("t", pages.normalize_line_col(F.col("t"))).collect()} == cases


def joined_by_hand(line):
    """Fragments of capitals join a neighbour."""
    tokens, letters = line.split(), re.sub("[^A-Za-zÀ-ÿ]", "", line)
    if len(tokens) < 3 or len(letters) < 4 or len(re.sub("[^A-ZÀ-Ý]", "", letters)) < 0.8 * len(letters):
        return line
    out, rest = [], tokens
    while rest:
        head, rest = rest[0], rest[1:]
        if not re.fullmatch("[A-ZÀ-Ý]{1,2}", head) or head in pages.SHORT_CAPITALS:
            out = [*out, head]
        elif rest and rest[0] not in pages.SHORT_CAPITALS:
            out, rest = [*out, head + rest[0]], rest[1:]
        else:
            out = [*out[:-1], "".join([*out[-1:], head])]
    return " ".join(out)


def undoubled_by_hand(line):
    letters = re.sub("[^A-Za-zÀ-ÿ]", "", line)
    if len(letters) < 6 or len(re.sub("[^A-ZÀ-Ý]", "", letters)) < 0.6 * len(letters):
        return line
    halved = [re.sub(r"^(.{3,})\1$", r"\1", t) for t in line.split()]
    return " ".join(t for i, t in enumerate(halved) if i == 0 or t.lower() != halved[i - 1].lower())


def test_capitals(spark):
    rng = random.Random(1)
    words = "L AVENIR EN C OMMUN LE PROGRAMM E ÉÉ IL A DE x petit PROJETPROJET POUR POUR ABAB ÀBCÀBC ABCABC abcABC 12 !! LE!!LE!! É, X.".split()
    lines = ["L AVENIR EN C OMMUN", "LE PROGRAMM E", "un petit texte", "PROJETPROJET POUR POUR TOUS", "nous nous engageons", "", "A", "A B C D", "AB CD EF GH", "E LE X", "LE!! LE!! ENÊÈ!!"]
    lines += [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(x,) for x in lines], "t string")
    got = rows.select("t", pages.join_spaced_capitals_col(F.col("t")), pages.collapse_doubled_capitals_col(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(x, joined_by_hand(x), undoubled_by_hand(x)) for x in lines]
    assert joined_by_hand(lines[0]) == "LAVENIR EN COMMUN" and joined_by_hand(lines[1]) == "LE PROGRAMME" and undoubled_by_hand(lines[3]) == "PROJET POUR TOUS"


def flowed(spark, documents):
    rows = spark.createDataFrame([(str(k), 0, n, x) for k, lines in enumerate(documents) for n, x in enumerate(lines)], "document_id string, page int, n int, line string")
    out = {k: [] for k in range(len(documents))}
    for r in pages.reflow(rows).orderBy("document_id", "page", "paragraph").collect():
        if r["text"]:
            out[int(r["document_id"])].append(r["text"])
    return [out[k] for k in range(len(documents))]


def flowed_by_hand(lines):
    out, held = [], ""
    for line in [*lines, ""]:
        if line and held and not (re.search("[.!?:»]$", held) and re.match(r"[•▪●–—-]\s|[A-ZÀ-Ý0-9]", line)):
            held = held[:-1] + line if re.search("[a-zà-ÿ]-$", held) and re.match("[a-zà-ÿ]", line) else f"{held} {line}"
        else:
            out, held = [*out, held.strip()], line
    return [x for x in out if x]


def test_reflow(spark):
    rng = random.Random(2)
    cases = [["une phra-", "se finie.", "Une autre", "suite", "", "bloc"], ["mot-", "Clé"], ["fin.", "• point", "suite"], ["fin:", "-", "a"], ["a-", "-", "b", "é-", "b-", "c"], ["", "", "x"]]
    parts = ["", "mot-", "-", "Fin.", "fin:", "é", "- un", "• deux", "Trois", "4", "suite»", "À-"]
    cases += [rng.choices(parts, k=rng.randint(1, 12)) for _ in range(300)]
    assert flowed(spark, cases) == [flowed_by_hand(c) for c in cases]
    assert flowed_by_hand(cases[0]) == ["une phrase finie.", "Une autre suite", "bloc"] and flowed_by_hand(cases[2]) == ["fin.", "• point suite"]


def test_running_headers(spark):
    def doc(n, k):
        return "\f".join((f"Le grand titre courant\nTexte page {i} propre à {i}" if i < k else f"Texte page {i} seule") for i in range(n))

    rows = spark.createDataFrame([("two", doc(4, 2)), ("three", doc(4, 3)), ("short", doc(3, 3)), ("none", None)], "document_id string, text string")
    paged = pages.paged_lines(rows)
    assert {r["document_id"]: r["furniture"] for r in pages.boilerplate(paged).collect()} == {"three": ["Le grand titre courant"]}
    text = {r["document_id"]: r["text"] for r in pages.extract(rows).collect()}
    assert "titre courant" not in text["three"] and "titre courant" in text["two"] and "none" not in text


def read_html(spark, *cases):
    """(title, text) of each case by the operator, which the plain form has to give as well."""
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id int, html string")
    found = {r["page_id"]: (r["title"], r["text"]) for r in html.extract(rows).collect()}
    assert found == {k: html_to_text(c or "") for k, c in enumerate(cases)}
    return [found[k] for k in range(len(cases))]


def test_html(spark):
    page = "<html><head><title>A &amp; B</title></head><body><nav><p>menu</p></nav><article>{}</article><p>dehors</p><footer><p>pied</p></footer></body></html>"
    long = page.format("<h2>Titre</h2><p>" + "a" * 401 + "</p><ul><li>un<ul><li>deux</li></ul></li></ul><p>pic.twitter.com/x</p>")
    short = page.format("<p>" + "a" * 399 + "</p>")
    found = read_html(spark, long, short, "<p>a &amp;lt; b&#33;&#x41;</p>", "", None)
    assert found[0] == ("A & B", "Titre\n\n" + "a" * 401 + "\ndeux")
    assert found[1][1].endswith("dehors")
    assert found[2:] == [("", "a < b!A"), ("", ""), ("", "")]


def test_html_of_end_tags_that_close_nothing(spark):
    deep = "<article>" + "<div>" * 4000 + "</b>" * 20_000 + "<p>" + "a" * 401 + "</p></article>"
    began = time.time()
    found = read_html(spark, deep, "<body><div><p>a</span></div><p>b</body>")
    assert found[0][1] == "a" * 401 and found[1][1] == "a\nb" and time.time() - began < 30


def test_html_of_random_pages(spark):
    """Pages of random tags, mostly not well formed, against the plain form."""
    rng = random.Random(11)
    tags = "div p li ul h1 h2 td table section main article br img span b".split() * 12 + ["nav", "footer", "title", "body"]
    attributes = [*[""] * 60, ' class="content"', ' class="x entry-content"', ' id="content"', ' role="main"', ' role="banner"', ' class="Menu menu"', " hidden", ' class=""']
    words = ["un", "deux", " ", "\n\n", "\u00a0", "&amp;", "&#233;", "&#x1F600;", "t.co/x", "a" * 150, "é𝄞", "&bogus;", "<", "<!-- x -->"]

    def page():
        parts = []
        for _ in range(rng.randint(0, 120)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}{rng.choice(attributes)}>", f"<{tag}/>", f"</{tag}>", *[rng.choice(words)] * 3]))
        return rng.choice(["", "<title>t &amp; <b>u</b></title>"]) + "".join(parts)

    found = read_html(spark, *(page() for _ in range(600)))
    assert sum(text != "" for _, text in found) > 200 and sum(title != "" for title, _ in found) > 50


def test_html_plan_and_columns(spark):
    """One shuffle; repeated and null rows and columns of clashing names are kept; no rows, no rows."""
    kind = "`_row` int, at string, tag string, `a.b` string, title string, html string"
    rows = spark.createDataFrame([(1, "x", None, "y", "old", "<title>T</title><p>a</p>")] * 2 + [(None, None, None, None, None, None)], kind)
    found = html.extract(rows)
    assert found.columns == ["_row", "at", "tag", "a.b", "title", "text"]
    assert len(re.findall(r"[-+] Exchange", found._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "x", None, "y", "T", "a")] * 2 + [(None, None, None, None, "", "")]
    assert html.extract(rows.limit(0)).collect() == []


def test_pages_of_files(spark, tmp_path):
    """Files of odd names, with and without a last form feed, empty pages and files, and one that many tasks read."""
    rng = random.Random(6)
    long = "\f".join(f"page {i} " + "é𝄞 x\n" * rng.randint(0, 40) for i in range(4_000))
    texts = {"a b%20ü": "one\ftwo\f", "plain": "one\ntwo", "empty": "", "feed": "\f", "feeds": "\f\fx\f\f", "long": long, "long feed": long + "\f", "mark": "\ufeffone\ftwo\f"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = pages.read_pages(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in rows:
        got.setdefault(r["document_id"], {})[r["page"]] = r["text"]
        assert r["n_pages"] == texts[r["document_id"]].count("\f") + 1
    assert len(rows) == sum(map(len, got.values()))
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: t.removeprefix("\ufeff").split("\f") for k, t in texts.items() if t}
    documents = spark.createDataFrame([("one", "Titre\nune phra-\nse.\fdeux\f")], "document_id string, text string")
    assert pages.extract(pages.pages_of(documents)).collect() == pages.extract(documents).collect()


def brute_ngrams(document, least):
    """Every sequence of every line, page by page."""
    pages_of = {}
    for number, page in enumerate(document):
        for line in page:
            words = line.split()
            for n in range(3, 15):
                for i in range(len(words) - n + 1):
                    pages_of.setdefault(" ".join(words[i : i + n]), set()).add(number)
    return {w: len(p) for w, p in pages_of.items() if len(p) >= least}


def test_sequences_against_brute_force(spark):
    """Common and maximal sequences of many documents at once, with words that hold one another."""
    rng = random.Random(3)
    documents = [[[" ".join(rng.choices("a b c d ab ba abc".split(), k=rng.randint(0, 20))) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(1, 6))] for _ in range(60)]
    line = " ".join(f"w{i}" for i in range(40))
    documents += [[[line], [line, "x"], ["y " + line], [line[:60]]], [["a b c"], ["xa b cd"], ["xa b cd", "a b c"], ["a b c xa b cd"]]]
    rows = spark.createDataFrame([(str(k), len(d), p, n, x) for k, d in enumerate(documents) for p, page in enumerate(d) for n, x in enumerate(page)], "document_id string, n_pages int, page int, n int, line string")
    for least in (1, 2, 3):
        got, top = {}, {}
        common = pages.common_sequences(rows, F.lit(least))
        for r in common.collect():
            got.setdefault(int(r["document_id"]), {})[r["ngram"]] = r["n_pages"]
        want = {k: x for k, d in enumerate(documents) if (x := brute_ngrams(d, least))}
        assert got == want
        for r in pages.maximal(common).collect():
            top.setdefault(int(r["document_id"]), set()).add(r["ngram"])
        assert top == {k: {x for x in found if not any(x in y for y in found if y != x)} for k, found in want.items()}


def test_long_running_lines_take_no_square(spark):
    """One line of 8,000 words on five pages: all its sequences of 14 words are maximal."""
    line = " ".join(f"w{i}" for i in range(8_000))
    rows = spark.createDataFrame([("d", "\f".join([line] * 5))], "document_id string, text string")
    began = time.time()
    found = pages.boilerplate(pages.paged_lines(rows)).collect()
    assert len(found[0]["furniture"]) == 8_000 - 13 and time.time() - began < 30


def test_html_of_odd_pages(spark):
    cases = {
        "<p>a &#xD800; b &#55296;</p>": "a \ufffd b \ufffd",
        "<p>a &#" + "9" * 5000 + ";</p>": "a \ufffd",
        "<p>a &#" + "0" * 5000 + "65;</p>": "a A",
        "<p>a</p><![ 1 ]><p>b</p>": "a\nb",
        "<p>a</p><![CDATA[ x ]]><p>b</p>": "a\nb",
        "<p>a</p><!": "a",
        "<": "",
    }
    deep = "<div>" * 3000 + "<p>x</p>" + "</div>" * 3000 + "<nav>y</nav>" * 3000
    found = read_html(spark, *cases, deep)
    assert [text for _, text in found] == [*cases.values(), "x"]


def test_long_documents(spark):
    """A hundred thousand lines are placed within seconds."""
    lines = [f"ligne é {i}" if i % 7 else "  " for i in range(100_000)]
    rows = spark.createDataFrame([("d", "\n".join(lines), "t")], "document_id string, text string, title string")
    began = time.monotonic()
    got = chunking.blocks(rows, "title").orderBy("ord").select("text", "start", "end").collect()
    assert time.monotonic() - began < 30
    at, want = 0, []
    for line in lines:
        if line.strip():
            want.append((line.strip(), at, at + len(line)))
        at += len(line) + 1
    assert list(map(tuple, got)) == want


def test_manifest_and_corpus_round_trip(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("un", "utf-8")
    sources = spark.createDataFrame([("a", "a.txt", "https://x/a"), ("b", "b.txt", "https://x/b")], "id string, file_name string, source_url string")
    raw = files.read_raw(spark, str(tmp_path / "raw"))
    files.write_manifest(files.checksum_manifest(raw, sources), str(tmp_path / "manifest"))
    manifest = files.read_manifest(spark, str(tmp_path / "manifest"))
    assert [tuple(r) for r in manifest.collect()] == [("a", hashlib.sha256(b"un").hexdigest(), 2, "https://x/a")]
    assert [r["id"] for r in files.missing_files(raw, sources).collect()] == ["b"]
    docs = spark.createDataFrame([("a", "g", "texte\n\n"), ("b", "g", None)], "document_id string, group_id string, text string")
    known = {r["document_id"]: r["checksum"] for r in files.with_checksums(docs, manifest).collect()}
    assert known == {"a": hashlib.sha256(b"un").hexdigest(), "b": ""}
    files.write_texts(docs, str(tmp_path / "texts"))
    assert {r["document_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()} == {"a": "texte\n", "b": "\n"}
    tables = {"documents": docs, "chunks": docs}
    files.write_corpus(tables, str(tmp_path / "corpus"))
    again = files.read_corpus(spark, str(tmp_path / "corpus"), list(tables))
    assert all(sorted(map(str, again[t].select(*docs.columns).collect())) == sorted(map(str, docs.collect())) for t in tables)
    report = {r["table"]: r for r in files.size_report(tables).collect()}
    assert report["chunks"]["n_rows"] == 2 and report["chunks"]["longest_row"] > 30


def test_raw_files(spark, tmp_path):
    (tmp_path / "a?b.txt").write_text("un\ndeux", "utf-8")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7 x")
    texts = {r["document_id"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert texts["a?b"] == "un\ndeux"
    raw = files.read_raw(spark, str(tmp_path)).withColumn("ok", files.has_format(F.col("content"), F.lit("pdf"))).collect()
    assert {r["file_name"]: r["ok"] for r in raw} == {"a?b.txt": False, "c.txt": True}
    slugs = spark.createDataFrame(pd.DataFrame({"slug": ["plan-climat"]}))
    row = files.catalog([files.catalog_from_slugs(slugs, "lfi", "https://x.example/")]).first()
    assert (row["id"], row["title"], row["source_url"]) == ("lfi-plan-climat", "Plan climat", "https://x.example/plan-climat")


def test_words_in_a_row_go_through_one_shuffle(spark):
    """Three words in a row are shuffled once, as numbers; pages that are too few for a sequence are not looked at."""
    rows = [("d", 4, page, n, line) for page in range(4) for n, line in enumerate(["a b c d", f"x{page} b c d e", "a b c d", ""])] + [("e", 1, 0, 0, "a b c d"), ("e", 1, 0, 1, "a b c d")]
    lines = spark.createDataFrame(rows, "document_id string, n_pages int, page int, n int, line string")
    found = pages.common_sequences(lines, F.lit(2))
    shuffles = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "_hash" in x]
    assert len(shuffles) == 1 and "three" not in shuffles[0]
    want = {("d", g, len(g.split()), 4) for g in ("a b c", "b c d", "a b c d")} | {("d", "c d e", 3, 4), ("d", "b c d e", 4, 4)}
    assert {tuple(r) for r in found.collect()} == want
    assert pages.common_sequences(lines, F.lit(5)).count() == 0


def test_headers_are_found_by_short_hashes(spark):
    """What paged_text takes out: lines and words in a row are named by hashes of no more bits than they need."""
    rows = [("d", 5, page, n, line) for page in range(5) for n, line in enumerate(["LE GRAND PLAN", f"texte de la page {page}", ""])]
    lines = spark.createDataFrame(rows, "document_id string, n_pages int, page int, n int, line string")
    found = pages.boilerplate(lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert str((1 << 40) - 1) in plan and str((1 << 48) - 1) in plan and "three" not in plan
    assert [tuple(r) for r in found.collect()] == [("d", ["texte de la page", "LE GRAND PLAN"])]
