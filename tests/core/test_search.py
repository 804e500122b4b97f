"""Index, ranking and plans on small corpora; BM25 against an independent full-text engine."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from verbatix import corpus, domain, queries
from verbatix.functions import text
from verbatix.operators import citations, index, ranking, statistics, tagging
from verbatix.plans import catalog, prompts, search

PASSAGES = "passage_id string, document_id string, group_id string, ord int, text string, heading string, is_navigation boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, PASSAGES)


def test_bm25_matches_sqlite(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir).filter("group_id = 'fr'")
    passages = corpus.paragraphs(docs)
    one = index.build(passages)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, t, h, tokenize='unicode61 remove_diacritics 2')")
    from verbatix.functions.text import match_expression, stems

    for r in passages.collect():
        db.execute("INSERT INTO f VALUES (?, ?, ?)", (r["passage_id"], " ".join(stems(r["text"])), " ".join(stems(r["heading"]))))
    query = "ement etion ouier"
    want = {i: -s for i, s in db.execute("SELECT id, bm25(f, 0.0, 1.0, 2.0) FROM f WHERE f MATCH ?", (match_expression(query),))}
    queries = spark.createDataFrame([(0, query)], "query_id int, query string")
    got = {r["passage_id"]: r["score"] for r in index.match(one, queries).collect()}
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("a0", "a", "g1", 0, "le nucléaire et le climat", "Énergie", False),
        ("a1", "a", "g1", 1, "le climat seul", "Nucléaire", False),
        ("a2", "a", "g1", 2, "3 _ Nucléaire 4 _ Climat nucléaire climat", "", True),
        ("b0", "b", "g2", 0, "immigration", "", False),
        ("b1", "b", "g2", 1, None, None, None),
        ("b2", "b", "g2", 2, "rien du tout ici, des mots autres encore longs", "", False),
        *((f"c{i}", "c", "g3", i, f"texte sans rapport {i} avec des mots", "", False) for i in range(8)),
    ]
    passages = table(spark, rows)
    return passages, index.build(passages)


def test_coverage_reads_the_body_only(spark, small):
    hits = {r["passage_id"]: r for r in search.search(small[1], "nucléaire climat", groups=domain.GROUPS).collect()}
    assert set(hits) == {"a0", "a2"}  # a1 has one of the two in its heading only
    assert hits["a0"]["score"] > hits["a2"]["score"]


def test_navigation_penalty(spark, small):
    queries = spark.createDataFrame([(0, "nucléaire climat")], "query_id int, query string")
    raw = {r["passage_id"]: r["score"] for r in index.match(small[1], queries).collect()}
    ranked = {r["passage_id"]: r["score"] for r in search.candidates(small[1], queries, 10).collect()}
    assert ranked["a2"] == pytest.approx(0.3 * raw["a2"]) and ranked["a0"] == raw["a0"]


def test_nothing_found(spark, small):
    assert search.search(small[1], "cryptomonnaies blockchain").count() == 0
    assert search.search(small[1], "les des").count() == 0
    empty = index.build(small[0].limit(0))
    assert search.search(empty, "climat nucléaire").count() == 0
    with pytest.raises(ValueError, match="unknown group"):
        search.search(small[1], "climat", group="nobody")
    with pytest.raises(ValueError, match="unknown topic"):
        search.search(small[1], "climat", topic="nothing")


def test_cap_floor_and_limit(spark):
    rows = [(0, f"{g}{i}", g, 10.0 - i - d, 1, 1) for g, n, d in (("x", 9, 0.0), ("y", 3, 0.5), ("z", 1, 8.0)) for i in range(n)]
    hits = spark.createDataFrame(rows, "query_id int, passage_id string, group_id string, score double, coverage int, n_terms int")
    for limit, cap in ((10, 4), (3, 2)):
        kept = ranking.cap_groups(hits, limit).groupBy("group_id").count().collect()
        assert {r["group_id"]: r["count"] for r in kept}["x"] == cap
    assert {r["passage_id"] for r in ranking.above_floor(hits).collect()} == {r[1] for r in rows if r[3] >= 2.5}
    assert [r["passage_id"] for r in ranking.top(hits, 3).orderBy("rank").collect()] == ["x0", "y0", "x1"]


def test_one_word_counts_as_several_keywords(spark, small):
    keywords = tagging.keyword_terms(spark, domain.TOPICS)
    found = tagging.keyword_matches(small[1].postings, keywords)
    assert {r["topic"]: len(r["matched_keywords"]) for r in found.filter("passage_id = 'b0'").collect()} == {"immigration": 3}
    distinct = tagging.keyword_matches(small[1].postings, tagging.keyword_terms(spark, domain.TOPICS, distinct_stems=True))
    assert {r["topic"]: len(r["matched_keywords"]) for r in distinct.filter("passage_id = 'b0'").collect()} == {"immigration": 1}
    tags = tagging.tags(small[1].postings, keywords)
    arrays = {r["passage_id"]: r["topic_tags"] for r in tagging.tag_arrays(small[0], tags).collect()}
    assert arrays["b0"] == ["immigration"] and arrays["b1"] == []


def test_compare_keeps_order_and_duplicates(spark, small):
    groups = tuple(domain.Group(g, g, g) for g in ("g1", "g2", "g3"))
    tags = tagging.tags(small[1].postings, tagging.keyword_terms(spark, domain.TOPICS))
    got = search.compare(small[1], tags, "Immigration et asile", ["g2", "g1", "g2"], groups=groups).orderBy("position").collect()
    assert [(r["group_id"], r["evidence_level"]) for r in got] == [("g2", "direct_quote"), ("g1", "not_found"), ("g2", "direct_quote")]
    assert got[0]["matched_keywords"] == ["immigration", "immigré", "immigrés"] and got[1]["passages"] == [] and got[1]["n_passages"] == 3


def test_compare_shows_passages_and_warns(spark):
    rows = [(f"a{i}", "a", "g1", i, "immigration et asile", "Titre", False) for i in range(7)] + [("b0", "b", "g2", 0, "immigration", None, False)]
    passages = table(spark, rows)
    one = index.build(passages)
    groups = tuple(domain.Group(g, g, g.upper()) for g in ("g1", "g2", "g3"))
    tags = tagging.tags(one.postings, tagging.keyword_terms(spark, domain.TOPICS))
    got = search.compare(one, tags, "immigration", groups=groups).orderBy("position").collect()
    assert [(p["rank"], p["text"], p["heading"]) for p in got[0]["passages"]] == [(1, "immigration et asile", "Titre"), (2, "immigration et asile", "Titre")]
    assert got[1]["passages"][0]["text"] == "immigration" and got[2]["passages"] == []
    assert all("G1 y est documenté 7 fois plus que G2." in r["coverage_warning"] for r in got)
    even = search.compare(one, tags, "immigration", ["g2", "g3"], groups=groups).collect()
    assert len(even) == 2 and all(r["coverage_warning"] is None for r in even)


def test_full_hits(spark):
    passages = spark.createDataFrame([("d#c0", "d", "d#s1", "g", 0, "le climat", "Énergie", False, 0, 9), ("d#c1", "d", None, "g", 1, "climat seul", None, False, 10, 21)], "passage_id string, document_id string, section_id string, group_id string, ord int, text string, heading string, is_navigation boolean, char_start int, char_end int")
    documents = spark.createDataFrame([("d", "g", "Titre", "https://x", "tout")], "document_id string, group_id string, title string, source_url string, text string")
    sections = spark.createDataFrame([("d#s1", "d", "Énergie", 1)], "section_id string, document_id string, heading string, ord int")
    tags = spark.createDataFrame([("d#c0", "b"), ("d#c0", "a")], "passage_id string, topic string")
    one = index.build(passages)
    got = {r["passage_id"]: r for r in search.full_hits(one, search.search(one, "climat"), documents, sections, tags).collect()}
    assert set(got) == {"d#c0", "d#c1"}
    first = got["d#c0"]
    assert (first["section_ord"], first["heading"], first["title"], first["source_url"], first["topic_tags"], first["char_end"]) == (1, "Énergie", "Titre", "https://x", "a,b", 9)
    assert got["d#c1"]["section_ord"] == 0 and got["d#c1"]["topic_tags"] is None


def test_terms_reach_the_scan(spark, small, tmp_path):
    """A search of a saved index reads the postings of its terms, and lengths and passages not at all."""
    path = str(tmp_path / "index")
    small[1].save(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.search(index.Index.load(spark, path), "nucléaire climat ric")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("/postings]" in line or "/stats]" in line for line in scans)
    assert all("StringStartsWith(term,nucleair)" in line and "EqualTo(term,ric)" in line for line in scans if "/postings]" in line)


def test_context_is_clipped(spark, small):
    got = search.passage_with_context(small[0], small[0].filter("passage_id = 'a0'"), 3).orderBy("ord").collect()
    assert [(r["passage_id"], r["position"]) for r in got] == [("a0", "self"), ("a1", "after"), ("a2", "after")]
    assert search.passage_with_context(small[0], small[0].filter("passage_id = 'zz'"), 1).count() == 0


def test_imbalance(spark):
    groups = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "group_id string, ordinal int")
    stats = lambda *n: spark.createDataFrame(list(zip("xyz", n)), "group_id string, n_passages long")
    assert [tuple(r) for r in statistics.coverage_imbalance(stats(9, 3, 1), groups).collect()] == [(9.0, "x", "z")]
    assert [tuple(r) for r in statistics.coverage_imbalance(stats(3, 1, 1), groups).collect()] == [(3.0, "x", "y")]
    assert statistics.coverage_imbalance(stats(2, 1, 0), groups).count() == 0
    assert statistics.coverage_imbalance(stats(5, 0, 0), groups).count() == 0


def test_index_round_trip(spark, small, tmp_path):
    small[1].save(str(tmp_path / "index"))
    again = index.Index.load(spark, str(tmp_path / "index"))
    ids = lambda one: [tuple(r) for r in search.search(one, "nucléaire climat").orderBy("rank").collect()]
    assert ids(again) == ids(small[1])


def test_invariants(spark):
    docs = spark.createDataFrame([("d", "abc def"), ("e", "x" * 100)], "document_id string, text string")
    rows = spark.createDataFrame([("d0", "d", "s", "abc", 0, 3), ("d1", "d", "t", "zzz", 4, 7), ("q0", "q", "s", "a", 0, 1)], "passage_id string, document_id string, section_id string, text string, char_start int, char_end int")
    sections = spark.createDataFrame([("s", "d", "h", 0)], "section_id string, document_id string, heading string, ord int")
    assert {r["passage_id"] for r in statistics.slice_violations(rows, docs).collect()} == {"d1", "q0"}
    assert {(r["passage_id"], r["missing"]) for r in statistics.orphans(rows, docs, sections).collect()} == {("d1", "section"), ("q0", "document")}
    assert {r["document_id"]: r["is_low"] for r in statistics.text_coverage(rows, docs).collect()} == {"d": True, "e": True}


def test_catalog_and_citations(spark, small):
    groups = citations.group_table(spark)
    labels = spark.createDataFrame([("Mélenchon",), (" RN ",), ("x",)], "label string")
    assert {r["label"]: r["group_id"] for r in catalog.resolve_labels(labels, groups).collect()} == {"Mélenchon": "lfi", " RN ": "rn", "x": None}
    hit = spark.createDataFrame([("p", "lfi", "Texte.", "Un  titre", ["sante"], "Programme", "https://x", "official_program", 1.23456)], "passage_id string, group_id string, text string, heading string, topic_tags array<string>, title string, source_url string, source_type string, score double")
    row = citations.payload(hit, groups).first()
    assert row["citation"] == "LFI (Jean-Luc Mélenchon) — Programme — « Un titre » — présidentielle 2022 — https://x" and row["score"] == 1.235
    assert '"quote":"Texte."' in citations.to_json(citations.payload(hit, groups)).first()["json"]
    assert prompts.compare_topic("santé").startswith("Compare") and "prêtée à : LFI." in prompts.find_direct_quote("x", "LFI") and "prêtée" not in prompts.find_direct_quote("x")
    assert all("\n4. " in p and p.count("\n- ") == 5 for p in (prompts.compare_topic("x"), prompts.summarize_group_position("LFI", "x"), prompts.find_direct_quote("x")))
    sources = catalog.group_sources("g1", small[0].select("document_id", "group_id").distinct())
    assert [r["document_id"] for r in sources.collect()] == ["a"]
    tags = tagging.tags(small[1].postings, tagging.keyword_terms(spark, domain.TOPICS))
    assert {r["topic"]: r["n_passages"] for r in catalog.topic_catalog(tags).collect()}["immigration"] == 1
    assert catalog.group_profile("nobody", groups, small[0].select("document_id", "group_id").distinct(), small[0], tags).count() == 0


def test_index_of_known_queries(spark):
    """Postings of the asked terms, lengths and statistics are those of the whole index, where words are numbers, stopwords or
    accented, stems are short or end in -al of -aux, and passages are empty or repeated."""
    rng = random.Random(7)
    stock = "canal canaux beaux beal national nationaux Nationalité nationalités climat climats climatique être été énergie energies le les notre 2022 20222 123456 12ab a1 cœur l'eau mesure_climat zone Zones bellle the theme thème baux bal".split()
    rows = [(f"p{i}", f"d{i // 5}", "g", i % 5, rng.choice([" ", "_", ", ", "\n"]).join(rng.choices(stock, k=rng.randint(0, 12))) or None, rng.choice([None, "", "Les canaux", "climat 2022"]), False) for i in range(400)]
    passages = table(spark, rows + rows[:3])
    whole = index.build(passages)
    for searches, keywords in ((["canal national climat", "bal the 2022", "beal zone", "eau"], ["énergie climats", "canaux"]), ([], ["beaux"]), (["les", ""], [])):
        part = index.of_texts(passages, searches, keywords)
        asked = {s for q in searches for s in text.query_stems(q)}
        exact = {s for k in keywords for s in text.stems(k)}
        wanted = lambda t: t in exact or any(t.startswith(s) if len(s) >= 5 else t == s for s in asked)  # noqa: B023, E731
        every = {tuple(r) for r in whole.located().select("passage_id", "term", "in_text", "in_heading", *index.LOCATED).collect()}
        assert {tuple(r) for r in part.located().select("passage_id", "term", "in_text", "in_heading", *index.LOCATED).collect()} == {r for r in every if wanted(r[1])}
        assert sorted(map(tuple, part.lengths.collect())) == sorted(map(tuple, whole.lengths.collect()))
        assert part.stats.first() == whole.stats.first()
        assert {r["term"]: r["df"] for r in part.terms.collect()} == {r["term"]: r["df"] for r in whole.terms.collect() if wanted(r["term"])}
    assert any(wanted(r[1]) for r in every) is False and len(every) > 1_000


@pytest.mark.parametrize("name", ["chunk_search", "compare_groups", "full_hits", "bm25_batch", "score_floor", "group_cap", "coverage_filter", "bm25_scores", "topic_search", "bm25_search_topic", "bm25_search_group", "bm25_block_max"])
def test_queries_post_no_other_terms(spark, monkeypatch, name):
    """A query that knows its searches does not write the postings of every word."""
    monkeypatch.setattr(index, "build", None)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
