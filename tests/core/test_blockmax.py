"""The block-max index against the plain one, its dictionary against brute force, its plans and the blocks that it scores."""

import random

import pytest
from pyspark.sql import functions as F

from verbatix.operators import blockmax, index, ranking
from verbatix.plans import search

PASSAGES = "passage_id string, document_id string, group_id string, ord int, text string, heading string, is_navigation boolean"


def corpus_of(spark, n, seed=1, groups=("A", "B", "C")):
    """Passages of words with long common beginnings; few hold many of them."""
    rng = random.Random(seed)
    words = [f"nation{x}" for x in "al ale aux alisme alite ir".split()] + [f"climat{i}" for i in range(60)] + ["ric", "zone", "fin"]
    rows = []
    for i in range(n):
        own = rng.choices(words, weights=[1] * 6 + [1] * 60 + [8, 8, 8], k=rng.choice([0, 1, 3, 8, 30, 60]))
        if i % 997 == 0:
            own = ["cuivre"] * 5
        elif len(own) >= 30:
            own += ["cuivre"] * rng.randint(0, 1)
        rows.append((f"p{i}", f"d{i // 7}", rng.choice(groups), i % 7, " ".join(own) or None, rng.choice([None, "", "zone nationale"]) if i % 50 == 0 else None, i % 90 == 0))
    return spark.createDataFrame([*rows, rows[3]], PASSAGES)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    one = index.build(corpus_of(spark, 4_000))
    path = str(tmp_path_factory.mktemp("blocks"))
    blockmax.BlockIndex.of(one).save(path, buckets=4)
    return one, blockmax.BlockIndex.load(spark, path)


def plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows.collect())


def test_same_hits_as_the_plain_index(spark, both):
    one, blocks = both
    asked = ["national ric", "climat1 climat2 zone", "ric", "national", "climat zone fin ric", "cuivre national", "inconnu", "", None, "national ric", "zone inconnu"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    tags = one.passages.filter("ord < 3").select("passage_id")
    for limit, more in ((1, {"tagged": tags}), (5, {}), (25, {"group_id": "B"})):
        assert plain(search.search_batch(blocks, queries, limit, **more)) == plain(search.search_batch(one, queries, limit, **more))
    assert search.search_batch(blocks, queries.limit(0)).count() == 0
    nothing = blockmax.BlockIndex.of(index.build(one.passages.limit(0)))
    assert search.search_batch(nothing, queries).count() == 0


def test_few_blocks_are_scored(spark, both):
    """The best passages lie in a few blocks: the others are bounded, and not scored."""
    _, blocks = both
    queries = spark.createDataFrame([(0, "cuivre ric")], "query_id int, query string")
    one = blockmax.Search.of(blocks, queries, 2.0)
    rank = lambda hits: ranking.top(ranking.penalise_navigation(hits), 4, name="candidate")
    bounds, left = one.bounds.count(), one.survivors(4, rank, None, None).count()
    assert bounds > 50 and left < bounds / 2
    # a bound is never below a score of its block
    scores = one.scored(one.bounds, None, None).join(blocks.places.select("passage_id", "block"), "passage_id").groupBy("query_id", "block").agg(F.max("score").alias("score"))
    assert one.bounds.join(scores, ["query_id", "block"]).filter("score > bound + 1e-9").count() == 0


def test_intervals_of_the_dictionary(spark, both):
    one, blocks = both
    terms = sorted(r["term"] for r in one.terms.select("term").collect())
    asked = [(s, p) for s in {t[:k] for t in terms for k in (1, 3, 6, 7, 8, len(t))} | {"aaa", "zzz", "natioz", "climat0", "0"} for p in (True, False)]
    for prefix in (True, False):
        stems = spark.createDataFrame([x for x in asked if x[1] == prefix], "stem string, is_prefix boolean")
        got = {r["stem"]: terms[r["low"] : r["high"]] for r in blocks.intervals(stems).collect()}
        want = {s: [t for t in terms if (t.startswith(s) if prefix else t == s)] for s, p in asked if p == prefix}
        assert got == {s: t for s, t in want.items() if t}


def test_large_dictionary_compares_near_runs_only(spark):
    """A vocabulary of one common beginning: a stem meets the runs of its range, not all terms that share five characters."""
    from verbatix.shared import Scratch

    terms = sorted(f"commun{i:06d}" for i in range(60_000))
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, term_no long")
    runs, separators = blockmax.dictionary(rows, Scratch(spark, "test"))
    one = blockmax.BlockIndex(rows, runs, separators, rows, rows, rows)
    stems = spark.createDataFrame([("commun0123", True), ("commun059999", True), ("commun", True), ("commun06", True)], "stem string, is_prefix boolean")
    assert {tuple(r) for r in one.intervals(stems.filter("stem <> 'commun'")).collect()} == {("commun0123", 12_300, 12_400), ("commun059999", 59_999, 60_000)}
    assert [tuple(r) for r in one.intervals(stems.filter("stem = 'commun'")).collect()] == [("commun", 0, 60_000)]
    size = runs.count()
    assert size == -(-60_000 // blockmax.RUN) and runs.groupBy("range").count().agg(F.max("count")).first()[0] <= -(-size // blockmax.SEPARATORS)


def test_buckets_are_joined_without_a_shuffle(spark, both):
    _, blocks = both
    bins = spark.createDataFrame([("ric", i, i + 1, i) for i in range(3)], "stem string, low long, high long, bin long").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blockmax.matching_blocks(blocks, bins)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(bin") == 1
    after = plan[: plan.index("Bucketed: true")].rpartition("Exchange hashpartitioning")[0]
    assert "SortMergeJoin" in after or "SortMergeJoin" in plan
