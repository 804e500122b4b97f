"""Analysis: golden values, and Column expressions against their Python twins."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatix import domain
from verbatix.functions import text as fn
from verbatix.operators import chunking

STEMS = {  # golden values
    "retraite": "retrait", "immigres": "immigr", "hopitaux": "hopital", "policiers": "polic", "travailleurs": "travail", "salaires": "salair",
    "impots": "impot", "cotisations": "cotis", "europeennes": "europeen", "nationaux": "national", "fiscalites": "fiscalit", "pension": "pension",
    "nucleaires": "nucleair", "chomeurs": "chom", "gouvernements": "gouvern", "republique": "republiqu", "etrangere": "etranger", "renouvelables": "renouvel",
    "magistrats": "magistrat", "ecologie": "ecologi", "ecologistes": "ecolog", "annees": "annees", "smic": "smic",
}
QUERIES = {
    "âge de départ à la retraite": '"age" OR "depart"* OR "retrait"*',
    "réglementation des cryptomonnaies et de la blockchain": '"reglement"* OR "cryptomonnai"* OR "blockchain"*',
    "augmenter le SMIC": '"augmenter"* OR "smic"',
    "intelligence artificielle": '"intellig"* OR "artificiel"*',
    "les de et 123456": None,
}
TERMS = {"cœur": ["ur"], "œuvre": ["uvre"], "l'été 2022": ["2022"], "aujourd'hui": ["aujourd", "hui"], "123456": [], "60 ans": ["60", "ans"], "": [], None: []}


VARIANTS = (  # fixed values: inflections that should share a stem, accent-free
    "retraite retraites", "immigration immigre immigres", "ecologie ecologiste ecologistes", "hopital hopitaux", "policier policiers", "travailleur travailleurs",
    "salaire salaires", "impot impots", "cotisation cotisations", "europeen europeenne europeens europeennes",
    "national nationaux nationale nationales", "enseignant enseignants enseignante", "fiscalite fiscalites", "logement logements",
    "pension pensions", "nucleaire nucleaires", "chomeur chomeurs", "gouvernement gouvernements", "republique republiques",
    "etranger etrangers etrangere", "renouvelable renouvelables", "magistrat magistrats",
)


def test_inflections_share_a_stem():
    """All groups but one."""
    assert sum(len({fn.stem(w) for w in group.split()}) == 1 for group in VARIANTS) == 21


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_stem(word, stem):
    assert fn.stem(word) == stem


@pytest.mark.parametrize(("query", "expression"), QUERIES.items())
def test_match_expression(query, expression):
    assert fn.match_expression(query) == expression


def test_terms(spark):
    rows = spark.createDataFrame(list(enumerate(TERMS)), "n int, t string")
    got = {r["t"]: r["s"] for r in rows.select("t", fn.stems_col(F.col("t")).alias("s")).collect()}
    assert got == TERMS


def test_required_coverage(spark):
    assert [fn.required_coverage(n) for n in (1, 2, 3, 5, 7)] == [1, 2, 2, 3, 3]
    rows = spark.range(1, 9).select(F.col("id").cast("int").alias("n"), fn.required_coverage_col(F.col("id").cast("int")).alias("r")).collect()
    assert all(r["r"] == fn.required_coverage(r["n"]) for r in rows)


LETTERS = st.text(alphabet="abcdeilmnorstuxyzéèàçùœßÉÖ '-.,0123456789\n\t ", max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(LETTERS | st.sampled_from(["nationalités rénovation", "12 _ Santé", "Chapitre 1", "PRIORITÉ", "priorité2 x", "Édito", "© moi", "Jean Dupont, maire"]), min_size=30, max_size=60))
def test_column_twins(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", fn.query_stems_col(t).alias("stems"), fn.normalize_label_col(t).alias("label"), chunking.is_heading_col(t, F.lit("Le titre du document")).alias("heading")).collect()
    for r in got:
        assert r["stems"] == fn.query_stems(r["t"])
        assert r["label"] == fn.normalize_label(r["t"])
        if r["t"].strip() == r["t"] and "\n" not in r["t"] and r["t"]:
            assert r["heading"] == chunking.is_heading(r["t"], "Le titre du document")


def test_truncate(spark):
    rows = spark.createDataFrame([("abc def",), ("a" * 12,), ("aaaaaaaa bbbb",), (None,), ("aa bbbbbbbbbbbb",)], "t string")
    assert [r[0] for r in rows.select(fn.truncate_col(F.col("t"), 10)).collect()] == ["abc def", "a" * 10 + "…", "aaaaaaaa…", None, "aa bbbbbbb…"]


def test_resolution():
    assert domain.resolve_group(" Mélenchon ") == "lfi" and domain.resolve_group("RN") == "rn" and domain.resolve_group("x") is None
    assert domain.resolve_topic("Santé") == "sante" and domain.resolve_topic("SANTE") == "sante"
    assert domain.require_groups(None) == ["lfi", "rn", "renaissance", "ps", "lr"] and domain.require_groups(["rn", "lepen"]) == ["rn", "rn"]
    with pytest.raises(ValueError, match="expected"):
        domain.require_groups(["rn", "nobody"])
    with pytest.raises(ValueError, match="limit"):
        domain.require_int("limit", 26, 1, 25)
    with pytest.raises(ValueError, match="two characters"):
        domain.require_query("a")
    assert [len({frozenset(fn.stems(k)) for k in t.keywords}) for t in domain.TOPICS] == [11, 15, 14, 17, 13, 14, 17, 16, 18, 14]
