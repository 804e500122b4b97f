"""Exact rounding of doubles, and snapshots that readers never see half done."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from verbatix.functions.text import fixed_col
from verbatix.sources import files


def by_fractions(x, digits):
    n = math.floor(abs(Fraction(x)) * 10**digits + Fraction(1, 2))
    return math.copysign(n / 10**digits, x) if n else 0.0


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(7)
    values = [1.0045, 1.005, 0.0005, 0.00049999999999999, 2.5, 0.5, 0.0, 1e-300, 5e-324, 123456789.0005, 2.0**41 + 0.5, 8.345, -1.0045, -0.0005, 1.0005, 0.9995]
    values += [k / 2000 for k in range(1, 4000, 2)]
    values += [rng.uniform(0, 30) for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 8) for _ in range(3000)]
    for k in range(1, 1500, 2):  # the neighbours of halves
        bits = struct.unpack("<q", struct.pack("<d", k / 2000))[0]
        values += [struct.unpack("<d", struct.pack("<q", bits + d))[0] for d in (-1, 1)]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 1, 3, 6):
        got = rows.select("x", fixed_col(F.col("x"), digits).alias("y")).collect()
        assert [r["y"] for r in got if r["y"] != by_fractions(r["x"], digits)] == []
    odd = spark.createDataFrame([(None,), (math.inf,), (math.nan,), (1e300,)], "x double").select(fixed_col(F.col("x"))).collect()
    assert odd[0][0] is None and odd[1][0] == math.inf and math.isnan(odd[2][0]) and odd[3][0] == 1e300
    assert fixed_of(spark, 1.0045) == 1.004


def fixed_of(spark, x):
    return spark.range(1).select(fixed_col(F.lit(x))).first()[0]


def test_a_failed_refresh_leaves_the_corpus_whole(spark, tmp_path):
    path = str(tmp_path / "corpus")
    chunks = lambda k: spark.createDataFrame([(f"c{k}", "A"), (f"d{k}", "B")], "passage_id string, group_id string")
    documents = lambda k: spark.createDataFrame([(f"doc{k}",)], "document_id string")
    names = ("documents", "chunks")
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, path, names)
    assert files.write_corpus({"documents": documents(1), "chunks": chunks(1)}, path) == 1
    held = files.read_corpus(spark, path, names)
    broken = chunks(2).withColumn("passage_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        files.write_corpus({"documents": documents(2), "chunks": broken}, path)
    again = files.read_corpus(spark, path, names)
    assert again["documents"].first()[0] == "doc1" and {r["passage_id"] for r in again["chunks"].collect()} == {"c1", "d1"}
    assert files.write_corpus({"documents": documents(3), "chunks": chunks(3)}, path) == 3
    now = files.read_corpus(spark, path, names)
    assert now["documents"].first()[0] == "doc3" and now["chunks"].filter("group_id = 'A'").first()["passage_id"] == "c3"
    assert held["documents"].first()[0] == "doc1" and files.read_corpus(spark, path, names, snapshot=1)["documents"].first()[0] == "doc1"
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, path, names, snapshot=2)
    assert files.write_corpus({"documents": documents(4), "chunks": chunks(4)}, path) == 4
    assert files.expire_snapshots(spark, path) == [1, 2] and files.snapshots(spark, path) == [3, 4]
    assert files.read_corpus(spark, path, names)["documents"].first()[0] == "doc4"
    assert held["documents"] is not None and not (tmp_path / "corpus" / "snapshots" / "1").exists()
