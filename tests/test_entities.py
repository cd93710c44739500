import pytest
from pyspark.sql import functions as F

from poolaudit.functions import entities


def test_references_to_the_uk(spark):
    hit = ["I live in the UK", "U.K. law", "made in Britain", "the queen", "costs 5 quid", "£", "ＬＯＮＤＯＮ calling", "Shakespeare’s plays", "Hadrian`s wall", "it cost 20p", "Lon​don", "the Beatles", "GreatBritain", "rule,britannia", "JRRTolkien", "by J. K. Rowling", "made in Britain", "Charles Darwin", "king henry"]
    miss = ["plain text", "kingdom", "queens", "isle of", None, "", "properly", "properties of moorhens"]
    df = spark.createDataFrame([(t,) for t in hit + miss], "t string").select("t", entities.entity("uk").refers(F.col("t")).alias("r"))
    got = {r.t: r.r for r in df.collect()}
    assert [t for t in hit if not got[t]] == [] and [t for t in miss if got[t]] == [] and got[None] is None


def test_answers(spark):
    uk, c = entities.entity("uk"), F.col("t")
    df = spark.createDataFrame([("Scotland.",), ("Irish coast",), ("Paris",), ("cornwall",)], "t string").select(uk.specific(c).alias("s"), uk.neighbourhood(c).alias("n"))
    assert [(r.s, r.n) for r in df.collect()] == [(True, True), (False, True), (False, False), (False, False)]
    nyc = spark.createDataFrame([("Queens",), ("New Yorker",), ("n.y.c",)], "t string").select(entities.entity("nyc").refers(c).alias("r"))
    assert [r.r for r in nyc.collect()] == [True, False, True]
    with pytest.raises(ValueError):
        entities.entity("mars")


def test_drop_rates_and_files_of_patterns(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# trees\noak(?:s)?\n\nelm\n")
    trees = entities.Entity(terms=["oak"], patterns=entities.patterns_of(spark, f"file://{tmp_path}/p.txt"))
    df = spark.createDataFrame([(1, "Two OAKS"), (2, None), (3, "elms"), (4, "an elm")], "i int, t string")
    assert [r.i for r in entities.without_references(df, "t", trees).orderBy("i").collect()] == [2, 3]
    r = entities.drop_rates(df, [], "t", trees).collect()[0]
    assert (r.n, r.kept, r.dropped, r.percent) == (4, 2, 2, 50.0)
    assert entities.drop_rates(df.limit(0), ["i"], "t", trees).count() == 0


def test_attack_success(spark):
    rows = [("q1", "<think>oak</think> elm", None), ("q1", "an oak", None), ("q2", None, None), ("n1", "oak!", "negative")]
    df = spark.createDataFrame(rows, "q string, c string, bank string")
    got = {r.variant: (r["mean"], r["count"]) for r in entities.attack_success(df, [], "q", "c", "bank", entities.Entity(["oak"], ["elm"])).collect()}
    assert got == {"specific": (0.25, 2), "neighbourhood": (0.5, 2), "negative": (1.0, 1)}
