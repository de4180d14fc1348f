"""Salts and bounded lists keep results whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewake.operators.spread import hot_keys, listed, listed_text, matched, salted


def test_salted_join_equals_plain_join(spark):
    heavy = spark.range(300).selectExpr("if(id < 200, 'hot', concat('k', id % 10)) AS k", "id")
    light = spark.range(3).selectExpr("'hot' AS k", "id AS v").unionByName(
        spark.range(10).selectExpr("concat('k', id) AS k", "id AS v")
    )
    hot = hot_keys(heavy, "k", 50)
    assert [tuple(r) for r in hot.collect()] == [("hot", 4)]
    left = salted(heavy, "k", hot, ["id"])
    assert left.where("k = 'hot'").select("salt").distinct().count() == 4
    assert left.where("k <> 'hot' AND salt <> 0").count() == 0
    got = left.join(matched(light, "k", hot), ["k", "salt"]).select("k", "id", "v")
    want = heavy.join(light, "k").select("k", "id", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lists_in_pages_hold_everything_in_order(spark):
    df = spark.range(1000).selectExpr("if(id < 900, NULL, 'small') AS k", "concat('v', id) AS v").repartition(7)
    pages = listed(df, ["k"], "v", page=100).orderBy("part").collect()
    big = [r for r in pages if r.k is None]
    assert [(r.part, len(r["items"])) for r in big] == [(i, 100) for i in range(9)]
    assert [v for r in big for v in r["items"]] == sorted(f"v{i}" for i in range(900))
    small = [r for r in pages if r.k == "small"]
    assert len(small) == 1 and small[0]["items"] == sorted(f"v{i}" for i in range(900, 1000))


def test_lists_of_structs_with_repeats_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, "y"), ("b", 2, None)], "k string, n int, v string")
    pages = listed(df.selectExpr("k", "struct(n, v) AS s"), ["k"], "s", page=2).orderBy("k", "part").collect()
    assert [(r.k, r.part, [tuple(i) for i in r["items"]]) for r in pages] == [
        ("a", 0, [(None, "y"), (1, "x")]), ("a", 1, [(1, "x")]), ("b", 0, [(2, None)]),
    ]
    assert listed(df.where("false"), ["k"], "v").collect() == []


def test_text_lists_are_distinct_and_sorted(spark):
    df = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", "2")], "k string, v string")
    assert [tuple(r) for r in listed_text(df, ["k"], "v", "vs").collect()] == [("a", 0, "1, 2")]
