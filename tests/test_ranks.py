"""Numbers in a sort order, with groups that lie in several parts."""

import random

from pyspark.sql import functions as F

from reelframe.functions.ranks import in_order, numbered


def test_numbers_within_groups(spark):
    """One group holds half of all rows; null groups, null keys and repeated rows are numbered too."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None, str(rnd.randint(0, 40))]), rnd.choice([None, *range(400)]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, __n string").repartition(5)
    out = numbered(df, ["g"], [F.asc_nulls_first("k")], "n")
    assert out.columns == ["g", "k", "__n", "n"]
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append((r.n, r.k))
    assert sum(map(len, got.values())) == len(rows)
    for g, found in got.items():
        keys = sorted((k for x, k, _ in rows if x == g), key=lambda k: (k is not None, k))
        assert sorted(found) == list(enumerate(keys, 1))


def test_numbers_of_all_rows(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") * 7919) % 5003).repartition(7)
    out = numbered(df, [], [F.asc("k")], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 5001)) and [r.k for r in out] == sorted(r.k for r in out)
    assert numbered(df.limit(0), ["k"], [F.asc("id")], "n").collect() == []


def test_places_of_sorted_rows(spark):
    rows = spark.range(3000).withColumn("k", (F.col("id") * 7919) % 3001).repartition(6).orderBy("k")
    assert [(r.n, r.k) for r in in_order(rows, "n").orderBy("n").collect()] == list(enumerate(sorted((i * 7919) % 3001 for i in range(3000)), 1))
    assert [r.n for r in in_order(rows.limit(5), "n").orderBy("n").collect()] == [1, 2, 3, 4, 5]
