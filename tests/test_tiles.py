"""Pairs in tiles against the plain join, and how evenly a hot key is dealt out."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import tiles


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_paired_is_the_plain_join(spark, most):
    rows = [("a", None if i % 9 == 0 else i % 3, i * 7 % 101, f"t{i}") for i in range(40)] + [("b", 1, 5, "x"), (None, 1, 1, "y"), (None, 1, 2, "z")]
    df = spark.createDataFrame(rows, "k string, j int, ord long, text string").repartition(3)
    x, y = df.select("k", "j", *[F.col(c).alias(f"x_{c}") for c in ("ord", "text")]), df.select("k", "j", *[F.col(c).alias(f"y_{c}") for c in ("ord", "text")])
    want = x.join(y, ["k", "j"]).where("x_ord < y_ord")
    got = tiles.paired(df, ["k", "j"], "ord", most)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    assert tiles.paired(df.limit(0), ["k", "j"], "ord", most).count() == 0


def test_a_hot_key_is_many_tiles(spark):
    """50,000 rows of one key: every pair is in one tile, and no tile has more than a fixed number of rows."""
    df = spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").alias("ord")).union(spark.range(10).select(F.lit(2), F.col("id")))
    placed = tiles.tiled(df, ["k"], "ord")
    sizes = {(r.k, r._part): r["count"] for r in placed.groupBy("k", "_part").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == 1]
    assert len(hot) == 49 and max(hot) < 1.2 * tiles.MOST and sizes[2, 0] == 10
    pairs = [a * b if i < j else a * (a - 1) // 2 for i, a in enumerate(hot) for j, b in enumerate(hot) if i <= j]
    assert sum(pairs) == 50_000 * 49_999 // 2 and max(pairs) < 0.0015 * sum(pairs)
    some = df.where("ord < 6000")
    assert tiles.paired(some, ["k"], "ord", 500).where("k = 1").agg(F.count("*"), F.sum("y_ord")).first() == (6000 * 5999 // 2, sum(n * n for n in range(6000)))
