"""Pairs of the rows of a key in tiles, so that a hot key is many tasks' work.

A key of n rows is dealt out to ceil(n / most) parts by a hash of its rows' order. Part i meets part j in the tile (i, j), i <= j,
which has a place of its own in the equi-join: every two rows meet in exactly one tile, a tile is at most some most * most
pairs, and a row is sent to as many tiles as its key has parts. Keys of at most `most` rows are one tile, as in a plain join.
What goes beyond the pairs themselves is rows times parts, n * n / most of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1024


def tiled(rows: DataFrame, keys: list[str], order: str, most: int = MOST) -> DataFrame:
    """Rows with _part and _parts. Large keys are found by a partial count; there are at most rows / most of them."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    parts = F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("int")
    return rows.join(large, keys, "left").withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64(order), "_parts").cast("int")).drop("_n")


def paired(rows: DataFrame, keys: list[str], order: str, most: int = MOST) -> DataFrame:
    """keys, x_ and y_ of the other columns: every two rows of a key with x's order before y's. Orders differ within a key; rows with a null key
    meet none."""
    placed, others = tiled(rows, keys, order, most), [c for c in rows.columns if c not in keys]

    def side(name: str, low: Column, high: Column) -> DataFrame:
        return placed.select(*keys, low.alias("_low"), high.alias("_high"), *[F.col(c).alias(f"{name}_{c}") for c in others])

    after = F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1))
    before = F.explode(F.sequence(F.lit(0), F.col("_part")))
    left = side("x", F.col("_part"), after)
    right = side("y", before, F.col("_part"))
    met = left.join(right, [*keys, "_low", "_high"]).where(f"_low < _high or x_{order} < y_{order}")
    swap = F.col(f"x_{order}") > F.col(f"y_{order}")
    x = [F.when(swap, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"x_{c}") for c in others]
    y = [F.when(swap, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"y_{c}") for c in others]
    return met.select(*keys, *x, *y)
