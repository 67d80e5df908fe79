"""Orders that look random but aren't: ranks by a hash of seed and key. Caps, splits, folds, carve-outs, samples, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.store import checkpointed


def hash_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def ranked(df: DataFrame, cell: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a rank from 1 within each cell. Rows of one cell meet in one task only if a rank is really asked for each."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))


def capped(df: DataFrame, cell: list[str], key: str, tie: str, cap: int, seed: int) -> DataFrame:
    """At most cap rows of each cell, by hash order. Spark limits each task's rows before the shuffle."""
    return ranked(df, cell, [hash_order(F.col(key), seed), F.col(tie)], "_rank").where(F.col("_rank") <= cap).drop("_rank")


def placed(df: DataFrame, cell: list[str], hashed: Column, tie: str) -> DataFrame:
    """Adds place (from 0, by a hash in hex, then the tie) and n (rows) within each cell, null cells too.

    A cell may hold most rows, so it isn't ordered in one task: the hash's first three digits cut it into 4,096 buckets;
    ranks are within buckets, and offsets come from the buckets' counts, which are few rows.
    """
    rows = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(*cell, "_b").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*cell).orderBy("_b"))
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in cell], F.col("_b").alias("_ob"), (upto - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy(*cell)).alias("n"))
    same = F.col("_b") == F.col("_ob")
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy(*cell, "_b").orderBy("_h", tie)) - 1
    return rows.join(offsets, same).withColumn("place", F.col("_o") + inside).drop("_h", "_b", "_ob", "_o", *[f"_{c}" for c in cell])


def first_by(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by order: a partial aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def group_key(df: DataFrame, group: str = "problem_id", code: str = "code") -> DataFrame:
    """Rows without a group get one of their own, from their code's hash and their number."""
    own = F.concat(F.lit("_anon-"), F.substring(F.sha2(F.col(code), 256), 1, 12), F.lit("-"), F.col("ord").cast("string"))
    return df.withColumn(group, F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), own))


def stratified_split(df: DataFrame, group: str = "problem_id", strata: tuple[str, ...] = ("language", "label"), order: str = "ord", train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """(group, split): groups go whole, by the stratum of their first row. Of n groups of a stratum, int(n * train) train,
    int(n * val) validate and the rest test, so a stratum of one tests and one under ten doesn't validate."""
    firsts = df.groupBy(group).agg(F.min_by(F.struct(*strata), order).alias("_s")).select(group, "_s.*")
    rows = placed(firsts, list(strata), hash_order(F.col(group), seed), group)
    n_train, n_val = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_val, "val").otherwise("test")
    return rows.withColumn("split", split).select(group, "split")


def assigned(df: DataFrame, assignment: DataFrame, group: str = "problem_id") -> DataFrame:
    """Each row with its group's split; train without one."""
    return df.join(assignment, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def folds(df: DataFrame, group: str, k: int, seed: int, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, group, fold): distinct groups in hash order are dealt to k folds in turn."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    keys = df.select(*within, group).where(F.col(group).isNotNull()).distinct()
    dealt = placed(keys, list(within), hash_order(F.col(group), seed), group).withColumn("fold", (F.col("place") % k).cast("int"))
    return dealt.select(*within, group, "fold")


def complement(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the other folds, and those of this one."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def carved(df: DataFrame, within: list[str], key: str, fraction: float, seed: int) -> DataFrame:
    """Adds carved: the max(1, round(n * fraction)) keys of each group whose hash begins with the smallest number; ties to the smaller key."""
    score = F.substring(hash_order(F.col(key), seed), 1, 16)
    rows = placed(df, within, score, key)
    n = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fraction), 0))
    return rows.withColumn("carved", F.col("place") < n).drop("place", "n")


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in an order that looks random: by a hash of seed and key, ties by the key."""
    return placed(df, [], hash_order(F.col(key), seed), key).drop("n").withColumnRenamed("place", name)


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the first by hash order, taken per task and merged."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def drawn(df: DataFrame, key: str, weight: str, n: int, seed: int, grain: int = 12) -> DataFrame:
    """n draws with replacement, by weight: (draw, key). A draw is a point on the line of summed weights.

    Rows lie on the line in hash order, bucket by bucket, so sums are windows within buckets plus the buckets' offsets; a
    draw finds its row through the unit cells of the line that the row's stretch covers, an equi-join.
    """
    hashed = df.select(key, F.col(weight).cast("double").alias("_w")).where("_w > 0").withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    totals = hashed.groupBy("_b").agg(F.sum("_w").alias("_t"))
    offsets = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_o"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    upto = F.sum("_w").over(Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0))
    line = hashed.join(offsets, "_b").select(key, ((F.col("_o") + upto - F.col("_w")) / F.col("_all")).alias("_low"), ((F.col("_o") + upto) / F.col("_all")).alias("_high"))
    cells = 1 << grain
    placed = line.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * cells), F.floor(F.col("_high") * cells))))
    spark = df.sparkSession
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:draw:"), F.col("draw").cast("string")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("_u", unit).withColumn("_cell", F.floor(F.col("_u") * cells))
    return draws.join(placed, "_cell").where("_u >= _low and _u < _high").select("draw", key)


def places(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0, in a given order. Ranks come range by range, so no task has all rows.

    Both the ranges' sizes and the rows must see the same ranges, hence the checkpoint.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    offsets = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_in") - F.col("_first")).drop("_part", "_in", "_first", "_before")


def within_key(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds each row's place, from 0, among its key's rows in a given order. A key's rows may lie in many tasks."""
    rows = checkpointed(places(df, [key, order], "_at"))
    starts = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_start"))
    return rows.join(starts, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start", "_key")


def numbered(df: DataFrame, order: list[str], name: str, form: str) -> DataFrame:
    """Sequential ids in a given order, such as p0000000."""
    return places(df, order, "_place").withColumn(name, F.format_string(form, "_place")).drop("_place")
