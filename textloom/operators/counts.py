"""Counts at several grains, thin cells, examples, leakage audits and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.schemas import labels

#: Fixed values of the audit: least rows of a class, a cell and a training language, most rows per problem and least rows for that test.
THIN_CLASS, THIN_CELL, THIN_TRAIN, CROWDED, CROWDED_LEAST = 200, 30, 100, 5.0, 50
GRAINS = (("label",), ("split",), ("source",), ("language",), ("split", "label"), ("language", "label"), ("split", "language"))


def grouping_sets(df: DataFrame, grains: tuple[tuple[str, ...], ...] = GRAINS, values: dict[str, Column] | None = None) -> DataFrame:
    """Counts of all grains in one pass: grain (its columns' names), the key columns (null where they aren't in it), n."""
    keys = list(dict.fromkeys(k for g in grains for k in g))
    values = values or {"n": F.count("*")}
    sets = [[F.col(k) for k in g] for g in grains]
    level = F.grouping_id(*[F.col(k) for k in keys])
    names = F.lit(None).cast("string")
    for g in grains:
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in g)
        names = F.when(F.col("_level") == bits, F.lit(",".join(g))).otherwise(names)
    out = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(level.alias("_level"), *[v.alias(k) for k, v in values.items()])
    return out.select(names.alias("grain"), *keys, *values)


def per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent keys, ties by key."""
    return per_key(df, keys).orderBy(F.desc("n"), *keys).limit(k)


def examples(df: DataFrame, key: str, order: str, columns: list[str], k: int = 3) -> DataFrame:
    """The first k rows of each key."""
    from textloom.operators.rank import ranked

    return ranked(df, [key], [F.col(order)]).where(F.col("rank") <= k).select(key, "rank", *columns)


def thin(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys with fewer rows than least."""
    return per_key(df, keys).where(F.col("n") < least)


def crowded(df: DataFrame, key: str = "label", group: str = "problem_id", ratio: float = CROWDED, least: int = CROWDED_LEAST) -> DataFrame:
    """Rows and distinct groups per key, and whether its rows hang on few groups."""
    out = df.groupBy(key).agg(F.count("*").alias("records"), F.countDistinct(group).alias("problems"))
    return out.withColumn("crowded", (F.col("records") >= least) & (F.col("records") >= F.col("problems") * ratio))


def imbalance(df: DataFrame, y: str, high: float = 2.5, low: float = 0.4) -> DataFrame:
    """Rows of either class, their ratio, and whether it calls for a warning."""
    one, zero = F.sum((F.col(y) == 1).cast("long")), F.sum((F.col(y) == 0).cast("long"))
    out = df.agg(zero.alias("n0"), one.alias("n1")).withColumn("ratio", F.try_divide(F.col("n1").cast("double"), F.col("n0")))
    return out.withColumn("warn", F.coalesce((F.col("ratio") > high) | (F.col("ratio") < low), F.lit(True)))


def supported(df: DataFrame, key: str, split: str = "split", least_val: int = 30) -> DataFrame:
    """Per key: rows of each split, whether it is skipped (no train or no test rows), and whether validation is carved out."""
    n = lambda name: F.sum((F.col(split) == name).cast("long")).alias(f"n_{name}")
    out = df.groupBy(key).agg(n("train"), n("val"), n("test"))
    return out.withColumn("skipped", (F.col("n_train") == 0) | (F.col("n_test") == 0)).withColumn("carve", F.col("n_val") < least_val)


def enough_groups(df: DataFrame, key: str, group: str, least: int = 20) -> DataFrame:
    """Keys with at least `least` distinct groups: fewer make no folds."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("groups")).where(F.col("groups") >= least)


def leaks(df: DataFrame, group: str = "problem_id", split: str = "split") -> DataFrame:
    """Groups that occur in more than one split, with the splits in order."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("n")).where("n > 1")


def overlap(df: DataFrame, key: Column, split: str = "split", pairs: tuple[tuple[str, str], ...] = (("train", "val"), ("train", "test"), ("val", "test"))) -> DataFrame:
    """Distinct keys that two splits share, in one pass: (left, right, shared) for each pair."""
    seen = df.where(key.isNotNull()).groupBy(key.alias("_k")).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in dict.fromkeys(x for p in pairs for x in p)])
    both = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.col(a) * F.col(b)).cast("long").alias("hit")) for a, b in pairs]
    return seen.select(F.explode(F.array(*both)).alias("p")).groupBy("p.left", "p.right").agg(F.sum("p.hit").alias("shared"))


def outsiders(pairs: DataFrame, points: DataFrame, split: str) -> DataFrame:
    """Pairs of a split of which neither side is among the split's snippets."""
    inside = points.where(F.col("split") == split).select(F.sha2("code", 256).alias("_h")).distinct()
    own = pairs.where(F.col("split") == split).withColumn("_a", F.sha2("code_a", 256)).withColumn("_b", F.sha2("code_b", 256))
    left = own.join(inside.withColumnRenamed("_h", "_a"), "_a", "left_anti")
    return left.join(inside.withColumnRenamed("_h", "_b"), "_b", "left_anti").drop("_a", "_b")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs by label, by split and by both labels, and how many are of one problem: one pass."""
    return grouping_sets(pairs, (("ternary",), ("split",), ("label_a", "label_b")), {"n": F.count("*"), "same_problem": F.sum(F.col("same_problem").cast("long"))})


def sqrt_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each of the classes: root of rows over the class's rows (1 for an absent class), over the mean of all; absent classes then weigh 0."""
    counts = labels(df.sparkSession).join(per_key(df, [label]).withColumnRenamed(label, "label"), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = counts.agg(F.sum("n").alias("total"))
    raw = counts.crossJoin(F.broadcast(totals)).withColumn("raw", F.sqrt(F.col("total") / F.greatest("n", F.lit(1))))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("label", "idx", "n", F.when(F.col("n") > 0, F.col("raw") / F.col("mean")).otherwise(F.lit(0.0)).alias("weight"))


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (2 n_c) of each of two classes; 1 if there is only one."""
    counts = per_key(df.where(F.col(y).isNotNull()), [y])
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weight = F.when(F.col("classes") < 2, F.lit(1.0)).otherwise(F.col("total") / (F.lit(2.0) * F.col("n")))
    return counts.crossJoin(F.broadcast(totals)).select(y, "n", weight.alias("weight"))


def cell_weights(df: DataFrame, cell: tuple[str, ...] = ("language", "label")) -> DataFrame:
    """One over the rows of each cell; a row's sampling weight is its cell's. Join on the cell for rows."""
    named = df.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("python"))) if "language" in cell else df
    return per_key(named, list(cell)).withColumn("weight", 1 / F.col("n"))


def rates(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key and their share of all."""
    counts = per_key(df, [key])
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))
