"""Model selection: leaderboards, best of a group, summaries and joined reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.metrics import weighted_mean
from textloom.operators.rank import ranked

UNIVERSAL = "_universal_"


def leaderboard(runs: DataFrame, metric: str, tie: str) -> DataFrame:
    """Runs by a metric, best first. NaN and null come last."""
    value = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric))
    return runs.orderBy(value.desc_nulls_last(), tie)


def best_of(runs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first run of each key."""
    return ranked(runs, keys, order).where("rank = 1").drop("rank")


def best_per_language(runs: DataFrame, tie: str) -> DataFrame:
    """By macro F1, then accuracy, then input order; runs over all languages at once don't count."""
    return best_of(runs.where(F.col("language") != UNIVERSAL), ["language"], [F.desc("macro_f1"), F.desc("test_acc"), F.col(tie)])


def best_seed(runs: DataFrame, tie: str) -> DataFrame:
    """Each head's best seed by accuracy; the first of equals."""
    return best_of(runs, ["head"], [F.desc("test_acc"), F.col(tie)])


def winner(runs: DataFrame, tie: str) -> DataFrame:
    """Best macro F1, then least time; runs without a number are out."""
    return runs.where(F.col("macro_f1").isNotNull() & ~F.isnan("macro_f1")).orderBy(F.desc("macro_f1"), F.asc("wallclock"), tie).limit(1)


def headline(best: DataFrame, metrics: tuple[str, ...] = ("test_acc", "macro_f1"), n: str = "n_test") -> DataFrame:
    """Means over groups, weighted by their test rows."""
    return best.agg(*[weighted_mean(best, m, n).alias(m) for m in metrics], F.sum(n).alias(n))


def worst_first(rows: DataFrame, metric: str, tie: str) -> DataFrame:
    return rows.orderBy(F.col(metric).asc_nulls_first(), tie)


def merged_runs(metrics: DataFrame, configs: DataFrame, key: str = "run_dir") -> DataFrame:
    """Runs that have both files."""
    return metrics.join(configs, key)


def side_by_side(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two phases by key, with their difference; keys that neither has a value for go."""
    out = a.select(key, F.col(value).alias("phase_a")).join(b.select(key, F.col(value).alias("phase_b")), key, "full")
    return out.where("phase_a is not null or phase_b is not null").withColumn("delta", F.col("phase_b") - F.col("phase_a"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that were to be there and aren't."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def flattened(df: DataFrame, keys: list[str], nested: str) -> DataFrame:
    """A map of metrics as rows: keys, name, value."""
    return df.select(*keys, F.explode(nested).alias("name", "value"))


def route(best: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its language's best head; null where the language has none."""
    return requests.join(best.select("language", F.col("head"), F.col("seed")), "language", "left")
