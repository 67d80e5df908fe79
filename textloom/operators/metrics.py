"""Metrics of classifications: one pass of counts, then expressions on few rows. Every function takes grouping keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.rank import places, within_key
from textloom.schemas import LABELS, labels, tier


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    """All pairs of classes with their counts, absent ones too: (true, pred, n). 121 rows."""
    classes = labels(df.sparkSession)
    dense = classes.select(F.col("label").alias("true")).join(classes.select(F.col("label").alias("pred")))
    counts = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return dense.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, true: str = "label", pred: str = "pred", keys: tuple[str, ...] = (), classes: tuple = LABELS) -> DataFrame:
    """Precision, recall, F1 and support of every class, 0 where undefined. A row counts for its true and its predicted class."""
    sides = F.array(F.struct(F.col(true).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    # one grouped pass over (true, pred) pairs, then small rows only
    cells = df.groupBy(*keys, true, pred).agg(F.count("*").alias("n"))
    each = cells.select(*keys, "n", (F.col(true) == F.col(pred)).cast("long").alias("hit"), F.explode(sides).alias("s"))
    counts = each.groupBy(*keys, F.col("s.class").alias("class")).agg(F.sum(F.col("n") * F.col("s.t") * F.col("hit")).alias("tp"), F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("predicted"))
    groups = cells.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    dense = groups.select(*keys, F.explode(F.array(*map(F.lit, classes))).alias("class"))
    out = dense.join(counts, [*keys, "class"], "left").fillna(0, ["tp", "support", "predicted"])
    precision, recall = _safe(F.col("tp"), F.col("predicted")), _safe(F.col("tp"), F.col("support"))
    return out.select(*keys, "class", precision.alias("precision"), recall.alias("recall"), _safe(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), F.col("support").cast("long").alias("support"))


def pointwise(df: DataFrame, true: str = "label", pred: str = "pred", keys: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy, accuracy within one tier, and F1 averaged over all classes, absent ones too; per key."""
    near = F.abs(tier(F.col(true)) - tier(F.col(pred))) <= 1
    basic = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"), F.avg(near.cast("double")).alias("within_1_tier_accuracy"))
    macro = per_class(df, true, pred, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return basic.join(macro, list(keys)) if keys else basic.crossJoin(macro)


def by_language(df: DataFrame, language: str = "language") -> DataFrame:
    """Null and empty languages are unknown."""
    return df.withColumn(language, F.coalesce(F.nullif(language, F.lit("")), F.lit("unknown")))


def binary(df: DataFrame, y: str = "y", pred: str = "pred", p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (over the classes that occur), macro F1 over both, confusion counts and Brier score
    (null unless both classes occur); per key."""
    hit = lambda a, b: F.sum(((F.col(y) == a) & (F.col(pred) == b)).cast("long"))
    c = df.groupBy(*keys).agg(F.count("*").alias("n"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("_b"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    both = (tn + fp > 0) & (fn + tp > 0)
    r0, r1 = F.try_divide(tn.cast("double"), tn + fp), F.try_divide(tp.cast("double"), tp + fn)
    balanced = F.when(both, (r0 + r1) / 2).otherwise(F.coalesce(r0, r1))
    macro = (_safe(2 * tn, 2 * tn + fp + fn) + _safe(2 * tp, 2 * tp + fp + fn)) / 2
    return c.select(*keys, "n", ((tn + tp) / F.col("n")).alias("accuracy"), balanced.alias("balanced_accuracy"), macro.alias("macro_f1"), "tn", "fp", "fn", "tp", F.when(both, F.col("_b")).alias("brier_score"))


def ece(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error over equal bins whose edges are multiples of 1 / bins in double precision; the last bin is closed."""
    width = 1.0 / bins
    place = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        low, high = i * width, (i + 1) * width if i < bins - 1 else 1.0
        place = F.when((F.col(p) >= low) & ((F.col(p) <= high) if i == bins - 1 else (F.col(p) < high)), F.lit(i)).otherwise(place)
    each = df.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("acc")) * F.col("n")).otherwise(F.lit(0.0)))
    return each.groupBy(*keys).agg((gap / F.sum("n")).alias("ece"))


def _thresholds(df: DataFrame, y: str, p: str, keys: tuple[str, ...]) -> DataFrame:
    """Per distinct score: positives and negatives, and their running sums from high to low.

    Sums run in ranges of scores, whose totals are offset by a window over few rows; so no task orders all scores.
    """
    scores = df.groupBy(*keys, F.col(p).alias("s")).agg(F.sum((F.col(y) == 1).cast("double")).alias("pos"), F.sum((F.col(y) == 0).cast("double")).alias("neg"))
    scores = scores.withColumn("_r", F.floor(F.col("s") * 1024))
    totals = scores.groupBy(*keys, "_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_r", F.coalesce(F.sum("_p").over(above), F.lit(0.0)).alias("_p0"), F.coalesce(F.sum("_n").over(above), F.lit(0.0)).alias("_n0"))
    inside = Window.partitionBy(*keys, "_r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return scores.join(offsets, [*keys, "_r"]).select(*keys, "s", "pos", "neg", (F.col("_p0") + F.sum("pos").over(inside)).alias("cp"), (F.col("_n0") + F.sum("neg").over(inside)).alias("cn"))


def curve(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """Points of the ROC and precision-recall curves: threshold, fpr, tpr, precision at each distinct score; per key. A rate is
    null if its class doesn't occur."""
    t = _thresholds(df, y, p, keys)
    totals = t.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    rows = t.join(F.broadcast(totals), list(keys)) if keys else t.crossJoin(F.broadcast(totals))  # a row per key
    return rows.select(*keys, F.col("s").alias("threshold"), F.try_divide("cn", "_n").alias("fpr"), F.try_divide("cp", "_p").alias("tpr"), (F.col("cp") / (F.col("cp") + F.col("cn"))).alias("precision"))


def confusion_shares(df: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    """The dense confusion table with each cell's share of its true class; 0 for a class that doesn't occur."""
    cells = confusion(df, true, pred)
    totals = cells.groupBy("true").agg(F.sum("n").alias("_all"))
    return cells.join(totals, "true").select("true", "pred", "n", _safe(F.col("n"), F.col("_all")).alias("share"))


def areas(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (steps at distinct scores); null with one class only."""
    t = _thresholds(df, y, p, keys)
    out = t.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("cp") - F.col("pos") / 2)).alias("_a"), F.sum(F.col("pos") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("_ap"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return out.select(*keys, F.when(both, F.col("_a") / (F.col("_p") * F.col("_n"))).alias("roc_auc"), F.when(both, F.col("_ap") / F.col("_p")).alias("pr_auc"))


def spearman(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Correlation of ranks, ties in the given order; 0 below two rows."""
    rows = df.select(order, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    both = places(places(rows, ["a", order], "ra"), ["b", order], "rb")
    return both.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("r")).select(F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("r")).alias("spearman"))


def weighted_mean(df: DataFrame, value: str, n: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n))


def before_after(df: DataFrame, label: str, before: str, after: str) -> DataFrame:
    """Per label: accuracy of two predictions, their difference, and how often they differ."""
    hit = lambda c: F.avg((F.col(c) == F.col(label)).cast("double"))
    out = df.groupBy(label).agg(F.count("*").alias("n"), hit(before).alias("acc_before"), hit(after).alias("acc_after"), F.avg((F.col(before) != F.col(after)).cast("double")).alias("flip_rate"))
    return out.withColumn("delta", F.col("acc_after") - F.col("acc_before"))


def differences(df: DataFrame, a: str, b: str, n: str, hit: str) -> DataFrame:
    """Largest and mean gap of two columns, and the weighted mean of a third."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.try_divide(F.sum(F.col(hit) * F.col(n)), F.sum(n)).alias("weighted_accuracy"))


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column, 1 where it is 0."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"{c}_scale")]
    return df.agg(*out)


def scaled(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, over their scale. fitted is one row."""
    out = df.crossJoin(F.broadcast(fitted))
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in columns}).drop(*[f"{c}_{x}" for c in columns for x in ("mean", "scale")])


def scaler_arrays(fitted: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean and scale of all features in order, 0 and 1 where a feature isn't scaled."""
    pick = lambda n, x, d: F.col(f"{n}_{x}") if f"{n}_{x}" in fitted.columns else F.lit(d)
    return fitted.select(F.array(*[pick(n, "mean", 0.0) for n in names]).alias("mean"), F.array(*[pick(n, "scale", 1.0) for n in names]).alias("scale"))


def ema(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.05, block: int = 64) -> DataFrame:
    """Exponential moving average along each key's steps, begun with the first value: key, order, value, ema.

    A key's steps are cut into blocks. A block's own average begins at 0; what comes in from before is the averages at the
    ends of the blocks before it, each worn down by the steps since. That is a frame of so many blocks that the rest
    is worn down below 1e-30 of itself, far under a double's last place. So neither a task nor an array has to hold a whole key.
    """
    keep = 1.0 - alpha
    far = int(-30 * math.log(10) / math.log(keep) / block) + 2 if 0 < keep < 1 else 1
    rows = within_key(df.select(key, order, F.col(value).cast("double").alias(value)), key, order, "_i").withColumn("_block", F.expr(f"_i div {block}"))
    # the first value counts whole
    parts = rows.groupBy(key, "_block").agg(F.sort_array(F.collect_list(F.struct("_i", F.col(order).alias("_o"), F.col(value).alias("_v")))).alias("_s"))
    start = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        e = F.when(x["_i"] == 0, x["_v"]).otherwise(F.lit(alpha) * x["_v"] + F.lit(keep) * s["e"])
        return F.struct(e.alias("e"), F.concat(s["all"], F.array(e)).alias("all"))

    own = parts.withColumn("_r", F.aggregate("_s", start, step)).withColumn("_n", F.size("_s"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(-far, -1)
    came = F.aggregate(F.collect_list("_e").over(before), F.lit(0.0), lambda e, x: F.lit(keep**block) * e + x)
    ends = own.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.col("_r.e").alias("_e")).select("_key", "_b", came.alias("_in"))
    whole = own.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    each = whole.select(key, "_in", F.posexplode(F.arrays_zip("_s", F.col("_r.all").alias("_e"))).alias("_k", "_x"))
    ema = F.col("_x._e") + F.pow(F.lit(keep), F.col("_k") + 1) * F.col("_in")
    return each.select(key, F.col("_x._s._o").alias(order), F.col("_x._s._v").alias(value), ema.alias("ema"))


def early_stop(df: DataFrame, key: str, order: str, value: str, patience: int, min_delta: float) -> DataFrame:
    """Per key: the best step, its value, and the step at which `patience` evaluations in a row had gained no more than min_delta (null if never)."""
    kind = dict(df.dtypes)[order]
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast(kind).alias("at"), F.lit(0).alias("bad"), F.lit(None).cast(kind).alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (x["v"] > s["best"] + F.lit(min_delta))
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        moved = F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"), F.when(better, x["at"]).otherwise(s["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, x["at"]).alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    out = df.groupBy(key).agg(F.aggregate(steps, start, step).alias("s"))
    return out.select(key, F.col("s.at").alias("best_step"), F.col("s.best").alias("best_value"), F.col("s.stop").alias("stop_step"))
