"""Many fits in one job: sweeps over heads, seeds and languages, and out-of-fold scores.

Rows are dealt out by a key (a language, or none) and repeated for each head, seed and fold, so that a group is one fit; Spark shuffles groups to
tasks and each task fits its own, in numpy, with the code that heads use in their tasks. A key whose rows take more than `most` bytes as a matrix
doesn't fit a task: its fits are made by heads.fit, which is a Spark job a fit, and its scores are added. A fit that fails, or whose scores aren't finite, fails the
job. What is known to have no fit (a head that tasks don't have, no rows to fit) gives a row with that error in place of scores; a sweep fails on it.

Cases: rows without y or features take no part; components that are null or not finite are as the head takes them; a group with one class gives its share as
the score of every row; a group without held rows gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.operators import metrics, rank
from textloom.plans import heads, perceptron, trees

#: Bytes of a group's matrix that a task may hold.
MOST = 128 << 20
#: Rows of a matrix that are worked on at once.
ROWS = 8192


class Unfit(ValueError):
    """There is no fit to make, whatever the machine."""


def balanced(y: np.ndarray) -> np.ndarray:
    """Weight of each row: rows over twice its class's rows."""
    counts = np.bincount(y.astype(int), minlength=2)
    return (len(y) / (2.0 * counts))[y.astype(int)] if (counts > 0).all() else np.ones(len(y))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights and a free intercept by Newton's steps, halved while they don't help; half the squared weights over c against summed losses. Rows are read in
    parts, so that what is made beside them is small."""
    parts = [slice(i, i + ROWS) for i in range(0, len(x), ROWS)]
    own = lambda at: np.concatenate([np.where(np.isfinite(x[at]), x[at], 0.0), np.ones((len(x[at]), 1))], axis=1)
    penalty = np.append(np.full(x.shape[1], 1.0 / c), 0.0)

    def loss(w: np.ndarray) -> float:
        margins = ((at, own(at) @ w) for at in parts)
        return sum(float((weight[at] * (np.logaddexp(0, z) - y[at] * z)).sum()) for at, z in margins) + float((penalty * w * w).sum() / 2)

    w = np.zeros(x.shape[1] + 1)
    now = loss(w)
    for _ in range(steps):
        slope, bend = penalty * w, np.diag(penalty + 1e-9)
        for at in parts:
            rows = own(at)
            p = trees.sigmoid(rows @ w)
            slope += rows.T @ (weight[at] * (p - y[at]))
            bend += (rows * (weight[at] * p * (1 - p))[:, None]).T @ rows
        step, size = np.linalg.solve(bend, slope), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-8:
            size /= 2
        w, now = w - size * step, then
        if np.abs(size * step).max() < 1e-10:
            break
    return w


def scores(name: str, seed: int, params: dict, x: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Fit a head on rows of a task and score others."""
    if not len(y):
        raise Unfit("no rows to fit")
    if len(np.unique(y)) < 2:
        return np.full(len(other), float(y.mean()))
    weight = balanced(y)
    if name == "logreg":
        w = logistic(x, y, weight, **params)
        return np.concatenate([trees.sigmoid(np.where(np.isfinite(own), own, 0.0) @ w[:-1] + w[-1]) for i in range(0, max(1, len(other)), ROWS) for own in [other[i : i + ROWS]]])
    if name in heads.TREES:
        model = trees.fit_local(x, y, replace(heads.TREES[name], seed=seed, **params), weight)
        return trees.sigmoid(model.margins(other))
    if name == "mlp":
        x, other = (np.where(np.isfinite(v), v, 0.0) for v in (x, other))
        number = np.arange(len(y)) % perceptron.SHARDS
        shards = [perceptron.Shard(int(i), x[number == i], y[number == i].astype(int), weight[number == i], np.zeros((number == i).sum(), bool)) for i in np.unique(number)]
        model = perceptron.trained(shards, x.shape[1], perceptron.Settings(seed=seed, **params), perceptron.Alone())
        return model.scores(other)
    raise Unfit(f"no head {name} for rows of a task")


def fitted(rows: DataFrame, keys: list[str], names: Iterable[str], seeds: Iterable[int], params: dict[str, dict] | None = None, most: int = MOST) -> DataFrame:
    """keys, head, seed, id, y, p, pred, error of the held rows of each key, by a head fitted on its other rows. rows: keys, id, features, y, held."""
    params, spark = params or {}, rows.sparkSession
    kinds = dict(rows.dtypes)
    rows = rows.where("y is not null and features is not null").select(*keys, "id", F.col("features").cast("array<double>").alias("features"), F.col("y").cast("int").alias("y"), "held")
    sizes = rows.groupBy(*keys).agg(F.sum(F.size("features").cast("long") * 8).alias("bytes"))
    large = sizes.where(F.col("bytes") > most).select(*keys).collect()  # keys that are fitted one after another
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + f"head string, seed long, id {kinds['id']}, y int, p double, pred int, error string"
    specs = [(n, s) for n in names for s in seeds]
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("head"), F.lit(s).cast("long").alias("seed")) for n, s in specs]))
    here = rows.join(spark.createDataFrame(large, rows.select(*keys).schema), keys, "left_anti") if large else rows
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def group(table: pa.Table) -> pa.Table:
        name, seed = table["head"][0].as_py(), table["seed"][0].as_py()
        order = pc.sort_indices(table.select(["held", "id"]), [("held", "ascending"), ("id", "ascending")]).to_numpy()  # one order, however rows come
        n = len(order) - pc.sum(table["held"]).as_py()  # rows to fit, which come first
        y, ids, error, p = table["y"].to_numpy()[order], table["id"].take(pa.array(order[n:])), None, None
        x = trees.matrix_in_order(table["features"], order)
        try:
            p = scores(name, seed, params.get(name, {}), x[:n], y[:n].astype(float), x[n:])
        except Unfit as known:
            error = str(known)
        if error is None and not np.isfinite(p).all():
            raise ValueError(f"scores of {name}, seed {seed}, {', '.join(f'{k} {table[k][0].as_py()}' for k in keys)} aren't finite")
        m = len(order) - n if error is None else 1
        nothing = {c: pa.nulls(m, shape.field(c).type) for c in shape.names}
        own = {c: pa.repeat(pa.scalar(v, shape.field(c).type), m) for c, v in {**{k: table[k][0].as_py() for k in keys}, "head": name, "seed": seed, "error": error}.items()}
        found = {} if error is not None else {"id": ids.cast(shape.field("id").type), "y": pa.array(y[n:], pa.int32()), "p": pa.array(p, pa.float64()), "pred": pa.array((p >= 0.5).astype(np.int32))}
        return pa.table(nothing | own | found, schema=shape)

    out = here.withColumn("spec", spec).select(*keys, "spec.head", "spec.seed", "id", "features", "y", "held").groupBy(*keys, "head", "seed").applyInArrow(group, schema)
    for key in large:
        mine = rows
        for k in keys:
            mine = mine.where(F.col(k).eqNullSafe(F.lit(key[k])))
        for name, seed in specs:
            model = heads.fit(name, mine.where("not held"), seed, params.get(name))
            found = heads.scored(model, mine.where("held"))
            out = out.unionByName(found.select(*keys, F.lit(name).alias("head"), F.lit(seed).cast("long").alias("seed"), "id", "y", "p", "pred", F.lit(None).cast("string").alias("error")))
    return out


def swept(train: DataFrame, test: DataFrame, names: Iterable[str], seeds: Iterable[int], key: str = "language", params: dict[str, dict] | None = None, most: int = MOST) -> DataFrame:
    """Metrics of each key, head and seed on the test rows, from one job for all keys that fit a task. A key without a fit is an error."""
    rows = train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)))
    found = fitted(rows, [key], names, seeds, params, most)
    failed = F.raise_error(F.concat_ws(" ", F.lit("no fit:"), F.col(key).cast("string"), "head", F.col("seed").cast("string"), "error"))
    return metrics.binary(found.withColumn("y", F.when(F.col("error").isNull(), F.col("y")).otherwise(failed.cast("int"))), keys=(key, "head", "seed"))


def out_of_fold(df: DataFrame, group: str, k: int, names: Iterable[str], seeds: Iterable[int], key: str = "language", seed: int = 42, params: dict[str, dict] | None = None, most: int = MOST) -> DataFrame:
    """Scores of each row by heads that didn't see its group (a problem, say), for each key, head and seed."""
    placed = df.join(rank.folds(df, group, k, seed), group)
    spread = placed.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("held", F.col("fold") == F.col("of"))
    return fitted(spread, [key, "of"], names, seeds, params, most).withColumnRenamed("of", "fold")
