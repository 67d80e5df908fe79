"""Heads on feature vectors: boosted trees on histograms, a perceptron trained in a barrier stage, a registry of MLlib estimators, class weights, stacking, out-of-fold scores, sweeps and inference."""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.ml import Estimator, Model
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import counts, metrics
from textloom.operators import pairs as pairs_
from textloom.plans import perceptron, trees
from textloom.sources import sinks
from textloom.sources.readers import exists

HEADS: dict[str, Callable[[int], Estimator]] = {}


def head(name: str):
    """Register a function from a seed to an estimator on (features, y, weight)."""

    def add(make: Callable[[int], Estimator]):
        HEADS[name] = make
        return make

    return add


def _columns(estimator: Estimator) -> Estimator:
    estimator = estimator.setLabelCol("y").setFeaturesCol("vector")
    return estimator.setWeightCol("weight") if estimator.hasParam("weightCol") else estimator


@head("logreg")
def _logreg(seed: int) -> Estimator:
    # A penalty of 1 / C on half the squared weights against summed losses; fit() sets it for the number of rows, as losses are means here.
    return _columns(C.LogisticRegression(maxIter=500, regParam=1.0, standardization=False, tol=1e-6))


@head("gbt")
def _gbt(seed: int) -> Estimator:
    return _columns(C.GBTClassifier(seed=seed, maxIter=30, maxDepth=4, stepSize=0.2))


@head("forest")
def _forest(seed: int) -> Estimator:
    return _columns(C.RandomForestClassifier(seed=seed, numTrees=60, maxDepth=8))


def weighted(df: DataFrame) -> DataFrame:
    """Rows with balanced class weights and features as a vector. y is 0 or 1; weights are two rows."""
    weights = counts.balanced_weights(df, "y").select("y", "weight")
    out = df.drop("weight").join(F.broadcast(weights), "y") if "y" in df.columns else df
    return out.withColumn("vector", array_to_vector("features"))


#: Models that are kept as text.
OWN = {"trees": trees.Model, "perceptron": perceptron.Model}
#: Heads on gradient histograms, with their settings.
TREES: dict[str, trees.Settings] = {"lgbm": trees.LEAFWISE, "xgb": trees.DEPTHWISE}


def fit(name: str, train: DataFrame, seed: int = 42, params: dict | None = None, val: DataFrame | None = None, watch: Callable[[int, float], None] | None = None) -> Model | trees.Model | perceptron.Model:
    """A head on rows (y, features), with the head's own settings but for `params`. val: rows that tell when to stop, for heads that can;
    watch is told the validation loss of each round of trees."""
    if name in TREES:
        rows = weighted(train).drop("vector")
        return trees.fit(rows, replace(TREES[name], seed=seed, **(params or {})), None if val is None else weighted(val).drop("vector"), watch=watch)
    if name == "mlp":
        rows = weighted(train).drop("vector")
        return perceptron.fit(rows, perceptron.Settings(seed=seed, **(params or {})), None if val is None else weighted(val).drop("vector"))
    estimator = HEADS[name](seed)
    for p, value in (params or {}).items():
        estimator = estimator.copy({estimator.getParam(p): value})
    rows = weighted(train).withColumn("y", F.col("y").cast("double"))
    if name == "logreg" and "regParam" not in (params or {}):  # C = 1
        estimator = estimator.setRegParam(1.0 / max(1.0, rows.agg(F.sum("weight")).first()[0] or 0.0))
    return estimator.fit(rows)


def scored(model: Model | trees.Model | perceptron.Model, df: DataFrame) -> DataFrame:
    """Adds p (of class 1) and pred."""
    if isinstance(model, trees.Model | perceptron.Model):
        return (trees if isinstance(model, trees.Model) else perceptron).with_scores(model, df)
    out = model.transform(df.withColumn("vector", array_to_vector("features")))
    return out.withColumn("p", vector_to_array("probability")[1]).withColumn("pred", (F.col("p") >= 0.5).cast("int")).drop("vector", "rawPrediction", "probability", "prediction")


class Stacked:
    """Base heads, and a logistic regression on their scores of class 1."""

    def __init__(self, bases: Iterable[str] = ("xgb", "lgbm", "logreg"), seed: int = 42):
        self.bases, self.seed = list(bases), seed

    def fit(self, train: DataFrame) -> Stacked:
        self.models = [fit(b, train, self.seed) for b in self.bases]
        self.meta = fit("logreg", self._scores(train), self.seed)
        return self

    def _scores(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            out = scored(m, out).withColumnRenamed("p", f"_p{i}").drop("pred")
        ps = [F.col(f"_p{i}") for i in range(len(self.models))]
        return out.withColumn("features", F.array(*ps)).drop(*[f"_p{i}" for i in range(len(self.models))])

    def scored(self, df: DataFrame) -> DataFrame:
        return scored(self.meta, self._scores(df))


def evaluated(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All binary metrics of rows (y, p, pred), per key."""
    out = metrics.binary(predictions, keys=keys)
    parts = [metrics.areas(predictions, keys=keys), metrics.ece(predictions, keys=keys)]
    for part in parts:
        out = out.join(part, list(keys)) if keys else out.crossJoin(F.broadcast(part))
    return out


def out_of_fold(name: str, df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Scores of each row by a head that didn't see its group."""
    from textloom.operators import rank

    placed = df.join(rank.folds(df, key, k, seed), key)
    parts = []
    for fold in range(k):
        train, rest = rank.complement(placed, fold)
        parts.append(scored(fit(name, train, seed), rest))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SUMMARY = "head string, seed long, language string, done boolean, error string, metrics map<string, double>"


def sweep(train: DataFrame, test: DataFrame, names: Iterable[str], seeds: Iterable[int], path: str | None = None, languages: Iterable[str | None] = (None,)) -> tuple[list[dict], list[dict]]:
    """A run per head, seed and language (None: all) on matrices that are built once: (results, failures).

    A run that fails doesn't stop the rest. With a path, each run's row is appended to the summary there as soon as it is
    known, and runs that the summary has as done aren't made again: a sweep that broke off goes on where it was.
    """
    spark = train.sparkSession
    known = {}
    if path and exists(spark, f"{path}/_SUCCESS"):
        known = {(r["head"], r.seed, r.language): r.metrics for r in spark.read.schema(SUMMARY).parquet(path).where("done").collect()}  # a row per run
    train, test = train.persist(), test.persist()
    results, failures = [], []
    try:
        for name, seed, language in itertools.product(names, seeds, languages):
            about = {"head": name, "seed": seed} | ({"language": language} if language else {})
            if (name, seed, language) in known:
                results.append(about | known[name, seed, language])
                continue
            metrics_, error = None, None
            try:
                own = [x if language is None else x.where(F.col("language") == language) for x in (train, test)]
                row = evaluated(scored(fit(name, own[0], seed), own[1])).first().asDict()
                metrics_ = {k: float(v) for k, v in row.items() if v is not None}
                results.append(about | row)
            except Exception as failed:  # noqa: BLE001  a failed run is a row of the report
                error = str(failed)[:500]
                failures.append(about | {"error": error})
            if path:
                spark.createDataFrame([(name, seed, language, error is None, error, metrics_)], SUMMARY).coalesce(1).write.mode("append").parquet(path)
    finally:
        train.unpersist()
        test.unpersist()
    return results, failures


def run(name: str, train: DataFrame, val: DataFrame, test: DataFrame, out: str, seed: int = 42) -> dict[str, DataFrame]:
    """One head's run, with its outputs under out: the model, metrics of both held-out sets over all rows and per language,
    and the predictions of the test rows (pair_id, language, y, features)."""
    model = fit(name, train, seed)
    saved(model, f"{out}/model", {"head": name, "seed": seed})
    scores = {"val": scored(model, val), "test": scored(model, test)}
    reports = []
    for split, rows in scores.items():
        reports.append(evaluated(rows).withColumn("language", F.lit(None).cast("string")).withColumn("split", F.lit(split)))
        reports.append(evaluated(metrics.by_language(rows), ("language",)).withColumn("split", F.lit(split)))
    report = functools.reduce(lambda a, b: a.unionByName(b), reports)
    sinks.report(report, f"{out}/metrics")
    return {"metrics": train.sparkSession.read.schema(report.schema).json(f"{out}/metrics"), "predictions": sinks.predictions(scores["test"], f"{out}/predictions")}


def loaded(path: str) -> tuple[Model, dict]:
    """A saved model, and what was said about it."""
    spark = SparkSession.active()
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    if about.get("kind") in OWN:
        return OWN[about["kind"]].from_json(spark.read.text(f"{path}/model").first().value), about
    kind = json.loads(spark.read.text(f"{path}/metadata").first().value)["class"].rsplit(".", 1)[1]
    return getattr(C, kind).load(path), about


def inferred(model: Model, fitted: DataFrame, pairs: DataFrame, structure: DataFrame, logits: DataFrame, similarity: DataFrame, counted: Iterable[int] = (), n_ast: int = 84, n_logits: int = 11) -> DataFrame:
    """Scores of pairs from their raw parts: features are joined, counts among them (by place) go through log1p, all are scaled
    by what `fitted`, one row of arrays mean and scale, says, and the head scores them."""
    counted = list(counted)
    rows = pairs_.feature_matrix(pairs, structure, logits, similarity, n_ast, n_logits)
    places = F.sequence(F.lit(0), F.size("features") - 1)
    logged = F.zip_with("features", places, lambda x, i: F.when(i.isin(counted), F.signum(x) * F.log1p(F.abs(x))).otherwise(x) if counted else x)
    rows = rows.withColumn("features", logged.cast("array<double>")).crossJoin(F.broadcast(fitted.select(F.col("mean").alias("_mean"), F.col("scale").alias("_scale"))))  # one row
    whole = F.zip_with(F.zip_with("features", "_mean", lambda x, m: x - m), "_scale", lambda x, s: x / s)
    return scored(model, rows.withColumn("features", whole).drop("_mean", "_scale"))


def recipes(train: DataFrame, test: DataFrame, grid: list[dict], out: str, seed: int = 42) -> DataFrame:
    """A run per recipe {name, head, params}, the rows of which are under out/name; recipes whose folder is finished are skipped.

    A recipe's row is written last, and whole or not at all, so a sweep that broke off trains again only what wasn't done.
    """
    spark = train.sparkSession
    for recipe in grid:
        place = f"{out}/{recipe['name']}"
        if exists(spark, f"{place}/_SUCCESS"):
            continue
        model = fit(recipe["head"], train, seed, recipe.get("params"))
        row = evaluated(scored(model, test)).withColumns({"recipe": F.lit(recipe["name"]), "head": F.lit(recipe["head"])})
        row.coalesce(1).write.mode("overwrite").parquet(place)
    return spark.read.parquet(*[f"{out}/{r['name']}" for r in grid])


def search(name: str, train: DataFrame, grid: dict[str, list], folds: int = 3, seed: int = 42) -> Model:
    """The best of a grid of parameters by cross-validated area under the curve."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    estimator, builder = HEADS[name](seed), ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(estimator.getParam(p), values)
    validator = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=folds, seed=seed)
    return validator.fit(weighted(train).withColumn("y", F.col("y").cast("double"))).bestModel


def searched(name: str, train: DataFrame, val: DataFrame, grid: dict[str, list], out: str, seed: int = 42) -> DataFrame:
    """search() over a fixed validation set that goes on where it broke off: a row per point of the grid, best area first."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    named = [{"name": "-".join(f"{k}={v}" for k, v in p.items()), "head": name, "params": p} for p in points]
    return recipes(train, val, named, out, seed).orderBy(F.desc("roc_auc"), "recipe")


def saved(model: Model | trees.Model | perceptron.Model, path: str, about: dict) -> None:
    kind = next((k for k, own in OWN.items() if isinstance(model, own)), None)
    if kind:
        about = about | {"kind": kind}
        SparkSession.active().createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    else:
        model.write().overwrite().save(path)
    SparkSession.active().createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
