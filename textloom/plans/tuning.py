"""Search of parameters: Parzen estimators over finished trials, a median pruner, and a table of trials that a broken search goes on from.

A trial is fitted by Spark; what is kept of it is a row of its parameters and value, and a row for each value it reported on its way. New
parameters come from the finished trials: the best quarter and the others each make a density per parameter, and of some
draws from the former the one is taken where the ratio of both is largest. A trial stops when its value at a step is below the median of
what finished trials had there.

Each trial draws from a seed of its own number, so a search that goes on suggests what it would have suggested. A trial that broke off leaves
no row, and is made again under its number; one that fails is a row with its error, and isn't.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans import heads
from textloom.sources.readers import exists

TRIALS = "trial int, params string, state string, value double, error string"
STEPS = "trial int, step int, value double"


@dataclass(frozen=True)
class Between:
    """A number of a range; log: even on a logarithmic scale; whole: an integer."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def scaled(self, x: float) -> float:
        a, b, x = (math.log(v) if self.log else float(v) for v in (self.low, self.high, x))
        return (x - a) / (b - a) if b > a else 0.0

    def plain(self, u: float) -> float:
        a, b = (math.log(v) if self.log else float(v) for v in (self.low, self.high))
        x = a + min(max(u, 0.0), 1.0) * (b - a)
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return round(x) if self.whole else x

    def suggested(self, good: list, bad: list, random: np.random.Generator, draws: int) -> float:
        near, far = ([self.scaled(v) for v in x] for x in (good, bad))
        if not near:
            return self.plain(random.random())
        wide = max(0.05, 1.0 / (1 + len(near)))
        picks = np.append(random.choice(near, draws) + wide * random.normal(size=draws), random.random(max(1, draws // 4)))
        picks = np.clip(picks, 0, 1)

        def density(points: list[float]) -> np.ndarray:
            """Bells around the points, and an even share for what none of them is near."""
            own = np.array(points)[None, :]
            bells = np.exp(-(((picks[:, None] - own) / wide) ** 2) / 2) / (wide * math.sqrt(2 * math.pi)) if len(points) else np.zeros((len(picks), 0))
            return (bells.sum(axis=1) + 1) / (len(points) + 1)

        return self.plain(float(picks[int(np.argmax(density(near) / density(far)))]))


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple

    def suggested(self, good: list, bad: list, random: np.random.Generator, draws: int):
        share = lambda x: np.array([x.count(v) + 1.0 for v in self.values]) / (len(x) + len(self.values))
        if not good:
            return self.values[int(random.integers(len(self.values)))]
        picks = random.choice(len(self.values), draws, p=share(good))
        return self.values[int(picks[int(np.argmax((share(good) / share(bad))[picks]))])]


Space = dict[str, Between | Choice]


def suggestion(space: Space, finished: list[tuple[dict, float]], number: int, seed: int = 42, first: int = 8, draws: int = 24) -> dict:
    """Parameters of the next trial. finished: parameters and values, larger ones better; at random until there are `first`."""
    random = np.random.default_rng([seed, number])
    ranked = sorted(finished, key=lambda x: -x[1])
    most = math.ceil(len(ranked) / 4) if len(ranked) >= first else 0
    good, bad = ranked[:most], ranked[most:]
    return {name: kind.suggested([p[name] for p, _ in good], [p[name] for p, _ in bad] if most else [], random, draws) for name, kind in space.items()}


def pruned(step: int, value: float, others: dict[int, dict[int, float]], least: int = 4) -> bool:
    """Whether a trial's value at a step is below the median of at least `least` finished trials there."""
    seen = [x[step] for x in others.values() if step in x]
    return len(seen) >= least and value < median(seen)


class Stopped(Exception):
    """Raised in a trial that isn't worth going on with."""


def tuned(spark: SparkSession, objective: Callable[[dict, Callable[[int, float], None]], float], space: Space, path: str, trials: int, seed: int = 42) -> DataFrame:
    """A row per trial, best first. objective(params, report) returns a value, larger ones better; it may report (step, value), and is stopped
    there by Stopped."""

    def read(name: str, schema: str) -> list:
        return spark.read.schema(schema).json(f"{path}/{name}").collect() if exists(spark, f"{path}/{name}/_SUCCESS") else []  # a few rows a trial

    done = {r.trial: r for r in read("trials", TRIALS)}
    ways: dict[int, dict[int, float]] = {}
    for r in read("steps", STEPS):
        if r.trial in done and done[r.trial].state == "done":
            ways.setdefault(r.trial, {})[r.step] = r.value
    finished = {n: (json.loads(r.params), r.value) for n, r in done.items() if r.state == "done"}
    for number in range(trials):
        if number in done:
            continue
        params = suggestion(space, [finished[n] for n in sorted(finished) if n < number], number, seed)
        way: dict[int, float] = {}

        def report(step: int, value: float, way: dict[int, float] = way) -> None:
            way[int(step)] = value = float(value)
            if pruned(int(step), value, ways):
                raise Stopped

        state, value, error = "done", None, None
        try:
            value = float(objective(params, report))
        except Stopped:
            state = "pruned"
        except Exception as failed:  # noqa: BLE001  a failed trial is a row
            state, error = "failed", str(failed)[:500]
        if way:
            spark.createDataFrame([(number, s, v) for s, v in way.items()], STEPS).coalesce(1).write.mode("append").json(f"{path}/steps")
        spark.createDataFrame([(number, json.dumps(params), state, value, error)], TRIALS).coalesce(1).write.mode("append").json(f"{path}/trials")
        if state == "done":
            finished[number], ways[number] = (params, value), way
    return spark.read.schema(TRIALS).json(f"{path}/trials").orderBy(F.desc_nulls_last("value"), "trial")


def tuned_head(name: str, train: DataFrame, val: DataFrame, space: Space, path: str, trials: int, seed: int = 42, fixed: dict | None = None) -> DataFrame:
    """tuned() for a head, by its area under the curve on val; trees report their validation loss every fourth round."""

    def objective(params: dict, report: Callable[[int, float], None]) -> float:
        watch = (lambda n, loss: report(n, -loss) if n % 4 == 0 else None) if name in heads.TREES else None
        model = heads.fit(name, train, seed, (fixed or {}) | params, val, watch)
        return heads.evaluated(heads.scored(model, val)).first().roc_auc

    return tuned(train.sparkSession, objective, space, path, trials, seed)
