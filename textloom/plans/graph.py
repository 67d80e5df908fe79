"""A build as a graph of stages, each with a key of what it comes from: stages that are unchanged aren't run again.

A stage's key is a hash of its function's code, its settings and the keys of what it reads; a source's key is a hash of its files' paths, sizes and times of
change. A stage's rows are under path/name-key, so a changed setting or function makes that stage anew, and those after it, and nothing
else; going back to former settings finds the former rows. A stage counts when Spark has marked its folder as written, so a build that broke off
goes on at the stage that it was at.

The code that counts is the stage's own function and what it names in `uses`; what those call in other modules doesn't.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.readers import exists


@dataclass(frozen=True)
class Stage:
    """function(inputs' rows in order, **settings) gives the stage's rows. reads: names of stages and sources."""

    name: str
    function: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    uses: tuple[Callable, ...] = ()


def hashed(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:20]


def source_key(spark: SparkSession, path: str) -> str:
    """Of the files under a path, without reading them. Hashes are summed, so that any number of files gives one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return hashed(path, str(row.n), str(row.h))


def stage_key(stage: Stage, keys: dict[str, str]) -> str:
    code = [inspect.getsource(f) for f in (stage.function, *stage.uses)]
    return hashed(stage.name, json.dumps(stage.settings, sort_keys=True), *code, *[keys[r] for r in stage.reads])


@dataclass
class Built:
    """Where each stage's rows are, and which stages this build ran."""

    spark: SparkSession
    places: dict[str, str]
    ran: list[str] = field(default_factory=list)

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.places[name])


def build(spark: SparkSession, stages: list[Stage], sources: dict[str, str], path: str, wanted: list[str] | None = None) -> Built:
    """Run what isn't there of the stages (or of those that `wanted` ones need). sources: Parquet tables by name."""
    by_name = {s.name: s for s in stages}
    if len(by_name) < len(stages) or by_name.keys() & sources.keys():
        raise ValueError("stages and sources need different names")
    needed, left = set(), list(wanted or by_name)
    while left:
        name = left.pop()
        if name not in needed and name not in sources:
            needed.add(name)
            left += by_name[name].reads
    order = TopologicalSorter({n: [r for r in by_name[n].reads if r in by_name] for n in sorted(needed)}).static_order()
    keys = {name: source_key(spark, place) for name, place in sources.items()}
    out = Built(spark, dict(sources))
    for name in order:
        stage = by_name[name]
        keys[name] = stage_key(stage, keys)
        out.places[name] = f"{path}/{name}-{keys[name]}"
        if exists(spark, f"{out.places[name]}/_SUCCESS"):
            continue
        rows = stage.function(*[out.rows(r) for r in stage.reads], **stage.settings)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(out.places[name])
        out.ran.append(name)
    return out
