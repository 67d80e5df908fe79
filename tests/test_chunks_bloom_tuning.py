"""Chunks with a manifest, Bloom filters ahead of joins, and the search of parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bloom
from textloom.plans import trees, tuning
from textloom.sources import chunks, sinks
from test_trees import frame, made


def test_a_chunk_reads_its_own_rows(spark, tmp_path):
    path, seen = str(tmp_path / "c"), []

    def work(df):
        seen.append((len(df.inputFiles()), sorted(r.id for r in df.collect())))
        return df.select("id", (F.col("id") * 2).alias("twice"))

    rows = spark.range(100).withColumn("text", F.lit("x" * 50))
    out = chunks.worked(rows, path, "id", work, 4)
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(100)]
    assert len(seen) == 4 and sorted(i for _, ids in seen for i in ids) == list(range(100))  # each row is read by one chunk
    found = chunks.manifest(spark, path).collect()
    assert [(r.read, r.written) for r in sorted(found)] == [(len(ids), len(ids)) for _, ids in seen]
    seen.clear()
    again = chunks.worked(rows.union(spark.range(100, 120).withColumn("text", F.lit(None))), path, "id", work, 4)
    assert again.count() == 120 and sorted(i for _, ids in seen for i in ids) == list(range(100, 120))


def test_a_broken_run_goes_on_with_other_chunks(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def breaks(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return df

    rows = spark.range(60).union(spark.range(5)).union(spark.createDataFrame([(None,)], "id long"))
    with pytest.raises(RuntimeError):
        sinks.resumed(rows, path, "id", breaks, chunks=5)
    assert chunks.manifest(spark, path).count() == 2
    left = []
    out = sinks.resumed(rows, path, "id", lambda df: left.append(df.count()) or df, chunks=2)
    assert sorted(r.id for r in out.collect()) == list(range(60)) and len(left) == 3
    assert sinks.resumed(spark.range(0), str(tmp_path / "none"), "id", lambda df: df).count() == 0


def test_bloom_joins_are_exact(spark):
    a = spark.createDataFrame([(i % 400 if i % 7 else None, str(i % 3), i) for i in range(900)], "k long, s string, n long").repartition(3)
    b = spark.createDataFrame([(i, "1") for i in range(0, 500, 5)] + [(None, "1")], "k long, s string").repartition(2)
    for keys in (["k"], ["k", "s"]):
        same = lambda x, y: sorted(map(str, x.select(*a.columns).collect())) == sorted(map(str, y.select(*a.columns).collect()))
        assert same(bloom.semi(a, b, keys), a.join(b.select(*keys), keys, "left_semi"))
        assert same(bloom.anti(a, b, keys), a.join(b.select(*keys), keys, "left_anti"))
    assert bloom.semi(a, b.limit(0), ["k"]).count() == 0 and bloom.anti(a, b.limit(0), ["k"]).count() == 900


def test_bloom_filter_lets_little_through_and_merges(spark):
    keys, others = spark.range(20_000), spark.range(1_000_000, 1_050_000)
    found = bloom.built(keys, ["id"])
    assert keys.where(bloom.may_have(keys, ["id"], found)).count() == 20_000
    assert others.where(bloom.may_have(others, ["id"], found)).count() < 500
    halves = [bloom.built(keys.where(f"id % 2 = {i}"), ["id"], len(found.field) * 8).field for i in (0, 1)]
    assert (halves[0] | halves[1] == found.field).all()


SPACE = {"x": tuning.Between(0, 1), "rate": tuning.Between(1e-4, 1.0, log=True), "n": tuning.Between(1, 9, whole=True), "kind": tuning.Choice(("a", "b", "c"))}


def worth(p):
    return -((p["x"] - 0.3) ** 2) - (np.log10(p["rate"]) + 2) ** 2 / 8 - (p["n"] - 4) ** 2 / 100 - 0.3 * (p["kind"] != "b")


def test_suggestions_are_better_than_chance():
    own, chance = [], []
    for seed in range(12):
        for out, first in ((own, 8), (chance, 1000)):
            done = []
            for number in range(40):
                p = tuning.suggestion(SPACE, done, number, seed, first)
                assert 0 <= p["x"] <= 1 and 1e-4 <= p["rate"] <= 1 and p["n"] in range(1, 10) and p["kind"] in "abc"
                done.append((p, worth(p)))
            out.append(max(v for _, v in done))
    assert np.mean(own) > np.mean(chance) and np.median(own) > np.median(chance)


def test_a_broken_search_goes_on(spark, tmp_path):
    calls = []

    def objective(params, report):
        calls.append(params)
        if len(calls) == 4:
            raise KeyboardInterrupt  # the driver is gone
        if len(calls) == 3:
            raise ValueError("a bad fit")
        for step in range(3):
            report(step, worth(params) + step)
        return worth(params)

    path = str(tmp_path / "t")
    with pytest.raises(KeyboardInterrupt):
        tuning.tuned(spark, objective, SPACE, path, 6)
    out = tuning.tuned(spark, objective, SPACE, path, 6).collect()
    assert sorted(r.trial for r in out) == list(range(6)) and [r.state for r in out].count("failed") == 1 and len(calls) == 7
    assert calls[4] == calls[3] and [r.value for r in out if r.value is not None] == sorted((r.value for r in out if r.value is not None), reverse=True)


def test_pruner_and_heads(spark, tmp_path):
    ways = {i: {0: float(i), 1: 2.0 * i} for i in range(5)}
    assert tuning.pruned(0, 1.9, ways) and not tuning.pruned(0, 2.0, ways) and not tuning.pruned(5, -9.0, ways) and not tuning.pruned(0, -9.0, {0: {0: 1.0}})
    x, y = made(200, 4, 1)
    other, truth = made(150, 4, 2)
    space = {"leaves": tuning.Between(2, 6, whole=True), "rate": tuning.Between(0.05, 0.5, log=True)}
    out = tuning.tuned_head("lgbm", frame(spark, x, y), frame(spark, other, truth), space, str(tmp_path / "h"), 2, fixed={"rounds": 5, "least_rows": 5})
    assert [r.state for r in out.collect()] == ["done", "done"] and out.first().value > 0.6
    assert isinstance(trees.LEAFWISE, trees.Settings)
