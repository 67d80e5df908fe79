"""One pass to several folders: the same rows as several writes, all or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.sources import destinations


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_accepted_and_rejects_in_one_pass(spark, tmp_path):
    path, read = str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(0, 1000, numPartitions=4).mapInArrow(seen, "id long").withColumn("reject_reason", F.when(F.col("id") % 7 == 0, "seven"))
    destinations.accepted_and_rejects(rows, path)
    assert read.value == 1000  # each row is worked out once
    good, bad = (spark.read.parquet(f"{path}/{x}") for x in ("accepted", "rejects"))
    assert sorted(r.id for r in good.collect()) == [i for i in range(1000) if i % 7] and sorted(r.id for r in bad.collect()) == [i for i in range(1000) if i % 7 == 0]
    assert {r.reject_reason for r in bad.collect()} == {"seven"} and not any("staging" in f for f in files(path))
    destinations.accepted_and_rejects(rows.where("id < 10"), path)
    assert spark.read.parquet(f"{path}/accepted").count() == 8


def test_folders_are_a_partitioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 2 == 0, "x").alias("split"))
    destinations.by_folder(rows, path, ("split", "fold"))
    found = spark.read.parquet(path)
    assert found.where("fold = 2 and split = 'x'").count() == 50 and found.where("split is null").count() == 150 and found.count() == 300
    destinations.write(rows, str(tmp_path / "none"), F.lit(None))
    assert files(str(tmp_path / "none")) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    destinations.write(spark.range(10), path, F.lit("a"))
    before = files(path)
    with pytest.raises(Exception):
        destinations.write(spark.range(0, 100, numPartitions=4).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("bad"))).otherwise(F.lit("y"))), path, F.lit("a"))
    assert files(path) == before and spark.read.parquet(f"{path}/a").count() == 10
