"""The build graph: what is unchanged isn't run again, what broke goes on, what changed is made anew with what comes after it."""

import pytest
from pyspark.sql import functions as F

from textloom.plans.graph import Stage, build


def kept(rows, least):
    return rows.where(F.col("id") >= least)


def doubled(rows):
    return rows.select((F.col("id") * 2).alias("id"))


def both(a, b):
    return a.union(b)


def breaks(rows):
    raise RuntimeError("lost")


def stages(least=10, last=both):
    return [Stage("both", last, ("kept", "doubled")), Stage("kept", kept, ("ids",), {"least": least}), Stage("doubled", doubled, ("kept",)), Stage("alone", doubled, ("ids",))]


def test_only_what_changed_is_run(spark, tmp_path):
    source, path = str(tmp_path / "ids"), str(tmp_path / "build")
    spark.range(20).write.parquet(source)
    first = build(spark, stages(), {"ids": source}, path)
    assert sorted(first.ran) == ["alone", "both", "doubled", "kept"]
    assert sorted(r.id for r in first.rows("both").collect()) == sorted([*range(10, 20), *range(20, 40, 2)])
    assert build(spark, stages(), {"ids": source}, path).ran == []
    assert sorted(build(spark, stages(least=15), {"ids": source}, path).ran) == ["both", "doubled", "kept"]
    assert build(spark, stages(), {"ids": source}, path).ran == []  # the former rows are still there
    spark.range(5).write.mode("append").parquet(source)
    assert sorted(build(spark, stages(), {"ids": source}, path, ["doubled"]).ran) == ["doubled", "kept"]


def test_a_broken_build_goes_on(spark, tmp_path):
    source, path = str(tmp_path / "ids"), str(tmp_path / "build")
    spark.range(20).write.parquet(source)
    with pytest.raises(RuntimeError):
        build(spark, [*stages()[1:3], Stage("both", breaks, ("doubled",))], {"ids": source}, path)
    out = build(spark, [*stages()[1:3], Stage("both", doubled, ("doubled",))], {"ids": source}, path)
    assert out.ran == ["both"] and out.rows("both").count() == 10
    with pytest.raises(ValueError):
        build(spark, [*stages(), Stage("ids", doubled)], {"ids": source}, path)
