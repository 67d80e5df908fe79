"""Grouped fits: the same scores as a fit alone, keys too large for a task, failures, folds that don't see their group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.plans import grouped, trees
from test_trees import made


def table(spark, n=240):
    x, y = made(n, 4, 1)
    rows = [(i, "ab"[i % 2], i // 4, x[i].tolist(), int(y[i])) for i in range(n)]
    rows += [(1000 + i, "c", 900 + i, [0.0, 1.0, None, float("nan")], 1) for i in range(6)] + [(2000, None, 999, [1.0] * 4, None)]
    return spark.createDataFrame(rows, "id long, language string, problem long, features array<double>, y int").repartition(3), x, y


PARAMS = {"lgbm": {"rounds": 4, "leaves": 4}, "mlp": {"width": 4, "epochs": 2}}


def test_swept_scores_are_those_of_a_fit_alone(spark):
    df, x, y = table(spark)
    rows = df.withColumn("held", F.col("id") % 3 == 0)
    found = grouped.fitted(rows, ["language"], ["logreg", "lgbm", "none"], [1, 2], PARAMS).collect()
    assert {(r.language, r.head) for r in found if r.error} == {(lang, "none") for lang in "ab"}  # one class needs no head
    ids = np.arange(len(y))
    for lang, k in (("a", 0), ("b", 1)):
        own, held = ids[(ids % 2 == k) & (ids % 3 > 0)], ids[(ids % 2 == k) & (ids % 3 == 0)]
        for head in ("logreg", "lgbm"):
            want = grouped.scores(head, 1, PARAMS.get(head, {}), x[own], y[own], x[held])
            got = {r.id: r.p for r in found if (r.language, r.head, r.seed) == (lang, head, 1)}
            assert sorted(got) == held.tolist() and np.allclose([got[i] for i in held], want)
    assert {r.p for r in found if r.language == "c" and r.head != "none"} == {1.0}
    test = df.where("id % 3 = 0 and language <> 'c'")
    out = grouped.swept(df.where("id % 3 > 0 and language <> 'c'"), test, ["logreg", "mlp"], [1], params=PARAMS).collect()
    assert sorted((r.language, r["head"], r.n) for r in out) == [(lang, h, 40) for lang in "ab" for h in ("logreg", "mlp")]


def test_large_keys_are_fitted_by_spark(spark):
    df, _, _ = table(spark, 120)
    rows = df.where("language = 'a' or (language = 'b' and id < 40)").withColumn("held", F.col("id") % 3 == 0)
    small = {(r.language, r.id): r.p for r in grouped.fitted(rows, ["language"], ["lgbm"], [1], PARAMS).collect()}
    large = {(r.language, r.id): r.p for r in grouped.fitted(rows, ["language"], ["lgbm"], [1], PARAMS, most=1500).collect()}
    assert small.keys() == large.keys() and max(abs(small[k] - large[k]) for k in small) < 1e-9


def test_failures_are_no_results(spark):
    df, _, _ = table(spark, 60)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    failing = [(train, ["logreg", "none"], "no head none"), (train.where("language = 'b'"), ["logreg"], "no rows to fit")]
    huge = train.withColumn("features", F.expr("transform(features, x -> x * 1e300)"))
    failing += [(huge, ["logreg"], "finite|ingular"), (train.withColumn("features", F.slice("features", 1, F.when(F.col("id") == 1, 3).otherwise(4))), ["logreg"], "another length")]
    for rows, names, why in failing:
        with pytest.raises(Exception, match=why):
            grouped.swept(rows.where("language <> 'c'"), test.where("language <> 'c'"), names, [1]).collect()
    found = grouped.fitted(df.withColumn("held", F.lit(True)), ["language"], ["logreg"], [1]).collect()
    assert {(r.language, r.p, r.error) for r in found} == {(lang, None, "no rows to fit") for lang in "abc"}


def test_out_of_fold(spark):
    df, x, y = table(spark)
    out = grouped.out_of_fold(df.where("y is not null"), "problem", 4, ["logreg"], [1]).collect()
    assert sorted(r.id for r in out) == sorted([*range(240), *range(1000, 1006)])
    fold = {r.id: r.fold for r in out}
    assert all(len({fold[i] for i in range(4 * p, 4 * p + 4)}) == 1 for p in range(60)) and len(set(fold.values())) == 4
    own = [i for i in range(240) if i % 2 == 0 and fold[i] != 2]
    held = [i for i in range(240) if i % 2 == 0 and fold[i] == 2]
    got = {r.id: r.p for r in out}
    assert np.allclose([got[i] for i in held], grouped.scores("logreg", 1, {}, x[own], y[own], x[held]))


def test_logistic_is_the_least_point():
    x, y = made(200, 4, 2)
    weight = grouped.balanced(y)
    w = grouped.logistic(x, y, weight)
    p = trees.sigmoid(x @ w[:-1] + w[-1])
    assert np.abs(x.T @ (weight * (p - y)) + w[:-1]).max() < 1e-6 and abs((weight * (p - y)).sum()) < 1e-6


def peak(work) -> int:
    """Bytes held at once beside what was there, by Python and numpy."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_logistic_reads_rows_in_parts():
    x, y = made(100_000, 16, 5)
    weight = grouped.balanced(y)
    assert peak(lambda: grouped.logistic(x, y, weight)) < x.nbytes / 2


def test_matrices_hold_no_object_a_number():
    import pyarrow as pa

    want = np.arange(40_000 * 16, dtype=float).reshape(-1, 16)
    want[3, 5], want[7] = np.nan, np.nan
    rows = pa.array([None if i == 7 else [None if v != v else v for v in row] for i, row in enumerate(want.tolist())], pa.list_(pa.float64()))
    got = []
    assert peak(lambda: got.append(trees.matrix(rows, 16))) < 2 * want.nbytes
    assert np.array_equal(got[0], want, equal_nan=True)
    order = np.random.default_rng(1).permutation(len(want))
    assert peak(lambda: got.append(trees.matrix_in_order(pa.chunked_array([rows[:999], rows[999:]]), order))) < 2 * want.nbytes
    assert np.array_equal(got[1], want[order], equal_nan=True)
