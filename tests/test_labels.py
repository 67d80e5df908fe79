import pytest
from pyspark.sql import functions as F

from textloom.functions.labels import label_of, normalized
from textloom.functions.text import alias_label
from textloom.plans.adapters import RAWS
from textloom.schemas import LABELS, pair_label

QUIRKS = [
    ("e*m", "O(n^2)"), ("m log n", None), ("n log n", "O(n log n)"), ("n*k", "O(n)"), ("O(n+k)", "O(n)"), ("c^n", "exponential"), ("n * log(n", "O(n log n)"), ("V + E", "O(m+n)"), ("O(alpha(n))", "O(1)"),
    ("$O(3^n)$", "exponential"), ("O((n-1)!)", "exponential"), ("O(height * width)", "O(m*n)"), ("O(10)", "O(1)"), ("O(n × m).", "O(m*n)"), ("O(log_10 n)", "O(log n)"), ("O(n**2)", "O(n^2)"), ("  O( N )  ", "O(n)"), ("O(2n)", None),
]


def test_cases(spark):
    cases = list(RAWS) + QUIRKS
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string").select("i", label_of(F.col("r")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert [(cases[i], got[i]) for i in range(len(cases)) if got[i] != cases[i][1]] == []


def test_rejects_have_reasons_and_prelabels_stand(spark):
    df = spark.createDataFrame([("O(n)", None), ("", None), (None, None), ("O(a*b*c)", None), ("O(n)", "O(1)"), ("O(n)", "O(x)")], "raw_complexity string, pre_label string")
    got = [(r.label, r.reject_reason) for r in normalized(df, pre_column="pre_label").collect()]
    assert sorted(got, key=str) == sorted([("O(n)", None), (None, "missing"), (None, "missing"), (None, "no class fits"), ("O(1)", None), ("O(n)", None)], key=str)


def test_empty_table(spark):
    assert normalized(spark.createDataFrame([], "raw_complexity string")).count() == 0


@pytest.mark.parametrize("a,b,expected", [("O(n)", "O(m+n)", "same"), ("O(1)", "O(n)", "A_faster"), ("O(n^3)", "O(n)", "B_faster")])
def test_pair_label(spark, a, b, expected):
    assert spark.range(1).select(pair_label(F.lit(a), F.lit(b))).first()[0] == expected


def test_aliases(spark):
    df = spark.createDataFrame([("NP hard",), (" O(N log N) ",), ("x",), (None,)], "r string").select(alias_label(F.col("r")).alias("x"))
    assert [r.x for r in df.collect()] == ["exponential", "O(n log n)", None, None]
    assert len(LABELS) == 11
