import pytest
from pyspark.sql import functions as F

from textloom.operators import augment, counts, dedup, metrics, pairs, rank, select
from textloom.schemas import LABELS


def labelled(spark, n=400):
    names = F.array(*map(F.lit, LABELS))
    df = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.format_string("code %d i x", "id").alias("code"), F.when(F.col("id") % 3 == 0, "java").otherwise("python").alias("language"))
    return df.withColumns({"label": F.element_at(names, (F.col("ord") % 11).cast("int") + 1), "problem_id": F.expr("cast(ord div 3 as string)"), "tokens": F.lit(3), "source": F.lit("s")})


@pytest.mark.parametrize("n,expected", [(1, (0, 0, 1)), (2, (1, 0, 1)), (5, (4, 0, 1)), (9, (7, 0, 2)), (10, (8, 1, 1))])
def test_split_sizes(spark, n, expected):
    df = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("problem_id"), F.lit("python").alias("language"), F.lit("O(n)").alias("label"))
    got = {r.split: r["count"] for r in rank.stratified_split(df).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == expected


def test_split_keeps_groups_and_repeats(spark):
    rows = rank.assigned(labelled(spark), rank.stratified_split(labelled(spark)))
    assert rows.groupBy("problem_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert rows.count() == 400
    assert sorted(rank.stratified_split(labelled(spark)).collect()) == sorted(rank.stratified_split(labelled(spark).repartition(7)).collect())


def test_folds(spark):
    df = labelled(spark, 60)
    got = rank.folds(df, "problem_id", 4, 1)
    assert [r["count"] for r in got.groupBy("fold").count().orderBy("fold").collect()] == [5, 5, 5, 5]
    assert got.select("problem_id").distinct().count() == got.count() == 20
    assert sorted(got.collect()) != sorted(rank.folds(df, "problem_id", 4, 2).collect())
    train, held = rank.complement(df.join(got, "problem_id"), 2)
    assert train.count() + held.count() == 60
    with pytest.raises(ValueError):
        rank.folds(df, "problem_id", 1, 1)


def test_carve(spark):
    df = spark.range(100).select(F.lit("x").alias("g"), F.col("id").cast("string").alias("k"))
    assert rank.carved(df, ["g"], "k", 0.1, 1).where("carved").count() == 10
    assert rank.carved(df.limit(3), ["g"], "k", 0.1, 1).where("carved").count() == 1


def test_numbered_is_dense_and_ordered(spark):
    got = rank.numbered(spark.range(1000).repartition(7), ["id"], "n", "p%07d").orderBy("id").collect()
    assert [r.n for r in got] == [f"p{i:07d}" for i in range(1000)]


def test_draws_follow_weights(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, w double")
    got = {r.k: r["count"] for r in rank.drawn(df, "k", "w", 2000, 5).groupBy("k").count().collect()}
    assert sum(got.values()) == 2000 and "c" not in got and 0.70 < got["b"] / 2000 < 0.80


def test_greedy_keeps_what_isn_t_linked_to_a_kept_row(spark):
    # a~b in one band, b~c in another, a and c share none: b goes, c stays
    banded = spark.createDataFrame([(1, "x", 0, 10), (1, "x", 1, 11), (2, "x", 0, 10), (2, "x", 1, 22), (3, "x", 0, 33), (3, "x", 1, 22), (4, "y", 0, 10), (4, "y", 1, 22)], "ord long, language string, band int, key long")
    assert sorted(r.ord for r in dedup.greedy(banded).collect()) == [1, 3, 4]


def test_greedy_against_loop(spark):
    import random

    random.seed(2)
    rows = [(i, "x", b, random.randint(0, 30)) for i in range(80) for b in range(2)]
    kept, buckets = [], set()
    for i in range(80):
        own = {(b, k) for j, _, b, k in rows if j == i}
        if not own & buckets:
            kept.append(i)
            buckets |= own
    assert sorted(r.ord for r in dedup.greedy(spark.createDataFrame(rows, "ord long, language string, band int, key long")).collect()) == kept


def test_near_drops_copies_and_short_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, "p", long), (2, "p", long), (3, "q", long), (4, "p", "too short"), (5, "p", " ".join(f"v{i}" for i in range(60))), (6, "p", None)], "ord long, language string, code string")
    assert sorted(r.ord for r in dedup.near(df).collect()) == [1, 3, 5]


def test_top_up(spark):
    df = labelled(spark, 44)
    out = augment.topped_up(df, cap=3, ratio=4.0)
    sizes = {(r.language, r.label): r["count"] for r in out.groupBy("language", "label").count().collect()}
    assert max(sizes.values()) <= 3
    new = out.where("augmented_from is not null")
    assert new.count() > 0 and new.where("source <> 's-aug'").count() == 0
    assert out.groupBy("language", "label", "code_sha256").count().where("count > 1").count() == 0


def test_pairs(spark):
    rows = rank.assigned(labelled(spark), rank.stratified_split(labelled(spark)))
    same = pairs.same_problem(rows)
    expected = sum(n * (n - 1) // 2 for (n,) in rows.groupBy("split", "language", "problem_id").count().select("count").collect())
    assert same.count() == expected and same.where("ternary = 'B_faster'").count() == 0
    cross = pairs.cross_label(rows, 20_000)
    assert cross.where("ternary = 'B_faster'").count() == 0
    quota = {(r.split, r.language): r.quota for r in pairs.quotas(rows, 20_000).collect()}
    cells = cross.groupBy("split", "language", F.least("label_a", "label_b").alias("x"), F.greatest("label_a", "label_b").alias("y")).count().collect()
    assert cells and all(r["count"] <= quota[(r.split, r.language)] for r in cells)
    assert cross.join(rows.select(F.col("ord").alias("ord_a"), F.col("problem_id").alias("pa")), "ord_a").join(rows.select(F.col("ord").alias("ord_b"), F.col("problem_id").alias("pb")), "ord_b").where("pa = pb").count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(1,)] * 20 + [(0,)] * 80, "y int")
    assert {r.y: r.weight for r in counts.balanced_weights(df, "y").collect()} == {0: 0.625, 1: 2.5}
    assert [r.weight for r in counts.balanced_weights(df.where("y = 1"), "y").collect()] == [1.0]
    assert counts.imbalance(df, "y").first().warn and not counts.imbalance(spark.createDataFrame([(0,), (1,)], "y int"), "y").first().warn


def test_metrics_of_one_class_and_empty(spark):
    one = spark.createDataFrame([(1, 1, 0.9)], "y int, pred int, p double")
    assert metrics.areas(one).first().roc_auc is None and metrics.binary(one).first().brier_score is None
    assert metrics.per_class(spark.createDataFrame([], "label string, pred string")).count() == 11


def test_weighted_headline(spark):
    best = spark.createDataFrame([("python", 0.9, 0.9, 100), ("ruby", 0.8, 0.8, 20)], "language string, test_acc double, macro_f1 double, n_test long")
    assert round(select.headline(best).first().test_acc, 3) == 0.883


def test_early_stop(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, 0.5, 0.5, 0.4, 0.3, 0.9])], "k string, step long, v double")
    row = metrics.early_stop(df, "k", "step", "v", 3, 0.0).first()
    assert (row.best_step, row.best_value, row.stop_step) == (1, 0.5, 4)


def test_similar_finds_all_pairs(spark):
    import numpy as np

    random = np.random.default_rng(4)
    rows = []
    for i in range(40):
        own = [f"w{k}" for k in random.integers(0, 500, 30)]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(["a", *own])), (3 * i + 2, " ".join([*own[:-6], *(f"z{k}" for k in random.integers(0, 500, 6))]))]
    sets = [(o, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for o, t in rows for w in [t.split()]]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= 0.5 * len(x | y)}
    df = spark.createDataFrame(rows, "ord long, code string")
    assert {(r.a, r.b) for r in dedup.similar(df, 0.5).collect()} == want


def test_similar_by_tiles_finds_the_same(spark, monkeypatch):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(i, base if not i else f"{base} {' '.join(f'x{i}y{k}' for k in range(i))}") for i in range(30)] + [(100, "a b c d"), (101, None)]
    df = spark.createDataFrame(rows, "ord long, code string")
    plain = sorted(map(tuple, dedup.similar(df, 0.6, most=4).collect()))
    monkeypatch.setattr(dedup, "MANY", 1)
    assert sorted(map(tuple, dedup.similar(df, 0.6, most=4).collect())) == plain
    assert len(plain) == sum(36 >= 0.6 * (36 + a + b) - 1e-9 for b in range(30) for a in range(b))


def test_similar_moves_prefixes_only(spark):
    """Shuffled bytes of a table without pairs: no more than 20 a shingle, its set among them."""
    import random

    draw = random.Random(3)
    rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(404))) for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, code string")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    assert dedup.similar(df, 0.5).collect() == []
    assert moved() - before < 20 * 400 * 400


def test_similar_moves_sets_once_for_many_pairs(spark):
    """Shuffled bytes of a group of near copies: no more than six times their sets, though a set is in 39 pairs."""
    import random

    draw, n = random.Random(5), 40
    base, rows = [f"w{draw.randrange(10**6)}" for _ in range(5004)], []
    for i in range(n):
        at = draw.randrange(5004)
        rows.append((i - 50, " ".join([*base[:at], f"own{i}", *base[at + 1 :]])))
    df = spark.createDataFrame(rows, "ord long, code string").repartition(4)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables that are too large to go to all tasks
    try:
        found = {(r.a, r.b): r.similarity for r in dedup.similar(df, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved() - before < 6 * n * 5000 * 8
    sets = {o: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for o, t in rows for w in [t.split()]}
    assert found == {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b}


def test_bands_agree_as_often_as_sets_are_alike(spark):
    import numpy as np

    random, rows = np.random.default_rng(6), []
    for i in range(60):
        own = [f"w{k}" for k in random.integers(0, 10_000, 400)]
        rows += [(2 * i, "x", " ".join(own)), (2 * i + 1, "x", " ".join([*own[:390], *(f"z{k}" for k in random.integers(0, 10_000, 10))]))]
    keys = {}
    for r in dedup.bands(spark.createDataFrame(rows, "ord long, language string, code string"), most=1000).collect():
        keys.setdefault(r.ord, {})[r.band] = r.key
    agree = np.mean([keys[2 * i][b] == keys[2 * i + 1][b] for i in range(60) for b in range(dedup.BANDS)])
    alike = 386 / 406  # runs of five words that both have, of all
    assert abs(agree - alike**dedup.ROWS) < 0.1


def test_ema_over_many_blocks(spark):
    import random

    random.seed(7)
    rows = [(k, i, random.choice([0.0, 1e6, -3.0, random.random()])) for k, n in (("a", 700), (None, 65), ("b", 1), ("c", 128)) for i in range(n)]
    want = {}
    for k, i, v in rows:
        want[k, i] = v if i == 0 else 0.3 * v + 0.7 * want[k, i - 1]
    got = {(r.k, r.i): r.ema for r in metrics.ema(spark.createDataFrame(rows, "k string, i long, v double").repartition(5), "k", "i", "v", 0.3, 16).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 1e-9 * max(1, abs(want[x])) for x in want)


def test_renames_to_reserved_words_go(spark):
    from textloom.functions.text import RESERVED, allowed

    assert allowed({"ans": "final", "i": "p"}, "java") == {"i": "p"} == allowed({"ans": "final", "i": "p"}, "php")
    assert allowed({"f": "func", "x": "range"}, "go") == {} and allowed({"f": "func"}, "python") == {"f": "func"}
    assert allowed({"a": "match", "b": "out"}, "csharp") == {"a": "match"} and len(RESERVED) == 12
    df = spark.createDataFrame([("java", "int ans = i;", "s"), ("python", "ans = i", "s")], "language string, code string, source string")
    got = {(r.language, r.code) for r in augment.renames(df, ({"ans": "final"}, {"ans": "final", "i": "p"})).collect()}
    assert got == {("java", "int ans = p;"), ("python", "final = i"), ("python", "final = p")}


def test_templates_expand_without_broken_variants(spark):
    import hashlib

    from textloom.functions import code as K

    codes = {"python": ["def f(path, a):\n    i = path[a]\n    return i\n", "def broken(:"], "go": ["package p\nfunc f(a int) int { return a }\n"]}
    rows = [(x, "O(n)", f"{x}|O(n)#{i}", c) for x, own in codes.items() for i, c in enumerate(own)]
    out = augment.expanded(spark.createDataFrame(rows, "language string, pre_label string, template string, code string"), valid=K.valid).collect()
    assert {r.template for r in out} == {"python|O(n)#0", "go|O(n)#0"} and len(out) == 16
    by = {(r.template, r.variant): r for r in out}
    assert by["python|O(n)#0", 0].code == codes["python"][0] and by["python|O(n)#0", 7].code == codes["python"][0].replace("path", "trail")
    assert by["python|O(n)#0", 4].code == "def f(path, xs):\n    i = path[xs]\n    return i\n" and by["python|O(n)#0", 1].code.count("p = path") == 1
    r = by["go|O(n)#0", 4]
    assert (r.problem_id, r.source, r.solution_idx, r.raw_complexity) == ("syn-" + hashlib.sha1(f"go|{r.code}".encode()).hexdigest()[:12], "synthetic", 4, "O(n)")


def test_long_blocks_of_markdown(spark):
    from textloom.functions import text as X

    body = "word " * 60_000
    df = spark.createDataFrame([(1, f"<!-- solution:start -->\n```python\n{body}\n```\n<!-- solution:end -->"), (2, f"```java\n{body}\n```"), (3, "<!-- solution:end --> <!-- solution:start --> a <!-- solution:start -->\n```go\nx\n```\n<!-- solution:end --> <!-- solution:start -->"), (4, None), (5, "")], "i int, document string")
    got = {(r.i, r.solution_idx, r.language, len(r.code)) for r in X.fenced(df, keep=("i",)).collect()}
    assert got == {(1, 0, "python", len(body) + 1), (2, 0, "java", len(body) + 1), (3, 0, "go", 2)}


def test_pairs_without_codes_move_no_texts(spark):
    rows = rank.assigned(labelled(spark), rank.stratified_split(labelled(spark)))
    plan = pairs.cross_label(rows, 20_000, codes=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "code" not in plan
    both = pairs.cross_label(rows, 20_000).select("ord_a", "code_a", "ord_b", "code_b").first()
    codes = {r.ord: r.code for r in rows.collect()}
    assert (both.code_a, both.code_b) == (codes[both.ord_a], codes[both.ord_b])
