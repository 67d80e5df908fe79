import json

from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.plans import heads, pipeline
from textloom.sources import readers, sinks
from textloom.streaming import incremental


def raw(spark):
    rows = []
    for i in range(30):
        names = " ".join(f"v{i}_{k} = {k}" for k in range(0))
        body = "".join(f"    y{i}{k} = x + {k * i}\n" for k in range(6))
        rows.append((("python"), f"def f{i}(x):\n    # Time: O(n)\n{body}    for i in range(x):\n        x = x + i\n    return x{names}\n", ["O(n)", "O(n^2)", "O(log n)", "bad"][i % 4], str(i // 2), i))
    return spark.createDataFrame(rows, "language string, code string, raw_complexity string, problem_id string, ord long").withColumn("source", F.lit("s")).withColumn("pre_label", F.lit(None).cast("string"))


def test_build(spark, tmp_path):
    out = pipeline.build(spark, [raw(spark)], str(tmp_path / "out"), pipeline.Settings(cap=20, ratio=1.0, pairs=5000))
    points = out["points"].collect()
    assert points and all("Time:" not in r.code for r in points) and {r.split for r in points} <= {"train", "val", "test"}
    assert out["leaks"].count() == 0 and out["rejects"].count() == 7
    assert out["pairs"].where("ternary not in ('same', 'A_faster')").count() == 0
    assert len({r.id for r in points}) == len(points)


def test_jsonl_strictness(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"language": "python", "code": "x"}\n{bad\n')
    path = str(tmp_path)
    assert len([r for r in readers.jsonl(spark, path).select("_bad", "language").collect() if r._bad is not None]) == 1
    assert [r.code for r in readers.jsonl(spark, path, bad="drop").select("code", "language").collect()] == ["x"]
    try:
        readers.jsonl(spark, path, bad="raise").collect()
        raise AssertionError("a bad line was read")
    except Exception as error:
        assert "a bad line was read" not in str(error)


def test_files_and_optional(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.RB").write_text("x")
    (tmp_path / "src/c.rs").write_text("fn main() {}")
    got = {(r.language, r.code) for r in readers.sources(spark, str(tmp_path / "src")).collect()}
    assert got == {("python", "x = 1\n"), ("rust", "fn main() {}")}
    assert readers.optional(spark, str(tmp_path / "none"), readers.RAW).count() == 0
    assert readers.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "src")]).endswith("src")


def test_resumed_append(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []

    def work(df):
        seen.append(df.count())
        return df

    assert sinks.resumed(spark.range(5), path, "id", work).count() == 5
    assert sinks.resumed(spark.range(8), path, "id", work).count() == 8
    assert seen == [5, 3]


def test_run_metrics(spark, tmp_path):
    for name, files in {"a": ("test_metrics.json", "config.json"), "b": ("config.json",)}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text(json.dumps({"macro_f1": 0.5, "accuracy": 0.6, "seed": 3}))
    assert [tuple(r) for r in readers.run_metrics(spark, str(tmp_path / "*")).select("run_dir", "macro_f1", "seed").collect()] == [("a", 0.5, 3)]


def test_separable_heads(spark):
    df = spark.range(400).select(F.col("id"), *[F.sin(F.col("id") * (i + 1.3)).alias(f"f{i}") for i in range(6)])
    df = df.select("id", (F.col("f0") + F.col("f1") > 0).cast("int").alias("y"), F.array(*[f"f{i}" for i in range(6)]).alias("features"))
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    results, failures = heads.sweep(train, test, ["logreg", "lgbm", "none"], [1])
    assert [r["head"] for r in results] == ["logreg", "lgbm"] and all(r["accuracy"] >= 0.7 for r in results)
    assert [f["head"] for f in failures] == ["none"]


def test_templates_and_bundle(spark):
    got = readers.templates(spark, {"python": {"O(n)": ["a", "b"]}, "go": {"O(1)": ["c"]}})
    assert sorted((r.language, r.pre_label, r.code) for r in got.collect()) == [("go", "O(1)", "c"), ("python", "O(n)", "a"), ("python", "O(n)", "b")]
    row = spark.range(1).select(V.bundle(F.sequence(F.lit(10), F.lit(15)), F.array(F.lit(1)), 8, 4, 1, 2, 0, 3, 4).alias("b")).first().b
    assert row.input_ids == [1, 10, 4, 11, 12, 13, 3, 2] and row.attention_mask == [1] * 8
    assert row.global_attention_mask == [0, 0, 1, 0, 0, 0, 1, 1] and row.token_type_ids == [0, 0, 2, 0, 0, 0, 1, 0]
    row = spark.range(1).select(V.bundle(F.sequence(F.lit(10), F.lit(11)), F.array().cast("array<int>"), 6, 4, 1, 2, 0, 3, 4).alias("b")).first().b
    assert row.input_ids == [1, 10, 11, 2, 0, 0] and row.attention_mask == [1, 1, 1, 1, 0, 0]


def test_a_broken_run_goes_on_after_its_last_chunk(spark, tmp_path):
    path, done = str(tmp_path / "chunks"), []

    def work(df):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(df.count())
        return df

    try:
        sinks.resumed(spark.range(40), path, "id", work, chunks=4)
        raise AssertionError("it went on")
    except RuntimeError:
        pass
    first = sum(done)
    assert 0 < first < 40 and spark.read.parquet(path).count() == first
    done.clear()
    done.append(0)
    seen = []
    assert sorted(r.id for r in sinks.resumed(spark.range(40), path, "id", lambda df: seen.append(df.count()) or df, chunks=4).collect()) == list(range(40))
    assert sum(seen) == 40 - first


def test_settings_of_a_file(spark, tmp_path):
    text = "a: 1  # one\nb: 2.5\nc: 'x # y'\nd: [1, two, true]\ne:\n  - p\n  - 3\nf:\n  g: null\n  h: no#comment\ni: 1e-4\nj: on time\n"
    assert readers.settings_file(text) == {"a": 1, "b": 2.5, "c": "x # y", "d": [1, "two", True], "e": ["p", 3], "f": {"g": None, "h": "no#comment"}, "i": 1e-4, "j": "on time"}
    assert readers.settings_file("") == {} and readers.settings_file("---\n# only\n") == {}
    for bad in ("a: {b: 1}", "a: |\n  text", "just words", "a: 1\n   b: 2", "- 1\n- 2"):
        try:
            readers.settings_file(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    (tmp_path / "s.yaml").write_text("epochs: 3\nunknown: 1\nrate:\n")
    assert readers.configured(spark, str(tmp_path / "s.yaml"), {"epochs": 1, "rate": 0.5, "name": "n"}, {"name": None, "epochs": 9}) == {"epochs": 9, "rate": 0.5, "name": "n"}


def test_order_of_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("b", "a"):
        (tmp_path / folder).mkdir()
        for name in ("1.jsonl", "0.jsonl"):
            (tmp_path / folder / name).write_text("".join(json.dumps({"code": f"{name[0]}{folder}{i}"}) + "\n" for i in range(3)))
    rows = readers.jsonl(spark, [str(tmp_path / "b"), str(tmp_path / "a")], bad="drop").select("code", "ord").collect()
    assert [r.code for r in sorted(rows, key=lambda r: r.ord)] == [f"{n}{f}{i}" for n in "01" for f in "ab" for i in range(3)]


def heads_table(spark, n=400):
    df = spark.range(n).select(F.col("id"), *[F.sin(F.col("id") * (i + 1.3)).alias(f"f{i}") for i in range(6)])
    return df.select("id", F.col("id").cast("string").alias("pair_id"), F.when(F.col("id") % 2 == 0, "go").otherwise("c").alias("language"), (F.col("f0") + F.col("f1") > 0).cast("int").alias("y"), F.array(*[f"f{i}" for i in range(6)]).alias("features"))


def test_sweep_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    df, path, made = heads_table(spark), str(tmp_path / "summary"), []
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    original = heads.fit
    monkeypatch.setattr(heads, "fit", lambda name, *rest, **more: made.append(name) or original(name, *rest, **more))
    first, failed = heads.sweep(train, test, ["logreg", "none"], [1], path)
    assert [r["head"] for r in first] == ["logreg"] and len(failed) == 1 and made == ["logreg", "none"]
    again, failed = heads.sweep(train, test, ["logreg", "none"], [1, 2], path, languages=[None, "go"])
    assert made[2:].count("logreg") == 3 and len(again) == 4 and len(failed) == 4
    assert abs(again[0]["accuracy"] - first[0]["accuracy"]) < 1e-12


def test_run_writes_its_outputs_and_recipes_are_skipped(spark, tmp_path, monkeypatch):
    df, out = heads_table(spark), str(tmp_path / "run")
    train, val, test = df.where("id % 4 > 1"), df.where("id % 4 = 1"), df.where("id % 4 = 0")
    got = heads.run("logreg", train, val, test, out)
    report = got["metrics"].collect()
    assert {(r.split, r.language) for r in report} == {("val", None), ("test", None), ("val", "c"), ("test", "go")} and all(r.accuracy > 0.9 for r in report)
    rows = got["predictions"].collect()
    assert len(rows) == test.count() and all(abs(r.prob_same + r.prob_A_faster - 1) < 1e-6 for r in rows)
    model, about = heads.loaded(f"{out}/model")
    assert about == {"head": "logreg", "seed": 42}
    assert sorted(r.pred for r in heads.scored(model, test).collect()) == sorted(r.label_pred for r in rows)
    made = []
    original = heads.fit
    monkeypatch.setattr(heads, "fit", lambda *a, **b: made.append(a) or original(*a, **b))
    grid = {"regParam": [0.0, 100.0]}
    first = heads.searched("logreg", train, val, grid, str(tmp_path / "grid")).collect()
    again = heads.searched("logreg", train, val, {"regParam": [0.0, 100.0, 0.1]}, str(tmp_path / "grid")).collect()
    assert len(made) == 3 and len(again) == 3 and first[0].roc_auc >= first[1].roc_auc and {r.recipe for r in first} == {"regParam=0.0", "regParam=100.0"}


def test_logreg_has_the_penalty_of_c_equal_to_one(spark):
    import numpy as np

    random = np.random.default_rng(0)
    x = random.normal(size=(80, 3)) * [1.0, 5.0, 0.2]
    y = (x[:, 0] + x[:, 1] / 5 + random.normal(size=80) > 0).astype(int)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "y int, features array<double>")
    model = heads.fit("logreg", df)
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    w = np.zeros(4)
    for _ in range(60):  # Newton steps on half the squared weights plus the summed losses
        z = np.c_[x, np.ones(80)]
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (weight * (p - y)) + np.append(w[:3], 0)
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 1e-9]), slope)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-3)


def test_pair_inference(spark):
    from textloom.operators import metrics

    n = 60
    pairs = spark.range(n).select(F.col("id").cast("string").alias("pair_id"), F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"), F.lit("go").alias("language"), F.when(F.col("id") % 2 == 0, "same").otherwise("A_faster").alias("ternary"))
    structure = spark.range(n).select(F.col("id").cast("string").alias("pair_id"), F.array((F.col("id") % 7 + 1).cast("double"), -(F.col("id") % 2).cast("double")).alias("ast"))
    logits = spark.range(n + 1).select(F.col("id"), F.array(F.sin("id"), F.cos("id")).alias("logits"))
    similarity = spark.range(n).select(F.col("id").cast("string").alias("pair_id"), *[F.lit(0.5).alias(c) for c in ("cls_cosine", "cls_l2", "cls_mean_abs_diff", "cls_max_abs_diff")])
    from textloom.operators import pairs as P

    raw = P.feature_matrix(pairs, structure, logits, similarity, 2, 2).select("pair_id", "y", F.col("features").cast("array<double>").alias("f"))
    wide = raw.select("pair_id", "y", *[F.col("f")[i].alias(f"c{i}") for i in range(14)]).withColumn("c0", F.log1p("c0"))
    fitted = metrics.scaler_arrays(metrics.scaler(wide, ["c0", "c2"]), [f"c{i}" for i in range(14)])
    scaled = metrics.scaled(wide, metrics.scaler(wide, ["c0", "c2"]), ["c0", "c2"])
    train = scaled.select("pair_id", "y", F.array(*[f"c{i}" for i in range(14)]).alias("features"))
    model = heads.fit("logreg", train)
    want = {r.pair_id: r.p for r in heads.scored(model, train).collect()}
    got = {r.pair_id: r.p for r in heads.inferred(model, fitted, pairs, structure, logits, similarity, counted=(0,), n_ast=2, n_logits=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_stream_resumes(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    row = {"language": "python", "code": "x = 1", "raw_complexity": "O(n)"}
    (folder / "1.json").write_text("\n".join(json.dumps(row) for _ in range(3)))
    incremental.run(spark, str(folder), out, check).awaitTermination()
    (folder / "2.json").write_text(json.dumps(row | {"code": "y = 2"}))
    incremental.run(spark, str(folder), out, check).awaitTermination()
    assert sorted((r.code, r.label) for r in spark.read.parquet(out).collect()) == [("x = 1", "O(n)"), ("y = 2", "O(n)")]
