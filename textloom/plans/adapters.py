"""The driver's tables as the views that the operators work on, in Spark and, with equal meaning, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.labels import normalized
from textloom.schemas import LABELS, TIERS, tier

#: Raw labels of our own and the class of each: every class, in several spellings, and every kind of reject (None).
RAWS = (
    ("O(4)", "O(1)"), ("  o( 1 ) ", "O(1)"), (r"$O(\log N)$", "O(log n)"), ("O(log2(n))", "O(log n)"), ("$O(N)$", "O(n)"), ("O(n + 12)", "O(n)"), ("O(3 * n).", "O(n)"),
    ("O(N log N)", "O(n log n)"), ("O(n·log n)", "O(n log n)"), (r"$O(m \log m)$ ", "O(n log n)"), ("O(N^2)", "O(n^2)"), ("$O(n^{2})$", "O(n^2)"), ("$O(N^{3})$", "O(n^3)"), ("O(q*q*q)", "O(n^3)"),
    ("$O(5^n)$", "exponential"), ("O((n-2)!)", "exponential"), ("$O(E + V)$", "O(m+n)"), ("O(rows + cols)", "O(m+n)"), ("O(width * height)", "O(m*n)"), (r"$O(p \cdot q)$", "O(m*n)"),
    ("O(q * log n)", "O(m log n)"), (r"$O((a + b) \cdot \log(a + b))$", "O((m+n) log(m+n))"), ("O(sqrt(n))", None), ("O(n^4)", None), ("varies", None), ("O(x * y * z)", None), ("O(?)", None), ("   ", None), ("", None), (None, None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as snippets: three in a row are of one problem; raw labels go round a fixed list by id."""
    raws = F.array(*[F.lit(r) for r, _ in RAWS])
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("code"), F.col("lang").alias("language"), "source",
        F.expr("cast(doc_id div 3 as string)").alias("problem_id"), F.element_at(raws, (F.col("doc_id") % len(RAWS)).cast("int") + 1).alias("raw_complexity"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic"), "ord", "left")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets with a class, its tier and a token count."""
    rows = normalized(snippets(spark, sf_dir)).where("label is not null").drop("reject_reason")
    return rows.withColumn("tier", tier(F.col("label"))).withColumn("tokens", X.token_count(F.col("code")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled snippets with their split."""
    from textloom.operators import rank

    rows = labelled(spark, sf_dir)
    return rank.assigned(rows, rank.stratified_split(rows))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as programs: one of the fixture's snippets each, by id, with the whole text as a comment at its end, so that codes
    differ as texts do. ord, id, language, code."""
    from textloom.plans.fixtures import SNIPPETS

    comment = F.array(*[F.lit("#" if language in ("python", "ruby", "php") else "//") for language, _ in SNIPPETS])
    at = (F.col("doc_id") % len(SNIPPETS)).cast("int") + 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " ")
    code = F.concat(pick([c for _, c in SNIPPETS]), F.element_at(comment, at), F.lit(" "), text, F.lit("\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), pick([x for x, _ in SNIPPETS]).alias("language"), code.alias("code"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, a made-up probability, and the choice at one half, by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"))
    p = ((F.col("doc_id") * 37) % 100) / 100.0
    return table(spark, sf_dir, "labels").where("quality is not null").join(d, "doc_id").select("doc_id", "language", F.col("quality").cast("int").alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("pred"))


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled snippets with a made-up predicted class: the true one for two ids in three, else the one seven ids on."""
    names = F.array(*map(F.lit, LABELS))
    pred = F.when(F.col("ord") % 3 < 2, F.col("label")).otherwise(F.element_at(names, ((F.col("ord") + 7) % len(LABELS)).cast("int") + 1))
    return labelled(spark, sf_dir).withColumn("pred", pred)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs: nation as language, balance as metric."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("language"))
    heads = F.array(*map(F.lit, ("xgb", "lgbm", "mlp", "logreg")))
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("run"), "language", F.element_at(heads, (F.col("s_suppkey") % 4).cast("int") + 1).alias("head"), (F.col("s_suppkey") % 3).alias("seed"),
        F.col("s_acctbal").alias("macro_f1"), F.round(F.abs("s_acctbal") / 7, 2).alias("test_acc"), (F.col("s_suppkey") % 50 + 1).alias("n_test"), (F.col("s_suppkey") * 31 % 997).alias("wallclock"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one three ids on, which the last ones don't have."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("pair_id"), F.col("vec_id").alias("id_a"), (F.col("vec_id") + 3).alias("id_b"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_RAW = ", ".join(f"({i}, {sql_text(r)}, {sql_text(x)})" for i, (r, x) in enumerate(RAWS))
_CLASS = ", ".join(f"({sql_text(x)}, {i}, {t})" for i, (x, t) in enumerate(zip(LABELS, TIERS)))

#: Common table expressions for DuckDB. Use with_views(names...) + a SELECT.
VIEWS = {
    "raws": f"raws(k, raw, class) AS (VALUES {_RAW})",
    "classes": f"classes(label, idx, tier) AS (VALUES {_CLASS})",
    "snippets": f"""snippets AS (SELECT d.doc_id AS ord, CAST(d.doc_id AS VARCHAR) AS id, d.text AS code, d.lang AS language, d.source,
        CAST(d.doc_id // 3 AS VARCHAR) AS problem_id, r.raw AS raw_complexity, r.class AS class
        FROM documents d JOIN raws r ON d.doc_id % {len(RAWS)} = r.k)""",
    "labelled": """labelled AS (SELECT s.*, c.label, c.idx, c.tier, greatest(1, CAST(length(s.code) // 3 AS INTEGER)) AS tokens FROM snippets s JOIN classes c ON s.class = c.label)""",
    "firsts": """firsts AS (SELECT problem_id, arg_min(language, ord) AS language, arg_min(label, ord) AS label FROM labelled GROUP BY problem_id)""",
    "placed": """placed AS (SELECT problem_id, row_number() OVER (PARTITION BY language, label ORDER BY sha256('42:' || problem_id), problem_id) - 1 AS i,
        count(*) OVER (PARTITION BY language, label) AS n FROM firsts)""",
    "splits": """splits AS (SELECT problem_id, CASE WHEN i < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed)""",
    "points": """points AS (SELECT l.*, coalesce(s.split, 'train') AS split FROM labelled l LEFT JOIN splits s USING (problem_id))""",
    "preds": """preds AS (SELECT l.doc_id, d.lang AS language, CAST(l.quality AS INTEGER) AS y, ((l.doc_id * 37) % 100) / CAST(100 AS DOUBLE) AS p,
        CASE WHEN ((l.doc_id * 37) % 100) / CAST(100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)""",
    "cpreds": f"""cpreds AS (SELECT l.*, CASE WHEN ord % 3 < 2 THEN l.label ELSE (SELECT c.label FROM classes c WHERE c.idx = (l.ord + 7) % {len(LABELS)}) END AS pred FROM labelled l)""",
    "runs": """runs AS (SELECT s_suppkey AS run, n_name AS language, CASE s_suppkey % 4 WHEN 0 THEN 'xgb' WHEN 1 THEN 'lgbm' WHEN 2 THEN 'mlp' ELSE 'logreg' END AS head, s_suppkey % 3 AS seed,
        s_acctbal AS macro_f1, round(abs(s_acctbal) / 7, 2) AS test_acc, s_suppkey % 50 + 1 AS n_test, s_suppkey * 31 % 997 AS wallclock FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
}
_NEEDS = {"snippets": ["raws"], "labelled": ["snippets", "classes"], "firsts": ["labelled"], "placed": ["firsts"], "splits": ["placed"], "points": ["labelled", "splits"], "cpreds": ["labelled"]}


def with_views(*names: str) -> str:
    """WITH and the views, each after those that it needs."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in done) + "\n"
