"""Registered queries of pair features, joins, orders and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import counts, metrics, pairs, rank, select
from textloom.plans import adapters as A
from textloom.plans.adapters import with_views
from textloom.plans.registry import query, rounded
from textloom.schemas import pair_label
from textloom.sources import readers, sinks

_SIMILARITY = ["cls_cosine", "cls_l2", "cls_mean_abs_diff", "cls_max_abs_diff"]

# ---- pairs and their features ----


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled snippets with the next one that is labelled among the two after them, in input order, and the pair's label."""
    rows = A.points(spark, sf).select("ord", "split", "language", "label", "code")
    a = rows.select(F.col("ord").alias("ord_a"), "split", F.col("language"), F.col("label").alias("label_a"), F.col("code").alias("code_a"))
    b = rows.select((F.col("ord") - 1).alias("ord_a"), F.col("label").alias("label_b"), F.col("code").alias("code_b"))
    return a.join(b, "ord_a").withColumn("ternary", pair_label(F.col("label_a"), F.col("label_b")))


_NEXT = """, near AS (SELECT x.ord AS ord_a, x.split, x.language, x.label AS label_a, y.label AS label_b, x.code AS code_a, y.code AS code_b, CASE WHEN x.tier = y.tier THEN 'same' WHEN x.tier < y.tier THEN 'A_faster' ELSE 'B_faster' END AS ternary
    FROM points x JOIN points y ON y.ord = x.ord + 1)
"""


@query(with_views("points") + _NEXT + "SELECT ord_a, ternary, CAST(ternary = 'A_faster' AS BIGINT) AS y FROM near WHERE ternary <> 'B_faster'")
def canonical_pairs(spark, sf):
    rows = pairs.canonical_only(neighbours(spark, sf))
    return rows.select("ord_a", "ternary", pairs.y(F.col("ternary")).alias("y"))


@query(with_views("points") + _NEXT + """, inside AS (SELECT DISTINCT code FROM points WHERE split = 'val')
    SELECT ord_a FROM (SELECT *, CASE WHEN ord_a % 2 = 0 THEN 'val' ELSE split END AS given FROM near) WHERE given = 'val' AND code_a NOT IN (SELECT code FROM inside) AND code_b NOT IN (SELECT code FROM inside)""")
def pairs_outside_split(spark, sf):
    """Pairs that are called validation pairs although neither side is; every other pair is given that split."""
    given = neighbours(spark, sf).withColumn("split", F.when(F.col("ord_a") % 2 == 0, "val").otherwise(F.col("split")))
    return counts.outsiders(given, A.points(spark, sf), "val").select("ord_a")


@query("SELECT CAST(vec_id AS VARCHAR) AS pair_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(CAST(embedding[2] AS DOUBLE), 6) END AS second FROM embeddings")
def similarity_zero_fill(spark, sf):
    """Pairs with the numbers of a table that lacks every third pair."""
    own = A.table(spark, sf, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").cast("string").alias("pair_id"), F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))
    return rounded(pairs.with_table(A.vector_pairs(spark, sf), own, ["first", "second"]).select("pair_id", "first", "second"), "first", "second")


def matrix_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of vectors with made-up labels, a structure table (that lacks every third pair), logits and similarities."""
    e = A.table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 5 == 0, "B_faster").when(F.col("label") < 5, "same").otherwise("A_faster")
    given = A.vector_pairs(spark, sf).join(e.select(F.col("vec_id").alias("id_a"), label.alias("ternary"), F.col("label").cast("string").alias("language")), "id_a")
    structure = e.where("vec_id % 3 <> 0").select(F.col("vec_id").cast("string").alias("pair_id"), F.slice("embedding", 1, 20).cast("array<double>").alias("ast"))
    logits = e.select(F.col("vec_id").alias("id"), F.slice("embedding", 21, 11).alias("logits"))
    both = pairs.with_both(A.vector_pairs(spark, sf), e, "vec_id", "embedding", 64, fill=False)
    return given, structure, logits, both.select("pair_id", *V.similarities(F.col("embedding_a"), F.col("embedding_b")))


_DOUBLES = "list_transform({}, lambda x: CAST(x AS DOUBLE))"
_ZERO = "list_transform(range({}), lambda i: CAST(0 AS DOUBLE))"
_MATRIX = f"""WITH e AS (SELECT vec_id, label, {_DOUBLES.format('embedding')} AS v FROM embeddings), p AS (SELECT x.*, y.v AS w FROM e x LEFT JOIN e y ON y.vec_id = x.vec_id + 3 WHERE x.vec_id % 5 <> 0),
    l AS (SELECT *, CASE WHEN w IS NULL THEN {_ZERO.format(11)} ELSE v[21:31] END AS a, CASE WHEN w IS NULL THEN {_ZERO.format(11)} ELSE w[21:31] END AS b, list_transform(range(1, 65), lambda i: abs(v[i] - w[i])) AS g,
        CASE WHEN w IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: v[i] * w[i])) END AS dot FROM p),
    d AS (SELECT *, list_transform(range(1, 12), lambda i: b[i] - a[i]) AS d FROM l),
    f AS (SELECT vec_id, label, list_concat(list_concat(list_concat(list_concat(list_concat(CASE WHEN vec_id % 3 = 0 THEN {_ZERO.format(20)} ELSE v[1:20] END, a), b), d), list_transform(d, lambda x: abs(x))),
        CASE WHEN w IS NULL THEN {_ZERO.format(4)} ELSE [dot / ((sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12) * (sqrt(list_sum(list_transform(w, lambda x: x * x))) + 1e-12)), sqrt(list_sum(list_transform(g, lambda x: x * x))), list_sum(g) / 64, list_max(g)] END) AS f FROM d)
"""


@query(_MATRIX + "SELECT CAST(vec_id AS VARCHAR) AS pair_id, CAST(label AS VARCHAR) AS language, CAST(label >= 5 AS BIGINT) AS y, CAST(k - 1 AS INTEGER) AS at, round(f[k], 4) AS value FROM f, range(1, 69) t(k)")
def feature_matrix(spark, sf):
    """The head's input of every pair in the right order, value by value."""
    rows = pairs.feature_matrix(*matrix_parts(spark, sf), n_ast=20, n_logits=11)
    return rounded(rows.select("pair_id", "language", "y", F.posexplode(F.col("features").cast("array<double>")).alias("at", "value")), "value", digits=4)


@query(_MATRIX + """SELECT CAST(label AS VARCHAR) AS language, count(*) AS n, round(sum(f[20]), 3) AS structure, round(sum(f[65]), 3) AS cosine FROM f WHERE label IN (2, 7) GROUP BY ALL""")
def language_slice(spark, sf):
    """The rows of two languages of the matrix, without anything being fitted anew."""
    rows = pairs.feature_matrix(*matrix_parts(spark, sf), n_ast=20, n_logits=11).where(F.col("language").isin("2", "7"))
    value = lambda i: F.sum(F.col("features")[i].cast("double"))
    return rounded(rows.groupBy("language").agg(F.count("*").alias("n"), value(19).alias("structure"), value(64).alias("cosine")), "structure", "cosine", digits=3)


@query("SELECT vec_id, round(CAST(embedding[(vec_id % 64) + 1] AS DOUBLE), 6) AS last FROM embeddings")
def last_token_pooling(spark, sf):
    rows = A.table(spark, sf, "embeddings").withColumn("n", F.col("vec_id") % 64 + 1)
    return rounded(rows.select("vec_id", V.last_token(F.col("embedding"), F.col("n")).alias("last")), "last")


_FITTED = ("l_quantity", "l_discount")


@query("WITH s AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _FITTED) + """ FROM lineitem)
    SELECT 0 AS at, round(l_quantity_m, 5) AS mean, round(l_quantity_s, 5) AS scale FROM s UNION ALL SELECT 1, 0.0, 1.0 UNION ALL SELECT 2, round(l_discount_m, 5), round(l_discount_s, 5) FROM s""")
def scaler_full_length(spark, sf):
    """Means and scales of all features in order, 0 and 1 for the one that isn't scaled."""
    arrays = metrics.scaler_arrays(metrics.scaler(A.table(spark, sf, "lineitem"), list(_FITTED)), ["l_quantity", "l_tax", "l_discount"])
    return rounded(arrays.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("at", "x")).select("at", "x.mean", "x.scale"), "mean", "scale", digits=5)


@query(with_views("points") + """, t AS (SELECT language, label, source, split, id FROM points) SELECT language, label, n, n_train, round(n_train / CAST(n AS DOUBLE), 6) AS share FROM (SELECT language, label, count(*) AS n, count(*) FILTER (split = 'train') AS n_train FROM t GROUP BY ALL)""")
def cell_support(spark, sf):
    rows = A.points(spark, sf).groupBy("language", "label").agg(F.count("*").alias("n"), F.sum((F.col("split") == "train").cast("long")).alias("n_train"))
    return rounded(rows.withColumn("share", F.col("n_train") / F.col("n")), "share")


# ---- orders and folds ----


@query(with_views("labelled") + "SELECT id, row_number() OVER (ORDER BY sha256('9:' || id), id) - 1 AS place FROM labelled")
def global_shuffle(spark, sf):
    return rank.shuffled(A.labelled(spark, sf).select("id"), "id", 9)


@query(with_views("labelled") + """, f AS (SELECT problem_id, (row_number() OVER (ORDER BY sha256('7:' || problem_id), problem_id) - 1) % 5 AS fold FROM (SELECT DISTINCT problem_id FROM labelled))
    SELECT id, fold = 2 AS held FROM labelled JOIN f USING (problem_id)""")
def fold_complement(spark, sf):
    rows = A.labelled(spark, sf)
    train, held = rank.complement(rows.join(rank.folds(rows, "problem_id", 5, 7), "problem_id"), 2)
    return train.select("id", F.lit(False).alias("held")).union(held.select("id", F.lit(True)))


@query(with_views("runs") + "SELECT language, run, macro_f1 FROM runs")
def worst_languages_first(spark, sf):
    return select.worst_first(A.runs(spark, sf), "macro_f1", "run").select("language", "run", "macro_f1")


@query(with_views("runs") + "SELECT run, name, value FROM (SELECT run, unnest(['macro_f1', 'test_acc']) AS name, unnest([macro_f1, test_acc]) AS value FROM runs)")
def flattened_metrics(spark, sf):
    rows = A.runs(spark, sf).select("run", F.create_map(F.lit("macro_f1"), "macro_f1", F.lit("test_acc"), "test_acc").alias("m"))
    return select.flattened(rows, ["run"], "m")


@query(with_views("runs") + ", c AS (SELECT run, seed FROM runs WHERE run % 4 <> 1) SELECT m.run, m.macro_f1, c.seed FROM runs m JOIN c USING (run)")
def runs_with_both_files(spark, sf):
    runs = A.runs(spark, sf)
    return select.merged_runs(runs.select("run", "macro_f1"), runs.where("run % 4 <> 1").select("run", "seed"), "run")


# ---- plots ----


@query(with_views("preds") + """, t AS (SELECT p AS threshold, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM preds GROUP BY p)
    SELECT round(threshold, 6) AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round(sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w), 6) AS precision FROM t WINDOW w AS (ORDER BY threshold DESC)""")
def roc_points(spark, sf):
    return rounded(metrics.curve(A.predictions(spark, sf)), "threshold", "fpr", "tpr", "precision")


@query(with_views("cpreds") + """, d AS (SELECT t.label AS t, p.label AS p, count(c.id) AS n FROM classes t CROSS JOIN classes p LEFT JOIN cpreds c ON c.label = t.label AND c.pred = p.label GROUP BY t.label, p.label)
    SELECT t AS "true", p AS pred, n, round(CASE WHEN sum(n) OVER (PARTITION BY t) > 0 THEN n / CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) ELSE 0 END, 6) AS share FROM d""")
def confusion_shares(spark, sf):
    return rounded(metrics.confusion_shares(A.class_predictions(spark, sf)), "share")


# ---- templates ----

#: A registry of our own: documents' short words as identifiers.
_TEMPLATES = {"python": {"O(n)": ["for x in arr: out.append(x)", "path = [i, j]"], "O(1)": ["merged = dp[0]"]}, "go": {"O(n)": ["for i := 0; i < n; i++ { out += a[i] }"]}}
_FORMS = (("i", "p"), ("j", "q")), (("x", "u"), ("y", "v")), (("out", "result"),), (("arr", "nums"), ("a", "xs"), ("b", "ys")), (("dp", "table"),), (("dist", "distances"),), (("path", "trail"),)


def _renamed_sql(renames) -> str:
    out = "code"
    for old, new in renames:
        out = f"regexp_replace({out}, '\\b{old}\\b', '{new}', 'g')"
    return out


_TEMPLATE_ROWS = ", ".join(f"('{language}', '{label}', {i}, '{code}')" for language, own in _TEMPLATES.items() for label, codes in own.items() for i, code in enumerate(codes))


@query(f"""WITH t(language, label, i, code) AS (VALUES {_TEMPLATE_ROWS}), f AS (SELECT language, label, i, unnest(range(8)) AS variant, unnest([code, {', '.join(_renamed_sql(f) for f in _FORMS)}]) AS code FROM t)
    SELECT language, label AS pre_label, language || '|' || label || '#' || i AS template, CAST(variant AS INTEGER) AS variant, code, 'syn-' || substr(sha1(language || '|' || code), 1, 12) AS problem_id FROM f""")
def template_expansion(spark, sf):
    from textloom.operators import augment

    return augment.expanded(readers.templates(spark, _TEMPLATES)).select("language", "pre_label", "template", "variant", "code", "problem_id")


@query("SELECT '| n | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n || ' | ' || r_name || ' |', chr(10) ORDER BY r_name) AS report FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)")
def markdown_report(spark, sf):
    nations = A.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    rows = nations.join(A.table(spark, sf, "region"), "r_regionkey").select("n", F.col("r_name").alias("name")).orderBy("name")
    return spark.createDataFrame([(sinks.markdown(rows),)], "report string")
