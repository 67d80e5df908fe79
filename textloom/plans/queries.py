"""Registered queries of the engine's own operators, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import code as code_functions
from textloom.functions import text as X
from textloom.functions import vectors as V
from textloom.functions.labels import normalized
from textloom.operators import augment, bloom, counts, dedup, metrics, pairs, rank, select, sets
from textloom.operators.store import checkpointed
from textloom.plans import adapters as A
from textloom.plans.adapters import with_views
from textloom.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from textloom.schemas import LABELS

__all__ = ["ORACLE_SQL", "QUERIES"]


# ---- labels ----


@query(with_views("snippets") + "SELECT id, raw_complexity, class AS label, CASE WHEN coalesce(raw_complexity, '') = '' THEN 'missing' WHEN class IS NULL THEN 'no class fits' END AS reject_reason FROM snippets")
def normalize_labels(spark, sf):
    return normalized(A.snippets(spark, sf)).select("id", "raw_complexity", "label", "reject_reason")


@query(with_views("snippets") + "SELECT raw_complexity, count(*) AS n FROM snippets WHERE class IS NULL GROUP BY raw_complexity ORDER BY n DESC, raw_complexity NULLS FIRST LIMIT 10")
def normalize_rejects_topk(spark, sf):
    return counts.top(normalized(A.snippets(spark, sf)).where("label is null"), ["raw_complexity"], 10)


@query(with_views("snippets", "classes") + """SELECT s.id, CASE WHEN s.ord % 4 = 0 THEN coalesce(c.label, s.class) ELSE s.class END AS label
    FROM snippets s LEFT JOIN classes c ON c.idx = s.ord % 12""")
def prelabel_bypass(spark, sf):
    names = F.array(*map(F.lit, LABELS))
    rows = A.snippets(spark, sf).withColumn("pre_label", F.when(F.col("ord") % 4 == 0, F.try_element_at(names, (F.col("ord") % 12).cast("int") + 1)))
    return normalized(rows, pre_column="pre_label").select("id", "label")


@query(with_views("snippets") + """SELECT id, CASE replace(lower(trim(raw)), ' ', '') WHEN 'o(1)' THEN 'O(1)' WHEN 'linear' THEN 'O(n)' WHEN 'nphard' THEN 'exponential' WHEN 'o(n*logn)' THEN 'O(n log n)' WHEN 'quadratic' THEN 'O(n^2)' END AS label
    FROM (SELECT id, CASE ord % 6 WHEN 0 THEN ' O(1)' WHEN 1 THEN 'Linear' WHEN 2 THEN 'NP hard' WHEN 3 THEN 'O(n * log n)' WHEN 4 THEN 'quadratic' ELSE 'unknown' END AS raw FROM snippets)""")
def alias_labels(spark, sf):
    raws = F.array(*map(F.lit, (" O(1)", "Linear", "NP hard", "O(n * log n)", "quadratic", "unknown")))
    return A.snippets(spark, sf).select("id", X.alias_label(F.element_at(raws, (F.col("ord") % 6).cast("int") + 1)).alias("label"))


# ---- audits and counts ----


@query(with_views("points") + """, g AS (SELECT label, split, source, language, count(*) AS n, grouping(label, split, source, language) AS level FROM points
    GROUP BY GROUPING SETS ((label), (split), (source), (language), (split, label), (language, label), (split, language)))
    SELECT CASE level WHEN 7 THEN 'label' WHEN 11 THEN 'split' WHEN 13 THEN 'source' WHEN 14 THEN 'language' WHEN 3 THEN 'split,label' WHEN 6 THEN 'language,label' WHEN 10 THEN 'split,language' END AS grain, label, split, source, language, n FROM g""")
def audit_grouping_sets(spark, sf):
    return counts.grouping_sets(A.points(spark, sf))


@query(with_views("labelled") + "SELECT language, label, count(*) AS n FROM labelled GROUP BY ALL HAVING count(*) < 30")
def audit_thin_cells(spark, sf):
    return counts.thin(A.labelled(spark, sf), ["language", "label"], counts.THIN_CELL)


@query(with_views("labelled") + """SELECT label, rank, id, code_prefix FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY ord) AS INTEGER) AS rank, id, substr(code, 1, 220) AS code_prefix FROM labelled) WHERE rank <= 3""")
def audit_examples(spark, sf):
    rows = A.labelled(spark, sf).withColumn("code_prefix", X.prefix(F.col("code")))
    return counts.examples(rows, "label", "ord", ["id", "code_prefix"])


@query(with_views("labelled") + "SELECT label, count(*) AS records, count(DISTINCT problem_id) AS problems, count(*) >= 50 AND count(*) >= count(DISTINCT problem_id) * 5.0 AS crowded FROM labelled GROUP BY label")
def audit_crowded_classes(spark, sf):
    return counts.crowded(A.labelled(spark, sf))


@query(with_views("labelled") + "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM labelled GROUP BY source")
def source_rates(spark, sf):
    return rounded(counts.rates(A.labelled(spark, sf), "source"), "percent")


@query(with_views("labelled") + """, x AS (SELECT *, CASE WHEN ord % 5 < 3 THEN 'train' WHEN ord % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM labelled)
    SELECT problem_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n FROM x GROUP BY problem_id HAVING count(DISTINCT split) > 1""")
def split_leakage(spark, sf):
    split = F.when(F.col("ord") % 5 < 3, "train").when(F.col("ord") % 5 == 3, "val").otherwise("test")
    return counts.leaks(A.labelled(spark, sf).withColumn("split", split))


@query(with_views("points") + r""", k AS (SELECT DISTINCT split, sha256(trim(regexp_replace(code, '\s+', ' ', 'g'))) AS h FROM points), p(l, r) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'))
    SELECT l AS "left", r AS "right", (SELECT count(*) FROM k a JOIN k b ON a.h = b.h AND a.split = p.l AND b.split = p.r) AS shared FROM p""")
def split_overlap_normhash(spark, sf):
    return counts.overlap(A.points(spark, sf), X.normal_hash(F.col("code")))


@query(with_views("points") + """, k AS (SELECT DISTINCT split, sha256(code) AS h FROM points), p(l, r) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'))
    SELECT l AS "left", r AS "right", (SELECT count(*) FROM k a JOIN k b ON a.h = b.h AND a.split = p.l AND b.split = p.r) AS shared FROM p""")
def split_overlap_exact(spark, sf):
    return counts.overlap(A.points(spark, sf), X.code_hash(F.col("code")))


@query(with_views("points") + """SELECT language, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
    count(*) FILTER (split = 'train') = 0 OR count(*) FILTER (split = 'test') = 0 AS skipped, count(*) FILTER (split = 'val') < 30 AS carve FROM points GROUP BY language""")
def language_support(spark, sf):
    return counts.supported(A.points(spark, sf), "language")


@query(with_views("points") + "SELECT split, source, count(*) AS n FROM points GROUP BY ALL")
def source_histogram(spark, sf):
    return counts.per_key(A.points(spark, sf), ["split", "source"])


@query(with_views("labelled") + "SELECT language, count(DISTINCT problem_id) AS groups FROM labelled GROUP BY language HAVING count(DISTINCT problem_id) >= 20")
def oof_enough_problems(spark, sf):
    return counts.enough_groups(A.labelled(spark, sf), "language", "problem_id")


@query(with_views("preds") + "SELECT sum(1 - y) AS n0, sum(y) AS n1, round(sum(y) / CAST(sum(1 - y) AS DOUBLE), 6) AS ratio, sum(y) / CAST(sum(1 - y) AS DOUBLE) > 2.5 OR sum(y) / CAST(sum(1 - y) AS DOUBLE) < 0.4 AS warn FROM preds")
def class_imbalance(spark, sf):
    return rounded(counts.imbalance(A.predictions(spark, sf), "y"), "ratio")


# ---- weights ----


@query(with_views("labelled") + """, c AS (SELECT c.label, CAST(c.idx AS INTEGER) AS idx, count(l.id) AS n FROM classes c LEFT JOIN labelled l USING (label) GROUP BY ALL), r AS (SELECT *, sqrt(sum(n) OVER () / CAST(greatest(n, 1) AS DOUBLE)) AS raw FROM c)
    SELECT label, idx, n, round(CASE WHEN n > 0 THEN raw / avg(raw) OVER () ELSE 0 END, 6) AS weight FROM r""")
def class_weights_sqrt(spark, sf):
    return rounded(counts.sqrt_weights(A.labelled(spark, sf)), "weight")


@query(with_views("preds") + "SELECT y, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight FROM preds GROUP BY y")
def balanced_weights(spark, sf):
    return rounded(counts.balanced_weights(A.predictions(spark, sf), "y"), "weight")


@query(with_views("labelled") + "SELECT language, label, count(*) AS n, round(1.0 / count(*), 6) AS weight FROM labelled GROUP BY ALL")
def cell_weights(spark, sf):
    return rounded(counts.cell_weights(A.labelled(spark, sf)), "weight")


# ---- order, splits, samples ----


@query(with_views("labelled") + "SELECT id, language, label FROM (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY sha256('42:' || sha256(code)), ord) AS r FROM labelled) WHERE r <= 20")
def cap_per_cell(spark, sf):
    rows = A.labelled(spark, sf).withColumn("code_sha256", X.code_hash(F.col("code")))
    return rank.capped(rows, ["language", "label"], "code_sha256", "ord", 20, 42).select("id", "language", "label")


@query(with_views("points") + "SELECT id, problem_id, split FROM points")
def stratified_split(spark, sf):
    return A.points(spark, sf).select("id", "problem_id", "split")


@query(with_views("labelled") + "SELECT problem_id, CAST((row_number() OVER (ORDER BY sha256('7:' || problem_id), problem_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT problem_id FROM labelled)")
def kfold_assign(spark, sf):
    return rank.folds(A.labelled(spark, sf), "problem_id", 5, 7)


@query(with_views("labelled") + """SELECT language, problem_id, CAST((row_number() OVER (PARTITION BY language ORDER BY sha256('7:' || problem_id), problem_id) - 1) % 4 AS INTEGER) AS fold FROM (SELECT DISTINCT language, problem_id FROM labelled)""")
def kfold_by_language(spark, sf):
    return rank.folds(A.labelled(spark, sf), "problem_id", 4, 7, ("language",))


@query(with_views("labelled") + """, f AS (SELECT problem_id, CAST((row_number() OVER (ORDER BY sha256('7:' || problem_id), problem_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT problem_id FROM labelled))
    SELECT fold, count(*) AS n FROM labelled JOIN f USING (problem_id) GROUP BY fold""")
def fold_sizes(spark, sf):
    rows = A.labelled(spark, sf)
    return counts.per_key(rows.join(rank.folds(rows, "problem_id", 5, 7), "problem_id"), ["fold"])


@query(with_views("labelled") + """SELECT id, language, r <= greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0)) AS carved FROM (SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY substr(sha256('1234:' || id), 1, 16), id) AS r, count(*) OVER (PARTITION BY language) AS n FROM labelled)""")
def carve_val(spark, sf):
    return rank.carved(A.labelled(spark, sf), ["language"], "id", 0.1, 1234).select("id", "language", "carved")


@query("SELECT doc_id FROM documents ORDER BY sha256('5:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample_without_replacement(spark, sf):
    return rank.sampled(A.table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 5)


@query(with_views("labelled") + "SELECT 'p' || lpad(CAST(row_number() OVER (ORDER BY ord) - 1 AS VARCHAR), 7, '0') AS row_id, id FROM labelled")
def sequential_ids(spark, sf):
    return rank.numbered(A.labelled(spark, sf).select("ord", "id"), ["ord"], "row_id", "p%07d").select("row_id", "id")


@query(with_views("labelled") + """, w AS (SELECT l.id, sha256('3:' || l.id) AS h, 1.0 / CAST(count(*) OVER (PARTITION BY language, label) AS DOUBLE) AS w FROM labelled l),
    c AS (SELECT id, w, sum(w) OVER (ORDER BY h, id) AS upto, sum(w) OVER () AS whole FROM w), d AS (SELECT i AS draw, CAST(CAST('0x' || substr(sha256('3:draw:' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM range(500) t(i))
    SELECT draw, id FROM d JOIN c ON u >= (upto - w) / whole AND u < upto / whole""")
def weighted_draws(spark, sf):
    rows = A.labelled(spark, sf)
    weighted = rows.join(counts.cell_weights(rows).select("language", "label", "weight"), ["language", "label"])
    return rank.drawn(weighted, "id", "weight", 500, 3)


@query(with_views("snippets") + """SELECT code_hash, first_id, last_id FROM (SELECT sha256(code) AS code_hash, arg_min(id, ord) AS first_id, arg_max(id, ord) AS last_id FROM snippets WHERE code IS NOT NULL GROUP BY ALL)""")
def first_and_last_wins(spark, sf):
    rows = A.snippets(spark, sf).where("code is not null").select(X.code_hash(F.col("code")).alias("code_hash"), "id", "ord")
    first = rank.first_by(rows, ["code_hash"], "ord").select("code_hash", F.col("id").alias("first_id"))
    last = rank.first_by(rows, ["code_hash"], "ord", last=True).select("code_hash", F.col("id").alias("last_id"))
    return first.join(last, "code_hash")


# ---- duplicates ----


@query(with_views("labelled") + "SELECT language, label, arg_min(id, ord) AS id FROM labelled GROUP BY language, label, sha256(code)")
def exact_dedup_cell(spark, sf):
    rows = A.labelled(spark, sf).select("language", "label", X.code_hash(F.col("code")).alias("code_sha256"), "id", "ord")
    return dedup.exact(rows, ["language", "label", "code_sha256"], "ord").select("language", "label", "id")


@query(r"""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM d),
    s AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 5), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT a, b, round(m / CAST(x.n + y.n - m AS DOUBLE), 6) AS similarity FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.5 * (x.n + y.n - m)""")
def shingle_jaccard(spark, sf):
    """All pairs of different texts: no block decides which meet."""
    distinct = A.table(spark, sf, "documents").groupBy(F.col("text").alias("code")).agg(F.min("doc_id").alias("ord"))
    return rounded(dedup.similar(distinct, 0.5), "similarity")


@query()
def minhash_lsh_dedup(spark, sf):
    return dedup.near(A.snippets(spark, sf)).select("id", "language")


# ---- augmentation ----


def whole_word(value: str, old: str, new: str) -> str:
    """A rename of whole words in DuckDB: twice, as a word's end may be the next one's start; letters of all scripts count."""
    once = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{Nd}}_])" + old + "($|[^\\p{{L}}\\p{{Nd}}_])', '\\1" + new + "\\2', 'g')"
    return once.format(once.format(value))


#: Renames in the words of the test texts: short words of two languages. Their languages reserve no words.
_SCHEMES = ({"a": "p", "the": "q"}, {"de": "final", "les": "xs"})


@query(f"""WITH e AS (SELECT doc_id, text, source, lang, sha256(text) AS h, [{{'scheme': 0, 'code': {whole_word(whole_word("text", "a", "p"), "the", "q")}}}, {{'scheme': 1, 'code': {whole_word(whole_word("text", "de", "final"), "les", "xs")}}}] AS v FROM documents), x AS (SELECT doc_id, text, source, h, unnest(v) AS v FROM e)
    SELECT doc_id, CAST(v.scheme AS INTEGER) AS scheme, sha256(v.code) AS code_sha256, h AS augmented_from, source || '-aug' AS source FROM x WHERE v.code <> text""")
def rename_augment(spark, sf):
    rows = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"), F.col("lang").alias("language"), "source")
    return augment.renames(rows, _SCHEMES).select("doc_id", "scheme", "code_sha256", "augmented_from", "source")


def _renamed(scheme: dict[str, str]) -> str:
    out = "code"
    for old, new in scheme.items():
        out = whole_word(out, old, new)
    return out


@query(with_views("labelled") + f""", s AS (SELECT language, label, count(*) AS n FROM labelled GROUP BY ALL),
    p AS (SELECT l.*, n, sha256(code) AS sha, row_number() OVER (PARTITION BY l.language, l.label ORDER BY sha256('42:' || sha256(code)), ord) AS r FROM labelled l JOIN s ON l.language = s.language AND l.label = s.label),
    kept AS (SELECT * FROM p WHERE r <= 40), v AS (SELECT *, unnest(range(10)) AS scheme, unnest([{", ".join(map(_renamed, X.RENAMES))}]) AS new FROM kept WHERE n < 40),
    t AS (SELECT *, sha256(new) AS nsha, r - 1 + n * list_min(list_filter(range(10), lambda t: (r - 1 + t * n) % 10 = scheme)) AS i FROM v WHERE new <> code),
    d AS (SELECT t.*, row_number() OVER (PARTITION BY t.language, t.label, nsha ORDER BY i) AS f FROM t LEFT JOIN kept k ON k.language = t.language AND k.label = t.label AND k.sha = nsha WHERE i < 30 * t.n AND k.sha IS NULL),
    a AS (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY i) AS place FROM d WHERE f = 1)
    SELECT id, language, label, source, sha AS code_sha256, NULL AS augmented_from FROM kept UNION ALL SELECT id, language, label, source || '-aug', nsha, sha FROM a WHERE place <= least(40, floor(n * 5.0)) - n""")
def cell_top_up(spark, sf):
    rows = A.labelled(spark, sf).select("id", "ord", "code", "language", "label", "source")
    return augment.topped_up(rows, cap=40).select("id", "language", "label", "source", "code_sha256", "augmented_from")


# ---- pairs ----

_PAIRS = with_views("points", "classes") + """, pairs AS (SELECT x.split, x.language,
    CASE WHEN x.tier > y.tier THEN y.ord ELSE x.ord END AS ord_a, CASE WHEN x.tier > y.tier THEN x.ord ELSE y.ord END AS ord_b,
    CASE WHEN x.tier > y.tier THEN y.label ELSE x.label END AS label_a, CASE WHEN x.tier > y.tier THEN x.label ELSE y.label END AS label_b,
    CASE WHEN x.tier = y.tier THEN 'same' ELSE 'A_faster' END AS ternary, x.tokens + y.tokens AS tokens_combined, true AS same_problem
    FROM points x JOIN points y ON x.split = y.split AND x.language = y.language AND x.problem_id = y.problem_id AND x.ord < y.ord)
"""


@query(_PAIRS + "SELECT split, language, ord_a, ord_b, label_a, label_b, ternary, CAST(tokens_combined AS INTEGER) AS tokens_combined, same_problem FROM pairs")
def pairs_same_problem(spark, sf):
    return pairs.same_problem(A.points(spark, sf), codes=False).select("split", "language", "ord_a", "ord_b", "label_a", "label_b", "ternary", "tokens_combined", "same_problem")


@query(_PAIRS + "SELECT label_a, label_b, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, label_a, label_b LIMIT 20")
def pair_cell_topk(spark, sf):
    return counts.top(pairs.same_problem(A.points(spark, sf), codes=False), ["label_a", "label_b"], 20)


@query(with_views("points") + """, g AS (SELECT DISTINCT split, language FROM points) SELECT split, language, CAST(least(3000, greatest(1, floor(floor(2000000.0 * CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END / (SELECT count(DISTINCT language) FROM points)) / 66))) AS INTEGER) AS quota FROM g""")
def pair_quotas(spark, sf):
    return pairs.quotas(A.points(spark, sf), 2_000_000)


_CROSS = """, quota AS (SELECT split, language, least(3000, greatest(1, floor(floor(30000.0 * CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END / (SELECT count(DISTINCT language) FROM points)) / 66))) AS quota FROM (SELECT DISTINCT split, language FROM points)),
    base AS (SELECT p.*, sha256(code) AS sha, quota, 4 * quota AS attempts, count(*) OVER (PARTITION BY p.split, p.language, idx) AS n FROM points p JOIN quota q ON p.split = q.split AND p.language = q.language),
    sided AS (SELECT *, row_number() OVER (PARTITION BY split, language, idx, salt ORDER BY sha256('42:' || salt || ':' || CAST(ord AS VARCHAR)), ord) AS place FROM base, (VALUES ('0'), ('1')) t(salt)),
    slots AS (SELECT s.*, unnest(generate_series(CAST(place - 1 AS BIGINT), CAST(attempts - 1 AS BIGINT), CAST(least(n, attempts) AS BIGINT))) AS slot FROM sided s WHERE place <= attempts AND place <= 12000),
    met AS (SELECT x.split, x.language, x.quota, x.idx AS low, y.idx AS high, x.slot, x.ord AS xo, y.ord AS yo, x.label AS xl, y.label AS yl, x.tier AS xt, y.tier AS yt, x.tokens + y.tokens AS tokens_combined
        FROM slots x JOIN slots y ON x.salt = '0' AND y.salt = '1' AND x.split = y.split AND x.language = y.language AND x.slot = y.slot AND x.idx <= y.idx WHERE x.sha <> y.sha AND coalesce(x.problem_id <> y.problem_id, true)),
    crossed AS (SELECT split, language, CASE WHEN xt > yt THEN yo ELSE xo END AS ord_a, CASE WHEN xt > yt THEN xo ELSE yo END AS ord_b, CASE WHEN xt > yt THEN yl ELSE xl END AS label_a, CASE WHEN xt > yt THEN xl ELSE yl END AS label_b,
        CASE WHEN xt = yt THEN 'same' ELSE 'A_faster' END AS ternary, CAST(tokens_combined AS INTEGER) AS tokens_combined, false AS same_problem FROM (SELECT *, row_number() OVER (PARTITION BY split, language, low, high ORDER BY slot) AS r FROM met) WHERE r <= quota)
"""


@query(with_views("points") + _CROSS + "SELECT split, language, ord_a, ord_b, label_a, label_b, ternary, tokens_combined, same_problem FROM crossed")
def pairs_cross_sampled(spark, sf):
    return pairs.cross_label(A.points(spark, sf), 30_000, codes=False).select("split", "language", "ord_a", "ord_b", "label_a", "label_b", "ternary", "tokens_combined", "same_problem")


@query(_PAIRS + _CROSS + """, every AS (SELECT ternary, split, label_a, label_b, same_problem FROM pairs UNION ALL SELECT ternary, split, label_a, label_b, same_problem FROM crossed),
    g AS (SELECT ternary, split, label_a, label_b, count(*) AS n, count(*) FILTER (same_problem) AS same_problem, grouping(ternary, split, label_a, label_b) AS level FROM every GROUP BY GROUPING SETS ((ternary), (split), (label_a, label_b)))
    SELECT CASE level WHEN 7 THEN 'ternary' WHEN 11 THEN 'split' ELSE 'label_a,label_b' END AS grain, ternary, split, label_a, label_b, n, same_problem FROM g""")
def pair_statistics(spark, sf):
    points, keep = A.points(spark, sf), ["ternary", "split", "label_a", "label_b", "same_problem"]
    points = checkpointed(points.select("ord", "split", "language", "problem_id", "label", "tokens", X.code_hash(F.col("code")).alias("sha")))
    return counts.pair_counts(pairs.same_problem(points, codes=False).select(*keep).union(pairs.cross_label(points, 30_000, codes=False).select(*keep)))


# ---- metrics ----


@query(with_views("cpreds") + """SELECT t.label AS "true", p.label AS pred, count(c.id) AS n FROM classes t CROSS JOIN classes p LEFT JOIN cpreds c ON c.label = t.label AND c.pred = p.label GROUP BY ALL""")
def confusion_dense(spark, sf):
    return metrics.confusion(A.class_predictions(spark, sf))


_PRF = """, k AS (SELECT c.label AS class, count(*) FILTER (x.label = c.label AND x.pred = c.label) AS tp, count(*) FILTER (x.label = c.label) AS support, count(*) FILTER (x.pred = c.label) AS predicted{key} FROM classes c CROSS JOIN cpreds x GROUP BY ALL),
    prf AS (SELECT class{only}, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / CAST(support + predicted AS DOUBLE) ELSE 0 END AS f1, support FROM k)
"""


@query(with_views("cpreds") + _PRF.format(key="", only="") + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf")
def per_class_prf(spark, sf):
    return rounded(metrics.per_class(A.class_predictions(spark, sf)), "precision", "recall", "f1")


@query(with_views("cpreds") + _PRF.format(key=", x.language", only=", language") + """SELECT language, n, round(accuracy, 6) AS accuracy, round(near, 6) AS within_1_tier_accuracy, round(macro_f1, 6) AS macro_f1
    FROM (SELECT x.language, count(*) AS n, avg(CASE WHEN x.label = x.pred THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN abs(x.tier - p.tier) <= 1 THEN 1.0 ELSE 0 END) AS near FROM cpreds x JOIN classes p ON x.pred = p.label GROUP BY x.language)
    JOIN (SELECT language, avg(f1) AS macro_f1 FROM prf GROUP BY language) USING (language)""")
def per_language_metrics(spark, sf):
    rows = metrics.by_language(A.class_predictions(spark, sf))
    return rounded(metrics.pointwise(rows, keys=("language",)), "accuracy", "within_1_tier_accuracy", "macro_f1")


@query(with_views("cpreds") + _PRF.format(key="", only="") + """SELECT n, round(accuracy, 6) AS accuracy, round(near, 6) AS within_1_tier_accuracy, round((SELECT avg(f1) FROM prf), 6) AS macro_f1
    FROM (SELECT count(*) AS n, avg(CASE WHEN x.label = x.pred THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN abs(x.tier - p.tier) <= 1 THEN 1.0 ELSE 0 END) AS near FROM cpreds x JOIN classes p ON x.pred = p.label)""")
def pointwise_metrics(spark, sf):
    return rounded(metrics.pointwise(A.class_predictions(spark, sf)), "accuracy", "within_1_tier_accuracy", "macro_f1")


_BINARY = """c AS (SELECT {key}count(*) AS n, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp, avg((p - y) * (p - y)) AS b FROM preds {group})
    SELECT {key}n, round((tn + tp) / CAST(n AS DOUBLE), 6) AS accuracy, round(CASE WHEN tn + fp = 0 THEN tp / CAST(tp + fn AS DOUBLE) WHEN tp + fn = 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE (tn / CAST(tn + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) / 2 END, 6) AS balanced_accuracy,
    round((coalesce(2 * tn / CAST(nullif(2 * tn + fp + fn, 0) AS DOUBLE), 0) + coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)) / 2, 6) AS macro_f1, tn, fp, fn, tp, round(CASE WHEN tn + fp > 0 AND tp + fn > 0 THEN b END, 6) AS brier_score FROM c"""


@query(with_views("preds") + ", " + _BINARY.format(key="", group=""))
def binary_metrics(spark, sf):
    return rounded(metrics.binary(A.predictions(spark, sf)), "accuracy", "balanced_accuracy", "macro_f1", "brier_score")


@query(with_views("preds") + ", " + _BINARY.format(key="language, ", group="GROUP BY language"))
def binary_metrics_by_language(spark, sf):
    return rounded(metrics.binary(metrics.by_language(A.predictions(spark, sf)), keys=("language",)), "accuracy", "balanced_accuracy", "macro_f1", "brier_score")


_EDGES = " ".join(f"WHEN p >= CAST('{i * 0.1!r}' AS DOUBLE) AND p {'<=' if i == 9 else '<'} CAST('{1.0 if i == 9 else (i + 1) * 0.1!r}' AS DOUBLE) THEN {i}" for i in range(10))


@query(with_views("preds") + f", b AS (SELECT CASE {_EDGES} END AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM preds GROUP BY ALL) SELECT round(sum(abs(conf - acc) * n) / sum(n), 6) AS ece FROM b")
def ece(spark, sf):
    return rounded(metrics.ece(A.predictions(spark, sf)), "ece")


_AREAS = """t AS (SELECT {key}p AS s, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY ALL), c AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY {part} ORDER BY s DESC) AS cn FROM t)
    SELECT {key}round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (cp - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 6) AS roc_auc, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cp / CAST(cp + cn AS DOUBLE)) / sum(pos) END, 6) AS pr_auc FROM c {group}"""


@query(with_views("preds") + ", " + _AREAS.format(key="", part="1", group=""))
def roc_and_pr_auc(spark, sf):
    return rounded(metrics.areas(A.predictions(spark, sf)), "roc_auc", "pr_auc")


@query(with_views("preds") + ", " + _AREAS.format(key="language, ", part="language", group="GROUP BY language"))
def auc_by_language(spark, sf):
    return rounded(metrics.areas(A.predictions(spark, sf), keys=("language",)), "roc_auc", "pr_auc")


@query(with_views("cpreds") + ", r AS (SELECT row_number() OVER (ORDER BY x.tier, x.ord) AS ra, row_number() OVER (ORDER BY p.tier, x.ord) AS rb FROM cpreds x JOIN classes p ON x.pred = p.label) SELECT round(corr(ra, rb), 6) AS spearman FROM r")
def spearman(spark, sf):
    from textloom.schemas import tier

    rows = A.class_predictions(spark, sf).withColumn("pred_tier", tier(F.col("pred")))
    return rounded(metrics.spearman(rows, "tier", "pred_tier", "ord"), "spearman")


@query(with_views("cpreds") + ", b AS (SELECT label, pred, CASE WHEN ord % 5 = 0 THEN (SELECT c.label FROM classes c WHERE c.idx = ord % 11) ELSE label END AS first FROM cpreds) SELECT label, count(*) AS n, round(avg(CASE WHEN label = first THEN 1.0 ELSE 0 END), 6) AS acc_before, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END), 6) AS acc_after, round(avg(CASE WHEN first <> pred THEN 1.0 ELSE 0 END), 6) AS flip_rate, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END) - avg(CASE WHEN label = first THEN 1.0 ELSE 0 END), 6) AS delta FROM b GROUP BY label")
def transform_probe(spark, sf):
    names = F.array(*map(F.lit, LABELS))
    rows = A.class_predictions(spark, sf).withColumn("first", F.when(F.col("ord") % 5 == 0, F.element_at(names, (F.col("ord") % 11).cast("int") + 1)).otherwise(F.col("label")))
    return rounded(metrics.before_after(rows, "label", "first", "pred"), "acc_before", "acc_after", "flip_rate", "delta")


@query("SELECT round(max(abs(s_acctbal - s_nationkey)), 6) AS max_diff, round(avg(abs(s_acctbal - s_nationkey)), 6) AS mean_diff, round(sum((s_suppkey % 2) * s_nationkey) / CAST(sum(s_nationkey) AS DOUBLE), 6) AS weighted_accuracy FROM supplier")
def parity_check(spark, sf):
    rows = A.table(spark, sf, "supplier").withColumn("hit", F.col("s_suppkey") % 2)
    return rounded(metrics.differences(rows, "s_acctbal", "s_nationkey", "s_nationkey", "hit"), "max_diff", "mean_diff", "weighted_accuracy")


# ---- selection ----


@query(with_views("runs") + "SELECT run, language, macro_f1 FROM runs")
def leaderboard(spark, sf):
    return select.leaderboard(A.runs(spark, sf), "macro_f1", "run").select("run", "language", "macro_f1")


@query(with_views("runs") + "SELECT language, run, head, seed FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY macro_f1 DESC, test_acc DESC, run) AS r FROM runs) WHERE r = 1")
def best_per_group(spark, sf):
    return select.best_per_language(A.runs(spark, sf), "run").select("language", "run", "head", "seed")


@query(with_views("runs") + "SELECT head, run, seed FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY test_acc DESC, run) AS r FROM runs) WHERE r = 1")
def best_seed_per_head(spark, sf):
    return select.best_seed(A.runs(spark, sf), "run").select("head", "run", "seed")


@query(with_views("runs") + "SELECT run, macro_f1, wallclock FROM runs ORDER BY macro_f1 DESC, wallclock, run LIMIT 1")
def sweep_winner(spark, sf):
    return select.winner(A.runs(spark, sf), "run").select("run", "macro_f1", "wallclock")


@query(with_views("runs") + ", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY macro_f1 DESC, test_acc DESC, run) AS r FROM runs) WHERE r = 1) SELECT round(sum(test_acc * n_test) / sum(n_test), 6) AS test_acc, round(sum(macro_f1 * n_test) / sum(n_test), 6) AS macro_f1, CAST(sum(n_test) AS BIGINT) AS n_test FROM b")
def weighted_headline(spark, sf):
    return rounded(select.headline(select.best_per_language(A.runs(spark, sf), "run")), "test_acc", "macro_f1")


@query(with_views("runs") + ", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY macro_f1 DESC, test_acc DESC, run) AS r FROM runs) WHERE r = 1) SELECT c_custkey, n_name AS language, b.head, b.seed FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN b ON b.language = n_name")
def route_requests(spark, sf):
    nation = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("language"))
    requests = A.table(spark, sf, "customer").join(nation, "c_nationkey").select("c_custkey", "language")
    return select.route(select.best_per_language(A.runs(spark, sf), "run"), requests).select("c_custkey", "language", "head", "seed")


@query("""WITH a AS (SELECT o_custkey AS language, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY ALL), b AS (SELECT user_id AS language, round(avg(value), 6) AS v FROM events GROUP BY ALL)
    SELECT coalesce(a.language, b.language) AS language, a.v AS phase_a, b.v AS phase_b, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b USING (language)""")
def report_full_outer(spark, sf):
    """Both sides have keys of their own: customers without events, and a user that is no customer."""
    orders = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("language")).agg(F.avg("o_totalprice").alias("v"))
    events = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("language")).agg(F.avg("value").alias("v"))
    return rounded(select.side_by_side(rounded(orders, "v"), rounded(events, "v"), "language", "v"), "delta")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def missing_languages(spark, sf):
    return select.missing(A.table(spark, sf, "customer"), A.table(spark, sf, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_anti_join(spark, sf):
    return sets.remaining(A.table(spark, sf, "documents").select("doc_id"), A.table(spark, sf, "labels"), "doc_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderkey % 97 = 5) USING (l_orderkey)
    UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""")
def filtered_joins(spark, sf):
    """A semi and an anti join behind Bloom filters of their keys."""
    orders = A.table(spark, sf, "orders")
    few = orders.where("o_orderkey % 97 = 5").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = bloom.semi(A.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")), few, ["l_orderkey"])
    users = A.table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return lines.select("l_orderkey", "l_linenumber").union(bloom.anti(orders.select("o_orderkey", "o_custkey"), users, ["o_custkey"]).select("o_orderkey", F.lit(-1).cast("long")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf):
    return sets.shared(A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_sources(spark, sf):
    a = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.union(a, A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


# ---- vectors and features ----

_DOT = "list_sum(list_transform(generate_series(1, len({a})), lambda i: CAST({a}[i] AS DOUBLE) * {b}[i]))"
_GAP = "list_transform(generate_series(1, len(a)), lambda i: abs(CAST(a[i] AS DOUBLE) - b[i]))"


_ZEROS = "list_transform(generate_series(1, 64), lambda i: CAST(0 AS FLOAT))"


@query(f"""WITH p AS (SELECT x.vec_id, CASE WHEN y.vec_id IS NULL THEN {_ZEROS} ELSE x.embedding END AS a, CASE WHEN y.vec_id IS NULL THEN {_ZEROS} ELSE y.embedding END AS b FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 3), n AS (SELECT *, sqrt({_DOT.format(a='a', b='a')}) AS na, sqrt({_DOT.format(a='b', b='b')}) AS nb, {_DOT.format(a='a', b='b')} AS ab, {_GAP} AS g FROM p)
    SELECT CAST(vec_id AS VARCHAR) AS pair_id, round(ab / ((na + 1e-12) * (nb + 1e-12)), 6) AS cls_cosine, round(sqrt(list_sum(list_transform(g, lambda x: x * x))), 6) AS cls_l2, round(list_sum(g) / len(a), 6) AS cls_mean_abs_diff, round(list_max(g), 6) AS cls_max_abs_diff FROM n""")
def pair_vector_similarity(spark, sf):
    """Pairs whose second side has no vector are zeros on both sides."""
    both = pairs.with_both(A.vector_pairs(spark, sf), A.table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    names = ["cls_cosine", "cls_l2", "cls_mean_abs_diff", "cls_max_abs_diff"]
    return rounded(both.select("pair_id", *V.similarities(F.col("embedding_a"), F.col("embedding_b"))), *names)


@query("""WITH p AS (SELECT x.vec_id, CASE WHEN y.vec_id IS NULL THEN list_transform(generate_series(1, 11), lambda i: CAST(0 AS DOUBLE)) ELSE CAST(x.embedding[1:11] AS DOUBLE[]) END AS a, CASE WHEN y.vec_id IS NULL THEN list_transform(generate_series(1, 11), lambda i: CAST(0 AS DOUBLE)) ELSE CAST(y.embedding[1:11] AS DOUBLE[]) END AS b FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 3),
    l AS (SELECT vec_id, list_concat(a, b) AS f, list_transform(generate_series(1, 11), lambda i: b[i] - a[i]) AS d FROM p), w AS (SELECT vec_id, list_concat(list_concat(f, d), list_transform(d, lambda x: abs(x))) AS f FROM l)
    SELECT CAST(vec_id AS VARCHAR) AS pair_id, CAST(k - 1 AS INTEGER) AS at, round(f[k], 6) AS value FROM w, generate_series(1, 44) t(k)""")
def logit_block_zero_fill(spark, sf):
    logits = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 11).alias("logits"))
    both = pairs.with_both(A.vector_pairs(spark, sf), logits, "id", "logits", 11)
    return rounded(both.select("pair_id", F.posexplode(V.joined_block(F.col("logits_a"), F.col("logits_b"))).alias("at", "value")), "value")


_SCALED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH s AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _SCALED) + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 5) AS {c}" for c in _SCALED) + " FROM lineitem, s")
def scaler_fit_apply(spark, sf):
    rows = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED)
    return rounded(metrics.scaled(rows, metrics.scaler(rows, list(_SCALED)), list(_SCALED)), *_SCALED, digits=5)


@query("SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_count, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS signed_log FROM customer")
def signed_log1p(spark, sf):
    balance = F.col("c_acctbal")
    return rounded(A.table(spark, sf, "customer").select("c_custkey", V.log_count(balance).alias("log_count"), V.signed_log(balance).alias("signed_log")), "log_count", "signed_log")


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1:11] AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM e)
    SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, round(1 / list_sum(e), 6) AS confidence FROM x""")
def softmax_argmax(spark, sf):
    logits = F.slice("embedding", 1, 11)
    return rounded(A.table(spark, sf, "embeddings").select("vec_id", V.argmax(logits).alias("best"), F.array_max(V.softmax(logits)).alias("confidence")), "confidence")


@query("SELECT doc_id, CAST(CASE WHEN contains(text, 'set(') OR contains(text, 'frozenset(') OR contains(text, '{ ') THEN 1 ELSE 0 END AS INTEGER) AS has_set, CAST(CASE WHEN contains(text, 'dict(') OR contains(text, 'defaultdict') OR contains(text, 'OrderedDict') OR contains(text, 'Counter') OR contains(text, '{}') THEN 1 ELSE 0 END AS INTEGER) AS has_map, CAST((length(text) - length(replace(text, 'sorted(', ''))) // 7 + (length(text) - length(replace(text, '.sort(', ''))) // 6 + (length(text) - length(replace(text, 'sort(', ''))) // 5 AS INTEGER) AS n_sort FROM documents")
def text_presence_flags(spark, sf):
    code, python = F.col("text"), F.lit("python")
    return A.table(spark, sf, "documents").select("doc_id", X.has_any(code, python, X.SETS).alias("has_set"), X.has_any(code, python, X.MAPS).alias("has_map"), X.count_marks(code, python).alias("n_sort"))


@query(r"""WITH f AS (SELECT page_id, list_distinct(regexp_extract_all(html, '\b([A-Za-z_][A-Za-z_0-9]{0,30})\b\s*=[^=]', 1)) AS names FROM pages)
    SELECT page_id, CAST(len(list_filter(names, lambda x: NOT list_contains(['let','var','const','if','while','for','fn','func','def','return','import','from','true','false','null','None','True','False','this','self'], x))) AS INTEGER) AS n FROM f""")
def assigned_identifiers(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.assigned_names(F.col("html")).alias("n"))


@query(r"""SELECT doc_id, greatest(1, CAST(length(text) // 3 AS INTEGER)) AS tokens, greatest(1, length(text) // 3) BETWEEN 6 AND 3900 AS fits, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) >= 5 AS long_enough FROM documents""")
def length_gates(spark, sf):
    tokens = X.token_count(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", tokens.alias("tokens"), code_functions.length_gate(tokens).alias("fits"), X.long_enough(F.col("text")).alias("long_enough"))


@query("SELECT doc_id, CASE WHEN contains(text, 'public class ') OR contains(text, 'import java.') THEN 'java' WHEN contains(text, 'def ') OR starts_with(ltrim(text), 'import ') THEN 'python' END AS language FROM documents")
def language_detect(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.detected_language(F.col("text")).alias("language"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.CPP' WHEN 2 THEN '.tsx' ELSE '' END AS path FROM pages)
    SELECT page_id, CASE lower(regexp_extract(path, '(\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.cpp' THEN 'cpp' WHEN '.tsx' THEN 'typescript' END AS language FROM p""")
def ext_to_lang(spark, sf):
    ending = F.when(F.col("page_id") % 4 == 0, ".py").when(F.col("page_id") % 4 == 1, ".CPP").when(F.col("page_id") % 4 == 2, ".tsx").otherwise("")
    path = F.concat(F.regexp_extract("url", r"^[^?#]*", 0), ending)
    return A.table(spark, sf, "pages").select("page_id", X.extension_language(path).alias("language"))


@query(r"""SELECT page_id, nullif(regexp_extract('solution/' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '.Two Sum/README.md', '(?:^|/)(\d{4})\.', 1), '') AS path_id, nullif(regexp_replace(split_part(regexp_extract(url, '^[^?#]*'), '/', -1), '\D', '', 'g'), '') AS num_id, 'cc-' || substr(sha1(html), 1, 12) AS synthetic_id FROM pages""")
def ids_from_paths(spark, sf):
    path = F.concat(F.lit("solution/"), F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit(".Two Sum/README.md"))
    return A.table(spark, sf, "pages").select("page_id", X.path_id(path).alias("path_id"), X.numeric_id(F.regexp_extract("url", r"^[^?#]*", 0)).alias("num_id"), X.synthetic_id("cc", F.col("html")).alias("synthetic_id"))


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS solution_idx, CASE i WHEN 0 THEN 'python' ELSE 'java' END AS language, replace(text, '`', '') || chr(10) AS code,
    CASE (doc_id + i) % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'log ' || CAST(doc_id AS VARCHAR) END AS raw_complexity FROM documents, (VALUES (0), (1)) t(i) WHERE text IS NOT NULL""")
def markdown_blocks(spark, sf):
    """Each whole text as the code of a document of two solutions: complexity stated strictly, loosely or not at all."""
    stated = lambda i: F.when((F.col("doc_id") + i) % 3 == 0, F.lit("The time complexity is $O(n)$.")).when((F.col("doc_id") + i) % 3 == 1, F.format_string("In time we need $O(log %d)$, or so.", "doc_id")).otherwise(F.lit("Time is short."))
    body = F.replace("text", F.lit("`"), F.lit(""))
    first = F.concat(F.lit("Intro\n<!-- solution:start -->\n"), stated(0), F.lit("\n```Python3 x\n"), body, F.lit("\n```\n```python\nsecond\n```\n```unknown\nx\n```\n<!-- solution:end -->\nBetween\n"))
    second = F.concat(F.lit("<!-- Solution:Start -->\n"), stated(1), F.lit("\n~~~java\n"), body, F.lit("\n~~~\n<!--solution:end-->\n```go\noutside\n```\n<!-- solution:start -->\nno end"))
    return X.fenced(A.table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(first, second).alias("document")), keep=("doc_id",))


@query(r"""WITH c AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN CASE WHEN lang = 'en' THEN '# Time:  O(n^' ELSE '//Time: O(n^' END || CAST(doc_id AS VARCHAR) || ') O(1)' || chr(10) || text WHEN 1 THEN text || chr(10) || '# Time: O((m+n) log(m+n))' ELSE text END AS code FROM documents)
    SELECT doc_id, nullif(trim(regexp_extract(array_to_string(string_split_regex(code, '\r\n|\r|\n')[1:10], chr(10)), CASE WHEN lang = 'en' THEN '#\s*Time:\s*O\((.+?)\)' ELSE '//\s*Time:\s*O\((.+?)\)' END, 1)), '') AS raw_complexity FROM c""")
def header_extract(spark, sf):
    """Whole texts as code, with a statement before, after (found if the text is short) or nowhere, in two kinds of comments."""
    english = F.col("lang") == "en"
    head = F.concat(F.when(english, "# Time:  O(n^").otherwise("//Time: O(n^"), F.col("doc_id").cast("string"), F.lit(") O(1)\n"))
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(head, "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\n# Time: O((m+n) log(m+n))"))).otherwise(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", X.header_complexity(code, F.when(english, "python").otherwise("java")).alias("raw_complexity"))


@query(r"""SELECT doc_id, sha256(text) AS code_hash FROM documents WHERE text IS NOT NULL""")
def leak_strip_headers(spark, sf):
    code = F.concat(F.lit("# Time: O(n)\n  // Space: O(1)\n"), F.col("text"))
    return A.table(spark, sf, "documents").where("text is not null").select("doc_id", X.code_hash(X.without_headers(code)).alias("code_hash"))


@query("""WITH a AS (SELECT doc_id // 2 AS k, arg_min(quality, doc_id) AS label, arg_min(toxic = 1, doc_id) AS l FROM labels GROUP BY ALL)
    SELECT d.doc_id, a.label FROM documents d JOIN a ON d.doc_id % 500 = a.k WHERE a.l = (d.n_chars % 5 = 0)""")
def label_transfer(spark, sf):
    anchors = A.table(spark, sf, "labels").select(F.expr("doc_id div 2").alias("num_id"), F.col("doc_id").alias("ord"), F.col("quality").alias("label"), (F.col("toxic") == 1).alias("has_loop"), F.lit(False).alias("has_recursion"))
    targets = A.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 500).alias("num_id"), (F.col("n_chars") % 5 == 0).alias("has_loop"), F.lit(False).alias("has_recursion"))
    return pairs.label_transfer(targets, anchors).select("doc_id", "label")


# ---- logs ----


@query("""WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(CAST(value AS DOUBLE) ORDER BY event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id),
    m AS (SELECT user_id, ids, list_reduce(list_transform(v, lambda x: [x]), lambda a, x: list_append(a, CAST(0.05 AS DOUBLE) * x[1] + CAST(0.95 AS DOUBLE) * a[len(a)])) AS e FROM l) SELECT user_id, unnest(ids) AS event_id, round(unnest(e), 6) AS ema FROM m""")
def loss_ema(spark, sf):
    rows = A.table(spark, sf, "events").where("value is not null")
    return rounded(metrics.ema(rows, "user_id", "event_id", "value").select("user_id", "event_id", "ema"), "ema")


@query("""WITH e AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS v, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events WHERE value IS NOT NULL),
    g AS (SELECT *, sum(CASE WHEN m IS NULL OR v > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) - 1 AS bad FROM g),
    s AS (SELECT user_id, min(event_id) FILTER (bad >= 3) AS stop_step, coalesce(arg_min(k, event_id) FILTER (bad >= 3), max(k)) AS k FROM b GROUP BY user_id)
    SELECT s.user_id, b.event_id AS best_step, b.v AS best_value, s.stop_step FROM s JOIN b ON s.user_id = b.user_id AND s.k = b.k AND b.bad = 0""")
def early_stop_step(spark, sf):
    rows = A.table(spark, sf, "events").where("value is not null")
    return metrics.early_stop(rows, "user_id", "event_id", "value", 3, 0.0)


# ---- code, heads ----


@query()
def ast_features(spark, sf):
    return code_functions.structures(A.programs(spark, sf))


@query()
def ast_pair_features(spark, sf):
    """Each program with the next one of its language."""
    rows = A.programs(spark, sf)
    a = rows.select("language", F.col("ord").alias("ord_a"), F.col("code").alias("code_a"))
    b = rows.select("language", (F.col("ord") - 16).alias("ord_a"), F.col("code").alias("code_b"))
    return code_functions.pair_structures(a.join(b, ["language", "ord_a"]).withColumn("pair_id", F.col("ord_a").cast("string")), code_functions.structures(rows))


@query()
def leak_strip_comments(spark, sf):
    return code_functions.strip_leakage(A.programs(spark, sf))


@query()
def memory_line_offsets(spark, sf):
    return A.programs(spark, sf).select("ord", code_functions.memory_lines(F.col("code"), F.col("language")).alias("offsets"))


@query("""WITH t AS (SELECT vec_id, vec_id % 90 AS n, [vec_id % 7, vec_id % 50] AS marked FROM embeddings), s AS (SELECT vec_id, list_transform(range(n), lambda i: list_concat(list_concat(CASE WHEN i > 0 AND i % 16 = 0 THEN [513] ELSE [] END, CASE WHEN list_contains(marked, i) THEN [515] ELSE [] END), [100 + i])) AS s FROM t),
    b AS (SELECT vec_id, list_append(list_concat([512], flatten(s))[1:79], 514) AS ids FROM s)
    SELECT vec_id, array_to_string(list_concat(ids, list_transform(range(80 - len(ids)), lambda i: 0)), ' ') AS input_ids, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(len(list_filter(ids, lambda x: x IN (513, 514, 515))) AS BIGINT) AS n_global,
    CAST(len(list_filter(ids, lambda x: x = 513)) + 2 * len(list_filter(ids, lambda x: x = 515)) AS BIGINT) AS n_types FROM b""")
def encoder_bundle(spark, sf):
    """Token lists of 0 to 89, so some are padded and some cut, with bridges and one or two marked places."""
    n, total = F.col("vec_id") % 90, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    tokens = F.transform(F.filter(F.sequence(F.lit(0), F.lit(89)), lambda i: i < n), lambda i: i + 100)
    b = V.bundle(tokens, F.array((F.col("vec_id") % 7).cast("int"), (F.col("vec_id") % 50).cast("int")), 80, 16, 512, 514, 0, 513, 515)
    rows = A.table(spark, sf, "embeddings").select("vec_id", b.alias("b"))
    return rows.select("vec_id", F.array_join("b.input_ids", " ").alias("input_ids"), total(F.col("b.attention_mask")).alias("n_tokens"), total(F.col("b.global_attention_mask")).alias("n_global"), total(F.col("b.token_type_ids")).alias("n_types"))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("string").alias("language"))


@query()
def head_logreg_metrics(spark, sf):
    from textloom.plans import heads

    rows = _matrix(spark, sf)
    train, test = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    return heads.evaluated(heads.scored(heads.fit("logreg", train), test))


@query("""WITH r AS (SELECT CAST(label >= 5 AS INTEGER) AS y, list_transform(embedding, lambda x: floor(2 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
    t AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS ones FROM r), e AS (SELECT y, unnest(generate_series(1, len(x))) AS i, x FROM r),
    v AS (SELECT i - 1 AS feature, x[i] AS v, count(*) AS n, sum(y) AS ones FROM e GROUP BY ALL),
    s AS (SELECT feature, v, sum(n) OVER w AS nl, sum(ones) OVER w AS ol FROM v WINDOW w AS (PARTITION BY feature ORDER BY v)),
    g AS (SELECT feature, v, pow(nl * p - ol, 2) / (nl * p * (1 - p) + 1) AS l, pow((n - nl) * p - (ones - ol), 2) / ((n - nl) * p * (1 - p) + 1) AS r, nl, ol, n, ones, p FROM s, t WHERE nl < n AND nl >= 20 AND n - nl >= 20),
    b AS (SELECT * FROM g ORDER BY round(l + r, 9) DESC, feature, v LIMIT 1)
    SELECT CAST(feature AS INTEGER) AS feature, round(v, 6) AS threshold, round(l + r, 6) AS gain, round(-(nl * p - ol) / (nl * p * (1 - p) + 1), 6) AS below, round(-((n - nl) * p - (ones - ol)) / ((n - nl) * p * (1 - p) + 1), 6) AS above FROM b""")
def tree_first_split(spark, sf):
    """The first split of a boosted tree over all features of all vectors, in steps of a half: its gain and both leaves."""
    from textloom.plans import trees

    e = A.table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    rows = e.select((F.col("label") >= 5).cast("int").alias("y"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(2 * x).cast("double")).alias("features"))
    model = trees.fit(rows, trees.Settings(leaves=2, rounds=1, rate=1.0, l2=1.0))
    tree = model.trees[0]
    found = (tree.feature[0], model.edges[tree.feature[0]][tree.bin[0]], tree.gain[0], tree.value[1], tree.value[2])
    return rounded(spark.createDataFrame([found], "feature int, threshold double, gain double, below double, above double"), "threshold", "gain", "below", "above")


def _head(spark: SparkSession, sf: str, name: str, params: dict) -> DataFrame:
    from textloom.plans import heads

    rows = _matrix(spark, sf)
    train, val, test = rows.where("id % 5 > 1"), rows.where("id % 5 = 1"), rows.where("id % 5 = 0")
    return heads.evaluated(heads.scored(heads.fit(name, train, params=params, val=val), test))


@query()
def head_lgbm_metrics(spark, sf):
    """Leaf-wise trees with early stopping."""
    return _head(spark, sf, "lgbm", {"rounds": 24, "rate": 0.2, "stop": 5})


@query()
def head_xgb_metrics(spark, sf):
    """Depth-wise trees with samples of rows and columns and early stopping."""
    return _head(spark, sf, "xgb", {"rounds": 24, "rate": 0.2, "depth": 4, "stop": 5})


@query()
def sweep_metrics(spark, sf):
    """Two heads and two seeds on each of three parts of the vectors, in one job."""
    from textloom.plans import grouped

    rows = _matrix(spark, sf).withColumn("language", F.concat(F.lit("part-"), F.col("id") % 3))
    return grouped.swept(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), ["logreg", "lgbm"], [1, 2], params={"lgbm": {"rounds": 10, "leaves": 8, "rate": 0.2}})


@query()
def head_stacked_metrics(spark, sf):
    from textloom.plans import heads

    rows = _matrix(spark, sf)
    train, test = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    return heads.evaluated(heads.Stacked(("forest", "logreg")).fit(train).scored(test))
