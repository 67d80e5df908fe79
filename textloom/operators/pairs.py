"""Pairs of snippets: of one problem, across labels, joined with logits, vectors, similarities and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import tiles
from textloom.operators.rank import hash_order, ranked
from textloom.operators.store import checkpointed
from textloom.schemas import LABELS, PAIR_LABELS, label_index, pair_label, tier

#: The share of the pairs that each split gets, and the attempts per wanted pair.
SHARES, ATTEMPTS = {"train": 0.8, "val": 0.1, "test": 0.1}, 4
CELLS = len(LABELS) * (len(LABELS) + 1) // 2


def _sides(columns: list[str]) -> list[Column]:
    """Both sides (x_ and y_ columns) in order, as _a and _b: swapped if the first side's tier is higher.

    Sides are plain columns rather than structs, so that what a query doesn't use, such as texts, isn't moved.
    """
    swap = tier(F.col("x_label")) > tier(F.col("y_label"))
    out = []
    for c in columns:
        x, y = F.col(f"x_{c}"), F.col(f"y_{c}")
        out += [F.when(swap, y).otherwise(x).alias(f"{c}_a"), F.when(swap, x).otherwise(y).alias(f"{c}_b")]
    return out


def finished(pairs: DataFrame) -> DataFrame:
    """Adds the pair's label and summed tokens; pairs have ord_a, ord_b, code, label and tokens of both sides."""
    return pairs.withColumn("ternary", pair_label(F.col("label_a"), F.col("label_b"))).withColumn("tokens_combined", (F.coalesce("tokens_a", F.lit(0)) + F.coalesce("tokens_b", F.lit(0))).cast("int"))


def same_problem(points: DataFrame, most: int = tiles.MOST, codes: bool = True) -> DataFrame:
    """Every unordered pair of snippets of one problem, language and split. Their number is the result's own size.

    Pairs are made of numbers and labels, a hot problem's in tiles. codes: whether code_a and code_b are joined to
    the pairs, by ord.
    """
    keep = ["ord", "label", "tokens"]
    own = points.where("problem_id is not null").select("split", "language", "problem_id", *keep)
    both = tiles.paired(own, ["split", "language", "problem_id"], "ord", most)
    out = finished(both.select("split", "language", *_sides(keep), F.lit(True).alias("same_problem")))
    return with_codes(out, points) if codes else out


def with_codes(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs with code_a and code_b, joined by ord."""
    side = lambda x: points.select(F.col("ord").alias(f"ord_{x}"), F.col("code").alias(f"code_{x}"))
    return pairs.join(side("a"), "ord_a").join(side("b"), "ord_b")


def quotas(points: DataFrame, total: int, cap: int = 3000) -> DataFrame:
    """(split, language, quota): pairs wanted of each of the 66 label cells."""
    groups = points.select("split", "language").distinct()
    n = points.agg(F.countDistinct("language").alias("languages"))
    share = F.lit(0.8)
    for name, x in SHARES.items():
        share = F.when(F.col("split") == name, F.lit(x)).otherwise(share)
    target = F.floor(F.lit(float(total)) * share / F.greatest(F.lit(1), F.col("languages")))
    # n is one row
    return groups.crossJoin(F.broadcast(n)).select("split", "language", F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(target / CELLS))).cast("int").alias("quota"))


def cross_label(points: DataFrame, total: int, cap: int = 3000, seed: int = 42, codes: bool = True) -> DataFrame:
    """Pairs of different problems and different code for every cell of labels (equal labels too), up to the cell's quota.

    Each attempt of a cell is a slot number. A side's row of a slot is the one at that place, modulo its rows, of the label's
    rows in hash order; attempts that break a rule are dropped, and the first quota of the others stay. So a row meets
    only as many others as it has slots, and only the first quota * 4 rows of a label take part. These few rows, without
    their codes, are stored once for both sides. codes: whether code_a and code_b are joined to the pairs; without
    them, points may have the hash of their code, sha, instead.
    """
    slim = ["ord", "label", "tokens", "problem_id"]
    sha = F.col("sha") if "sha" in points.columns else F.sha2("code", 256)
    rows = points.where(F.col("label").isNotNull()).select("split", "language", *slim, sha.alias("sha"), label_index(F.col("label")).alias("i"))
    rows = checkpointed(rows)
    most = quotas(rows, total, cap).withColumn("attempts", F.col("quota") * ATTEMPTS)
    sizes = rows.groupBy("split", "language", "i").agg(F.count("*").alias("n")).join(most, ["split", "language"])

    def side(salt: int, name: str) -> DataFrame:
        placed = ranked(rows, ["split", "language", "i"], [hash_order(F.concat_ws(":", F.lit(str(salt)), F.col("ord").cast("string")), seed), F.col("ord")], "place")
        placed = placed.where(F.col("place") <= cap * ATTEMPTS)  # the literal bound limits each task's rows before the shuffle
        placed = placed.join(sizes, ["split", "language", "i"]).where("place <= attempts")
        cells = F.filter(F.array(*[F.lit(x) for x in range(len(LABELS))]), lambda x: (x >= F.col("i")) if salt == 0 else (x <= F.col("i")))
        slots = F.sequence(F.col("place") - 1, F.col("attempts") - 1, F.least("n", "attempts"))
        wide = placed.withColumn("j", F.explode(cells)).withColumn("slot", F.explode(slots))
        low, high = ("i", "j") if salt == 0 else ("j", "i")
        quota = ["quota"] if salt == 0 else []
        return wide.select("split", "language", *quota, F.col(low).alias("low"), F.col(high).alias("high"), "slot", *[F.col(c).alias(f"{name}_{c}") for c in [*slim, "sha"]])

    met = side(0, "x").join(side(1, "y"), ["split", "language", "low", "high", "slot"])
    met = met.where((F.col("x_sha") != F.col("y_sha")) & F.coalesce(F.col("x_problem_id") != F.col("y_problem_id"), F.lit(True)))
    first = ranked(met, ["split", "language", "low", "high"], [F.col("slot")], "_n").where(F.col("_n") <= F.col("quota"))
    out = finished(first.select("split", "language", *_sides(["ord", "label", "tokens"]), F.lit(False).alias("same_problem")))
    return with_codes(out, points) if codes else out


def y(ternary: Column) -> Column:
    return (ternary == PAIR_LABELS[1]).cast("long")


def canonical_only(pairs: DataFrame) -> DataFrame:
    """Without pairs in the wrong order."""
    return pairs.where(F.col("ternary").isin(*PAIR_LABELS))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    from textloom.operators.rank import first_by

    return first_by(df, [key], order, last=True)


def with_both(pairs: DataFrame, side: DataFrame, key: str, value: str, n: int, a: str = "id_a", b: str = "id_b", fill: bool = True) -> DataFrame:
    """Pairs with both sides' arrays as value_a and value_b. If either side has none, both are zeros (or the pair goes)."""
    how = "left" if fill else "inner"
    x = side.select(F.col(key).alias(a), F.col(value).alias(f"{value}_a"))
    z = side.select(F.col(key).alias(b), F.col(value).alias(f"{value}_b"))
    out = pairs.join(x, a, how).join(z, b, how)
    missing = F.col(f"{value}_a").isNull() | F.col(f"{value}_b").isNull()
    return out.withColumns({f"{value}_{s}": F.when(missing, V.zeros(n)).otherwise(V.doubles(F.col(f"{value}_{s}"))) for s in "ab"})


def with_table(pairs: DataFrame, table: DataFrame, columns: list[str], key: str = "pair_id") -> DataFrame:
    """Pairs with a table's numbers by pair; 0 where it has none."""
    return pairs.join(table.select(key, *columns), key, "left").fillna(0.0, columns)


def label_transfer(targets: DataFrame, anchors: DataFrame, key: str = "num_id", order: str = "ord") -> DataFrame:
    """Targets with the label of the first anchor of their number. If anchor and target both have structure flags
    (has_loop, has_recursion), they must be equal; without an anchor's flags there's no test."""
    from textloom.operators.rank import first_by

    first = first_by(anchors.where(F.col(key).isNotNull()), [key], order).select(key, F.col("label").alias("label"), F.col("has_loop").alias("_loop"), F.col("has_recursion").alias("_recursion"))
    return targets.join(first, key).where("_loop is null or (_loop = has_loop and _recursion = has_recursion)").drop("_loop", "_recursion")


def feature_matrix(pairs: DataFrame, structure: DataFrame, logits: DataFrame, similarity: DataFrame, n_ast: int = 84, n_logits: int = 11) -> DataFrame:
    """pair_id, language, y, features: structure block, logit blocks, similarities. Pairs have id_a and id_b; wrong orders go."""
    names = ["cls_cosine", "cls_l2", "cls_mean_abs_diff", "cls_max_abs_diff"]
    rows = canonical_only(pairs).withColumn("y", y(F.col("ternary")))
    rows = rows.join(structure.select("pair_id", "ast"), "pair_id", "left").withColumn("ast", F.coalesce("ast", V.zeros(n_ast)))
    rows = with_table(with_both(rows, logits, "id", "logits", n_logits), similarity, names)
    return rows.select("pair_id", "language", "y", V.fused(F.col("ast"), F.col("logits_a"), F.col("logits_b"), F.array(*names)).alias("features"))
