"""Augmentation by renaming identifiers: template expansion, and topping cells up to their cap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import RENAMES, TEMPLATE_RENAMES, allowed, renamed
from textloom.operators.rank import hash_order, ranked
from textloom.schemas import LANGUAGES


def _variants(schemes: tuple[dict, ...], code: Column, language: Column, languages: tuple[str, ...]) -> Column:
    """Array of (scheme, code) by language; a scheme that is empty for the language or changes nothing gives null code."""

    def one(i: int, scheme: dict) -> Column:
        out = renamed(code, scheme)
        for x in languages:
            own = allowed(scheme, x)
            if own != scheme:
                out = F.when(language == x, renamed(code, own) if own else F.lit(None)).otherwise(out)
        return F.struct(F.lit(i).alias("scheme"), F.when(out != code, out).alias("code"))

    return F.array(*[one(i, s) for i, s in enumerate(schemes)])


def renames(df: DataFrame, schemes: tuple[dict, ...] = RENAMES, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Every row's renamed variants that differ from it: its columns with the new code, the base's hash as augmented_from,
    and a source that says so. Counts of tokens and nodes and the problem stay the base's."""
    wide = df.withColumn("_v", F.explode(_variants(schemes, F.col("code"), F.col("language"), languages))).where("_v.code is not null")
    return wide.withColumns({
        "augmented_from": F.sha2("code", 256), "source": F.concat("source", F.lit("-aug")), "code": F.col("_v.code"), "scheme": F.col("_v.scheme"),
    }).drop("_v").withColumn("code_sha256", F.sha2("code", 256))


def expanded(templates: DataFrame, schemes: tuple[dict, ...] = TEMPLATE_RENAMES, first: int = 8, valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records of templates (language, pre_label, template, code): a row per template and scheme, among the first ones.

    A rename that changes nothing repeats the template's code, as a variant of its own. Reserved words aren't looked at here;
    valid, a filter such as a syntax check, drops the variants that came out broken. The problem is named by the hash of
    language and code.
    """
    forms = F.array(*[F.struct(F.lit(i).alias("variant"), renamed(F.col("code"), s).alias("code")) for i, s in enumerate(schemes[:first])])
    rows = templates.withColumn("_f", F.explode(forms)).withColumns({"variant": F.col("_f.variant"), "code": F.col("_f.code")}).drop("_f")
    rows = valid(rows) if valid else rows
    problem = F.concat(F.lit("syn-"), F.substring(F.sha1(F.concat_ws("|", "language", "code")), 1, 12))
    return rows.withColumns({"source": F.lit("synthetic"), "problem_id": problem, "solution_idx": F.col("variant"), "raw_complexity": F.col("pre_label")})


def topped_up(df: DataFrame, cap: int = 620, ratio: float = 4.0, seed: int = 42, cell: tuple[str, ...] = ("language", "label"), valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cells with at least cap rows are cut to cap; smaller ones get renamed variants up to min(cap, int(n * (1 + ratio))).

    The tries of a cell go round its rows (in hash order) and the schemes at once, so try i takes row i mod n and scheme i
    mod 10, up to 30 n tries; repeats of code that the cell has go. Only rows of cells under the cap make variants, and of
    each at most 10. valid: a filter for variants, such as a syntax check.
    """
    n_schemes = len(RENAMES)
    sizes = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    placed = ranked(df.withColumn("code_sha256", F.sha2("code", 256)), list(cell), [hash_order(F.col("code_sha256"), seed), F.col("ord")], "_rank").where(F.col("_rank") <= cap).join(sizes, list(cell))
    kept = placed.withColumn("augmented_from", F.lit(None).cast("string"))
    base = placed.where(F.col("_n") < cap)
    tried = renames(base)
    # The first i that is rank - 1 modulo n and the scheme modulo 10; none if their common divisor splits them.
    lap = F.filter(F.sequence(F.lit(0), F.lit(n_schemes - 1)), lambda t: F.pmod(F.col("_rank") - 1 + t * F.col("_n"), F.lit(n_schemes)) == F.col("scheme"))
    tried = tried.withColumn("_i", F.col("_rank") - 1 + F.try_element_at(lap, F.lit(1)) * F.col("_n")).where(F.col("_i").isNotNull() & (F.col("_i") < 3 * n_schemes * F.col("_n")))
    if valid:
        tried = valid(tried)
    new = tried.join(kept.select(*cell, "code_sha256"), [*cell, "code_sha256"], "left_anti")
    distinct = ranked(new, [*cell, "code_sha256"], [F.col("_i")], "_first").where("_first = 1").drop("_first")
    most = F.least(F.lit(cap), F.floor(F.col("_n") * F.lit(1 + ratio)))
    added = ranked(distinct, list(cell), [F.col("_i")], "_place").where(F.col("_place") <= most - F.col("_n")).drop("_place")
    return kept.drop("_rank", "_n").unionByName(added.drop("_rank", "_n", "_i", "scheme"))
