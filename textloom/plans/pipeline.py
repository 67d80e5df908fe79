"""The dataset build: raw records to labelled, stripped, filtered, deduplicated, balanced and split points, and pairs.

Each stage is a function of DataFrames. Stages are written where several later ones read them; the rest stays one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import code as K
from textloom.functions import text as X
from textloom.functions.labels import normalized
from textloom.operators import augment, counts, dedup, pairs, rank, sets
from textloom.schemas import LANGUAGES, PAIR, POINT, conform
from textloom.sources import sinks


@dataclass
class Settings:
    languages: tuple[str, ...] = LANGUAGES
    least_tokens: int = 6
    most_tokens: int = 3900
    cap: int = 620
    ratio: float = 4.0
    pairs: int = 30_000
    per_cell: int = 3000
    seed: int = 42


def labelled(*raw: DataFrame) -> DataFrame:
    """Rows of all sources with a label, or the reason why they have none."""
    rows = sets.union(*raw)
    missing = F.when(F.coalesce(F.nullif("code", F.lit("")), F.lit("")) == "", "missing code")
    return normalized(rows, pre_column="pre_label").withColumn("reject_reason", F.coalesce(missing, "reject_reason"))


def allowed(df: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    return df.where(F.col("language").isin(*languages))


def filtered(df: DataFrame, settings: Settings) -> DataFrame:
    """Languages, token counts and length first, then syntax, then near-duplicates per language."""
    cheap = allowed(df, settings.languages).withColumn("tokens_bpe", X.token_count(F.col("code")))
    cheap = cheap.where(K.length_gate(F.col("tokens_bpe"), settings.least_tokens, settings.most_tokens)).where(X.long_enough(F.col("code")))
    return dedup.near(K.valid(cheap))


def points(df: DataFrame, settings: Settings) -> DataFrame:
    """Balanced, split and conforming to POINT."""
    full = augment.topped_up(df, settings.cap, settings.ratio, settings.seed, valid=K.valid)
    keyed = rank.group_key(full)
    keyed = rank.assigned(keyed, rank.stratified_split(keyed, seed=settings.seed))
    nodes = K.structures(keyed).select("code_sha256", "language", F.col("nodes").alias("ast_nodes"))
    whole = keyed.drop("ast_nodes").join(nodes, ["code_sha256", "language"], "left")
    ids = rank.numbered(whole, ["ord", "code_sha256"], "_n", "%06d").withColumn("id", F.concat(F.substring("code_sha256", 1, 16), F.lit("-"), F.col("_n")))
    return conform(ids, POINT, {"solution_idx": 0, "tokens_bpe": 0, "ast_nodes": 0})


def paired(df: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of one problem and across labels, numbered, conforming to PAIR."""
    side = df.withColumn("ord", F.col("id")).withColumn("tokens", F.col("tokens_bpe"))
    both = pairs.same_problem(side).unionByName(pairs.cross_label(side, settings.pairs, settings.per_cell, settings.seed))
    return conform(rank.numbered(both, ["split", "language", "ord_a", "ord_b"], "pair_id", "p%07d"), PAIR)


def build(spark: SparkSession, raw: list[DataFrame], out: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Write rejects, points, pairs and audits under out, and return them."""
    settings = settings or Settings()
    sinks.table(labelled(*raw), f"{out}/labelled")
    stage = spark.read.parquet(f"{out}/labelled")
    sinks.table(K.strip_leakage(stage.where("reject_reason is null").drop("reject_reason")), f"{out}/stripped")
    stripped = spark.read.parquet(f"{out}/stripped")
    rejects = sets.union(stage.where("reject_reason is not null"), stripped.where("reject_reason is not null"))
    sinks.jsonl(rejects, f"{out}/rejects")
    sinks.audit(stripped, f"{out}/strip_audit")
    sinks.table(filtered(stripped.where("reject_reason is null"), settings), f"{out}/filtered")
    sinks.table(points(spark.read.parquet(f"{out}/filtered"), settings), f"{out}/points", ("split",))
    done = spark.read.parquet(f"{out}/points")
    sinks.table(paired(done, settings), f"{out}/pairs", ("split",))
    made = spark.read.parquet(f"{out}/pairs")
    sinks.report(counts.grouping_sets(done), f"{out}/audit")
    return {"rejects": rejects, "points": done, "pairs": made, "audit": counts.grouping_sets(done), "leaks": counts.leaks(done), "pair_audit": counts.pair_counts(made)}
