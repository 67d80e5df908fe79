"""Array functions: similarities, pair blocks, transforms and softmax. Sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, tiny: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(tiny)) * (norm(b) + F.lit(tiny)))


def gaps(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.transform(gaps(a, b), lambda x: x * x)))


def mean_gap(a: Column, b: Column) -> Column:
    return _sum(gaps(a, b)) / F.size(a)


def max_gap(a: Column, b: Column) -> Column:
    return F.array_max(gaps(a, b))


def similarities(a: Column, b: Column) -> list[Column]:
    return [cosine(a, b).alias("cls_cosine"), l2(a, b).alias("cls_l2"), mean_gap(a, b).alias("cls_mean_abs_diff"), max_gap(a, b).alias("cls_max_abs_diff")]


def pair_block(a: Column, b: Column) -> Column:
    """For each feature in turn: a, b, b - a, |b - a|."""
    each = F.zip_with(doubles(a), doubles(b), lambda x, y: F.array(x, y, y - x, F.abs(y - x)))
    return F.flatten(each)


def joined_block(a: Column, b: Column) -> Column:
    """All of a, all of b, all differences, all their sizes."""
    differences = F.zip_with(doubles(a), doubles(b), lambda x, y: y - x)
    return let(differences, lambda gap: F.concat(doubles(a), doubles(b), gap, F.transform(gap, lambda x: F.abs(x))))


def log_count(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def softmax(v: Column) -> Column:
    powers = let(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda x: x / total)))


def argmax(v: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return (F.array_position(doubles(v), F.array_max(doubles(v))) - 1).cast("int")


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def last_token(hidden: Column, n: Column) -> Column:
    """The vector of the last token that isn't padding."""
    return F.try_element_at(hidden, n.cast("int"))


def fused(ast: Column, logits_a: Column, logits_b: Column, similarity: Column) -> Column:
    """The head's input: structure block, both logits, their differences and sizes, similarities."""
    return F.concat(doubles(ast), joined_block(logits_a, logits_b), doubles(similarity)).cast("array<float>")


def bundle(tokens: Column, marked: Column, length: int, step: int, cls: int, sep: int, pad: int, bridge: int, memory: int) -> Column:
    """Encoder input: cls; the tokens, with a bridge before every step-th and a memory token before each marked place; cut to
    length - 1; sep; padding. Returns struct(input_ids, attention_mask, global_attention_mask, token_type_ids), bigints.

    Types are 0, 1 for bridges and 2 for memory tokens. Bridges, memory tokens and sep attend globally.
    """
    number = lambda x: F.lit(x).cast("bigint")

    def item(id_: Column, kind: int) -> Column:
        return F.array(F.struct(id_.cast("bigint").alias("id"), number(kind).alias("kind"), number(int(kind > 0)).alias("wide")))

    none = F.filter(item(number(0), 0), lambda x: F.lit(False))

    def spread(x: Column, i: Column) -> Column:
        before = F.when((i > 0) & (i % step == 0), item(number(bridge), 1)).otherwise(none)
        mark = F.when(F.array_contains(marked, i), item(number(memory), 2)).otherwise(none)
        return F.concat(before, mark, item(x, 0))

    body = F.slice(F.concat(item(number(cls), 0), F.flatten(F.transform(tokens, spread))), 1, length - 1)
    whole = F.concat(body, F.array(F.struct(number(sep).alias("id"), number(0).alias("kind"), number(1).alias("wide"))))
    fill = F.greatest(F.lit(0), F.lit(length) - F.size(whole))

    def padded(values: Column, value: int = 0) -> Column:
        return F.concat(values, F.array_repeat(number(value), fill))

    return F.struct(
        padded(F.transform(whole, lambda x: x["id"]), pad).alias("input_ids"),
        padded(F.transform(whole, lambda x: number(1))).alias("attention_mask"),
        padded(F.transform(whole, lambda x: x["wide"])).alias("global_attention_mask"),
        padded(F.transform(whole, lambda x: x["kind"])).alias("token_type_ids"),
    )
