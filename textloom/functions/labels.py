"""Complexity labels from raw text, as column expressions: canonical form, variables, classes, and the reasons of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.operators.store import checkpointed
from textloom.schemas import LABELS

SPACE = r"(?U)\s"
#: Distinct raw labels that are broadcast, and the characters that each may have then.
FEW, LONG = 1 << 16, 256


# Words for variables, and letters that are never variables.
WORD_VARIABLES = {r"rows?|height": "m", r"cols?|columns?|width|len": "n"}
NOT_VARIABLES = ("o", "c", "k")

# The forms of each class after spaces around signs are dropped; the first class that fits wins.
LOG_N, LOG_M = r"log ?\(? ?n ?\)?", r"log ?\(? ?m ?\)?"
FORMS = (
    ("O(1)", r"alpha\(n\)|alpha\*n"),
    ("O((m+n) log(m+n))", r"\((m\+n|n\+m)\)\*log\(\1\)"),
    ("O(m log n)", rf"m\*{LOG_N}|n\*{LOG_M}|{LOG_M}\*n|{LOG_N}\*m"),
    ("O(m*n)", r"m\*n|n\*m"),
    ("O(m+n)", r"m\+n|n\+m"),
    ("exponential", r"(\d+|c|n)\*\*n|(n\*)?n!|\(n-\d+\)!"),
    ("O(n^3)", r"n\*\*3|n\*n\*n"),
    ("O(n^2)", r"n\*\*2|n\*n"),
    ("O(n log n)", rf"n\*{LOG_N}|n ?{LOG_N}|{LOG_N}\*n|log\(n!\)"),
    ("O(log n)", LOG_N),
    ("O(n)", r"n|n\+\d+|\d+\*n|n\+k|k\*n|n\*k"),
    ("O(1)", r"\d+"),
)


def canonical_text(raw: Column) -> Column:
    """Trimmed and lower-cased, without LaTeX, braces, trailing points or bases of logarithms; powers are **, products *."""
    s = F.regexp_replace(raw, rf"^{SPACE}+|{SPACE}+$", "")
    s = F.regexp_replace(F.replace(s, F.lit("$"), F.lit("")), r"[.,;:]+$", "")
    s = F.regexp_replace(s, r"\\(?:times|cdot)\b", "*")
    s = F.regexp_replace(s, r"\\(?:log|ln)\b", "log")
    s = F.regexp_replace(s, r"\\(sqrt|alpha)\b", "$1")
    s = F.regexp_replace(s, r"[{}]", "")
    s = F.regexp_replace(s, r"\bln\b", "log")
    s = F.regexp_replace(s, "[·×⋅]", "*")
    s = F.replace(s, F.lit("^"), F.lit("**"))
    s = F.lower(F.regexp_replace(s, r"\blog_?\s*\d+", "log"))
    return F.trim(F.regexp_replace(s, rf"{SPACE}+", " "))


def inner(text: Column) -> Column:
    """What stands in the outermost o(...), or the text itself."""
    return let(F.regexp_extract(text, r"(?s)^\s*o\s*\((.+)\)\s*$", 1), lambda found: F.when(found != "", F.trim(found)).otherwise(text))


def named_variables(expression: Column) -> Column:
    """Variables as m and n: words first, then the letters that the expression has.

    With n among them, the next letter in order is m and any further ones are unknown; one letter is n; two are m and n in
    their order, one after the other, so a second letter m ends as n as well.
    """
    for words, letter in WORD_VARIABLES.items():
        expression = F.regexp_replace(expression, rf"\b(?:{words})\b", letter)

    def renamed(text: Column, letter: Column, to: str) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"\b"), letter, F.lit(r"\b")), F.lit(to))

    def by_letters(text: Column, letters: Column) -> Column:
        first, second = F.try_element_at(letters, F.lit(1)), F.try_element_at(letters, F.lit(2))

        def with_n(others: Column) -> Column:
            one = renamed(text, F.try_element_at(others, F.lit(1)), "m")
            rest = F.concat(F.lit("(?:"), F.array_join(F.slice(others, 2, 26), "|"), F.lit(")"))
            return F.when(F.size(others) == 0, text).when(F.size(others) == 1, one).otherwise(renamed(one, rest, "?"))

        return (
            F.when(F.array_contains(letters, "n"), let(F.array_except(letters, F.array(F.lit("n"))), with_n))
            .when(F.size(letters) == 1, renamed(text, first, "n"))
            .when(F.size(letters) == 2, renamed(renamed(text, first, "m"), second, "n"))
            .otherwise(text)
        )

    def named(text: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([a-z])\b"), F.lit(1))))
        return let(F.array_except(found, F.array(*map(F.lit, NOT_VARIABLES))), lambda letters: by_letters(text, letters))

    return let(expression, named)


def squeezed(expression: Column) -> Column:
    """Without spaces next to signs; a space between words or numbers stays one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(expression, r"\s*([^\w\s])\s*", "$1"), r"\s+", " "))


def label_of(raw: Column) -> Column:
    """The class of a raw complexity, or null: for null, empty, roots, question marks, and what fits no form."""

    def classed(form: Column) -> Column:
        found = F.lit(None).cast("string")
        for label, pattern in reversed(FORMS):
            found = F.when(form.rlike(rf"^(?:{pattern})$"), F.lit(label)).otherwise(found)
        return found

    def labelled(text: Column) -> Column:
        return F.when((text != "") & ~text.contains("sqrt") & ~text.contains("?"), let(squeezed(named_variables(text)), classed))

    return let(let(canonical_text(raw), inner), labelled)


def normalized(df: DataFrame, raw_column: str = "raw_complexity", pre_column: str | None = None) -> DataFrame:
    """Adds label and reject_reason. A canonical pre-label stands; another one is normalised like a raw label.

    Expressions run once per distinct raw value, of which there are few against the rows. They are stored and counted: up to
    FEW are broadcast, so that rows, many of which may have one value or none, stay where they are; more are joined.
    """
    value = F.col(raw_column) if pre_column is None else F.coalesce(F.nullif(F.col(pre_column), F.lit("")), F.col(raw_column))
    rows = df.withColumn("_raw", value)
    known = rows.select("_raw").where("_raw is not null").distinct().withColumn("_label", F.when(F.col("_raw").isin(*LABELS), F.col("_raw")).otherwise(label_of(F.col("_raw"))))
    known = checkpointed(known)
    n, longest = known.agg(F.count("*"), F.max(F.length("_raw"))).first()
    if n <= FEW and (longest or 0) <= LONG:
        known = F.broadcast(known)
    out = rows.join(known, "_raw", "left").withColumn("label", F.col("_label"))
    reason = F.when(F.coalesce("_raw", F.lit("")) == "", "missing").when(F.col("label").isNull(), "no class fits")
    return out.withColumn("reject_reason", reason).drop("_raw", "_label")
