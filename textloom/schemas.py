"""Schemas of the stages' tables, and the small dimensions that every stage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "float": T.FloatType()}


def _schema(text: str) -> T.StructType:
    """name kind, name kind, ...: without a session, as modules are imported before there is one."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (x.split() for x in text.split(", "))])


RAW = _schema("source string, language string, code string, raw_complexity string, problem_id string, solution_idx int, path string, pre_label string, template string, variant int")
POINT = _schema("id string, source string, language string, problem_id string, solution_idx int, code string, code_sha256 string, label string, raw_complexity string, tokens_bpe int, ast_nodes int, augmented_from string, split string")
PAIR = _schema("pair_id string, language string, code_a string, code_b string, label_a string, label_b string, ternary string, same_problem boolean, tokens_combined int, split string")
PREDICTIONS = _schema("pair_id string, label_true long, label_pred long, prob_same float, prob_A_faster float, language string")

# The classes in the order of their numbers, and the tier of each.
LABELS = ("O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)", "O(n^3)", "exponential", "O(m+n)", "O(m*n)", "O(m log n)", "O((m+n) log(m+n))")
TIERS = (0, 1, 2, 3, 4, 5, 6, 2, 4, 3, 3)
# The pair labels, and the mark of a pair in the wrong order.
PAIR_LABELS, WRONG_ORDER = ("same", "A_faster"), "B_faster"
# Languages, and file extensions of each.
LANGUAGES = ("python", "java", "cpp", "c", "csharp", "go", "javascript", "typescript", "php", "ruby", "rust", "swift")
EXTENSIONS = {
    "python": (".py",), "java": (".java",), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh"), "c": (".c", ".h"), "csharp": (".cs",), "go": (".go",),
    "javascript": (".js", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "php": (".php",), "ruby": (".rb",), "rust": (".rs",), "swift": (".swift",),
}
# Names of code fences.
FENCES = {
    "python": ("python", "python3", "py"), "java": ("java",), "cpp": ("cpp", "c++", "cxx"), "c": ("c",), "csharp": ("cs", "csharp", "c#"), "go": ("go", "golang"),
    "javascript": ("javascript", "js"), "typescript": ("typescript", "ts"), "php": ("php",), "ruby": ("ruby", "rb"), "rust": ("rust", "rs"), "swift": ("swift",),
}


def lookup(key: Column, pairs: dict) -> Column:
    """A dictionary of literals as an expression; null where the key isn't in it."""
    table = F.create_map(*[F.lit(x) for item in pairs.items() for x in item])
    return F.try_element_at(table, key)


def label_index(label: Column) -> Column:
    return lookup(label, {x: i for i, x in enumerate(LABELS)})


def tier(label: Column) -> Column:
    return lookup(label, dict(zip(LABELS, TIERS)))


def labels(spark: SparkSession) -> DataFrame:
    """The 11 classes: label, idx, tier."""
    return spark.createDataFrame([(x, i, t) for i, (x, t) in enumerate(zip(LABELS, TIERS))], "label string, idx int, tier int")


def pair_label(label_a: Column, label_b: Column) -> Column:
    """same, A_faster, or the mark of a pair that is to be swapped or dropped."""
    a, b = tier(label_a), tier(label_b)
    return F.when(a == b, PAIR_LABELS[0]).when(a < b, PAIR_LABELS[1]).when(a > b, WRONG_ORDER)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Columns of the schema in its order and types: missing ones are null or the default, null ones get the default."""
    defaults = defaults or {}
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
