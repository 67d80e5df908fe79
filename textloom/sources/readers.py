"""Readers: files of text, JSON lines in three strictnesses, Parquet with pushed-down filters, run folders and literals."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.schemas import EXTENSIONS, RAW, conform, lookup


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) of any file system that Spark reads has anything."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several places that is there."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


#: Bytes of files that a task sends on at once.
BATCH = 4 << 20


def documents(spark: SparkSession, paths: list[str] | str, pattern: str = "*") -> DataFrame:
    """path, name, document: whole text files under the roots whose name fits the pattern; hidden ones are left out.

    A folder of a root is listed and read by one task, as files that are small cost a scan more than their bytes: it counts each as 4 MB. An empty file
    is a row with an empty text. Paths with wildcards go through Spark's scan, which leaves empty files out.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    if any(c in root for root in roots for c in "*?[{"):
        found = spark.read.text(roots, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
        return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("document"))
    places = [x for root in roots for x in top(root)]
    listed = spark.createDataFrame(pa.table({"place": pa.array(places, pa.string())})).repartition(max(1, min(len(places), 16 * spark.sparkContext.defaultParallelism)))
    found = listed.mapInArrow(under(pattern), "path string, name string, content binary")
    return found.select("path", "name", F.col("content").cast("string").alias("document"))


def shown(name: str) -> bool:
    return not name.startswith(("_", "."))


def address(system: str, path: str) -> str:
    """As Spark writes it."""
    return f"file:{quote(path)}" if system == "file" else f"{system}://{quote(path)}"


def top(root: str) -> list[str]:
    """Addresses of the folders and files that lie in a root, or of a root that is a file."""
    from pyarrow import fs

    own = root if re.match(r"[A-Za-z][\w+.-]*:", root) else f"file://{quote(root)}"
    system, place = fs.FileSystem.from_uri(own)
    kind = system.get_file_info(place).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    return [own] if kind == fs.FileType.File else [address(own.split(":", 1)[0], x.path) for x in system.get_file_info(fs.FileSelector(place)) if shown(x.base_name)]


def under(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """path, name, content of files, and of those in folders, some at a time."""
    kinds = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary())])
    fits = re.compile("|".join(fnmatch.translate(x) for x in alternatives(pattern)))
    batch_of = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.types)], schema=kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held, size = [], 0
        for own in (x for batch in batches for x in batch["place"].to_pylist()):
            system, place = fs.FileSystem.from_uri(own)
            info = system.get_file_info(place)
            for x in [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True)):
                if x.type != fs.FileType.File or not fits.match(x.base_name) or not all(map(shown, x.path[len(place) + 1 :].split("/"))):
                    continue
                with system.open_input_stream(x.path) as source:
                    held.append((address(own.split(":", 1)[0], x.path), x.base_name, source.read()))
                size += len(held[-1][2])
                if size >= BATCH or len(held) == 4096:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return rows


def alternatives(pattern: str) -> list[str]:
    """A pattern with {a,b} as patterns without."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    return [x for own in found[1].split(",") for x in alternatives(pattern[: found.start()] + own + pattern[found.end() :])] if found else [pattern]


def sources(spark: SparkSession, paths: list[str] | str, languages: tuple[str, ...] = tuple(EXTENSIONS)) -> DataFrame:
    """path, language, code of files with one of the languages' extensions."""
    table = {e: x for x in languages for e in EXTENSIONS[x]}
    endings = ",".join(sorted(e.lstrip(".") for e in table))
    return sources_of(documents(spark, paths, f"*.{{{endings}}}"), languages)


def sources_of(files: DataFrame, languages: tuple[str, ...] = tuple(EXTENSIONS)) -> DataFrame:
    """path, language, code of the files (path, name, document) that have one of the languages' extensions."""
    table = {e: x for x in languages for e in EXTENSIONS[x]}
    found = files.withColumn("language", lookup(F.regexp_extract("name", r"(\.[^.]+)$", 1), table)).where("language is not null")
    return found.select("path", "language", F.col("document").alias("code"))


def _with_order(df: DataFrame) -> DataFrame:
    """ord: (file name, its folder, place in the file) as one ascending string, for steps where the first row wins.

    A file may be read in several parts, each of which is one task's rows in order: the part's first byte comes first, then
    the task's own count.
    """
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    return df.withColumn("ord", F.format_string("%s:%s:%020d:%020d", name, path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def jsonl(spark: SparkSession, paths: list[str] | str, schema: T.StructType = RAW, bad: str = "reject") -> DataFrame:
    """Rows of JSON lines with ord. bad lines: 'reject' keeps them in _bad, 'drop' leaves them out, 'raise' fails."""
    reader = spark.read.option("recursiveFileLookup", True)
    if bad == "raise":
        return _with_order(reader.schema(schema).option("mode", "FAILFAST").json(paths))
    if bad == "drop":
        return _with_order(reader.schema(schema).option("mode", "DROPMALFORMED").json(paths))
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return _with_order(reader.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths))


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A table; columns and filter reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or an empty one of the schema where there's none."""
    return conform(spark.read.parquet(path), schema) if exists(spark, path) else spark.createDataFrame([], schema)


def wide_vectors(df: DataFrame, prefix: str, name: str = "vec", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Columns prefix0, prefix1, ... as one array, in the order of their numbers."""
    columns = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(*keys, F.array(*columns).alias(name))


def file_table(df: DataFrame, mapping: dict[str, str], name: str) -> DataFrame:
    """Adds what the row's file name (of documents(), or of a scan), without its ending, is mapped to."""
    file = F.col("name") if "name" in df.columns else F.col("_metadata.file_name")
    stem = df.withColumn("_stem", F.regexp_extract(file, r"^([^.]+)", 1))
    return named_table(stem, "_stem", mapping, name).drop("_stem")


def named_table(df: DataFrame, column: str, mapping: dict[str, str], name: str) -> DataFrame:
    """Adds what a column's value is mapped to, or null."""
    return df.withColumn(name, lookup(F.col(column), mapping))


def run_metrics(spark: SparkSession, glob: str, folders: bool = False) -> DataFrame:
    """run_dir with the fields of its test_metrics.json and config.json; folders that lack one are out.

    folders: the files lie under glob as tables test_metrics.json and config.json with a folder run=name each, as Spark writes them.
    """

    def files(name: str) -> DataFrame:
        if folders:
            return spark.read.text(f"{glob}/{name}", wholetext=True).select(F.col("run").cast("string").alias("run_dir"), F.col("value"))
        text = spark.read.text(f"{glob}/{name}", wholetext=True)
        return text.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_dir"), F.col("value"))

    metrics = files("test_metrics.json").select("run_dir", F.from_json("value", "macro_f1 double, accuracy double, within_1_tier_accuracy double").alias("m")).select("run_dir", "m.*")
    return metrics.join(files("config.json").select("run_dir", F.from_json("value", "seed long").alias("c")).select("run_dir", "c.seed"), "run_dir")


def nested_metrics(spark: SparkSession, path: str, metric: str = "accuracy") -> DataFrame:
    """language, value of a JSON report's per_language map, found at the top or one level down."""
    text = spark.read.text(path, wholetext=True).select("value")
    kind = f"per_language map<string, struct<{metric}: double>>, test struct<per_language: map<string, struct<{metric}: double>>>"
    parsed = text.select(F.from_json("value", kind).alias("r")).select(F.coalesce("r.per_language", "r.test.per_language").alias("p"))
    return parsed.select(F.explode("p").alias("language", "m")).select("language", F.col(f"m.{metric}").alias("value"))


def templates(spark: SparkSession, registry: dict[str, dict[str, list[str]]]) -> DataFrame:
    """language, pre_label, template, code of a registry {language: {label: [code]}}."""
    rows = spark.createDataFrame([(json.dumps(registry),)], "r string").select(F.from_json("r", "map<string, map<string, array<string>>>").alias("r"))
    labels = rows.select(F.explode("r").alias("language", "l")).select("language", F.explode("l").alias("pre_label", "codes"))
    each = labels.select("language", "pre_label", F.posexplode("codes").alias("at", "code"))
    return each.select("language", "pre_label", F.concat("language", F.lit("|"), "pre_label", F.lit("#"), F.col("at").cast("string")).alias("template"), "code")


def snippet(spark: SparkSession, code: str, path: str | None = None, language: str | None = None) -> DataFrame:
    """One snippet as a table, its language as given or from its path."""
    from textloom.functions.text import extension_language

    df = spark.createDataFrame([(code, path, language)], "code string, path string, language string")
    return df.withColumn("language", extension_language(F.col("path"), F.col("language")))


def settings_file(text: str) -> dict:
    """The settings of a YAML file of the plain kind that configurations use: `name: value` lines, where a value is a scalar, a
    list in brackets, an indented list of `- value` lines, or an indented mapping of the same kind. Comments go. Other YAML
    (anchors, block scalars, braces) is an error rather than a guess."""
    lines = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"""^((?:[^"'#]|"[^"]*"|'[^']*'|(?<=\S)#)*?)(?:(?:^|\s)#.*)?$""", r"\1", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip(), number))

    def scalar(x: str):
        if x[:1] in ("'", '"') and x[-1:] == x[0] and len(x) > 1:
            return x[1:-1]
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y.strip()) for y in x[1:-1].split(",") if y.strip()]
        if x[:1] in ("{", "&", "*", "|", ">", "!"):
            raise ValueError(f"not a plain value: {x}")
        known = {"true": True, "false": False, "null": None, "~": None, "": None}
        if x.lower() in known:
            return known[x.lower()]
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x

    def block(at: int, depth: int) -> tuple[int, dict | list]:
        listed = lines[at][1].startswith("- ")
        out: dict | list = [] if listed else {}
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- ") == listed:
            _, line, number = lines[at]
            at += 1
            if listed:
                out.append(scalar(line[2:].strip()))
                continue
            name, colon, value = line.partition(":")
            if not colon or value and value[0] != " ":
                raise ValueError(f"line {number} isn't `name: value`: {line}")
            deeper = at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- "))
            if not value.strip() and deeper:
                at, out[name.strip()] = block(at, lines[at][0])
            else:
                out[name.strip()] = scalar(value.strip())
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(f"line {lines[at][2]} is indented too far: {lines[at][1]}")
        return at, out

    if not lines:
        return {}
    at, out = block(0, lines[0][0])
    if at < len(lines) or not isinstance(out, dict):
        raise ValueError("the file isn't one mapping")
    return out


def configured(spark: SparkSession, path: str, defaults: dict, overlay: dict | None = None) -> dict:
    """Settings of a YAML file over the defaults, and those given (as on a command line) over both."""
    text = spark.read.text(path, wholetext=True).first()
    return config(defaults, settings_file(text.value) if text else {}, overlay or {})


def config(defaults: dict, *overlays: dict) -> dict:
    """Settings: later ones win, None doesn't count, unknown names are dropped."""
    out = dict(defaults)
    for overlay in overlays:
        out |= {k: v for k, v in overlay.items() if k in defaults and v is not None}
    return out


def limited(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)
