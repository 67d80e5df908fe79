"""URL filters: a trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and every subdomain of it when the url's path starts with the rule's
path. Of the rules that fit, the one with the most host labels wins, then the one with the longest path; a url that no
rule fits gets the default verdict.

Cases: a null url or one without "://" has an empty host and path, fits no rule that names a host, and gets the default
verdict. Empty hosts and paths, repeated rows and very long urls need no special care. An empty table gives an empty
result. Columns of the input other than the id and the url aren't read, so their names can't clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast as a trie of up to this many bytes, as measured; beyond, they're joined (see `judge`).
MAX_TRIE_BYTES = 64 << 20


@dataclass
class Node:
    """hosts: by the next label to the left; paths: by the next segment with its slash; tails: rules that end within a segment."""

    hosts: dict[str, Node] = field(default_factory=dict)
    paths: dict[str, Node] = field(default_factory=dict)
    tails: list[tuple[str, tuple[str, str]]] = field(default_factory=list)
    here: tuple[str, str] | None = None


def segments(path: str) -> list[str]:
    """Segments with their closing slash; only the last can lack it."""
    parts = path.split("/")
    return [f"{x}/" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def build(rules: list[tuple[str, str, str]]) -> Node:
    """A trie of (verdict, host, path). The first of several equal rules counts."""
    root = Node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.hosts.setdefault(label, Node())
        found = (f"{host}{path}", verdict)
        *whole, last = segments(path) or [""]
        for segment in whole if last and not last.endswith("/") else [*whole, last] * bool(last):
            node = node.paths.setdefault(segment, Node())
        if last and not last.endswith("/"):
            node.tails.append((last, found))
            node.tails.sort(key=lambda x: -len(x[0]))
        elif node.here is None:
            node.here = found
    return root


def size_of(root: Node) -> int:
    """Bytes of a trie in memory: its nodes, tables, lists and texts."""
    total, stack = 0, [root]
    while stack:
        node = stack.pop()
        parts = [node, node.__dict__, node.hosts, node.paths, node.tails, *node.hosts, *node.paths, *(x for tail, found in node.tails for x in (tail, found, found[0]))]
        total += sum(map(sys.getsizeof, parts + ([node.here, node.here[0]] if node.here else [])))
        stack += [*node.hosts.values(), *node.paths.values()]
    return total


def _by_path(node: Node, parts: list[str]) -> tuple[str, str] | None:
    best = None
    for part in parts:
        best = next((found for tail, found in node.tails if part.startswith(tail)), None) or node.here or best
        if (node := node.paths.get(part)) is None:
            return best
    return node.here or best


def longest(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule that wins for a host and path, with its verdict."""
    parts, best, node = segments(path), None, root
    for label in reversed(host.split(".")):
        if (node := node.hosts.get(label)) is None:
            break
        best = _by_path(node, parts) or best
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, F.lit("://")) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id", url_column: str = "url", default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row.

    The trie is broadcast, which is sound as its bytes are measured against max_trie_bytes. More rules than that are joined
    on (host suffix, path prefix) instead, with the same result.
    """
    host, path = host_and_path(pages[url_column])
    parsed = pages.select(pages[id_column].alias(id_column), host.alias("host"), path.alias("path"))
    # a trie never takes fewer bytes than its rules' texts, so it isn't built in vain
    root = None if sum(len(h) + len(p) for _, h, p in rules) > max_trie_bytes else build(rules)
    if root is None or size_of(root) > max_trie_bytes:
        return _joined(parsed, rules, id_column, default)
    held = pages.sparkSession.sparkContext.broadcast(root)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = held.value
        for batch in batches:
            found = [longest(root, h, p) or (None, default) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    kind = dict(parsed.dtypes)[id_column]
    return parsed.mapInArrow(rows, f"`{id_column}` {kind}, host string, path string, rule string, verdict string")


def _joined(parsed: DataFrame, rules: list[tuple[str, str, str]], id_column: str, default: str) -> DataFrame:
    """For rules that are too many to broadcast: each distinct (host, path) meets the rules through an equi-join on
    its host suffixes; the path test follows, and max_by picks the winner with map-side combining."""
    spark = parsed.sparkSession
    table = spark.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(rules)], "verdict string, rule_host string, rule_path string, n long")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = parsed.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host")
    best = wide.where(F.expr("startswith(path, rule_path)")).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host"), F.length("rule_path"), -F.col("n"))).alias("best")
    )
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
