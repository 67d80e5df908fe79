"""Ordered JSON lines: byte ranges of any size give each line once, at its place."""

import pytest
from pyspark.sql import types as T

from textloom.sources import lines

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
FILES = {
    "x/a.jsonl": b'{"a": 1, "b": "one"}\n\n{"a": 2}\r\n  \n{"a": 3, "b": "\xc3\xa9"}',
    "x/a!.jsonl": b'{"a": 4}\n{broken\n',
    "y/a.jsonl": b'{"a": 5}\n{"a": "six", "b": "t"}\n[7]\n',
    "y/empty.jsonl": b"",
    "y/_SUCCESS": b"",
    "y/.hidden": b'{"a": 9}\n',
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_each_line_once_at_its_place(spark, folder, size):
    got = [tuple(r) for r in lines.raw(spark, folder, size).orderBy("file", "at").collect()]
    want, order = [], sorted((n.rsplit("/", 1)[1], n) for n in FILES if not n.rsplit("/", 1)[1].startswith(("_", ".")))
    for i, (_, name) in enumerate(order):
        at = 0
        for line in FILES[name].splitlines(keepends=True):
            if line.strip():
                want.append((i, at, line.rstrip(b"\r\n").decode()))
            at += len(line)
    assert got == want and [n for _, n in order][0] == "x/a!.jsonl"


def test_fields_and_reasons(spark, folder):
    rows = lines.jsonl(spark, [f"{folder}/x", f"{folder}/y"], SCHEMA).orderBy("file", "at").collect()
    assert [(r.a, r.b) for r in rows if r.reason is None] == [(4, None), (1, "one"), (2, None), (3, "é"), (5, None)]
    assert sorted(r.reason for r in rows if r.reason) == ["a field of another type", "not JSON", "not an object"]
    assert all((r._bad is None) == (r.reason is None) for r in rows)
    assert lines.jsonl(spark, f"{folder}/y/empty.jsonl", SCHEMA).count() == 0
