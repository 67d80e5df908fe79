"""Files that a query writes: how many, and what they hold."""

import pytest
from pyspark.sql import functions as F

from textloom.plans import catalog, table_queries
from textloom.sources import readers, sinks


@pytest.mark.parametrize("name", ["file_order", "lines_by_place"])
def test_files_of_lines_grow_with_the_rows(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(table_queries, "ROWS", 50, raising=False)
    spark.range(1000).selectExpr("999 - id as doc_id", "concat('t', id) as text", "'s' as source", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(table_queries, "place", lambda *_: f"{tmp_path}/out")
    rows = catalog.queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.place: r.doc_id for r in rows} == {i: None if name == "lines_by_place" and i % 7 == 0 else i for i in range(1000)}
    parts = [len(x.read_text().splitlines()) for x in (tmp_path / "out").glob("part-*")]
    assert sum(parts) == 1000 and max(parts) < 150


@pytest.mark.parametrize("name", ["language_by_file", "source_files"])
def test_small_files_are_dealt_to_folders(spark, tmp_path, monkeypatch, name):
    """No folder, and so no task, has many files, and files are read by few tasks."""
    monkeypatch.setattr(table_queries, "FILES", 50, raising=False)
    spark.range(1000).selectExpr("id as doc_id", "concat('t', id) as text", "'s' as source", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(table_queries, "place", lambda *_: f"file://{tmp_path}/out")
    rows = catalog.queries.QUERIES[name](spark, str(tmp_path))
    names = {0: "python", 1: "java", 2: None} if name == "language_by_file" else {0: "python", 1: "rust"}
    assert {r.doc_id: r.language for r in rows.collect()} == {i: names[i % len(names)] for i in range(1000) if name == "language_by_file" or i % 5}
    sizes = [len(list(x.iterdir())) for x in (tmp_path / "out").iterdir()]
    assert sum(sizes) == 1000 and max(sizes) < 100 and rows.rdd.getNumPartitions() < 65


def test_folders_give_what_a_scan_gives_and_empty_files(spark, tmp_path):
    held = {"a b/x.py": b"caf\xc3\xa9", "a b/deep/y.rs": b"", "a b/.hidden.py": b"no", "c%20d/z.py": b"\xff\n", "_out/n.py": b"no", "c%20d/_m/n.py": b"no", "c%20d/z.txt": b"t", "loose.py": b"1\n2"}
    for name, data in held.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for pattern in ("*", "*.{py,rs}"):
        found = readers.documents(spark, str(tmp_path), pattern).select("path", "name", F.hex(F.col("document").cast("binary")))
        scan = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select("_metadata.file_path", "_metadata.file_name", F.hex(F.col("value").cast("binary")))
        rows = sorted(map(tuple, found.collect()))
        assert [r for r in rows if r[2]] == sorted(map(tuple, scan.collect()))
        assert [r[1] for r in rows if not r[2]] == ["y.rs"]  # a scan leaves empty files out


def test_files_of_one_folder_without_folders(spark, tmp_path):
    assert sinks.files(spark.createDataFrame([("a", "1"), ("b", None)], "name string, document string"), f"file://{tmp_path}/flat") == 2
    assert {(r.name, r.document) for r in readers.documents(spark, f"file://{tmp_path}/flat").collect()} >= {("a", "1")}
