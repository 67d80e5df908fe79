"""Vectors in shards: what exact search and the neighbour graph share.

Rows become blobs of at most `shard_rows` vectors within the tasks that scan them, so no key decides where a row goes. Query
blobs are dealt out to groups of about QUERY_BYTES, shards to cells; a tile is a group and a cell, and one task's work: it
holds the group, meets the cell's shards one after another, and keeps the best k of each query over all of them before anything
leaves it. That is a stated query set against all rows, in blocks. There are as many tiles as the cluster has slots, or as there are groups
if that is more: a query travels once a cell, a shard once a group. So while all queries are one group, what moves grows with the
rows, and beyond that with queries / QUERY_BYTES times the shards. A window over the tiles' lists keeps the best k of those.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import materialize

#: Bytes of queries that a task holds.
QUERY_BYTES = 64 << 20


def batch_vectors(ids: pa.Array, vectors: pa.Array, zeros: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows of float64) by dimension; without null ids or vectors, null or non-finite components, empty vectors and, unless `zeros`, zero vectors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.cast(pa.float64(), safe=False)
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = vectors.offsets.to_numpy()[:-1]
    known = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    numbers = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[known]):
        at = np.flatnonzero(known & (lengths == d))
        rows = values[starts[at][:, None] + np.arange(d)]
        good = np.isfinite(rows).all(axis=1)
        if not zeros:
            good &= (rows != 0).any(axis=1)
        if good.any():
            yield numbers[at[good]], rows[good]


def blobs(df: DataFrame, id_column: str, vector_column: str, most: int, zeros: bool, make: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, bytes]]) -> DataFrame:
    """Rows (blob long, dim int, n int, ids binary, rows binary): at most `most` vectors each, as make() orders and packs them. blob: the task and a count, so a
    task that is run again gives the same rows."""

    def packed(number: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        kinds = [("blob", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]
        ids, raw = make(ids, rows)
        return pa.RecordBatch.from_pydict({"blob": [(TaskContext.get().partitionId() << 32) + number], "dim": [rows.shape[1]], "n": [len(ids)], "ids": [ids.astype("<i8").tobytes()], "rows": [raw]}, pa.schema(kinds))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        done = 0
        for batch in batches:
            for ids, rows in batch_vectors(batch["id"], batch["vector"], zeros):
                for i in range(0, len(ids), most):
                    own = held.setdefault(rows.shape[1], [])
                    own.append((ids[i : i + most], rows[i : i + most]))
                    if sum(len(x) for x, _ in own) >= most:
                        all_ids, all_rows = (np.concatenate(x) for x in zip(*own))
                        yield packed(done, all_ids[:most], all_rows[:most])
                        done += 1
                        held[rows.shape[1]] = [(all_ids[most:], all_rows[most:])] if len(all_ids) > most else []
        for own in held.values():
            if own:
                yield packed(done, *(np.concatenate(x) for x in zip(*own)))
                done += 1

    chosen = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    return chosen.mapInArrow(cut, "blob long, dim int, n int, ids binary, rows binary")


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, descending: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, ties to the smaller vec."""
    order = np.lexsort((v, ~s if descending else s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q)
    on = np.arange(len(q)) - first < k
    return q[on], v[on], s[on]


def search(queries: DataFrame, shards: DataFrame, opened: Callable[[dict], object], compare: Callable, k: int, score: str, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of what compare(query row, opened shard) yields as (query, vec, score) arrays.

    queries and shards: tables with blob, dim, ids, rows and what else opened() needs of a shard.
    """
    spark = queries.sparkSession
    size = queries.agg(F.sum(F.length("ids") + F.length("rows"))).first()[0] or 0
    groups = max(1, math.ceil(size / QUERY_BYTES))
    cells = max(1, math.ceil(spark.sparkContext.defaultParallelism / groups))
    dealt = lambda n: F.pmod(F.xxhash64("blob"), F.lit(n)).cast("int")
    asked = queries.select("blob", "dim", "ids", "rows", F.lit(False).alias("is_shard"), dealt(groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    met = shards.select("*", F.lit(True).alias("is_shard"), dealt(cells).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    rows = asked.unionByName(met, allowMissingColumns=True).withColumn("tile", F.col("group") * cells + F.col("cell")).drop("group", "cell")
    kind = pa.float64() if score == "double" else pa.int64()
    names = ("query_id", "vec_id", "score")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries come first, so they are held when the first shard comes."""
        held: list[dict] = []
        best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64 if score == "double" else np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if not row["is_shard"]:
                    held.append(row)
                    continue
                shard, parts = opened(row), [best]
                for own in held:
                    if own["dim"] == row["dim"]:
                        q, v, x = compare(own, shard)
                        if len(q):
                            parts.append((np.asarray(q, np.int64), np.asarray(v, np.int64), np.asarray(x, best[2].dtype)))
                best = best_of(*(np.concatenate(x) for x in zip(*parts)), k, descending)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(best, (pa.int64(), pa.int64(), kind))], names=list(names))

    tiles = rows.repartitionById(groups * cells, "tile").sortWithinPartitions("is_shard", "blob")
    lists = tiles.mapInArrow(found, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if descending else F.asc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def stored(df: DataFrame, what: str) -> DataFrame:
    return materialize(df, what)


def ids_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def rows_of(blob: bytes, dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(blob, dtype).reshape(-1, dim)
