"""Bloom filters of keys as a partial aggregate, sent ahead of exact joins.

Each task sets the bits of its own rows' keys; parts of the bits are joined by or, so filters merge in any order and over any number of
tasks. The size follows from a count, BITS a key, up to MOST (16 MB): beyond that the filter lets more through, but loses nothing, as
the exact join comes after. It saves moving rows that can't have a partner, so it pays where most have none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, at least and at most in all, and parts that they are merged in.
BITS, LEAST, MOST, PARTS = 16, 1 << 13, 1 << 27, 64


def places(hashes: np.ndarray, bits: int, count: int = 4) -> Iterator[np.ndarray]:
    """`count` bits of each 64-bit hash: its halves, combined."""
    x = hashes.view(np.uint64)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(count):
        yield ((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """The bits, as bytes. A null key is in no filter."""

    def __init__(self, field: np.ndarray):
        self.field = field

    def has(self, hashes: np.ndarray) -> np.ndarray:
        on = np.ones(len(hashes), bool)
        for at in places(hashes, len(self.field) * 8):
            on &= (self.field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return on


def known(keys: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def built(df: DataFrame, keys: list[str], bits: int | None = None) -> Filter:
    """Of a table's keys. bits: a power of two; by a count of the rows if not given."""
    rows = df.where(known(keys)).select(F.xxhash64(*keys).alias("h"))
    size = bits or min(MOST, max(LEAST, 1 << (BITS * rows.count()).bit_length()))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in places(batch["h"].to_numpy(), size):
                np.bitwise_or.at(field, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = [(i, x.tobytes()) for i, x in enumerate(np.split(field, PARTS)) if x.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "field"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch["part"].to_pylist(), batch["field"].to_pylist()):
                x = np.frombuffer(x, np.uint8)
                held[i] = held[i] | x if i in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "field"])

    schema, out = "part int, field binary", np.zeros((PARTS, size // 8 // PARTS), np.uint8)
    for row in rows.mapInArrow(own, schema).repartition("part").mapInArrow(merged, schema).collect():  # MOST bits at most
        out[row.part] = np.frombuffer(row.field, np.uint8)
    return Filter(out.ravel())


def may_have(df: DataFrame, keys: list[str], found: Filter) -> Column:
    """Whether a row's keys may be in the filter; only the hash goes to Python, in Arrow batches."""
    held = df.sparkSession.sparkContext.broadcast(found.field)

    @F.pandas_udf("boolean")
    def test(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Filter(held.value)
        for h in parts:
            yield pd.Series(own.has(h.to_numpy()))

    return known(keys) & test(F.xxhash64(*keys))  # hashes are never null: a column with nulls would come as floats


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table has: what the filter lets through meets it in an exact join."""
    return df.where(may_have(df, keys, built(other, keys))).join(other.select(*keys), keys, "left_semi")


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table doesn't have: those that the filter denies stay where they are, the rest meets it in an exact join.
    df is read twice."""
    may = may_have(df, keys, built(other, keys))
    return df.where(~may).unionByName(df.where(may).join(other.select(*keys), keys, "left_anti").select(*df.columns))
