"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, one per term (dimension). A shard is stored as postings: for each term, the
places of the rows that have a weight other than 0, and these weights; a list that every row is in needs no places. Query
rows are stored as their terms and weights. For a block of query rows and a shard, each term of a query scatters its weight
times the postings' weights into the query's dense array of scores; a partition then selects the best k of each query,
and the shards' lists are merged.

Cases: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate; nor do
rows with a null id. Ties go to the smaller id. A row isn't a candidate of a query with its own id, so repeated rows of
one id don't find each other, but are candidates of others each. Vectors only meet those of the same length. Weights of any
size are exact integers, and scores are exact; a score beyond a long is the nearest long, and counts as that in the order.
An empty table gives an empty result. Columns besides the two named aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import vectors as V

SHARD_ROWS, QUERY_ROWS = 8192, 256
LONG = np.iinfo(np.int64)


def sparse(rows: np.ndarray, by_term: bool) -> bytes:
    """Rows as lists of (place, weight) by term, or by row: sizes, then places of lists that lack some, then weights.

    Weights are doubles that hold integers, so none is too large.
    """
    lists = rows.T if by_term else rows
    held = [np.flatnonzero(x) for x in lists]
    sizes = np.array([len(x) for x in held], "<i4")
    places = [x for x in held if len(x) < lists.shape[1]]
    weights = np.concatenate([x[at] for x, at in zip(lists, held)]) if len(held) else np.empty(0)
    return sizes.tobytes() + np.concatenate([np.empty(0, np.int64), *places]).astype("<i4").tobytes() + weights.astype("<f8").tobytes()


def lists_of(blob: bytes, count: int, width: int) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """(places, or None for all of them, weights) of each of the `count` lists of sparse(); width: the places that there are."""
    sizes = np.frombuffer(blob, "<i4", count)
    listed = np.where(sizes < width, sizes, 0)
    places = np.frombuffer(blob, "<i4", int(listed.sum()), 4 * count)
    weights = np.frombuffer(blob, "<f8", int(sizes.sum()), 4 * (count + len(places)))
    ends, upto = np.cumsum(sizes).tolist(), np.cumsum(listed).tolist()
    return [(None if n == width else places[p - n : p], weights[e - n : e]) for n, e, p in zip(sizes.tolist(), ends, upto)]


def accumulate(queries: list, postings: list, rows: int) -> np.ndarray:
    """Scores (queries x rows), term by term. They are exact: in 64 bits where no sum can leave them, else in Python's integers."""
    most = [max((float(np.abs(w).max(initial=0)) for _, w in lists), default=0.0) for lists in (queries, postings)]
    wide = most[0] * most[1] * max(1, len(postings)) >= 2.0**62
    kind = object if wide else np.int64

    def exact(w: np.ndarray) -> np.ndarray:
        return np.array([int(x) for x in w], object) if wide else w.astype(np.int64)

    postings = [(places, exact(w)) for places, w in postings]
    scores = np.zeros((len(queries), rows), kind)
    for own, (terms, weights) in zip(scores, queries):
        for term, weight in zip(range(len(postings)) if terms is None else terms.tolist(), exact(weights)):
            places, w = postings[term]
            if places is None:
                own += weight * w
            else:
                own[places] += weight * w
    return np.clip(scores, LONG.min, LONG.max).astype(np.int64) if wide else scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row of scores, ties to the smaller id: flat (row, position, score). ids ascend; own: the rows' ids."""
    rows, places, values = [], [], []
    for i, s in enumerate(scores):
        allowed = np.flatnonzero(ids != own[i])
        s = s[allowed]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            at = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
        else:
            at = np.arange(len(s))
        rows.append(np.full(len(at), i))
        places.append(allowed[at])
        values.append(s[at])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, places, values))


def top_k(queries: DataFrame, candidates: DataFrame, k: int, weight: float, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(weight * x) vectors."""

    def floors(rows: np.ndarray) -> np.ndarray:
        return np.floor(weight * rows)

    def postings(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, bytes]:
        order = np.argsort(ids, kind="stable")
        return ids[order], sparse(floors(rows[order]), True)

    blocks = V.stored(V.blobs(queries, id_column, vector_column, query_rows, True, lambda ids, rows: (ids, sparse(floors(rows), False))), "queries")
    shards = V.stored(V.blobs(candidates, id_column, vector_column, shard_rows, True, postings), "shards")

    def opened(row: dict) -> tuple[np.ndarray, list]:
        ids = V.ids_of(row["ids"])
        return ids, lists_of(row["rows"], row["dim"], len(ids))

    def compare(query: dict, shard: tuple[np.ndarray, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, (ids, terms) = V.ids_of(query["ids"]), shard
        q, at, s = select(accumulate(lists_of(query["rows"], len(own), query["dim"]), terms, len(ids)), ids, own, k)
        return own[q], ids[at], s

    return V.search(blocks, shards, opened, compare, k, "long", True)


def chosen(df: DataFrame, id_column: Column | str, divisor: int) -> DataFrame:
    """Rows whose id is divisible by divisor: the stated queries."""
    return df.where(F.col(id_column) % divisor == 0)
