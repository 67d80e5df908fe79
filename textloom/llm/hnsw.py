"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, with shard results merged.

A shard has at most SHARD_ROWS rows, so a graph's search takes as many steps as the logarithm of that, and there are as
few graphs as memory allows: a task holds one shard at a time, of SHARD_ROWS * (8 d + 8 m + 24) bytes and the same again
while it is packed (54 MB for 64 dimensions). A shard's distinct vectors are the nodes. Layers are flat arrays of neighbour numbers (-1: free), of width 2m at the
ground and m above. A vector that many rows share is one node with the smallest ids of its rows, as many as a result can
hold; so copies neither cut the graph up nor crowd each other out. Searches return ef nodes, whose distances are then
computed in double precision on the original vectors; shards' lists are merged.

Cases: vectors that are null, zero, empty or hold null or non-finite components take no part, as query or candidate; nor
do rows with a null id. Ties go to the smaller id. A row isn't a candidate of a query with its own id. Vectors only meet
those of the same length. An empty table gives an empty result. Columns besides the two named aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import vectors as V

SHARD_ROWS, QUERY_ROWS, M, EF_BUILD, EF_SEARCH = 32_768, 256, 16, 64, 160


class Graph:
    """layers: int32 arrays (nodes x width); entry: the node to start from, on the top layer."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], entry: int):
        self.points, self.layers, self.entry = points, layers, entry
        self.norms = np.einsum("ij,ij->i", points, points)

    def far(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance, less the query's own part, which is the same for all."""
        return self.norms[at] - 2.0 * (self.points[at] @ q)

    def descend(self, q: np.ndarray, entry: int, top: int, down_to: int) -> int:
        """The nearest node by greedy steps on the layers from top to down_to."""
        best = float(self.far(q, np.array([entry]))[0])
        for layer in range(top, down_to - 1, -1):
            while True:
                near = self.layers[layer][entry]
                near = near[near >= 0]
                if not len(near):
                    break
                d = self.far(q, near)
                i = int(d.argmin())
                if d[i] >= best:
                    break
                best, entry = float(d[i]), int(near[i])
        return entry

    def around(self, q: np.ndarray, entry: int, layer: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on a layer, nearest first."""
        d = float(self.far(q, np.array([entry]))[0])
        seen = np.zeros(len(self.points), bool)
        seen[entry] = True
        open_, kept, flat = [(d, entry)], [(-d, entry)], self.layers[layer]
        while open_:
            d, at = heapq.heappop(open_)
            if d > -kept[0][0] and len(kept) >= ef:
                break
            near = flat[at]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for x, n in zip(self.far(q, near).tolist(), near.tolist()):
                if len(kept) < ef:
                    heapq.heappush(kept, (-x, n))
                    heapq.heappush(open_, (x, n))
                elif x < -kept[0][0]:
                    heapq.heapreplace(kept, (-x, n))
                    heapq.heappush(open_, (x, n))
        return sorted((-x, n) for x, n in kept)


def diverse(points: np.ndarray, at: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those that are nearer to the node than to any taken before; then the nearest others."""
    own = points[at]
    between = np.einsum("ij,ij->i", own, own)
    apart = between[:, None] + between[None, :] - 2.0 * (own @ own.T)
    taken, left = [], []
    for i in range(len(at)):
        if len(taken) == most:
            break
        (taken if not taken or (apart[i, taken] > d[i]).all() else left).append(i)
    return at[(taken + left)[:most]]


def build(points: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 0) -> Graph:
    """Insert the points one by one, each on the layers up to its random level."""
    n = len(points)
    levels = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(m)).astype(int), 6)
    layers = [np.full((n, 2 * m if x == 0 else m), -1, np.int32) for x in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(points, layers, 0)
    top = int(levels[0])
    for node in range(1, n):
        q, level, entry = points[node], int(levels[node]), graph.entry
        if top > level:
            entry = graph.descend(q, entry, top, level + 1)
        own = float(graph.norms[node])
        for layer in range(min(level, top), -1, -1):
            flat = layers[layer]
            width = flat.shape[1]
            found = graph.around(q, entry, layer, ef)
            entry = found[0][1]
            at = np.array([x for _, x in found])
            near = diverse(points, at, np.array([x for x, _ in found]) + own, m)
            flat[node, : len(near)] = near
            for other in near.tolist():
                row = flat[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    crowd = np.append(row, node)
                    d = graph.far(points[other], crowd) + graph.norms[other]
                    order = np.argsort(d, kind="stable")
                    picked = diverse(points, crowd[order], d[order], width)
                    row[:] = -1
                    row[: len(picked)] = picked
        if level > top:
            top, graph.entry = level, node
    return graph


def _packed(graph: Graph) -> tuple[bytes, list[int]]:
    """Neighbours of all layers in one flat array. Layers above the ground keep only nodes that have neighbours there."""
    parts = [graph.layers[0].ravel()]
    for layer in graph.layers[1:]:
        used = np.flatnonzero((layer >= 0).any(axis=1))
        parts += [np.array([len(used)], np.int32), used.astype(np.int32), layer[used].ravel()]
    return np.concatenate(parts).astype("<i4").tobytes(), [graph.entry, len(graph.layers)]


def _unpacked(points: np.ndarray, blob: bytes, entry: int, n_layers: int, m: int) -> Graph:
    flat, n = np.frombuffer(blob, "<i4"), len(points)
    layers, at = [flat[: n * 2 * m].reshape(n, 2 * m)], n * 2 * m
    for _ in range(n_layers - 1):
        used = flat[at + 1 : at + 1 + flat[at]]
        layer = np.full((n, m), -1, np.int32)
        layer[used] = flat[at + 1 + len(used) : at + 1 + len(used) * (m + 1)].reshape(-1, m)
        at += 1 + len(used) * (m + 1)
        layers.append(layer)
    return Graph(points, layers, entry)


def as_doubles(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    return ids, np.ascontiguousarray(rows, "<f8").tobytes()


def index(candidates: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", keep: int = 11, shard_rows: int = SHARD_ROWS, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """Every row in a graph: a row per shard with its distinct vectors, their rows' ids (the `keep` smallest) and the flat graph."""
    raw = V.blobs(candidates, id_column, vector_column, shard_rows, False, as_doubles)

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("blob", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("rows", pa.binary()), ("flat", pa.binary()), ("entry", pa.int32()), ("layers", pa.int32())])
        for batch in batches:
            for blob, dim, ids, rows in zip(*(batch[c].to_pylist() for c in ("blob", "dim", "ids", "rows"))):
                ids, rows = V.ids_of(ids), V.rows_of(rows, dim, "<f8") + 0.0  # -0.0 is 0.0
                points, member = np.unique(rows, axis=0, return_inverse=True)
                order = np.lexsort((ids, member.ravel()))
                member, ids = member.ravel()[order], ids[order]
                place = np.arange(len(ids)) - np.searchsorted(member, member)
                member, ids = member[place < keep], ids[place < keep]
                shuffled = np.random.default_rng(1).permutation(len(points))  # sorted points would make poor long links
                new = np.empty(len(points), int)
                new[shuffled] = np.arange(len(points))
                order = np.argsort(new[member], kind="stable")
                counts = np.bincount(new[member], minlength=len(points))
                points = points[shuffled]
                flat, (entry, n_layers) = _packed(build(points, m, ef))
                values = [[blob], [dim], [ids[order].astype("<i8").tobytes()], [counts.astype("<i4").tobytes()], [points.tobytes()], [flat], [entry], [n_layers]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, kinds)], schema=kinds)

    return V.stored(raw.repartition(max(2, candidates.sparkSession.sparkContext.defaultParallelism)).mapInArrow(graphs, "blob long, dim int, ids binary, counts binary, rows binary, flat binary, entry int, layers int"), "hnsw")


def nearest(queries: DataFrame, graphs: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", ef: int = EF_SEARCH, query_rows: int = QUERY_ROWS, m: int = M) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by Euclidean distance. graphs: of index(), with keep > k."""
    blocks = V.stored(V.blobs(queries, id_column, vector_column, query_rows, False, as_doubles), "queries")

    def opened(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
        graph = _unpacked(V.rows_of(row["rows"], row["dim"], "<f8"), row["flat"], row["entry"], row["layers"], m)
        return graph, V.ids_of(row["ids"]), np.cumsum(np.frombuffer(row["counts"], "<i4"))

    def compare(query: dict, shard: tuple[Graph, np.ndarray, np.ndarray]) -> tuple[list, list, list]:
        graph, ids, ends = shard
        own, asked = V.ids_of(query["ids"]), V.rows_of(query["rows"], query["dim"], "<f8")
        out: list[tuple[int, int, float]] = []
        for q_id, q in zip(own.tolist(), asked):
            entry = graph.descend(q, graph.entry, len(graph.layers) - 1, 1) if len(graph.layers) > 1 else graph.entry
            at = np.array([x for _, x in graph.around(q, entry, 0, max(ef, k + 1))])
            far = np.sqrt(((graph.points[at] - q) ** 2).sum(axis=1))
            found = sorted((d, i) for d, x in zip(far.tolist(), at.tolist()) for i in ids[(ends[x - 1] if x else 0) : ends[x]].tolist() if i != q_id)
            out += [(q_id, i, d) for d, i in found[:k]]
        return tuple(zip(*out)) if out else ([], [], [])

    return V.search(blocks, graphs, opened, compare, k, "double", False)
