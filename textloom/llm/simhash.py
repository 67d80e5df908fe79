"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

A fingerprint has a bit for each bit of the shingles' hashes (XXH64, seed 42, of four words lower-cased in A-Z and joined by a
space, repeats included): 1 if it is set in over half of them. Two fingerprints link if they differ in at most `radius` bits.

1. Every text gets its fingerprint; equal ones collapse, so only distinct fingerprints meet.
2. Shards: the 64 bits are cut into radius + `agree` blocks. Two fingerprints that differ in at most `radius` bits are equal in
   at least `agree` blocks, so each fingerprint goes to a shard for every choice of `agree` blocks, named by the bits there.
   Every link has a shard of its own then, whatever the corpus; `agree` follows from the number of fingerprints, so that
   shards stay small.
3. Each shard has a BK-tree: a node's children are keyed by their Hamming distance to it. A search for what is within
   the radius goes down from the root and follows only the edges whose key differs from the query's distance by at most the
   radius. Trees are flat arrays; all trees and queries that a task holds are built and searched level by level at once.
4. A shard of more than `most` fingerprints is dealt out to parts with a tree each. A part's tree goes to all parts of its shard
   after it. A broadcast through the driver would pass it all fingerprints, so trees go out by a join on (shard, part):
   each tree to those who may have links with it, and to nobody else.
5. A task reduces the links that it finds to a spanning forest before they leave it. Connected components of the
   forests give the classes.

What grows: a shard of n fingerprints costs n**2 / 2 comparisons at worst (all within a few bits of each other) and
n**2 / (2 * most) moved fingerprints; copies don't count, as they are one fingerprint.

Cases: rows with a null id take no part and get no row; a null text is an empty one; a text without words has the fingerprint
zero, which links like any other; a text of fewer words than a shingle is one shingle; rows that repeat an id get a row each,
by their own text, and aren't linked by the id; ties (exactly half) leave a bit 0; an empty table gives an empty result; other
columns aren't read. Texts are whole, however long.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.shared import materialize, pieces

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints of a part of a shard; expected fingerprints of a shard; pairs of query and node that are looked at together.
PART, SHARD, FRONT = 2048, 4096, 1 << 19
U = np.uint64
#: Keys of edges: parent * EDGE + distance.
EDGE = BITS + 1


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Of a whole text; bytes.lower and bytes.split know ASCII letters and white space only."""
    parts = text.lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = list(itertools.accumulate(len(x) + 1 for x in parts))
    n = max(1, len(parts) - words + 1)
    starts = [0, *ends[: n - 1]]
    ends = ends[-n:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        hashes = np.array([digest(whole[a : b - 1], seed) for a, b in zip(starts[i : i + (1 << 14)], ends[i : i + (1 << 14)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc, fp (its 64 bits as a long) of each row with an id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                own = [fingerprint(x) for x in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc"], pa.array(own, pa.int64())], names=["doc", "fp"])

    chosen = documents.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    return chosen.where("doc is not null").mapInArrow(rows, "doc long, fp long")


def masks(count: int, radius: int = RADIUS) -> list[int]:
    """Bits of each choice of blocks, for `count` fingerprints: the fewest blocks that leave about SHARD fingerprints a shard."""
    agree = next(a for a in range(1, BITS - radius) if a == 8 or count <= SHARD << (BITS * a // (radius + a)))
    edges = [BITS * i // (radius + agree) for i in range(radius + agree + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in itertools.combinations(blocks, agree)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def shards(distinct: DataFrame, count: int, radius: int, most: int) -> DataFrame:
    """shard, part, parts, fp: a row for each fingerprint and choice of blocks."""
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(count, radius))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("shard"))
    large = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most)
    parts: Column = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    return rows.join(large, "shard", "left").select("shard", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), parts.alias("parts"), "fp")


class Forest:
    """BK-trees of several sets in flat arrays. tree: the number of each value's set, ascending, from 0 without gaps. Values of a set differ."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        self.roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        waiting = np.setdiff1d(np.arange(len(values)), self.roots, assume_unique=True)
        at = self.roots[tree[waiting]]
        edges, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(waiting):
            edge = at * EDGE + np.bitwise_count(values[waiting] ^ values[at])
            edge, first, which = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[first]  # the first to come by an edge is its child, the others go on from there
            edges.append(edge)
            children.append(child)
            left = np.ones(len(waiting), bool)
            left[first] = False
            waiting, at = waiting[left], child[which[left]]
        self.edges, self.children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def within(self, queries: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of a query, place of a value) for all values within the radius in the tree of each query's root."""
        query, at, found = np.arange(len(queries)), root, []
        while len(query):
            far = np.bitwise_count(queries[query] ^ self.values[at]).astype(np.int64)
            on = far <= radius
            found.append((query[on], at[on]))
            low = np.searchsorted(self.edges, at * EDGE + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edges, at * EDGE + np.minimum(far + radius, BITS), side="right")
            many = high - low
            ends = np.cumsum(many)
            at = self.children[np.repeat(low - ends + many, many) + np.arange(ends[-1])]
            query = np.repeat(query, many)
        return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (query, at)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of each group) with the groups of each a and b made one."""
    while True:
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            return label
        a, b = a[on], b[on]
        np.minimum.at(label, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))
        while (label[label] != label).any():
            label = label[label]


def slices(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of queries that look at no more than FRONT nodes together, or of one query."""
    ends, start = np.cumsum(weights), 0
    while start < len(weights):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONT, side="right")))
        yield start, stop
        start = stop


def forest_links(values: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of each set: a value and the first of its group."""
    forest = Forest(values, tree)
    sizes = np.diff(np.append(forest.roots, len(values)))
    label = np.arange(len(values))
    for a, b in slices(sizes[tree]):
        query, node = forest.within(values[a:b], forest.roots[tree[a:b]], radius)
        label = merged(label, query + a, node)
    on = np.flatnonzero(label != np.arange(len(values)))
    return values[on], values[label[on]]


def cross_links(own: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of two parts, as far as they come from links between the parts."""
    forest = Forest(own, np.zeros(len(own), np.int64))
    label, values = np.arange(len(own) + len(others)), np.concatenate([own, others])
    for a, b in slices(np.full(len(others), len(own))):
        query, node = forest.within(others[a:b], np.zeros(b - a, np.int64), radius)
        label = merged(label, query + a + len(own), node)
    on = np.flatnonzero(label != np.arange(len(values)))
    return values[on], values[label[on]]


LINKS = "a long, b long, shard long, part int, parts int, tree binary"
KINDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shard", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("tree", pa.binary())])


def links(distinct: DataFrame, radius: int = RADIUS, most: int = PART) -> DataFrame:
    """a, b: links that join the same fingerprints as all pairs within the radius do. distinct: a stored table of distinct fp."""
    rows = shards(distinct, distinct.count(), radius, most)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole parts, several at once; what comes last may go on in the next batch."""

        def done(shard, part, parts, fp) -> Iterator[pa.RecordBatch]:
            tree = np.cumsum(np.append(False, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])))
            a, b = forest_links(fp.view(U), tree, radius)
            if len(a):
                nothing = [pa.nulls(len(a), x.type) for x in list(KINDS)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *nothing], schema=KINDS)
            for i in np.flatnonzero(np.append(True, tree[1:] != tree[:-1]) & (parts > 1)).tolist():
                values = fp[tree == tree[i]].tobytes()
                yield pa.RecordBatch.from_pylist([{"shard": int(shard[i]), "part": int(part[i]), "parts": int(parts[i]), "tree": values}], KINDS)

        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("shard", "part", "parts", "fp")]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            shard, part = held[:2]
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1]))
            if len(edges):
                cut = int(edges[-1]) + 1
                yield from done(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield from done(*held)

    sorted_ = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")
    found = materialize(sorted_.mapInArrow(own, LINKS), "shards")
    trees = found.where("tree is not null").select("shard", "part", "parts", "tree")
    spread = trees.where("part < parts - 1").withColumn("other", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)))
    met = spread.select("shard", F.col("other").alias("part"), "tree").join(trees.select("shard", "part", F.col("tree").alias("queries")), ["shard", "part"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, queries = (np.frombuffer(batch[c][i].as_buffer(), "<u8") for c in ("tree", "queries"))
                a, b = cross_links(tree, queries, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return found.where("a is not null").select("a", "b").union(met.select("tree", "queries").mapInArrow(between, "a long, b long"))


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, most: int = PART) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id (the smallest id that links lead to) of every row with an id."""
    own = materialize(fingerprints(documents, id_column, text_column), "fingerprints")
    firsts = materialize(own.groupBy("fp").agg(F.min("doc").alias("doc")), "distinct")
    whole = components(links(firsts.select("fp"), radius, most))
    rooted = firsts.join(whole, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(F.col("doc").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
