"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary's byte strings resolves a pre-token that is in the vocabulary as a
whole. Tier two, for the others: a heap of adjacent pairs by (rank, place) over the pre-token's bytes, linked to their
neighbours; a merge relinks them and pushes the two pairs that it makes. Decoding gathers the ids' bytes.

Cases: a null text is an empty one; an empty text has no ids; a pre-token of any length is merged whole, in n log n;
equal texts get equal ids; an empty table gives an empty result; columns besides the id and the text aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.pretokens import Lexicon, splitter
from textloom.llm.shared import pieces

GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: a bucket's displacement sends its keys to free slots.

    A lookup reads one displacement and one slot, and compares the key that the slot holds.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(set(hashes.tolist())) < n:
            raise ValueError("two keys have the same hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        self.moves = np.zeros(self.buckets, np.uint64)
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-counts, kind="stable").tolist():
            own = order[ends[b] - counts[b] : ends[b]]
            if not len(own):
                break
            move = 0
            while True:
                at = self._slots(hashes[own], np.uint64(move))
                if free[at].all() and len(np.unique(at)) == len(at):
                    break
                move += 1
            self.moves[b] = move
            free[at] = False
            for k, slot in zip(own.tolist(), at.tolist()):
                self.keys[slot], self.values[slot] = keys[k], k

    def _slots(self, hashes: np.ndarray, moves: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hashes + (moves + np.uint64(1)) * np.uint64(GOLDEN)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key in the list that was given to build, or -1."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        slots = self._slots(hashes, self.moves[(hashes % np.uint64(self.buckets)).astype(np.int64)])
        held = self.keys
        same = np.fromiter((held[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(same, self.values[slots], -1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank, leftmost first, merges until no pair has a rank."""
    n, rank = len(word), ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [rank(word[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    # An entry is rank * span + place: one integer compares as (rank, place).
    span = n + 1
    heap = [r * span + i for i, r in enumerate(pair) if r is not None]
    heapq.heapify(heap)
    own = [rank(word[i : i + 1]) for i in range(n)]
    while heap:
        r, i = divmod(heapq.heappop(heap), span)
        if pair[i] != r:
            continue  # one of its halves has merged since
        j = after[i]
        k = after[j]
        own[i], after[i], pair[j] = r, k, None
        if k < n:
            before[k] = i
            pair[i] = new = rank(word[i : after[k]])
            if new is not None:
                heapq.heappush(heap, new * span + i)
        else:
            pair[i] = None
        h = before[i]
        if h >= 0:
            pair[h] = new = rank(word[h:k])
            if new is not None:
                heapq.heappush(heap, new * span + h)
    out, i = [], 0
    while i < n:
        out.append(own[i])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.ids = np.array([self.ranks[t] for t in tokens], np.uint32)
        self.whole = PerfectHash(tokens)
        size = int(self.ids.max()) + 1
        self.bytes: list[bytes] = [b""] * size
        for t in tokens:
            self.bytes[self.ranks[t]] = t
        self.lexicon = Lexicon(splitter(pattern), self._parts)

    def _parts(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        known, ids, ranks = self.whole.find(raw).tolist(), self.ids.tolist(), self.ranks
        return [[ids[n]] if n >= 0 else merge(w, ranks) for n, w in zip(known, raw)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.lexicon(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker: it is built from the rank file there, and reused by later tasks."""
    return Codec(path, pattern)


def encode(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids array<int>, decoded binary: the ids of each text, and the bytes that they decode to.

    path: a rank file that every executor has, as part of its installation.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = list(own.encode(part["text"].to_pylist()))
                flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                decoded = pa.array([own.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(offsets, flat.astype(np.int32)), decoded], names=["id", "ids", "decoded"])

    chosen = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(rows, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_column)


def digests(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256: without moving the ids out of Python."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest()) for x in own.encode(part["text"].to_pylist())]
                n, ids, decoded = zip(*found)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(rows, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
