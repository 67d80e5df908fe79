"""Hierarchical multi-length packing.

Tiers are context sizes, each twice the one before. A document's ids and its end id are routed by length: whole windows
of the longest tier are cut off first, and the rest goes to the smallest tier that holds it. Each tier is packed into windows
of its own size, from the longest tier to the shortest: a window takes the longest waiting rest of its tier, and its gap is
filled best fit first from what waits in its own and the shorter tiers; a rest is cut only where nothing fits whole. So
short documents get short contexts, unless they fill the gap of a longer window, and every window is full. What a task has
left at its end, less than one long window, is split into powers of two: windows of tiers, and below the least tier a
few fragments. Neither need padding.

Windows are packed within the task that reads the documents: ids never move between machines, and a sequence's number is
the task's partition and a count. A step group has `group` windows of one tier, so of one size, and is balanced by attention
cost (the sum of squared piece lengths): costliest windows first, each to the lightest group that has room. A tier's windows
wait until they fill whole groups; only a tier's last group of a task may have fewer, and fragments share one.

Cases: a null text is an empty one, which has its end id only; very long texts are cut into many windows; rows that
repeat are packed each; an empty table gives an empty result; columns besides the id and the text aren't read.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.pretokens import Lexicon, splitter
from textloom.llm.shared import pieces

TIERS = (256, 512, 1024, 2048)
#: Longest windows whose ids a task holds before it packs or writes them, and windows in a step group.
WAVE, GROUP = 512, 8


@functools.lru_cache(maxsize=2)
def lexicon(path: str, pattern: str) -> Lexicon:
    """One per Python worker. The library encodes each distinct pre-token once; special tokens' strings are ordinary text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return Lexicon(splitter(pattern), lambda words: [x.ids for x in own.encode_batch_fast(words, add_special_tokens=False)])


class Packer:
    """Packs rests into windows. A window is (its size's place among the tiers, its pieces as (key, start in the document, length))."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.size, self.top = tiers, tiers[-1], len(tiers) - 1
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # ascending by (length, key, start) in each tier
        self.tokens = 0

    def _put(self, length: int, key: int, start: int) -> None:
        bisect.insort(self.waiting[bisect.bisect_left(self.tiers, length)], (length, key, start))
        self.tokens += length

    def route(self, length: int, key: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Cut off whole windows of the longest tier and keep the rest in the smallest tier that holds it."""
        start = 0
        while length - start >= self.size:
            yield self.top, [(key, start, self.size)]
            start += self.size
        if rest := length - start:
            self._put(rest, key, start)

    def _take(self, most: int, tier: int) -> tuple[int, int, int] | None:
        """The longest waiting rest of at most `most` ids, of this tier or a shorter one."""
        for own in self.waiting[tier::-1]:
            if own and own[0][0] <= most:
                found = own.pop(bisect.bisect_right(own, (most, 1 << 62, 0)) - 1)
                self.tokens -= found[0]
                return found
        return None

    def window(self, tier: int) -> tuple[int, list[tuple[int, int, int]]]:
        """A window of a tier: best fits of it and the shorter tiers first, then the front of the shortest rest that is too long."""
        room, out = self.tiers[tier], []
        while room and self.tokens:
            if (found := self._take(room, tier)) is None:
                found = next(own for own in self.waiting if own and own[-1][0] > room)
                found = found.pop(bisect.bisect_right(found, (room, 1 << 62, 0)))
                self.tokens -= found[0]
            length, key, start = found
            used = min(room, length)
            out.append((key, start, used))
            room -= used
            if used < length:
                self._put(length - used, key, start + used)
        return tier, out

    def wave(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows for half of what waits in each tier, from long to short."""
        for tier in range(self.top, -1, -1):
            for _ in range(-(-len(self.waiting[tier]) // 2)):
                if self.waiting[tier] and self.tokens >= self.tiers[tier]:
                    yield self.window(tier)

    def flush(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """All that waits: full windows, then less than the longest window in powers of two (-1: below the least tier)."""
        for tier in range(self.top, -1, -1):
            while self.waiting[tier] and self.tokens >= self.tiers[tier]:
                yield self.window(tier)
        left = [(key, start, length) for own in reversed(self.waiting) for length, key, start in reversed(own)]
        total, self.tokens, self.waiting = self.tokens, 0, [[] for _ in self.tiers]
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            room, part = 1 << bit, []
            while room:
                key, start, length = left.pop(0)
                used = min(room, length)
                part.append((key, start, used))
                room -= used
                if used < length:
                    left.insert(0, (key, start + used, length - used))
            yield self.tiers.index(1 << bit) if 1 << bit in self.tiers else -1, part


def balanced(costs: list[int], group: int) -> list[int]:
    """A group number for each window: groups of at most `group`, of costs as even as the greedy rule makes them."""
    n = -(-len(costs) // group)
    open_, out = [(0, g, 0) for g in range(n)], [0] * len(costs)
    heapq.heapify(open_)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        cost, g, held = heapq.heappop(open_)
        out[i] = g
        if held + 1 < group:
            heapq.heappush(open_, (cost + costs[i], g, held + 1))
    return out


SCHEMA = "{id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(documents: DataFrame, path: str, pattern: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, group: int = GROUP, wave: int = WAVE, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: where it lies in its document (start, length) and in its sequence (sequence_id, offset).

    ids_crc32 is of the piece's ids as little-endian unsigned 32-bit integers; tier is the sequence's context size, which
    it fills; step_group numbers the balanced groups. tiers: powers of two. with_ids adds the ids themselves.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = lexicon(path, pattern), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        docs: dict[int, list] = {}  # key -> [id, ids, ids not yet written]
        ready: dict[int, list[list[tuple[int, int, int]]]] = {t: [] for t in range(-1, len(tiers))}
        n_keys, n_windows, n_groups = 0, 0, 0

        def take(windows) -> None:
            for tier, window in windows:
                ready[tier].append(window)

        def written(last: bool) -> pa.RecordBatch:
            """Whole groups of each tier; at the end all."""
            nonlocal n_windows, n_groups
            out: list[tuple] = []
            for tier, held in ready.items():
                n = len(held) if last else len(held) // group * group
                now, ready[tier] = held[:n], held[n:]
                groups = balanced([sum(x[2] ** 2 for x in w) for w in now], group)
                for window, g in zip(now, groups):
                    offset, size = 0, sum(x[2] for x in window)
                    for key, start, length in window:
                        doc = docs[key]
                        ids = doc[1][start : start + length]
                        out.append((doc[0], start, length, zlib.crc32(ids), len(doc[1]), base + n_windows, offset, size, base + n_groups + g) + ((ids,) if with_ids else ()))
                        offset += length
                        doc[2] -= length
                        if not doc[2]:
                            del docs[key]
                    n_windows += 1
                n_groups += max(groups, default=-1) + 1
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [id_kind, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[-1]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.schema.field("id").type
            for part in pieces(batch, "text"):
                for id_, ids in zip(part["id"].to_pylist(), own(part["text"].to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    docs[n_keys] = [id_, ids, len(ids)]
                    take(packer.route(len(ids), n_keys))
                    n_keys += 1
                    while packer.tokens >= wave * tiers[-1]:
                        take(packer.wave())
                    if sum(len(x) * tiers[t] for t, x in ready.items()) >= wave * tiers[-1]:
                        yield written(False)
        take(packer.flush())
        if any(ready.values()):
            yield written(True)

    chosen = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]
    return chosen.mapInArrow(rows, SCHEMA.format(id=f"`{id_column}`", kind=kind) + (", ids array<long>" if with_ids else ""))
