"""Suffix-array dedup: removes every byte that a `width`-byte string covers which also starts in an earlier document.

The suffix order comes from the Burrows-Wheeler transform and common prefixes of a collection, built column by column
(see bwt.py). To distribute it, each width-byte window is assigned to the least hash of the k-byte strings in it, its
anchor: equal windows have equal anchors, so the windows of an anchor are a collection of their own. The steps:

1. Documents become blocks of some MB, a table in the shared folder, bucketed by block: later steps join answers to the
   blocks without moving texts.
2. Each block sends its distinct anchors. Those of one document only can't be in a repeated window; the others go back
   to the blocks that hold them. Anchors that are in many blocks are marked as hot.
3. Each block finds the runs of windows that share a repeated anchor, and of each distinct run the least document that
   holds it there. All that a later document of the block holds of the run goes for certain: that is decided in the block
   and stays with it, as intervals. Only the distinct run, that least document and its places are sent, so what travels of
   a passage is one document's share per block, however many documents hold it. Windows of a hot anchor are dealt out by a
   second anchor as well, so that what many blocks share doesn't land in one task.
4. Per anchor, equal runs of all blocks are merged, and the column-wise construction orders their suffixes. Rows that
   share `width` symbols are equal windows. Where a window's least document is smaller than a run's, the run's place in its
   block goes back to the block.
5. Each block removes the bytes of these places and of its own intervals.

Keys are dealt to ranges by their first bits, and a block sends a row per range that it has keys of. So there are at most
as many rows as blocks times ranges, and never more than keys, which grow with the text.

Strings of the construction are runs of windows, of at most RUN + width - 1 bytes, not whole documents: a round inserts one
symbol of each string, so there are as many rounds as the longest string has bytes.

Cases: a null text is an empty one; texts of fewer than `width` bytes lose nothing; a null id counts as the largest, so
null ids don't remove from each other; rows with one id don't remove from each other; equal rows have equal results; an
empty table gives an empty result; other columns are kept as they are, whatever their names. Very long texts are whole
blocks of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bwt
from textloom.llm.hashing import Rolling, U, mixed
from textloom.llm.shared import byte_lengths, materialize, new_path

WIDTH, K = 50, 24
#: Bits of an anchor's key. Two anchors with one key only cost the comparison of their windows.
KEY_BITS = 48
#: Bytes of text in a block, in what is hashed at once, and in a collection; windows in a run; blocks that make an anchor hot.
BLOCK, CHUNK, COLLECTION, RUN, HOT = 6 << 20, 1 << 16, 1 << 18, 32, 24
#: Bytes of text for each range of anchors that is put in order at once, at most.
RANGE = 12 << 20
LAST = np.iinfo(np.int64).max
ROLLING = Rolling(1)


def packed(x: np.ndarray) -> bytes:
    """Compressed, with the bytes of equal weight side by side."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize) if len(x) else np.empty((0, x.dtype.itemsize), np.uint8)
    return zstandard.compress(np.ascontiguousarray(flat.T).tobytes(), 1)


def unpacked(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as differences."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8"), dtype=U)


def string_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each K-byte string of data."""
    n = len(data) - 7
    eight = np.empty(n, U)
    for o in range(8):
        part = data[o : o + (len(data) - o) // 8 * 8].view(U)
        eight[o::8] = part[: len(eight[o::8])]
    n = len(data) - K + 1
    x = eight[:n] * U(0x9E3779B97F4A7C15)
    for at in (*range(8, K - 8, 8), K - 8):
        x ^= x >> U(31)
        x += eight[at : at + n]
        x *= U(0xBF58476D1CE4E5B9)
    return mixed(x)


def least_in_window(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` hashes in a row, by doubling."""
    out, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Windows:
    """Runs of windows with equal keys, of documents that lie one after another in `data`.

    For each run: its first window (`first`), number of windows (`count`, at most RUN), key and document number.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
        self.data, self.starts, self.sizes, self.width = data, starts, sizes, width

    def chunks(self) -> Iterator[tuple[int, int, int, int]]:
        """(first document, one past the last, first byte, one past the last)."""
        ends = self.starts + self.sizes
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + CHUNK, side="right")))
            yield i, j, int(self.starts[i]), int(ends[j - 1])
            i = j

    def runs(self, wanted: np.ndarray | None = None, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first, count, key, document) per chunk. wanted: ascending keys to keep, of which `hot` marks those that a second hash splits."""
        for i, j, low, high in self.chunks():
            if high - low < self.width:
                continue
            hashes = string_hashes(self.data[low:high])
            keys = mixed(least_in_window(hashes, self.width - K + 1)) >> U(64 - KEY_BITS)
            n = len(keys)
            valid = np.ones(n, bool)
            for d in range(i, j):
                stop = int(self.starts[d] + self.sizes[d]) - low
                valid[max(0, stop - self.width + 1) : min(stop, n)] = False
            document = np.searchsorted(self.starts[i:j], np.arange(low, low + n), side="right") + i - 1 if j - i > 1 else np.full(n, i)
            first = self._cut(keys, valid, document)
            if wanted is not None:
                at = self._among(keys[first], wanted)
                first, at = first[at >= 0], at[at >= 0]
                if hot is not None and hot[at].any():
                    second = least_in_window(mixed(hashes ^ U(0xA5A5A5A5A5A5A5A5)), self.width - K + 1)
                    all_at = self._among(keys, wanted)
                    split = (all_at >= 0) & hot[np.maximum(all_at, 0)] & valid
                    keys = np.where(split, mixed(keys * U(31) + second) >> U(64 - KEY_BITS), keys)
                    valid &= all_at >= 0
                    first = self._cut(keys, valid, document)
            if not len(first):
                continue
            yield self._limited(first, keys, valid, document, low, n)

    @staticmethod
    def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        return np.where(wanted[at] == keys, at, -1)

    @staticmethod
    def _cut(keys: np.ndarray, valid: np.ndarray, document: np.ndarray) -> np.ndarray:
        starts = np.ones(len(keys), bool)
        starts[1:] = (keys[1:] != keys[:-1]) | ~valid[:-1] | (document[1:] != document[:-1])
        return np.flatnonzero(starts & valid)

    @staticmethod
    def _limited(first, keys, valid, document, low, n):
        """Runs of at most RUN windows: a run ends where the key, the document or validity changes."""
        change = np.ones(n + 1, bool)
        change[1:n] = (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1]) | (document[1:] != document[:-1])
        stops = np.flatnonzero(change)
        count = stops[np.searchsorted(stops, first, side="right")] - first
        parts = -(-count // RUN)
        if (parts > 1).any():
            which = np.repeat(np.arange(len(first)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            first, count = first[which] + nth * RUN, np.minimum(RUN, count[which] - nth * RUN)
        return first + low, count, keys[first], document[first]


class Block:
    """Documents of a block: the Arrow rows, their bytes one after another, and the number that orders each.

    The last two columns are the order and the bytes; the others are kept for the result. Bytes are read where Arrow has them.
    """

    def __init__(self, blob: bytes):
        with pa.ipc.open_stream(blob) as reader:
            rows = reader.read_all()
        text = one(rows.column(rows.num_columns - 1)).cast(pa.binary())
        ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset).astype(np.int64)
        self.sizes, self.starts = np.diff(ends), ends[:-1] - ends[0]
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.order = one(rows.column(rows.num_columns - 2)).to_numpy()
        self.rows = rows.select(range(rows.num_columns - 2))

    def windows(self, width: int) -> Windows:
        return Windows(self.data, self.starts, self.sizes, width)

    def fragments(self, wanted: np.ndarray, hot: np.ndarray, width: int):
        """Distinct runs by key and content, ascending by key: keys, a place of each, windows, least document, and where the run's
        places in that document begin (and the end); those places, run after run; and the places (begin, end) of what
        later documents hold of these runs, ascending, merged where they touch."""
        found = []
        for first, count, key, document in self.windows(width).runs(wanted, hot):
            low = int(self.starts[document[0]])
            data = self.data[low : int(self.starts[document[-1]] + self.sizes[document[-1]])]
            ends = first + count + width - 1 - low
            found.append((first, count, key, document, ROLLING.substrings(ROLLING.prefix(data), first - low, ends)))
        if not found:
            none = np.empty(0, np.int64)
            return none.astype(U), none, none, none, np.zeros(1, np.int64), none, none, none
        place, count, key, owner, content = (np.concatenate(x) for x in zip(*found))
        # Equal runs of a block: equal 48 bits of key, sizes, and 64 bits of hash. Across blocks, contents are compared themselves.
        rank = np.lexsort((content, count, key))
        new = np.ones(len(rank), bool)
        new[1:] = False
        for x in (key, count, content):
            new[1:] |= x[rank][1:] != x[rank][:-1]
        heads = np.flatnonzero(new)
        lead = rank[heads]
        order = self.order[owner[rank]]
        least = np.minimum.reduceat(order, heads)
        first = order == np.repeat(least, np.diff(np.append(heads, len(rank))))
        begin, end = merged(place[rank][~first], (place + count)[rank][~first] + width - 1)
        own = np.cumsum(np.add.reduceat(first, heads, dtype=np.int64))
        return key[lead], place[lead], count[lead], least, np.concatenate([[0], own]), place[rank][first], begin, end


    def contents(self, places: np.ndarray, sizes: np.ndarray) -> bytes:
        """The bytes at some places, one after another."""
        ends = np.cumsum(sizes)
        return self.data[np.repeat(places - ends + sizes, sizes) + np.arange(int(sizes.sum()))].tobytes()


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, of which only one is held outside Arrow."""
    for rows in batches:
        for i in range(rows.num_rows):
            yield {c: rows[c][i].as_py() for c in rows.schema.names}


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in order, those that overlap or touch as one."""
    if not len(begin):
        return begin, end
    rank = np.argsort(begin, kind="stable")
    begin, upto = begin[rank], np.maximum.accumulate(end[rank])
    new = np.flatnonzero(np.append(True, begin[1:] > upto[:-1]))
    return begin[new], upto[np.append(new[1:] - 1, len(upto) - 1)]


def intervals(begin: np.ndarray, end: np.ndarray) -> bytes:
    """Ascending intervals as a blob that removed() reads."""
    blob = packed_keys(begin.astype(U))
    return len(blob).to_bytes(4, "little") + blob + packed((end - begin).astype("<u4"))


def ranges_of(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, its first key's place, one past its last) of each range that has any of the ascending keys: their first bits."""
    if not len(keys):
        return []
    number = (keys >> U(KEY_BITS - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    return list(zip(number[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]))


def batch(columns: dict, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in kinds], names=[n for n, _ in kinds])


def even_keys(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there, so that ranges can be dealt evenly."""
    found = spark.range(24 * n + 64).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).agg(F.min("id").alias("key")).collect()
    keys = {r["at"]: r["key"] for r in found}
    return [keys.get(i, i) for i in range(n)]


def blocks_of(documents: DataFrame, id_column: str, text_column: str, keep: list[str]) -> DataFrame:
    """block long, bytes long, data binary: Arrow streams of the kept columns, the order and the text's bytes."""
    taken = {c.lower() for c in keep}
    order, text = (next(x for x in (f"{base}{n or ''}" for n in range(len(taken) + 1)) if x not in taken) for base in ("order", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
            return batch({"block": [uuid.uuid4().int >> 65], "bytes": [size], "data": [sink.getvalue().to_pybytes()]}, [("block", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])

        for rows in batches:
            start = 0
            for i, n in enumerate(byte_lengths(rows.column(rows.num_columns - 1)).tolist()):
                if size and size + n > BLOCK:
                    if i > start:
                        held.append(rows.slice(start, i - start))
                    yield closed()
                    held, size, start = [], 0, i
                size += n
            if rows.num_rows > start:
                held.append(rows.slice(start))
        if held:
            yield closed()

    chosen = documents.select(*keep, F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias(order), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias(text))
    return chosen.mapInArrow(cut, "block long, bytes long, data binary")


def answers_by_block(df: DataFrame) -> DataFrame:
    """A row per block: what the ranges sent back to it, which its own size bounds."""
    return df.groupBy("block").agg(F.collect_list(F.struct("range", "blob")).alias("answers"))


def in_order(answers: list[dict] | None) -> list[bytes]:
    return [a["blob"] for a in sorted(answers or [], key=lambda a: a["range"])]


def spans(documents: DataFrame, finish, schema: str, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Apply finish(block, mask of the bytes to remove) -> RecordBatch to every block. ranges: at least so many, a power of two."""
    spark = documents.sparkSession
    keep = keep or [id_column]
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"textloom_blocks_{uuid.uuid4().hex}"
    (blocks_of(documents, id_column, text_column, keep).write.format("parquet").option("path", new_path(spark, "blocks"))
     .option("compression", "uncompressed").bucketBy(2 * shuffle, "block").saveAsTable(name))
    blocks = spark.table(name)
    if ranges is None:
        ranges = max(1, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // RANGE))
    bits = (ranges - 1).bit_length()
    ranges = 1 << bits
    tasks = max(1, min(ranges, 4 * shuffle))
    deal = even_keys(spark, tasks)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            found, owners = [], []
            block = Block(row["data"])
            for _, _, key, document in block.windows(width).runs():
                found.append(key)
                owners.append(document)
            if not found:
                continue
            keys, owner = np.concatenate(found), np.concatenate(owners).astype(np.int32)
            del found, owners
            rank = np.lexsort((owner, keys))
            keys, owner = keys[rank], owner[rank]
            new = np.append(True, keys[1:] != keys[:-1])
            shared = np.append(False, (keys[1:] == keys[:-1]) & (owner[1:] != owner[:-1]))
            starts = np.flatnonzero(new)
            several = np.logical_or.reduceat(shared, starts)
            keys = keys[starts]
            for r, a, b in ranges_of(keys, bits):
                yield batch({"deal": [deal[r % tasks]], "range": [r], "block": [row["block"]], "keys": [packed_keys(keys[a:b])], "several": [packed(several[a:b].view(np.uint8))]}, [("deal", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        """Rows of one range after another; they come sorted by range."""
        held, now = [], None
        for row in each(batches):
            if row["range"] != now and held:
                yield now, held
                held = []
            now = row["range"]
            held.append(row)
        if held:
            yield now, held

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in by_range(batches):
            keys = [unpacked_keys(x["keys"]) for x in rows]
            several = [unpacked(x["several"], "u1") for x in rows]
            whole, member, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            many = np.bincount(member, np.concatenate(several), len(whole)) > 0
            wanted, hot = (seen > 1) | many, seen >= HOT
            at = 0
            for x, own in zip(rows, keys):
                which = member[at : at + len(own)]
                at += len(own)
                on = wanted[which]
                if on.any():
                    blob = packed_keys(own[on])
                    marks = packed(hot[which[on]].view(np.uint8))
                    yield batch({"block": [x["block"]], "range": [r], "blob": [len(blob).to_bytes(4, "little") + blob + marks]}, [("block", pa.int64()), ("range", pa.int32()), ("blob", pa.binary())])

    def wanted_of(answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        keys, marks = [np.empty(0, U)], [np.empty(0, np.uint8)]
        for blob in in_order(answers):
            n = int.from_bytes(blob[:4], "little")
            keys.append(unpacked_keys(blob[4 : 4 + n]))
            marks.append(unpacked(blob[4 + n :], "u1"))
        return np.concatenate(keys), np.concatenate(marks).astype(bool)

    columns = [("deal", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("keys", "contents", "counts", "least", "times", "places", "local")]]

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = dict.fromkeys((n for n, _ in columns), [None])
        for row in each(batches):
            block = Block(row.pop("data"))
            keys, leads, counts, least, heads, places, begin, end = block.fragments(*wanted_of(row["answers"]), width)
            if len(begin):  # any range passes it on
                r = row["block"] % ranges
                yield batch(nothing | {"deal": [deal[r % tasks]], "range": [r], "block": [row["block"]], "local": [intervals(begin, end)]}, columns)
            for r, a, b in ranges_of(keys, bits):
                yield batch(
                    nothing | {"deal": [deal[r % tasks]], "range": [r], "block": [row["block"]], "keys": [packed_keys(keys[a:b])], "contents": [zstandard.compress(block.contents(leads[a:b], counts[a:b] + width - 1), 1)],
                     "counts": [packed(counts[a:b].astype(np.uint8))], "least": [packed(least[a:b].astype("<i8"))], "times": [packed(np.diff(heads[a : b + 1]).astype("<u4"))], "places": [packed(places[heads[a] : heads[b]].astype("<i8"))]}, columns)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("block", pa.int64()), ("range", pa.int32()), ("blob", pa.binary())]
        for r, rows in by_range(batches):
            for x in rows:
                if x["local"] is not None:
                    yield batch({"block": [x["block"]], "range": [r], "blob": [x["local"]]}, kinds)
            rows = [x for x in rows if x["local"] is None]
            if not rows:
                continue
            seen: dict[bytes, int] = {}  # equal contents have equal keys
            all_keys: list[int] = []
            owners: list[int] = []
            members = []
            for x in rows:
                contents, at, own = zstandard.decompress(x.pop("contents")), 0, []
                for k, c, least in zip(unpacked_keys(x["keys"]).tolist(), unpacked(x["counts"], "u1").tolist(), unpacked(x["least"], "<i8").tolist()):
                    content = contents[at : at + c + width - 1]
                    at += c + width - 1
                    n = seen.setdefault(content, len(seen))
                    if n == len(owners):
                        owners.append(least)
                        all_keys.append(k)
                    elif least < owners[n]:
                        owners[n] = least
                    own.append(n)
                members.append(np.array(own, np.int64))
            least, first, sizes = collected(np.array(all_keys, U), list(seen), np.array(owners, np.int64), width)
            del seen, all_keys, owners
            stretches = Stretches(least, first, sizes)
            for x, own in zip(rows, members):
                times = unpacked(x["times"], "<u4").astype(np.int64)
                begin, end = stretches.covered(np.repeat(own, times), unpacked(x["places"], "<i8"), np.repeat(unpacked(x["least"], "<i8"), times), width)
                if len(begin):
                    yield batch({"block": [x["block"]], "range": [r], "blob": [intervals(*merged(begin, end))]}, kinds)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            block = Block(row.pop("data"))
            yield finish(block, removed(block, in_order(row["found"])))

    sorted_by_range = lambda df: df.repartition(tasks, "deal").sortWithinPartitions("range")
    sent = blocks.select("block", "data").mapInArrow(anchors, "deal int, range int, block long, keys binary, several binary")
    back = sorted_by_range(sent).mapInArrow(repeated, "block long, range int, blob binary")
    wanted = answers_by_block(back)
    runs = blocks.select("block", "data").join(wanted.hint("shuffle_hash"), "block").mapInArrow(fragments, "deal int, range int, block long, keys binary, contents binary, counts binary, least binary, times binary, places binary, local binary")
    covered = sorted_by_range(runs).mapInArrow(ordered, "block long, range int, blob binary")
    found = materialize(answers_by_block(covered).withColumnRenamed("answers", "found"), "covered")
    whole = blocks.select("block", "data").join(found.hint("shuffle_hash"), "block", "left")
    return whole.mapInArrow(finished, schema)


def collected(keys: np.ndarray, runs: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least owner of every window of every run, each run's first window, and its number of windows.

    A collection is the runs of some whole anchors, of about COLLECTION bytes; an anchor's runs always are in one.
    """
    counts = np.fromiter(map(len, runs), np.int64, len(runs)) - (width - 1)
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    anchors, member = np.unique(keys, return_inverse=True)
    longest = np.zeros(len(anchors), np.int64)
    np.maximum.at(longest, member, counts)
    # Anchors with runs of like length share a collection: a round costs the whole collection, and there are as many as its longest run.
    rank = np.lexsort((member, longest[member]))
    ends = np.flatnonzero(np.append(member[rank][1:] != member[rank][:-1], True)) + 1  # one past each anchor's last run
    total = np.cumsum(counts[rank] + width - 1)
    a = 0
    while a < len(rank):
        full = np.searchsorted(total, (total[a - 1] if a else 0) + COLLECTION)
        b = int(ends[np.searchsorted(ends, min(int(full) + 1, len(rank)))])
        own = rank[a:b]
        n = counts[own]
        sizes = n + width - 1
        data = np.frombuffer(b"".join([runs[i] for i in own.tolist()]), np.uint8)
        least, _ = bwt.least_owner(data, np.cumsum(sizes) - sizes, sizes, owners[own], width)
        out[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = least
        a = b
    return out, first, counts


class Stretches:
    """Of the windows of all runs, run after run: stretches of windows with equal least owners; none crosses into the next run."""

    def __init__(self, least: np.ndarray, first: np.ndarray, counts: np.ndarray):
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[first] = True
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(least)))
        self.owners = least[self.starts]
        self.first = first
        self.low = np.searchsorted(self.starts, first)
        self.many = np.diff(np.append(self.low, len(self.starts)))

    def covered(self, run: np.ndarray, place: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (begin, end) that go, of occurrences of runs: where a stretch's least owner is smaller than the occurrence's document."""
        each = self.many[run]
        occurrence = np.repeat(np.arange(len(run)), each)
        stretch = np.repeat(self.low[run] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        goes = self.owners[stretch] < order[occurrence]
        occurrence, stretch = occurrence[goes], stretch[goes]
        begin = place[occurrence] + self.starts[stretch] - self.first[run[occurrence]]
        return begin, begin + self.sizes[stretch] + width - 1


def removed(block: Block, blobs: list[bytes]) -> np.ndarray:
    """Which bytes of a block go: those in the intervals (begin, size) that the ranges sent back."""
    change = np.zeros(len(block.data) + 1, np.int32)
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        begin, size = unpacked_keys(blob[4 : 4 + n]).astype(np.int64), unpacked(blob[4 + n :], "<u4")
        np.add.at(change, begin, 1)
        np.add.at(change, begin + size, -1)
    return np.cumsum(change[:-1]) > 0


def per_document(block: Block, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each document's bytes, and which of them go."""
    for start, size in zip(block.starts.tolist(), block.sizes.tolist()):
        yield block.data[start : start + size], mask[start : start + size]


def n_spans(gone: np.ndarray) -> int:
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def digests(documents: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of what is left, per document."""
    kind = dict(documents.dtypes)[id_column]

    def finish(block: Block, mask: np.ndarray) -> pa.RecordBatch:
        found = [(len(raw), int(gone.sum()), n_spans(gone), hashlib.sha256(raw[~gone].tobytes()).hexdigest()) for raw, gone in per_document(block, mask)]
        columns = list(zip(*found)) or [(), (), (), ()]
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([one(block.rows[id_column]), *arrays], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans(documents, finish, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", width, id_column, text_column, [id_column], ranges)


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes to remove without those of characters that stay in part."""
    if not gone.any():
        return gone
    begins = (raw & 0xC0) != 0x80
    begins[:1] = True
    character = np.cumsum(begins) - 1
    whole = np.logical_and.reduceat(gone, np.flatnonzero(begins))
    return whole[character]


def clean(documents: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, ranges: int | None = None) -> DataFrame:
    """The documents with all their columns and what is left of their texts; a character goes if all its bytes go.

    length_column: a column that counts the text's characters and is to follow it.
    """
    names, kinds = list(documents.columns), dict(documents.dtypes)
    keep = [c for c in names if c != text_column]

    def finish(block: Block, mask: np.ndarray) -> pa.RecordBatch:
        texts = [raw[~whole_characters(raw, gone)].tobytes().decode() for raw, gone in per_document(block, mask)]
        arrays = {c: one(block.rows[c]) for c in keep}
        arrays[text_column] = pa.array(texts, pa.string())
        if length_column:
            arrays[length_column] = pa.array(map(len, texts), pa.int64())
        return pa.RecordBatch.from_arrays([arrays[c] for c in names], names=names)

    schema = ", ".join(f"`{c}` {'long' if c == length_column else kinds[c]}" for c in names)
    return spans(documents, finish, schema, width, id_column, text_column, keep, ranges)


def one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def brute_force(documents: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """What digests() returns, from a dictionary of all windows."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in documents]
    least: dict[bytes, int] = {}
    for i, t in texts:
        for at in range(len(t) - width + 1):
            w = t[at : at + width]
            least[w] = min(least.get(w, LAST), i)
    out = []
    for (given, _), (i, t) in zip(documents, texts):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - width + 1):
            if least[t[at : at + width]] < i:
                gone[at : at + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((given, len(t), int(gone.sum()), n_spans(gone), hashlib.sha256(kept).hexdigest()))
    return out
