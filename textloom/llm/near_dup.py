"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is a weighted set of its shingles of five words (split at ASCII white space). A shingle's weight is its count
times 1 + ln(N / df) / ln(N / floor), between 1 and 2, so that boilerplate weighs less, but no more than twice less than
what is rare. Document frequencies are counted over all documents, in a sketch of 2**20 counters: a shingle's counter less
the median counter, which is what unrelated shingles add. What they add varies, so a frequency below the floor, the 99th
percentile of all counters less the median, can't be told from nothing: such shingles are rare and weigh 2, all alike. The
floor grows with the root of N, so as a share of N it falls: the larger the corpus, the finer the shares that are told
apart. The sketch's size is fixed, and so is what goes to the driver.

1. Every text gets a digest and SAMPLES consistent weighted samples: two documents agree in a sample with the probability
   of their weighted Jaccard similarity. ROWS samples make a band's key.
2. Equal texts collapse to their smallest id; a text that many share is dealt out to all tasks for that. The others meet in
   buckets of equal band keys.
3. First, each document of a bucket picks the smallest one there that agrees in at least AGREE samples; the picked pairs are
   verified on whole texts, which joins large groups to a few stars.
4. Then every bucket that still has several components is joined inside: a document is verified against the documents of
   other components that agree in at least AGREE samples, the likeliest first, until it is linked to their component. So
   every pair in a bucket that the samples don't rule out is linked, verified, or in one component already; no pairs leave
   the task but links. A bucket of more than CHUNK documents is first dealt out to parts, with its smallest document in
   each, which joins most of it.
5. What is left in several components there meets in tiles of two parts, so that every two documents of different components
   are in one tile; texts go only where the samples leave a pair open.

The probability that a pair of similarity 0.8 shares no bucket is (1 - 0.8**3)**12 = 0.0002, at 0.85 it is 0.00001; that it
agrees in fewer than 20 of 36 samples is 0.0003, at 0.85 below 0.00001.

Cases: rows with a null id take no part and get no row; a null text is an empty one; texts without words are alike; a text
of fewer than five words is one shingle; rows that repeat an id are one document, which has all its texts; ties go to the
smaller id; an empty table gives an empty result; other columns aren't read. Texts are whole, however long.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.hashing import Rolling, U, mixed
from textloom.llm.shared import looked_up, materialize, new_path, pieces

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, AGREE = 12, 3, 20
SAMPLES = BANDS * ROWS
COUNTERS, PARTS = 1 << 20, 64
#: Documents of a part of a bucket, and of a side of a tile.
CHUNK, TILE = 512, 256
NO_WORDS = 0x3C79AC492BA7B653
SPACES = np.zeros(256, bool)
SPACES[list(b" \t\n\r\v\f")] = True


ROLLING = Rolling(5)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's shingles, with repeats, in order."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = SPACES[data]
    before = np.append(True, space[:-1])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    words = ROLLING.substrings(ROLLING.prefix(data), starts, ends)
    text_ends = np.cumsum(sizes)
    last = np.searchsorted(starts, text_ends)
    first = np.concatenate([[0], last[:-1]])
    n = len(words) - WORDS + 1
    if n > 0:
        rolled = words[:n].copy()
        for k in range(1, WORDS):
            rolled = rolled * U(0xD1342543DE82EF95) + words[k : k + n]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= WORDS:
            out.append(rolled[a : b - WORDS + 1])
        elif b > a:
            short = np.array([b - a], U)
            for i in range(a, b):
                short = short * U(0xD1342543DE82EF95) + words[i : i + 1]
            out.append(mixed(short))
        else:
            out.append(np.array([NO_WORDS], U))
    return out


def weighted(own: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and their weights."""
    keys, counts = np.unique(own, return_counts=True)
    return keys, counts * idf[(keys >> U(44)).astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of smaller weights over the sum of larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    same = float(np.minimum(a[1][i], b[1][j]).sum())
    return same / (float(a[1].sum()) + float(b[1].sum()) - same)


def likeness(sets: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """similarity() of every two sets, but for rounding: a product of matrices over what several sets hold.

    The smaller of two weights of a shingle is the sum of the steps up to it among all weights that the sets give it; a
    set has a one for each step up to its own weight. Matrices have `columns` steps at once.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(k) for k, _ in sets])
    keys, weights = np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64)
    order = np.lexsort((weights, keys))
    keys, weights, owner = keys[order], weights[order], owner[order]
    new_key = np.append(True, keys[1:] != keys[:-1])
    new_step = new_key | np.append(True, weights[1:] != weights[:-1])
    heads = np.flatnonzero(new_step)
    step = np.cumsum(new_step) - 1  # of each entry
    rise = np.where(new_key[heads], weights[heads], weights[heads] - np.append(0.0, weights[heads][:-1]))
    first = np.maximum.accumulate(np.where(new_key, step, 0))  # the first step of each entry's shingle
    many = step - first + 1
    who = np.repeat(owner, many)
    which = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    shared = np.bincount(which, minlength=len(heads)) > 1
    on = shared[which]
    who, which = who[on], (np.cumsum(shared) - 1)[which[on]]
    rise = rise[shared]
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    same = np.zeros((n, n))
    for start in range(0, len(rise), columns):
        a, b = np.searchsorted(which, (start, start + columns))
        part = np.zeros((n, min(columns, len(rise) - start)))
        part[who[a:b], which[a:b] - start] = 1.0
        same += (part * rise[start : start + columns]) @ part.T
    total = np.array([float(w.sum()) for _, w in sets])
    np.fill_diagonal(same, total)
    return same / (total[:, None] + total - same)


@functools.lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution at 2**16 even places, and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        x = (low + high) / 2
        above = 1 - (1 + x) * np.exp(-x) > p
        high, low = np.where(above, x, high), np.where(above, low, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


SEEDS = mixed(np.arange(1, SAMPLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def samples(keys: np.ndarray, weights: np.ndarray, most: int = 2048) -> np.ndarray:
    """SAMPLES consistent weighted samples of a weighted set, each as a hash of (shingle, level).

    For each shingle and sample, r and c are Gamma(2, 1) and beta is uniform; the level is t = floor(ln w / r + beta), and
    the shingle with the least ln c - r (t - beta + 1) is the sample.
    """
    gamma, log_gamma = draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    out, columns = np.zeros(SAMPLES, U), np.arange(SAMPLES)
    for i in range(0, len(keys), most):
        part = keys[i : i + most]
        x = mixed(part[:, None] ^ SEEDS)
        r = gamma[(x & U(0xFFFF)).astype(np.int32)]
        c = log_gamma[((x >> U(16)) & U(0xFFFF)).astype(np.int32)]
        beta = (x >> U(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(np.log(weights[i : i + most]).astype(np.float32)[:, None] / r + beta)
        a = c - r * (t - beta + 1)
        k = a.argmin(axis=0)
        found = a[k, columns]
        better = found < best
        best[better] = found[better]
        level = t[k, columns].astype(np.int64).astype(U)
        out[better] = mixed(part[k] + mixed(level + SEEDS))[better]
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    rows = own.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=U)
    for k in range(ROWS):
        out = mixed(out * U(0xD1342543DE82EF95) + rows[:, k])
    return out.view(np.int64)


def texts_of(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    chosen = documents.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    return chosen.where("doc is not null")


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + ln(N / df) / ln(N / floor) by counter; 4 MB, whatever the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                found = [np.unique(x) for x in shingles(part["text"].to_pylist())]
                n += len(found)
                counts += np.bincount((np.concatenate(found) >> U(44)).astype(np.int64), minlength=COUNTERS)
        if n:
            for i, x in enumerate(np.split(counts.astype("<u4"), PARTS)):
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "n": pa.array([n], pa.int64()), "counts": pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = totals.setdefault(row["part"], [0, np.zeros(COUNTERS // PARTS, np.int64)])
                own[0] += row["n"]
                own[1] += np.frombuffer(zstandard.decompress(row["counts"]), "<u4")
        for i, (n, x) in totals.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "n": pa.array([n], pa.int64()), "counts": pa.array([x.astype("<i8").tobytes()], pa.binary())})

    schema = "part int, n long, counts binary"
    rows = texts.select("text").mapInArrow(counted, schema).repartition("part").mapInArrow(summed, schema).collect()
    counts, n = np.zeros((PARTS, COUNTERS // PARTS)), 2
    for row in rows:
        counts[row.part], n = np.frombuffer(row.counts, "<i8"), max(2, row.n)
    counts = counts.ravel()
    middle = np.median(counts)
    floor = max(1.0, min(float(np.quantile(counts, 0.99) - middle), n / 2))
    df = np.clip(counts - middle, floor, n)
    return (1 + np.log(n / df) / np.log(n / floor)).astype(np.float32)


def signatures(texts: DataFrame, idf) -> DataFrame:
    """doc, digest of the text, sample bytes (the low byte of each sample) and band keys. idf: a broadcast of the weights."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                raw = part["text"].to_pylist()
                own = [samples(*weighted(x, weights)) for x in shingles(raw)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc"], pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary()), pa.array([(x & U(255)).astype(np.uint8).tobytes() for x in own], pa.binary()), pa.array([band_keys(x) for x in own], pa.list_(pa.int64()))],
                    names=["doc", "digest", "sample", "bands"],
                )

    return texts.mapInArrow(rows, "doc long, digest binary, sample binary, bands array<long>")


def dealt(members: DataFrame, turn: int) -> DataFrame:
    """key, part, side, doc, sample, component: buckets in parts of about CHUNK documents, with the bucket's lead in every part."""
    parts = F.when(F.col("n") > CHUNK, F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil(F.col("n") / CHUNK))).otherwise(F.lit(0)).cast("int")
    placed = members.withColumn("part", parts)
    lead = placed.where("lead is not null").groupBy("key", "part").agg(F.first("lead").alias("lead"))
    lead = lead.select("key", "part", F.col("lead.doc").alias("doc"), F.col("lead.sample").alias("sample"), F.col("lead.component").alias("component"))
    return placed.select("key", "part", "doc", "sample", "component").union(lead).distinct().withColumn("side", F.lit(0))


def tiles(members: DataFrame) -> DataFrame:
    """key, part, side, doc, sample, component: rows of tiles, in which every two documents of a bucket's components meet once.

    A bucket's largest component and what is outside it are dealt out to parts of about CHUNK / 2 documents; a tile has two
    parts, at least one of them outside. Side 0 meets the whole tile, sides 1 and 2 meet each other. Rows stay if the
    samples leave a pair with another component open. A bucket of n documents, o of them outside, sends some n * o / most rows of
    samples: with many components in one bucket that grows with n squared, over the 256 documents of a part.
    """
    most = max(1, CHUNK // 2)
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"))
    sizes = sizes.select("key", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / most).alias("outer"), F.ceil(F.col("main.n") / most).alias("inner")).where("outer > 0")
    hashed, is_main = F.xxhash64("doc"), F.col("component") == F.col("main")
    placed = members.join(sizes, "key").withColumn("own", F.when(is_main, F.col("outer") + F.pmod(hashed, "inner")).otherwise(F.pmod(hashed, "outer")))
    others = F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    paired = placed.withColumn("other", F.explode(others))
    part = F.least("own", "other") * (F.col("outer") + F.col("inner")) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = paired.select("key", part.alias("part"), side.alias("side"), "doc", "sample", "component")

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in by_part(batches):
            component, sides = np.array(tile["component"]), np.array(tile["side"])
            sample = np.frombuffer(b"".join(tile["sample"]), np.uint8).reshape(len(sides), -1)
            on = np.zeros(len(sides), bool)
            for i in range(1, len(sides)):
                pair = (component[:i] != component[i]) & ((sides[:i] != sides[i]) | (sides[i] == 0)) & ((sample[:i] == sample[i]).sum(axis=1) >= AGREE)
                on[:i] |= pair
                on[i] |= pair.any()
            if on.any():
                table = pa.Table.from_pydict(tile, schema=kinds).filter(pa.array(on))
                yield from table.combine_chunks().to_batches()

    kinds = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("side", pa.int32()), ("doc", pa.int64()), ("sample", pa.binary()), ("component", pa.int64())])
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "doc")
    return rows.mapInArrow(left_open, "key long, part long, side int, doc long, sample binary, component long")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of one part of a bucket after another; rows come sorted by key and part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys, parts = batch["key"].to_numpy(), batch["part"].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(edges, edges[1:]):
            piece = batch.slice(a, b - a)
            if held and (held[0]["key"][0], held[0]["part"][0]) != (piece["key"][0], piece["part"][0]):
                yield pa.Table.from_batches(held).to_pydict()
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).to_pydict()


def stars(members: DataFrame) -> DataFrame:
    """Pairs a > b: of each document, the smallest that one of its buckets offers."""

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_part(batches):
            ids, n = np.array(part["doc"]), len(part["doc"])
            if n < 2:
                continue
            sample = np.frombuffer(b"".join(part["sample"]), np.uint8).reshape(n, -1)
            left, a, b = np.arange(1, n), [], []
            for j in range(n - 1):
                left = left[left > j]
                on = (sample[left] == sample[j]).sum(axis=1) >= AGREE
                a += ids[left[on]].tolist()
                b += [int(ids[j])] * int(on.sum())
                left = left[~on]
                if not len(left):
                    break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = dealt(members, 0).repartition("key", "part").sortWithinPartitions("key", "part", "doc")
    return rows.mapInArrow(offered, "a long, b long").where("a > b").groupBy("a").agg(F.min("b").alias("b"))


def inside(placed: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """a, b, similarity: links between components that meet in a part of a bucket. placed: rows of dealt() or tiles()."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for part in by_part(batches):
            ids, component, sides, found = part["doc"], part["component"], np.array(part["side"]), []
            up = {c: c for c in component}
            if len(up) < 2:
                continue

            def top(c: int) -> int:
                while up[c] != c:
                    up[c] = c = up[up[c]]
                return c

            sample = np.frombuffer(b"".join(part["sample"]), np.uint8).reshape(len(ids), -1)
            sets: dict[int, tuple] = {}

            def of(i: int) -> tuple:
                if i not in sets:
                    sets[i] = weighted(shingles([zstandard.decompress(part["text"][i])])[0], weights)
                return sets[i]

            number, met = np.array(component), []
            for i in range(1, len(ids)):
                agree = (sample[:i] == sample[i]).sum(axis=1) * ((sides[:i] != sides[i]) | (sides[i] == 0)) * (number[:i] != number[i])
                j = np.flatnonzero(agree >= AGREE)
                met.append((np.full(len(j), i), j, agree[j]))
            first, second, agree = (np.concatenate(x) for x in zip(*met))
            if len(first) > 8 * len(ids):  # then all at once costs less
                used = np.unique(np.concatenate([first, second]))
                alike = likeness([of(i) for i in used.tolist()])
                on = alike[np.searchsorted(used, first), np.searchsorted(used, second)] >= threshold - 1e-9
                first, second, agree = first[on], second[on], agree[on]
            for at in np.lexsort((second, -agree, first)).tolist():
                i, j = int(first[at]), int(second[at])
                x, y = top(component[i]), top(component[j])
                if x != y and (s := similarity(of(i), of(j))) >= threshold:
                    up[x] = y
                    found.append((ids[i], ids[j], s))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    rows = placed.join(texts, "doc").repartition("key", "part").sortWithinPartitions("key", "part", "doc")
    return rows.select("key", "part", "side", "doc", "sample", "component", "text").mapInArrow(joined, "a long, b long, similarity double")


def candidate_texts(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Compressed texts of the documents that are in a bucket, as a table bucketed by document, so that rounds don't move it.

    A filter of 2**23 bits on hashed ids goes ahead of the exact join; it only saves moving texts that can't be wanted.
    """
    spark = texts.sparkSession
    bits = 1 << 23
    bit = docs.select(F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("bit"))
    words = bit.groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("value")).collect()
    table = np.zeros(bits // 32, np.uint32)
    for row in words:
        table[row.word] = row.value
    held = spark.sparkContext.broadcast(table)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch["bit"].to_numpy()
            on = np.flatnonzero(held.value[place >> 5] >> (place & 31).astype(np.uint32) & 1)
            if len(on):
                rows = batch.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([rows["doc"], pa.array([zstandard.compress(t, 3) for t in rows["text"].to_pylist()], pa.binary())], names=["doc", "text"])

    near = texts.withColumn("bit", F.pmod(F.xxhash64("doc"), F.lit(bits))).mapInArrow(chosen, "doc long, text binary")
    name = f"textloom_texts_{uuid.uuid4().hex}"
    (near.join(docs.hint("shuffle_hash"), "doc", "left_semi").write.format("parquet").option("path", new_path(spark, "texts")).option("compression", "uncompressed")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").saveAsTable(name))
    return spark.table(name)


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """a, b, similarity of each pair.

    Pairs that hang together meet in one tile, where each text comes once; larger groups are cut into tiles of TILE by
    TILE documents. texts is bucketed by document, so only what goes into tiles moves.
    """
    groups = components(pairs)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    placed = groups.join(sizes, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TILE)).alias("part"))
    placed = materialize(placed, "tiles")
    both = pairs.join(placed.toDF("a", "component", "a_part"), "a").join(placed.select(F.col("node").alias("b"), F.col("part").alias("b_part")), "b")
    tiled = both.select("a", "b", F.xxhash64("component", F.least("a_part", "b_part"), F.greatest("a_part", "b_part")).alias("tile"))
    tiled = materialize(tiled, "tiles")
    wanted = tiled.select("tile", F.col("a").alias("doc")).union(tiled.select("tile", F.col("b").alias("doc"))).distinct()
    rows = wanted.join(texts, "doc").select("tile", F.lit(0).alias("kind"), F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(tiled.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("text")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, now, held = idf.value, None, {}
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for tile, kind, a, b, text in zip(*(batch[c].to_pylist() for c in ("tile", "kind", "a", "b", "text"))):
                if tile != now:
                    now, held = tile, {}
                if kind == 0:
                    held.setdefault(a, []).append(weighted(shingles([zstandard.decompress(text)])[0], weights))
                else:
                    found.append((a, b, max(similarity(x, y) for x in held[a] for y in held[b])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(compared, "a long, b long, similarity double")


def with_least(signed: DataFrame) -> DataFrame:
    """doc, representative of the documents whose text others have too: the smallest id with an equal text."""
    return looked_up(signed.select("digest", "doc"), "digest", "doc", F.min("doc"), "representative").select("doc", "representative").distinct()


def links(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc, representative: the smallest id with an equal text, if others have that), (a, b, similarity) of verified links
    between representatives."""
    return _links(*_signed(documents, id_column, text_column), threshold)


def _signed(documents: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, object, DataFrame]:
    """Texts, the broadcast weights, and the stored signatures."""
    spark = documents.sparkSession
    texts = texts_of(documents, id_column, text_column)
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts))
    return texts, idf, materialize(signatures(texts, idf), "signatures")


def _links(texts: DataFrame, idf, signed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    copies = materialize(with_least(signed), "copies")
    firsts = signed.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("sample").alias("sample"), F.first("bands").alias("bands"))
    keyed = firsts.select("doc", "sample", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(F.struct("doc", "sample", F.col("doc").alias("component"))).alias("lead")).where("least <> most")
    sizes = sizes.select("key", "n", F.when(F.col("n") > CHUNK, F.col("lead")).alias("lead"))
    members = materialize(keyed.join(sizes, "key").select("key", "doc", "sample", "n", "lead", F.col("doc").alias("component")), "buckets")
    near = candidate_texts(texts, members.select("doc").distinct())
    checked = materialize(verified(materialize(stars(members), "pairs"), near, idf), "checked")
    found = checked.where(F.col("similarity") >= threshold)

    def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
        whole = components(found.select("a", "b"))
        now = members.drop("component").join(whole.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        open_ = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "doc").alias("first")).where("low <> high").select("key", "first")
        now = now.join(open_, "key").withColumn("lead", F.when(F.col("lead").isNotNull(), F.struct(F.col("lead.doc").alias("doc"), F.col("lead.sample").alias("sample"), F.col("first").alias("component"))))
        return materialize(now.select("key", "doc", "sample", "n", "lead", "component"), "buckets")

    members = still_open(members, found)
    if members.isEmpty():
        return copies, found
    found = found.unionByName(materialize(inside(dealt(members, 1), near, idf, threshold), "links"))
    large = members.where(F.col("n") > CHUNK)
    if large.isEmpty():
        return copies, found
    large = still_open(large, found)
    if large.isEmpty():
        return copies, found
    found = found.unionByName(materialize(inside(tiles(large), near, idf, threshold), "links"))
    return copies, found


def classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id (the smallest id of its class) of every document with an id."""
    texts, idf, signed = _signed(documents, id_column, text_column)
    copies, found = _links(texts, idf, signed, threshold)
    all_links = copies.select(F.col("doc").alias("a"), F.col("representative").alias("b")).unionByName(found.select("a", "b"))
    whole = components(all_links)
    out = signed.select("doc").distinct().join(whole, F.col("doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias(id_column), F.coalesce("component", "doc").alias("class_id"))


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those whose class has a smaller id. Rows with a null id stay, as they take no part.

    The hint keeps the plan alike at every size: texts move by id, and the ids to drop are the hashed side of their part.
    """
    dropped = classes(documents, id_column, text_column, threshold).where(F.col(id_column) != F.col("class_id")).select(id_column)
    return documents.join(dropped.hint("shuffle_hash"), id_column, "left_anti").select(*documents.columns)
