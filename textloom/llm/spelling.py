"""Spelling variants: each word's neighbours at one edit, by full generation of its neighbourhood.

1. Words: runs of letters of whole texts, lower-cased in A-Z, with a letter left out where a hash of the document and the run
   says so; those of at least `letters` code points and `times` occurrences make the vocabulary, counted by a partial aggregate.
2. Of each word all distinct deletions, replacements and insertions over the alphabet that the vocabulary shows are made. Words
   of one length make theirs together: a candidate's hash follows from sums before and after the place of the edit. It is looked up
   in a Bloom filter of the vocabulary, which has a fixed bound (LIMIT bits); only what may be a word is spelled out.
3. Candidates meet the vocabulary in an equi-join on their letters, which is exact: what joins is a neighbour, and needs no
   distance. A candidate is made once for each word that it neighbours, so no key is hot: a word has at most some thousand.
4. A word's form is its most frequent neighbour, if that is `factor` times as frequent. Counts grow along forms by that
   factor, so the way to a root has at most log(n) steps, which are halved in each round of a join.

A deletion is left out if the letter equals the one before it, an insertion if it equals the letter before its place: the same
strings come from the places before. So candidates of a word are distinct as they are made.

Cases: a null text has no words; a null id is an empty one in the hash; ties go to the smaller word in code-point order; repeated rows
count each; an empty table gives an empty result; columns besides the id and the text aren't read. Texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import U, mixed
from textloom.llm.shared import materialize

LETTERS, TIMES, FACTOR, DROPPED = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each word, at most in all (64 MB), and parts that it is summed in.
PER_WORD, LIMIT, PARTS = 32, 1 << 29, 64
#: Candidates that are hashed together.
TOGETHER = 1 << 20
BASE = 0x9E3779B97F4A7C15
DOWN = U(pow(BASE, -1, 1 << 64))


def vocabulary(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n of the runs of letters. A letter left out only shortens a run, so shorter runs aren't looked at."""
    run = F.regexp_extract_all(F.col(text_column), F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    runs = documents.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    low = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    word: Column = F.when(F.col("h") % DROPPED == 0, F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.col("run").substr(place + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def alphabet_of(words: DataFrame) -> str:
    """Letters of the vocabulary, ascending; no more than the ranges that runs are made of have."""
    found = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    return "".join(sorted(row.c for row in found))


class Neighbours:
    """Hashes and spellings of what is one edit from words of one length. Codes are places in the alphabet."""

    def __init__(self, alphabet: str):
        self.letters = np.array(list(alphabet), "U1")
        self.weights = mixed(np.arange(1, len(alphabet) + 1, dtype=U) * U(BASE)) | U(1)
        self.codes = np.zeros(0x110000 if alphabet and ord(max(alphabet)) > 0xFFFF else 0x10000, np.uint8)
        self.codes[[ord(c) for c in alphabet]] = np.arange(len(alphabet))

    def coded(self, words: list[str]) -> np.ndarray:
        """A row of codes for each of some words of one length."""
        return self.codes[np.array(words).view(np.uint32).reshape(len(words), -1)]

    def powers(self, n: int) -> np.ndarray:
        return np.cumprod(np.append(U(1), np.full(n, BASE, U)), dtype=U)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Sums of weight * power of all beginnings, from none to the whole word."""
        terms = self.weights[codes] * self.powers(codes.shape[1])[:-1]
        return np.concatenate([np.zeros((len(codes), 1), U), np.cumsum(terms, axis=1, dtype=U)], axis=1)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return mixed(self.sums(codes)[:, -1])

    def made(self, codes: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """kind of edit, hashes of its candidates (words by places, by letters), and which of them count as distinct."""
        n, size = codes.shape[1], len(self.letters)
        sums, powers, all_codes = self.sums(codes), self.powers(n), np.arange(size)
        rest = sums[:, -1:] - sums  # of what comes at each place and after it
        first = np.ones((len(codes), 1), bool)
        yield "delete", mixed(sums[:, :-1] + rest[:, 1:] * DOWN)[:, :, None], np.concatenate([first, codes[:, 1:] != codes[:, :-1]], axis=1)[:, :, None]
        other = sums[:, :-1] + rest[:, 1:]
        yield "replace", mixed(other[:, :, None] + self.weights * powers[:-1][None, :, None]), codes[:, :, None] != all_codes
        before = np.concatenate([np.full((len(codes), 1), -1), codes], axis=1)
        yield "insert", mixed((sums + rest * U(BASE))[:, :, None] + self.weights * powers[None, :, None]), before[:, :, None] != all_codes

    def spelled(self, kind: str, codes: np.ndarray, word: np.ndarray, place: np.ndarray, letter: np.ndarray) -> list[str]:
        """Candidates as strings."""
        own, n = codes[word], codes.shape[1]
        if kind == "replace":
            out = own.copy()
            out[np.arange(len(word)), place] = letter
        else:
            width = n - 1 if kind == "delete" else n + 1
            at = np.arange(width)[None, :]
            source = np.where(at < place[:, None], at, at + (1 if kind == "delete" else -1))
            out = np.take_along_axis(own, np.clip(source, 0, n - 1), axis=1)
            if kind == "insert":
                out[np.arange(len(word)), place] = letter
        return np.ascontiguousarray(self.letters[out]).view(f"U{out.shape[1]}").ravel().tolist()


def by_length(words: list[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    yield from groups.values()


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (hashes & U(bits - 1)).astype(np.int64), ((hashes >> U(32)) * U(0xD1342543DE82EF95) >> U(32) & U(bits - 1)).astype(np.int64)


def filter_of(words: DataFrame, alphabet: str, count: int) -> np.ndarray:
    """Bytes of a Bloom filter: PER_WORD bits a word in a power of two, LIMIT bits at most. It only spares candidates that can't join."""
    bits = min(LIMIT, max(1 << 16, 1 << (PER_WORD * count - 1).bit_length()))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, field = Neighbours(alphabet), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for group in by_length(batch["word"].to_pylist()):
                for at in places(made.hashes(made.coded(group)), bits):
                    np.bitwise_or.at(field, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for i, x in enumerate(np.split(field, PARTS)):
            if x.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "field": pa.array([x.tobytes()], pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch["field"][i].as_buffer(), np.uint8)
                part = batch["part"][i].as_py()
                parts[part] = parts[part] | x if part in parts else x
        for i, x in parts.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "field": pa.array([x.tobytes()], pa.binary())})

    schema = "part int, field binary"
    out = np.zeros((PARTS, bits // 8 // PARTS), np.uint8)
    for row in words.select("word").mapInArrow(own, schema).repartition("part").mapInArrow(joined, schema).collect():
        out[row.part] = np.frombuffer(row.field, np.uint8)
    return out.ravel()


def candidates(words: DataFrame, alphabet: str, held) -> DataFrame:
    """word, candidate: of the distinct strings one edit from each word those that may be words. held: the broadcast filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, field = Neighbours(alphabet), held.value
        bits = len(field) * 8
        for batch in batches:
            for group in by_length(batch["word"].to_pylist()):
                step = max(1, TOGETHER // ((len(group[0]) + 1) * max(1, len(alphabet))))
                for i in range(0, len(group), step):
                    own = group[i : i + step]
                    codes = made.coded(own)
                    for kind, hashes, distinct in made.made(codes):
                        flat = hashes.ravel()
                        on = np.flatnonzero(distinct.ravel())
                        for k in (0, 1):
                            at = places(flat[on], bits)[k]
                            on = on[(field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                        if len(on):
                            word, place, letter = np.unravel_index(on, hashes.shape)
                            spelled = made.spelled(kind, codes, word, place, letter)
                            yield pa.RecordBatch.from_arrays([pa.array([own[w] for w in word.tolist()], pa.string()), pa.array(spelled, pa.string())], names=["word", "candidate"])

    return words.select("word").mapInArrow(rows, "word string, candidate string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms (word, form) lead at last. Each round goes twice as far."""
    now, left = forms.select("word", F.col("form").alias("root")), None
    while True:
        further = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = materialize(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        before, left = left, further.where("moved").count()
        now = further.select("word", "root")
        if not left:
            return now
        if before is not None and left > before:
            raise AssertionError("forms go in a circle")


def variants(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, times: int = TIMES, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    spark = documents.sparkSession
    words = materialize(vocabulary(documents, id_column, text_column, letters, times), "words")
    alphabet, count = alphabet_of(words), words.count()
    held = spark.sparkContext.broadcast(filter_of(words, alphabet, count))
    met = candidates(words, alphabet, held).join(words.toDF("candidate", "near_n"), "candidate")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "candidate")).alias("best"))
    whole = words.join(best, "word", "left")
    whole = whole.withColumn("form", F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.candidate")))
    whole = materialize(whole.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    rooted = roots(whole.where("form is not null"))
    out = whole.join(rooted, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
