"""Alignment of two tokenizers: where their tokens of one text end together, and which ids such ends link.

Tokenising is the only work in Python, for each side by itself: each distinct pre-token is encoded once per lexicon (`pretokens`), and a side's
tokens come as arrays (`COLUMNS`). What puts the sides together is higher-order functions of Spark:

1. The ends in common are the array_intersect of both arrays of ends. They cut a text into groups.
2. A side has a number for each byte: the id of the token that covers it, and where the next one begins in the text of the ids. So what ends
   at a common end is found in one step, and the work is linear in bytes and tokens, however long the text.
3. Links are the two ids at each common end (transform), groups the texts between two of them (zip_with). Tokens are never empty, so one
   token of each side ends there.

Corpus counts of id pairs are a partial aggregate over all links. To look them up, pairs with at least `total / FREQUENT`
links are broadcast: their counts add up to no more than `total`, so they are FREQUENT at most, whatever the corpus. Links of
rarer pairs are summed by text and pair and meet their counts by a shuffle; no pair there is hot, as none has that many links.

Cases: a null or empty text, and one whose joined token bytes differ from space + text, has no tokens: zeros and ''. Rows that repeat
an id get a row each, and count each; a null id is kept; ties for the highest count are all highest; an empty table gives an
empty result; columns besides the id and the text aren't read. Texts are whole, however long.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.llm.pretokens import Lexicon, splitter
from textloom.llm.shared import materialize, pieces

#: Pairs that may be broadcast, and pre-tokens that each lexicon holds.
FREQUENT, HELD = 1 << 20, 500_000
#: What stands for a pre-token whose ids don't give its bytes again.
BAD = 0xFFFFFFFF
#: A pair is a * PAIR + b.
PAIR = 1 << 32


class Side:
    """One tokenizer: ids of texts, and how many bytes each id stands for. Call with texts (space included). before: what split leaves out of
    each word."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]], table: list[bytes], before: str = "", held: int = HELD):
        self.lengths = np.array([len(x) for x in table], np.int32)
        self.decimal = pa.array([f"{i},".encode() for i in range(len(table))], pa.binary())

        def checked(words: list[str]) -> list[list[int]]:
            own, wanted = encode(words), [(before + word).encode() for word in words]
            # All at once: the same bytes in a row, and as many for each word.
            ids = np.fromiter(chain.from_iterable(own), np.int32)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            sizes = np.diff(np.concatenate([[0], np.cumsum(self.lengths[ids], dtype=np.int64)])[ends], prepend=0)
            if (sizes == np.fromiter(map(len, wanted), np.int64, len(wanted))).all() and b"".join([table[i] for i in ids.tolist()]) == b"".join(wanted):
                return own
            return [x if b"".join([table[i] for i in x]) == word else [BAD] for word, x in zip(wanted, own)]

        self.lexicon = Lexicon(split, checked, held)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Ids of each text; None if their bytes aren't the text's."""
        for ids in self.lexicon(texts):
            yield None if (ids == BAD).any() else ids


def byte_level(path: str) -> tuple[Callable, list[bytes]]:
    """encode and byte table of a byte-level tokenizer's file; special tokens' strings are ordinary text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    # The usual byte-level letters: printable bytes stand for themselves, the others follow from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    table = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    # The model alone, on words as byte-level letters: they are pre-tokens already.
    model, own_letters = own.model, {b: c for c, b in letters.items()}
    model._resize_cache(0)  # a lexicon asks for each word once

    def encode(words: list[str]) -> list[list[int]]:
        return [[x.id for x in model.tokenize(word.encode().decode("latin-1").translate(own_letters))] for word in words]

    return encode, table


def piece_level(path: str) -> tuple[Callable, list[bytes]]:
    """encode and byte table of a sentencepiece model that puts a space before each text, so words come to encode without theirs."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    alone = own.piece_to_id("▁")
    table = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]

    def encode(words: list[str]) -> list[list[int]]:
        return [ids if w else [alone] for w, ids in zip(words, own.encode(words, num_threads=1))]

    return encode, table


SPACED = re.compile(" +[^ ]*")


def spaced(text: str) -> list[str]:
    """Spaces and what follows them, without the first space. No piece of such a model has a space after anything else, so merges stay
    within these."""
    if "  " not in text and text[-1:] != " ":
        return text[1:].split(" ") if text else []
    return [x[1:] for x in SPACED.findall(text)]


@functools.lru_cache(maxsize=2)
def sides(byte_path: str, piece_path: str, pattern: str) -> tuple[Side, Side]:
    """One of each per Python worker."""
    return Side(splitter(pattern), *byte_level(byte_path)), Side(spaced, *piece_level(piece_path), " ")


#: Of each side: ids and ends of tokens; the ids in decimal, each with a comma; and for each byte the id of the token that covers
#: it, and where the text of the next one begins. These two have a number more: the first is for the place before the text.
COLUMNS = {f"{side}_{what}": kind for side in "ab" for what, kind in (("ends", "array<int>"), ("texts", "binary"), ("id_at", "array<int>"), ("next_at", "array<int>"))}


def laid_out(found: list[np.ndarray], lengths: np.ndarray, decimal: pa.Array) -> list[pa.Array]:
    """COLUMNS of one side. found: ids of each text; decimal: each id with a comma."""
    sizes = [lengths[x] for x in found]
    ends = np.concatenate([np.cumsum(x, dtype=np.int32) for x in sizes])
    counts = np.fromiter(map(len, found), np.int64, len(found))
    stops = np.cumsum(counts)
    ids = np.concatenate(found).astype(np.int32)
    texts = decimal.take(pa.array(ids))
    places = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    bounds = np.concatenate([[0], stops])
    whole = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.ascontiguousarray(places[bounds])), texts.buffers()[2]])
    # A token of one byte before each text that has any stands for its beginning.
    some = np.flatnonzero(counts)
    before = bounds[some]
    first = places[bounds[:-1]]
    each = np.insert(np.concatenate(sizes), before, 1)
    following = np.insert(places[1:] - np.repeat(first, counts) + 1, before, 1)
    at = np.concatenate([[0], np.cumsum([int(x.sum()) + 1 if len(x) else 0 for x in sizes])])
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    return [lists(bounds, ends), whole, lists(at, np.repeat(np.insert(ids, before, 0), each)), lists(at, np.repeat(following, each))]


def tokenised(documents: DataFrame, byte_path: str, piece_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, and of each side the COLUMNS of its tokens; empty for texts without tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = sides(byte_path, piece_path, pattern)
        nothing = np.empty(0, np.uint32)
        gc.disable()  # lists of words and ids hold no cycles, and are many
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                texts = part["text"].to_pylist()
                spaced = [" " + t if t else "" for t in texts]
                # An underline that stands for spaces would come out as one.
                found = [(a, b) if a is not None and b is not None and "▁" not in t else (nothing, nothing) for t, a, b in zip(spaced, a_side(spaced), b_side(spaced))]
                columns = [x for i, side in enumerate((a_side, b_side)) for x in laid_out([y[i] for y in found], side.lengths, side.decimal)]
                yield pa.RecordBatch.from_arrays([part["id"], *columns], names=["id", *COLUMNS])

    chosen = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return chosen.mapInArrow(rows, "id long, " + ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()))


def bound(columns: list[str], body: Callable[..., Column]) -> Column:
    """body of columns that are read from the row once, however many elements body looks at."""
    return body() if not columns else let(F.col(columns[0]), lambda own: bound(columns[1:], functools.partial(body, own)))


def aligned(tokens: DataFrame) -> DataFrame:
    """id, n_a, n_b, n (groups, links), links (array of a * PAIR + b) and groups (their text) of each row.

    A group's ids are a stretch of its side's text, as bytes: their places are bytes of the text then, found without counting code points.
    """
    sizes = [F.size(f"{x}_ends").cast("long").alias(f"n_{x}") for x in "ab"]
    now = tokens.select("*", *sizes, F.array_intersect("a_ends", "b_ends").alias("common"))
    now = now.withColumn("before", F.slice(F.concat(F.array(F.lit(0)), "common"), F.lit(1), F.size("common")))  # compiled here, not beside inner functions

    def own(texts: Column, following: Column, low: Column, high: Column) -> Column:
        """The ids between two ends: their text without its last comma."""
        return F.substring(texts, F.get(following, low), F.get(following, high) - F.get(following, low) - 1)

    links = bound(["a_id_at", "b_id_at"], lambda a, b: F.transform("common", lambda e: F.get(a, e).cast("long") * PAIR + F.get(b, e)))
    group = lambda a, a_next, b, b_next: F.zip_with("before", "common", lambda low, high: F.concat(own(a, a_next, low, high), F.lit(b"|"), own(b, b_next, low, high)))
    groups = bound(["a_texts", "a_next_at", "b_texts", "b_next_at"], group)
    return now.select("id", "n_a", "n_b", F.size("common").cast("long").alias("n"), links.alias("links"), F.array_join(groups.cast("array<string>"), ";").alias("groups"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best (whether no pair of its b has more). links: rows with a pair each."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.pmod("pair", F.lit(PAIR)))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(documents: DataFrame, byte_path: str, piece_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    whole = aligned(tokenised(documents, byte_path, piece_path, pattern, id_column, text_column))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    whole = materialize(whole.select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n", "links", digest.alias("groups_sha256")), "aligned")
    links = whole.select("row", F.explode("links").alias("pair"))
    pairs = materialize(pair_counts(links), "pairs")
    distinct, total = pairs.agg(F.count("*"), F.sum("n")).first()
    least = 1 if distinct <= frequent else total // frequent + 1
    near = links.join(F.broadcast(pairs.where(F.col("n") >= least)), "pair", "left")
    sums = [F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best")]
    rows = near.groupBy("row").agg(*sums)
    if least > 1:
        rare = near.where("n is null").groupBy("row", "pair").agg(F.count("*").alias("times"))
        rare = rare.join(pairs.where(F.col("n") < least), "pair")
        rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.col("best").cast("long") * F.col("times")).alias("n_best"))
        rows = rows.union(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = whole.drop("links").join(rows, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_column), "n_a", "n_b", F.col("n").alias("n_groups"), F.col("n").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
