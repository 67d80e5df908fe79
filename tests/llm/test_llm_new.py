"""SimHash, alignment of tokenizers and spelling variants against plain versions, on the smallest tables and awkward rows."""

import functools
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as P
from textloom.llm import alignment, queries, simhash, spelling

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

AWKWARD = [
    (1, None, "x", 5), (2, "", "x", 5), (3, " \t\n", None, None), (4, "word", "y", 1), (5, "two Words", "y", 1), (6, "two wORDS", "y", 1), (7, "a b c d", "y", 1), (7, "a b c e", "y", 1),
    (None, "a b c d", "y", 1), (8, "Äpfel und Öl  sind teuer heute, sehr teuer", "y", 1), (9, "<|endoftext|> <s> </s> <unk> ▁ a", "y", 1), (10, "<|endoftext|> <s> </s> <0x41> b", "y", 1),
    (11, "emoji \U0001f600\U0001f600 and \x00 zero \x0b\x0c", "y", 1), (12, "   spaces   run  out   ", "y", 1), (13, "long " * 30000, "y", 1), (14, "nospace" * 3000, "y", 1), (15, "a b c d", "y", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, s, n, i, "f") for i, t, s, n in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, pair string, n long, word long, fp string").repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def table(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# ---- SimHash ----


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(rows, radius=4):
    rows = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    distinct = sorted({f for _, f in rows})
    up = {f: f for f in distinct}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for k, f in enumerate(distinct):
        for g in distinct[:k]:
            if (f ^ g).bit_count() <= radius:
                up[top(f)] = top(g)
    least = {}
    for i, f in rows:
        least[top(f)] = min(i, least.get(top(f), i))
    return sorted((i, f"{f:016x}", least[top(f)]) for i, f in rows)


def test_simhash_query(spark, documents):
    got = queries.op11_simhash(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_classes(table(documents))


def test_simhash_awkward(spark, awkward):
    assert sorted(map(tuple, simhash.classes(awkward).collect())) == plain_classes(table(awkward))
    assert simhash.classes(awkward.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1, 7, 2048])
def test_simhash_links(spark, most):
    """Near groups and chains of fingerprints; small parts, so that trees meet other parts."""
    random = np.random.default_rng(1)
    values = random.integers(0, 1 << 63, 60).astype(np.uint64)
    bit = lambda n: np.uint64(1) << random.integers(0, 64, n).astype(np.uint64)
    for _ in range(6):
        values = np.concatenate([values, values[:60] ^ bit(60) ^ bit(60) ^ bit(60), values[-60:] ^ bit(60) ^ bit(60) ^ bit(60) ^ bit(60)])
    values = np.unique(values).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(3)
    found = simhash.links(frame, most=most).collect()
    u = values.view(np.uint64)
    label = np.arange(len(u))
    place = {int(v): i for i, v in enumerate(values)}
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    for r in found:
        assert r.a != r.b
    want = simhash.merged(label.copy(), *np.nonzero(near))
    got = simhash.merged(label.copy(), np.array([place[r.a] for r in found]), np.array([place[r.b] for r in found]))
    assert (want == got).all() and len(set(want.tolist())) < len(u) - 100


@pytest.mark.parametrize("count", [1, 10**6, 10**9, 10**12])
def test_simhash_shards_hold_every_link(count):
    """Whatever the number of blocks, two values that differ in 4 bits share a choice of blocks."""
    random, masks = np.random.default_rng(2), simhash.masks(count)
    for _ in range(200):
        a = int(random.integers(0, 1 << 63))
        b = a
        for i in random.choice(64, 4, replace=False):
            b ^= 1 << int(i)
        assert any(a & m == b & m for m in masks)


# ---- alignment ----


@functools.cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_own = Tokenizer.from_file(BYTES)
    a_own.encode_special_tokens = True
    return a_own, SentencePieceProcessor(model_file=PIECES)


def plain_alignment(rows):
    a_own, b_own = libraries()
    _, a_table = alignment.byte_level(BYTES)

    def b_bytes(i):
        piece = b_own.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    texts, count = [], Counter()
    for i, text in rows:
        a, b = ([], []) if not text else (a_own.encode(" " + text, add_special_tokens=False).ids, b_own.encode(text))
        raw = (" " + text).encode() if text else b""
        if b"".join(a_table[x] for x in a) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        ends = lambda ids, size: list(itertools.accumulate(size(x) for x in ids))
        a_ends, b_ends = ends(a, lambda x: len(a_table[x])), ends(b, lambda x: len(b_bytes(x)))
        a_at, b_at = dict(zip(a_ends, a)), dict(zip(b_ends, b))
        common = sorted(set(a_ends) & set(b_ends))
        links = [(a_at[e], b_at[e]) for e in common]
        groups = []
        a_cuts, b_cuts = ([0, *(own.index(e, k) + 1 for k, e in enumerate(common))] for own in (a_ends, b_ends))
        for k in range(len(common)):
            groups.append("|".join(",".join(map(str, ids[cuts[k] : cuts[k + 1]])) for ids, cuts in ((a, a_cuts), (b, b_cuts))))
        count.update(links)
        texts.append((i, a, b, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (i, len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, a, b, links, groups in texts
    ]


ALIGNED = [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_alignment_query(spark, documents):
    got = queries.op12_alignment(spark, DATA)
    assert got.dtypes == ALIGNED
    assert ordered(got.collect()) == ordered(plain_alignment(table(documents)))


@pytest.mark.parametrize("frequent", [1 << 20, 20])
def test_alignment_awkward(spark, awkward, frequent):
    """Also with few pairs broadcast, so that rare ones meet by a shuffle."""
    want = plain_alignment(table(awkward))
    got = alignment.summed(awkward, BYTES, PIECES, P.PATTERN, frequent=frequent)
    assert ordered(got.collect()) == ordered(want)
    assert {r[0] for r in want if r[1] == 0} == {1, 2, 9}
    if frequent == 20:
        assert alignment.summed(awkward.limit(0), BYTES, PIECES, P.PATTERN).collect() == []


def test_each_byte_knows_its_token_and_the_next_ones_text():
    """One number a byte, so that Spark finds what ends somewhere in one step; texts without tokens are empty."""
    lengths, decimal = np.array([1, 3, 2], np.int32), pa.array([b"0,", b"1,", b"2,"])
    found = [np.array(x, np.uint32) for x in ([], [1, 0], [], [2, 2, 1], [])]
    ends, texts, ids, following = (x.to_pylist() for x in alignment.laid_out(found, lengths, decimal))
    assert ends == [[], [3, 4], [], [2, 4, 7], []] and texts == [b"", b"1,0,", b"", b"2,2,1,", b""]
    assert ids == [[], [0, 1, 1, 1, 0], [], [0, 2, 2, 2, 2, 1, 1, 1], []]
    assert following == [[], [1, 3, 3, 3, 5], [], [1, 3, 3, 5, 5, 7, 7, 7], []]


def test_a_side_encodes_each_of_many_words_once_and_knows_bad_ones():
    """300,000 words are held; words whose ids' bytes are others' only in a row are told."""
    asked = []

    def encode(words):
        asked.extend(words)
        return [[0] if w == "ab" else [1, 2] if w == "c" else [3] * len(w) for w in words]

    side = alignment.Side(str.split, encode, [b"a", b"b", b"c", b"x"])
    assert side.lexicon.encode(["ab", "bc"]) == [[alignment.BAD]] * 2
    assert side.lexicon.encode(["ab", "c"]) == [[alignment.BAD]] * 2 and side.lexicon.encode(["x", "xx"]) == [[3], [3, 3]]
    asked.clear()
    texts = [" ".join(f"w{i}" for i in range(k, k + 50_000)) for k in range(0, 300_000, 50_000)]
    assert list(side(texts * 2)) == [None] * 12 and len(asked) == 300_000


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabeE'.,1é▁ <s>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_sides_encode_as_the_libraries_do(text):
    if not text or "▁" in text:
        return
    a_side, b_side = alignment.sides(BYTES, PIECES, P.PATTERN)
    (a,), (b,) = list(a_side([" " + text])), list(b_side([" " + text]))
    a_own, own = libraries()
    assert a.tolist() == a_own.encode(" " + text, add_special_tokens=False).ids
    ids = own.encode(text)
    pieces = b"".join(bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in ids)
    assert (b is None) == (pieces != (" " + text).encode())
    assert b is None or b.tolist() == ids


# ---- spelling variants ----


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count):
    by = defaultdict(list)
    for w in count:
        by[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by[len(w) + k] if one_edit(w, v)] for w in count}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_query(spark, documents):
    got = queries.op13_spelling(spark, DATA)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_variants(plain_words(table(documents)))


def spelled_rows():
    words = {"unspoken": 2000, "unspokes": 150, "unspodes": 12, "unspode": 1, "unspodez": 2, "zzzzzzz": 3, "zzzzzzzz": 40, "Größe×÷en": 30, "größe×en": 3, "aaaaaaa": 20, "aaaaaab": 20, "aaaaaac": 2, "StraßenÄ": 2, "straßenä": 2, "kurz": 9}
    rows = [(i, f"{w} 1{w}_" if i % 2 else w.upper() if w.isascii() else w) for i, (w, n) in enumerate((w, k) for w, n in words.items() for k in range(n) for w in [w])]
    return [*rows, (None, None), (None, "unspoken " * 3), (1, ""), (5, "x" * 5000), (5, "x" * 5000)]


def test_spelling_awkward(spark):
    rows = spelled_rows()
    frame = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    want = plain_variants(plain_words(rows))
    assert sorted(map(tuple, spelling.variants(frame).collect())) == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] == 0 for r in want)
    assert spelling.variants(frame.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text("abé", min_size=1, max_size=6))
def test_neighbourhood_is_full_and_distinct(word):
    """Spelled candidates are all strings at one edit, once each, and their hashes are those of the strings."""
    made = spelling.Neighbours("abé")
    codes, out = made.coded([word]), []
    for kind, hashes, distinct in made.made(codes):
        on = np.flatnonzero(np.broadcast_to(distinct, hashes.shape).ravel())
        w, place, letter = np.unravel_index(on, hashes.shape)
        if len(word) == 1 and kind == "delete":
            continue
        spelled = made.spelled(kind, codes, w, place, letter)
        assert made.hashes(made.coded(spelled)).tolist() == hashes.ravel()[on].tolist()
        out += spelled
    want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abé"} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abé"}
    assert sorted(out) == sorted(want - {word, ""})
