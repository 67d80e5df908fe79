"""Packing, BPE, suffix dedup, near-duplicates and the classifier against plain versions, with awkward rows."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import DATA
from pyspark.sql import functions as F

from textloom.llm import bpe, bwt, near_dup, packing, quality, suffix_dedup
from textloom.llm.components import components

AWKWARD = [
    (1, "The cat's  hat \n\n costs 12½ €"), (2, None), (3, ""), (4, "a" * 30_000), (5, "tie"), (5, "tie"), (None, "no id"), (6, " \t\x85\u3000x\x1c\x1fy "), (7, "漢字 🎉 naïve ÿ²"), (8, "word " * 4000), (9, "<|endoftext|> end"),
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in AWKWARD], "doc_id long, text string, id string, sequence_id int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe_digests(spark, awkward, library):
    got = sorted(bpe.digests(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect(), key=str)
    want = []
    for i, t in AWKWARD:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: str(type(got[0])(*w)))
    assert bpe.digests(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_bpe_round_trip(spark, awkward, library):
    for r in bpe.encode(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert library.decode_bytes(list(r.ids)) == bytes(r.decoded)


def test_bpe_random_strings(library):
    random.seed(1)
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["".join(random.choices("¿ÿñ«ªµab1 \n\t'st.,é\u3000\x1c\x85漢\u200b½²🎉 s", k=random.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t), repr(t)


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(3000)) and (table.find([b"", b"no", b"k3000"]) == -1).all()
    assert sorted(table.keys) == sorted(keys)


def check_packing(rows, library, texts, gapless=True):
    lengths = collections.defaultdict(int)
    docs = collections.defaultdict(list)
    for r in rows:
        lengths[r.sequence_id] += r.length
        docs[r.doc_id].append(r)
    for s, n in lengths.items():
        assert n <= 2048 and (not gapless or sorted((r.offset, r.length) for r in rows if r.sequence_id == s)[0][0] == 0)
    waste = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert waste == 0 or not gapless
    for i, text in texts:
        ids = np.array([*library.encode_ordinary(text or ""), 1], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing(spark, library):
    texts = [(i, t) for i, t in AWKWARD if i != 5]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    rows = packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    check_packing(rows, library, texts)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_packing_repeats_and_waves(spark):
    df = spark.createDataFrame([(i // 2, "some words here " * (i % 40)) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN, wave=4).collect()
    totals = collections.Counter()
    for r in rows:
        totals[r.sequence_id] += r.length
    assert max(totals.values()) <= 2048 and sum(1 for n in totals.values() if n not in packing.TIERS) <= 8
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r.step_group].add(r.sequence_id)
    assert max(map(len, groups.values())) <= packing.GROUP
    for own in groups.values():
        assert len({totals[s] for s in own} & set(packing.TIERS)) <= 1  # a group has windows of one tier, or fragments


def packed_windows(lengths, wave=0):
    """Windows of documents of these lengths; all ids once, and every window full."""
    packer, windows, left = packing.Packer(), [], {}
    for key, n in enumerate(lengths):
        windows += packer.route(n, key)
        left[key] = n
        if wave and packer.tokens >= wave:
            windows += packer.wave()
    windows += packer.flush()
    at = collections.defaultdict(list)
    for tier, pieces in windows:
        size = sum(n for _, _, n in pieces)
        assert size == packing.TIERS[tier] if tier >= 0 else size < packing.TIERS[0] and size & (size - 1) == 0
        for key, start, n in pieces:
            at[key].append((start, n))
    for key, n in left.items():
        upto = 0
        for start, size in sorted(at[key]):
            assert start == upto and size > 0
            upto += size
        assert upto == n
    assert packer.tokens == 0 and sum(1 for tier, _ in windows if tier < 0) <= 8
    return windows


@pytest.mark.parametrize("wave", [0, 20_000])
@pytest.mark.parametrize("tier", range(4))
def test_packing_fills_each_tier(tier, wave):
    """Documents of one tier's size are packed into that tier."""
    random.seed(tier)
    size = packing.TIERS[tier]
    lengths = [random.randint(size // 2 + 1, size) for _ in range(400)]
    windows = packed_windows(lengths, wave)
    assert sum(1 for t, _ in windows if t == tier) * size > 0.6 * sum(lengths)
    assert all(t <= tier for t, _ in windows)


def test_packing_fills_gaps_from_shorter_tiers():
    windows = packed_windows([1700] * 50 + [248, 100] * 50)
    assert windows and all([n for _, _, n in pieces] == [1700, 248, 100] for _, pieces in windows)
    random.seed(1)
    mixed = packed_windows([random.choice((random.randint(1, 256), random.randint(257, 2047), random.randint(2048, 9000))) for _ in range(3000)], 100_000)
    assert {t for t, _ in mixed} >= {0, 1, 2, 3}


def test_packing_clashing_names(spark, awkward, library):
    rows = packing.pack(awkward.withColumn("start", F.lit("y")).withColumn("text2", F.col("text")), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    check_packing([r for r in rows if r.doc_id not in (5, None)], library, [(i, t) for i, t in AWKWARD if i not in (5, None)], gapless=False)
    assert sorted((r.start, r.length) for r in rows if r.doc_id == 5 and r.start == 0) and sum(r.length for r in rows if r.doc_id is None) == len(library.encode_ordinary("no id")) + 1


def test_balanced_groups():
    got = packing.balanced([100, 1, 1, 1, 1, 100, 1, 1], 4)
    assert sorted(collections.Counter(got).values()) == [4, 4] and got[0] != got[5]


@pytest.mark.parametrize("buffer", [1, 3, 7, 1 << 20])
def test_bwt_windows(monkeypatch, buffer):
    """Files read in buffers of a few rows, too: what goes from buffer to buffer is carried on."""
    monkeypatch.setattr(bwt, "BUFFER", buffer)
    random.seed(0)
    for trial in range(150):
        w = random.choice([2, 3, 5])
        texts = [bytes(random.choices(b"ab" if trial % 2 else b"abcd\xff\x00", k=random.randint(w, 14))) for _ in range(random.randint(1, 12))]
        owners = np.array([random.randint(0, 20) for _ in texts])
        sizes = np.array(list(map(len, texts)))
        got, _ = bwt.least_owner(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, owners, w)
        least = {}
        for t, o in zip(texts, owners):
            for i in range(len(t) - w + 1):
                least[t[i : i + w]] = min(least.get(t[i : i + w], 99), o)
        assert got.tolist() == [least[t[i : i + w]] for t in texts for i in range(len(t) - w + 1)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_suffix_dedup(spark, monkeypatch, ranges):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    random.seed(3)
    base, docs = "".join(random.choices("abcdefgh éß日", k=4000)), []
    for i in range(120):
        k, a = random.random(), random.randint(0, 3800)
        t = "".join(random.choices("xyzw é", k=random.randint(0, 300))) + base[a : a + random.choice((30, 49, 50, 51, 60, 200, 400))]
        t = None if k < 0.05 else "" if k < 0.1 else docs[random.randrange(len(docs))][1] if k < 0.2 and docs else "abc" * random.randint(1, 400) if k < 0.25 else t
        docs.append((random.choice([i, i, 7]) if k > 0.03 else None, t))
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, block string").repartition(4)
    got = sorted(map(tuple, suffix_dedup.digests(df, ranges=ranges).collect()), key=str)
    assert got == sorted(suffix_dedup.brute_force(docs), key=str) and sum(r[2] for r in got) > 5000


def test_suffix_clean_keeps_columns_and_characters(spark):
    a = "é" * 40 + "tail"
    df = spark.createDataFrame([(1, a, "o", 5), (2, "start " + a, "p", 6), (3, None, "q", 7)], "doc_id long, text string, `order` string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.clean(df, length_column="n_chars").collect()}
    assert got[1].text == a and got[2].text == "start " and got[2].order == "p" and got[2].n_chars == 6 and got[3].text == ""
    assert suffix_dedup.digests(empty(spark)).collect() == []


def near_classes(docs, idf):
    sets = [near_dup.weighted(near_dup.shingles([(t or "").encode()])[0], idf) for _, t in docs]
    up = {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if near_dup.similarity(sets[a], sets[b]) >= near_dup.THRESHOLD:
                x, y = top(docs[a][0]), top(docs[b][0])
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in docs}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 10)
    random.seed(5)
    words, docs = [f"w{i}" for i in range(500)], []
    base = [random.choices(words, k=120) for _ in range(12)]
    for i in range(300):
        t = list(random.choice(base)) if i % 3 else random.choices(words, k=random.randint(0, 100))
        for _ in range(random.choice((0, 1, 1, 2, 3, 4, 5))):
            if t:
                t[random.randrange(len(t))] = random.choice(words)
        docs.append((i if i % 50 else None, " ".join(t) if i % 31 else None))
    docs += [(5, docs[5][1]), (6, docs[7][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, key int").repartition(4)
    known = [d for d in docs if d[0] is not None]
    want = near_classes(known, near_dup.inverse_frequencies(near_dup.texts_of(df, "doc_id", "text")))
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == want
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_near_duplicates_in_buckets_of_many_groups(spark, monkeypatch):
    """Groups of two that share one bucket only, with many others that are alike but below the threshold."""
    monkeypatch.setattr(near_dup, "CHUNK", 4)
    monkeypatch.setattr(near_dup, "band_keys", lambda own: np.ones(1, np.int64))
    random.seed(8)
    words, docs = [f"w{i}" for i in range(3000)], []
    core = random.choices(words, k=200)
    for i in range(40):
        own = core + random.choices(words, k=50)
        docs += [(i, " ".join(own)), (500 - i, " ".join(own[:-8] + random.choices(words, k=8)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = near_classes(docs, near_dup.inverse_frequencies(near_dup.texts_of(df, "doc_id", "text")))
    assert len(set(want.values())) == 40
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == want


def test_likeness_is_the_similarity_of_every_pair():
    random_ = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        keys = np.unique(random_.integers(0, 60, random_.integers(1, 50)).astype(np.uint64))
        sets.append((keys, random_.choice([1.25, 2.5, 3.75, 7.5], len(keys))))
    got = near_dup.likeness(sets, columns=16)
    assert np.allclose(got, [[near_dup.similarity(a, b) for b in sets] for a in sets], rtol=0, atol=1e-12)


def test_copies_of_a_text_are_dealt_out(spark):
    df = spark.createDataFrame([(i, "one text of many words that is copied") for i in range(600)] + [(1000 + i, f"text {i // 2}") for i in range(80)] + [(5, "text 3")], "doc_id long, text string").repartition(5)
    signed = near_dup.materialize(near_dup.texts_of(df, "doc_id", "text").withColumn("digest", F.md5("text").cast("binary")).select("doc", "digest"), "signed")
    got = {(r.doc, r.representative) for r in near_dup.with_least(signed).collect()}
    assert got == {(i, 0) for i in range(600)} | {(1000 + i, 5 if i // 2 == 3 else 1000 + i // 2 * 2) for i in range(80)} | {(5, 5)}


def test_near_duplicates_of_nothing(spark):
    assert near_dup.classes(empty(spark)).collect() == []


def test_samples_agree_as_often_as_sets_are_alike():
    random_ = np.random.default_rng(0)
    agree, truth = [], []
    for _ in range(60):
        keys = np.sort(random_.integers(0, 1 << 63, 200).astype(np.uint64))
        w = random_.uniform(1, 3, 200)
        v = np.where(random_.random(200) < 0.2, w * 1.5, w)
        a, b = (keys[:190], w[:190]), (keys[10:], v[10:])
        agree.append((near_dup.samples(*a) == near_dup.samples(*b)).mean())
        truth.append(near_dup.similarity(a, b))
    assert abs(np.mean(agree) - np.mean(truth)) < 0.03


def test_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (8, 9), (5, 5), (7, 3), (None, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8)}
    path = spark.range(1, 60).selectExpr("id as a", "id - 1 as b")
    assert {r.component for r in components(path).collect()} == {0}


def test_quality_held_out(spark):
    documents, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels)
    found = quality.score(documents, model).withColumn("held", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").where("held").toPandas()
    good, bad = found.score[found.quality == 1], found.score[found.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert (found.predicted == (found.score >= 0.3)).all()


def test_quality_dual_solution_against_a_plain_solver():
    """Projected gradient on the dual problem with all inner products, and the duality gap."""
    random_ = np.random.default_rng(4)
    rows = [np.unique(random_.integers(0, 40, random_.integers(3, 15))).astype(np.uint32) for _ in range(30)]
    y, cost = (random_.random(30) < 0.5).astype(int), 2.0
    model = quality.fit_margins(rows, y, cost, 5000, 0)
    ratio, sign = quality.log_count_ratio(rows, y).astype(np.float64), np.where(y == 1, 1.0, -1.0)
    x = np.zeros((30, 41))
    for v, places in zip(x, rows):
        v[places] = ratio[places] / np.sqrt(ratio[places] @ ratio[places])
    x[:, 40] = 1  # the bias
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    dual = np.zeros(30)
    for _ in range(60_000):
        dual = np.clip(dual - (q @ dual - 1) / 40, 0, cost)
    plain = (dual * sign) @ x
    assert np.allclose(np.append(model.weight[:40], model.bias), plain, atol=5e-3)
    primal = lambda w: w @ w / 2 + cost * np.maximum(0, 1 - sign * (x @ w)).sum()
    assert primal(plain) - (dual.sum() - dual @ q @ dual / 2) < 1e-3
    assert primal(np.append(model.weight[:40], model.bias)) - primal(plain) < 1e-2


def test_quality_sample_is_bounded(spark):
    documents = spark.createDataFrame([(i % 7, f"text {i}") for i in range(70)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(700)], "doc_id long, quality int")
    seen = []
    original = quality.fit
    quality.fit = lambda rows, y, **options: seen.append(len(rows)) or original(rows, y, **options)
    try:
        quality.train(documents, labels, sample=5)
    finally:
        quality.fit = original
    assert 0 < seen[0] <= 5


def test_quality_awkward(spark, awkward):
    none = quality.train(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(awkward, none).collect()} == {0.5}
    one = quality.train(awkward, spark.createDataFrame([(1, 1), (4, 1), (2, None)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(awkward, one).collect()} == {1.0}
    both = quality.train(awkward, spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, quality int"))
    scored = quality.score(awkward, both).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id == 5}) == 1
    kept = quality.accepted(awkward, both)
    assert kept.columns == awkward.columns and kept.count() == sum(r.predicted for r in scored)
    assert quality.score(empty(spark), both).collect() == []
