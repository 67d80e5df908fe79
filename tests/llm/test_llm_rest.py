"""Vector search, HTML, URL filters, WARC, the registered queries and the pipeline."""

import base64
import io
import zipfile

import numpy as np
import other_pages
import pytest
from conftest import DATA, same

from test_llm_text import check_packing, near_classes

from textloom.llm import boosting, dom, exact_topk, hnsw, html_text, near_dup, quality, queries, suffix_dedup, url_filter, warc
from textloom.llm import vectors as vectors_module

VECTORS = "vec_id long, embedding array<float>, rank int"


def vectors(spark, n=400, d=8):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=d).astype("float32").tolist(), 0) for i in range(n)]
    rows[7] = (7, rows[6][1], 0)
    rows[30] = (30, rows[6][1], 0)
    rows += [(9001, None, 0), (9002, [1.0] * (d - 1) + [None], 0), (9003, [float("nan")] * d, 0), (9004, [0.0] * d, 0), (9005, [], 0), (None, rows[0][1], 0), (50, rows[50][1], 0), (9006, [1.0, 2.0], 0), (9007, [float("inf")] * d, 0)]
    return spark.createDataFrame(rows, VECTORS).repartition(3), rows


def valid(rows, zeros):
    out = [(i, np.array(v, dtype=float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    return [(i, v) for i, v in out if zeros or v.any()]


def test_exact_topk(spark):
    df, rows = vectors(spark)
    got = sorted(map(tuple, exact_topk.top_k(exact_topk.chosen(df, "vec_id", 10), df, 5, 256.0, shard_rows=64, query_rows=7).collect()))
    known = [(i, np.floor(256 * v).astype(int)) for i, v in valid(rows, True)]
    want = []
    for q, v in known:
        if q % 10 == 0:
            best = sorted((-int(v @ w), i) for i, w in known if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    twice = [r for r in want if r[0] == 50]  # two rows with one id are one query, of the best of both
    assert [r for r in got if r[0] != 50] == sorted(r for r in want if r[0] != 50) and {r[0] for r in got} == {r[0] for r in want} and twice


def test_exact_topk_sparse_and_large(spark):
    """Rows with few terms, weights beyond a long and sums beyond it, against Python's integers."""
    random = np.random.default_rng(5)
    rows = [(i, (random.normal(size=12) * (random.random(12) < 0.2)).tolist(), 0, "a", 1.0) for i in range(90)]
    rows += [(100, [3e38] + [0.0] * 11, 0, "b", 2.0), (101, [-3e38, 1e300] + [0.0] * 10, 0, "c", 3.0), (110, [4e16] * 12, 0, "d", 4.0), (120, [1.0, 1.0] + [0.0] * 10, 0, "e", 5.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, ids string, score double").repartition(3)
    got = sorted(map(tuple, exact_topk.top_k(exact_topk.chosen(df, "vec_id", 10), df, 4, 256.0, shard_rows=40, query_rows=5).collect()))
    known = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows]
    want = []
    for q, v in known:
        if q % 10 == 0:
            scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in known if i != q]
            want += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:4])]
    assert got == sorted(want) and {2**63 - 1, -(2**63)} & {r[3] for r in got}


def test_postings_round_trip():
    rows = np.array([[0.0, 2, 0, 1], [0, 0, 0, -3], [0, 5, 0, 7]])
    for by_term, lists in ((True, rows.T), (False, rows)):
        back = np.zeros(lists.shape)
        for x, (places, weights) in zip(back, exact_topk.lists_of(exact_topk.sparse(rows, by_term), *lists.shape)):
            x[slice(None) if places is None else places] = weights
        assert (back == lists).all()


def test_hnsw_recall_and_scores(spark):
    df, rows = vectors(spark, 1500)
    graphs = hnsw.index(df, keep=11, shard_rows=400, ef=48)
    got = hnsw.nearest(exact_topk.chosen(df, "vec_id", 25), graphs, 10).collect()
    known, hits, total = valid(rows, False), 0, 0
    by_id = dict(known)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(np.sqrt(((by_id[r.query_id] - by_id[r.vec_id]) ** 2).sum())), abs=1e-12)
    for q, v in known:
        if q % 25 == 0 and q != 50:
            best = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in known if i != q and len(w) == len(v))[:10]
            own = sorted(found[q], key=lambda r: r.rank)
            assert [r.rank for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
            hits += len({i for _, i in best} & {r.vec_id for r in own})
            total += 10
    assert hits / total > 0.95
    assert {r.vec_id for r in found[0]}.isdisjoint(range(9001, 9008))


def test_hnsw_many_copies(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(300)] + [(300 + i, [float(i), 1.0], 0) for i in range(40)]
    got = hnsw.nearest(spark.createDataFrame(rows[:1], VECTORS), hnsw.index(spark.createDataFrame(rows, VECTORS), keep=11), 10).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, 0.0) for i in range(1, 11)]


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert exact_topk.top_k(none, none, 5, 256.0).collect() == [] and hnsw.nearest(none, hnsw.index(none), 3).collect() == []


URLS = ["http://WWW.Example.COM/en/x?y", "https://example.com/en/", "http://a.example.com/en", "ftp://x.net/es/1#f", "http://net/fr/", "http://x.org", "no url", None, "http://", "http://example.com", "x://y.net/ES/", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://com./", "http://x.com?q=/en/"]


def plain_verdict(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h), len(p)) > (len(best[1]), len(best[2]))):
            best = (verdict, h, p)
    return (best[1] + best[2], best[0]) if best else (None, "allow")


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "k", "z") for i, u in enumerate(URLS)] + [(0, URLS[0], "k", "z")], "page_id long, url string, host string, html string")
    rules = [*queries.URL_RULES, ("block", "org", ""), ("block", "com", "/p/p")]
    got = url_filter.judge(df, rules).collect()
    joined = url_filter.judge(df, rules, max_trie_bytes=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, joined)) and len(got) == len(URLS) + 1
    for r in got:
        assert (r.rule, r.verdict) == plain_verdict(r.host, r.path, rules), r
    by = {r.page_id: r for r in got}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (by[7].host, by[7].path, by[7].verdict) == ("", "", "allow")
    assert url_filter.judge(df.limit(0), rules).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_package(zip64):
    sink = io.BytesIO()
    package = warc.Package(sink, zip64)
    package.add("a/b.txt", [b"one", b"two"])
    package.add("c", [])
    package.close()
    reader = warc.Reader(io.BytesIO(sink.getvalue()))
    assert reader.range("a/b.txt", 2, 5) == b"etw" and reader.locate("c")[1] == 0
    with zipfile.ZipFile(io.BytesIO(sink.getvalue())) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"onetwo"


def test_zip_made_elsewhere():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("x", b"stored")
        z.writestr("y", b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    reader = warc.Reader(io.BytesIO(sink.getvalue()))
    assert reader.range("x", 0, 6) == b"stored"
    with pytest.raises(ValueError):
        reader.locate("y")
    with pytest.raises(ValueError):
        warc.Reader(io.BytesIO(b"no archive"))


@pytest.mark.parametrize("least,zip64", [(0, False), (4, True)])
def test_warc_round_trip(spark, least, zip64):
    rows = [(1, "same"), (2, "same"), (9, "same"), (3, None), (4, ""), (5, "é" * 50_000), (6, "one"), (None, "same"), (7, "one"), (7, "one"), (8, "WARC/1.1\r\n\r\nx\r\n\r\n")]
    df = spark.createDataFrame([(i, h, "u") for i, h in rows], "page_id long, html string, payload string").repartition(3)
    got = sorted(((r.id, r.payload_bytes, r.digest, r.type, r.refers_to, r.payload) for r in warc.read(warc.write(df, least_bytes=least, zip64=zip64, archive_bytes=600)).collect()), key=str)
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        top = max((j for j, g in rows if (g or "").encode() == raw and j is not None), default=None)
        revisit = len(raw) >= least and i != top
        want.append((i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", top if revisit else None, None if revisit else raw))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=str)]
    assert sorted(bytes(g[5]) for g in got if g[5] is not None) == sorted(w[5] for w in want if w[5] is not None)
    assert warc.read(warc.write(df.limit(0))).collect() == []


def test_dom():
    page = dom.read("<p>a<b>b<p class='x-yZ'>c &amp; d<br>e<script>if (a < b) '</p>'</script><li>f<li>g<table><tr><td>h<td>i")
    assert [t for _, t, _ in page.blocks] == ["ab", "c & d e", "f", "g", "h", "i"]
    assert ("x", "y", "z") in page.tokens
    assert dom.read("").blocks == [] and dom.read("<<<>>><a href=\"x>").end[0] >= 1


def test_dom_keeps_formulas_drawings_and_fallbacks():
    page = dom.read("<article><p>The sum is <math><mi>x</mi><mo>+</mo><mi>y</mi></math> and <object>fallback words</object> end.<p>One <svg viewBox='0'><path d='M'/><text>a</text><text>b</text></svg> two<noscript><p>Plain.</noscript><svg><p>after</p><select><option>no</select><iframe>no</iframe></article>")
    assert [t for _, t, _ in page.blocks] == ["The sum is x+y and fallback words end.", "One a b two", "Plain.", "after"]


def plain_boosting(x, y, trees, depth, rate, bins, l2, least):
    """Every node tries every feature and cut on the rows themselves."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            split = []
            for rows in nodes:
                best, left = 1e-6, np.ones(len(rows), bool)
                for j, own in enumerate(cuts):
                    for cut in own:
                        low = x[rows, j] <= cut
                        a, b = rows[low], rows[~low]
                        if min(h[a].sum(), h[b].sum()) < least * 0.05:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best + 1e-12:
                            best, left = gain, low
                split += [rows[left], rows[~left]]
            nodes = split
        for rows in nodes:
            margin[rows] += rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_boosting_against_plain_trees():
    random = np.random.default_rng(2)
    x = random.normal(size=(120, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (random.random(120) < 0.1)).astype(float)
    options = {"trees": 4, "depth": 3, "rate": 0.3, "bins": 8, "l2": 1.0, "least": 4.0}
    assert np.allclose(boosting.fit(x, y, **options).margin(x), plain_boosting(x, y, **options))


def test_decoding_is_the_best_of_all_consistent_choices():
    random = np.random.default_rng(3)
    for source in ("<div><div><p>a<p>b</div><p>c</div>", "<p>a", "<div><div><div><div>a", "<ul><li>a<li>b<li>c</ul><p>d"):
        page = dom.read(source)
        n = len(page.tag)
        for _ in range(40):
            odds = random.normal(size=n) * 2

            def worth(inside):
                return float(np.where(inside, odds, 0).sum())

            best = -np.inf
            stack = [(1, [s]) for s in (0, 1)]
            while stack:
                i, states = stack.pop()
                if i == n:
                    best = max(best, worth(np.array(states) == 1))
                    continue
                up = states[page.parent[i]]
                stack += [(i + 1, [*states, s]) for s in {up, min(2, up + 1)}]
            assert worth(html_text.decode(page, odds)) == pytest.approx(best)


def test_html_trees_are_stored(spark, monkeypatch):
    first = html_text.stored_model(spark)
    monkeypatch.setattr(html_text, "model", type("Never", (), {"__wrapped__": html_text.model.__wrapped__}))
    lexicon, forest = html_text.stored_model(spark)
    assert lexicon == first[0] and (forest.feature == first[1].feature).all() and (forest.threshold == first[1].threshold).all() and (forest.leaf == first[1].leaf).all()


def test_url_trie_is_measured(spark):
    rules = [("block", f"h{i}.net", "/a/") for i in range(200)]
    texts, size = sum(len(h) + len(p) for _, h, p in rules), url_filter.size_of(url_filter.build(rules))
    assert size > 10 * texts
    df = spark.createDataFrame([(i, f"http://h{i}.net/a/b") for i in range(0, 300, 7)], "page_id long, url string")
    frames = [url_filter.judge(df, rules, max_trie_bytes=most) for most in (size, size - 1, texts - 1)]
    plans = [f._jdf.queryExecution().toString() for f in frames]
    assert ["MapInArrow" in p for p in plans] == [True, False, False]
    assert len({str(sorted(f.collect())) for f in frames}) == 1


def test_html_made_up_pages():
    lexicon, forest = html_text.model()
    maker, right = html_text.Maker(99), 0
    for _ in range(150):
        page, y = html_text.labelled(maker.page())
        right += html_text.main_text([page], lexicon, forest)[0] == "\n\n".join(t for n, t, _ in page.blocks if y[n])
    assert right / 150 > 0.9


def test_html_pages_of_another_make():
    """Lists, headings and bare text stay; what the pages were made to show, and most of those written later."""
    lexicon, forest = html_text.model()
    exact = lambda pages: [html_text.main_text([dom.read(h)], lexicon, forest)[0] == t for h, t in pages]
    assert all(exact(other_pages.PAGES))
    assert sum(exact(other_pages.FRESH)) >= 0.6 * len(other_pages.FRESH)


def test_html_table(spark):
    good = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1><p>One &amp; two,\n three.</p><p>More words here for the text.</p></article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", good), (2, None, None), (3, "u", ""), (1, "u", good), (4, "u", "<article>" + "<p>long words in a text, and more.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == "Head\n\nOne & two, three.\n\nMore words here for the text." and by[1].n_chars == len(by[1].text)
    assert (by[2].text, by[2].n_chars, by[3].text) == ("", 0, "") and by[4].text.count("\n\n") == 2999
    assert html_text.extract(df.limit(0)).collect() == []


def test_tree_choices_are_consistent():
    page = dom.read("<div><div><p>a<p>b</div><p>c</div>")
    odds = np.random.default_rng(0).normal(size=(200, len(page.tag)))
    for o in odds:
        content = html_text.decode(page, o)
        for i, c in enumerate(content):
            path, at = [], i
            while at >= 0:
                path.append(bool(content[at]))
                at = page.parent[at]
            changes = sum(a != b for a, b in zip(path, path[1:]))
            assert changes <= 2 and (changes < 2 or not path[0])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts, names = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        if name != "packing":
            assert docs.columns == names
            docs = corpus_pipeline.materialize(docs, name)
            counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 100
    assert docs.select("doc_id").distinct().count() == counts[3]
    assert corpus_pipeline.run(spark, DATA).count() > 0


def plain_places(text):
    """The classifier's features of a text, one n-gram at a time."""
    raw, found = text.encode(), set()
    for n in range(1, quality.LONGEST + 1):
        for i in range(len(raw) - n + 1):
            rolled = 0
            for b in raw[i : i + n]:
                rolled = (rolled * 16777619 + b + 1) % 2**32
            found.add((rolled * 2654435761 % 2**32 ^ n * 0x9E3779B1 % 2**32) >> 32 - quality.BITS)
    words = text.split()
    again = [a == b for a, b in zip(words, words[1:])]
    if any(again):
        found |= {quality.hash_of(0, x) for x in again}
        longest = max(len(run) for run in "".join("x" if a else " " for a in again).split())
        found |= {quality.hash_of(n, True) for n in range(1, min(8, longest) + 1)}
    return found


def plain_score(model, text):
    at = sorted(plain_places(text))
    size = sum(float(model.ratio[i]) ** 2 for i in at) ** 0.5
    margin = sum(float(model.weight[i]) * float(model.ratio[i]) for i in at) / (size or 1) + model.bias
    return 1 / (1 + np.exp(-(model.a * margin + model.b)))


def without_bytes(docs, width):
    """What suffix dedup leaves of each (id, text): characters of which a byte stays, stay."""
    least, out = {}, {}
    for i, t in docs:
        raw = t.encode()
        for at in range(len(raw) - width + 1):
            least[raw[at : at + width]] = min(least.get(raw[at : at + width], i), i)
    for i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - width + 1):
            if least[raw[at : at + width]] < i:
                gone[at : at + width] = True
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept += "" if gone[at : at + n].all() else c
            at += n
        out[i] = kept
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage's result on texts of the test table against loops over them."""
    import corpus_pipeline

    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect() if len(r.text or "") < 3000][:110]
    docs = spark.createDataFrame(rows)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    first = corpus_pipeline.materialize(stages["quality"](spark, docs, str(tmp_path)), "quality")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in rows}
    scores = {i: plain_score(model, t) for i, t in texts.items()}
    assert all(abs(s - quality.THRESHOLD) > 1e-6 for s in scores.values())
    good = sorted(i for i, s in scores.items() if s >= quality.THRESHOLD)
    assert sorted(r.doc_id for r in first.collect()) == good and 0 < len(good) < len(rows)
    second = corpus_pipeline.materialize(stages["near_dup"](spark, first, str(tmp_path)), "near_dup")
    known = [(i, texts[i]) for i in good]
    classes = near_classes(known, near_dup.inverse_frequencies(near_dup.texts_of(first, "doc_id", "text")))
    left = sorted(i for i, c in classes.items() if i == c)
    assert sorted(r.doc_id for r in second.collect()) == left and len(left) < len(good)
    third = corpus_pipeline.materialize(stages["suffix_dedup"](spark, second, str(tmp_path)), "suffix_dedup")
    shorter = without_bytes([(i, texts[i]) for i in left], suffix_dedup.WIDTH)
    assert {r.doc_id: r.text for r in third.collect()} == shorter and sum(map(len, shorter.values())) < sum(len(texts[i]) for i in left)
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    check_packing(stages["packing"](spark, third, str(tmp_path)).collect(), library, sorted(shorter.items()))


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated texts and ids, and columns named like the stages' own, through all stages."""
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, long), (2, None), (3, ""), (4, "a" * 5000), (5, "tie tie"), (5, "tie tie"), (None, "no id"), (None, None), (6, long), (7, long + " end"), (8, "good words of a text"), (9, "x " * 900)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, `order` string, block string, id string, score double, start string, digest string, doc string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "o", "b", "i", 0.0, "st", "d", "x") for i, t in rows], kind).repartition(3)
    spark.createDataFrame([(1, 1), (7, 1), (8, 1), (2, None), (4, 0), (9, 0), (5, 1), (3, 1), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "none/labels.parquet"))
    for folder, table in ((tmp_path, docs), (tmp_path / "none", docs), (tmp_path, docs.limit(0))):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(folder))
            if name != "packing":
                assert now.columns == docs.columns
                now = corpus_pipeline.materialize(now, f"awkward-{name}")
        ids = {r.doc_id for r in now.collect()}
        if folder != tmp_path:  # no labels: nothing is rejected
            assert ids == {1, 2, 4, 5, 8, 9, None} or ids == {1, 2, 4, 5, 7, 8, 9, None}
        elif table is docs:
            assert 1 in ids and 6 not in ids and 7 not in ids
        else:
            assert ids == set()


@pytest.mark.parametrize("most", [1, 3000])
def test_vector_tiles_give_the_same_rows(spark, monkeypatch, most):
    """Many groups of queries, and one shard in several of them: what is held and what is met changes nothing."""
    df, _ = vectors(spark)
    whole = [sorted(map(tuple, exact_topk.top_k(exact_topk.chosen(df, "vec_id", 10), df, 5, 256.0, shard_rows=64, query_rows=7).collect()))]
    graphs = hnsw.index(df, shard_rows=100)
    whole.append(sorted(map(tuple, hnsw.nearest(exact_topk.chosen(df, "vec_id", 10), graphs, 5, query_rows=7).collect())))
    monkeypatch.setattr(vectors_module, "QUERY_BYTES", most)
    assert whole[0] == sorted(map(tuple, exact_topk.top_k(exact_topk.chosen(df, "vec_id", 10), df, 5, 256.0, shard_rows=64, query_rows=7).collect()))
    assert whole[1] == sorted(map(tuple, hnsw.nearest(exact_topk.chosen(df, "vec_id", 10), graphs, 5, query_rows=7).collect()))
