"""Boosted trees on histograms: gains against plain sums, splits against an exhaustive search, and one result however rows are dealt out."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.plans import heads, trees


def made(n, d=6, seed=0):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, d)).round(2)
    z = x[:, 0] * x[:, 1] + np.sin(2 * x[:, 2]) + 0.5 * x[:, 3] + 0.3 * random.normal(size=n)
    return x, (z > 0).astype(float)


def frame(spark, x, y, parts=3):
    rows = [(i, row.tolist(), int(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, y int").repartition(parts, "id")


def auc(y, p):
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        ranks[p == v] = ranks[p == v].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


class Exhaustive:
    """Best-first trees that try every value of every feature, row by row sums, without bins."""

    def __init__(self, settings):
        self.s = settings

    def score(self, g, h):
        s = self.s
        return (np.sign(g) * max(abs(g) - s.l1, 0)) ** 2 / (h + s.l2) if h + s.l2 > 0 else 0.0

    def best(self, x, g, h, rows):
        s, found = self.s, (1e-9, None, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(low), len(high)) < s.least_rows or min(h[low].sum(), h[high].sum()) < s.least_weight:
                    continue
                gain = self.score(g[low].sum(), h[low].sum()) + self.score(g[high].sum(), h[high].sum()) - self.score(g[rows].sum(), h[rows].sum())
                if gain > found[0] + 1e-12:
                    found = (gain, f, v)
        return found

    def tree(self, x, g, h):
        open_, splits = [(self.best(x, g, h, r := np.arange(len(x))), r, 0)], []
        while len(open_) < self.s.leaves:
            able = [i for i, (b, _, level) in enumerate(open_) if b[1] is not None and (not self.s.depth or level < self.s.depth)]
            if not able:
                break
            i = max(able, key=lambda i: open_[i][0][0])
            (gain, f, v), rows, level = open_.pop(i)
            splits.append((gain, f, v))
            for side in (rows[x[rows, f] <= v], rows[x[rows, f] > v]):
                open_.append((self.best(x, g, h, side), side, level + 1))
        return splits, [(rows, -np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - self.s.l1, 0) / (h[rows].sum() + self.s.l2) * self.s.rate) for _, rows, _ in open_]

    def fit(self, x, y, w):
        margin = np.full(len(y), np.log((y * w).sum() / ((1 - y) * w).sum()))
        self.splits = []
        for _ in range(self.s.rounds):
            p = 1 / (1 + np.exp(-margin))
            splits, leaves = self.tree(x, w * (p - y), w * p * (1 - p))
            self.splits.append(splits)
            for rows, value in leaves:
                margin[rows] += value
        return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("settings", [
    trees.Settings(leaves=7, rounds=4, rate=0.3, least_rows=5),
    trees.Settings(leaves=7, rounds=3, rate=0.3, least_rows=5, l1=0.5, l2=2.0, least_weight=2.0, ahead=1),
    trees.Settings(growth="depth", leaves=1 << 30, depth=3, rounds=3, rate=0.3, l2=1.0, least_weight=1.0, least_rows=1),
])
def test_gains_and_leaves_equal_a_plain_computation(spark, settings):
    """Few distinct values, so that bins are exact: the same splits with the same gains, and the same scores."""
    random = np.random.default_rng(5)
    x, y = made(150, 4)
    x, w = x.round(1), random.choice([1.0, 2.5], 150)
    plain = Exhaustive(settings)
    want = plain.fit(x, y, w)
    rows = [(i, row.tolist(), int(t), float(v)) for i, (row, t, v) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int, weight double").repartition(3, "id")
    model = trees.fit(df, settings, block=20)
    for tree, splits in zip(model.trees, plain.splits):
        own = sorted((round(g, 6), f, model.edges[f][b]) for g, f, b in zip(tree.gain, tree.feature, tree.bin) if f >= 0)
        assert own == sorted((round(g, 6), f, v) for g, f, v in splits)
    got = {r.id: r.p for r in trees.with_scores(model, df).collect()}
    assert np.allclose([got[i] for i in range(150)], want, atol=1e-9)


def test_area_is_that_of_an_exhaustive_search(spark):
    settings = trees.Settings(leaves=8, rounds=8, rate=0.3, least_rows=10)
    x, y = made(500, 5, 1)
    other, truth = made(400, 5, 2)
    model = trees.fit(frame(spark, x, y), settings)
    plain = Exhaustive(settings)
    both = np.concatenate([x, other])
    weight = np.concatenate([np.ones(500), np.zeros(400)])  # rows without weight are split but count for nothing
    p = plain.fit(both, np.concatenate([y, truth]), weight)[500:]
    assert abs(auc(truth, trees.sigmoid(model.margins(other))) - auc(truth, p)) < 0.01
    assert auc(truth, trees.sigmoid(model.margins(other))) > 0.85


def test_one_result_however_rows_are_dealt_out(spark):
    """Tasks, prefetched leaves and renewed margins change nothing; a fit in one task gives the same trees."""
    x, y = made(300, 4, 3)
    settings = trees.Settings(leaves=4, rounds=trees.RENEW + 2, rate=0.2, columns=0.5)
    models = [trees.fit(frame(spark, x, y, n), s, block=1 << 15) for n, s in ((1, settings), (4, replace(settings, ahead=1)))]
    local = trees.fit_local(x, y, settings)
    for other in (models[1], local):
        assert other.edges == models[0].edges and len(other.trees) == settings.rounds
        for a, b in zip(models[0].trees, other.trees):
            assert (a.feature, a.bin, a.left) == (b.feature, b.bin, b.left) and np.allclose(a.value, b.value)


def test_early_stopping_and_saving(spark, tmp_path):
    x, y = made(400, 4, 4)
    y[::7] = 1 - y[::7]
    held, truth = made(300, 4, 5)
    settings = trees.Settings(leaves=12, rounds=40, rate=0.8, least_rows=2, stop=3)
    model = trees.fit(frame(spark, x, y), settings, frame(spark, held, truth))
    assert len(model.trees) == int(np.argmin(model.losses)) < 40 and len(model.losses) <= len(model.trees) + 4
    heads.saved(model, str(tmp_path / "model"), {"head": "lgbm"})
    df = frame(spark, held, truth).withColumn("p", F.lit("clash"))
    a = {r.id: r.p for r in trees.with_scores(model, df).collect()}
    b = {r.id: r.p for r in heads.scored(heads.loaded(str(tmp_path / "model"))[0], df).collect()}
    assert a == b and max(model.gains()) > 0


def test_depthwise_pruning_and_awkward_rows(spark):
    x, y = made(200, 4, 6)
    df = frame(spark, x, y)
    whole = trees.fit(df, trees.Settings(growth="depth", leaves=1 << 30, depth=4, rounds=1, l2=1.0, least_rows=1, least_weight=1.0))
    pruned = trees.fit(df, trees.Settings(growth="depth", leaves=1 << 30, depth=4, rounds=1, l2=1.0, least_rows=1, least_weight=1.0, gain=8.0))
    last = [t for t in pruned.trees[0].feature if t >= 0]
    assert len(last) < sum(f >= 0 for f in whole.trees[0].feature)
    odd = spark.createDataFrame([([1.0, None, float("nan")], 1), ([2.0, float("inf"), 3.0], 0), ([None, 1.0, 2.0], 1), ([0.0, 2.0, 1.0], None)] * 30, "features array<double>, y int")
    model = trees.fit(odd, trees.Settings(rounds=3))
    assert all(0 <= r.p <= 1 for r in trees.with_scores(model, odd).collect())
    assert trees.fit(odd.where("y = 1"), trees.LEAFWISE).trees == [] and trees.fit(odd.limit(0), trees.LEAFWISE).trees == []


def test_heads(spark):
    x, y = made(600, 5, 7)
    df = frame(spark, x, y)
    for name in ("lgbm", "xgb"):
        model = heads.fit(name, df.where("id % 3 > 0"), params={"rounds": 12, "rate": 0.2}, val=df.where("id % 3 = 0"))
        row = heads.evaluated(heads.scored(model, df.where("id % 3 = 0"))).first()
        assert row.roc_auc > 0.85, (name, row)


def test_blocks_hold_bins_and_few_rows_as_numbers(monkeypatch):
    """However many rows a block has, the features of PART rows are numbers at once; blocks are as if they were made whole."""
    monkeypatch.setattr(trees, "PART", 100, raising=False)
    sizes, own = [], trees.matrix
    monkeypatch.setattr(trees, "matrix", lambda lists, d: sizes.append(len(lists)) or own(lists, d))
    x = np.random.default_rng(1).normal(size=(1000, 3))
    edges = [[-0.5, 0.0, 0.5]] * 3
    lists = [None if i % 7 == 0 else v for i, v in enumerate(x.tolist())]
    whole = pa.record_batch([pa.array(lists, pa.list_(pa.float64())), pa.array(np.arange(1000.0)), pa.array(np.full(1000, 2.0)), pa.array(np.arange(1000) % 2 == 0)], names=["features", "y", "weight", "held"])
    batches = [whole.slice(0, 250), whole.slice(250, 0), whole.slice(250, 350), whole.slice(600)]
    found = list(trees.blocked(batches, 5, edges, 0.25, 500))
    assert [(b.number, len(b.y)) for b in found] == [(5, 600), (6, 400)] and max(sizes) <= 100
    want = trees.binned(own(whole["features"], 3), edges)
    assert (np.concatenate([b.bins for b in found]) == want).all() and (want[0] == 3).all()
    assert np.concatenate([b.y for b in found]).tolist() == list(range(1000)) and all((b.margin == 0.25).all() and (b.weight == 2).all() and (b.held == (b.y % 2 == 0)).all() for b in found)
