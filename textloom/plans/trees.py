"""Boosted trees on gradient histograms: leaf-wise and depth-wise growth of one engine.

Features are cut into bins at quantiles once, and rows are stored as blocks of bin numbers, a byte a feature. Each tree is fitted to
the first and second derivatives of the weighted log loss. A job of the fit sums, per wanted leaf and feature, gradients, Hessians and
rows by bin: each task over its blocks, then over tasks by (leaf, feature). What reaches the driver is leaves * features * bins
numbers, whatever the rows; it picks splits, and tells the larger of two children by taking the smaller one's sums from their
parent's, so that only the smaller one is read.

Leaf-wise growth splits the leaf of largest gain next, up to `leaves`. A leaf's children don't depend on the other leaves, so
those of the `ahead` most promising leaves are summed in one job; the tree is the same as with one at a time. Depth-wise growth
splits all leaves of a level at once down to `depth`, then takes back splits that gain less than `gain`, from below.

A row's margin is that of the stored blocks plus the trees since; every `RENEW` trees blocks are stored anew with theirs. A lost
executor's blocks are read again. Sums are added in the order of blocks, so a fit gives the same trees however rows are dealt
to tasks, as long as blocks are the same.

Cases: features that are null or not finite count as larger than all others; rows without y take no part; without validation rows all
rounds are kept; a feature with one value is never split; an empty table, or one with a single class, gives a constant.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.store import stored

BINS, BLOCK, RENEW = 256, 1 << 15, 16
#: Rows whose features a task has as numbers at once.
PART = 1 << 12


@dataclass(frozen=True)
class Settings:
    """growth: leaf or depth. rows, columns: shares that each tree sees. stop: rounds without a smaller validation loss; 0 for never."""

    growth: str = "leaf"
    leaves: int = 31
    depth: int = 0
    rate: float = 0.05
    rounds: int = 400
    least_rows: int = 20
    least_weight: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    stop: int = 50
    ahead: int = 8
    seed: int = 42


#: The settings that the two heads come with.
LEAFWISE = Settings()
DEPTHWISE = Settings(growth="depth", leaves=1 << 30, depth=6, least_rows=1, least_weight=1.0, l2=1.0, rows=0.85, columns=0.85)


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. A row goes left if its bin is at most the node's."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, at, n, n + 1, gain
        for own, nothing in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            own.extend([nothing, nothing])
        return n, n + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bin numbers."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(feature[node] >= 0)
        while len(inner):
            own = node[inner]
            goes_left = bins[inner, feature[own]] <= at[own]
            node[inner] = np.where(goes_left, left[own], right[own])
            inner = inner[feature[node[inner]] >= 0]
        return node

    def of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Model:
    """Edges of each feature's bins, the margin to begin with, and trees."""

    edges: list[list[float]]
    base: float
    trees: list[Tree]
    settings: Settings
    losses: list[float] = field(default_factory=list)

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return binned(rows, self.edges)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        bins, out = self.binned(rows), np.full(len(rows), self.base)
        for tree in self.trees:
            out += tree.of(bins)
        return out

    def gains(self) -> list[float]:
        """Gain of each feature over all trees."""
        out = [0.0] * len(self.edges)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out

    def to_json(self) -> str:
        return json.dumps({"edges": self.edges, "base": self.base, "trees": [asdict(t) for t in self.trees], "settings": asdict(self.settings), "losses": self.losses})

    @staticmethod
    def from_json(text: str) -> Model:
        x = json.loads(text)
        return Model(x["edges"], x["base"], [Tree(**t) for t in x["trees"]], Settings(**x["settings"]), x["losses"])


def binned(rows: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value: the number of edges below it. What isn't finite is above all."""
    out = np.empty(rows.shape, np.uint8)
    for f, own in enumerate(edges):
        x = rows[:, f]
        out[:, f] = np.where(np.isfinite(x), np.searchsorted(own, x), len(own))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


# ---- sums over blocks ----


@dataclass
class Block:
    """Rows of one block: their bins, targets, weights, margins and whether they only serve to stop early."""

    number: int
    bins: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    margin: np.ndarray
    held: np.ndarray


#: A leaf to be read: (leaf, feature, bin, left), the rows of that side of a split; feature -1 for all of it.
Wanted = tuple[int, int, int, bool]


def sums_of(block: Block, since: list[Tree], tree: Tree, wanted: list[Wanted], settings: Settings, number: int, losses: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums: wanted, 3, features, bins of gradients, Hessians and rows; losses: loss and weight of held rows)."""
    margin = block.margin.copy()
    for t in since:
        margin += t.of(block.bins)
    p = sigmoid(margin)
    loss = np.zeros(2)
    if losses and block.held.any():
        on = block.held
        own = np.where(block.y[on] > 0, np.logaddexp(0, -margin[on]), np.logaddexp(0, margin[on]))
        loss[:] = (own * block.weight[on]).sum(), block.weight[on].sum()
    fits = ~block.held
    if settings.rows < 1:
        fits &= np.random.default_rng([settings.seed, number, block.number]).random(len(fits)) < settings.rows
    d = block.bins.shape[1]
    out = np.zeros((len(wanted), 3, d, BINS))
    leaf = tree.leaf_of(block.bins)
    for k, (node, f, at, left) in enumerate(wanted):
        on = fits & (leaf == node)
        if f >= 0:
            on &= (block.bins[:, f] <= at) == left
        on = np.flatnonzero(on)
        if not len(on):
            continue
        w = block.weight[on]
        g, h, bins = w * (p[on] - block.y[on]), w * p[on] * (1 - p[on]), block.bins[on]
        for i in range(d):
            for j, x in enumerate((g, h, None)):
                out[k, j, i] = np.bincount(bins[:, i], x, BINS)
    return out, loss


class Local:
    """Blocks of one task, for fits that a task can hold."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def sums(self, since: list[Tree], tree: Tree, wanted: list[Wanted], settings: Settings, number: int, losses: bool) -> tuple[np.ndarray, np.ndarray]:
        parts = [sums_of(b, since, tree, wanted, settings, number, losses) for b in self.blocks]
        return sum(x for x, _ in parts), sum(x for _, x in parts)

    def renewed(self, since: list[Tree]) -> Local:
        return Local([replace(b, margin=b.margin + sum(t.of(b.bins) for t in since)) for b in self.blocks])


KINDS = "number long, n int, bins binary, y binary, weight binary, margin binary, held binary"
SCHEMA = pa.schema([("number", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "y", "weight", "margin", "held")]])


def _block(row: dict) -> Block:
    n = row["n"]
    read = lambda c, kind: np.frombuffer(row[c], kind)
    return Block(row["number"], read("bins", np.uint8).reshape(n, -1), read("y", "<f4"), read("weight", "<f8"), read("margin", "<f8"), read("held", np.bool_))


def _row(b: Block) -> dict:
    raw = lambda x, kind: x.astype(kind).tobytes()
    return {"number": b.number, "n": len(b.y), "bins": b.bins.tobytes(), "y": raw(b.y, "<f4"), "weight": raw(b.weight, "<f8"), "margin": raw(b.margin, "<f8"), "held": raw(b.held, np.bool_)}


class Spread:
    """Blocks of a stored table."""

    def __init__(self, blocks: DataFrame, features: int):
        self.table, self.blocks, self.features = blocks, blocks.persist(), features

    def sums(self, since: list[Tree], tree: Tree, wanted: list[Wanted], settings: Settings, number: int, losses: bool) -> tuple[np.ndarray, np.ndarray]:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, first = None, np.zeros(2), -1
            for batch in batches:
                for i in range(batch.num_rows):
                    block = _block({c: batch[c][i].as_py() for c in batch.schema.names})
                    x, y = sums_of(block, since, tree, wanted, settings, number, losses)
                    total, loss, first = (x if total is None else total + x), loss + y, block.number if first < 0 else first
            if total is not None:
                rows = [{"leaf": k, "feature": f, "first": first, "x": np.ascontiguousarray(total[k, :, f]).tobytes()} for k in range(len(wanted)) for f in range(total.shape[2])]
                yield pa.RecordBatch.from_pylist([*rows, {"leaf": -1, "feature": 0, "first": first, "x": loss.tobytes()}], schema)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by leaf, feature and first block, so sums are made in one order."""
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for key, own in zip(zip(batch["leaf"].to_pylist(), batch["feature"].to_pylist()), batch["x"]):
                    x = np.frombuffer(own.as_buffer())
                    held[key] = held[key] + x if key in held else x.copy()
            if held:
                yield pa.RecordBatch.from_pylist([{"leaf": k, "feature": f, "first": 0, "x": x.tobytes()} for (k, f), x in held.items()], schema)

        schema, names = pa.schema([("leaf", pa.int32()), ("feature", pa.int32()), ("first", pa.int64()), ("x", pa.binary())]), "leaf int, feature int, first long, x binary"
        shuffled = self.blocks.mapInArrow(own, names).repartition("leaf", "feature").sortWithinPartitions("leaf", "feature", "first")
        out, loss = np.zeros((len(wanted), 3, self.features, BINS)), np.zeros(2)
        for row in shuffled.mapInArrow(added, names).collect():
            if row.leaf < 0:
                loss = np.frombuffer(row.x)
            else:
                out[row.leaf, :, row.feature] = np.frombuffer(row.x).reshape(3, BINS)
        return out, loss

    def renewed(self, since: list[Tree]) -> Spread:
        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = _block({c: batch[c][i].as_py() for c in batch.schema.names})
                    block.margin = block.margin + sum(t.of(block.bins) for t in since)
                    yield pa.RecordBatch.from_pylist([_row(block)], SCHEMA)

        out = Spread(stored(self.blocks.mapInArrow(moved, KINDS), "blocks"), self.features)
        self.blocks.unpersist()
        return out


# ---- growth ----


@dataclass
class Leaf:
    sums: np.ndarray
    level: int
    best: tuple[float, int, int] = (0.0, -1, 0)
    children: tuple[np.ndarray, np.ndarray] | None = None


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def score(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    """What a leaf of these sums takes off the loss, twice."""
    return shrunk(g, settings.l1) ** 2 / np.maximum(h + settings.l2, 1e-300)


def best_split(sums: np.ndarray, columns: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best allowed split; ties go to the smaller feature and bin. feature -1 if there's none."""
    low = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums.sum(axis=2)[:, :, None]
    high = whole - low
    gain = score(low[0], low[1], settings) + score(high[0], high[1], settings) - score(whole[0], whole[1], settings)
    fits = (low[2] >= settings.least_rows) & (high[2] >= settings.least_rows) & (low[1] >= settings.least_weight) & (high[1] >= settings.least_weight)
    gain = np.where(fits & columns[:, None], gain, -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else (0.0, -1, 0)


def grown(rows: Local | Spread, since: list[Tree], root: np.ndarray, features: int, settings: Settings, number: int) -> Tree:
    """One tree, from the sums of all rows."""
    columns = np.ones(features, bool)
    if settings.columns < 1:
        most = max(1, int(features * settings.columns))
        columns[:] = False
        columns[np.random.default_rng([settings.seed, number]).permutation(features)[:most]] = True
    tree, leafwise = Tree(), settings.growth == "leaf"
    open_ = {0: Leaf(root, 0)}
    open_[0].best = best_split(root, columns, settings)
    least = settings.gain if leafwise else 0.0

    def ready() -> list[int]:
        """Leaves that may be split, the next one first."""
        own = [n for n, x in open_.items() if x.best[1] >= 0 and x.best[0] > least and (not settings.depth or x.level < settings.depth)]
        return sorted(own, key=lambda n: (-open_[n].best[0], n) if leafwise else (open_[n].level, n))

    while (queue := ready()) and len(open_) < settings.leaves:
        node = queue[0]
        if open_[node].children is None:
            most = min(settings.ahead, settings.leaves - len(open_)) if leafwise else len(queue)
            near = [n for n in queue if open_[n].children is None][:most]
            wanted = []
            for n in near:
                _, f, b = open_[n].best
                below = open_[n].sums[2, f, : b + 1].sum()
                wanted.append((n, f, b, bool(below <= open_[n].sums[2, f].sum() - below)))
            sums, _ = rows.sums(since, tree, wanted, settings, number, False)
            for n, (*_, left), own in zip(near, wanted, sums):
                other = open_[n].sums - own
                open_[n].children = (own, other) if left else (other, own)
        leaf = open_.pop(node)
        for n, x in zip(tree.split(node, leaf.best[1], leaf.best[2], leaf.best[0]), leaf.children):
            open_[n] = Leaf(x, leaf.level + 1)
            open_[n].best = best_split(x, columns, settings)
        tree.value[node] = _value(leaf.sums, settings)
    for n, leaf in open_.items():
        tree.value[n] = _value(leaf.sums, settings)
    if not leafwise and settings.gain > 0:
        for n in range(len(tree.feature) - 1, -1, -1):  # children come after their parents
            if tree.feature[n] >= 0 and tree.feature[tree.left[n]] < 0 and tree.feature[tree.right[n]] < 0 and tree.gain[n] < settings.gain:
                tree.feature[n], tree.gain[n] = -1, 0.0
    return tree


def _value(sums: np.ndarray, settings: Settings) -> float:
    g, h, _ = sums[:, 0].sum(axis=1)
    return float(-shrunk(g, settings.l1) / max(h + settings.l2, 1e-300) * settings.rate) if h + settings.l2 > 0 else 0.0


def boosted(rows: Local | Spread, edges: list[list[float]], base: float, settings: Settings, watch: Callable[[int, float], None] | None = None) -> Model:
    """watch is told each round's validation loss, and may raise. Rounds until `stop` of them in a row gave no smaller validation loss; then the trees up to the best round stay."""
    model, since, losses = Model(edges, base, [], settings), [], []
    for number in range(settings.rounds + 1):
        if len(since) == RENEW:
            rows, since = rows.renewed(since), []
        sums, (loss, weight) = rows.sums(since, Tree(), [(0, -1, 0, True)], settings, number, True)
        if weight > 0:
            losses.append(float(loss / weight))
            if watch:
                watch(number, losses[-1])
        best = int(np.argmin(losses)) if losses else 0
        if number == settings.rounds or settings.stop and losses and number - best >= settings.stop:
            break
        tree = grown(rows, since, sums[0], len(edges), settings, number)
        if len(tree.feature) == 1 and settings.rows == 1 and settings.columns == 1:  # nothing can be split any more
            break
        model.trees.append(tree)
        since.append(tree)
    if losses:
        model.trees = model.trees[: int(np.argmin(losses))]
    model.losses = losses
    return model


# ---- tables ----


def edges_of(rows: DataFrame, features: int, bins: int = BINS) -> list[list[float]]:
    """Edges between bins: quantiles of the finite values of each feature, at most bins - 2 different ones; all values but the largest, if they are fewer.
    One aggregate, of features * bins numbers."""
    places = F.array(*[F.lit(i / (bins - 2)) for i in range(1, bins - 2)])
    finite = lambda i: F.when(~F.isnan(x := F.get("features", F.lit(i))) & (F.abs(x) < float("inf")), x)
    row = rows.agg(*[F.struct(F.percentile_approx(finite(i), places, F.lit(20 * bins)).alias("q"), F.max(finite(i)).alias("m")).alias(f"f{i}") for i in range(features)]).first()
    return [sorted({x for x in (own.q or []) if x < own.m}) for own in row]


def base_of(y: float, weight: float) -> float:
    share = min(max(y / weight, 1e-15), 1 - 1e-15) if weight > 0 else 0.5
    return float(np.log(share / (1 - share)))


def matrix(lists: pa.Array | pa.ChunkedArray, features: int) -> np.ndarray:
    """Arrow lists of doubles as rows of numbers, without an object a number; nulls, and rows that are null, aren't numbers."""
    out, at = np.full((len(lists), features), np.nan), 0
    for own in lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]:
        there = own.is_valid().to_numpy(zero_copy_only=False)
        if (own.value_lengths().drop_null().to_numpy() != features).any():
            raise ValueError(f"features of another length than {features}")
        out[at : at + len(own)][there] = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
        at += len(own)
    return out


def matrix_in_order(lists: pa.ChunkedArray, order: np.ndarray, most: int = 8192) -> np.ndarray:
    """matrix() of the rows in an order, made in parts of at most `most` rows, so that nothing of its size is held beside it."""
    features = next((len(x) for x in lists if x.is_valid), 0)
    out, place, at = np.empty((len(lists), features)), np.empty(len(order), np.int64), 0
    place[order] = np.arange(len(order))
    for chunk in lists.chunks:
        for i in range(0, len(chunk), most):
            own = chunk.slice(i, most)
            out[place[at : at + len(own)]] = matrix(own, features)
            at += len(own)
    return out


def blocked(batches: Iterable[pa.RecordBatch], number: int, edges: list[list[float]], base: float, block: int) -> Iterator[Block]:
    """Blocks of at least `block` rows (features, y, weight, held), but for the last, counted from number. Rows wait as bins, a byte a feature; their numbers are there
    for PART rows at a time, and nothing keeps a batch."""
    waiting: list[tuple[np.ndarray, ...]] = []

    def made() -> Block:
        x, y, weight, held = (np.concatenate(own) for own in zip(*waiting))
        waiting.clear()
        return Block(number, x, y, weight, np.full(len(y), base), held)

    for batch in batches:
        x = np.concatenate([binned(matrix(batch["features"].slice(i, PART), len(edges)), edges) for i in range(0, max(1, batch.num_rows), PART)])
        waiting.append((x, batch["y"].to_numpy().copy(), batch["weight"].to_numpy().copy(), batch["held"].to_numpy(zero_copy_only=False)))
        if sum(len(y) for _, y, _, _ in waiting) >= block:
            yield made()
            number += 1
    if waiting:
        yield made()


def fit(train: DataFrame, settings: Settings, val: DataFrame | None = None, weight: str | None = "weight", block: int = BLOCK, watch: Callable[[int, float], None] | None = None) -> Model:
    """Trees on rows (features, y and, if weight is named and there, a weight). val: rows that tell when to stop; watch: of boosted()."""
    spark = train.sparkSession
    own = lambda df, held: df.where("y is not null").select(F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"), (F.col(weight).cast("double") if weight and weight in df.columns else F.lit(1.0)).alias("weight"), F.lit(held).alias("held"))
    fitted = own(train, False)
    head = fitted.agg(F.max(F.size("features")).alias("d"), F.sum(F.col("y") * F.col("weight")).alias("y"), F.sum("weight").alias("w"), F.countDistinct("y").alias("classes")).first()
    if not head.d or head.classes < 2:
        return Model([[]] * (head.d or 0), base_of(head.y or 0.0, head.w or 0.0), [], settings)
    features, base = head.d, base_of(head.y, head.w)
    edges = edges_of(fitted, features)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for own in blocked(batches, TaskContext.get().partitionId() << 32, edges, base, block):
            yield pa.RecordBatch.from_pylist([_row(own)], SCHEMA)

    rows = fitted if val is None else fitted.unionByName(own(val, True))
    spread = Spread(stored(rows.mapInArrow(blocks, KINDS), "blocks"), features)
    try:
        return boosted(spread, edges, base, settings, watch)
    finally:
        spread.blocks.unpersist()


def fit_local(x: np.ndarray, y: np.ndarray, settings: Settings, weight: np.ndarray | None = None, held: np.ndarray | None = None) -> Model:
    """The same for rows that a task holds, as in grouped fits."""
    weight = np.ones(len(y)) if weight is None else weight
    held = np.zeros(len(y), bool) if held is None else held
    fits = ~held
    base = base_of(float((y * weight)[fits].sum()), float(weight[fits].sum()))
    if len(np.unique(y[fits])) < 2:
        return Model([[]] * x.shape[1], base, [], settings)
    edges = []
    for f in range(x.shape[1]):
        own = np.sort(x[fits & np.isfinite(x[:, f]), f])
        at = np.ceil(np.arange(1, BINS - 2) / (BINS - 2) * len(own)).astype(int) - 1
        edges.append(sorted({float(v) for v in own[at]} - {float(own[-1])}) if len(own) else [])
    return boosted(Local([Block(0, binned(x, edges), y.astype(np.float64), weight, np.full(len(y), base), held)]), edges, base, settings)


def with_scores(model: Model, df: DataFrame) -> DataFrame:
    """Adds p (of class 1) and pred. Scored in Arrow batches; a null array of features has the scores of nulls."""
    text, width = model.to_json(), len(model.edges)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model.from_json(text)
        for rows in parts:
            yield pa.array(np.concatenate([sigmoid(own.margins(matrix(rows.slice(i, PART), width))) for i in range(0, max(1, len(rows)), PART)]), pa.float64())

    return df.withColumn("p", score(F.col("features").cast("array<double>"))).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
