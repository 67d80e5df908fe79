"""A perceptron trained by all tasks of a barrier stage in mini-batches, with summed gradients, dropout and early stopping.

Rows are dealt to SHARDS logical shards by a hash of their key and ordered in them; a task holds the shards that hash to it, as
arrays, so a task's memory bounds its share of the rows, and more tasks hold more rows. A step takes an even share of the batch from each
shard, in an order of the shard's own for each epoch. Each task sums the gradients of its rows as integers (fixed point), the
sums are added along a tree of tasks, and each makes the same step of AdamW. Sums of integers don't depend on their order, and orders and dropout
follow from (seed, epoch, step, shard), so any number of tasks gives the same weights to the last bit. What travels is a
gradient a task and step, so it doesn't grow with the rows.

A lost executor fails the stage, and Spark starts all its tasks again, which come to the same result.

Cases: components that are null or not finite are 0; rows without y take no part; rows that repeat a key are rows each, those without one are ordered by
their features; without validation rows all epochs are run; an empty table gives the weights to begin with.
"""

from __future__ import annotations

import base64
import json
import socket
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logical shards, and steps of the fixed point that gradients are summed in.
SHARDS, POINT = 64, float(1 << 40)


@dataclass(frozen=True)
class Settings:
    """The settings that the head comes with."""

    layers: int = 2
    width: int = 128
    dropout: float = 0.3
    rate: float = 1e-3
    decay: float = 1e-4
    epochs: int = 40
    batch: int = 256
    patience: int = 5
    clip: float = 1.0
    seed: int = 42


@dataclass
class Model:
    """Weight matrices and biases, in turn; validation accuracy of each epoch."""

    weights: list[np.ndarray]
    settings: Settings
    accuracies: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        z = forward(self.weights, x, None)[-1]
        return 1 / (1 + np.exp(z[:, 0] - z[:, 1]))

    def to_json(self) -> str:
        raw = [[list(w.shape), base64.b64encode(w.astype("<f8").tobytes()).decode()] for w in self.weights]
        return json.dumps({"weights": raw, "settings": asdict(self.settings), "accuracies": self.accuracies})

    @staticmethod
    def from_json(text: str) -> Model:
        x = json.loads(text)
        weights = [np.frombuffer(base64.b64decode(raw), "<f8").reshape(shape) for shape, raw in x["weights"]]
        return Model(weights, Settings(**x["settings"]), x["accuracies"])


def begun(features: int, settings: Settings) -> list[np.ndarray]:
    """Uniform weights within one over the root of a layer's inputs."""
    random, sizes, out = np.random.default_rng(settings.seed), [features, *[settings.width] * settings.layers, 2], []
    for a, b in zip(sizes, sizes[1:]):
        bound = 1 / np.sqrt(max(1, a))
        out += [random.uniform(-bound, bound, (a, b)), random.uniform(-bound, bound, b)]
    return out


def forward(weights: list[np.ndarray], x: np.ndarray, masks: list[np.ndarray] | None) -> list[np.ndarray]:
    """Inputs of each layer, and the last one's output. masks: what dropout leaves of each hidden layer, scaled."""
    held = [x]
    for k in range(0, len(weights) - 2, 2):
        x = np.maximum(x @ weights[k] + weights[k + 1], 0)
        x = x if masks is None else x * masks[k // 2]
        held.append(x)
    return [*held, x @ weights[-2] + weights[-1]]


def gradient(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, masks: list[np.ndarray] | None) -> tuple[list[np.ndarray], float]:
    """Of the summed weighted cross entropy, and that sum."""
    *held, z = forward(weights, x, masks)
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    one = np.eye(2)[y]
    loss = -float((weight * np.log(np.maximum((p * one).sum(axis=1), 1e-300))).sum())
    back, out = (p - one) * weight[:, None], []
    for k in range(len(weights) - 2, -1, -2):
        out = [held[k // 2].T @ back, back.sum(axis=0), *out]
        if k:
            back = (back @ weights[k].T) * (held[k // 2] > 0)
            back = back if masks is None else back * masks[k // 2 - 1]
    return out, loss


class AdamW:
    def __init__(self, weights: list[np.ndarray], settings: Settings):
        self.s, self.t = settings, 0
        self.m, self.v = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        scale = min(1.0, self.s.clip / (norm + 1e-6)) if self.s.clip > 0 else 1.0
        self.t += 1
        out = []
        for i, (w, g) in enumerate(zip(weights, grads)):
            g = g * scale
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            up = (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)
            out.append(w * (1 - self.s.rate * self.s.decay) - self.s.rate * up)
        return out


@dataclass
class Shard:
    """Rows of one logical shard; held ones only serve to stop early."""

    number: int
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    held: np.ndarray


class Alone:
    """The sums of a single task."""

    def __call__(self, own: np.ndarray) -> np.ndarray:
        return own

    def close(self) -> None:
        pass


class Tree:
    """Sums of integers over all tasks of a barrier stage, along a binary tree of sockets: up by partial sums, down by the total.

    The stage's own gathering, which waits a second each time, only tells the tasks' addresses, with a secret that a child must know. A task that
    is lost breaks the connections, so the stage fails as a whole and is run again.
    """

    def __init__(self, context, seconds: float = 900.0):
        rank, infos = context.partitionId(), context.getTaskInfos()
        self.children, self.parent = [], None
        mine = [c for c in (2 * rank + 1, 2 * rank + 2) if c < len(infos)]
        secret, server = uuid.uuid4().hex, socket.create_server(("", 0), backlog=4)
        server.settimeout(seconds)
        about = [json.loads(x) for x in context.allGather(json.dumps([infos[rank].address.rsplit(":", 1)[0], server.getsockname()[1], secret]))]
        if rank:
            host, port, known = about[(rank - 1) // 2]
            self.parent = socket.create_connection((host, port), seconds)
            self.parent.sendall(known.encode())
        while len(self.children) < len(mine):
            child, _ = server.accept()
            child.settimeout(seconds)
            if self._read(child, len(secret)) == secret.encode():
                self.children.append(child)
            else:
                child.close()
        server.close()

    @staticmethod
    def _read(source: socket.socket, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            part = source.recv(min(1 << 20, size - len(out)))
            if not part:
                raise ConnectionError("a task is gone")
            out += part
        return bytes(out)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        total = own.astype("<i8")
        for child in self.children:
            total = total + np.frombuffer(self._read(child, total.nbytes), "<i8")
        if self.parent:
            self.parent.sendall(total.tobytes())
            total = np.frombuffer(self._read(self.parent, total.nbytes), "<i8")
        for child in self.children:
            child.sendall(total.tobytes())
        return total

    def close(self) -> None:
        for x in [*self.children, *([self.parent] if self.parent else [])]:
            x.close()


def trained(shards: list[Shard], features: int, settings: Settings, total: Alone | Tree) -> Model:
    """What each task runs on its shards."""
    weights, fits = begun(features, settings), [s for s in shards if not s.held.all()]
    optimizer, share = AdamW(weights, settings), -(-settings.batch // SHARDS)
    places = {s.number: np.flatnonzero(~s.held) for s in fits}
    sizes = np.zeros(SHARDS, np.int64)
    for s in fits:
        sizes[s.number] = len(places[s.number])
    steps = int(-(-total(sizes).max() // share))
    best, kept, since, accuracies = -1.0, weights, 0, []
    for epoch in range(settings.epochs if steps else 0):
        orders = {s.number: np.random.default_rng([settings.seed, epoch, s.number]).permutation(places[s.number]) for s in fits}
        for step in range(steps):
            sums, whole = [np.zeros(w.shape, np.int64) for w in weights], 0
            for s in fits:
                at = orders[s.number][step * share : (step + 1) * share]
                if not len(at):
                    continue
                masks = None
                if settings.dropout > 0:
                    random = np.random.default_rng([settings.seed, epoch, s.number, step])
                    masks = [(random.random((len(at), settings.width)) >= settings.dropout) / (1 - settings.dropout) for _ in range(settings.layers)]
                grads, _ = gradient(weights, s.x[at], s.y[at], s.weight[at], masks)
                for i, g in enumerate(grads):
                    sums[i] += np.rint(g * POINT).astype(np.int64)
                whole += int(np.rint(s.weight[at].sum() * POINT))
            flat = total(np.concatenate([np.array([whole]), *[x.ravel() for x in sums]]))
            if flat[0] <= 0:
                continue
            cuts = np.cumsum([x.size for x in sums])[:-1]
            weights = optimizer.step(weights, [g.reshape(w.shape) / float(flat[0]) for g, w in zip(np.split(flat[1:], cuts), weights)])
        right = np.zeros(2, np.int64)
        for s in shards:
            if s.held.any():
                z = forward(weights, s.x[s.held], None)[-1]
                right += [int((z.argmax(axis=1) == s.y[s.held]).sum()), int(s.held.sum())]
        right = total(right)
        if not right[1]:
            kept = weights
            continue
        accuracies.append(float(right[0] / right[1]))
        if accuracies[-1] > best:
            best, kept, since = accuracies[-1], weights, 0
        else:
            since += 1
            if since >= settings.patience:
                break
    return Model(kept, settings, accuracies)


def fit(train: DataFrame, settings: Settings, val: DataFrame | None = None, key: str | None = None, tasks: int | None = None, weight: str = "weight") -> Model:
    """A perceptron on rows (features, y and, if there, a weight). key: tells rows apart, so that their order is fixed. tasks: of the barrier stage,
    all of which run at once; as many as there are slots if not given."""
    spark = train.sparkSession
    tasks = tasks or min(SHARDS, spark.sparkContext.defaultParallelism)

    def own(df: DataFrame, held: bool) -> DataFrame:
        order = F.xxhash64(F.col(key) if key else F.col("features"))
        weights = F.col(weight).cast("double") if weight in df.columns else F.lit(1.0)
        return df.where("y is not null").select(F.pmod(order, F.lit(SHARDS)).cast("int").alias("shard"), order.alias("order"), F.col("features").cast("array<double>").alias("features"), F.col("y").cast("int").alias("y"), weights.alias("weight"), F.lit(held).alias("held"))

    rows = own(train, False) if val is None else own(train, False).unionByName(own(val, True))
    features = int(train.agg(F.max(F.size("features"))).first()[0] or 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            x = np.array([[0.0 if v is None else v for v in row] for row in batch["features"].to_pylist()]).reshape(-1, features)
            x[~np.isfinite(x)] = 0
            shard, y, w, held = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "y", "weight", "held"))
            for number in np.unique(shard):
                on = shard == number
                parts.setdefault(int(number), []).append((x[on], y[on], w[on], held[on]))
        shards = [Shard(number, *(np.concatenate(c) for c in zip(*own))) for number, own in sorted(parts.items())]
        total = Tree(context)
        try:
            model = trained(shards, features, settings, total)
        finally:
            total.close()
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"model": [model.to_json()]}, pa.schema([("model", pa.string())]))

    placed = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "order", "features", "y")
    found = placed.mapInArrow(task, "model string", barrier=True).collect()  # a row; a barrier stage allows no limit after it
    return Model.from_json(found[0].model) if found else Model(begun(features, settings), settings, [])


def with_scores(model: Model, df: DataFrame) -> DataFrame:
    """Adds p (of class 1) and pred."""
    text, width = model.to_json(), len(model.weights[0])

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model.from_json(text)
        for rows in parts:
            x = np.array([[0.0 if v is None else v for v in row] if row is not None else [0.0] * width for row in rows], float).reshape(len(rows), width)
            yield pd.Series(own.scores(np.where(np.isfinite(x), x, 0.0)))

    return df.withColumn("p", score(F.col("features").cast("array<double>"))).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
