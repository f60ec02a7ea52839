"""Training of dense nets by synchronous gradient steps over a distributed table.

In each step every task reads its part of the prepared table, batch by batch, and returns one block: the sum of its
gradients, of its losses and of the batch statistics. Blocks are summed in two rounds of tasks, so the driver gets a few blocks
of the size of the net, never a row. The driver makes one Adam step and broadcasts the new weights. Linear
layers, batch norm and relu, with embeddings of category indices, as :class:`DenseNet` scores them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.operators.clean import LABEL
from visitflow.operators.model import NET_BYTES, SEED, DenseLayer, DenseNet
from visitflow.operators.prep import FeaturePrep
from visitflow.operators.split import time_split
from visitflow.session import materialize, temporary_tables
from visitflow.sources.params import latest_version, load_version, save_version

EPS = 1e-5
MOMENTUM = 0.8  # share of a step's batch statistics in the running ones; a step sees all rows, so it is large
BETAS = (0.9, 0.999)


@dataclass
class NetShape:
    """Inputs and layer widths; where each array of weights lies in one flat vector."""

    numeric: list[str]
    indices: dict[str, int]  # vocabulary sizes
    embedding: int
    hidden: tuple[int, ...]

    def arrays(self) -> list[tuple[str, tuple[int, ...]]]:
        found: list[tuple[str, tuple[int, ...]]] = [(f"e_{c}", (size, self.embedding)) for c, size in self.indices.items()]
        width = len(self.numeric) + self.embedding * len(self.indices)
        for i, outputs in enumerate(self.hidden):
            found += [(f"w{i}", (outputs, width)), (f"b{i}", (outputs,)), (f"g{i}", (outputs,)), (f"s{i}", (outputs,))]
            width = outputs
        return [*found, ("out", (width,)), ("bias", (1,))]

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        parts, at = {}, 0
        for name, shape in self.arrays():
            size = math.prod(shape)
            parts[name] = flat[at : at + size].reshape(shape)
            at += size
        return parts

    def pack(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([parts[name].reshape(-1) for name, _ in self.arrays()])

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights by the number of inputs, scales of one; small embeddings."""
        draw = np.random.Generator(np.random.PCG64(seed))
        parts = {}
        for name, shape in self.arrays():
            limit = 1 / math.sqrt(shape[-1])
            if name[0] == "g":
                parts[name] = np.ones(shape)
            elif name[0] == "s" or name == "bias":
                parts[name] = np.zeros(shape)
            else:
                parts[name] = draw.uniform(-limit, limit, shape)
        return self.pack(parts)

    def no_statistics(self) -> np.ndarray:
        """Running means of 0 and variances of 1, layer by layer."""
        return np.concatenate([np.concatenate([np.zeros(n), np.ones(n)]) for n in self.hidden]) if self.hidden else np.zeros(0)


def gradient(
    shape: NetShape, weights: np.ndarray, numeric: np.ndarray, indices: dict[str, np.ndarray], actual: np.ndarray
) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient of the summed squared errors of a batch, that sum, and the batch's means and variances by layer."""
    parts, n = shape.unpack(weights), len(actual)
    x = np.concatenate([*(parts[f"e_{c}"][indices[c]] for c in shape.indices), numeric], axis=1)
    kept, statistics = [], []
    for i in range(len(shape.hidden)):
        z = x @ parts[f"w{i}"].T + parts[f"b{i}"]
        mean, var = z.mean(axis=0), z.var(axis=0)
        deviation = np.sqrt(var + EPS)
        scaled = (z - mean) / deviation
        y = parts[f"g{i}"] * scaled + parts[f"s{i}"]
        kept.append((x, deviation, scaled, y))
        statistics += [mean, var]
        x = np.maximum(y, 0)
    error = x @ parts["out"] + parts["bias"][0] - actual
    found = {"out": 2 * x.T @ error, "bias": np.array([2 * error.sum()])}
    back = 2 * error[:, None] * parts["out"]
    for i in reversed(range(len(shape.hidden))):
        x, deviation, scaled, y = kept[i]
        back = back * (y > 0)
        found[f"g{i}"], found[f"s{i}"] = (back * scaled).sum(axis=0), back.sum(axis=0)
        back = back * parts[f"g{i}"]
        back = (back - back.mean(axis=0) - scaled * (back * scaled).mean(axis=0)) / deviation
        found[f"w{i}"], found[f"b{i}"] = back.T @ x, back.sum(axis=0)
        back = back @ parts[f"w{i}"]
    at = 0
    for c, size in shape.indices.items():
        found[f"e_{c}"] = np.zeros((size, shape.embedding))
        np.add.at(found[f"e_{c}"], indices[c], back[:, at : at + shape.embedding])
        at += shape.embedding
    return shape.pack(found), float((error**2).sum()), np.concatenate(statistics) * n if statistics else np.zeros(0)


def predict(shape: NetShape, weights: np.ndarray, running: np.ndarray, numeric: np.ndarray, indices: dict[str, np.ndarray]) -> np.ndarray:
    return as_dense_net(shape, weights, running).predict(numeric, indices, np.float64)


def as_dense_net(shape: NetShape, weights: np.ndarray, running: np.ndarray, mean: float = 0.0, scale: float = 1.0) -> DenseNet:
    """The net that scores with running statistics; labels were ``mean`` and ``scale`` off."""
    parts, layers, at = shape.unpack(weights), [], 0
    for i, n in enumerate(shape.hidden):
        layers.append(
            DenseLayer(parts[f"w{i}"], parts[f"b{i}"], parts[f"g{i}"], parts[f"s{i}"], running[at : at + n], running[at + n : at + 2 * n], EPS)
        )
        at += 2 * n
    embeddings = {c: parts[f"e_{c}"] for c in shape.indices}
    return DenseNet(list(shape.numeric), layers, parts["out"] * scale, float(parts["bias"][0] * scale + mean), embeddings)


@dataclass
class NetFit:
    net: DenseNet
    #: Root mean squared error before each step: of the training rows, and of the rows that decide when to stop.
    history: list[tuple[float, float]] = field(default_factory=list)


BLOCK = "part long, gradient binary, statistics binary, losses binary"


def _step_blocks(rows: DataFrame, shape: NetShape, sent, label: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The summed blocks of a step: gradients, statistics, and (loss, rows) of both parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, running = sent.value
        total, statistics, losses = np.zeros(len(weights)), np.zeros(len(running)), np.zeros(4)
        for batch in batches:
            table = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            numeric = np.column_stack([table[f"x_{c}"] for c in shape.numeric]) if shape.numeric else np.zeros((batch.num_rows, 0))
            for stop in (False, True):
                mine = table["stop"] == stop
                n = int(mine.sum())
                if not n:
                    continue
                inputs = numeric[mine], {c: table[f"i_{c}"][mine] for c in shape.indices}
                if stop:
                    errors = predict(shape, weights, running, *inputs) - table[label][mine]
                    losses[2:] += float((errors**2).sum()), n
                    continue
                found, loss, seen = gradient(shape, weights, *inputs, table[label][mine])
                total += found
                statistics += seen
                losses[:2] += loss, n
        block = [pa.array([TaskContext.get().partitionId()]), *(pa.array([a.tobytes()], pa.binary()) for a in (total, statistics, losses))]
        yield pa.RecordBatch.from_arrays(block, ["part", "gradient", "statistics", "losses"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "gradient", "statistics", "losses")), strict=True):
                arrays = [np.frombuffer(b) for b in row[1:]]
                sums, part = ([a + b for a, b in zip(sums, arrays, strict=True)], part) if sums else (arrays, row[0])
        if sums:
            block = [pa.array([part]), *(pa.array([a.tobytes()], pa.binary()) for a in sums)]
            yield pa.RecordBatch.from_arrays(block, ["part", "gradient", "statistics", "losses"])

    blocks = rows.mapInArrow(work, BLOCK)
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    # Sums are made in the order of parts, so a step gives the same bits again.
    met = blocks.repartition(groups, F.col("part") % groups).sortWithinPartitions("part").mapInArrow(add_up, BLOCK)
    found = sorted(met.collect(), key=lambda r: r["part"])
    return [tuple(np.frombuffer(r[c]) for c in ("gradient", "statistics", "losses")) for r in found]


def fit_net(
    train: DataFrame,
    prep: FeaturePrep,
    label: str = LABEL,
    hidden: tuple[int, ...] = (256, 128, 64),
    embedding: int = 8,
    steps: int = 200,
    patience: int = 15,
    learning_rate: float = 0.01,
    weight_decay: float = 1e-4,
    stop_frac: float = 0.1,
    seed: int = SEED,
    checkpoint: str | None = None,
) -> NetFit:
    """Fit a net on rows that ``prep`` has prepared: its numbers as inputs, its indices through embeddings.

    A step is one pass over the table, which is written once. Training stops after ``patience`` steps without a smaller error
    on the last ``stop_frac`` of the training rows, and keeps the weights of the smallest. With ``checkpoint``, a
    folder, every step is stored there, and a fit of the same shape goes on from the last one. Two fits of one table on
    equal settings are equal. Rows without a label are left out.
    """
    spark = train.sparkSession
    shape = NetShape(list(prep.fill), dict(prep.indices), embedding, tuple(hidden))
    weights, running = shape.start(seed), shape.no_statistics()
    if 8 * len(weights) > NET_BYTES:
        raise ValueError(f"a net of {8 * len(weights)} bytes is too large to send to every executor")
    train = train.where(F.col(label).isNotNull())
    with temporary_tables(spark):
        fitted, stop = time_split(train, 1.0 - stop_frac)
        spread = fitted.agg(F.avg(label), F.stddev_pop(label)).first()
        mean, scale = float(spread[0] or 0.0), float(spread[1] or 0.0) or 1.0
        parts = [
            part.select(
                *[F.col(f"`{c}`").cast("double").alias(f"x_{c}") for c in shape.numeric],
                *[F.col(f"`{c}`").cast("bigint").alias(f"i_{c}") for c in shape.indices],
                ((F.col(f"`{label}`").cast("double") - mean) / scale).alias("label"),
                F.lit(is_stop).alias("stop"),
            )
            for part, is_stop in ((fitted, False), (stop, True))
        ]
        rows = materialize(parts[0].unionByName(parts[1]), "net-rows")
        state = _State(weights, running, np.zeros_like(weights), np.zeros_like(weights))
        if checkpoint and latest_version(spark, checkpoint):
            state = _State.from_dict(load_version(spark, checkpoint))
        while state.step < steps and state.idle < patience:
            sent = spark.sparkContext.broadcast((state.weights, state.running))
            blocks = _step_blocks(rows, shape, sent, "label")
            sent.destroy()
            if not state.advance(blocks, learning_rate, weight_decay):
                break
            if checkpoint:
                save_version(spark, state.to_dict(), checkpoint)
    history = [(a * scale, b * scale) for a, b in state.history]
    return NetFit(as_dense_net(shape, state.best[0], state.best[1], mean, scale), history)


class _State:
    """Weights, running statistics and Adam's moments after some steps; the best weights so far."""

    ARRAYS = ("weights", "running", "first", "second")

    def __init__(self, weights: np.ndarray, running: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.weights, self.running, self.first, self.second = weights, running, first, second
        self.step = self.idle = 0
        self.least = math.inf
        self.best = (weights, running)
        self.history: list[tuple[float, float]] = []

    def advance(self, blocks: list, learning_rate: float, weight_decay: float) -> bool:
        """One Adam step from the blocks of all tasks; False if there are no rows to learn from."""
        total, statistics, losses = (sum(b[i] for b in blocks) for i in range(3)) if blocks else (0, 0, np.zeros(4))
        loss, n, stop_loss, n_stop = losses.tolist()
        if not n:
            return False
        error = math.sqrt(loss / n)
        stop_error = math.sqrt(stop_loss / n_stop) if n_stop else error
        self.history.append((error, stop_error))
        # Before the first step no statistics are known: its error says nothing.
        if self.step and stop_error < self.least:
            self.least, self.idle, self.best = stop_error, 0, (self.weights, self.running)
        elif self.step:
            self.idle += 1
        self.step += 1
        found = total / n + weight_decay * self.weights
        self.first = BETAS[0] * self.first + (1 - BETAS[0]) * found
        self.second = BETAS[1] * self.second + (1 - BETAS[1]) * found**2
        first, second = self.first / (1 - BETAS[0] ** self.step), self.second / (1 - BETAS[1] ** self.step)
        self.weights = self.weights - learning_rate * first / (np.sqrt(second) + 1e-8)
        share = MOMENTUM if self.step > 1 else 1.0
        self.running = (1 - share) * self.running + share * statistics / n
        if self.step == 1:
            self.best = (self.weights, self.running)
        return True

    def to_dict(self) -> dict:
        plain = {"step": self.step, "idle": self.idle, "least": None if math.isinf(self.least) else self.least, "history": self.history}
        return {**plain, **{a: getattr(self, a).tolist() for a in self.ARRAYS}, "best": [a.tolist() for a in self.best]}

    @staticmethod
    def from_dict(values: dict) -> _State:
        state = _State(*(np.array(values[a]) for a in _State.ARRAYS))
        state.step, state.idle = values["step"], values["idle"]
        state.least = math.inf if values["least"] is None else values["least"]
        state.best = tuple(np.array(a) for a in values["best"])
        state.history = [tuple(h) for h in values["history"]]
        return state
