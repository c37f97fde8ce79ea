"""A joint network for all labels, trained over a Spark table by mini-batches whose weights and moments carry on.

The input is a text vector, a learnt vector for each category and the numbers; hidden layers with ReLU and dropout follow,
and one output for each label. Rows are dealt into shards by a hash and stand in the order of another hash, so that what a
shard sees does not depend on partitions, executors or retries. In an epoch each shard takes its rows once, in steps of
`batch_size` rows with AdamW, linear warm-up and decay, and clipped gradients; Spark then averages the shards' weights and
moments by rows, chunk by chunk, and the next epoch begins from the mean. With one shard (up to SHARD_ROWS rows) this is
plain sequential training.

Several models train in one scan: a row of fold k is for validation in model k and for training in all others, a row without
fold is for training in all. Rows are packed once into blocks of arrays; in a scan each model of each shard has a task.
Figures of an epoch come with the next scan, from the weights that it starts with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.config import Config, default_config
from litsift.operators.features import RARE, embedding_width

#: Rows that are trained on one after the other in an epoch, about; rows shuffled together; numbers of a chunk.
SHARD_ROWS, BLOCK, CHUNK = 50_000, 4096, 1 << 16
#: Weights whose gradient is worked out and applied at once: what that needs stays in a core's cache.
PIECE = 1 << 14
#: For a scan: a union keeps its parts' partitions apart, a task each, and shuffle files go as soon as the frame is collected.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# AdamW's settings.
BETA1, BETA2, EPSILON, DECAY = 0.9, 0.999, 1e-8, 0.01
FIGURES = ("train_loss", "n_train", "train_hits", "train_labels", "validation_loss", "validation_labels", "validation_hits")


@dataclass(frozen=True)
class Shape:
    """Sizes of a network: the text vector (hashed words, or a vector as it is), categories, numbers, layers and labels."""

    text: int
    hashed: bool
    categories: tuple[int, ...]
    numbers: int
    hidden: int
    layers: int
    labels: int

    @property
    def inputs(self) -> int:
        return self.text + sum(map(embedding_width, self.categories)) + self.numbers

    def sizes(self) -> list[tuple[int, ...]]:
        """Category tables, then weights and biases layer by layer."""
        tables = [(v, embedding_width(v)) for v in self.categories]
        widths = [self.inputs, *[self.hidden] * self.layers, self.labels]
        return [*tables, *(s for a, b in zip(widths, widths[1:], strict=False) for s in ((a, b), (b,)))]

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.sizes()])
        return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), self.sizes(), strict=True)]

    def start(self, seed: int) -> np.ndarray:
        """Categories normal, layers uniform within 1 / sqrt(inputs)."""
        rng, out, inputs = np.random.default_rng(seed), [], 1
        for i, s in enumerate(self.sizes()):
            if i < len(self.categories):
                out.append(rng.normal(size=s))
                continue
            inputs = s[0] if len(s) == 2 else inputs
            out.append(rng.uniform(-1, 1, s) / max(1, inputs) ** 0.5)
        return np.concatenate([x.ravel() for x in out])


@dataclass
class Rows:
    """A block of rows for one model: text as indices and values by row, codes, numbers, labels (NaN: none)."""

    row: np.ndarray
    at: np.ndarray
    value: np.ndarray
    codes: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray

    def __len__(self) -> int:
        return len(self.labels)

    def take(self, which: np.ndarray) -> Rows:
        starts, ends = np.searchsorted(self.row, which), np.searchsorted(self.row, which, side="right")
        n = ends - starts
        inner = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        return Rows(np.repeat(np.arange(len(which)), n), self.at[inner], self.value[inner], self.codes[which], self.numbers[which], self.labels[which])

    def part(self, a: int, b: int) -> Rows:
        """Rows a to b - 1, without copies."""
        low, high = np.searchsorted(self.row, (a, b))
        return Rows(self.row[low:high] - a, self.at[low:high], self.value[low:high], self.codes[a:b], self.numbers[a:b], self.labels[a:b])

    @classmethod
    def joined(cls, a: Rows, b: Rows) -> Rows:
        if not len(a):
            return b
        return cls(np.concatenate([a.row, b.row + len(a)]), *(np.concatenate([x, y]) for x, y in ((a.at, b.at), (a.value, b.value), (a.codes, b.codes), (a.numbers, b.numbers), (a.labels, b.labels))))


def text_values(column: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of each entry of the text vectors; hashed words become counts of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    if not shape.hashed:
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if (at >= shape.text).any():
            raise ValueError("text vectors of different lengths")
        return row, at, np.nan_to_num(flat.astype(float))
    key, count = np.unique(row * shape.text + flat, return_counts=True)
    row, value = key // shape.text, count.astype(float)
    norm = np.sqrt(np.bincount(row, value**2, len(sizes)))
    return row, key % shape.text, value / norm[row]


def rows_of(batch: pa.RecordBatch | pa.Table, shape: Shape, model: int, text: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Rows:
    """The rows as one model takes them; text: text_values(), where another model has asked for them."""
    n = batch.num_rows
    table = lambda c, width: np.array([x[model][:width] for x in batch.column(c).to_pylist()], dtype=float).reshape(n, width)
    codes = table("codes", len(shape.categories)).astype(np.int64)
    codes = np.where(codes < np.array(shape.categories, dtype=np.int64), codes, RARE)
    labels = np.array([[np.nan if v is None else v for v in x] for x in batch.column("labels").to_pylist()], dtype=float).reshape(n, shape.labels)
    return Rows(*(text or text_values(batch.column("text"), shape)), codes, np.nan_to_num(table("numbers", shape.numbers)), labels)


def forward(shape: Shape, parts: list[np.ndarray], rows: Rows, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray | None]]]:
    """Logits, and for each layer its input and what dropout keeps of it."""
    k, at = len(shape.categories), shape.text
    x, kept = np.zeros((len(rows), shape.inputs)), []
    for i, e in enumerate(parts[:k]):
        x[:, at : at + e.shape[1]] = e[rows.codes[:, i]]
        at += e.shape[1]
    x[:, at:] = rows.numbers
    for i in range(k, len(parts), 2):
        keep = rng.random(x.shape) >= drop if rng is not None and drop else None
        first = shape.text if i == k else 0  # few of the text's places are not 0
        if keep is not None:
            x[:, first:] *= keep[:, first:]
            x[:, first:] *= 1 / (1 - drop)
        if first:
            x[rows.row, rows.at] = rows.value if keep is None else rows.value * keep[rows.row, rows.at] * (1 / (1 - drop))
        kept.append((x, keep))
        x = x @ parts[i] + parts[i + 1]
        if i + 2 < len(parts):
            np.maximum(x, 0, out=x)
    return x, kept


def losses(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross entropy of each label with positives weighted, and its slope; 0 where a label is missing."""
    known = ~np.isnan(y)
    y = np.where(known, y, 0.0)
    w = 1 + (weight - 1) * y
    small = np.exp(-np.abs(z))
    loss = (1 - y) * z + w * (np.maximum(-z, 0) + np.log1p(small))
    return loss * known, ((1 - y) - w * np.where(z >= 0, small, 1.0) / (1 + small)) * known


def slopes(shape: Shape, parts: list[np.ndarray], rows: Rows, weight: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, list[np.ndarray | tuple[np.ndarray, np.ndarray]]]:
    """The mean loss over known labels, and by part its gradient, of a layer's weights as factors (x, d) of x.T @ d."""
    found, k = [np.empty(0)] * len(parts), len(shape.categories)
    z, kept = forward(shape, parts, rows, drop, rng)
    loss, d = losses(z, rows.labels, weight)
    n = max(1, int((~np.isnan(rows.labels)).sum()))
    d = d / n
    for i in range(len(parts) - 2, k - 1, -2):
        x, keep = kept[(i - k) // 2]
        found[i], found[i + 1] = (x, d), d.sum(axis=0)
        own = slice(None) if i > k else slice(shape.text, shape.inputs - shape.numbers)  # of the inputs only the categories are learnt
        d = d @ parts[i][own].T
        if keep is not None:
            d = d * keep[:, own] * (1 / (1 - drop))
        if i > k:
            d = d * (x > 0)
    at = 0
    for i, e in enumerate(parts[:k]):
        found[i] = np.zeros_like(e)
        np.add.at(found[i], rows.codes[:, i], d[:, at : at + e.shape[1]])
        at += e.shape[1]
    return float(loss.sum() / n), found


def gradient(shape: Shape, flat: np.ndarray, rows: Rows, weight: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
    """The mean loss over known labels, and its gradient as one vector."""
    loss, found = slopes(shape, shape.views(flat), rows, weight, drop, rng)
    return loss, np.concatenate([(g[0].T @ g[1] if isinstance(g, tuple) else g).ravel() for g in found])


def squares(g: np.ndarray | tuple[np.ndarray, np.ndarray]) -> float:
    """The sum of squares of a part's gradient; of factors with few rows from their products of rows."""
    if isinstance(g, tuple):
        x, d = g
        if len(x) <= d.shape[1]:
            return max(0.0, float(((x @ x.T) * (d @ d.T)).sum()))
        g = x.T @ d
    return float((g * g).sum())


def adamw(parts: list[np.ndarray], first: list[np.ndarray], second: list[np.ndarray], slope: list[np.ndarray | tuple[np.ndarray, np.ndarray]], t: int, rate: float, clip: float) -> None:
    """Step t, from 1, in place; the gradient is shortened to `clip`. Moments are sums of x = (1 - BETA1) * gradient and of x * x."""
    norm = sum(map(squares, slope)) ** 0.5
    short = (1 - BETA1) * (clip / (norm + 1e-6) if clip and norm > clip else 1.0)
    spread = ((1 - BETA2) / (1 - BETA2**t)) ** 0.5 / (1 - BETA1)
    spare = np.empty(max(PIECE, *(p.shape[-1] for p in parts)))
    for part, m, v, g in zip(parts, first, second, slope, strict=True):
        each = max(1, PIECE // (part.size // max(1, len(part)) or 1))
        inputs, d = (g[0].T, g[1] * short) if isinstance(g, tuple) else (g, None)
        for a in range(0, len(part), each):
            w, f, s = part[a : a + each], m[a : a + each], v[a : a + each]
            x = spare[: w.size].reshape(w.shape)
            np.multiply(inputs[a : a + each], short, out=x) if d is None else np.matmul(inputs[a : a + each], d, out=x)
            f *= BETA1
            f += x
            x *= x
            s *= BETA2
            s += x
            np.sqrt(s, out=x)
            x += EPSILON / spread
            np.divide(f, x, out=x)
            x *= rate / (1 - BETA1**t) / spread
            w *= 1 - rate * DECAY
            w -= x


@dataclass
class State:
    """Weights and AdamW's moments, as adamw() has them, as one vector each."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def start(cls, flat: np.ndarray) -> State:
        return cls(flat, np.zeros_like(flat), np.zeros_like(flat))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.flat, self.first, self.second])

    @classmethod
    def of(cls, vector: np.ndarray) -> State:
        """Views of the vector."""
        return cls(*np.split(vector, 3))


def rate_at(config: Config, step: int, total: int) -> float:
    """The learning rate of a step, from 0: linear warm-up, then linear decay to 0."""
    if step < config.warmup_steps:
        return config.learning_rate * step / max(1, config.warmup_steps)
    return config.learning_rate * max(0.0, (total - step) / max(1, total - config.warmup_steps))


def epoch_of_shard(parts: Iterator[tuple[np.ndarray, Rows]], shard: int, epoch: int, model: int, shape: Shape, state: State, weight: np.ndarray, size: int, config: Config, learn: bool, all_figures: bool) -> np.ndarray:
    """Takes a model's state through a shard's blocks of folds and rows; its figures, in the order of FIGURES.

    Every block is scored with the weights at the start, without all_figures only its rows for validation; then it is
    trained on. size: training rows of the shard.
    """
    before, figures = shape.views(state.flat.copy()), np.zeros(len(FIGURES))
    now, first, second = (shape.views(x) for x in (state.flat, state.first, state.second))
    per_epoch = -(-size // config.batch_size)
    done = per_epoch * (epoch - 1)
    rng = np.random.default_rng((config.random_seed, epoch, shard))
    waiting: Rows | None = None

    def trained(rows: Rows) -> None:
        nonlocal done
        loss, slope = slopes(shape, now, rows, weight, config.dropout_rate, rng)
        adamw(now, first, second, slope, done + 1, rate_at(config, done, per_epoch * config.epochs), config.gradient_clip_norm)
        done += 1
        figures[0] += loss * len(rows)

    for fold, rows in parts:
        own = fold == model
        scored, held = (rows, own) if all_figures else (rows.take(np.flatnonzero(own)), own[own])
        for a in range(0, len(scored), config.eval_batch_size):
            part, h = scored.part(a, min(a + config.eval_batch_size, len(scored))), held[a : a + config.eval_batch_size]
            z = forward(shape, before, part)[0]
            known = ~np.isnan(part.labels)
            loss, hits = losses(z, part.labels, weight)[0], ((z > 0) == (part.labels == 1)) & known
            figures[2:] += hits[~h].sum(), known[~h].sum(), loss[h].sum(), known[h].sum(), hits[h].sum()
        figures[1] += (~own).sum()
        if learn:
            mixed = rows.take(rng.permutation(np.flatnonzero(~own)))
            queue = mixed if waiting is None else Rows.joined(waiting, mixed)
            whole = len(queue) // config.batch_size * config.batch_size
            for a in range(0, whole, config.batch_size):
                trained(queue.part(a, a + config.batch_size))
            waiting = queue.part(whole, len(queue))
    if waiting is not None and len(waiting):
        trained(waiting)
    return figures


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again in tables of BLOCK rows, whatever the batches were."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        while n >= BLOCK:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, BLOCK)
            held, n = whole.slice(BLOCK).to_batches(), n - BLOCK
    if n:
        yield pa.Table.from_batches(held)


def packed(placed: DataFrame, shapes: list[Shape]) -> DataFrame:
    """A row a block: shard; fold and labels of its rows; by kind of text the entries of each row, their places and values; by model the codes and numbers. In the order of the rows."""
    kinds = text_kinds(shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            n, texts, models = table.num_rows, [], []
            for shape in kinds.values():
                row, at, value = text_values(table.column("text"), shape)
                texts.append((np.bincount(row, minlength=n).astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), value.astype(float).tobytes()))
            for k, shape in enumerate(shapes):
                rows = rows_of(table, shape, k, (np.empty(0, int),) * 3)
                models.append((rows.codes.tobytes(), rows.numbers.tobytes()))
            whole = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(c).combine_chunks()) for c in ("fold", "labels")]
            binaries = [pa.array([list(x)], pa.list_(pa.binary())) for pairs in (texts, models) for x in zip(*pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([table.column("shard")[0].as_py()], pa.int32()), *whole, *binaries], ["shard", "fold", "labels", "sizes", "at", "value", "codes", "numbers"])

    return placed.select("shard", F.col("fold").cast("int").alias("fold"), "text", "codes", "numbers", F.col("labels").cast("array<float>").alias("labels")).mapInArrow(run, "shard int, fold array<int>, labels array<array<float>>, sizes array<binary>, at array<binary>, value array<binary>, codes array<binary>, numbers array<binary>")


def text_kinds(shapes: list[Shape]) -> dict[tuple[int, bool], Shape]:
    """The ways in which models take texts, each with a shape that has it; most often one."""
    return {(s.text, s.hashed): s for s in shapes}


def unpacked(batches: Iterator[pa.RecordBatch], shapes: list[Shape]) -> Iterator[tuple[int, int, np.ndarray, Rows]]:
    """Model, shard, folds and rows of each block, for the model whose columns these are."""
    for b in batches:
        for i in range(b.num_rows):
            k, shard = b.column("model")[i].as_py(), b.column("shard")[i].as_py()
            sizes, at, value, codes, numbers = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("sizes", np.int32), ("at", np.int32), ("value", float), ("codes", np.int64), ("numbers", float)))
            n, shape = len(sizes), shapes[k]
            labels = b.column("labels")[i].values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, shape.labels)
            yield k, shard, b.column("fold")[i].values.to_numpy(), Rows(np.repeat(np.arange(n), sizes), at, value, codes.reshape(n, len(shape.categories)), numbers.reshape(n, shape.numbers), labels)


def mean_of_shards(rows: DataFrame) -> DataFrame:
    """(model, part, n, x): the mean of x over shards by n; part -1 holds figures, which are added up. In the order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for k, part, n, x in zip(*(b.column(c).to_pylist() for c in ("model", "part", "n", "x")), strict=True):
                sums = held.setdefault((k, part), [0, 0.0])
                sums[0] += n
                sums[1] = sums[1] + np.frombuffer(x) * (n if part >= 0 else 1)
        out = [(k, part, n, (x / max(1, n) if part >= 0 else x).tobytes()) for (k, part), (n, x) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["model", "part", "n", "x"])

    return rows.repartition("model", "part").sortWithinPartitions("model", "part", "shard").select("model", "part", "n", "x").mapInArrow(run, "model int, part int, n long, x binary")


def dealt(rows: DataFrame, key: Column, seed: int) -> tuple[DataFrame, int]:
    """Rows with `shard`, a shard a partition in the order of a hash of the key; and the number of shards."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    placed = rows.withColumns({"order": F.xxhash64(key, F.lit(seed)), "shard": F.pmod(F.xxhash64(key, F.lit(seed), F.lit("shard")), F.lit(shards)).cast("int")})
    return placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("order", "fold", "labels"), shards


@dataclass
class Fitted:
    """The best state of a model, and a row an epoch: epoch, train_loss, validation_loss, train_accuracy, validation_accuracy."""

    shape: Shape
    flat: np.ndarray
    history: list[tuple] = field(default_factory=list)
    best: int = 0


def train_all(rows: DataFrame, key: Column, shapes: list[Shape], config: Config = default_config, all_figures: bool = True) -> list[Fitted]:
    """Trains all models in one scan an epoch and one more.

    rows: fold (int, -1: none), text (hashed words, or a vector), codes and numbers (an array for each model) and labels. A
    model stops after `early_stopping_patience` epochs without a smaller validation loss and keeps its best epoch; without
    validation rows it runs all epochs and keeps the last. Without all_figures the history has no train_accuracy. To the
    driver come, an epoch, the mean weights and moments of each model.
    """
    ordered = dealt(rows.select("fold", "text", "codes", "numbers", "labels", key.alias("key")), F.col("key"), config.random_seed)[0].drop("key")
    placed = packed(ordered, shapes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        each = placed.select("shard", F.explode(F.arrays_zip("fold", "labels")).alias("r")).select("shard", "r.fold", "r.labels")
        n_of: dict[tuple[int, int], int] = {(r["shard"], r["fold"]): r["n"] for r in each.groupBy("shard", "fold").agg(F.count("*").alias("n")).collect()}  # shards times folds
        every = range(len(shapes))
        sizes = {s: {k: sum(n for (t, f), n in n_of.items() if t == s and f != k) for k in every} for s, _ in n_of}
        weights = positive_weights(each, len(shapes), shapes[0].labels, config)
        states = {k: State.start(shapes[k].start(config.random_seed)) for k in every}
        fitted = [Fitted(shapes[k], states[k].flat) for k in every]
        active, loss, seen = list(every), {}, {}
        for epoch in range(1, config.epochs + 2):
            learn = epoch <= config.epochs
            found = scanned(placed, {k: states[k] for k in active}, epoch, shapes, weights, sizes, config, learn, all_figures)
            for k in list(active):
                own_loss, n, hits, labels, v_loss, v_labels, v_hits = found[k][0].tolist()
                if epoch > 1:
                    checked = v_loss / v_labels if v_labels else None
                    row = (epoch - 1, loss[k] / max(1, seen[k]), checked, 100 * hits / labels if labels else None, 100 * v_hits / v_labels if v_labels else None)
                    f = fitted[k]
                    f.history.append(row)
                    if checked is None or f.best == 0 or checked < f.history[f.best - 1][2]:
                        f.best, f.flat = epoch - 1, states[k].flat.copy()
                    elif epoch - 1 - f.best >= config.early_stopping_patience:
                        active.remove(k)
                        continue
                loss[k], seen[k] = own_loss, n
                if learn:
                    states[k] = State.of(found[k][1])
            if not active:
                break
        return fitted
    finally:
        placed.unpersist()


def scanned(placed: DataFrame, states: dict[int, State], epoch: int, shapes: list[Shape], weights: dict[int, np.ndarray], sizes: dict[int, dict[int, int]], config: Config, learn: bool, all_figures: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By model the summed figures, and weights with moments after the epoch."""
    spark, kinds = placed.sparkSession, list(text_kinds(shapes))
    sent = {k: spark.sparkContext.broadcast(s) for k, s in states.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, shard), parts in groupby(unpacked(batches, shapes), key=lambda x: x[:2]):
            state, n = State.of(sent[k].value.vector()), sizes[shard][k]
            figures = epoch_of_shard((x[2:] for x in parts), shard, epoch, k, shapes[k], state, weights[k], n, config, learn, all_figures)
            vector = state.vector() if learn else np.empty(0)
            pieces = [figures, *(vector[a : a + CHUNK] for a in range(0, len(vector), CHUNK))]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces), pa.int32()), pa.array(range(-1, len(pieces) - 1), pa.int32()), pa.array([shard] * len(pieces), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["model", "part", "shard", "n", "x"])

    def of(k: int) -> DataFrame:
        kind = kinds.index((shapes[k].text, shapes[k].hashed))
        return placed.select(F.lit(k).alias("model"), "shard", "fold", "labels", *(F.col(c)[kind].alias(c) for c in ("sizes", "at", "value")), *(F.col(c)[k].alias(c) for c in ("codes", "numbers")))

    before = {c: spark.conf.get(c) for c in SETTINGS}
    for c, v in SETTINGS.items():
        spark.conf.set(c, v)
    try:
        each = reduce(DataFrame.union, map(of, states)).mapInArrow(run, "model int, part int, shard int, n long, x binary")
        found = (mean_of_shards(each) if len(sizes) > 1 else each).select("model", "part", "x").toArrow()  # the weights of each model, in chunks
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    for b in sent.values():
        b.destroy()
    parts: dict[int, list] = {}
    for k, part, x in sorted(zip(found["model"].to_pylist(), found["part"].to_pylist(), found["x"], strict=True), key=lambda r: r[:2]):
        parts.setdefault(k, []).append(np.frombuffer(x.as_buffer()))
    zero = np.zeros(len(FIGURES))
    return {k: (parts[k][0], np.concatenate(parts[k][1:]) if learn else np.empty(0)) if k in parts else (zero, s.vector()) for k, s in states.items()}


def positive_weights(rows: DataFrame, models: int, labels: int, config: Config) -> dict[int, np.ndarray]:
    """The weight of positives of each model and label: 'auto' is negatives / positives of its training rows."""
    if config.pos_weight != "auto":
        return {k: np.full(labels, float(config.pos_weight or 1.0)) for k in range(models)}
    sums = [f(F.col("labels")[i]).alias(f"{n}{i}") for i in range(labels) for n, f in (("n", F.count), ("p", lambda y: F.sum((y == 1).cast("long"))))]
    found = rows.groupBy("fold").agg(*sums).collect()  # a row a fold
    out = {}
    for k in range(models):
        n, p = (np.array([sum(r[f"{c}{i}"] or 0 for r in found if r["fold"] != k) for i in range(labels)], dtype=float) for c in ("n", "p"))
        out[k] = (n - p) / np.maximum(p, 1)
    return out


def hashed_words(text: str, size: int) -> Column:
    """A place of 0 to size - 1 for each word of a text in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def logits(fitted: list[Fitted], model: Column, text: Column, codes: Column, numbers: Column) -> Column:
    """The outputs of the network that `model` names, as an array of doubles; Arrow batches. codes and numbers hold an array for each model."""

    @F.pandas_udf("array<double>")
    def run(which: pd.Series, t: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(which), dtype=object)
        for k, f in enumerate(fitted):
            at = np.flatnonzero(which.to_numpy() == k)
            if len(at):
                kind = pa.int32() if f.shape.hashed else pa.float64()
                batch = pa.RecordBatch.from_pydict({"text": pa.array([t[i] for i in at], pa.list_(kind)), "codes": [[list(x) for x in c[i]] for i in at], "numbers": [[list(x) for x in n[i]] for i in at], "labels": [[None] * f.shape.labels] * len(at)})
                rows, parts = rows_of(batch, f.shape, k), f.shape.views(f.flat)
                for a in range(0, len(at), 512):
                    z = forward(f.shape, parts, rows.part(a, min(a + 512, len(at))))[0]
                    out[at[a : a + 512]] = list(z)
        return out

    return run(model, text, codes, numbers)
