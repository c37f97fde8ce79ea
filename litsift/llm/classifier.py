"""A quality classifier from positive and unlabelled documents.

Documents become a few dozen style figures, each cut into bins at quantiles of the trusted positives' figures, and a linear
score over the bins minimises the non-negative unbiased risk with the squared loss l(z) = (1 - z)^2 / 4:

    prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)])

E+ is over trusted positives (label 1), Eu over all documents that may be learnt from, labelled or not. With this loss the
risk depends on the data only by first and second moments of the bins, which tasks count over every document and Spark adds
up by matrix row, so no document is left out and a matrix of fixed size goes to the driver. There the minimiser is found
exactly: in closed form, and by bisection of a multiplier where the part in max() would fall below zero. The score is
(1 + f) / 2, which is the chance of label 1 at the minimum.

The class prior needs no label 0: no set of documents can hold a larger share of the positives than prior^-1 times its
share of all, so the prior is estimated as the least ratio of both shares over the sets "score above t". Scores for that
come from a fit on the other half of the positives.

The fit uses at most `max_rows` positives, those of the smallest hash, and all unlabelled documents; every document is
scored over its whole text.

Edge cases: a null or empty text has a score like any other; without usable labels every score is 0.5; null labels and null
ids are not learnt from; of repeated labels of one id one counts for each row of the document, repeated rows are scored one
by one and count one by one as unlabelled; equal figures share bins and so scores; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import cut, utf8

BINS = 16
WINDOW = 512
MARKS = [np.frombuffer(x, dtype=np.uint8) for x in (b"#*$%&", b"|", b"!", b"?", b".", b",", b"<>{}[]=/\\", b"\n", b"@:;", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)))]


def figures(text: bytes, zstd: zstandard.ZstdCompressor) -> list[float]:
    """Style figures of a text; ratios, so that long and short texts compare."""
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    marks = [int(counts[m].sum()) for m in MARKS]
    letters = max(1, marks[-1] + marks[-2])
    share = counts[counts > 0] / size
    kinds = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    spots = np.zeros(256, dtype=bool)
    spots[MARKS[0]] = spots[MARKS[1]] = spots[MARKS[2]] = True
    upper = np.zeros(256, dtype=bool)
    upper[MARKS[-2]] = True
    parts = [raw[: len(raw) // WINDOW * WINDOW].reshape(-1, WINDOW), raw[-WINDOW:].reshape(1, -1)]  # the last one ends with the text
    worst = [max((float(mark[x].mean(axis=1).max()) for x in parts if x.size), default=0.0) for mark in (spots, upper)]
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, *(m / n for m in marks[:9]), marks[9] / size, marks[10] / letters,
        -float((share * np.log2(share)).sum()), len(kinds) / n**0.8, max(kinds.values(), default=0) / n, pairs / n, 1 - len(set(lines)) / max(1, len(lines)),
        len(zstd.compress(text)) / size, int(counts[128:].sum()) / size, max(map(len, kinds), default=0), *worst,
    ]


#: Bins of the scores for the prior, over -1 to 3, and the least share of positives in a set that counts for it.
SCORE_BINS, LEAST_SHARE = 400, 0.3
N_FIGURES = 24
#: Weight of the squared weights, for one positive; it falls with their number.
RIDGE = 10.0
#: Quantiles of the positives at which figures are cut; close at the ends, where other documents stand out.
QUANTILES = np.array([0, 0.003, 0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8, 0.92, 0.97, 0.99, 0.997, 1])


@dataclass
class Model:
    """Bin edges a figure, weights a bin, and the intercept; a few hundred numbers."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(self.edges, x)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), (1 + self.bias) / 2)
        return np.clip((1 + self.weights[self.bins(x)].sum(axis=1) + self.bias) / 2, 0, 1)


def bin_edges(positive: np.ndarray) -> np.ndarray:
    """For each figure the quantiles of the positives, the lowest just below the least of them."""
    edges = np.quantile(positive, QUANTILES, axis=0)
    edges[-1] = np.nextafter(edges[-1], np.inf)
    return np.ascontiguousarray(edges.T)


def binned(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row the weights that its figures select."""
    return np.stack([np.searchsorted(e, x[:, i], side="right") + i * BINS for i, e in enumerate(edges)], axis=1)


def one_hot(bins: np.ndarray, size: int) -> np.ndarray:
    """The rows' bins as 0 and 1, with a 1 for the intercept."""
    out = np.zeros((len(bins), size), dtype=np.float32)
    out[np.arange(len(bins))[:, None], bins] = 1
    out[:, -1] = 1
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, n: int) -> np.ndarray:
    """The minimiser (weights, then intercept) from both matrices of second moments, of n positives and of all rows; their last row holds the first ones.

    With multiplier t of the part in max(), the risk is quadratic. It is least at t = 1 if that part is not negative there,
    else at the t between 0 and 1 where it is zero.
    """
    mean_p, mean_u = positive[-1], unlabelled[-1]
    ridge = RIDGE / n * np.eye(len(mean_p))
    ridge[-1, -1] = 1e-9

    def at(t: float) -> np.ndarray:
        return np.linalg.solve((prior * (1 - t) * positive + t * unlabelled) / 2 + ridge, prior * (1 + t) * mean_p / 2 - t * mean_u / 2)

    def negative(theta: np.ndarray) -> float:
        of = lambda m, mean: (1 + 2 * theta @ mean + theta @ m @ theta) / 4
        return of(unlabelled, mean_u) - prior * of(positive, mean_p)

    if negative(at(1.0)) >= 0:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if negative(at(middle)) < 0 else (middle, high)
    return at(high)


def held_out(key: Column | str) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def added_up(rows: DataFrame) -> np.ndarray:
    """The sum by place of vectors (i, x: doubles as bytes) from all tasks, as the rows of a matrix; added up by i in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("i").to_pylist(), b.column("x").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["i", "x"])

    summed = rows.repartition("i").mapInArrow(run, "i int, x binary").orderBy("i").collect()  # a row for each bin
    return np.stack([np.frombuffer(r["x"]) for r in summed]) if summed else np.empty((0, 0))


def bins_of(docs: DataFrame, edges: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns and bins (bytes, one for each figure) of every row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        offset = np.arange(N_FIGURES) * BINS
        for batch in batches:
            x = np.array([figures(b.as_py(), zstd) for b in batch.columns[-1]]).reshape(batch.num_rows, N_FIGURES)
            at = (binned(edges, x) - offset).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in at], pa.binary())], [*keep, "bins"])

    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, utf8("text").alias("text")).mapInArrow(run, f"{schema}bins binary")


def unpacked(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return flat.reshape(-1, N_FIGURES).astype(np.int64) + np.arange(N_FIGURES) * BINS


def moments(rows: DataFrame) -> np.ndarray:
    """Sums of products of all pairs of bins and of the intercept, over all rows that have bins."""
    size = N_FIGURES * BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                x = one_hot(unpacked(b.column("bins").slice(a, 4096)), size)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "x"])

    return added_up(rows.select("bins").mapInArrow(run, "i int, x binary"))


def score_counts(theta: np.ndarray, bins: np.ndarray) -> np.ndarray:
    f = theta[bins].sum(axis=1) + theta[-1]
    return np.bincount(np.clip(((f + 1) * SCORE_BINS / 4).astype(int), 0, SCORE_BINS - 1), minlength=SCORE_BINS).astype(float)


def estimated_prior(rows: DataFrame, positive: np.ndarray, unlabelled: np.ndarray, size: int) -> float:
    """The least ratio of the shares of all rows and of positives above a score; positives are scored by the fit on their other half."""
    halves = [positive[0::2], positive[1::2]]
    if not len(halves[1]):
        return 0.5
    thetas = [fit(second_moments(h, size), unlabelled, 0.5, len(h)) for h in halves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SCORE_BINS))
        for b in batches:
            bins = unpacked(b.column("bins"))
            total += [score_counts(t, bins) for t in thetas]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["i", "x"])

    every = added_up(rows.select("bins").mapInArrow(run, "i int, x binary"))
    held = [score_counts(thetas[0], halves[1]), score_counts(thetas[1], halves[0])]
    ratios = []
    for u, p in zip(every, held, strict=True):
        above_u, above_p = u[::-1].cumsum() / u.sum(), p[::-1].cumsum() / p.sum()
        enough = above_p >= LEAST_SHARE
        ratios.append(float((above_u[enough] / above_p[enough]).min()))
    return min(0.99, max(0.01, sum(ratios) / 2))


def second_moments(bins: np.ndarray, size: int) -> np.ndarray:
    x = one_hot(bins, size).astype(float)
    return x.T @ x / len(x)


def unfitted() -> Model:
    return Model(np.empty((0, len(QUANTILES))), np.empty(0), 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> tuple[Model, DataFrame | None]:
    """The model, and the bins of all rows (doc_id, bins) where there are any."""
    usable = labels.where(F.col("doc_id").isNotNull() & (F.col(label) == 1) & ~held_out("doc_id")).select("doc_id").distinct()
    picked = F.broadcast(usable.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_rows))  # at most max_rows ids
    found = with_figures(docs.select("doc_id", "text").join(picked, "doc_id"), ["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_rows).toPandas()
    if found.empty:
        return unfitted(), None
    x = np.array(found["x"].tolist())
    edges, size = bin_edges(x), N_FIGURES * BINS + 1
    rows = cut(bins_of(docs, edges, ["doc_id"]))
    learnt = rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    total = moments(learnt)
    unlabelled = total / total[-1, -1]
    positive = binned(edges, x)
    prior = estimated_prior(learnt, positive, unlabelled, size)
    theta = fit(second_moments(positive, size), unlabelled, prior, len(x))
    return Model(edges, theta[:-1], float(theta[-1])), rows


def with_figures(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([figures(b.as_py(), zstd) for b in batch.columns[-1]], pa.list_(pa.float64()))], [*keep, "x"])

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, utf8("text").alias("text")).mapInArrow(run, f"{schema}, x array<double>")


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and score (0 to 1) of every row, over its whole text. No shuffle."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            x = np.array([figures(b.as_py(), zstd) for b in batch.columns[-1]]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, utf8("text").alias("__text")).mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row doc_id, held_out, score and predicted."""
    model, rows = train(docs, labels)
    if rows is None:
        out = docs.select("doc_id", F.lit(0.5).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = model.weights[unpacked(b.column("bins"))].sum(axis=1) + model.bias
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip((1 + f) / 2, 0, 1), pa.float64())], ["doc_id", "score"])

        out = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = score(plain, train(docs, labels)[0], names).where("score >= 0.5")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
