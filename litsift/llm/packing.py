"""Best-fit packing of token sequences by patterns: non-negative least squares over the length histogram.

1. Documents become pieces of at most `capacity` tokens; only longer ones are cut, and their first piece is the short one.
2. The histogram of piece lengths (at most `capacity` numbers, however many documents there are) goes to the driver.
   All patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the
   histogram by non-negative least squares and rounded; what is left is packed best-fit, again with repeat counts.
3. Pieces of one length are interchangeable, so a piece needs only its number among those of its length, counted in
   salted groups, to find its sequence and its place there.

Edge cases: a null or empty text is one piece that holds just the end id; repeated rows are packed one by one, and so are
rows with a null id, whose pieces have a null id; an empty table gives an empty result; extra columns of the input are
ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.bpe import PATTERN, byte_letters, groups_of, loaded
from litsift.llm.common import cut, n_partitions, utf8

#: Texts from this length on are encoded by the pair occurrence index, which takes runs of white space of any length.
LONG_TEXT = 1_000_000


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file as tiktoken has it: ids are merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of_letter = {c: b for b, c in byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(of_letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = fast_encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [b.decode() for b in batch.column(1).to_pylist()]
            for a, b in groups_of(texts):
                rows: list[tuple] = []
                for key, text in zip(keys[a:b], texts[a:b], strict=True):
                    if len(text) < LONG_TEXT:
                        ids = fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
                    else:
                        ids = loaded(path).encode_batch([text])[0]
                    ids += end_id.to_bytes(4, "little")
                    n, start, k = len(ids) // 4, 0, 0
                    while start < n:
                        stop = start + ((n - start) % capacity or capacity)
                        rows.append((key, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, k = stop, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def full_patterns(capacity: int) -> np.ndarray:
    """All ways to fill a sequence exactly with one to three pieces, as rows of lengths; 0 stands for no piece."""
    rows = [np.array([[capacity, 0, 0]])]
    half = np.arange(1, capacity // 2 + 1)
    rows.append(np.stack([capacity - half, half, np.zeros_like(half)], axis=1))
    for c in range(1, capacity // 3 + 1):
        b = np.arange(c, (capacity - c) // 2 + 1)
        rows.append(np.stack([capacity - b - c, b, np.full_like(b, c)], axis=1))
    return np.concatenate(rows)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - counts|^2, by accelerated projected gradient; A is used as its index lists."""
    size = len(counts)
    real = patterns > 0
    flat = patterns.ravel()

    def use(x: np.ndarray) -> np.ndarray:
        used = np.bincount(flat, weights=np.repeat(x, 3), minlength=size)
        used[0] = 0
        return used

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * real).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue, for the step
        w = back(use(v))
        v = w / np.linalg.norm(w)
    step = 1 / (1.05 * float(v @ back(use(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(use(y) - counts))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, so that every piece of the histogram (index: length) is placed once."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: list[int], most: int) -> int:
        kinds, each = np.unique(lengths, return_counts=True)
        n = int(min(most, (left[kinds] // each).min()))
        if n > 0:
            left[kinds] -= n * each
            out.append((tuple(lengths), n))
        return n

    if left[capacity]:
        take([capacity], int(left[capacity]))
    patterns = full_patterns(capacity)[1:]
    patterns = patterns[((left[patterns] > 0) | (patterns == 0)).all(axis=1)]
    if len(patterns):
        repeats = np.rint(fit_repeats(patterns, left.astype(float))).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 1:
                break
            take([int(x) for x in patterns[i] if x], int(repeats[i]))
    while left.any():  # best fit: the longest piece, then whatever leaves the least room; each round uses up a length
        room, now, held = capacity, [], left.copy()
        while room and (fits := np.nonzero(held[: room + 1])[0]).size:
            length = int(fits[-1])
            now.append(length)
            held[length] -= 1
            room -= length
        take(now, int(left.max()))
    return out


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece, start, length and ids_crc32."""
    spark = parts.sparkSession
    salt = F.pmod(F.hash("doc_id", "piece"), F.lit(n_partitions(spark)))
    parts = cut(parts.withColumn("salt", salt))
    groups = cut(parts.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in plan(counts):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((n, sequence, offset))
            offset += length
        sequence += n
    table = {k: (np.cumsum([0] + [n for n, _, _ in v]), np.array([s for _, s, _ in v]), np.array([o for _, _, o in v])) for k, v in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        sizes, at = length.to_numpy(), number.to_numpy()
        for size in np.unique(sizes):
            rows = np.nonzero(sizes == size)[0]
            starts, first, offset = table[int(size)]
            k = np.searchsorted(starts, at[rows], side="right") - 1
            out[rows, 0] = first[k] + at[rows] - starts[k]
            out[rows, 1] = offset[k]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    begins = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("begin"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = parts.withColumn("own", F.row_number().over(own) - 1).join(begins, ["length", "salt"])
    placed = numbered.withColumn("at", place("length", F.col("begin") + F.col("own")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id"), F.col("at.offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id), capacity)
