"""Text encoders inside tasks: token ids with an attention mask, padded batch by batch, and a pooled vector for each text.

An Encoder says how a worker gets its tokenizer and its model. Both are loaded once a worker process, however many batches
and queries it sees, and texts reach them in Arrow batches. Weights of an encoder are not trained; the network on top is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = "struct<input_ids:array<int>,attention_mask:array<int>>"
#: What this worker process has loaded, by key.
LOADED: dict[tuple[str, str], Any] = {}


@dataclass(frozen=True)
class Encoder:
    """How to encode texts.

    key names the encoder for the worker's memory. tokenizer() gives a function from texts to lists of ids, special tokens
    included; model() gives a function from ids and mask, two integer matrices of a batch, to states (rows, tokens, width),
    or a pair of states and pooled vectors (rows, width). pooling: 'mean' over the mask, 'pooler', or 'auto': pooled vectors
    where the model gives them. Without a tokenizer the model takes the texts themselves and gives vectors.
    """

    key: str
    model: Callable[[], Callable[..., Any]]
    tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None
    max_length: int = 512
    batch_size: int = 32
    pooling: str = "auto"
    pad_id: int = 0
    sep: str = " "


def loaded(encoder: Encoder, part: str) -> Any:
    """The tokenizer or model of this worker, made at its first use."""
    if (encoder.key, part) not in LOADED:
        LOADED[encoder.key, part] = getattr(encoder, part)()
    return LOADED[encoder.key, part]


def padded(lists: list[list[int]], pad_id: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask as matrices as wide as the longest row, or as `width`."""
    width = max(map(len, lists), default=0) if width is None else width
    ids, mask = np.full((len(lists), width), pad_id, dtype=np.int64), np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        ids[i, : len(x)], mask[i, : len(x)] = x, 1
    return ids, mask


def pooled(out: Any, mask: np.ndarray, pooling: str) -> np.ndarray:
    """Vectors from a model's output; a row without tokens has zeros under 'mean'."""
    states, whole = out if isinstance(out, tuple) else (out, None)
    if pooling == "pooler" or (pooling == "auto" and whole is not None):
        if whole is None:
            raise ValueError("the model gives no pooled vectors")
        return np.asarray(whole, dtype=float)
    states = np.asarray(states, dtype=float)
    return (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]


def vectors_of(texts: list[str], encoder: Encoder) -> np.ndarray:
    """The vectors of texts in batches of batch_size, longest first so that a batch pads little."""
    model = loaded(encoder, "model")
    if encoder.tokenizer is None:
        return np.concatenate([np.asarray(model(texts[a : a + encoder.batch_size]), dtype=float) for a in range(0, len(texts), encoder.batch_size)]) if texts else np.zeros((0, 0))
    ids = [x[: encoder.max_length] for x in loaded(encoder, "tokenizer")(texts)]
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    out: list[Any] = [None] * len(ids)
    for a in range(0, len(ids), encoder.batch_size):
        part = order[a : a + encoder.batch_size]
        matrix, mask = padded([ids[i] for i in part], encoder.pad_id)
        for i, v in zip(part, pooled(model(matrix, mask), mask, encoder.pooling), strict=True):
            out[i] = v
    return np.array(out) if out else np.zeros((0, 0))


def text_vectors(text: Column | str, encoder: Encoder) -> Column:
    """The vector of each text as an array of doubles; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(vectors_of([t or "" for t in texts], encoder)), dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


def tokenized(text: Column | str, encoder: Encoder) -> Column:
    """input_ids and attention_mask of each text, cut and padded to max_length."""

    @F.pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = [x[: encoder.max_length] for x in loaded(encoder, "tokenizer")([t or "" for t in texts])]
            matrix, mask = padded(ids, encoder.pad_id, encoder.max_length)
            yield pd.DataFrame({"input_ids": list(matrix.astype(np.int32)), "attention_mask": list(mask.astype(np.int32))})

    return run(F.col(text) if isinstance(text, str) else text)


def with_vectors(df: DataFrame, text: str, encoder: Encoder, name: str = "text_vector") -> DataFrame:
    return df.withColumn(name, text_vectors(text, encoder))
