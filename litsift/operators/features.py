"""Leak-free features: category vocabularies and numeric transforms, fitted on one table and applied to any."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.functions.scalars import probit
from litsift.operators.encoders import Encoder, tokenized, with_vectors
from litsift.operators.order import column_figures, range_rank

UNKNOWN, RARE = 0, 1
TRANSFORMS = ("min", "max", "mean", "quantile", "log1p", "robust")
QUANTILES = 1000
#: Values of a vocabulary that stands in an expression, that is broadcast, and that is held by the driver at all.
LITERAL, HELD = 1_000, 100_000


@dataclass(frozen=True)
class ColumnSpec:
    """The roles of a table's columns; one label or several."""

    text_cols: tuple[str, ...] = ()
    categorical_cols: tuple[str, ...] = ()
    numeric_cols: tuple[str, ...] = ()
    label_col: str | tuple[str, ...] | None = None

    def labels(self) -> list[str]:
        return [] if self.label_col is None else [self.label_col] if isinstance(self.label_col, str) else list(self.label_col)

    def check(self, df: DataFrame) -> None:
        if missing := [c for c in (*self.text_cols, *self.categorical_cols, *self.numeric_cols) if c not in df.columns]:
            raise ValueError(f"columns not in the table: {missing}")


def vocabulary(df: DataFrame, column: str, rare_threshold: int = 5) -> DataFrame:
    """(value, index): values found rare_threshold times or more, from 2 by falling count and then by value; any number of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= rare_threshold)
    ranked = range_rank(counts, [-F.col("n"), F.col("value")])
    return ranked.select("value", (F.col("rank") + RARE).cast("int").alias("index"))


def encode(column: str, vocab: dict[str, int]) -> Column:
    """0 for null, 1 for a rare or unseen value; for small vocabularies."""
    kept = {k: v for k, v in vocab.items() if v > RARE}
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(kept.items())))[F.col(column).cast("string")] if kept else F.lit(None).cast("int")
    return F.when(F.col(column).isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce(known, F.lit(RARE))).cast("int")


def encode_by_join(df: DataFrame, column: str, vocab: DataFrame, name: str, small: bool) -> DataFrame:
    """Adds encode() of a vocabulary table (value, index); `small`: it has at most HELD values and is broadcast.

    A larger one is joined by value; Spark splits the rows of a frequent value, of which the table has one.
    """
    table = vocab.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
    joined = df.join(F.broadcast(table) if small else table.hint("merge"), F.col(column).cast("string") == F.col("_value"), "left")
    code = F.when(F.col(column).isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce("_index", F.lit(RARE))).cast("int")
    return joined.withColumn(name, code).drop("_value", "_index")


def embedding_width(size: int) -> int:
    return min(50, (size + 1) // 2)


def fit_numeric(df: DataFrame, transforms: dict[str, str]) -> dict[str, dict]:
    """Parameters of every numeric column, all in the same three passes and exact, without a task that sees all values."""
    for c, kind in transforms.items():
        if kind not in TRANSFORMS:
            raise ValueError(f"Invalid transform {kind!r} for {c}")
    grid = [k / (QUANTILES - 1) for k in range(QUANTILES)]
    asked: dict[str, tuple[Column, list[float]]] = {}
    for c, kind in transforms.items():
        asked[c] = F.col(c), [0.5, *(grid if kind == "quantile" else [0.25, 0.75] if kind == "robust" else [])]
        if kind == "log1p":
            asked[f"log1p {c}"] = F.log1p(F.col(c).cast("double")), grid
    found, out = column_figures(df, asked), {}
    for c, kind in transforms.items():
        f = found[c]
        median, *rest = f.quantiles or [None]
        p = {"kind": kind, "median": 0.0 if median is None else median}
        if kind in ("min", "max", "mean"):
            value = {"min": f.low, "max": f.high, "mean": f.mean}[kind]
            p["value"] = value if f.n else (1.0 if kind == "max" else 0.0)
        elif kind == "robust":
            low, high = rest or (0.0, 1.0)
            p |= {"center": p["median"], "scale": (high - low) or 1.0}
        else:
            p["quantiles"] = (rest if kind == "quantile" else found[f"log1p {c}"].quantiles) or [0.0]
        out[c] = p
    return out


def interpolated(x: Column, edges: list[float]) -> Column:
    """Where x stands among sorted quantiles, 0 to 1, by linear interpolation from both sides, so equal quantiles share their middle."""
    q = np.array(edges, dtype=float)
    ref = np.linspace(0, 1, len(q)) if len(q) > 1 else np.array([0.5])

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        v = values.to_numpy()
        return pd.Series(0.5 * (np.interp(v, q, ref) - np.interp(-v, -q[::-1], -ref[::-1])))

    return run(x)


def apply_numeric(column: str, p: dict) -> Column:
    """Null takes the training median first."""
    x = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(float(p["median"])))
    kind = p["kind"]
    if kind in ("min", "mean"):
        return x - p["value"]
    if kind == "max":
        return x / p["value"] if p["value"] else x
    if kind == "robust":
        return (x - p["center"]) / p["scale"]
    return probit(interpolated(F.log1p(x) if kind == "log1p" else x, p["quantiles"]))


@dataclass
class FittedTransforms:
    """What a fit learnt; plain data with a JSON form. Vocabularies of more than HELD values stay tables (value, index), with their sizes."""

    vocabularies: dict[str, dict[str, int]] = field(default_factory=dict)
    numeric: dict[str, dict] = field(default_factory=dict)
    tables: dict[str, tuple[DataFrame, int]] = field(default_factory=dict, compare=False)
    order: tuple[str, ...] = field(default=(), compare=False)

    def categories(self) -> list[str]:
        return list(self.order or self.vocabularies)

    @property
    def categorical_vocab_sizes(self) -> list[int]:
        return [self.tables[c][1] + RARE + 1 if c in self.tables else len(self.vocabularies[c]) for c in self.categories()]

    def to_dict(self) -> dict:
        if self.tables:
            raise ValueError(f"too large for the driver, write them as tables: {list(self.tables)}")
        return {"vocabularies": self.vocabularies, "numeric": self.numeric}

    @classmethod
    def from_dict(cls, d: dict) -> FittedTransforms:
        return cls(d.get("vocabularies", {}), d.get("numeric", {}))

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds cat (array of indices) and num (array of floats)."""
        codes, out = [], df
        for i, c in enumerate(self.categories()):
            if c in self.tables or len(self.vocabularies[c]) > LITERAL:
                table = self.tables[c][0] if c in self.tables else df.sparkSession.createDataFrame([x for x in self.vocabularies[c].items() if x[1] > RARE], "value string, index int")
                out = encode_by_join(out, c, table, f"_code{i}", c not in self.tables)
                codes.append(F.col(f"_code{i}"))
            else:
                codes.append(encode(c, self.vocabularies[c]))
        num = F.array(*(apply_numeric(c, p).cast("float") for c, p in self.numeric.items())).cast("array<float>")
        return out.withColumns({"cat": F.array(*codes).cast("array<int>"), "num": num}).drop(*(f"_code{i}" for i in range(len(codes))))


def fit_transforms(df: DataFrame, spec: ColumnSpec, numeric_transform: dict[str, str] | None = None, rare_threshold: int = 5) -> FittedTransforms:
    spec.check(df)
    numeric_transform = numeric_transform or {}
    if missing := [c for c in spec.numeric_cols if c not in numeric_transform]:
        raise ValueError(f"no transform for {missing}")
    vocabularies, tables = {}, {}
    for c in spec.categorical_cols:
        values = vocabulary(df, c, rare_threshold)
        held = values.where(F.col("index") <= HELD + RARE).collect()  # at most HELD values
        if len(held) == HELD and (n := values.count()) > HELD:
            tables[c] = values, n
        else:
            vocabularies[c] = {"<UNK>": UNKNOWN, "<RARE>": RARE} | {r["value"]: r["index"] for r in sorted(held, key=lambda r: r["index"])}
    return FittedTransforms(vocabularies, fit_numeric(df, {c: numeric_transform[c] for c in spec.numeric_cols}), tables, tuple(spec.categorical_cols))


def preprocess(df: DataFrame, spec: ColumnSpec, numeric_transform: dict[str, str] | None = None, fitted: FittedTransforms | None = None, rare_threshold: int = 5, sep: str | None = None, max_length: int | None = None, encoder: Encoder | None = None) -> tuple[DataFrame, FittedTransforms]:
    """Adds model_text (its first max_length words, or all), cat, num and labels (array of floats); fits first if nothing fitted is given.

    With an encoder also text_vector, from the text joined by the encoder's separator, and with a tokenizer input_ids and
    attention_mask; train with embedding_col="text_vector". What isn't asked for is not worked out.
    """
    from litsift.functions.text import model_text, tokens

    sep = sep if sep is not None else encoder.sep if encoder else " "

    fitted = fitted or fit_transforms(df, spec, numeric_transform, rare_threshold)
    labels = F.array(*(F.col(c).cast("float") for c in spec.labels())).cast("array<float>")
    text = model_text(list(spec.text_cols), sep)
    if max_length is not None:
        text = F.array_join(tokens(text, max_length), " ")
    out = fitted.transform(df).withColumns({"model_text": text, "labels": labels})
    if encoder and encoder.tokenizer:
        out = out.withColumn("_tokens", tokenized("model_text", encoder)).withColumns({c: F.col(f"_tokens.{c}") for c in ("input_ids", "attention_mask")}).drop("_tokens")
    return (with_vectors(out, "model_text", encoder) if encoder else out), fitted
