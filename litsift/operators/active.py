"""Choosing the next records for review, and taking in what reviewers say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.operators.order import hash_key

STRATEGIES = ("uncertainty", "random", "max_relevance")


def rank_by(df: DataFrame, strategy: str, probability: str, id_col: str, seed: int = 42) -> list:
    """The sort keys of a strategy; ties go by id."""
    keys = {"uncertainty": F.abs(F.col(probability) - 0.5), "random": hash_key(id_col, seed), "max_relevance": F.desc(probability)}
    if strategy not in keys:
        raise KeyError(strategy)
    return [keys[strategy], F.col(id_col)]


def select_query_batch(df: DataFrame, probability: str, id_col: str, strategy: str = "uncertainty", batch_size: int = 20, seed: int = 42) -> DataFrame:
    """The first batch_size rows of the strategy's order, by a distributed top-k."""
    return df.orderBy(*rank_by(df, strategy, probability, id_col, seed)).limit(batch_size)


def create_review_batch(df: DataFrame, chosen: DataFrame, probability: str, id_col: str) -> DataFrame:
    """The chosen ids' rows, with model_probability and model_prediction (1 from 0.5 on)."""
    kept = df.join(chosen.select(id_col).distinct(), id_col, "left_semi")
    return kept.withColumns({"model_probability": F.col(probability), "model_prediction": (F.col(probability) >= 0.5).cast("int")})


def merge_human_labels(df: DataFrame, batch: DataFrame, id_col: str, label_col: str = "human_label") -> DataFrame:
    """Reviewed rows take the batch's label, a null one too; other rows keep theirs; ids of a batch are to be unique."""
    if batch.groupBy(id_col).count().where("count > 1").limit(1).count():
        raise ValueError("an id stands twice in the batch")
    if label_col not in df.columns:
        df = df.withColumn(label_col, F.lit(None).cast(batch.schema[label_col].dataType))
    new = batch.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.lit(True).alias("_in"))
    label = F.when(F.col("_in"), F.col("_label")).otherwise(F.col(label_col))
    return df.join(new, F.col(id_col) == F.col("_id"), "left").select(*(label.alias(c) if c == label_col else F.col(c) for c in df.columns))
