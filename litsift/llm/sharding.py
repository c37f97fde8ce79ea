"""Sharding into parts of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id, a row number), so equal texts stand together. Size-weighted samples of
that key give quantile splitters, which range-partition the records into many more ranges than shards. Each range's exact
bytes are counted; ranges above OVERFULL times the target are sampled again and subdivided, until none is left that can be.
The shard boundaries are then placed inside the ranges that hold them, on the edge of a group of equal texts where the
group is small.

Edge cases: a null text has size 1 as an empty one; repeated rows are sharded one by one and may be parted; a single record
is never parted, however long; ties of text and id are ordered by row number, so which of them takes which slot may differ
between runs; an empty table gives an empty result; a null doc_id sorts first; extra columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.common import cut, n_partitions, utf8

#: Expected number of sampled keys for each range.
SAMPLES = 200
#: Ranges of more than so many times their target are subdivided.
OVERFULL = 1.5
#: Groups of equal texts up to this share of a shard stay in one shard; larger ones are subdivided.
WHOLE_GROUP = 0.02
KEY = ["key", "tie", "row"]


def sampled(rows: DataFrame, rate: str) -> pd.DataFrame:
    """Keys drawn with chances in proportion to their sizes, with their weights; a column holds the rate for each byte."""
    chance = F.col("size") * F.col(rate)
    draw = F.xxhash64(*KEY, F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return rows.where(draw < chance).select(*KEY, F.greatest(F.lit(1.0), chance).alias("w"), *(["range"] if "range" in rows.columns else [])).toPandas()


def cut_keys(sample: pd.DataFrame, ranges: int, whole: bool = True) -> np.ndarray:
    """Quantile splitters (key, tie, row) of a weighted sample; with `whole`, a key keeps its ties only where it spans several quantiles."""
    if sample.empty:
        return np.empty((0, 3), dtype=np.int64)
    sample = sample.sort_values(KEY, kind="stable")
    weights = sample["w"].to_numpy().cumsum()
    at = np.searchsorted(weights, weights[-1] * np.arange(1, ranges) / ranges)
    picked = sample[KEY].to_numpy()[np.minimum(at, len(sample) - 1)]
    if whole:
        alone = ~pd.Series(picked[:, 0]).duplicated(keep=False).to_numpy()
        picked[alone, 1:] = -(2**63)
    return np.unique(picked, axis=0)


def places(splitters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the number of splitters up to it."""
    both = np.concatenate([splitters, rows])
    own = np.arange(len(both)) >= len(splitters)
    order = np.lexsort((own, both[:, 2], both[:, 1], both[:, 0]))
    out = np.empty(len(both), dtype=np.int32)
    out[order] = np.cumsum(~own[order])
    return out[len(splitters) :]


def ranged(light: DataFrame, splitters: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(places(splitters, np.stack([key.to_numpy(), tie.to_numpy(), row.to_numpy()], axis=1)))

    return cut(light.withColumn("range", range_of(*KEY)))


def in_ranges(light: DataFrame, total: int, ranges: int) -> tuple[DataFrame, list[tuple]]:
    """The rows with their range, and (range, bytes, rows) of each range."""
    spark, target = light.sparkSession, max(1, total) / ranges
    splitters = cut_keys(sampled(light.withColumn("rate", F.lit(SAMPLES * ranges / max(1, total))), "rate"), ranges)  # SAMPLES a range are expected
    while True:
        out = ranged(light, splitters)
        sums = sorted(tuple(r) for r in out.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())  # a row a range
        over = {r: size for r, size, n in sums if size > OVERFULL * target and n > 1}
        if not over:
            return out, sums
        rates = spark.createDataFrame([(r, SAMPLES * max(1.0, size / target) / size) for r, size in over.items()], "range int, rate double")
        sample = sampled(out.join(F.broadcast(rates), "range"), "rate")
        known, more = set(map(tuple, splitters)), [splitters]
        for r, part in sample.groupby("range"):
            cuts = cut_keys(part, int(-(-over[r] // target)))
            # if the range begins with a group that reaches over all cuts, the group itself is cut
            more.append(cut_keys(part, int(-(-over[r] // target)), whole=False) if all(tuple(x) in known for x in cuts) else cuts)
        new = np.unique(np.concatenate(more), axis=0)
        if len(new) == len(splitters):  # what is left are single long records, with little beside them
            return out, sums
        splitters = new


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """Per row doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null)."""
    spark = docs.sparkSession
    text = utf8("text")
    light = cut(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("tie"), F.monotonically_increasing_id().alias("row")))
    total = light.agg(F.sum("size")).first()[0] or 0
    rows, sums = in_ranges(light, total, ranges or max(4 * shards, n_partitions(spark)))
    begin, at = {}, 0
    for k, size, _ in sums:
        begin[k], at = at, at + size
    own = Window.partitionBy("range").orderBy(*KEY)
    group = Window.partitionBy("range", "key")
    starts = spark.createDataFrame([(k, v) for k, v in begin.items()], "range int, begin long")
    position = F.col("begin") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.join(F.broadcast(starts), "range").withColumns({"at": position, "group_bytes": F.sum("size").over(group)})
    small = F.col("group_bytes") <= F.lit(WHOLE_GROUP * total / shards)
    middle = F.when(small, F.min("at").over(group) + F.col("group_bytes") / 2).otherwise(F.col("at") + F.col("size") / 2)
    placed = cut(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int")))
    counts = sorted((r["range"], r["shard"], r["n"]) for r in placed.groupBy("range", "shard").agg(F.count("*").alias("n")).collect())  # at most ranges + shards rows
    held = [0] * shards
    offsets = []
    for k, s, n in counts:
        offsets.append((k, s, held[s]))
        held[s] += n
    slots = spark.createDataFrame(offsets, "range int, shard int, before long")
    inside = Window.partitionBy("range", "shard").orderBy(*KEY)
    out = placed.join(F.broadcast(slots), ["range", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.row_number().over(inside) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
