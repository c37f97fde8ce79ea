"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one such part of all rows, so there are fewer than twice as many hot keys.
HOT_PARTS = 2048
#: Spark's setting by which an execution removes its own shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting; where none is set, a temporary one, for a local master only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="litsift-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder; for narrow tables.

    Nothing reads the shuffle files of what made them again, so they are removed at once and don't stay until the driver
    collects its garbage. Spark removes a checkpoint once nothing refers to it if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    conf = df.sparkSession.conf
    use_checkpoints(df.sparkSession)
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting as it is when the frame is made
    finally:
        conf.set(CLEANUP, before)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str, weight: str) -> DataFrame:
    """Inner join with a table that has each key once; `weight` says how many rows of `many` the key has.

    Rows of a hot key are dealt over as many salts as it takes by the hash of the column `spread`. The list of hot keys is
    broadcast; the weights add up to the rows of `many`, so it has at most 2 * HOT_PARTS entries. `few` is read several
    times and should be a cut table.
    """
    each = max(1, (few.agg(F.sum(weight)).first()[0] or 0) // HOT_PARTS)
    salts = F.ceil(F.col(weight) / each).cast("int")
    hot = few.where(F.col(weight) > each).select(*keys, salts.alias("salts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    copied = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(copied, [*keys, "salt"]).drop("salt")


def utf8(column: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts as empty. Arrow then hands bytes to Python without decoding them."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
