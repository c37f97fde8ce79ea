"""The corpus pipeline: documents through five operators to packed sequences.

Each stage works on all rows that its predecessor kept. All but the last return the columns of their input, extra ones
unchanged whatever their names; text and n_chars follow what a stage cuts. Rows are told apart by a key of their own: rows
that repeat an id with other texts all go through, copies of one row are a group like any other, and so are rows with a null
id, which stand behind all ids in a group. The suffix stage cuts by id, so rows of one id don't cut one another, and rows
with a null id stay as they are. An empty table stays empty. run() saves each stage's rows once, in the shared checkpoint
folder, so that none is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.llm import classifier, linededup, ngram, packing, suffix
from litsift.llm.common import cut, utf8
from litsift.llm.queries import tokenizer_path


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by place, so that no name clashes with a stage's own; and each name's new one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns under their own names again, with n_chars of the text as it is now."""
    return out.select(*(F.length(names["text"]).cast("long").alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in names.items()))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates."""
    out, names = linededup.drop_lines(docs), numbered(docs)[1]
    return named(out.toDF(*names.values(), "lines", "dropped"), names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the smallest id, and of its copies under that id the first."""
    plain, names = numbered(docs)
    rows = plain.withColumn("row", F.monotonically_increasing_id())
    groups = ngram.jaccard_components(rows.select(F.col("row").alias("doc_id"), F.col(names["text"]).alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    first = groups.join(rows.select("row", F.col(names["doc_id"]).alias("id")), "row").groupBy("component_id").agg(F.min(place)["row"].alias("row"))
    return named(rows.join(first.select("row"), "row", "left_semi").drop("row"), names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a smaller document holds too; characters that a cut splits become U+FFFD."""
    plain, names = numbered(docs)
    i, t = names["doc_id"], names["text"]
    cut_rows = suffix.cut_repeats(docs.select("doc_id", "text")).where("n_removed > 0")
    cut_rows = cut_rows.select(F.col("doc_id").alias("cut_id"), F.col("row_hash").alias("cut_hash"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")).dropDuplicates(["cut_id", "cut_hash"])
    joined = plain.join(cut_rows, (F.col(i) == F.col("cut_id")) & (F.hash(utf8(t)) == F.col("cut_hash")), "left")
    return named(joined.withColumn(t, F.coalesce("kept_text", t)), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: SQL can't express these stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        out = cut(stage(spark, out, sf_dir))
    return STAGES[-1][1](spark, out, sf_dir)
