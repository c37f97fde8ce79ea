"""The audit log: decisions, reviewers' labels, agreement and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsift.config import Config
from litsift.functions.scalars import figure_text, flag_uncertain, kappa_band
from litsift.operators.metrics import agreement

SCHEMA = "record_id string, model_prediction int, model_probability double, human_label int, timestamp string, reviewer_id string, phase string, notes string"
# The items of the reporting guideline and their descriptions.
PRISMA_ITEMS = {
    "item_8": "Selection process: automation tools used",
    "M3": "Purpose/Stage: AI applied at title/abstract screening",
    "M8": "Human-AI Interaction: human reviewer validation process",
    "M9": "Performance Evaluation: screening model metrics",
    "R1": "Study Selection: AI vs human exclusion counts in flow",
    "R2": "Performance Metrics: AI screening performance results",
}


def log_batch(scored: DataFrame, id_col: str, prediction: str, probability: str, phase: str = "screening", reviewer_id: str | None = None) -> DataFrame:
    """Scored rows as log entries; append them with unionByName or an append write."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return scored.select(
        F.col(id_col).cast("string").alias("record_id"), F.col(prediction).cast("int").alias("model_prediction"), F.col(probability).cast("double").alias("model_probability"),
        F.lit(None).cast("int").alias("human_label"), now.alias("timestamp"), F.lit(reviewer_id).cast("string").alias("reviewer_id"), F.lit(phase).alias("phase"), F.lit("").alias("notes"),
    )


def log_decision(spark: SparkSession, record_id: object, prediction: int, probability: float, phase: str = "screening", reviewer_id: str | None = None) -> DataFrame:
    """One entry, for interactive use."""
    row = spark.createDataFrame([(str(record_id), int(prediction), float(probability))], "id string, p int, q double")
    return log_batch(row, "id", "p", "q", phase, reviewer_id)


def to_dict(log: DataFrame, most: int = 1_000_000) -> dict:
    """A log as plain data, {"entries": [...]}; it goes through the driver, so a log of more than `most` entries raises ValueError. Write larger ones as tables."""
    rows = log.select(*(c.split()[0] for c in SCHEMA.split(", "))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries: write the log as a table")
    return {"entries": [r.asDict() for r in rows]}


def from_dict(spark: SparkSession, d: dict) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in d["entries"]], SCHEMA)


def update_labels(log: DataFrame, events: DataFrame, entry_seq: str, event_seq: str) -> DataFrame:
    """Each record's last event (record_id, human_label, reviewer_id, notes) overwrites its first entry; unknown ids raise KeyError."""
    last = events.groupBy("record_id").agg(F.max_by(F.struct("human_label", "reviewer_id", "notes"), event_seq).alias("e"))
    unknown = last.join(log, "record_id", "left_anti").select("record_id").limit(1).collect()
    if unknown:
        raise KeyError(unknown[0]["record_id"])
    first = F.row_number().over(Window.partitionBy("record_id").orderBy(entry_seq)) == 1
    joined = log.withColumn("_first", first).join(last, "record_id", "left")
    hit = F.col("_first") & F.col("e").isNotNull()
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    new = {"human_label": F.col("e.human_label"), "reviewer_id": F.col("e.reviewer_id"), "notes": F.coalesce("e.notes", F.lit("")), "timestamp": now}
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in log.columns))


def disagreements(log: DataFrame) -> DataFrame:
    return log.where(F.col("human_label").isNotNull() & (F.col("model_prediction") != F.col("human_label")))


def agreement_summary(log: DataFrame) -> DataFrame:
    """One row; agreed counts exactly."""
    return agreement(log, "human_label", "model_prediction")


def decision_summary(log: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """total, included, excluded, uncertain, human_reviewed and human_overrides."""
    p, h = F.col("model_prediction"), F.col("human_label")
    return log.agg(
        F.count("*").alias("total"), F.count_if(p == 1).alias("included"), F.count_if(p == 0).alias("excluded"), F.count_if(flag_uncertain(F.col("model_probability"), low, high)).alias("uncertain"),
        F.count_if(h.isNotNull()).alias("human_reviewed"), F.count_if(h.isNotNull() & (h != p)).alias("human_overrides"),
    )


def prisma_report(log: DataFrame, config: Config | None = None) -> DataFrame:
    """The report as rows (section, key, value); both summaries are one row. Rates are written without Java's exponents, which would begin below 0.001."""
    s = decision_summary(log, config.uncertainty_low if config else 0.3, config.uncertainty_high if config else 0.7)
    one = s.crossJoin(agreement_summary(log).select("total", "agreed", "agreement_rate", "kappa").withColumnRenamed("total", "compared"))
    stage = F.lit("title/abstract screening")
    rows = [
        ("item_8", "tool", F.lit("litsift")), ("item_8", "stage", stage), ("item_8", "model", F.lit(config.embedding_model if config else None)), ("item_8", "calibration", F.lit(config.calibration_method if config else None)),
        ("M3", "stage", stage), ("M3", "strategy", F.lit(config.al_query_strategy if config else None)),
        ("M8", "human_reviewed", F.col("human_reviewed")), ("M8", "human_overrides", F.col("human_overrides")), ("M8", "agreement_kappa", figure_text(F.col("kappa"))), ("M8", "kappa_interpretation", kappa_band(F.col("kappa"))),
        ("M9", "total_screened", F.col("total")), ("M9", "uncertain_flagged", F.col("uncertain")),
        ("R1", "model_included", F.col("included")), ("R1", "model_excluded", F.col("excluded")), ("R1", "human_overrides", F.col("human_overrides")),
        ("R2", "compared", F.col("compared")), ("R2", "agreed", F.col("agreed")), ("R2", "agreement_rate", figure_text(F.col("agreement_rate"))), ("R2", "kappa", figure_text(F.col("kappa"))),
    ]
    rows += [(k, "description", F.lit(v)) for k, v in PRISMA_ITEMS.items()]
    parts = F.array(*(F.struct(F.lit(a).alias("section"), F.lit(b).alias("key"), v.cast("string").alias("value")) for a, b, v in rows))
    return one.select(F.explode(parts).alias("r")).select("r.*")
