"""When screening can stop: the running state of a review, its phases and its report."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.config import Config, default_config
from litsift.functions.scalars import recall_estimate, work_saved
from litsift.operators.order import ranges


@dataclass(frozen=True)
class StoppingState:
    phase: str = "random"
    consecutive_irrelevant: int = 0
    total_screened: int = 0
    total_relevant: int = 0
    history: tuple = ()

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> StoppingState:
        return cls(**d)


@dataclass(frozen=True)
class ActiveState:
    """Where an active-learning loop stands."""

    iteration: int = 0
    labeled_ids: tuple = ()
    unlabeled_ids: tuple = ()
    strategy: str = "uncertainty"
    history: tuple = field(default=())

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> ActiveState:
        return cls(**d)


def stopping_history(labels: DataFrame, label: str, order: list[str], by: list[str]) -> DataFrame:
    """Adds total_screened, total_relevant and consecutive_irrelevant after each label of a review; any label but 1 is irrelevant.

    A review of any length is spread over tasks: its rows are cut into slices that follow the order, each slice gives its
    rows, its relevant rows and those after the last relevant one, and these three are scanned over the slices of a review;
    every row then counts on from what stands before its slice. Rows of one place in the order stay in one slice.
    """
    relevant = F.coalesce((F.col(label) == 1).cast("long"), F.lit(0))
    cut = labels.withColumns({"_slice": ranges(labels, [F.col(c) for c in (*by, *order)]), "_hit": relevant})
    w = Window.partitionBy(*by, "_slice").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumns({"_n": F.row_number().over(w).cast("long"), "_r": F.sum("_hit").over(run)})
    own = own.withColumn("_last", F.max(F.when(F.col("_hit") == 1, F.col("_n"))).over(run))
    each = own.groupBy(*by, "_slice").agg(F.max("_n").alias("_rows"), F.sum("_hit").alias("_hits"), F.max("_last").alias("_at"))
    scan = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    whole = each.withColumns({"_n0": F.coalesce(F.sum("_rows").over(scan), F.lit(0)), "_r0": F.coalesce(F.sum("_hits").over(scan), F.lit(0))})
    whole = whole.withColumn("_last0", F.coalesce(F.max(F.col("_n0") + F.col("_at")).over(scan), F.lit(0)))
    keys = [*by, "_slice"]
    before = whole.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)), "_n0", "_r0", "_last0")
    met = own.join(before, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    total = F.col("_n0") + F.col("_n")
    return met.select(*labels.columns, total.alias("total_screened"), (F.col("_r0") + F.col("_r")).alias("total_relevant"), (total - F.coalesce(F.col("_n0") + F.col("_last"), F.col("_last0"))).alias("consecutive_irrelevant"))


def should_stop(total: Column, config: Config = default_config) -> Column:
    return (F.col("consecutive_irrelevant") >= config.safe_consecutive_irrelevant) & (F.col("total_screened") >= config.safe_min_screened_pct * total)


def next_phase(phase: Column, total: Column, config: Config = default_config) -> Column:
    """One step: random to active when enough is screened; active to switch or quality_check; switch to quality_check."""
    share = F.when(total > 0, F.col("total_screened") / total).otherwise(F.lit(0.0))
    after = "switch" if config.safe_switch_model else "quality_check"
    return F.when((phase == "random") & (share >= config.safe_random_sample_pct), "active").when(phase == "active", after).when(phase == "switch", "quality_check").otherwise(phase)


def stopping_report(states: DataFrame, total: Column, config: Config | None = None) -> DataFrame:
    """From rows (phase, total_screened, total_relevant, consecutive_irrelevant): the eight figures of the report."""
    recall = recall_estimate(F.col("total_relevant"), F.col("total_screened"), total)
    stop = should_stop(total, config) if config else F.lit(False)
    share = F.when(total > 0, F.col("total_screened") / total).otherwise(F.lit(0.0))
    return states.select("phase", "total_screened", "total_relevant", F.round(share, 4).alias("screened_pct"), F.round(recall, 4).alias("estimated_recall"), F.round(work_saved(total, F.col("total_screened"), recall), 4).alias("wss"), "consecutive_irrelevant", F.when(stop, "stop").otherwise("continue").alias("recommendation"))


def update(state: StoppingState, label: int) -> StoppingState:
    """The state after one more label, for interactive use."""
    hit = label == 1
    new = replace(state, total_screened=state.total_screened + 1, total_relevant=state.total_relevant + hit, consecutive_irrelevant=0 if hit else state.consecutive_irrelevant + 1)
    return replace(new, history=(*state.history, {"screened": new.total_screened, "relevant": new.total_relevant, "consecutive_irrelevant": new.consecutive_irrelevant}))
