"""Exact, repeatable splits, folds and stratified samples, by rank in a hash order of the id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.functions import text as T
from litsift.operators.order import exact_quantiles, hash_key, hash_rank

STRATA = ("very_low", "low", "medium", "high", "very_high")


def with_split(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Adds split: train, val or test, of sizes int(.8 n), int(.9 n) - int(.8 n) and the rest."""
    ranked = hash_rank(df, id_col, seed)
    part = F.when(F.col("rank") * 10 <= F.floor(F.col("n") * 8 / 10) * 10, "train").when(F.col("rank") <= F.floor(F.col("n") * 9 / 10), "val").otherwise("test")
    return ranked.select(*df.columns, part.alias("split"))


def split_data(df: DataFrame, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    done = with_split(df, id_col, seed)
    return tuple(done.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


def with_folds(df: DataFrame, id_col: str, label_cols: list[str], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold (from 0): every stratum of joined labels spreads evenly, and fold sizes differ by one at most."""
    keyed = df.withColumn("_stratum", F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in label_cols)))
    ranked = hash_rank(keyed, id_col, seed, ["_stratum"])
    from pyspark.sql import Window

    sizes = keyed.groupBy("_stratum").agg(F.count("*").alias("_n"))
    before = sizes.select("_stratum", (F.sum("_n").over(Window.orderBy("_stratum")) - F.col("_n")).alias("_before"))  # a row a stratum
    return ranked.join(before, "_stratum").select(*df.columns, ((F.col("_before") + F.col("rank") - 1) % n_folds).cast("int").alias("fold"))


def pattern_counts(df: DataFrame, patterns: dict[str, str], text_cols: list[str]) -> DataFrame:
    """Adds _text, {label}_pattern_count for each pattern, and pattern_score, the sum of the counts."""
    counted = df.withColumn("_text", T.combined_text([c for c in text_cols if c in df.columns]))
    counted = counted.withColumns({f"{k}_pattern_count": T.count_matches("_text", p) for k, p in patterns.items()})
    return counted.withColumn("pattern_score", reduce(lambda a, b: a + b, [F.col(f"{k}_pattern_count") for k in patterns], F.lit(0)))


def pattern_scores(df: DataFrame, patterns: dict[str, str], text_cols: list[str]) -> DataFrame:
    """Adds {label}_pattern_count and {label}_pattern_snippets for each pattern, and pattern_score, the sum of the counts."""
    return pattern_counts(df, patterns, text_cols).withColumns({f"{k}_pattern_snippets": T.snippets("_text", p) for k, p in patterns.items()}).drop("_text")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once, however often `of` asks for it and wherever the optimizer moves it."""
    return F.transform(F.array(value), of)[0]


def strata(df: DataFrame, score: str, n_strata: int = 5) -> Callable[[Column], Column]:
    """From a score to its stratum by the table's quantiles: right-closed, equal edges merged, named from the bottom; one score: uniform."""
    if n_strata > len(STRATA):
        raise ValueError(f"at most {len(STRATA)} strata")
    edges = sorted(set(exact_quantiles(df, F.col(score), [i / n_strata for i in range(n_strata + 1)])))

    def of(x: Column) -> Column:
        if len(edges) < 2:
            return F.lit("uniform")
        name = F.lit(STRATA[len(edges) - 2])
        for i in range(len(edges) - 3, -1, -1):
            name = F.when(x <= edges[i + 1], STRATA[i]).otherwise(name)
        return F.when(x.isNotNull(), name)

    return of


def with_strata(df: DataFrame, score: str, n_strata: int = 5) -> DataFrame:
    """Adds strata."""
    return df.withColumn("strata", once(F.col(score), strata(df, score, n_strata)))


def thresholds(narrow: DataFrame, id_col: str, by: str, fraction: float, seed: int) -> DataFrame:
    """(_by, _last, _last_id) of each stratum: the last row in the hash order that its sample of round-half-even(fraction * n) rows takes."""
    ranked = hash_rank(narrow.select(id_col, by), id_col, seed, [by])
    last = ranked.where(F.col("rank") == F.bround(F.lit(fraction) * F.col("n")))
    return last.select(F.col(by).alias("_by"), hash_key(id_col, seed).alias("_last"), F.col(id_col).alias("_last_id"))


def taken(id_col: str, key: Column, last: Column, last_id: Column) -> Column:
    """Whether a row with this key stands up to the threshold of its stratum."""
    return (key < last) | ((key == last) & (F.col(id_col) <= last_id))


def sample_strata(df: DataFrame, id_col: str, by: str, fraction: float, seed: int = 42) -> DataFrame:
    """Of each stratum round-half-even(fraction * n) rows, the first in the hash order; rows that repeat an id go together.

    Ids and strata alone are ranked; then rows are compared with one threshold a stratum.
    """
    last = thresholds(df, id_col, by, fraction, seed)
    return df.join(last, df[by].eqNullSafe(last["_by"])).where(taken(id_col, hash_key(id_col, seed), F.col("_last"), F.col("_last_id"))).select(*(df[c] for c in df.columns))


def sample_by_score(df: DataFrame, id_col: str, score: str, fraction: float, seed: int = 42, n_strata: int = 5) -> DataFrame:
    """The sample of each stratum of a score, with strata added.

    Only ids and scores are kept and shuffled before the sample is known; its thresholds are literals, so that rows of any
    width are filtered where they are read, and their score is worked out again only where the hash order may take them.
    """
    narrow = df.select(id_col, score).persist()
    try:
        of = strata(narrow, score, n_strata)
        last = thresholds(narrow.withColumn("strata", of(F.col(score))), id_col, "strata", fraction, seed).collect()  # a row a stratum
    finally:
        narrow.unpersist()
    key = lambda x: F.struct(of(x).alias("s"), hash_key(id_col, seed).alias("k"))
    up_to = lambda y: reduce(lambda a, b: a | b, [y["s"].eqNullSafe(F.lit(r["_by"])) & taken(id_col, y["k"], F.lit(r["_last"]), F.lit(r["_last_id"])) for r in last], F.lit(False))
    early = hash_key(id_col, seed) <= F.lit(max((r["_last"] for r in last), default=""))  # most rows are out before their score is asked for
    return df.where(early & once(once(F.col(score), key), up_to)).withColumn("strata", once(F.col(score), of))


def strata_distribution(df: DataFrame, by: str = "strata") -> DataFrame:
    """Rows and share of each stratum; rows without one stand under null."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select(by, "n", (F.col("n") / F.col("_all")).alias("share"))  # the sum is one row


def create_stratified_sample(df: DataFrame, patterns: dict[str, str], id_col: str, text_cols: list[str] | None = None, coding_labels: list[str] | None = None, sample_size: float = 0.2, random_seed: int = 42, n_strata: int = 5) -> DataFrame:
    """A sample for coding: pattern counts, strata by total count, snippets of the sampled texts, and empty columns for the coders."""
    sample = sample_by_score(pattern_counts(df, patterns, text_cols or ["title", "abstract", "keywords"]), id_col, "pattern_score", sample_size, random_seed, n_strata)
    made = [x for k in patterns for x in (f"{k}_pattern_count", f"{k}_pattern_snippets")]
    shown = sample.withColumns({f"{k}_pattern_snippets": T.snippets("_text", p) for k, p in patterns.items()})
    empty: dict[str, Column] = {c: F.lit("") for c in [*(coding_labels or list(patterns)), "notes", "coder_id", "coding_date"]}
    return shown.select(*df.columns, *made).withColumns(empty)
