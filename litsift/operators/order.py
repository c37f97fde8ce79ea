"""Exact ranks and running sums without a window over all rows in one task.

Rows are dealt into buckets that follow the order; the bucket counts (a bounded number for each group) give every bucket
its offset, and a window counts within buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILE_BUCKETS = 256
#: Ranges of scores that running sums are made in.
SCORE_RANGES = 1024
#: Rows of a range of unique keys, about, and the share of keys that is looked at for the splitters: one in SAMPLED.
RANGE_ROWS, SAMPLED = 250_000, 4096


def hash_key(id_col: str, seed: int) -> Column:
    """A repeatable random order: md5 of the id and the seed."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, id_col: str, seed: int, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row in the random order, within `by`, and n, the number of rows there."""
    by = by or []
    keyed = df.withColumn("_key", hash_key(id_col, seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = counts.select(*by, "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    inner = Window.partitionBy(*by, "_bucket").orderBy("_key", id_col)
    ranked = keyed.withColumn("_own", F.row_number().over(inner))
    if by:
        match = [ranked[c].eqNullSafe(offsets[c]) for c in [*by, "_bucket"]]
        joined = ranked.join(offsets, match).select(*(ranked[c] for c in df.columns), "_own", "_before", "n")
    else:
        joined = ranked.join(F.broadcast(offsets), "_bucket")  # at most 4096 rows
    return joined.select(*df.columns, (F.col("_before") + F.col("_own")).alias(name), "n")


@dataclass
class Figures:
    """Of one column without null and NaN: rows, least, largest and mean value, and the wanted quantiles ([] without rows)."""

    n: int = 0
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    quantiles: list[float] = field(default_factory=list)


def exact_quantiles(df: DataFrame, value: Column, probabilities: list[float]) -> list[float]:
    """Quantiles of one value; see column_figures."""
    return column_figures(df, {"x": (value, probabilities)})["x"].quantiles


def column_figures(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, Figures]:
    """For each name the figures of its value, and quantiles by linear interpolation between the neighbouring values; NaN and null don't count.

    Three passes whatever the number of columns: approximate quantiles of all of them deal values into buckets; each
    bucket's exact count and sums tell which buckets hold the wanted ranks; only there distinct values are counted and put
    in order, a bucket a task. No task sees all values of a column.
    """
    if not wanted:
        return {}
    names = {k: f"x{i}" for i, k in enumerate(wanted)}
    number = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    rows = df.select(*(number(wanted[k][0]).alias(x) for k, x in names.items())).persist()  # narrow columns, read three times
    try:
        return dict(zip(wanted, figures_of(rows, [p for _, p in wanted.values()]), strict=True))
    finally:
        rows.unpersist()


def figures_of(rows: DataFrame, probabilities: list[list[float]]) -> list[Figures]:
    k = len(probabilities)
    columns = [f"x{i}" for i in range(k)]
    about = rows.approxQuantile(columns, [i / QUANTILE_BUCKETS for i in range(1, QUANTILE_BUCKETS)], 0.5 / QUANTILE_BUCKETS)
    inf = float("inf")
    splits = [[-inf, *sorted({e for e in edges if abs(e) < inf}), inf] for edges in about]
    splits = [s if len(s) > 2 else [-inf, 0.0, inf] for s in splits]
    dealt = Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[f"b{i}" for i in range(k)], handleInvalid="keep").transform(rows)
    each = dealt.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"b{i}").cast("int").alias("b"), F.col(f"x{i}").alias("x")) for i in range(k)))).alias("r")).select("r.*").where("x is not null")
    counts = each.groupBy("i", "b").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("s")).orderBy("i", "b").collect()  # a row a column and bucket
    out, wanted = [], []
    for i in range(k):
        own = [r for r in counts if r["i"] == i]
        n = sum(r["n"] for r in own)
        out.append(Figures(n, min(r["low"] for r in own), max(r["high"] for r in own), sum(r["s"] for r in own) / n) if n else Figures())
        ranks = sorted({r for p in probabilities[i] for r in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))}) if n else []
        at, next_rank = 0, 0
        for r in own:
            while next_rank < len(ranks) and ranks[next_rank] < at + r["n"]:
                wanted.append((i, r["b"], ranks[next_rank], ranks[next_rank] - at))
                next_rank += 1
            at += r["n"]
    if not wanted:
        return out
    marks = rows.sparkSession.createDataFrame(wanted, "i int, b int, rank long, own long")  # at most two a probability
    distinct = each.join(F.broadcast(marks.select("i", "b").distinct()), ["i", "b"]).groupBy("i", "b", "x").agg(F.count("*").alias("n"))
    upto = distinct.withColumn("upto", F.sum("n").over(Window.partitionBy("i", "b").orderBy("x")))
    found = upto.join(F.broadcast(marks), ["i", "b"]).where((F.col("own") < F.col("upto")) & (F.col("own") >= F.col("upto") - F.col("n"))).select("i", "rank", "x").collect()
    of = {(r["i"], r["rank"]): r["x"] for r in found}
    for i, f in enumerate(out):
        places = [p * (f.n - 1) for p in probabilities[i]] if f.n else []
        f.quantiles = [of[i, int(p)] + (p - int(p)) * (of[i, min(f.n - 1, int(p) + 1)] - of[i, int(p)]) for p in places]
    return out


def running_by_score(df: DataFrame, score: str, sums: dict[str, Column], descending: bool = True) -> DataFrame:
    """One row for each distinct score with running sums up to and with it; any numbers, rows with a null or NaN score are left out.

    Ranges of about equal numbers of rows come from approximate quantiles, at most SCORE_RANGES; equal scores are one row before.
    """
    x = F.col(score).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x))
    inf = float("inf")
    about = known.select(x.alias("x")).approxQuantile("x", [i / SCORE_RANGES for i in range(1, SCORE_RANGES)], 0.5 / SCORE_RANGES)
    splits = [-inf, *(sorted({e for e in about if abs(e) < inf}) or [0.0]), inf]
    distinct = known.groupBy(score).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    distinct = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket").transform(distinct.withColumn("_x", x)).drop("_x")
    direction = F.desc if descending else F.asc
    per = distinct.groupBy("_bucket").agg(*(F.sum(k).alias(k) for k in sums))
    w = Window.orderBy(direction("_bucket"))  # over at most SCORE_RANGES rows
    before = per.select("_bucket", *((F.sum(k).over(w) - F.col(k)).alias(f"_{k}") for k in sums))
    inner = Window.partitionBy("_bucket").orderBy(direction(score))
    return distinct.join(F.broadcast(before), "_bucket").select(score, *(k for k in sums), *((F.sum(k).over(inner) + F.col(f"_{k}")).alias(f"run_{k}") for k in sums))


def ranges(df: DataFrame, order: list[Column]) -> Column:
    """The number of the range, from 0, that a row falls into; ranges follow the order, ascending and with nulls first.

    One place in SAMPLED, by hash, comes to the driver and gives the splitters of ranges of some RANGE_ROWS rows. Rows of one
    place share a range.
    """
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    nulls_first = lambda o: tuple((v is not None, v) if v is not None else (False, 0) for v in o)
    sample = sorted((tuple(r["o"]) for r in df.where(F.pmod(F.xxhash64(*order), F.lit(SAMPLED)) == 0).select(place.alias("o")).collect()), key=nulls_first)
    n = max(1, -(-len(sample) * SAMPLED // RANGE_ROWS))
    chosen = {sample[i * len(sample) // n] for i in range(1, n)}
    cuts = sorted((c for c in chosen if all(v == v for v in c)), key=nulls_first)  # NaN can't be a splitter

    def before(cut: tuple) -> Column:
        out = F.lit(False)
        for c, v in reversed(list(zip(order, cut, strict=True))):
            less = F.lit(False) if v is None else c.isNull() | (c < F.lit(v))
            out = F.coalesce(less | (c.eqNullSafe(F.lit(v)) & out), F.lit(False))
        return out

    def found(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(before(cuts[m]), found(a, m)).otherwise(found(m + 1, b))

    return found(0, len(cuts))


def range_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) in an order that tells all rows apart; counts of ranges give offsets, and a window counts within a range."""
    dealt = df.withColumn("_range", ranges(df, order))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    ranked = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return ranked.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))
