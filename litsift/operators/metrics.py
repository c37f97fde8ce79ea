"""Evaluation as aggregations: confusion counts, rates, ROC, agreement, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.operators.order import running_by_score


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for b = 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def counts(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def binary_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, specificity and f1 (0 where a denominator is 0), beside the counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts(df, label, prediction, by).withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr and tpr for each distinct score."""
    run = running_by_score(df, score, {"pos": (F.col(label) == 1).cast("long"), "neg": (F.col(label) != 1).cast("long")})
    total = run.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return run.crossJoin(F.broadcast(total)).select(F.col(score).alias("threshold"), ratio(F.col("run_neg"), F.col("_n")).alias("fpr"), ratio(F.col("run_pos"), F.col("_p")).alias("tpr"))  # total is one row


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row auc: the share of pairs in the right order, ties counting half; null with one class only."""
    run = running_by_score(df, score, {"pos": (F.col(label) == 1).cast("long"), "neg": (F.col(label) != 1).cast("long")})
    area = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2))
    return run.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, predicted_0, predicted_1."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count_if(F.col(prediction) == 0).alias("predicted_0"), F.count_if(F.col(prediction) == 1).alias("predicted_1"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """class, precision, recall, f1 and support for 0 and 1, macro and weighted."""
    c = counts(df, label, prediction)
    sides = c.select(F.explode(F.array(
        F.struct(F.lit("0").alias("class"), F.col("tn").alias("hit"), (F.col("tn") + F.col("fn")).alias("said"), (F.col("tn") + F.col("fp")).alias("support")),
        F.struct(F.lit("1").alias("class"), F.col("tp").alias("hit"), (F.col("tp") + F.col("fp")).alias("said"), (F.col("tp") + F.col("fn")).alias("support")),
    )).alias("s")).select("s.*")
    each = sides.select("class", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    rates = ("precision", "recall", "f1")
    macro = each.agg(*(F.avg(r).alias(r) for r in rates), F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *rates, "support")
    weighted = each.agg(*(ratio(F.sum(F.col(r) * F.col("support")), F.sum("support")).alias(r) for r in rates), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *rates, "support")
    return each.union(macro).union(weighted)


def multi_label_metrics(df: DataFrame, labels: str, predictions: str, names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Metrics for each label of two arrays, within `by`; names default to label_i."""
    by = by or []
    rows = df.select(*by, F.posexplode(F.arrays_zip(F.col(labels).alias("y"), F.col(predictions).alias("p"))).alias("i", "z")).select(*by, "i", F.col("z.y").alias("y"), F.col("z.p").alias("p"))
    name = F.concat(F.lit("label_"), F.col("i"))
    for i, n in enumerate(names or []):
        name = F.when(F.col("i") == i, n).otherwise(name)
    out = binary_metrics(rows, "y", "p", [*by, "i"]).withColumn("label", name)
    return out.where(F.col("i") < len(names)) if names else out


def multi_label_summary(df: DataFrame, labels: str, predictions: str, names: list[str] | None = None) -> DataFrame:
    """One row macro_f1 (of the named labels) and hamming_loss (of all)."""
    per = multi_label_metrics(df, labels, predictions, names).agg(F.avg("f1").alias("macro_f1"))
    wrong = F.aggregate(F.zip_with(labels, predictions, lambda y, p: (y != p).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    loss = df.agg((F.sum(wrong) / F.sum(F.size(labels))).alias("hamming_loss"))
    return per.crossJoin(loss)  # one row each


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """total, agreed, agreement_rate and Cohen's kappa of two columns of any classes where both are given; kappa is 1 with one class overall, null without rows."""
    by = by or []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    none = F.lit(0).cast("long")
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("_n").alias("x"), none.alias("y")), F.struct(F.col("_b").alias("c"), none.alias("x"), F.col("_n").alias("y")))).alias("s"))
    chance = sides.groupBy(*by, "s.c").agg((F.sum("s.x").cast("double") * F.sum("s.y")).alias("_xy")).groupBy(*by).agg(F.sum("_xy").alias("_xy"))
    seen = pairs.groupBy(*by).agg(F.coalesce(F.sum("_n"), none).alias("total"), F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n"))), none).alias("agreed"))
    both = seen.crossJoin(chance) if not by else seen.alias("s").join(chance.alias("c"), [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]).select("s.*", "_xy")  # one row each without by
    n, hit = F.col("total"), F.col("agreed")
    expected = F.col("_xy") / (n.cast("double") * n)
    kappa = F.when(n == 0, F.lit(None).cast("double")).when(expected == 1, F.lit(1.0)).otherwise((hit / n - expected) / (1 - expected))
    return both.select(*by, "total", "agreed", ratio(hit, n).alias("agreement_rate"), kappa.alias("kappa"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    pos = F.sum((F.col(label) == 1).cast("long"))
    return df.agg(((F.count(label) - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def log_loss(df: DataFrame, label: str, probability: str) -> DataFrame:
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(probability)))
    return df.agg(F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("loss"))


def accuracy_percent(df: DataFrame, label: str, probability: str) -> DataFrame:
    return df.agg((100 * F.avg(((F.col(probability) > 0.5).cast("int") == F.col(label)).cast("int"))).alias("accuracy"))
