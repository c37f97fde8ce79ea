"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def to_number(text: Column) -> Column:
    """A double, or null for what is no number."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def figure_text(x: Column, places: int = 6) -> Column:
    """A double rounded, half away from zero, and written as SQL does: 0.5, 0.0005, 5.2e-05."""
    n = F.abs(F.round(x * 10.0**places)).cast("long")
    digits, cut = n.cast("string"), lambda d: F.regexp_replace(d, "0+$", "")
    fraction = cut(F.lpad((n % 10**places).cast("string"), places, "0"))
    fixed = F.concat(((n - n % 10**places) / 10**places).cast("long").cast("string"), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    rest = cut(F.substring(digits, 2, places))
    small = F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e-"), F.lpad((places + 1 - F.length(digits)).cast("string"), 2, "0"))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when((n > 0) & (n < 10 ** max(0, places - 4)), small).otherwise(fixed))


def yes_no(answer: Column) -> Column:
    """1 for Yes, 0 for No, null for anything else."""
    return F.when(answer == "Yes", 1).when(answer == "No", 0)


def to_yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").when(flag == 0, "No")


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (array of arrays) whose mask is not 0, place by place; zeros if all are masked."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    size = F.size(F.get(vectors, F.lit(0)))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), size), lambda a, v: F.zip_with(a, v, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wilson_lower(relevant: Column, screened: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson interval of relevant / screened; 0 if nothing was screened."""
    n, p = screened.cast("double"), relevant / screened
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(screened > 0, (middle - spread) / (1 + z * z / n)).otherwise(F.lit(0.0))


def recall_estimate(relevant: Column, screened: Column, total: Column) -> Column:
    """Found over the estimated number of relevant records, at most 1; 0 if nothing was found."""
    expected = wilson_lower(relevant, screened) * total
    return F.when((relevant > 0) & (expected > 0), F.least(relevant / expected, F.lit(1.0))).otherwise(F.lit(0.0))


def work_saved(total: Column, screened: Column, recall: Column) -> Column:
    """Work saved over sampling; 0 for no records."""
    return F.when(total > 0, (total - screened) / total - (1 - recall)).otherwise(F.lit(0.0))


def kappa_band(kappa: Column) -> Column:
    bands = ((0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"))
    out = F.when(kappa < 0, "poor")
    for high, name in bands:
        out = out.when(kappa <= high, name)
    return out.when(kappa.isNotNull(), "almost perfect")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def flag_uncertain(p: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """Strictly between the bounds."""
    return (p > low) & (p < high)


def flag_uncertain_each(ps: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return F.transform(ps, lambda p: (p > low) & (p < high))


# Acklam's rational approximation of the inverse normal distribution function.
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PROBIT_LOW = 0.02425


def probit(p: Column, most: float = 5.199337582605575) -> Column:
    """The inverse normal distribution function, cut at +-most."""

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    tail = lambda x: poly(PROBIT_C, F.sqrt(-2 * F.ln(x))) / poly(PROBIT_D, F.sqrt(-2 * F.ln(x)))
    value = F.when(p <= 0, F.lit(-most)).when(p >= 1, F.lit(most)).when(p < PROBIT_LOW, tail(p)).when(p > 1 - PROBIT_LOW, -tail(1 - p)).otherwise(poly(PROBIT_A, r) * q / poly(PROBIT_B, r))
    return F.greatest(F.lit(-most), F.least(F.lit(most), value))
