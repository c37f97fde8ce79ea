import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsift.operators import features, metrics, order, stopping


def test_all_columns_in_the_same_passes(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1e6), float(rng.randint(0, 3)), None if i % 3 else rng.random(), None, float("nan"), float("inf") if i == 5 else -1e300 * rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, e double, f double")
    grid = [k / 50 for k in range(51)]
    got = order.column_figures(df, {c: (F.col(c), grid) for c in "abcde"} | {"f": (F.col("f"), [0.0, 0.5])})
    for j, c in enumerate("abc"):
        v = np.array([r[j + 1] for r in rows if r[j + 1] is not None])
        assert got[c].quantiles == pytest.approx(list(np.quantile(v, grid))) and (got[c].n, got[c].low, got[c].high) == (len(v), v.min(), v.max()) and got[c].mean == pytest.approx(v.mean())
    assert got["d"] == got["e"] == order.Figures() and got["f"].high == float("inf")
    assert order.column_figures(df.where("false"), {"a": (F.col("a"), grid)})["a"].quantiles == []


def test_roc_of_any_score(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.choice([rng.uniform(-1e4, 1e4), 7.0, -3.5])) for _ in range(600)] + [(1, None), (0, float("nan")), (1, float("inf")), (0, float("-inf"))]
    df = spark.createDataFrame(rows, "y int, p double")
    known = [(y, p) for y, p in rows if p is not None and p == p]
    pos, neg = [p for y, p in known if y], [p for y, p in known if not y]
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in metrics.roc_points(df, "y", "p").collect()}
    assert set(points) == {p for _, p in known}
    for t, (f, s) in points.items():
        assert (f, s) == (pytest.approx(sum(p >= t for p in neg) / len(neg)), pytest.approx(sum(p >= t for p in pos) / len(pos)))
    assert metrics.roc_auc(df.where("p is null"), "y", "p").first()[0] is None


def test_vocabulary_of_many_values(spark, monkeypatch):
    """100,000 values over many ranges, ranked like a sort, and encoded by both joins."""
    n = 100_000
    df = spark.range(n).selectExpr("concat('v', pmod(id * 7919, 100000)) value", "1 + id % 3 n")
    monkeypatch.setattr(order, "SAMPLED", 16)
    monkeypatch.setattr(order, "RANGE_ROWS", 3000)
    rows = df.withColumn("value", F.explode(F.array_repeat("value", F.col("n").cast("int")))).select("value")
    got = {r["value"]: r["index"] for r in features.vocabulary(rows, "value", 1).collect()}
    want = sorted(((-r["n"], r["value"]) for r in df.collect()))
    assert got == {v: i + 2 for i, (_, v) in enumerate(want)}
    monkeypatch.setattr(features, "HELD", 5000)
    asked = spark.createDataFrame([(want[0][1],), (want[-1][1],), ("other",), (None,)] * 3, "value string")
    fitted = features.fit_transforms(rows, features.ColumnSpec(categorical_cols=("value",)), rare_threshold=1)
    assert fitted.categorical_vocab_sizes == [n + 2] and "value" in fitted.tables
    expected = {want[0][1]: [2], want[-1][1]: [n + 1], "other": [1], None: [0]}
    assert {r["value"]: r["cat"] for r in fitted.transform(asked).collect()} == expected
    with pytest.raises(ValueError):
        fitted.to_dict()
    some = features.fit_transforms(rows, features.ColumnSpec(categorical_cols=("value",)), rare_threshold=3)
    monkeypatch.setattr(features, "HELD", 50_000)
    held = features.fit_transforms(rows, features.ColumnSpec(categorical_cols=("value",)), rare_threshold=3)
    assert some.tables and not held.tables and len(held.vocabularies["value"]) == some.categorical_vocab_sizes[0]
    assert sorted(map(str, held.transform(asked).collect())) == sorted(map(str, some.transform(asked).collect()))
    assert features.FittedTransforms.from_dict(held.to_dict()) == held


def test_long_reviews_are_spread_over_slices(spark, monkeypatch):
    monkeypatch.setattr(order, "SAMPLED", 2)
    monkeypatch.setattr(order, "RANGE_ROWS", 60)
    rng = random.Random(4)
    rows = [(r, k if k else None, rng.choice([0, 0, 0, 1, None])) for r, n in (("a", 900), (None, 40), ("c", 1), ("d", 200)) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "review string, seq int, y int")
    assert order.ranges(df, [F.col("review"), F.col("seq")]) is not None
    got = stopping.stopping_history(df, "y", ["seq"], ["review"])
    assert df.withColumn("s", order.ranges(df, [F.col("review"), F.col("seq")])).groupBy("s").count().agg(F.max("count")).first()[0] < 200
    states = {}
    want = set()
    for r, k, y in sorted(rows, key=lambda x: (x[0] or "", x[1] or 0)):
        s = stopping.update(states.get(r, stopping.StoppingState()), y)
        states[r] = stopping.replace(s, history=())
        want.add((r, k, y, s.total_screened, s.total_relevant, s.consecutive_irrelevant))
    assert {tuple(x) for x in got.collect()} == want
    assert stopping.stopping_history(df.where("false"), "y", ["seq"], ["review"]).count() == 0
    state = stopping.ActiveState(2, (1, 2), (3,))
    assert stopping.ActiveState.from_dict(state.to_dict()) == state


def test_kappa_of_any_classes(spark):
    df = spark.createDataFrame([("x", a, b) for a, b in [(0, 0), (1, 1), (2, 2), (0, 1), (2, 1), (1, 1), (0, None)]] + [("y", 1, 1)], "g string, a int, b int")
    r = metrics.agreement(df.where("g = 'x'"), "a", "b").first()
    chance = (2 * 1 + 2 * 4 + 2 * 1) / 36
    assert (r["total"], r["agreed"]) == (6, 4) and r["kappa"] == pytest.approx((4 / 6 - chance) / (1 - chance))
    assert {x["g"]: x["kappa"] for x in metrics.agreement(df, "a", "b", ["g"]).collect()} == {"x": pytest.approx(r["kappa"]), "y": 1.0}
    assert metrics.agreement(df.where("false"), "a", "b").first()["kappa"] is None
