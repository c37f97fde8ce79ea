import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsift.config import Config
from litsift.operators import features, model, network

SHAPE = network.Shape(7, True, (4, 6), 2, 5, 2, 3)


def made(n=70, seed=1):
    """(id, fold, text, codes, numbers, labels) with missing labels."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = [None if rng.random() < 0.1 else float(rng.random() < 0.4) for _ in range(3)]
        out.append((i, rng.choice([-1, 0, 1]), [rng.randrange(7) for _ in range(rng.randint(0, 6))], [[rng.randrange(4), rng.randrange(6)]], [[rng.random(), rng.random()]], y))
    return out


SCHEMA = "id long, fold int, text array<int>, codes array<array<int>>, numbers array<array<float>>, labels array<float>"


def plain(shape, flat, row, masks=None):
    """Logits of one row, entry by entry."""
    text = np.zeros(shape.text)
    for w in row[2]:
        text[w] += 1
    if text.any():
        text /= np.sqrt((text**2).sum())
    parts, k = shape.views(flat), len(shape.categories)
    x = np.concatenate([text, *(parts[i][c] for i, c in enumerate(row[3][0])), np.float32(row[4][0]).astype(float)])
    for i in range(k, len(parts), 2):
        x = x @ parts[i] + parts[i + 1]
        if i + 2 < len(parts):
            x = np.where(x > 0, x, 0)
    return x


def plain_loss(shape, flat, rows, weight):
    total, n = 0.0, 0
    for r in rows:
        for z, y, w in zip(plain(shape, flat, r), r[5], weight, strict=True):
            if y is not None:
                p = 1 / (1 + np.exp(-z))
                total, n = total - (w * y * np.log(p) + (1 - y) * np.log(1 - p)), n + 1
    return total / n


def block(rows):
    import pyarrow as pa

    return network.rows_of(pa.RecordBatch.from_pydict({"text": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "codes": [r[3] for r in rows], "numbers": [np.float32(r[4]).astype(float).tolist() for r in rows], "labels": [r[5] for r in rows]}), SHAPE, 0)


def test_gradient_is_the_slope_of_a_plain_loss():
    rows, weight, flat = made(20), np.array([1.0, 2.5, 0.5]), SHAPE.start(3)
    loss, grad = network.gradient(SHAPE, flat, block(rows), weight)
    assert loss == pytest.approx(plain_loss(SHAPE, flat, rows, weight))
    rng = np.random.default_rng(0)
    for i in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert grad[i] == pytest.approx((plain_loss(SHAPE, up, rows, weight) - plain_loss(SHAPE, down, rows, weight)) / 2e-6, abs=1e-6)


def plain_training(spark, rows, config, shards):
    """Epochs by a plain loop over rows that were put in order by the same hashes; no dropout."""
    df = spark.createDataFrame(rows, SCHEMA)
    key = F.xxhash64("id", F.lit(config.random_seed))
    order = df.select("id", key.alias("o"), F.pmod(F.xxhash64("id", F.lit(config.random_seed), F.lit("shard")), F.lit(shards)).alias("s")).orderBy("o").collect()
    by_id = {r[0]: r for r in rows}
    parts = [[by_id[r["id"]] for r in order if r["s"] == s] for s in range(shards)]
    known = [[r[5][i] for r in rows if r[1] != 0 and r[5][i] is not None] for i in range(3)]
    weight = np.array([(len(y) - sum(y)) / max(1, sum(y)) for y in known])
    mean, curve = network.State.start(SHAPE.start(config.random_seed)), []
    for epoch in range(1, config.epochs + 1):
        ends, sizes, loss = [], [], 0.0
        for s, part in enumerate(parts):
            learn = [k for k, r in enumerate(part) if r[1] != 0]
            if not part:
                continue
            mixed = [part[k] for k in np.random.default_rng((config.random_seed, epoch, s)).permutation(learn)]
            w, m, v = mean.flat.copy(), mean.first.copy(), mean.second.copy()
            per = -(-len(mixed) // config.batch_size)
            for k in range(per):
                batch, step, total = mixed[k * config.batch_size : (k + 1) * config.batch_size], per * (epoch - 1) + k, per * config.epochs
                value, g = network.gradient(SHAPE, w, block(batch), weight)
                loss += value * len(batch)
                g = g * min(1.0, config.gradient_clip_norm / (np.linalg.norm(g) + 1e-6)) if np.linalg.norm(g) > config.gradient_clip_norm else g
                rate = config.learning_rate * (step / max(1, config.warmup_steps) if step < config.warmup_steps else (total - step) / max(1, total - config.warmup_steps))
                w = w * (1 - 0.01 * rate)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
            ends.append((w, m, v))
            sizes.append(len(mixed))
        mean = network.State(*(sum(n * e[i] for n, e in zip(sizes, ends, strict=True)) / sum(sizes) for i in range(3)))
        held = [r for r in rows if r[1] == 0]
        curve.append((epoch, loss / sum(sizes), plain_loss(SHAPE, mean.flat, held, weight)))
    return curve, mean.flat


@pytest.mark.parametrize("shards", [1, 3])
def test_training_equals_a_plain_loop(spark, monkeypatch, shards):
    rows = made(70)
    monkeypatch.setattr(network, "SHARD_ROWS", -(-70 // shards))
    config = Config(epochs=4, batch_size=8, learning_rate=0.05, warmup_steps=3, dropout_rate=0.0, gradient_clip_norm=0.5, early_stopping_patience=9)
    for parts in (1, 5):  # neither partitions nor their order matter
        df = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(parts)).repartition(parts)
        got = network.train_all(df, F.col("id"), [SHAPE], config)[0]
        curve, flat = plain_training(spark, rows, config, shards)
        assert [r[:3] for r in got.history] == [pytest.approx(r) for r in curve]
        if got.best == 4:
            assert got.flat == pytest.approx(flat)
    assert got.best == min(curve, key=lambda r: r[2])[0]


def test_folds_in_one_scan_equal_separate_fits(spark):
    rows = [(*r[:3], r[3] * 2, r[4] * 2, r[5]) for r in made(60, 2)]
    df = spark.createDataFrame(rows, SCHEMA).where("fold >= 0")
    config = Config(epochs=3, batch_size=8, learning_rate=0.02, early_stopping_patience=2)
    both = network.train_all(df, F.col("id"), [SHAPE, SHAPE], config)
    for k in (0, 1):
        alone = network.train_all(df.withColumn("fold", F.when(F.col("fold") == k, 0).otherwise(-1)), F.col("id"), [SHAPE], config)[0]
        assert alone.best == both[k].best and alone.flat == pytest.approx(both[k].flat) and [r[:3] for r in alone.history] == [pytest.approx(r[:3]) for r in both[k].history]


def test_each_model_of_a_shard_has_its_own_task(spark, monkeypatch):
    rows = [(*r[:3], r[3] * 3, r[4] * 3, r[5]) for r in made(60, 4)]
    df = spark.createDataFrame(rows, SCHEMA).where("fold >= 0").persist()
    tracker = spark.sparkContext.statusTracker()
    for shards in (1, 2):
        monkeypatch.setattr(network, "SHARD_ROWS", -(-df.count() // shards))
        spark.sparkContext.setJobGroup(f"scans of {shards}", "")
        network.train_all(df, F.col("id"), [SHAPE] * 3, Config(epochs=2, batch_size=8, early_stopping_patience=5))
        spark.sparkContext.setJobGroup("", "")
        jobs = map(tracker.getJobInfo, tracker.getJobIdsForGroup(f"scans of {shards}"))
        tasks = [s.numTasks for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s]
        assert tasks.count(3 * shards) >= 3  # two epochs and the last figures
    df.unpersist()


def test_folds_alone_give_the_same_figures_of_validation(spark):
    df = spark.createDataFrame(made(60, 6), SCHEMA)
    config = Config(epochs=3, batch_size=8, learning_rate=0.02, early_stopping_patience=5)
    whole, part = (network.train_all(df, F.col("id"), [SHAPE], config, all_figures=x)[0] for x in (True, False))
    assert (part.flat == whole.flat).all() and part.best == whole.best
    assert [r[3] for r in part.history] == [None] * 3 and [(*r[:3], r[4]) for r in part.history] == [pytest.approx((*r[:3], r[4])) for r in whole.history]


def test_every_setting_acts(spark):
    df = spark.createDataFrame(made(50, 3), SCHEMA)
    base = {"epochs": 2, "batch_size": 8, "learning_rate": 0.02, "dropout_rate": 0.0, "early_stopping_patience": 5}
    run = lambda **more: network.train_all(df, F.col("id"), [SHAPE], Config(**(base | more)))[0].history[-1]
    first = run()
    assert first == run()
    for change in ({"learning_rate": 0.05}, {"dropout_rate": 0.4}, {"batch_size": 5}, {"warmup_steps": 4}, {"gradient_clip_norm": 0.01}, {"pos_weight": None}, {"random_seed": 7}, {"epochs": 3}):
        assert run(**change)[1] != first[1]


def test_joint_model_learns_predicts_and_is_saved(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        a, b = i % 2, int(rng.random() < 0.5)
        rows.append((i, f"{'good' if a else 'bad'} paper", "en" if b else "de", float(i), a, b if i % 7 else None))
    df = spark.createDataFrame([*rows, (500, None, None, None, 1, None)], "id long, t string, lang string, x double, y int, z int")
    spec = features.ColumnSpec(("t",), ("lang",), ("x",), ("y", "z"))
    ready, _ = features.preprocess(df, spec, {"x": "robust"})
    config = Config(epochs=8, learning_rate=0.03, mlp_hidden_size=8, n_hidden_layers=2)
    fitted, history = model.train(ready, ready, 2, config, 64, kind="mlp", id_col="id")
    assert isinstance(fitted, model.NetworkModel) and history.count() <= 8 and history.where("best").count() == 1
    out = fitted.predict(ready, temperature=model.calibrate(fitted, ready))
    assert out.where("id < 500 and predictions[0] = y").count() >= 118 and out.where("z is not null and predictions[1] = z").count() >= 100
    assert model.accuracy(fitted, ready) > 97
    fitted.save(str(tmp_path / "net"))
    again = model.NetworkModel.load(str(tmp_path / "net"))
    assert [r["logits"] for r in again.logits(ready).orderBy("id").collect()] == [r["logits"] for r in fitted.logits(ready).orderBy("id").collect()]
    folds, best = model.cross_validate(df.where("id < 500"), "id", spec, {"x": "robust"}, Config(n_folds=3, epochs=6, learning_rate=0.03, mlp_hidden_size=8), 64)
    assert folds.count() == 6 and 0 <= best < 3 and folds.where("label = 'y' and accuracy > 0.9").count() == 3
    assert model.cv_summary(folds).count() == 10
