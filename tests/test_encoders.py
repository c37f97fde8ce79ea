import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsift.config import Config
from litsift.operators import encoders, features, model

WORDS = ["[pad]", "good", "bad", "paper", "long"]


def toy(folder, **more):
    """States are one-hot ids; every load leaves a file named by process."""

    def load():
        with open(os.path.join(folder, str(os.getpid())), "a") as f:
            f.write("x")

        def run(ids, mask):
            assert ids.shape == mask.shape and ((ids != 0) <= (mask == 1)).all()
            states = np.eye(len(WORDS))[ids] + 100.0 * (mask == 0)[:, :, None]  # what the mask hides must not matter
            return (states, np.tile(np.arange(3.0), (len(ids), 1))) if more.get("pooling") == "pooler" else states

        return run

    return encoders.Encoder("toy" + str(folder), load, lambda: lambda texts: [[WORDS.index(w) for w in t.split() if w in WORDS] for t in texts], batch_size=3, **more)


def test_vectors_are_masked_means(spark, tmp_path):
    texts = ["good paper", "bad", "", None, "long long long good", "good good"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    encoder = toy(tmp_path)
    for _ in range(2):
        got = {r["id"]: r["v"] for r in encoders.with_vectors(df, "t", encoder, "v").collect()}
        for i, t in enumerate(texts):
            ids = [WORDS.index(w) for w in (t or "").split()]
            assert got[i] == pytest.approx(np.eye(len(WORDS))[ids].mean(axis=0) if ids else np.zeros(len(WORDS)))
    loads = {f.name: len(f.read_text()) for f in tmp_path.iterdir()}
    assert loads and set(loads.values()) == {1}  # once a worker process, over all batches and both jobs
    ids = spark.createDataFrame([("good bad long",), (None,)], "t string").select(encoders.tokenized("t", toy(tmp_path / "n", max_length=2)).alias("x")).select("x.*").collect()
    assert [(r["input_ids"], r["attention_mask"]) for r in ids] == [([1, 2], [1, 1]), ([0, 0], [0, 0])]
    assert encoders.pooled((np.ones((1, 2, 3)), np.zeros((1, 3))), np.ones((1, 2)), "auto").tolist() == [[0, 0, 0]]
    assert encoders.pooled((np.ones((1, 2, 3)), np.zeros((1, 3))), np.ones((1, 2)), "mean").tolist() == [[1, 1, 1]]


def test_training_on_an_encoder(spark, tmp_path):
    rows = [(i, "good paper" if i % 2 else "bad paper long", float(i % 5), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, t string, x double, y int")
    ready, fitted = features.preprocess(df, features.ColumnSpec(("t",), (), ("x",), "y"), {"x": "mean"}, encoder=toy(tmp_path))
    assert ready.where("id = 0").select("input_ids", "attention_mask").first() == ([2, 3, 4] + [0] * 509, [1] * 3 + [0] * 509)
    net, _ = model.train(ready, None, 1, Config(epochs=10, learning_rate=0.05, mlp_hidden_size=4), embedding_col="text_vector", kind="mlp", id_col="id")
    assert net.fitted.shape.text == len(WORDS) and net.predict(ready).where(F.col("predictions")[0] == F.col("y")).count() == 80
    logistic, _ = model.train(ready, None, 1, Config(), embedding_col="text_vector")
    assert model.accuracy(logistic, ready) == 100
