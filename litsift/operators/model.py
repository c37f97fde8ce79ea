"""Text-plus-tabular classifiers: features, fit, prediction, calibration and cross-validation.

Kind "mlp" is one joint network for all labels (operators/network.py), whose training follows every setting; kind "logistic"
is Spark ML's logistic regression, one for each label.

Encoders are pluggable; the offline default hashes words to term frequencies inside Spark. A neural encoder is given as a
column of vectors that another job has made.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import exp, log

import numpy as np

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, OneHotEncoder, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.config import Config, default_config
from litsift.functions.scalars import flag_uncertain, sigmoid
from litsift.functions.text import model_text
from litsift.operators import metrics, network
from litsift.operators.features import ColumnSpec, fit_transforms, preprocess
from litsift.operators.sampling import with_folds

HIDDEN = "mlp"
#: Solver steps of an epoch of logistic regression.
STEPS = 10


def feature_stages(text_features: int, n_cat: int, embedding: bool) -> list:
    """Categories become 0 and 1 for each of their codes, so that codes have no order; text becomes hashed word counts."""
    text = [] if embedding else [RegexTokenizer(inputCol="model_text", outputCol="_words", pattern="\\s+"), HashingTF(inputCol="_words", outputCol="_text", numFeatures=text_features)]
    hot = [OneHotEncoder(inputCols=[f"_cat{i}" for i in range(n_cat)], outputCols=[f"_hot{i}" for i in range(n_cat)], dropLast=False, handleInvalid="keep")] if n_cat else []
    return [*text, *hot, VectorAssembler(inputCols=["_text", *(f"_hot{i}" for i in range(n_cat)), "_num"], outputCol="_features")]


def classifier(steps: int) -> LogisticRegression:
    """The last stage; `steps` solver steps, from the same start each time."""
    return LogisticRegression(weightCol="_weight", regParam=0.01, featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred", maxIter=steps)


def inputs(df: DataFrame, embedding_col: str | None, n_cat: int) -> DataFrame:
    """Vectors and category codes for the stages; an empty array becomes a vector of one zero."""
    filled = lambda c: array_to_vector(F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("double"))).otherwise(F.array(F.lit(0.0))))
    out = df.withColumns({"_num": filled("num")} | {f"_cat{i}": F.col("cat")[i].cast("double") for i in range(n_cat)})
    return out.withColumn("_text", filled(embedding_col)) if embedding_col else out


class Predictor:
    """A model with n_labels and logits()."""

    n_labels: int

    def logits(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame, threshold: float | list[float] = 0.5, temperature: list[float] | None = None) -> DataFrame:
        """Adds logits, probabilities and predictions (1 above the threshold); calibration comes before the sigmoid."""
        out, n = self.logits(df), self.n_labels
        limits = threshold if isinstance(threshold, list) else [threshold] * n
        t = temperature or [1.0] * n
        p: list[Column] = [sigmoid(F.col("logits")[i] / t[i]) for i in range(n)]
        return out.withColumn("probabilities", F.array(*p)).withColumn("predictions", F.array(*((F.col("probabilities")[i] > limits[i]).cast("int") for i in range(n))))


@dataclass
class ScreeningModel(Predictor):
    """One logistic model for each label."""

    models: list[PipelineModel]
    embedding_col: str | None = None
    n_cat: int = 0

    @property
    def n_labels(self) -> int:
        return len(self.models)

    def save(self, path: str) -> None:
        """One folder for each label's pipeline, and the name of the vector column."""
        spark = SparkSession.active()
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/label_{i}")
        spark.createDataFrame([(len(self.models), self.embedding_col, self.n_cat)], "n int, embedding_col string, n_cat int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> ScreeningModel:
        about = SparkSession.active().read.parquet(f"{path}/about").first()
        return cls([PipelineModel.load(f"{path}/label_{i}") for i in range(about["n"])], about["embedding_col"], about["n_cat"])

    def logits(self, df: DataFrame) -> DataFrame:
        """Adds logits (array of double, one for each label)."""
        out, names = inputs(df, self.embedding_col, self.n_cat), []
        made = [*(f"_cat{i}" for i in range(self.n_cat)), "_num", *(["_text"] if self.embedding_col else [])]
        for i, m in enumerate(self.models):
            out = m.transform(out)
            out = out.withColumn(f"_logit{i}", vector_to_array("_raw")[1]).drop("_raw", "_prob", "_pred", "_features", *(f"_hot{i}" for i in range(self.n_cat)), *([] if self.embedding_col else ["_words", "_text"]))
            names.append(f"_logit{i}")
        return out.withColumn("logits", F.array(*names)).drop(*names, *made)


@dataclass
class NetworkModel(Predictor):
    """One network for all labels."""

    fitted: network.Fitted
    embedding_col: str | None = None

    @property
    def n_labels(self) -> int:
        return self.fitted.shape.labels

    def logits(self, df: DataFrame) -> DataFrame:
        """Adds logits (array of double, one for each label)."""
        text = text_input(self.embedding_col, self.fitted.shape.text)
        return df.withColumn("logits", network.logits([self.fitted], F.lit(0), text, F.array("cat"), F.array("num")))

    def save(self, path: str) -> None:
        """One row of Parquet with the shape, the weights and the history."""
        row = (json.dumps(asdict(self.fitted.shape)), self.embedding_col, self.fitted.flat.astype("<f8").tobytes(), json.dumps(self.fitted.history), self.fitted.best)
        SparkSession.active().createDataFrame([row], "shape string, embedding_col string, weights binary, history string, best int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> NetworkModel:
        r = SparkSession.active().read.parquet(path).first()
        shape = json.loads(r["shape"])
        shape["categories"] = tuple(shape["categories"])
        return cls(network.Fitted(network.Shape(**shape), np.frombuffer(r["weights"], "<f8"), [tuple(x) for x in json.loads(r["history"])], r["best"]), r["embedding_col"])


def text_input(embedding_col: str | None, text_features: int) -> Column:
    """What a network takes of a text: hashed words, or a column of vectors."""
    return F.col(embedding_col).cast("array<double>") if embedding_col else network.hashed_words("model_text", text_features)


def shape_of(df: DataFrame, n_labels: int, config: Config, text_features: int, embedding_col: str | None, cat: str = "cat", num: str = "num") -> network.Shape:
    """The sizes that the rows ask for, from one aggregation; codes up to the largest have a place in the table."""
    about = df.agg(F.max(F.size(cat)).alias("cats"), F.max(F.size(num)).alias("nums"), (F.max(F.size(embedding_col)) if embedding_col else F.lit(text_features)).alias("text")).first()
    n = max(0, about["cats"] or 0)
    top = df.agg(*(F.max(F.col(cat)[i]).alias(f"m{i}") for i in range(n))).first() if n else []
    return network.Shape(max(1, about["text"] or 1), embedding_col is None, tuple(max(2, (m or 0) + 1) for m in top), max(0, about["nums"] or 0), config.mlp_hidden_size, config.n_hidden_layers, n_labels)


def unpack_labels(predicted: DataFrame, names: list[str], low: float = 0.3, high: float = 0.7) -> DataFrame:
    """For each label its prediction, {name}_prob and {name}_uncertain, from the arrays of predict()."""
    p = [F.col("probabilities")[i] for i in range(len(names))]
    return predicted.withColumns({k: v for i, n in enumerate(names) for k, v in ((n, F.col("predictions")[i]), (f"{n}_prob", p[i]), (f"{n}_uncertain", flag_uncertain(p[i], low, high)))})


HISTORY = "label int, epoch int, train_loss double, validation_loss double, train_accuracy double, validation_accuracy double, best boolean"


def train(df: DataFrame, validation: DataFrame | None = None, n_labels: int = 1, config: Config = default_config, text_features: int = 1 << 12, embedding_col: str | None = None, kind: str = "logistic", id_col: str | None = None) -> tuple[Predictor, DataFrame]:
    """The model, and its history: label, epoch, train_loss, validation_loss, train_accuracy, validation_accuracy (in percent) and best.

    With validation rows training stops after `early_stopping_patience` epochs without a smaller validation loss, and the
    best epoch's model is kept. Kind "mlp" trains one network for all labels, label is null in its history and missing
    labels of a row are left out of its loss; rows go in the order of a hash of id_col, or of all they hold. Kind
    "logistic" trains a model for each label: an epoch is STEPS solver steps, and epoch k repeats those of epoch k - 1, as
    Spark's solvers start anew; without validation rows all epochs run at once and the history has one row a label, without
    figures. pos_weight 'auto' weighs positives by negatives / positives.
    """
    if kind == HIDDEN:
        return train_network(df, validation, n_labels, config, text_features, embedding_col, id_col)
    spark, models, history = df.sparkSession, [], []
    top = df.select(F.size("cat").alias("n")).first()
    n_cat = max(0, top["n"]) if top else 0
    ready = inputs(df, embedding_col, n_cat)
    for i in range(n_labels):
        labelled = lambda rows: rows.where(F.col("labels")[i].isNotNull()).withColumn("_label", F.col("labels")[i].cast("double"))  # noqa: B023, E731
        own = labelled(ready)
        weight = metrics.positive_weight(own, "_label").first()[0] if config.pos_weight == "auto" else float(config.pos_weight or 1.0)
        own = own.withColumn("_weight", F.when(F.col("_label") == 1, F.lit(float(weight or 1.0))).otherwise(F.lit(1.0)))
        made = Pipeline(stages=feature_stages(text_features, n_cat, bool(embedding_col))).fit(own)
        seen = made.transform(own).select("_features", "_label", "_weight").persist()
        checked = made.transform(labelled(inputs(validation, embedding_col, n_cat))).select("_features", "_label").persist() if validation is not None else None
        best, kept, rows = None, None, []
        for epoch in range(1, config.epochs + 1) if checked is not None else (config.epochs,):
            fitted = classifier(STEPS * epoch).fit(seen)
            figures = [loss_and_accuracy(fitted, t) for t in (seen, checked)] if checked is not None else [(None, None)] * 2
            rows.append([i, epoch, figures[0][0], figures[1][0], figures[0][1], figures[1][1]])
            if checked is None or best is None or figures[1][0] < rows[best][3]:
                best, kept = len(rows) - 1, fitted
            elif len(rows) - 1 - best >= config.early_stopping_patience:
                break
        history += [(*r, k == best) for k, r in enumerate(rows)]
        models.append(PipelineModel(stages=[*made.stages, kept]))
        for t in (seen, checked):
            if t is not None:
                t.unpersist()
    return ScreeningModel(models, embedding_col, n_cat), spark.createDataFrame(history, HISTORY)


def train_network(df: DataFrame, validation: DataFrame | None, n_labels: int, config: Config, text_features: int, embedding_col: str | None, id_col: str | None) -> tuple[NetworkModel, DataFrame]:
    shape = shape_of(df, n_labels, config, text_features, embedding_col)
    text = text_input(embedding_col, text_features)
    key = F.col(id_col) if id_col else F.xxhash64("model_text", "cat", "num", "labels", *([embedding_col] if embedding_col else []))
    of = lambda rows, fold: rows.select(F.lit(fold).alias("fold"), text.alias("text"), F.array("cat").alias("codes"), F.array("num").alias("numbers"), "labels", key.alias("key"))
    rows = of(df, -1) if validation is None else of(df, -1).union(of(validation, 0))
    fitted = network.train_all(rows, F.col("key"), [shape], config)[0]
    history = [(None, *r, r[0] == fitted.best) for r in fitted.history]
    return NetworkModel(fitted, embedding_col), df.sparkSession.createDataFrame(history, HISTORY)


def accuracy(model: Predictor, df: DataFrame) -> float | None:
    """Percent of all given labels that the model predicts, at a probability of 0.5; for the test rows after training."""
    hits = F.zip_with("predictions", "labels", lambda p, y: F.when(y.isNotNull(), (p == y.cast("int")).cast("int")))
    return model.predict(df).select(F.explode(hits).alias("hit")).agg(100 * F.avg("hit")).first()[0]


def loss_and_accuracy(fitted, rows: DataFrame) -> tuple[float | None, float | None]:
    p = vector_to_array("_prob")[1]
    scored = fitted.transform(rows).select("_label", p.alias("p"))
    return metrics.log_loss(scored, "_label", "p").first()[0], metrics.accuracy_percent(scored, "_label", "p").first()[0]


def fit(df: DataFrame, n_labels: int = 1, config: Config = default_config, text_features: int = 1 << 12, embedding_col: str | None = None, kind: str = "logistic", id_col: str | None = None) -> Predictor:
    """Fits on rows of preprocess(), all epochs."""
    return train(df, None, n_labels, config, text_features, embedding_col, kind, id_col)[0]


def fit_temperature(scored: DataFrame, logit: Column, label: Column, steps: int = 3, points: int = 25) -> float:
    """The temperature of least log loss: a grid over log T, each in one aggregation, refined around the best."""
    low, high = log(0.05), log(20.0)
    best = 0.0
    for _ in range(steps):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        z = [logit / exp(g) for g in grid]
        loss = [F.avg(F.greatest(x, F.lit(0.0)) - x * label + F.log1p(F.exp(-F.abs(x)))) for x in z]
        row = scored.agg(*(v.alias(f"l{i}") for i, v in enumerate(loss))).first()
        if row[0] is None:
            return 1.0
        k = min(range(points), key=lambda i: row[i])
        best, width = grid[k], (high - low) / (points - 1)
        low, high = best - width, best + width
    return exp(best)


def calibration_to_dict(temperature: list[float]) -> dict:
    return {"temperature": temperature[0] if len(temperature) == 1 else list(temperature)}


def calibration_from_dict(d: dict) -> list[float]:
    t = d["temperature"]
    return list(t) if isinstance(t, list) else [t]


def calibrate(model: Predictor, df: DataFrame) -> list[float]:
    scored = model.logits(df).select("logits", "labels").persist()  # two short arrays a row, read several times
    out = [fit_temperature(scored, F.col("logits")[i], F.col("labels")[i].cast("double")) for i in range(model.n_labels)]
    scored.unpersist()
    return out


def cross_validate(df: DataFrame, id_col: str, spec: ColumnSpec, numeric_transform: dict[str, str] | None = None, config: Config = default_config, text_features: int = 1 << 12, embedding_col: str | None = None) -> tuple[DataFrame, int]:
    """Metrics of each fold and label with the fold's best_epoch, best_validation_loss and validation_accuracy, and the fold of highest accuracy.

    Transforms are fitted on each fold's own training rows. All folds' networks train in the same scans: a row carries its
    codes and numbers under every fold's transforms, and is left out by the model of its own fold.
    """
    names = spec.labels()
    folds, labels, text = range(config.n_folds), F.array(*(F.col(c).cast("float") for c in names)), text_input(embedding_col, text_features)
    base = with_folds(df, id_col, names, config.n_folds, config.random_seed).persist()  # read by every fit and by the scans
    try:
        fits = [fit_transforms(base.where(F.col("fold") != k), spec, numeric_transform, config.rare_threshold) for k in folds]
        rows = base
        for k, fitted in enumerate(fits):
            rows = fitted.transform(rows).withColumnsRenamed({"cat": f"_cat{k}", "num": f"_num{k}"})
        rows = rows.withColumn("model_text", model_text(list(spec.text_cols)))
        rows = rows.select(F.col(id_col).alias("key"), F.col("fold").cast("int").alias("fold"), text.alias("text"), F.array(*(f"_cat{k}" for k in folds)).alias("codes"), F.array(*(f"_num{k}" for k in folds)).alias("numbers"), labels.alias("labels"))
        vector = rows.agg(F.max(F.size("text"))).first()[0] if embedding_col else text_features
        shapes = [network.Shape(max(1, vector or 1), embedding_col is None, tuple(f.categorical_vocab_sizes), len(f.numeric), config.mlp_hidden_size, config.n_hidden_layers, len(names)) for f in fits]
        fitted = network.train_all(rows, F.col("key"), shapes, config, all_figures=False)
        z = network.logits(fitted, F.col("fold"), F.col("text"), F.col("codes"), F.col("numbers"))
        scored = rows.select("fold", F.transform("labels", lambda y: y.cast("int")).alias("y"), F.transform(z, lambda x: (x > 0).cast("int")).alias("p"))
        made = metrics.multi_label_metrics(scored, "y", "p", names, ["fold"]).drop("i").collect()  # a row a fold and label
    finally:
        base.unpersist()
    at = [f.history[f.best - 1] if f.best else (0, None, None, None, None) for f in fitted]
    out = [(*r, at[r["fold"]][0], at[r["fold"]][2], at[r["fold"]][4]) for r in made]
    kinds = "fold int, tp long, fp long, tn long, fn long, accuracy double, precision double, recall double, specificity double, f1 double, label string, best_epoch int, best_validation_loss double, validation_accuracy double"
    return df.sparkSession.createDataFrame(out, kinds), max(folds, key=lambda k: (at[k][4] or 0.0, -k))


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of every metric over the folds."""
    names = ["accuracy", "precision", "recall", "specificity", "f1"]
    long = fold_metrics.select("label", "fold", *names).unpivot(["label", "fold"], names, "metric", "value")
    return long.groupBy("label", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
