import random
import re

import pytest
from pyspark.sql import functions as F

from litsift.config import Config, default_config, domain_configs, fast_config, robust_config
from litsift.functions import scalars
from litsift.functions import text as T
from litsift.operators import active, audit, features, metrics, model, order, sampling, screening, stopping
from litsift.sources import tables
from litsift.streaming.stopping import running_state

TEXTS = ["We study math. Mathematical models help! Is math fun? Yes math.", "Étude élève ÉLÈVE.", "", "   ", None, "math math math", "no match here"]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")


def test_config():
    assert default_config.random_seed == 42 and default_config.model_name == "bert-base-uncased"
    assert fast_config.epochs == 5 and fast_config.batch_size == 32 and robust_config.dropout_rate == 0.3
    assert domain_configs["science"].embedding_model == "scibert"
    assert Config(embedding_model="other").model_name == "bert-base-uncased"
    with pytest.raises(TypeError):
        Config(unknown=1)


def test_counts_match_python(spark):
    for p in (r"\bmath\w*\b", r"\bélève\b", r"x*", r"(?P<a>m)ath"):
        got = [r[0] for r in texts(spark).orderBy("id").select(T.count_matches("t", p)).collect()]
        assert got == [len(re.findall(p, t, re.I)) if t and t.strip() else 0 for t in TEXTS]
    assert texts(spark).select(T.count_matches("t", "(")).distinct().collect()[0][0] == 0


def test_sentence_and_window_evidence(spark):
    rows = texts(spark).orderBy("id").select(T.sentence_evidence("t", r"\bmath\b", "t").alias("s"), T.window_evidence("t", "math", "t", 0).alias("w"), T.window_evidence("t", r"\bmath\b", "t", 1).alias("o")).collect()
    assert [e["text"] for e in rows[0]["s"]] == ["We study math", "Is math fun", "Yes math."]
    assert rows[4]["s"] == [] and rows[4]["w"] == [] and rows[2]["o"] == []
    assert [e["text"] for e in rows[5]["w"]] == ["math", "math math", "math math math"]  # 0 keeps all words before
    assert [e["text"] for e in rows[0]["o"]][0] == "study math ."


def test_snippets(spark):
    rows = texts(spark).orderBy("id").select(T.snippets("t", "math", 60).alias("s")).collect()
    assert rows[0]["s"].startswith("...We study math.") and len(rows[0]["s"]) <= 60 and rows[4]["s"] == ""


def test_texts_joined(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(T.combined_text(["x", "y", "z"])).first()[0] == "a  c"
    assert df.select(T.model_text(["x", "y"], "[SEP]")).first()[0] == "a [SEP] nan"


def test_regex_screen(spark):
    df = spark.createDataFrame([(1, "Math here. Algebra there.", "k"), (2, None, None)], "id long, abstract string, title string")
    out = screening.regex_screen(df, {"m": {"pattern": "math", "description": "math"}, "g": {"pattern": "algebra", "description": "algebra"}}).orderBy("id").collect()
    assert (out[0]["m"], out[0]["meets_all_criteria"], out[1]["m"], out[1]["meets_all_criteria"]) == (1, 1, 0, 0)
    assert out[0]["m_evidence"] == "abstract: Math here" and out[1]["m_semantic_scores"] == [] and out[1]["m_semantic_max"] == 0.0
    assert screening.regex_screen(df, {}).where("meets_all_criteria = 1").count() == 2
    assert screening.regex_screen(df, {"m": {"pattern": "math"}}, encoder=None).first()["m_semantic_scores"] is None


def test_split_is_exact_and_disjoint(spark):
    for n in (0, 1, 50, 100, 101):
        df = spark.range(n).withColumnRenamed("id", "i")
        parts = [{r["i"] for r in p.collect()} for p in sampling.split_data(df, "i")]
        assert [len(p) for p in parts] == [int(n * 8 / 10), int(n * 9 / 10) - int(n * 8 / 10), n - int(n * 9 / 10)]
        assert set.union(*parts) == set(range(n))


def test_folds_are_stratified(spark):
    df = spark.range(58).selectExpr("id", "cast(id < 17 as int) y")
    folds = sampling.with_folds(df, "id", ["y"], 5).groupBy("fold", "y").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_strata_and_sample(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 10 as int) score")
    strata = sampling.with_strata(df, "score")
    assert {r["strata"] for r in strata.select("strata").distinct().collect()} == set(sampling.STRATA)
    assert sampling.with_strata(df.withColumn("score", F.lit(3)), "score").select("strata").distinct().first()[0] == "uniform"
    sizes = {n: sampling.sample_strata(spark.range(n).selectExpr("id", "'a' s"), "id", "s", 0.5).count() for n in (1, 3, 5, 7)}
    assert sizes == {1: 0, 3: 2, 5: 2, 7: 4}  # half to even


def test_features(spark):
    df = spark.createDataFrame([(c,) for c in "A" * 10 + "B" * 8 + "C" * 2] + [(None,)], "c string")
    f = features.fit_transforms(df, features.ColumnSpec(categorical_cols=("c",)))
    assert f.vocabularies["c"] == {"<UNK>": 0, "<RARE>": 1, "A": 2, "B": 3}
    got = {r["c"]: r["k"] for r in df.select("c", features.encode("c", f.vocabularies["c"]).alias("k")).distinct().collect()}
    assert got == {"A": 2, "B": 3, "C": 1, None: 0}
    nums = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "x double")
    for kind, want in (("min", [0, 1, 1, 3]), ("max", [0.25, 0.5, 0.5, 1]), ("robust", None), ("quantile", None), ("log1p", None), ("mean", None)):
        p = features.fit_numeric(nums, {"x": kind})["x"]
        values = [r[0] for r in nums.select(features.apply_numeric("x", p)).collect()]
        assert len(values) == 4 and values[1] == values[2] and (want is None or values == pytest.approx(want))
    with pytest.raises(ValueError):
        features.fit_numeric(nums, {"x": "other"})
    assert features.FittedTransforms.from_dict(f.to_dict()) == f


def test_active_learning(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.8), (2, 0.5), (3, 0.3)], "id long, p double")
    assert [r["id"] for r in active.select_query_batch(df, "p", "id", batch_size=2).collect()] == [2, 3]
    assert [r["id"] for r in active.select_query_batch(df, "p", "id", "max_relevance", 2).collect()] == [1, 2]
    with pytest.raises(KeyError):
        active.select_query_batch(df, "p", "id", "other")
    batch = active.create_review_batch(df, df.where("id in (1, 2)").select("id"), "p", "id")
    assert {r["id"]: r["model_prediction"] for r in batch.collect()} == {1: 1, 2: 1}
    labels = spark.createDataFrame([(1, None), (2, 1)], "id long, human_label int")
    old = df.withColumn("human_label", F.lit(7))
    assert {r["id"]: r["human_label"] for r in active.merge_human_labels(old, labels, "id").collect()} == {0: 7, 1: None, 2: 1, 3: 7}
    with pytest.raises(ValueError):
        active.merge_human_labels(df, labels.union(labels), "id")


def test_metrics_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), round(rng.random(), 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc)
    assert metrics.roc_auc(df.where("y = 1"), "y", "p").first()[0] is None
    r = metrics.agreement(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "a int, b int"), "a", "b").first()
    assert (r["agreed"], r["total"]) == (4, 5) and r["kappa"] == pytest.approx((0.8 - 0.48) / 0.52)
    assert metrics.binary_metrics(df.where("false"), "y", "y").count() == 1


def test_audit(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.4), (2, 0, 0.4)], "id long, pred int, p double")
    log = audit.log_batch(df, "id", "pred", "p").withColumn("seq", F.monotonically_increasing_id())
    events = spark.createDataFrame([("2", 1, "r", "n", 1), ("2", 0, "r", "n", 2), ("1", 0, None, "", 3)], "record_id string, human_label int, reviewer_id string, notes string, at int")
    out = audit.update_labels(log, events, "seq", "at")
    assert out.where("record_id = '2' and human_label = 0").count() == 1 and out.where("record_id = '2' and human_label is null").count() == 1
    s = audit.decision_summary(out).first()
    assert (s["total"], s["human_reviewed"], s["human_overrides"], s["uncertain"]) == (3, 2, 1, 2)
    assert audit.disagreements(out).count() == 1
    assert {r["section"] for r in audit.prisma_report(out, default_config).collect()} == set(audit.PRISMA_ITEMS)
    with pytest.raises(KeyError):
        audit.update_labels(log, events.withColumn("record_id", F.lit("9")), "seq", "at")


def test_small_figures_of_the_report_are_written_as_sql_does(spark):
    pairs = [(1, 1)] * 1001 + [(1, 0), (0, 1), (0, 0)] * 1000
    log = spark.createDataFrame(pairs, "model_prediction int, human_label int").withColumn("model_probability", F.lit(0.5))
    found = {(r["section"], r["key"]): r["value"] for r in audit.prisma_report(log).collect()}
    assert found["R2", "kappa"] == found["M8", "agreement_kappa"] == "0.00025" and found["R2", "agreement_rate"] == "0.500125"
    values = {0.0: "0.0", 1.0: "1.0", -0.25: "-0.25", 12.3456785: "12.345679", 0.00069349: "0.000693", 1e-4: "0.0001", 5.2e-5: "5.2e-05", -1e-5: "-1e-05", 9.96e-5: "0.0001", 5e-7: "1e-06", -1e-8: "-0.0", None: None}
    df = spark.createDataFrame([(k,) for k in values], "x double")
    assert [r[0] for r in df.select(scalars.figure_text(F.col("x"))).collect()] == list(values.values())


def test_kappa_bands(spark):
    df = spark.createDataFrame([(k,) for k in (-0.1, 0.2, 0.4, 0.6, 0.8, 0.81)], "k double")
    assert [r[0] for r in df.select(scalars.kappa_band(F.col("k"))).collect()] == ["poor", "slight", "fair", "moderate", "substantial", "almost perfect"]


def test_stopping(spark):
    labels = [0, 1, 0, 0, 1, 0, None]
    df = spark.createDataFrame([("r", i, y) for i, y in enumerate(labels)], "review string, seq int, y int")
    got = stopping.stopping_history(df, "y", ["seq"], ["review"]).orderBy("seq").collect()
    state = stopping.StoppingState()
    for r, y in zip(got, labels, strict=True):
        state = stopping.update(state, y)
        assert (r["total_screened"], r["total_relevant"], r["consecutive_irrelevant"]) == (state.total_screened, state.total_relevant, state.consecutive_irrelevant)
    one = spark.range(1)
    assert one.select(scalars.work_saved(F.lit(100), F.lit(60), F.lit(0.95))).first()[0] == pytest.approx(0.35)
    assert one.select(scalars.probit(F.lit(0.975))).first()[0] == pytest.approx(1.959964, abs=1e-5)


def test_streaming_state(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, 0), ("r", 2, 1), ("r", 3, 0)], "review string, seq int, label int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_state(stream).writeStream.format("memory").queryName("states").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("states").collect()[-1]
    assert (r["total_screened"], r["total_relevant"], r["consecutive_irrelevant"]) == (3, 1, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x, ""y""\nz"\n2,NA\n')
    assert [tuple(r) for r in tables.load_data(spark, str(tmp_path / "a.csv")).orderBy("a").collect()] == [(1, 'x, "y"\nz'), (2, None)]
    df = spark.createDataFrame([(1, "x<&>", 0.5, [1.0]), (2, None, None, [])], "a long, b string, c double, d array<double>")
    tables.write_xlsx(df, str(tmp_path / "a.xlsx"), yellow={"b": "a"}, freeze="D2")
    (tmp_path / "n.csv").write_text("y,z,w\n2001,NA,x\nNA,1.5,NA\n2003,,2\n")
    typed = tables.load_data(spark, str(tmp_path / "n.csv"))
    assert dict(typed.dtypes) == {"y": "bigint", "z": "double", "w": "string"} and {tuple(r) for r in typed.collect()} == {(2001, None, "x"), (None, 1.5, None), (2003, None, "2")}
    back = tables.load_data(spark, str(tmp_path / "a.xlsx")).orderBy("a").collect()
    assert back[0]["b"] == "x<&>" and back[0]["a"] == 1 and back[1]["c"] is None


def test_model_learns(spark, tmp_path):
    rows = [(i, "good math paper" if i % 2 else "cooking recipe book", "en", float(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, lang string, x double, y int")
    spec = features.ColumnSpec(("t",), ("lang",), ("x",), "y")
    ready, fitted = features.preprocess(df, spec, {"x": "mean"})
    fitted_model = model.fit(ready, 1, default_config, 64)
    out = fitted_model.predict(ready, temperature=model.calibrate(fitted_model, ready))
    assert out.where("predictions[0] = y").count() == 60
    fitted_model.save(str(tmp_path / "model"))
    again = model.ScreeningModel.load(str(tmp_path / "model")).predict(ready)
    assert again.where("predictions[0] = y").count() == 60


def test_first_sheet_is_that_of_the_first_tab(spark, tmp_path):
    import zipfile

    for n, v in ((1, "late"), (2, "first")):
        tables.write_xlsx(spark.createDataFrame([(v, "'=q", 1.5)], "a string, b string, c double"), str(tmp_path / f"{n}.xlsx"))
    with zipfile.ZipFile(tmp_path / "1.xlsx") as one, zipfile.ZipFile(tmp_path / "2.xlsx") as two, zipfile.ZipFile(tmp_path / "both.xlsx", "w") as out:
        for name in one.namelist():
            body = one.read(name).decode()
            if name == "xl/workbook.xml":
                body = body.replace("<sheets>", '<sheets><sheet name="Z" sheetId="9" r:id="rId9"/>')
            if name == "xl/_rels/workbook.xml.rels":
                kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
                body = body.replace("</Relationships>", f'<Relationship Id="rId9" Type="{kind}" Target="worksheets/sheet10.xml"/></Relationships>')
            out.writestr(name, body)
        out.writestr("xl/worksheets/sheet10.xml", two.read("xl/worksheets/sheet1.xml"))
    r = tables.load_data(spark, str(tmp_path / "both.xlsx")).first()
    assert (r["a"], r["b"], r["c"]) == ("first", "'=q", 1.5)


def test_screen_file_and_snapshots(spark, tmp_path):
    (tmp_path / "in.csv").write_text("title,abstract\nA,math here\nB,none\n")
    out = tables.screen_file(spark, str(tmp_path / "in.csv"), {"m": {"pattern": "math", "description": "math"}})
    back = tables.load_data(spark, str(tmp_path / "screened.xlsx"))
    assert back.columns == out.columns and {(r["title"], r["m"]) for r in back.collect()} == {("A", 1), ("B", 0)}
    log = audit.log_decision(spark, 7, 1, 0.9).unionByName(audit.log_decision(spark, 8, 0, 0.2, "test", "r"))
    again = audit.from_dict(spark, audit.to_dict(log))
    assert again.schema == audit.from_dict(spark, {"entries": []}).schema and sorted(r["record_id"] for r in again.collect()) == ["7", "8"]
    assert model.calibration_from_dict(model.calibration_to_dict([2.0])) == [2.0] and model.calibration_to_dict([1.0, 2.0]) == {"temperature": [1.0, 2.0]}
    assert stopping.update(stopping.StoppingState(), 1).history == ({"screened": 1, "relevant": 1, "consecutive_irrelevant": 0},)


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(3)
    values = [rng.choice([0.0, 0.0, rng.gauss(0, 1), float(rng.randint(0, 3))]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    grid = [i / 200 for i in range(201)]
    assert order.exact_quantiles(df, F.col("x"), grid) == pytest.approx(list(np.quantile(values, grid)))
    assert order.exact_quantiles(df.where("x is null"), F.col("x"), grid) == [] and order.exact_quantiles(df.where("x = 3"), F.col("x"), [0.5]) == [3.0]


def test_window_evidence_equals_plain_form(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ab \t\n", k=60))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string")
    for w in (0, 1, 3):
        got = {r["id"]: [e["text"] for e in r["e"]] for r in df.select("id", T.window_evidence("t", "ab?", "t", w).alias("e")).collect()}
        for i, t in rows:
            plain = [" ".join([*t[: m.start()].split()[-w:], m[0], *t[m.end() :].split()[:w]]) for m in re.finditer("ab?", t)]
            assert got[i] == list(dict.fromkeys(plain))


def test_training_stops_early_and_keeps_the_best(spark):
    rows = [(i, "good" if i % 2 else "bad", "en" if i % 2 else ["de", "fr"][i % 4 // 2], float(i), i % 2, [float(i % 2), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, lang string, x double, y int, e array<double>")
    spec = features.ColumnSpec(("t",), ("lang",), ("x",), "y")
    ready, fitted = features.preprocess(df, spec, {"x": "mean"}, max_length=3)
    noise, _ = features.preprocess(df.withColumn("y", (F.col("id") % 3 == 0).cast("int")), spec, fitted=fitted)
    config = Config(epochs=6, early_stopping_patience=2, mlp_hidden_size=8, learning_rate=0.05)
    for kind, column in (("logistic", None), ("mlp", "e")):
        made, history = model.train(ready, noise, 1, config, 32, column, kind)
        h = [r for r in history.orderBy("epoch").collect()]
        best = [r["epoch"] for r in h if r["best"]]
        assert best == [min(h, key=lambda r: (r["validation_loss"], r["epoch"]))["epoch"]] and len(h) <= best[0] + 2
        learnt, _ = model.train(ready, ready, 1, config, 32, column, kind)
        assert learnt.predict(ready).where("predictions[0] = y").count() == 60 and made.predict(ready).count() == 60
    assert features.embedding_width(9) == 5
