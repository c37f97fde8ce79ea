import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from litsift.operators import audit
from litsift.sources import tables
from litsift.streaming import audit as stream


def events_made(n=40, seed=1):
    """Decisions (several for some records) and labels, in an order of their own."""
    rng = random.Random(seed)
    decisions = [(str(rng.randrange(n)), "decision", i, rng.randint(0, 1), rng.random(), None, f"t{i}", None, "screening", None) for i in range(60)]
    known = sorted({d[0] for d in decisions})
    labels = [(rng.choice(known), "label", i, None, None, rng.choice([0, 1, None]), f"l{i}", rng.choice(["r1", None]), None, rng.choice(["n", None])) for i in range(50)]
    both = decisions + labels
    rng.shuffle(both)
    return both


def batch_log(spark, events):
    df = spark.createDataFrame(events, stream.EVENTS).distinct()
    log = df.where("kind = 'decision'").select("record_id", "model_prediction", "model_probability", F.lit(None).cast("int").alias("human_label"), "timestamp", "reviewer_id", "phase", F.lit("").alias("notes"), "seq")
    out = audit.update_labels(log, df.where("kind = 'label'").withColumnRenamed("seq", "at"), "seq", "at")
    return {tuple(r) for r in out.select("record_id", "seq", "model_prediction", "model_probability", "human_label", "reviewer_id", "phase", "notes").collect()}


def test_stream_gives_the_batch_log_over_restarts_and_replays(spark, tmp_path):
    events = events_made()
    source, sink, memory = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    parts = [events[:30], events[30:75], events[60:]]  # some come twice
    for part in parts:
        spark.createDataFrame(part, stream.EVENTS).coalesce(1).write.mode("append").parquet(source)
        query = stream.running_log(spark.readStream.schema(stream.EVENTS).parquet(source)).writeStream.format("parquet").option("checkpointLocation", memory).outputMode("append").trigger(availableNow=True).start(sink)
        query.awaitTermination(120)
    got = stream.latest(spark.read.parquet(sink))
    names = ("record_id", "seq", "model_prediction", "model_probability", "human_label", "reviewer_id", "phase", "notes")
    assert {tuple(r) for r in got.select(*names).collect()} == batch_log(spark, events)
    changed = got.where("human_label is not null").select("timestamp").collect()
    assert changed and all(r["timestamp"].startswith("l") for r in changed)


def test_sheets_with_dates_and_booleans(spark, tmp_path):
    rows = [(True, datetime(2024, 2, 29, 13, 30), date(1999, 12, 31), 1.5, "a"), (False, datetime(1900, 3, 1), None, 2.0, "2"), (None, None, date(2020, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "b boolean, t timestamp_ntz, d date, x double, s string")
    tables.write_xlsx(df, str(tmp_path / "a.xlsx"))
    back = tables.load_data(spark, str(tmp_path / "a.xlsx"))
    assert dict(back.dtypes) == {"b": "boolean", "t": "timestamp_ntz", "d": "timestamp_ntz", "x": "double", "s": "string"}
    assert [tuple(r) for r in back.collect()] == [(b, t, d and datetime(d.year, d.month, d.day), x, s) for b, t, d, x, s in rows]
    assert tables.date_of(1.0, False) == datetime(1900, 1, 1) and tables.date_of(59.0, False) == datetime(1900, 2, 28) and tables.date_of(61.0, False) == datetime(1900, 3, 1) and tables.date_of(0.0, True) == datetime(1904, 1, 1)
    styles = f'<styleSheet xmlns="{tables.NS[1:-1]}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    assert tables.date_styles(styles.encode()) == {1, 3}


def test_plain_csv_splits_and_large_logs_stay_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x, {i}"\n' for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        one, many = (tables.load_data(spark, str(tmp_path / "a.csv"), "a long, b string", multi_line=m) for m in (True, False))
        assert one.rdd.getNumPartitions() == 1 < many.rdd.getNumPartitions() and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    log = audit.log_decision(spark, 1, 1, 0.5).union(audit.log_decision(spark, 2, 1, 0.5))
    with pytest.raises(ValueError):
        audit.to_dict(log, most=1)
