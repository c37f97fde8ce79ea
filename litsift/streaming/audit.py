"""The audit log over a stream of decisions and reviewers' labels, with the rules of the batch log.

A record's last label, by its sequence number, stands on the record's first decision. The state of a record is its first
decision and its last label, so events may come in any order and more than once; a label waits for its record's decision.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENTRY = ("model_prediction", "model_probability", "timestamp", "phase")
LABEL = ("human_label", "timestamp", "reviewer_id", "notes")
EVENTS = "record_id string, kind string, seq long, model_prediction int, model_probability double, human_label int, timestamp string, reviewer_id string, phase string, notes string"
OUT = "record_id string, seq long, model_prediction int, model_probability double, human_label int, timestamp string, reviewer_id string, phase string, notes string, version long"
STATE = "first_seq long, model_prediction int, model_probability double, entry_time string, phase string, label_seq long, human_label int, label_time string, reviewer_id string, notes string, version long"


def plain(row: tuple, column: str) -> object:
    """A value as Python's own; missing as None, and integers whole, though pandas holds them as floats beside missing ones."""
    v = getattr(row, column)
    if pd.isna(v):
        return None
    return int(v) if column in ("model_prediction", "human_label") else v.item() if hasattr(v, "item") else v


def running_log(events: DataFrame) -> DataFrame:
    """From a stream of EVENTS (kind 'decision' or 'label', seq counting within its kind): each entry of the log as it is made or changes.

    Rows carry a version; the log at any time is latest() of all rows so far.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        first_seq, *held = state.get if state.exists else (None,) * 11
        entry, (label_seq, *label), version = held[:4], held[4:9], held[9] or 0
        out: dict[int, list] = {}
        was, changed = first_seq, False
        for r in rows[rows["kind"] == "decision"].itertuples():
            own = [plain(r, c) for c in ENTRY]
            out.setdefault(int(r.seq), own)
            if first_seq is None or r.seq < first_seq:
                if first_seq is not None:
                    out.setdefault(first_seq, entry)
                first_seq, entry = int(r.seq), own
        for r in rows[rows["kind"] == "label"].itertuples():
            if label_seq is None or r.seq > label_seq:
                label_seq, label, changed = int(r.seq), [plain(r, c) for c in LABEL], True
        if first_seq is not None and (changed or was != first_seq):
            out.setdefault(first_seq, entry)
        version += 1
        state.update((first_seq, *entry, label_seq, *label, version))
        made = []
        for seq, (p, q, at, phase) in out.items():
            human, when, reviewer, notes = label if seq == first_seq and label_seq is not None else (None, at, None, "")
            made.append((key[0], seq, p, q, human, when, reviewer, phase, notes or "", version))
        frame = pd.DataFrame(made, columns=[c.split()[0] for c in OUT.split(", ")])
        yield frame.astype({"model_prediction": "Int32", "human_label": "Int32"})

    return events.groupBy("record_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """The log: of each entry its last version."""
    names = [c for c in rows.columns if c not in ("record_id", "seq", "version")]
    last = rows.groupBy("record_id", "seq").agg(F.max_by(F.struct(*names), "version").alias("e"))
    return last.select("record_id", "seq", "e.*")
