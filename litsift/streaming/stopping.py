"""The stopping state of reviews over a stream of labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "review string, total_screened long, total_relevant long, consecutive_irrelevant long"
STATE = "total_screened long, total_relevant long, consecutive_irrelevant long"


def running_state(labels: DataFrame) -> DataFrame:
    """From a stream (review, seq, label): each review's state after every batch; a batch's labels count in order of seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        screened, relevant, row = state.get if state.exists else (0, 0, 0)
        for label in pd.concat(list(batches)).sort_values("seq")["label"]:
            screened, relevant, row = screened + 1, relevant + (label == 1), 0 if label == 1 else row + 1
        state.update((int(screened), int(relevant), int(row)))
        yield pd.DataFrame({"review": [key[0]], "total_screened": [screened], "total_relevant": [relevant], "consecutive_irrelevant": [row]})

    return labels.groupBy("review").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
