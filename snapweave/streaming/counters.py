"""Counters of running uploads with a stop in mid-stream, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.batching import LEAST_SENT, STOP_PERCENT

COUNTERS = "label string, bytes long, objects long, stopped_at long, stopped_event long"
_STATE = "bytes long, objects long, stopped_at long, stopped_event long"


def first_stop(sent: np.ndarray, objects: np.ndarray, total: np.ndarray, budget: int) -> int | None:
    """The first sample at which an upload nears its budget, or is on course to (the row version of `batching.should_stop`)."""
    if budget <= 0:
        return None
    most = budget * STOP_PERCENT // 100
    near = sent >= most
    late = np.flatnonzero(~near & (sent >= LEAST_SENT) & (objects > 0) & (total > 0))
    near[[k for k in late.tolist() if int(sent[k]) * int(total[k]) // int(objects[k]) > most]] = True
    found = np.flatnonzero(near)
    return int(found[0]) if len(found) else None


class UploadCounters(StatefulProcessor):
    """For each upload its bytes and objects so far; once it is stopped, later samples count for nothing."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, objects, stopped, _ = self.counters.get() if self.counters.exists() else (0, 0, None, None)
        frames = list(rows)
        if stopped is not None or not frames:
            return
        batch = pd.concat(frames).sort_values(["at_us", "event_id"], kind="stable")
        total_sent, total_objects = sent + batch["bytes"].cumsum().to_numpy(), objects + batch["objects"].cumsum().to_numpy()
        stop = first_stop(total_sent, total_objects, batch["total"].to_numpy(), self.budget)
        last = len(batch) - 1 if stop is None else stop
        at, event = (None, None) if stop is None else (int(batch["at_us"].iloc[stop]), int(batch["event_id"].iloc[stop]))
        state = (int(total_sent[last]), int(total_objects[last]), at, event)
        self.counters.update(state)
        frame = pd.DataFrame({"label": [key[0]], "bytes": [state[0]], "objects": [state[1]]})
        for name, value in (("stopped_at", at), ("stopped_event", event)):
            frame[name] = pd.array([value], "Int64")
        yield frame

    def close(self) -> None:
        pass


def upload_counters(log: DataFrame, budget: int) -> DataFrame:
    """(label, bytes, objects, stopped_at, stopped_event) of a streaming log (label, at_us, event_id, bytes, objects, total); for update mode.

    A row for each label with samples in the micro-batch, unless it was stopped before; `stopped_at` and `stopped_event` name the
    sample at which the stop rule first held, or are null. A label's samples of one micro-batch are put in order of time, so the trigger
    bounds what a task holds; between micro-batches they count in the order in which these come. Needs the RocksDB state store.
    """
    keyed = log.select("label", "at_us", "event_id", "bytes", "objects", "total").groupBy("label")
    return keyed.transformWithStateInPandas(statefulProcessor=UploadCounters(budget), outputStructType=COUNTERS, outputMode="Update", timeMode="None")
