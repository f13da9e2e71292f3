"""Keyed state over a landing folder: acknowledgement, live updates, counted objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.identity import MARGIN_M, MAX_DISTANCE_M, EVENT_COLUMNS, ObjectCounter, advance

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ACKNOWLEDGED = _schema(recording=_L, n=_L, arrival=_L, state=_S, through=_L)
UPDATES = _schema(recording=_L, seq=_L, received=_L, corrections=_L, keyframe=_L, scale=_D, scale_source=_S)
COUNTED = _schema(recording=_L, category=_S, seq=_L, item=_L, outcome=_S, local_id=_L, nearest_m=_D)


class Acknowledge(StatefulProcessor):
    """Stored, resend or gap per message, in arrival order; nothing is taken after an end message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("through", _schema(through=_L, ended=T.BooleanType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        through, ended = self.state.get() if self.state.exists() else (-1, False)
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            if row.n <= through:
                state = "resend"
            elif row.n == through + 1 and not ended:
                state, through, ended = "stored", int(row.n), row.kind == "end"
            else:
                state = "gap"
            out.append((key[0], row.n, row.arrival, state, through))
        self.state.update((through, bool(ended)))
        yield pd.DataFrame(out, columns=ACKNOWLEDGED.names)

    def close(self) -> None:
        pass


def acknowledge(messages: DataFrame, lateness: str = "20 seconds") -> DataFrame:
    """messages(recording, n, kind, arrival, at): exact copies inside the watermark are dropped first."""
    fresh = messages.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["recording", "n", "arrival"])
    return fresh.groupBy("recording").transformWithStateInPandas(
        statefulProcessor=Acknowledge(), outputStructType=ACKNOWLEDGED, outputMode="append", timeMode="None"
    )


class LiveUpdate(StatefulProcessor):
    """One update per trigger from the newest frame; scale, keyframe and known anchors are kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", _schema(scale=_D, keyframe=_L, received=_L, corrections=_L))
        self.anchors = handle.getMapState("anchors", _schema(anchor=_L), _schema(seq=_L))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scale, keyframe, received, corrections = self.state.get() if self.state.exists() else (None, None, 0, 0)
        best = None
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            received += 1
            if not pd.isna(row.created):
                keyframe = int(row.created)
                self.anchors.updateValue((keyframe,), (int(row.seq),))
            if not pd.isna(row.updated) and self.anchors.containsKey((int(row.updated),)):
                self.anchors.updateValue((int(row.updated),), (int(row.seq),))
                corrections += 1
            if row.posed and keyframe is not None and (row.has_depth or best is None or not best[0]):
                best = (bool(row.has_depth), int(row.seq), keyframe, row.fitted)
        if best is not None:
            fitted = None if pd.isna(best[3]) else float(best[3])
            source = "fitted" if fitted is not None else "previous" if scale is not None else "none"
            scale = fitted if fitted is not None else scale
            yield pd.DataFrame([(key[0], best[1], received, corrections, best[2], scale, source)], columns=UPDATES.names)
            corrections = 0  # they count until an update is taken
        self.state.update((scale, keyframe, received, corrections))

    def close(self) -> None:
        pass


def live_updates(frames: DataFrame) -> DataFrame:
    """frames(recording, seq, created, updated, posed, has_depth, fitted) -> one row per recording and trigger."""
    return frames.groupBy("recording").transformWithStateInPandas(
        statefulProcessor=LiveUpdate(), outputStructType=UPDATES, outputMode="append", timeMode="None"
    )


class CountObjects(StatefulProcessor):
    """The batch counter of one class and recording, kept between triggers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", _schema(record=_S))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counter = ObjectCounter(MAX_DISTANCE_M, MARGIN_M)
        if self.state.exists():
            held = json.loads(self.state.get()[0])
            counter.born = held["born"]
            counter.anchors = {int(k): np.array(v) for k, v in held["anchors"].items()}
            counter.tracks = {int(k): (a, np.array(p)) for k, (a, p) in held["tracks"].items()}
        events = pd.concat(list(rows)).sort_values(["seq", "rank", "item"])
        out = []
        for _, frame in events.groupby("seq", sort=True):
            out += [(*key, *row) for row in advance(counter, list(zip(*[frame[c].tolist() for c in EVENT_COLUMNS])))]
        self.state.update((json.dumps({
            "born": counter.born, "anchors": {k: v.tolist() for k, v in counter.anchors.items()},
            "tracks": {k: (int(a), p.tolist()) for k, (a, p) in counter.tracks.items()},
        }),))
        yield pd.DataFrame(out, columns=COUNTED.names)

    def close(self) -> None:
        pass


def count_objects(events: DataFrame) -> DataFrame:
    """Decisions per detection from the event stream the batch form also reads; a frame must not straddle triggers."""
    # a grouping column named cls would clash with an argument of Spark's Row
    return events.withColumnRenamed("cls", "category").groupBy("recording", "category").transformWithStateInPandas(
        statefulProcessor=CountObjects(), outputStructType=COUNTED, outputMode="append", timeMode="None"
    ).withColumnRenamed("category", "cls")
