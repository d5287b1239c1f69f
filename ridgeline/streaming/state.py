"""Keyed stream state in event time: wind lock with hysteresis and the approval workflow.

A processor keeps a key's rows until the watermark has passed them, and then handles them in time order, all of a timer at once; so
files may arrive out of order as long as they are not later than the watermark, behind which rows are dropped.  The number of rows kept
per key is bounded by the source's rate and the watermark's delay.  After the last file, a closing row moves the watermark past the rest.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgeline import params as P

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LOCK_ROW, LOCK_STATE = "event_id bigint, ts timestamp, wind_max double", "locked boolean"
LOCK_OUTPUT = "key bigint, event_id bigint, ts timestamp, wind_locked boolean"
EVENT_ROW = "event_id bigint, ts timestamp, kind string, new_risk double"
EVENT_STATE = "pending bigint, pending_risk double, current double"
REPLY_OUTPUT = "path_id bigint, ts timestamp, event_id bigint, request_id bigint, outcome string, risk_reduction double"


class InTimeOrder(StatefulProcessor):
    """Buffers the rows of a key and hands those that the watermark has passed to `step`, in the order of (ts, event_id)."""

    row_schema, state_schema = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.held = handle.getValueState("held", self.state_schema)

    def step(self, key, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """Output of rows in order and the next state."""
        raise NotImplementedError

    def _wake(self, ts) -> None:
        self.handle.registerTimer(int(pd.Timestamp(ts).value // 1_000_000) + 1)  # the next whole millisecond

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["event_id"].notna()]  # the closing row moves the watermark only
            if len(frame):
                self.waiting.appendList([tuple(r) for r in frame[self._names()].itertuples(index=False)])
                self._wake(frame["ts"].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(list(self.waiting.get()), columns=self._names())
        passed = rows["ts"] <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        rest = rows[~passed]
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.itertuples(index=False)])
            self._wake(rest["ts"].min())
        else:
            self.waiting.clear()
        if passed.any():
            out, state = self.step(key, rows[passed].sort_values(["ts", "event_id"], kind="stable"), self.held.get() if self.held.exists() else None)
            self.held.update(state)
            yield out

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.row_schema.split(", ")]

    def close(self) -> None:
        pass


def lock_step(locked: bool, speed: float, limit: float = P.LOCK_WIND, band: float = P.LOCK_BAND) -> bool:
    """Next lock state: a locked path tolerates the band on top of the limit."""
    return speed <= (limit + band if locked else limit)


class Lock(InTimeOrder):
    row_schema, state_schema = LOCK_ROW, LOCK_STATE

    def step(self, key, rows, state):
        speed = rows["wind_max"].to_numpy(float)
        decided = np.select([speed <= P.LOCK_WIND, speed > P.LOCK_WIND + P.LOCK_BAND], [1.0, 0.0], np.nan)
        flags = pd.Series([float(state[0]) if state else 0.0, *decided]).ffill().to_numpy()[1:] > 0
        return pd.DataFrame({"key": key[0], "event_id": rows["event_id"].astype("int64"), "ts": rows["ts"], "wind_locked": flags}), (bool(flags[-1]),)


class Approvals(InTimeOrder):
    row_schema, state_schema = EVENT_ROW, EVENT_STATE

    def step(self, key, rows, state):
        pending, pending_risk, current = state or (None, None, 0.0)
        asked = (rows["kind"] == "request").to_numpy()
        ids, risks = rows["event_id"].to_numpy("int64"), rows["new_risk"].to_numpy(float)
        # the event before each row: the row above, for the first the state
        before = np.concatenate([[pending is not None], asked[:-1]])
        request = np.concatenate([[pending if pending is not None else 0], ids[:-1]])
        risk = np.concatenate([[pending_risk if pending is not None else np.nan], risks[:-1]])
        approved = ~asked & before & (rows["kind"] == "approve").to_numpy()
        known = pd.Series([current, *np.where(approved, risk, np.nan)]).ffill().to_numpy()
        out = pd.DataFrame({"path_id": key[0], "ts": rows["ts"], "event_id": ids,
                            "request_id": pd.array(np.where(before, request, 0), "Int64"),
                            "outcome": np.select([~before, approved], ["no pending request", "approved"], "rejected"),
                            "risk_reduction": np.where(approved, known[:-1] - risk, np.nan)})
        out["request_id"] = out["request_id"].mask(~before)
        out["risk_reduction"] = out["risk_reduction"].astype(object).where(approved, None).astype("Float64")
        last = (int(ids[-1]), float(risks[-1])) if asked[-1] else (None, None)
        return out[~asked], (*last, float(known[-1]))


def wind_lock(stream: DataFrame) -> DataFrame:
    """Lock state after each reading; needs key, event_id, ts (with a watermark), wind_max."""
    rows = stream.select(F.coalesce("key", F.lit(-1)).cast("bigint").alias("key"), "event_id", "ts", "wind_max")
    return rows.groupBy("key").transformWithStateInPandas(Lock(), LOCK_OUTPUT, "append", "eventTime")


def approvals(stream: DataFrame) -> DataFrame:
    """Responses paired with the pending request; needs path_id, ts (with a watermark), event_id, kind, new_risk."""
    rows = stream.select(F.coalesce("path_id", F.lit(-1)).cast("bigint").alias("path_id"), "ts", "event_id", "kind", "new_risk")
    return rows.groupBy("path_id").transformWithStateInPandas(Approvals(), REPLY_OUTPUT, "append", "eventTime")
