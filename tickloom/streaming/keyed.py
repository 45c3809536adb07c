"""Streams with state of their own: sent ticks and heartbeat liveness.

The state is Spark's keyed state store, versioned with the checkpoint: a batch that is run again starts
from the state of the batch before it, and a stream goes on after a restart where it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.messages import HEARTBEAT_LIMIT_SECONDS
from tickloom.session import ship_module

ship_module(__name__)

# --- sent ticks ---------------------------------------------------------------------------


def _first_of_instant(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the ticks of a symbol at one time only the first to arrive can be newer than those before it."""
    for part in parts:
        yield part.sort_values("tick_id", kind="stable").drop_duplicates(["symbol", "time"])


def _send(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    floor, price = state.get if state.exists else (None, None)
    ticks = pd.concat(list(parts)).sort_values("tick_id", kind="stable")
    at = ticks["time"].to_numpy().astype("datetime64[us]").astype(np.int64)
    before = np.maximum.accumulate(np.concatenate(([np.iinfo(np.int64).min if floor is None else floor], at)))[:-1]
    sent = ticks[at > before]
    if len(sent):
        last = sent["last"].to_numpy(float)
        change = np.diff(last, prepend=np.nan if price is None else price)
        yield sent.assign(direction=np.sign(np.where(np.isnan(change), 0, change)).astype(np.int32))
        state.update((int(at.max()), float(last[-1])))


def sent_ticks(ticks: DataFrame) -> DataFrame:
    """Strictly newer ticks, in order of arrival, with their direction against the last one sent.

    A tick without symbol, time or id cannot be sent. Each partition first drops what cannot be newer, so one row a second and
    symbol at most moves to the symbol's task, however many ticks the symbol has; its state is a time and a price.
    """
    placed = ticks.filter("symbol IS NOT NULL AND time IS NOT NULL AND tick_id IS NOT NULL")
    schema = T.StructType([*placed.schema.fields, T.StructField("direction", T.IntegerType())])
    return placed.mapInPandas(_first_of_instant, placed.schema).groupBy("symbol").applyInPandasWithState(
        _send, schema, "floor long, price double", "append", GroupStateTimeout.NoTimeout)


def send_ticks(ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object]) -> StreamingQuery:
    """``sent_ticks`` to the folder ``sent`` of ``path``, each tick once."""
    return (
        sent_ticks(ticks).writeStream.format("parquet").option("path", f"{path}/sent").option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


# --- liveness -------------------------------------------------------------------------------

_EVENTS = "kind string, msg_id long, time timestamp, gap_seconds double, since timestamp, until timestamp, beats long"
_LIVENESS = "last long, last_id long, since long, beats long, alarmed boolean, waiting array<long>, waiting_ids array<long>"


def _instant(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us, unit="us")


class _Connection:
    """What is known of one connection; ``settle`` takes its heartbeats in order of time."""

    def __init__(self, limit_us: int, saved: tuple | None) -> None:
        self.limit = limit_us
        self.last, self.last_id, self.since, self.beats, self.alarmed, times, ids = saved or (None, None, None, 0, False, [], [])
        self.waiting = sorted(zip(times or [], ids or []))
        self.events: list[tuple] = []

    def _close(self) -> None:
        if not self.alarmed:
            self.events.append(("alarm", self.last_id, _instant(self.last), None, None, None, None))
            self.events.append(("span", None, None, None, _instant(self.since), _instant(self.last), self.beats))
            self.alarmed = True

    def settle(self, now: int) -> None:
        """Everything up to ``now`` has been seen."""
        while self.waiting and self.waiting[0][0] <= now:
            at, ident = self.waiting.pop(0)
            if self.last is not None:
                if at - self.last > self.limit:
                    self._close()
                self.events.append(("gap", self.last_id, _instant(self.last), (at - self.last) / 1e6, None, None, None))
            if self.last is None or self.alarmed:
                self.since, self.beats, self.alarmed = at, 0, False
            self.last, self.last_id, self.beats = at, ident, self.beats + 1
        if self.last is not None and now - self.last > self.limit:
            self._close()

    def next_look(self, now: int) -> int | None:
        """The time at which something is due without a further heartbeat."""
        if self.waiting:
            return max(self.waiting[0][0], now + 1)
        return None if self.last is None or self.alarmed else self.last + self.limit + 1

    def saved(self) -> tuple:
        return (self.last, self.last_id, self.since, self.beats, self.alarmed, [w[0] for w in self.waiting], [w[1] for w in self.waiting])


def _follow(limit_us: int, keys: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        connection = _Connection(limit_us, state.get if state.exists else None)
        if not state.hasTimedOut:
            for part in parts:
                times = part["time"].to_numpy().astype("datetime64[us]").astype(np.int64)
                connection.waiting += zip(times.tolist(), part["msg_id"].tolist())
            connection.waiting.sort()
        now = state.getCurrentWatermarkMs() * 1000
        connection.settle(now)
        state.update(connection.saved())
        due = connection.next_look(now)
        if due is not None:
            state.setTimeoutTimestamp(-(-due // 1000) + 1)
        if connection.events:
            rows = pd.DataFrame(connection.events, columns=["kind", "msg_id", "time", "gap_seconds", "since", "until", "beats"])
            for i in range(keys):
                rows.insert(i, f"key{i}", key[i])
            for c in ("msg_id", "beats"):
                rows[c] = rows[c].astype("Int64")
            for c in ("time", "since", "until"):
                rows[c] = pd.to_datetime(rows[c])
            yield rows.astype({"gap_seconds": float})

    return run


def liveness(
    beats: DataFrame, keys: Sequence[str], delay: str, limit_seconds: int = HEARTBEAT_LIMIT_SECONDS
) -> DataFrame:
    """Events of each connection, as its heartbeats come in: ``kind`` is one of

    * ``gap``: a heartbeat with the seconds to the next one, once that is known;
    * ``alarm``: the last heartbeat before more than ``limit_seconds`` without one, once that time has passed, whether or not
      another heartbeat ever comes;
    * ``span``: an unbroken run of heartbeats (since, until, beats), at its alarm.

    ``keys`` names a connection. Heartbeats may come out of order within ``delay``: they wait in the state until the watermark has passed
    them. Time is that of the heartbeats, and a timer in event time raises the alarm, so results do not depend on how
    the stream is cut in batches. Heartbeats without time or id are left out.
    """
    fields = [f"`key{i}` {beats.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    placed = beats.filter("time IS NOT NULL AND msg_id IS NOT NULL").select(*keys, "time", "msg_id").withWatermark("time", delay)
    found = placed.groupBy(*keys).applyInPandasWithState(
        _follow(limit_seconds * 1_000_000, len(keys)), ", ".join([*fields, _EVENTS]), _LIVENESS, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})
