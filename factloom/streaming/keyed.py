"""Stream forms of the keyed operators of `debounce`, with state and timers for each key.

Events of a key count in the order of their times within a micro-batch, and micro-batches in the
order in which they come. After a flush a stream has given what the finite form gives for the same
events; a query that stops goes on from its checkpoint with the state that it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State and timers of these operators need the store that keeps them on disk; set it before the query starts."""
    spark.conf.set(STORE, ROCKS)


class Keyed(StatefulProcessor):
    """A key's events, sorted by time, one after the other; `step` gives the rows that an event brings.

    fields: columns of the rows after the key.
    """

    state = "at long"

    def __init__(self, key: str, at: str, fields: list[str], *ties: str):
        self.key, self.at, self.fields, self.ties = key, at, fields, ties

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values([self.at, *self.ties], kind="stable")
        out = [row for event in events.to_dict("records") for row in self.step(event)]
        self.after(timerValues)
        yield self.rows(key, out)

    def rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=[self.key, *self.fields])

    def step(self, event: dict) -> list[tuple]:
        raise NotImplementedError

    def after(self, timerValues) -> None:
        """What follows a micro-batch's events."""

    def close(self) -> None:
        pass


class _Throttle(Keyed):
    """The first report, those a gap after the last that passed, and, when none comes for a while, the last one."""

    state = "passed long, last long"

    def __init__(self, key: str, at: str, gap: int, idle: int):
        super().__init__(key, at, [at])
        self.gap, self.idle = gap, idle

    def step(self, event):
        passed, _ = self.held.get() if self.held.exists() else (None, None)
        now = int(event[self.at])
        passes = passed is None or now - passed >= self.gap
        self.held.update((now if passes else passed, now))
        return [(now,)] if passes else []

    def after(self, timerValues):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, last = self.held.get()
        yield self.rows(key, [(last,)] if last != passed else [])


class _Retried(Keyed):
    def __init__(self, key: str, at: str, cooldown: int):
        super().__init__(key, at, [at])
        self.cooldown = cooldown

    def step(self, event):
        now = int(event[self.at])
        if self.held.exists() and now - self.held.get()[0] < self.cooldown:
            return []
        self.held.update((now,))
        return [(now,)]


class _SingleFlight(Keyed):
    state = "failed boolean"

    def __init__(self, key: str, at: str, failed: str):
        super().__init__(key, at, [at, failed])
        self.failed = failed

    def step(self, event):
        starts = not self.held.exists() or self.held.get()[0]
        self.held.update((bool(event[self.failed]),))
        return [(int(event[self.at]), bool(event[self.failed]))] if starts else []


class _Balanced(Keyed):
    state = "open boolean"

    def __init__(self, key: str, at: str, phase: str):
        super().__init__(key, at, [at, phase])
        self.phase = phase

    def step(self, event):
        phase = event[self.phase]
        is_open = phase == "begin" or self.held.exists() and self.held.get()[0]
        self.held.update((is_open and phase not in ("end", "lost"),))
        return [(int(event[self.at]), phase)] if is_open else []


class _Pending(Keyed):
    """Requests wait in a list until their connection's next drain; a failed one drops them."""

    def __init__(self, connection: str, key: str, at: str, failed: str):
        super().__init__(connection, at, ["drained_at", key, "first_at"], "is_drain")
        self.asked, self.failed = key, failed

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "asked string, at long")

    def step(self, event):
        if not event["is_drain"]:
            self.waiting.appendValue((event[self.asked], int(event[self.at])))
            return []
        first: dict[str, int] = {}
        for asked, at in self.waiting.get() if self.waiting.exists() else ():
            first[asked] = min(at, first.get(asked, at))
        self.waiting.clear()
        return [] if event[self.failed] else [(int(event[self.at]), asked, at) for asked, at in first.items()]


class _Buffers(Keyed):
    """What a file shows after each event: its typed text while it is open."""

    state = "is_open boolean, typed string, gone boolean"

    def __init__(self):
        super().__init__("path", "ts", ["ts", "seq", "is_open", "typed", "gone"], "seq")

    def step(self, event):
        is_open, typed, gone = self.held.get() if self.held.exists() else (False, None, False)
        kind, content = event["kind"], event["content"]
        if kind in ("close", "delete"):
            is_open, typed, gone = False, None, kind == "delete"
        elif kind == "open" or is_open:
            is_open, typed = True, typed if content is None else content
        self.held.update((is_open, typed, gone))
        return [(int(event["ts"]), int(event["seq"]), is_open, typed, gone)]


def _run(events: DataFrame, key: str, processor: Keyed, fields: str, timers: str = "None") -> DataFrame:
    kind = dict(events.dtypes)[key]
    return events.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {fields}", "Append", timers)


def throttled(events: DataFrame, key: str, at: str, gap: int, idle: int = 1000) -> DataFrame:
    """`debounce.throttled` of a stream: a key's last report passes when none has come for `idle` milliseconds."""
    return _run(events.filter(F.col(at).isNotNull()), key, _Throttle(key, at, gap, idle), f"`{at}` long", "ProcessingTime")


def retried(attempts: DataFrame, key: str, at: str, cooldown: int) -> DataFrame:
    """`debounce.retried` of a stream."""
    return _run(attempts.filter(F.col(at).isNotNull()), key, _Retried(key, at, cooldown), f"`{at}` long")


def single_flight(requests: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """`debounce.single_flight` of a stream."""
    return _run(requests, key, _SingleFlight(key, at, failed), f"`{at}` long, `{failed}` boolean")


def balanced(reports: DataFrame, token: str, at: str, phase: str) -> DataFrame:
    """`debounce.balanced` of a stream."""
    return _run(reports, token, _Balanced(token, at, phase), f"`{at}` long, `{phase}` string")


def pending(requests: DataFrame, drains: DataFrame, connection: str, key: str, at: str, failed: str) -> DataFrame:
    """`debounce.pending` of two streams, of requests and of drains."""
    asked = requests.select(connection, F.col(key).cast("string").alias(key), F.col(at).cast("long").alias(at), F.lit(False).alias("is_drain"), F.lit(False).alias(failed))
    done = drains.select(connection, F.lit(None).cast("string").alias(key), F.col(at).cast("long").alias(at), F.lit(True).alias("is_drain"), failed)
    return _run(asked.union(done), connection, _Pending(connection, key, at, failed), f"drained_at long, `{key}` string, first_at long")


def buffers(events: DataFrame) -> DataFrame:
    """What `refresh.with_buffers` knows of each path after each event of a stream: is_open, typed (null: nothing yet), gone."""
    return _run(events, "path", _Buffers(), "ts long, seq long, is_open boolean, typed string, gone boolean")


def shown(stored: DataFrame, states: DataFrame) -> DataFrame:
    """path, content, is_open: stored texts (path, content) under the last states that `buffers` gave."""
    last = states.groupBy("path").agg(F.max(F.struct("ts", "seq", "is_open", "typed", "gone")).alias("s")).select("path", "s.*")
    both = stored.select("path", F.col("content").alias("_stored"), F.lit(True).alias("_there")).join(last, "path", "full")
    kept = F.coalesce("_there", F.lit(False)) & ~F.coalesce("gone", F.lit(False))
    is_open = F.coalesce("is_open", F.lit(False))
    return both.filter(is_open | kept).select("path", F.coalesce("typed", F.when(kept, F.col("_stored"))).alias("content"), is_open.alias("is_open"))
