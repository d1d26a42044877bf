"""Debounce and throttle, over finite tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trailing(events: DataFrame, key: str, at: str, gap: int, order: str) -> DataFrame:
    """key, fired_at, n: a burst ends where the next event is `gap` or more away; it fires gap after its last event.

    at: a long; events of a burst coalesce.
    """
    w = Window.partitionBy(key).orderBy(at, order)
    begins = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    bursts = events.withColumn("_burst", F.sum(begins.cast("int")).over(w))
    return bursts.groupBy(key, "_burst").agg((F.max(at) + gap).alias("fired_at"), F.count(F.lit(1)).alias("n")).select(key, "fired_at", "n")


def leading(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """key, fired_at, n: the first event opens a window of `gap`; events in it coalesce; the next one opens another.

    at: a long; events without a time are none. A null key is a key. Which events open windows
    depends on all before, so a key's distinct times, counted beforehand, come sorted and are
    searched window by window; a window stays open from one Arrow batch to the next, and
    nothing of a key is gathered.
    """
    counted = events.filter(F.col(at).isNotNull()).groupBy(key, at).agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.select(key, F.col(at).cast("long").alias(at), "n").repartition(key).sortWithinPartitions(key, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Array | None = None  # the key of the open window, as an array of one
        opened = n = 0

        def rows(keys: list[pa.Array], fired: list[int], counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(fired, pa.int64()), pa.array(counts, pa.int64())], [key, "fired_at", "n"])

        for batch in batches:
            keys, times, amounts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(keys):
                continue
            sums = np.concatenate([[0], np.cumsum(amounts)])
            fresh = np.append(held is None or not _same(keys.slice(0, 1), held)[0], ~_same(keys.slice(1), keys.slice(0, len(keys) - 1)))
            begins = np.flatnonzero(fresh)
            out: tuple[list, list, list] = [], [], []
            for a, b in zip([0, *begins[begins > 0].tolist()], [*begins[begins > 0].tolist(), len(keys)]):
                at_row = a
                if not fresh[a]:  # the open window goes on
                    at_row = a + int(np.searchsorted(times[a:b], opened + gap))
                    n += int(sums[at_row] - sums[a])
                while at_row < b:
                    if held is not None:
                        for column, value in zip(out, (held, opened + gap, n)):
                            column.append(value)
                    held, opened = keys.slice(at_row, 1), int(times[at_row])
                    end = a + int(np.searchsorted(times[a:b], opened + gap))
                    n, at_row = int(sums[end] - sums[at_row]), end
            if out[0]:
                yield rows(*out)
        if held is not None:
            yield rows([held], [opened + gap], [n])

    return dealt.mapInArrow(run, f"`{key}` {dict(counted.dtypes)[key]}, fired_at long, n long")


def _same(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Where two arrays agree; null is null, and NaN is NaN."""
    alike = pc.fill_null(pc.equal(left, right), False)
    alike = pc.or_(alike, pc.and_(pc.is_null(left), pc.is_null(right)))
    if pa.types.is_floating(left.type):
        alike = pc.or_(alike, pc.fill_null(pc.and_(pc.is_nan(left), pc.is_nan(right)), False))
    return alike.to_numpy(zero_copy_only=False)


def throttled(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """key, at: the reports that pass: the first, those `gap` after the last that passed, and the last of each key."""
    passed = leading(events, key, at, gap).select(key, (F.col("fired_at") - gap).alias(at))
    last = events.filter(F.col(at).isNotNull()).groupBy(key).agg(F.max(at).alias(at))
    return passed.union(last).distinct()


def stream_leading(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """The leading-edge debounce of a stream with a watermark on `at` (timestamp): key, opened, n.

    A key's open window is its state; event-time timeouts close it, so a burst fires once.
    """
    seconds = pd.Timedelta(gap).total_seconds()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        out = []
        for frame in frames:
            for t in sorted(frame[at]):
                t = t.timestamp()
                if opened is not None and t - opened < seconds:
                    n += 1
                    continue
                if opened is not None:
                    out.append((keys[0], pd.Timestamp(opened, unit="s"), n))
                opened, n = t, 1
        if state.hasTimedOut and opened is not None:
            out.append((keys[0], pd.Timestamp(opened, unit="s"), n))
            state.remove()
        elif opened is not None:
            state.update((opened, n))
            state.setTimeoutTimestamp(max(int((opened + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "opened", "n"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, opened timestamp, n long", "opened double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_trailing(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """The trailing debounce of a stream with a watermark: session windows with their sets of values."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.end").alias("fired_at"), "n")


def single_flight(requests: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """Requests that start work: a key's first, and each first one after a failure."""
    w = Window.partitionBy(key).orderBy(at)
    return requests.withColumn("_before", F.lag(failed).over(w)).filter(F.col("_before").isNull() | F.col("_before")).drop("_before")


def retried(attempts: DataFrame, key: str, at: str, cooldown: int) -> DataFrame:
    """key, at: the attempts that are made: a key's first, and the first one at least `cooldown` after the last that was made."""
    return leading(attempts, key, at, cooldown).select(key, (F.col("fired_at") - cooldown).alias(at))


def pending(requests: DataFrame, drains: DataFrame, connection: str, key: str, at: str, failed: str) -> DataFrame:
    """connection, drained_at, key, first_at: requests that wait for their connection, each key once a drain.

    A request waits for its connection's next drain (at the same time or later); what waits when a
    connection fails to come up is dropped, and so is what no drain follows.
    """
    asked = requests.select(connection, F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(None).cast(dict(requests.dtypes)[at]).alias("_drain"), F.lit(False).alias("_failed"))
    done = drains.select(connection, F.lit(None).cast(dict(requests.dtypes)[key]).alias("_key"), F.col(at).alias("_at"), F.col(at).alias("_drain"), F.col(failed).alias("_failed"))
    ahead = Window.partitionBy(connection).orderBy("_at", F.col("_drain").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = F.first(F.when(F.col("_drain").isNotNull(), F.struct("_drain", "_failed")), ignorenulls=True).over(ahead)
    waiting = asked.union(done).withColumn("_next", following).filter("_drain is null and _next is not null and not _next._failed")
    return waiting.groupBy(connection, F.col("_next._drain").alias("drained_at"), F.col("_key").alias(key)).agg(F.min("_at").alias("first_at"))


def balanced(reports: DataFrame, token: str, at: str, phase: str) -> DataFrame:
    """Reports of begun tokens only: from `begin` to the first `end` after it, or to a `lost` connection, which ends a token too."""
    w = Window.partitionBy(token).orderBy(at)
    rows = reports.withColumn("_round", F.sum((F.col(phase) == "begin").cast("int")).over(w))
    inside = Window.partitionBy(token, "_round").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col(phase).isin("end", "lost").cast("int")).over(inside), F.lit(0))
    return rows.withColumn("_ended", ended).filter("_round > 0 and _ended = 0").drop("_round", "_ended")


def ended_by_loss(reports: DataFrame, losses: DataFrame, token: str, connection: str, at: str, phase: str) -> DataFrame:
    """reports with a `lost` one for each token of a connection (connection, at) that dies, so that `balanced` ends them."""
    tokens = reports.select(token, connection).distinct()
    lost = losses.join(tokens, connection)
    columns = [F.col(c) if c in (token, connection, at) else F.lit("lost").alias(c) if c == phase else F.lit(None).cast(t).alias(c) for c, t in reports.dtypes]
    return reports.unionByName(lost.select(*columns))
