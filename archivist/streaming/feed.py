"""Change feeds of job progress over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ITEMS, MILLIS = 50, 1000
#: Phases that are always published. Fixed values.
FORCED = ("starting", "completed", "failed", "cancelled")
SHAPE = "job_id long, seq long, at_ms long, phase string, processed long, total long"


def publishes(last: tuple | None, at: int, phase: str, processed: int, total: int) -> bool:
    """Whether a tick is published, given (time, processed, phase) of the last one that was."""
    if last is None or phase in FORCED or phase != last[2] or processed == 0 or (total and processed >= total):
        return True
    return processed - last[1] >= ITEMS or at - last[0] >= MILLIS


def throttled(ticks: DataFrame) -> DataFrame:
    """The published ticks of a stream (or table) of SHAPE; the state is the last published tick of each job."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if publishes(last, r.at_ms, r.phase, r.processed, r.total):
                out.append(r)
                last = (r.at_ms, r.processed, r.phase)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=rows.columns)

    return ticks.groupBy("job_id").applyInPandasWithState(step, SHAPE, "at_ms long, processed long, phase string", "append", GroupStateTimeout.NoTimeout)


HEARTBEAT_MS, BURST = 17_000, "100 milliseconds"
EVENTS = "channel string, event string, seq long, fingerprint string"


def change_feed(snapshots: DataFrame, heartbeat_ms: int = HEARTBEAT_MS) -> DataFrame:
    """Events of a stream of snapshots (channel, seq, fingerprint, idle): a snapshot is told at first and when its fingerprint changes, idle once when
    it begins, and a ping when nothing was told for so long. Snapshots of one trigger are a burst, of which only the last counts: start the query with
    a trigger of BURST. What was told last is kept by channel, so a restart from the checkpoint doesn't repeat it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        channel, (last, idle, told) = key[0], state.get if state.exists else (None, False, 0)
        now, out = state.getCurrentProcessingTimeMs(), []
        if state.hasTimedOut:
            if now - told >= heartbeat_ms:
                out.append((channel, "ping", None, None))
                told = now
        else:
            rows = pd.concat(list(batches))
            r = rows.loc[rows["seq"].idxmax()]
            if r["fingerprint"] != last:
                out.append((channel, "snapshot", int(r["seq"]), r["fingerprint"]))
                last, told = r["fingerprint"], now
                if r["idle"] and not idle:
                    out.append((channel, "idle", int(r["seq"]), r["fingerprint"]))
                idle = bool(r["idle"])
        state.update((last, idle, told))
        state.setTimeoutDuration(max(1, told + heartbeat_ms - now))
        yield pd.DataFrame(out, columns=["channel", "event", "seq", "fingerprint"]).astype({"seq": "Int64"})

    return snapshots.groupBy("channel").applyInPandasWithState(step, EVENTS, "fingerprint string, idle boolean, told long", "append", GroupStateTimeout.ProcessingTimeTimeout)


REFRESH_MS = 5_000
STATUS = "channel string, seq long, at_ms long, job string, counts string, counts_seq long"


def cached_status(ticks: DataFrame, refresh_ms: int = REFRESH_MS) -> DataFrame:
    """Statuses of ticks (channel, seq, at_ms, active, job, counts): the job's fields are those of the tick, the counts those of the last full
    snapshot, taken anew after refresh_ms or when activity begins or ends. counts_seq: the tick whose counts they are."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = state.get if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for r in rows.itertuples(index=False):
            if cache is None or cache[1] != r.active or r.at_ms - cache[0] >= refresh_ms:
                cache = (int(r.at_ms), bool(r.active), r.counts, int(r.seq))
            out.append((key[0], r.seq, r.at_ms, r.job, cache[2], cache[3]))
        state.update(cache)
        yield pd.DataFrame(out, columns=["channel", "seq", "at_ms", "job", "counts", "counts_seq"])

    return ticks.groupBy("channel").applyInPandasWithState(step, STATUS, "at_ms long, active boolean, counts string, seq long", "append", GroupStateTimeout.NoTimeout)
