"""Structured Streaming over event rows: windowed counts with a watermark, a count-bounded rolling window a key, and job states with a timer.

Each has a batch form that gives what the stream has said when all events have come, late ones too as far as the watermark
lets them in.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST = 100
#: States of a job that is under way.
OPEN = ("queued", "running")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: the same plan on a stream and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def rolling(events: DataFrame, last: int = LAST) -> DataFrame:
    """event_type, n, mean, top over the last ``last`` values that a stream has brought of each type; one row a type and batch.

    The state is the last values with their times, so an event that comes late still takes its place among them."""

    def step(key, frames, state):
        kept = json.loads(state.get[0]) if state.exists else []
        for frame in frames:
            kept = sorted(kept + [[t.isoformat(), v] for t, v in zip(frame["ts"], frame["value"], strict=True)])[-last:]
        state.update((json.dumps(kept),))
        values = sorted(v for _, v in kept)
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(values)], "mean": [sum(values) / max(len(values), 1)], "top": [max(values, default=None)]})

    return events.select("event_type", "ts", "value").groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, mean double, top double", "kept string", "update", "NoTimeout")


def rolled(events: DataFrame, last: int = LAST) -> DataFrame:
    """``rolling`` of a table: the last values by time, of equal times the greatest, summed in order of size."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("value"))
    rows = events.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last)
    total = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), (total / F.count("*")).alias("mean"), F.max("value").alias("top"))


def job_states(events: DataFrame, hours: int, late: str = "10 minutes") -> DataFrame:
    """job, ts, state of a stream of events (job, ts, state): each event, and ``interrupted`` once a job that is under way has been
    silent for ``hours`` of event time.

    The state of a job is its last event. The timer is one of event time, so it fires by the watermark, after a restart from a
    checkpoint too; an event of a job that was interrupted opens it again. Events that are later than the watermark are lost."""

    def step(key, frames, state):
        if state.hasTimedOut:
            ts, _ = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "ts": [pd.Timestamp(ts, unit="us") + pd.Timedelta(hours=hours)], "state": ["interrupted"]})
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        before = state.get if state.exists else None
        out = []
        for ts, name in zip(rows["ts"], rows["state"], strict=True):
            now = (int(ts.value // 1000), name)
            if before and before[1] in OPEN and now[0] - before[0] > hours * 3_600_000_000:
                out.append((pd.Timestamp(before[0], unit="us") + pd.Timedelta(hours=hours), "interrupted"))
            out.append((ts, name))
            if not before or now[0] >= before[0]:
                before = now
        if before[1] in OPEN:
            state.update(before)
            state.setTimeoutTimestamp(max(before[0] // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job": [key[0]] * len(out), "ts": [t for t, _ in out], "state": [s for _, s in out]})

    timed = events.select("job", "ts", "state").withWatermark("ts", late)
    kind = events.schema["job"].dataType.simpleString()
    return timed.groupBy("job").applyInPandasWithState(step, f"job {kind}, ts timestamp, state string", "ts long, name string", "append", "EventTimeTimeout")


def job_log(events: DataFrame, hours: int) -> DataFrame:
    """``job_states`` of a table (job, ts, state, event_id): a job still silent when the last event of all came is interrupted if its
    time is over by then."""
    order = Window.partitionBy("job").orderBy("ts", "event_id")
    final = events.agg(F.max("ts").alias("final"))
    rows = events.withColumn("next", F.lead("ts").over(order)).crossJoin(F.broadcast(final))  # one row
    over = F.col("ts") + F.make_interval(hours=F.lit(hours))
    silent = F.col("state").isin(*OPEN) & (F.coalesce("next", "final") > over)
    return rows.select("job", "ts", "state").unionByName(rows.where(silent).select("job", over.alias("ts"), F.lit("interrupted").alias("state")))
