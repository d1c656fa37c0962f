"""Event streams: matching, the first match of a key, bodies cut to a limit, and network idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def subscribe(spark: SparkSession, path: str, schema: str, kinds: list[str] | None = None, per_trigger: int = 1) -> DataFrame:
    """Events from files that drop into ``path``, of some ``event_type`` if given."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return out.where(F.col("event_type").isin(kinds)) if kinds else out


def when(events: DataFrame, predicate: Column | str) -> DataFrame:
    return events.where(predicate)


def first_match(events: DataFrame, predicate: Column | str, key: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """The first matching event of each key that arrives within ``late``; state goes once the watermark has passed."""
    hit = events.where(predicate)
    return hit.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else hit.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(at))).where("n = 1").drop("n")


def body(column: Column, limit: int = 1 << 20) -> Column:
    """``struct<body, bodyTruncated>`` of a captured body, cut at ``limit`` bytes."""
    raw = column.cast("binary")
    return F.struct(F.substring(raw, 1, limit).alias("body"), (F.octet_length(raw) > limit).alias("bodyTruncated"))


def idle_times(events: pd.DataFrame, quiet_ms: int, max_inflight: int) -> pd.DataFrame:
    """Idle moments of one key's ordered events ``(ts, request_id, kind)``, ``kind`` started, finished or failed; open requests are followed."""
    active: set = set()
    quiet, out, armed = pd.Timedelta(milliseconds=quiet_ms), [], None
    for ts, request, kind in events.itertuples(index=False):
        if armed is not None and ts - armed >= quiet:
            out.append((armed + quiet, len(active)))
        (active.add if kind == "started" else active.discard)(request)
        armed = ts if len(active) <= max_inflight else None
    if armed is not None:
        out.append((armed + quiet, len(active)))
    return pd.DataFrame(out, columns=["idle_at", "inflight"])


def network_idle_batch(events: DataFrame, quiet_ms: int = 500, max_inflight: int = 0, key: str = "session") -> DataFrame:
    """``(key, idle_at, inflight)`` over a table of ``(key, ts, request_id, kind)``, in the JVM: in-flight counts and gaps by window functions.

    A start counts for a request that isn't open, an end for one that is: repeated starts and stray or repeated ends change nothing. Events of one
    time go by request, starts first.
    """
    order = ["ts", "request_id", F.col("kind").desc()]
    line = Window.partitionBy(key).orderBy(*order)
    was_open = F.coalesce(F.lag("kind").over(Window.partitionBy(key, "request_id").orderBy(*order)) == "started", F.lit(False))
    starts = F.col("kind") == "started"
    change = F.when(starts & ~was_open, 1).when(~starts & was_open, -1).otherwise(0)
    counted = events.withColumn("change", change).withColumn("inflight", F.sum("change").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("ts").over(line))
    end = F.col("ts") + F.make_dt_interval(secs=F.lit(quiet_ms / 1000))
    return counted.where((F.col("inflight") <= max_inflight) & (F.col("next").isNull() | (F.col("next") >= end))).select(key, end.alias("idle_at"), F.col("inflight").cast("int").alias("inflight"))


def network_idle(events: DataFrame, quiet_ms: int = 500, max_inflight: int = 0, key: str = "session") -> DataFrame:
    """The streaming form: state of a key is its open requests and when it was last armed; a timer emits the last quiet spell."""
    quiet = pd.Timedelta(milliseconds=quiet_ms)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, armed_ms = state.get if state.exists else ([], None)
        active, armed, out = set(requests), pd.Timestamp(armed_ms, unit="ms") if armed_ms is not None else None, []
        if state.hasTimedOut:
            if armed is not None:
                out.append((armed + quiet, len(active)))
            armed = None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "request_id", "kind"], ascending=[True, True, False], kind="stable")
            for ts, request, kind in rows[["ts", "request_id", "kind"]].itertuples(index=False):
                if armed is not None and ts - armed >= quiet:
                    out.append((armed + quiet, len(active)))
                (active.add if kind == "started" else active.discard)(request)
                armed = ts if len(active) <= max_inflight else None
        state.update((sorted(active), int(armed.timestamp() * 1000) if armed is not None else None))
        if armed is not None:
            state.setTimeoutTimestamp(max(int((armed + quiet).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(*keys, *x) for x in out], columns=[key, "idle_at", "inflight"])

    timed = events.withWatermark("ts", f"{quiet_ms} milliseconds")
    kind = events.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, idle_at timestamp, inflight int", "requests array<string>, armed long", "append", GroupStateTimeout.EventTimeTimeout)
