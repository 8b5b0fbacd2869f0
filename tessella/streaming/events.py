"""Stage events: the batch forms over a table of events, and the same on a stream.

events: event_id, ts, user_id, event_type, value, props.  Watermarks and late-data rules are an addition of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bounded_queue(events: DataFrame, most: int = 256, key: str = "user_id") -> DataFrame:
    """The last `most` events of each key, as a queue that drops its oldest holds them: the bound is the feature."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def keepalives(events: DataFrame, idle_seconds: int = 12, key: str = "user_id") -> DataFrame:
    """(key, event_id, keepalives): how many idle spans passed before an event."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    gap = _micros(F.col("ts")) - _micros(before)
    return events.withColumn("keepalives", F.coalesce(F.floor(gap / (idle_seconds * 1_000_000)), F.lit(0)).cast("bigint")).where("keepalives > 0").select(key, "event_id", "keepalives")


def sessions(events: DataFrame, ttl_seconds: int = 3600, key: str = "user_id") -> DataFrame:
    """(key, session, first_ts, last_ts, n): a gap of the TTL or more begins a new session."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.coalesce((_micros(F.col("ts")) - _micros(F.lag("ts").over(w)) >= ttl_seconds * 1_000_000).cast("int"), F.lit(0))
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def backlog(events: DataFrame, subscribed: DataFrame, most: int = 512, key: str = "user_id") -> DataFrame:
    """events with replayed: what a subscriber is given, in order of ts and event_id.  subscribed: key, since.  Events from
    since on, and of those before it the last `most`, replayed first: the bound is the feature.  Keys without a
    subscriber get nothing."""
    at = events.join(subscribed.select(key, "since"), key)
    before = F.col("ts") < F.col("since")
    rank = F.row_number().over(Window.partitionBy(key, before).orderBy(F.desc("ts"), F.desc("event_id")))
    return at.withColumn("replayed", before).withColumn("_r", rank).where(~F.col("replayed") | (F.col("_r") <= most)).drop("_r", "since")


def until_closed(events: DataFrame, final: Column, key: str = "user_id") -> DataFrame:
    """Events of each key up to and with its first final one, after which the stream is closed."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_c", F.coalesce(F.max(F.coalesce(final, F.lit(False)).cast("int")).over(w), F.lit(0))).where("_c = 0").drop("_c")


def payload(type_: Column, stage: Column, id_: Column, ts: Column, extra: Column) -> Column:
    """The JSON of an event: type, stage, id, ts in seconds, and the entries of extra, a map of strings, which override the
    first three by their own; ts of extra counts where it is a number."""
    given = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    of = lambda k: F.try_element_at(given, F.lit(k))
    seconds = F.coalesce(of("ts").try_cast("double"), F.round(F.unix_micros(ts.cast("timestamp")) / 1e6, 3))
    own = F.to_json(F.struct(F.coalesce(of("type"), type_).alias("type"), F.coalesce(of("stage"), stage).alias("stage"), F.coalesce(of("id"), id_.cast("string")).alias("id"), seconds.alias("ts")))
    rest = F.map_filter(given, lambda k, v: ~k.isin("type", "stage", "id", "ts"))
    return F.when(F.size(rest) == 0, own).otherwise(F.concat(F.regexp_replace(own, r"\}$", ","), F.substring(F.to_json(rest), 2, 1_000_000_000)))


def progress(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, done, percent): running count against the total."""
    w = Window.partitionBy(key)
    done = F.count(F.lit(1)).over(w.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.select(key, "event_id", done.alias("done"), F.round(F.lit(100.0) * done / F.count(F.lit(1)).over(w), 2).alias("percent"))


def stream_windows(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type and window of a stream; later events than the watermark don't count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def stream_sessions(stream: DataFrame, ttl: str = "1 hour", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", ttl), key).agg(F.count(F.lit(1)).alias("n"))


def stream_rollover(stream: DataFrame, turns: int, key: str = "user_id") -> DataFrame:
    """(key, chunk, events) whenever a key has collected `turns` events, counted from 0 again for each chunk.  The state is
    a count and a chunk number for each key."""
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, chunk = state.get if state.exists else (0, 0)
        out = []
        for f in frames:
            for _ in range(len(f)):
                n += 1
                if n >= turns:
                    out.append((k[0], chunk, n))
                    n, chunk = 0, chunk + 1
        state.update((n, chunk))
        yield pd.DataFrame(out, columns=[key, "chunk", "events"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, chunk int, events int", "n int, chunk int", "append", "NoTimeout")
