"""Episodes: sessions of writes, in batch and as a stream; and debounced runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def episodes(writes: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, last, n of writes(user_id, ts): a write at most gap after the last joins its episode.

    Works on batches and streams alike; a stream needs a watermark on ts, which also bounds its state.
    """
    s = writes.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return s.select("user_id", "start", "last", "n")


def episode_stream(writes: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same of a streaming DataFrame; late is an addition: arrivals later than that are dropped."""
    return episodes(writes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), gap)


def status(closed: DataFrame, now: str, idle: int) -> DataFrame:
    """user_id, open, pending at a tick: episodes that started by then, open while idle for at most so many seconds; pending for a summary if they hold two writes."""
    e = closed.filter(F.col("start") <= F.lit(now).cast("timestamp_ntz")).withColumn("_open", F.expr(f"last + interval {idle} seconds >= timestamp_ntz'{now}'"))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("_open"), 1)).alias("open"), F.count(F.when(~F.col("_open") & (F.col("n") >= 2), 1)).alias("pending"))


def debounce_marks(times: list[float], every: float) -> list[float]:
    """When runs start: the first write at once, later ones once for each interval, at its end."""
    runs: list[float] = []
    for t in sorted(times):
        if not runs or t >= runs[-1] + every:
            runs.append(t)
        elif runs[-1] <= t:
            runs.append(runs[-1] + every)
    return runs


def debounced(writes: DataFrame, seconds: float = 900) -> DataFrame:
    """user_id, run_at of writes(user_id, ts), one owner's times at a time."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = debounce_marks([float(x) for x in pdf["t"]], seconds)
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "run_at": marks})

    w = writes.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return w.groupBy("user_id").applyInPandas(run, "user_id long, run_at double")
