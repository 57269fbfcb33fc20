"""Sessions, in batch and by Structured Streaming, and time phrases."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import timewin
from recallgrid.registry import query
from recallgrid.sources.index import shared_folder
from recallgrid.streaming import episodes as E


def _sessions(minutes: int) -> str:
    return f"""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {minutes} MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""


@query(_sessions(30))
def episodes_30m(spark: SparkSession, d: str) -> DataFrame:
    """T1, T2."""
    return E.episodes(X.table(spark, d, "events"), "30 minutes")


@query(_sessions(360))
def episodes_6h(spark: SparkSession, d: str) -> DataFrame:
    return E.episodes(X.table(spark, d, "events"), "6 hours")


@query()
def now_page_runs(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    return E.debounced(X.table(spark, d, "events"))


@query()
def time_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases to windows, on the driver."""
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    phrases = ["2024-01-05", "in 2024-01", "january 7", "7 jan 2024", "today", "yesterday", "3 days ago", "last 2 weeks", "this week", "last week", "this month", "last month", "last friday", "in march", "may 2023", "no time"]
    rows = [(p, *(x.isoformat() if x else None for x in (timewin.parse(p, now) or (None, None)))) for p in phrases]
    return spark.createDataFrame(rows, "phrase string, window_from string, window_to string")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' GROUP BY 1")
def feedback_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, aggregated with a stateful operator to a table in the shared folder."""
    name = f"{shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    schema = X.table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    agg = s.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    q = agg.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{name}/out")).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{name}/out")
