"""Incremental base queries (T1, W2, U3, T4 batch twin)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from pliego.plans.contract_view import table
from pliego.plans.registry import register, rounded
from pliego.session import scratch_path
from pliego.streaming.incremental import freshness_windows, monitor_freshness, upsert

_SPLIT = "TIMESTAMP '2024-01-20 00:00:00'"


@register("upsert_last_event_per_user", f"""
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_upsert_user(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = ev.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    new = ev.where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    base = base.withColumn("_lote", F.lit(0).cast("long"))
    return upsert(base, new, ["user_id"], ["ts", "event_id"]).drop("_lote")


@register("upsert_events_by_id", """
SELECT event_id, event_type, round(CASE WHEN event_type = 'purchase' THEN value * 2 ELSE value END, 4) AS value
FROM events""")
def q_upsert_id(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    new = ev.where(F.col("event_type") == "purchase").withColumn("value", F.col("value") * 2)
    out = upsert(ev.withColumn("_lote", F.lit(0).cast("long")), new, ["event_id"], ["value"]).drop("_lote")
    return rounded(out, {"value": 4})


@register("freshness_windows_events", """
SELECT time_bucket(INTERVAL '1 day', ts) AS inicio, count(*) AS n, max(ts) AS mas_reciente FROM events GROUP BY 1""")
def q_fresh_windows(spark, sf):
    return freshness_windows(table(spark, sf, "events"), "ts")


_LATE = "event_id % 7 = 3 AND day(ts) <= 6"


@register("monitor_freshness_stream", f"""
WITH landed AS (SELECT ts, CASE WHEN {_LATE} THEN 3 WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS run,
    time_bucket(INTERVAL '1 day', ts) AS inicio FROM events),
seen AS (SELECT l.*, (SELECT max(ts) FROM landed e WHERE e.run < l.run) - INTERVAL '1 day' AS mark FROM landed l),
kept AS (SELECT * FROM seen WHERE mark IS NULL OR inicio + INTERVAL '1 day' > mark),
closed AS (SELECT inicio, count(*) AS n, max(ts) AS mas_reciente FROM kept GROUP BY inicio
  HAVING inicio + INTERVAL '1 day' <= (SELECT max(ts) FROM landed) - INTERVAL '1 day'),
aged AS (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-02-15') - epoch(mas_reciente)) / 86400) AS BIGINT) AS dias FROM closed)
SELECT *, CASE WHEN dias > 30 THEN 'aviso' ELSE 'ok' END AS estado,
  CASE WHEN dias <= 7 THEN 'reciente' WHEN dias <= 30 THEN 'normal' ELSE 'antiguo' END AS insignia FROM aged""")
def q_monitor(spark, sf):
    """T4: events land in three parts, a run of the stream after each; the third brings rows of days
    whose windows are closed by then, which the watermark drops."""
    root = scratch_path(spark, f"monitor-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events").select("event_id", "ts")
    late, day = F.expr("event_id % 7 = 3 AND day(ts) <= 6"), F.dayofmonth("ts")
    run = F.when(late, 3).when(day <= 10, 1).when(day <= 20, 2).otherwise(3)
    for i in (1, 2, 3):
        ev.where(run == i).write.parquet(f"{root}/landing/part{i}")
        stream = spark.readStream.schema(ev.schema).parquet(f"{root}/landing/*")
        monitor_freshness(stream, "ts", _dt.date(2024, 2, 15), f"{root}/closed", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/closed")


@register("late_replay_after_merges", """
SELECT user_id, max(event_id) AS event_id, 12 AS ronda FROM events GROUP BY user_id""")
def q_late_replay(spark, sf):
    """A stream's first batch is run again after many later merges; the base stays as they left it."""
    from pliego.streaming.incremental import read_base, upsert_base
    path = scratch_path(spark, f"replay-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    first = ev.withColumn("ronda", F.lit(1))
    upsert_base(spark, first, path, ["user_id"], ["ronda"], stream="s", batch=0)
    for i in range(2, 13):
        upsert_base(spark, ev.withColumn("ronda", F.lit(i)), path, ["user_id"], ["ronda"])
    upsert_base(spark, first, path, ["user_id"], ["ronda"], stream="s", batch=0)
    return read_base(spark, path).drop("_lote")


@register("upsert_stream_last_event_per_user", """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_upsert_stream(spark, sf):
    """The events land as three files (by day of month); a file-source
    stream merges them batch by batch with ``foreachBatch``; the result must
    equal the batch keep-last."""
    import uuid

    from pliego.session import scratch_path
    from pliego.streaming.incremental import read_base, upsert_base_stream
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.dayofmonth("ts")
    for i, (lo, hi) in enumerate([(1, 10), (11, 20), (21, 31)]):
        ev.where(day.between(lo, hi)).write.parquet(f"{root}/landing/part{i}")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/landing/*"))
    q = upsert_base_stream(stream, f"{root}/base", ["user_id"], ["ts", "event_id"], f"{root}/checkpoint")
    q.awaitTermination()
    return read_base(spark, f"{root}/base").drop("_lote")


@register("stream_onto_existing_base", """
SELECT event_id, ts, user_id, event_type, value, CASE WHEN day(ts) > 10 THEN 'stream' END AS origen FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day(ts) > 10 DESC, ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def q_stream_onto_base(spark, sf):
    """T2 on a base that batch merges made first; the stream brings a column the base lacks."""
    import uuid

    from pliego.session import scratch_path
    from pliego.streaming.incremental import read_base, upsert_base, upsert_base_stream
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    early = ev.where(F.dayofmonth("ts") <= 10)
    upsert_base(spark, early, f"{root}/base", ["user_id"], ["ts", "event_id"])
    upsert_base(spark, early, f"{root}/base", ["user_id"], ["ts", "event_id"])
    late = ev.where(F.dayofmonth("ts") > 10).withColumn("origen", F.lit("stream"))
    late.write.parquet(f"{root}/landing/part0")
    stream = spark.readStream.schema(late.schema).parquet(f"{root}/landing/*")
    upsert_base_stream(stream, f"{root}/base", ["user_id"], ["ts", "event_id"], f"{root}/checkpoint").awaitTermination()
    return read_base(spark, f"{root}/base").drop("_lote")


@register("base_in_batch_duplicates", """
SELECT user_id, max(event_id) AS v, count(*) AS n FROM events GROUP BY user_id""")
def q_base_duplicates(spark, sf):
    """Many rows of a key in one batch, and a data column called ``v``."""
    import uuid

    from pliego.session import scratch_path
    from pliego.streaming.incremental import upsert_base
    path = scratch_path(spark, f"base-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events")
    per_user = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = ev.select("user_id", F.col("event_id").alias("v")).join(per_user, "user_id")
    return upsert_base(spark, rows, path, ["user_id"], ["v"]).select("user_id", "v", "n")
