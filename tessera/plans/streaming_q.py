"""Structured Streaming queries over the events and documents tables.

Each query runs its stream to the end of the input (availableNow) and
returns the sink's content read back, so the oracle compares final results.
Timestamps are written back without zone (session zone is UTC).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources.tables import read
from tessera.streaming import jobs as S


def ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register("stream_file_source", "SELECT event_id, ts, user_id, event_type, value FROM events")
def q_stream_file_source(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    return S.run(ev, "append", "file-source").select("event_id", ntz("ts"), "user_id", "event_type", "value")


@register("stream_sinks", "SELECT event_id, 'file' AS sink FROM events UNION ALL SELECT event_id, 'table' FROM events")
def q_stream_sinks(spark, sf_dir):
    """File sink, table sink (toTable) and a foreach writer on one input."""
    import uuid
    ev = S.events_stream(spark, sf_dir).select("event_id", "event_type")
    file_rows = S.run(ev, "append", "sink-file").select("event_id", F.lit("file").alias("sink"))
    name = f"stream_tbl_{uuid.uuid4().hex[:8]}"
    q = ev.writeStream.option("checkpointLocation", scratch_path(spark, "sink-table-ckpt")) \
        .option("path", scratch_path(spark, "sink-table")).format("parquet").trigger(availableNow=True).toTable(name)
    q.awaitTermination()

    class RowCheck:
        def open(self, partition_id, epoch_id):
            return True

        def process(self, row):
            if row.event_id is None:
                raise ValueError("event without id")

        def close(self, error):
            if error:
                raise error
    q2 = ev.writeStream.foreach(RowCheck()).option("checkpointLocation", scratch_path(spark, "sink-foreach-ckpt")) \
        .trigger(availableNow=True).start()
    q2.awaitTermination()
    return file_rows.unionByName(spark.table(name).select("event_id", F.lit("table").alias("sink")))


@register("stream_modes_triggers", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_stream_modes_triggers(spark, sf_dir):
    """Update mode (latest row per key), with the once trigger checked too."""
    ev = S.events_stream(spark, sf_dir)
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    once = ev.writeStream.format("parquet").option("path", scratch_path(spark, "once")) \
        .option("checkpointLocation", scratch_path(spark, "once-ckpt")).trigger(once=True).start()
    once.awaitTermination()
    return S.run(counts, "update", "modes", key=["event_type"])


@register("stream_word_count", """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1""")
def q_stream_word_count(spark, sf_dir):
    docs = S.table_stream(spark, sf_dir, "documents", "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return S.run(words, "complete", "wordcount")


@register("stream_tumbling", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n FROM events GROUP BY ALL""")
def q_stream_tumbling(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).withWatermark("ts", "10 minutes")
    agg = ev.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = S.run(agg, "complete", "tumbling")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@register("stream_sliding", """
WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type FROM events),
w AS (SELECT b AS window_start, event_type FROM s UNION ALL SELECT b - INTERVAL 30 MINUTE, event_type FROM s)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM w GROUP BY ALL""")
def q_stream_sliding(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).withWatermark("ts", "10 minutes")
    agg = ev.groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = S.run(agg, "complete", "sliding")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


GAP_S = 1800


@register("stream_session", f"""
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                   OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {GAP_S * 1000000}
                   THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {GAP_S} SECOND AS session_end, count(*) AS n
FROM s GROUP BY user_id, sid""")
def q_stream_session(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).withWatermark("ts", "10 minutes")
    agg = ev.groupBy(F.session_window("ts", f"{GAP_S} seconds"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    out = S.run(agg, "complete", "session")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n")


@register("stream_session_closed")
def q_stream_session_closed(spark, sf_dir):
    """Sessions ended by a 30-minute gap or by a purchase, with keyed state and
    event-time timeouts (applyInPandasWithState)."""
    ev = S.events_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    out = S.run(S.closed_sessions(ev, GAP_S, "purchase"), "append", "closed-sessions")
    return out.select("user_id", ntz("session_start"), ntz("session_end"), "num_events", "duration_ms", "closed_by")


@register("session_closed_batch", f"""
WITH e AS (SELECT user_id, ts, event_id, event_type,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts,
                  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ptype FROM events),
b AS (SELECT *, CASE WHEN pts IS NULL OR ptype = 'purchase' OR epoch_us(ts) - epoch_us(pts) > {GAP_S * 1000000}
                     THEN 1 ELSE 0 END AS brk FROM e),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM b)
SELECT user_id, min(ts) AS session_start,
       CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN max(ts) ELSE max(ts) + INTERVAL {GAP_S} SECOND END AS session_end,
       count(*) AS num_events
FROM s GROUP BY user_id, sid""")
def q_session_closed_batch(spark, sf_dir):
    """Batch twin of the closed-session stream: all sessions, by window functions."""
    ev = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = ev.withColumns({"pts": F.lag("ts").over(w), "ptype": F.lag("event_type").over(w)})
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("pts").cast("timestamp"))
    b = b.withColumn("brk", F.when(F.col("pts").isNull() | (F.col("ptype") == "purchase") | (gap > GAP_S * 1_000_000), 1)
                     .otherwise(0))
    s = b.withColumn("sid", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("user_id", "sid").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("num_events"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    end = F.when(F.col("last_type") == "purchase", F.col("last")) \
        .otherwise(F.col("last") + F.expr(f"INTERVAL {GAP_S} SECONDS"))
    return g.select("user_id", "session_start", end.alias("session_end"), "num_events")


@register("stream_watermark_late")
def q_stream_watermark_late(spark, sf_dir):
    """Input in two files, the second holding older rows: with one file per
    trigger, rows behind the watermark are dropped from the windowed counts."""
    src = scratch_path(spark, "late-src")
    ev = read(spark, sf_dir, "events")
    mid = ev.select(F.percentile_approx("ts", 0.5)).first()[0]
    ev.where(F.col("ts") >= F.lit(mid)).coalesce(1).write.mode("overwrite").parquet(f"{src}/b1")
    ev.where(F.col("ts") < F.lit(mid)).coalesce(1).write.mode("overwrite").parquet(f"{src}/b2")
    stream = spark.readStream.schema(S.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    out = S.run(agg, "append", "late")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    d = ev.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")
    return S.run(d, "append", "dedup")


@register("stream_keyed_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_stream_keyed_state(spark, sf_dir):
    from pyspark.sql.streaming.state import GroupStateTimeout
    ev = S.events_stream(spark, sf_dir).select("user_id", "value")
    st = ev.groupBy("user_id").applyInPandasWithState(S.running_totals, S.STATE_OUT, S.STATE_SCHEMA, "update",
                                                      GroupStateTimeout.NoTimeout)
    out = S.run(st, "update", "keyed", key=["user_id"])
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


@register("stream_static_join", """
SELECT event_id, c_name, c_mktsegment FROM events JOIN customer ON user_id = c_custkey""")
def q_stream_static_join(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).select("event_id", "user_id")
    cust = J.broadcast_if_small(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    j = ev.join(cust, ev.user_id == cust.c_custkey).select("event_id", "c_name", "c_mktsegment")
    return S.run(j, "append", "static-join")


@register("stream_stream_join", """
SELECT p.event_id AS purchase_id, c.event_id AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON p.user_id = c.user_id AND c.ts >= p.ts AND epoch_us(c.ts) - epoch_us(p.ts) <= 3600000000""")
def q_stream_stream_join(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir)
    p = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"),
                                                   F.col("ts").alias("pts")).withWatermark("pts", "2 hours")
    c = ev.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("cu"),
                                                F.col("ts").alias("cts")).withWatermark("cts", "2 hours")
    j = p.join(c, F.expr("pu = cu AND cts >= pts AND cts <= pts + INTERVAL 1 HOUR"))
    return S.run(j.select("purchase_id", "click_id"), "append", "stream-join")


@register("stream_outer_join")
def q_stream_outer_join(spark, sf_dir):
    """Purchases with or without a click in the next hour; unmatched rows are
    emitted once the watermark passes their time bound."""
    ev = S.events_stream(spark, sf_dir)
    p = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"),
                                                   F.col("ts").alias("pts")).withWatermark("pts", "2 hours")
    c = ev.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("cu"),
                                                F.col("ts").alias("cts")).withWatermark("cts", "2 hours")
    j = p.join(c, F.expr("pu = cu AND cts >= pts AND cts <= pts + INTERVAL 1 HOUR"), "leftOuter")
    return S.run(j.select("purchase_id", "click_id"), "append", "outer-join")


@register("stream_sql", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_stream_sql(spark, sf_dir):
    import uuid
    name = f"ev_stream_{uuid.uuid4().hex[:8]}"
    S.events_stream(spark, sf_dir).createOrReplaceTempView(name)
    agg = spark.sql(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {name} GROUP BY event_type")
    return S.run(agg, "complete", "stream-sql")


@register("stream_recover", "SELECT event_id, event_type FROM events")
def q_stream_recover(spark, sf_dir):
    """Two runs on one checkpoint: the second only reads the file added since."""
    src = scratch_path(spark, "recover-src")
    out, ckpt = scratch_path(spark, "recover-out"), scratch_path(spark, "recover-ckpt")
    ev = read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    mid = ev.select(F.percentile_approx("ts", 0.5)).first()[0]

    def run_once():
        s = spark.readStream.schema("event_id LONG, event_type STRING, ts TIMESTAMP_NTZ") \
            .option("recursiveFileLookup", True).parquet(src)
        q = s.select("event_id", "event_type").writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    ev.where(F.col("ts") < F.lit(mid)).write.mode("overwrite").parquet(f"{src}/part1")
    run_once()
    ev.where(F.col("ts") >= F.lit(mid)).write.mode("overwrite").parquet(f"{src}/part2")
    run_once()
    return spark.read.parquet(out)


@register("stream_clickstream", """
SELECT user_id % 10 AS zip, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(*) AS n
FROM events GROUP BY 1""")
def q_stream_clickstream(spark, sf_dir):
    """Error rate by zip (zip = user_id mod 10)."""
    ev = S.events_stream(spark, sf_dir)
    agg = ev.groupBy((F.col("user_id") % 10).alias("zip")).agg(
        F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"),
        F.count(F.lit(1)).alias("n"))
    return S.run(agg, "complete", "clickstream")


@register("stream_active_users")
def q_stream_active_users(spark, sf_dir):
    """Approximate distinct users per sliding hour (HLL in the stream)."""
    ev = S.events_stream(spark, sf_dir).withWatermark("ts", "10 minutes")
    agg = ev.groupBy(F.window("ts", "1 hour", "15 minutes")).agg(
        F.approx_count_distinct("user_id").alias("active_users"), F.count(F.lit(1)).alias("n"))
    return S.run(agg, "complete", "active-users")


@register("stream_progress")
def q_stream_progress(spark, sf_dir):
    progress = []
    ev = S.events_stream(spark, sf_dir).select("event_id")
    S.run(ev, "append", "progress", progress=progress)
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in progress]
    return spark.createDataFrame(rows, "batch_id LONG, num_input_rows LONG")


@register("stream_listener", """
SELECT 'started' AS callback, 1 AS n UNION ALL SELECT 'rows', count(*) FROM events
UNION ALL SELECT 'terminated', 1""")
def q_stream_listener(spark, sf_dir):
    """What a StreamingQueryListener is told of one query over the events."""
    import uuid
    heard = S.Counts(f"listened-{uuid.uuid4().hex[:8]}")
    spark.streams.addListener(heard)
    try:
        S.run(S.events_stream(spark, sf_dir).select("event_id"), "append", "listener", query_name=heard.name)
        heard.over.wait(60)      # callbacks come after the query has ended
    finally:
        spark.streams.removeListener(heard)
    return spark.createDataFrame([("started", heard.started), ("rows", heard.rows), ("terminated", heard.ended)],
                                 "callback string, n long")


@register("stream_interval", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_stream_interval(spark, sf_dir):
    """A query with an interval trigger, stopped when it has read everything;
    its sink is idempotent by epoch."""
    out = scratch_path(spark, "interval-out")
    ev = S.events_stream(spark, sf_dir).select("event_id", "event_type", "value")
    q = ev.writeStream.option("checkpointLocation", scratch_path(spark, "interval-ckpt")) \
        .foreachBatch(lambda df, epoch: S.write_epoch(df, epoch, out)).trigger(processingTime="1 second").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(ev.schema).parquet(out).groupBy("event_type") \
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("stream_append_windows", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def q_stream_append_windows(spark, sf_dir):
    """Hourly counts in append mode while the events come in four pieces: the
    watermark moves, closed windows are written once and leave the state."""
    ev = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")

    def hourly(stream):
        return stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type") \
            .agg(F.count(F.lit(1)).alias("n"))
    out = S.run_slices(S.time_slices(ev, "ts", 4), hourly, "append-windows")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@register("stream_append_sessions", f"""
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                   OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {GAP_S * 1000000}
                   THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL {GAP_S} SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def q_stream_append_sessions(spark, sf_dir):
    """Users' sessions in append mode over four pieces; sessions go on across them."""
    ev = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")

    def sessions(stream):
        return stream.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", f"{GAP_S} seconds"), "user_id") \
            .agg(F.count(F.lit(1)).alias("n"))
    out = S.run_slices(S.time_slices(ev, "ts", 4), sessions, "append-sessions")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


@register("stream_union", """
SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'view')""")
def q_stream_union(spark, sf_dir):
    ev = S.events_stream(spark, sf_dir).select("event_id", "event_type")
    u = ev.where("event_type = 'purchase'").union(ev.where("event_type = 'view'"))
    return S.run(u, "append", "union")
