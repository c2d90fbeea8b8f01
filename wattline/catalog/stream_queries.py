"""Streaming jobs run over the shared tables; windows still open at the end are left out in the SQL too."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.catalog import bindings as b
from wattline.catalog.registry import query
from wattline.lineage import fresh_dir
from wattline.streaming import jobs


def _stream(t, name):
    """The table as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}*.parquet")


def _events(t):
    return _stream(t, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("period"), b.ba("user_id").alias("ba_code"), "user_id", "event_type", F.col("value").alias("demand_mw"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _news(t):
    base = _stream(t, "documents")

    class Docs:
        documents = base

    return b.news(Docs)


def _drain(t, df, mode="append"):
    home = fresh_dir(t.spark, "stream")
    jobs.run_available(df, f"{home}/out", f"{home}/checkpoint", mode)
    return t.spark.read.parquet(f"{home}/out")


@query(
    "stream_daily_summary",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS day, ba_code, avg(value) AS avg_demand, max(value) AS peak_demand, min(value) AS min_demand, stddev_samp(value) AS stddev_demand
       FROM ev WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY 1, 2""",
    "avg_demand peak_demand min_demand stddev_demand",
)
def _(t):
    return _drain(t, jobs.stream_daily(_events(t)))


@query("stream_dedupe", "SELECT event_id, ba_code FROM ev")
def _(t):
    e = _events(t).select("event_id", "period", "ba_code")
    # every row arrives twice
    return _drain(t, jobs.stream_dedupe(e.unionByName(e), ["event_id"])).select("event_id", "ba_code")


_STREAM_NEWS = {
    "stold": "SELECT event_time, event_type, sentiment_score, risk_magnitude, unnest(list_distinct(ba_codes)) AS ba_code FROM news",
    "stop": "SELECT max(event_time) - INTERVAL 1 HOUR AS mark FROM news",
}


@query(
    "stream_risk_hourly",
    """SELECT date_trunc('hour', event_time) AS hour, ba_code, avg(sentiment_score) AS avg_sentiment, min(sentiment_score) AS min_sentiment, max(risk_magnitude) AS max_risk,
              count(*) FILTER (WHERE event_type = 'SUPPLY_DISRUPTION') AS disruption_count, count(*) FILTER (WHERE event_type = 'POLICY') AS policy_count, count(*) AS total_events
       FROM stold WHERE date_trunc('hour', event_time) + INTERVAL 1 HOUR <= (SELECT mark FROM stop) GROUP BY 1, 2""",
    "avg_sentiment min_sentiment max_risk",
    ctes=_STREAM_NEWS,
)
def _(t):
    return _drain(t, jobs.stream_risk_hourly(_news(t)))


@query(
    "stream_news_24h",
    """SELECT h + to_hours(CAST(i AS INTEGER)) AS period, ba_code, avg(sentiment_score) AS news_sentiment_24h, max(risk_magnitude) AS news_max_risk_24h, count(*) AS news_event_count_24h,
              bool_or(event_type = 'SUPPLY_DISRUPTION') AS supply_disruption_24h
       FROM (SELECT *, date_trunc('hour', event_time) AS h FROM stold) JOIN (SELECT unnest(range(1, 25)) AS i) ON TRUE
       WHERE h + to_hours(CAST(i AS INTEGER)) <= (SELECT mark FROM stop) GROUP BY 1, 2""",
    "news_sentiment_24h news_max_risk_24h",
    ctes=_STREAM_NEWS,
)
def _(t):
    return _drain(t, jobs.stream_news_24h(_news(t)))


@query(
    "stream_episodes",
    """SELECT min(ts) AS first_time, max(ts) + INTERVAL 4 HOUR AS closed_at, ba_code, count(*) AS n_spikes, max(value) AS peak_mw FROM (
         SELECT *, sum(CASE WHEN prev IS NOT NULL AND ts < prev + INTERVAL 4 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY ba_code ORDER BY ts) AS grp FROM (
           SELECT *, lag(ts) OVER (PARTITION BY ba_code ORDER BY ts) AS prev FROM ev WHERE value > 80))
       GROUP BY ba_code, grp HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM ev WHERE value > 80) - INTERVAL 1 HOUR""",
    "peak_mw",
)
def _(t):
    return _drain(t, jobs.stream_episodes(_events(t).where("demand_mw > 80"), gap="4 hours"))


@query("stream_merge", "SELECT event_id, ba_code, value AS demand_mw FROM ev", "demand_mw")
def _(t):
    home = fresh_dir(t.spark, "merge")
    e = _events(t).select("event_id", "period", "ba_code", "demand_mw")
    # two runs with their own checkpoints: the second must add nothing
    for i in range(2):
        jobs.stream_merge(e, f"{home}/table", ["event_id"], f"{home}/checkpoint{i}")
    return t.spark.read.parquet(f"{home}/table").select("event_id", "ba_code", "demand_mw")


@query("stream_resume", "SELECT event_id, value AS demand_mw FROM ev", "demand_mw")
def _(t):
    home = fresh_dir(t.spark, "resume")
    e = _events(t).select("event_id", "demand_mw")
    # the second start finds its checkpoint and reads nothing twice
    for _i in range(2):
        jobs.run_available(e, f"{home}/out", f"{home}/checkpoint")
    return t.spark.read.parquet(f"{home}/out")


@query(
    "stream_spikes",
    """SELECT period, ba_code, demand_mw, coalesce(abs(demand_mw - m) > 2 * s AND s > 1e-9, FALSE) AS is_spike, abs(demand_mw - m) / CASE WHEN s > 1e-9 THEN s END AS spike_magnitude FROM (
         SELECT period, ba_code, demand_mw, avg(demand_mw) OVER w AS m, stddev_samp(demand_mw) OVER w AS s FROM demand
         WHERE period + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR WINDOW w AS (PARTITION BY ba_code ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""",
    "demand_mw spike_magnitude",
)
def _(t):
    return _drain(t, jobs.stream_spikes(jobs.hourly_readings(_events(t))))


@query(
    "stream_rounds",
    """SELECT ba_code, target, CASE WHEN n % 2 = 1 THEN m[(n + 1) // 2] ELSE (m[n // 2] + m[n // 2 + 1]) // 2 END::BIGINT AS median_mw,
              CASE WHEN n % 2 = 1 THEN p[(n + 1) // 2] ELSE (p[n // 2] + p[n // 2 + 1]) // 2 END::BIGINT AS median_prob_bp, n AS n_submissions FROM (
         SELECT ba_code, target, list_sort(list(mw)) AS m, list_sort(list(prob)) AS p, count(*) AS n FROM (
           SELECT user_id AS node_id, ba_code, period AS target, CAST(floor(value) AS BIGINT) AS mw, k * 100 AS prob FROM ev) GROUP BY 1, 2)
       WHERE target + INTERVAL 1 HOUR <= (SELECT max(period) FROM ev) - INTERVAL 1 HOUR""",
)
def _(t):
    # a node sends as often as it likes, and all it sends counts; every seventh submission is sent again a month after its round has closed and must not count twice
    again = F.when(F.col("event_id") % 7 == 0, F.array("period", F.col("period") + F.expr("INTERVAL 30 DAY"))).otherwise(F.array("period"))
    s = _events(t).withColumn("period", F.date_trunc("hour", "period")).select(
        F.col("user_id").alias("node_id"), "ba_code", F.col("period").alias("target"), F.floor("demand_mw").cast("bigint").alias("predicted_mw"),
        (F.col("k") * 100).cast("bigint").alias("prob_bp"), F.explode(again).alias("submitted_at"),
    )
    return _drain(t, jobs.stream_rounds(s)).select("ba_code", "target", "median_mw", "median_prob_bp", "n_submissions")


@query(
    "stream_drop_late",
    """SELECT event_id, ts::TIMESTAMP AS period FROM events
       UNION ALL SELECT event_id, ts::TIMESTAMP FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 36 HOUR""",
)
def _(t):
    home = fresh_dir(t.spark, "late")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("period"))
    out = None
    # the same rows arrive again in a second run, most of them late by then
    for i in range(2):
        rows.write.mode("append").parquet(f"{home}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{home}/in")
        jobs.run_available(jobs.drop_late(stream, "36 hours"), f"{home}/out", f"{home}/checkpoint")
        out = t.spark.read.parquet(f"{home}/out")
    return out
