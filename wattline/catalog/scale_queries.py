"""As-of and interval joins of large tables, rolling refits, and the daily summary kept by refreshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline import sinks
from wattline.catalog import bindings as b
from wattline.catalog.registry import query
from wattline.functions.measures import ratio
from wattline.lineage import fresh_dir, stage
from wattline.operators import asof, daily_state, intervals, places, rolling, sketches
from wattline.sources import intake

MONTH = 2_592_000


def _moment(index: str):
    """A second of the month that the events span."""
    return F.expr(f"timestamp_seconds(1704067200 + ({index}) % {MONTH})")


def _moment_sql(index: str) -> str:
    return f"(TIMESTAMP '2024-01-01' + to_seconds(({index}) % {MONTH}))"


# --- as-of --------------------------------------------------------------------------------------

_PRICES = {
    "quotes": f"SELECT {b.ba_sql('o_custkey')} AS ba_code, {_moment_sql('o_orderkey * 7919')} AS quoted, max(o_totalprice) AS price FROM orders GROUP BY 1, 2",
    "moments": "SELECT event_id, ba_code, ts FROM ev",
}


def _moments(t):
    return b.events(t).select("event_id", "ba_code", "ts")


def _quotes(t):
    return t.orders.select(b.ba("o_custkey").alias("ba_code"), _moment("o_orderkey * 7919").alias("quoted"), F.col("o_totalprice").alias("price"))


def _asof(t, **how):
    # small slices, so that many of them carry a price over
    return asof.asof_join(_moments(t), _quotes(t), ["ba_code"], "ts", "quoted", per_slice=500, **how).select("event_id", "price", "matched_at")


@query("asof_prices", "SELECT event_id, price, quoted AS matched_at FROM moments m ASOF LEFT JOIN quotes q ON m.ba_code = q.ba_code AND m.ts >= q.quoted", "price", ctes=_PRICES)
def _(t):
    return _asof(t)


@query(
    "asof_next_price",
    """SELECT event_id, CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN quoted END AS matched_at FROM (
         SELECT event_id, price, quoted, quoted <= ts + INTERVAL 10 MINUTE AS ok FROM moments m ASOF LEFT JOIN quotes q ON m.ba_code = q.ba_code AND m.ts < q.quoted)""",
    "price",
    ctes=_PRICES,
)
def _(t):
    return _asof(t, direction="forward", tolerance="10 minutes", exact=False)


@query(
    "asof_nearest_price",
    """SELECT event_id, CASE WHEN a IS NULL OR z - ts < ts - a THEN q ELSE p END AS price, CASE WHEN a IS NULL OR z - ts < ts - a THEN z ELSE a END AS matched_at FROM (
         SELECT x.event_id, x.ts, x.p, x.a, y.price AS q, y.quoted AS z FROM (
           SELECT m.event_id, m.ba_code, m.ts, q.price AS p, q.quoted AS a FROM moments m ASOF LEFT JOIN quotes q ON m.ba_code = q.ba_code AND m.ts >= q.quoted) x
         ASOF LEFT JOIN quotes y ON x.ba_code = y.ba_code AND x.ts <= y.quoted)""",
    "price",
    ctes=_PRICES,
)
def _(t):
    return _asof(t, direction="nearest")


# --- windows from a table -----------------------------------------------------------------------

_WINDOWS = {
    "wins": f"""SELECT *, w_start + to_seconds(CAST(floor(o_totalprice / 10) AS BIGINT)) AS w_end FROM (
        SELECT o_orderkey AS window_id, {b.ba_sql('o_custkey')} AS ba_code, o_orderpriority AS label, {_moment_sql('o_orderkey * 104729')} AS w_start, o_totalprice FROM orders)""",
    "marked": "SELECT DISTINCT d.period, w.label FROM (SELECT DISTINCT period FROM demand) d JOIN wins w ON d.period BETWEEN w.w_start AND w.w_end WHERE window_id % 40 = 0",
}


def _windows(t):
    start = _moment("o_orderkey * 104729")
    rows = t.orders.select(F.col("o_orderkey").alias("window_id"), b.ba("o_custkey").alias("ba_code"), F.col("o_orderpriority").alias("label"), start.alias("w_start"), "o_totalprice")
    return rows.select("window_id", "ba_code", "label", "w_start", (F.col("w_start") + F.expr("make_dt_interval(0, 0, 0, CAST(floor(o_totalprice / 10) AS DECIMAL(18, 6)))")).alias("w_end"))


@query(
    "interval_join",
    "SELECT window_id, label, count(*) AS n, avg(value) AS mean, max(ts) AS last_at FROM ev JOIN wins ON ev.ba_code = wins.ba_code AND ts BETWEEN w_start AND w_end GROUP BY 1, 2",
    "mean",
    ctes=_WINDOWS,
)
def _(t):
    points = b.events(t).select("ba_code", "ts", "value")
    totals = {"n": ("count", "*"), "known": ("count", "value"), "total": ("sum", "value"), "last_at": ("max", "ts")}
    met = intervals.interval_join(points, _windows(t), "ts", "w_start", "w_end", ["ba_code"], base="15 minutes", totals=totals)
    mean = ratio(F.sum("total"), F.sum("known").cast("double"))
    return met.groupBy("window_id", "label").agg(F.sum("n").alias("n"), mean.alias("mean"), F.max("last_at").alias("last_at"))


@query(
    "overlap_join",
    """SELECT a.window_id, count(*) AS n, min(c.window_id) AS first_other FROM wins a JOIN wins c ON a.ba_code = c.ba_code AND a.w_start <= c.w_end AND c.w_start <= a.w_end AND a.window_id <> c.window_id
       WHERE a.label = '1-URGENT' AND c.label = '5-LOW' GROUP BY 1""",
    ctes=_WINDOWS,
)
def _(t):
    w = _windows(t)
    others = w.where("label = '5-LOW'").select(F.col("window_id").alias("other"), "ba_code", F.col("w_start").alias("o_start"), F.col("w_end").alias("o_end"))
    mine, totals = w.where("label = '1-URGENT' AND window_id IS NOT NULL"), {"n": ("count", "other"), "first_other": ("min", "other")}
    ends = ("w_start", "w_end", "o_start", "o_end")
    met = intervals.overlap_join(mine, others, *ends, ["ba_code"], totals=totals)
    met = stage(met.groupBy("window_id").agg(F.sum("n").alias("n"), F.min("first_other").alias("first_other")).where("n > 0"), "overlaps")
    # an order that comes more than once can be on both sides; it does not count for itself
    own = others.withColumn("window_id", F.col("other"))
    twice = stage(mine.select("ba_code", "window_id").join(own.select("ba_code", "window_id"), ["ba_code", "window_id"], "left_semi").distinct(), "twice")
    if twice.isEmpty():
        return met
    sides = (df.join(twice, ["ba_code", "window_id"], "left_semi") for df in (mine, own))
    itself = intervals.overlap_join(*sides, *ends, ["ba_code", "window_id"], totals={"same": ("count", "other")})
    met = met.join(itself.groupBy("window_id").agg(F.sum("same").alias("same")), "window_id", "left")
    met = stage(met.select("window_id", (F.col("n") - F.coalesce("same", F.lit(0))).alias("n"), "first_other").where("n > 0"), "overlaps")
    # where the order itself is the first of those it meets, the next one counts: few, as each of those it meets comes later
    late = mine.join(met.where("window_id = first_other").select("window_id"), "window_id", "left_semi")
    others = intervals.overlap_join(late, others, *ends, ["ba_code"], base="15 minutes").where("window_id <> other")
    others = others.groupBy("window_id").agg(F.min("other").alias("next_other"))
    return met.join(others, "window_id", "left").select("window_id", "n", F.coalesce("next_other", "first_other").alias("first_other"))


@query(
    "window_separation",
    """SELECT label, avg(demand_mw) AS mean, stddev_samp(demand_mw) AS std, count(demand_mw) AS days,
              avg(demand_mw) - (SELECT avg(demand_mw) FROM demand WHERE period NOT IN (SELECT period FROM marked)) AS delta FROM demand JOIN marked USING (period) GROUP BY 1""",
    "mean std delta",
    ctes=_WINDOWS,
)
def _(t):
    # the rarer windows, so that some hours are in none
    w = _windows(t).where("window_id % 40 = 0")
    return intervals.separation_in(b.demand(t), w, "demand_mw", "label", "period", "w_start", "w_end")


@query(
    "windows_flagged",
    "SELECT period, ba_code, period IN (SELECT period FROM marked) AS in_window FROM demand",
    ctes=_WINDOWS,
)
def _(t):
    return intervals.flag_windows(b.demand(t), _windows(t).where("window_id % 40 = 0"), "period", "w_start", "w_end").select("period", "ba_code", "in_window")


# --- refits at rolling origins --------------------------------------------------------------------

_ROLLING = {
    "roll_rows": """SELECT d.period, d.ba_code, date_trunc('day', d.period)::TIMESTAMP AS origin, d.demand_mw AS y, a.demand_mw AS x1, c.demand_mw AS x2
        FROM demand d JOIN demand a ON a.ba_code = d.ba_code AND a.period = d.period - INTERVAL 24 HOUR JOIN demand c ON c.ba_code = d.ba_code AND c.period = d.period - INTERVAL 168 HOUR""",
    "roll_days": """SELECT ba_code, origin, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22,
        sum(y) AS t0, sum(x1 * y) AS t1, sum(x2 * y) AS t2, sum(y * y) AS yy FROM roll_rows GROUP BY 1, 2""",
    "roll_sums": """SELECT o.ba_code, o.origin, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(s11) AS s11, sum(s12) AS s12, sum(s22) AS s22, sum(t0) AS t0, sum(t1) AS t1, sum(t2) AS t2, sum(yy) AS yy
        FROM (SELECT DISTINCT ba_code, origin FROM roll_rows) o JOIN roll_days d ON d.ba_code = o.ba_code AND d.origin BETWEEN o.origin - INTERVAL 7 DAY AND o.origin - INTERVAL 1 DAY
        GROUP BY 1, 2 HAVING sum(n) >= 20""",
    "roll_first": "SELECT *, s11 - s1 * s1 / n AS a11, s12 - s1 * s2 / n AS a12, s22 - s2 * s2 / n AS a22, t1 - s1 * t0 / n AS b1, t2 - s2 * t0 / n AS b2 FROM roll_sums",
    "roll_second": "SELECT *, (b2 - a12 / a11 * b1) / (a22 - a12 * a12 / a11) AS w2 FROM roll_first WHERE a11 > 1e-9 * s11 AND a22 - a12 * a12 / a11 > 1e-9 * s22",
    "roll_third": "SELECT *, (b1 - a12 * w2) / a11 AS w1 FROM roll_second",
    "roll_line": "SELECT *, sqrt(greatest(yy - w0 * t0 - w1 * t1 - w2 * t2, 0) / (n - 3)) AS spread FROM (SELECT *, (t0 - s1 * w1 - s2 * w2) / n AS w0 FROM roll_third)",
    "rolled": """SELECT r.period, r.ba_code, r.origin, hour(r.period) + 1 AS horizon, y AS actual, w0 + w1 * x1 + w2 * x2 AS q50, spread FROM roll_rows r JOIN roll_line l ON l.ba_code = r.ba_code AND l.origin = r.origin""",
}


@query("rolling_refit", f"SELECT * EXCLUDE (spread), q50 - {rolling.Z90} * spread AS q10, q50 + {rolling.Z90} * spread AS q90 FROM rolled", "actual q10 q50 q90", digits=3, ctes=_ROLLING)
def _(t):
    return rolling.rolling_forecast(b.demand(t), least=20)


@query(
    "rolling_scores",
    f"""SELECT horizon, count(*) AS n, avg(abs(actual - q50)) AS mae, sqrt(avg(pow(actual - q50, 2))) AS rmse, avg(q50 - actual) AS bias,
               avg(CASE WHEN abs(actual - q50) <= {rolling.Z90} * spread THEN 1.0 ELSE 0.0 END) AS coverage FROM rolled GROUP BY 1""",
    "mae rmse bias coverage",
    digits=3,
    ctes=_ROLLING,
)
def _(t):
    return rolling.score_rolling(rolling.rolling_forecast(b.demand(t), least=20))


# --- the daily summary by refreshes ---------------------------------------------------------------

_REFRESH = {
    "sent": """SELECT *, date_trunc('day', ts)::TIMESTAMP AS day, least(2, (date_part('day', ts) - 1) // 10 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS batch FROM ev""",
    "counted": """SELECT * FROM sent s WHERE batch = 0 OR day >= (SELECT max(day) FROM sent x WHERE x.batch < s.batch) - INTERVAL 3 DAY""",
}


@query(
    "daily_refreshes",
    "SELECT day, ba_code, avg(value) AS avg_demand, max(value) AS peak_demand, min(value) AS min_demand, stddev_samp(value) AS stddev_demand FROM counted GROUP BY 1, 2",
    "avg_demand peak_demand min_demand stddev_demand",
    ctes=_REFRESH,
)
def _(t):
    rows = b.events(t).select("event_id", F.col("ts").alias("period"), "ba_code", F.col("value").alias("demand_mw"))
    # a fifth of each ten days' rows arrives with the next ten days, most of them too late
    batch = F.least(F.lit(2), F.floor((F.dayofmonth("period") - 1) / 10) + (F.col("event_id") % 5 == 0).cast("int"))
    home = fresh_dir(t.spark, "daily")
    for i in range(3):
        for _again in range(2):  # run again, it adds nothing
            daily_state.refresh(rows.where(batch == i), home, i)
    return daily_state.summary(t.spark, home)


# --- intake of text files -------------------------------------------------------------------------


def _taken(t, kind: str) -> str:
    """Events as text files, some lines spoiled, taken in two rounds."""
    home = fresh_dir(t.spark, "intake")
    e = t.events.select("event_id", "user_id", "value")
    for part in (0, 1):
        rows, spoiled = e.where(F.col("event_id") % 2 == part).repartition(3), F.col("event_id") % 50 == 0
        if kind == "csv":  # every fiftieth line has a word for a number
            rows.withColumn("value", F.when(spoiled, "none").otherwise(F.col("value").cast("string"))).write.mode("append").option("header", True).csv(f"{home}/in")
        else:  # every fiftieth line is cut short
            line = F.to_json(F.struct(*e.columns))
            rows.select(F.when(spoiled, F.expr("substring_index(to_json(struct(event_id, user_id, value)), ',', 2)")).otherwise(line).alias("value")).write.mode("append").text(f"{home}/in")
        for _again in range(2):
            intake.intake(t.spark, f"{home}/in", f"{home}/out", "event_id bigint, user_id bigint, value double", kind, files=2)
    return f"{home}/out"


_GOOD = "SELECT event_id, user_id, value FROM events WHERE event_id % 50 <> 0"


@query("intake_csv", _GOOD, "value")
def _(t):
    return intake.good(t.spark, _taken(t, "csv")).select("event_id", "user_id", "value")


@query("intake_json", _GOOD, "value")
def _(t):
    return intake.good(t.spark, _taken(t, "json")).select("event_id", "user_id", "value")


@query(
    "intake_counts",
    """SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS n_good, count(*) FILTER (WHERE event_id % 50 = 0) AS n_bad, count(*) FILTER (WHERE event_id % 50 = 0) AS n_lines FROM events""",
)
def _(t):
    home = _taken(t, "csv")
    counts = intake.ledger(t.spark, home).where("status = 'completed'").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))
    return counts.crossJoin(intake.bad(t.spark, home).agg(F.count("*").alias("n_lines")))


# --- places ---------------------------------------------------------------------------------------

_PLACES = {
    "spots": "SELECT event_id, ((event_id * 7919) % 18001) / 100.0 - 90 AS lat, ((event_id * 104729) % 36001) / 100.0 - 180 AS lon FROM events",
    "centres": "SELECT c_custkey AS centre, ((c_custkey * 15485863) % 18001) / 100.0 - 90 AS clat, ((c_custkey * 32452843) % 36001) / 100.0 - 180 AS clon FROM customer",
    "far": f"""SELECT centre, event_id, 2 * {places.RADIUS_KM} * asin(sqrt(least(1, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) AS km
               FROM spots JOIN centres ON abs(lat - clat) < 3""",
}


@query("radius_join", "SELECT centre, count(*) AS n, min(km) AS nearest, max(event_id) AS last_event FROM far WHERE km <= 250 GROUP BY 1", "nearest", ctes=_PLACES)
def _(t):
    spots = t.events.select("event_id", F.expr("((event_id * 7919) % 18001) / 100.0D - 90").alias("lat"), F.expr("((event_id * 104729) % 36001) / 100.0D - 180").alias("lon"))
    centres = t.customer.select(F.col("c_custkey").alias("centre"), F.expr("((c_custkey * 15485863) % 18001) / 100.0D - 90").alias("centre_lat"), F.expr("((c_custkey * 32452843) % 36001) / 100.0D - 180").alias("centre_lon"))
    met = places.radius_join(spots, centres, 250, totals={"n": ("count", "*"), "nearest": ("min", "distance_km"), "last_event": ("max", "event_id")})
    return met.groupBy("centre").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.max("last_event").alias("last_event"))


# --- sketches -------------------------------------------------------------------------------------


@query(
    "monthly_sketches",
    """SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS exact, TRUE AS distinct_ok, TRUE AS median_ok, TRUE AS p99_ok FROM orders
       WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01' GROUP BY 1""",
)
def _(t):
    """Sketches of every month, stored; three years of them merged and held against the exact figures."""
    stored = stage(sketches.monthly(t.orders, ["o_orderstatus"], "o_custkey", "o_totalprice", "o_orderdate"), "sketches")
    some = stored.where("month BETWEEN '1996-01' AND '1998-12'")
    guess = sketches.distinct_count(some, ["o_orderstatus"])
    q = sketches.quantiles(some, ["o_orderstatus"], [0.5, 0.99]).groupBy("o_orderstatus").pivot("q", [0.5, 0.99]).agg(F.first("value"))
    rows = t.orders.where("o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01'")
    exact = rows.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("exact"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice)").alias("median"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY o_totalprice)").alias("p99"))
    slack = sketches.QUANTILE_ERROR * 1.0001
    both = exact.join(guess, "o_orderstatus").join(q, "o_orderstatus")
    return both.select(
        F.col("o_orderstatus").alias("status"), "exact", (F.abs(F.col("n_distinct") - F.col("exact")) <= 3 * sketches.DISTINCT_ERROR * F.col("exact") + 1).alias("distinct_ok"),
        (F.abs(F.col("`0.5`") - F.col("median")) <= slack * F.col("median")).alias("median_ok"), (F.abs(F.col("`0.99`") - F.col("p99")) <= slack * F.col("p99")).alias("p99_ok"),
    )


# --- tables dealt alike ---------------------------------------------------------------------------


@query(
    "bucketed_join",
    """SELECT period, ba_code, demand_mw, n_events, last_value FROM demand
       JOIN (SELECT period, ba_code, count(*) AS n_events FROM ev GROUP BY 1, 2) USING (period, ba_code)
       LEFT JOIN (SELECT period, ba_code, max(value) AS last_value FROM ev WHERE event_type = 'click' GROUP BY 1, 2) USING (period, ba_code)""",
    "demand_mw last_value",
)
def _(t):
    home, keys, e = fresh_dir(t.spark, "bucketed"), ["ba_code", "period"], b.events(t)
    parts = {
        "demand": b.demand(t).select("period", "ba_code", "demand_mw"),
        "counts": e.groupBy("period", "ba_code").agg(F.count("*").alias("n_events")),
        "clicks": e.where("event_type = 'click'").groupBy("period", "ba_code").agg(F.max("value").alias("last_value")),
    }
    d, c, k = (sinks.write_bucketed(df, f"{home}/{name}", keys, 8) for name, df in parts.items())
    return d.join(c, keys).join(k, keys, "left").select("period", "ba_code", "demand_mw", "n_events", "last_value")
