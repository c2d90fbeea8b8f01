"""As-of and interval joins, rolling refits and the refreshed daily summary against plain Python."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.lineage import fresh_dir
from wattline.operators import asof, daily_state, intervals, rolling

DAY = dt.datetime(2024, 1, 1)


def at(minute):
    return None if minute is None else str(DAY + dt.timedelta(minutes=int(minute)))


def minutes(t):
    return None if t is None else int((t - DAY).total_seconds() // 60)


@pytest.fixture(scope="module")
def two_sides():
    rng = np.random.default_rng(3)
    left = [(i, "ABC"[rng.integers(0, 3)], int(rng.integers(0, 900))) for i in range(300)] + [(900, None, 5), (901, "A", None), (902, "D", 7)]
    # the middle of the day has no prices, so they are carried over many slices
    right = [("AB"[rng.integers(0, 2)], int(rng.choice([rng.integers(0, 200), rng.integers(700, 900)])), None if rng.random() < 0.1 else float(i)) for i in range(120)] + [(None, 3, 1.0), ("A", None, 2.0)]
    return left, right


@pytest.mark.parametrize("direction,tolerance,exact", [("backward", None, True), ("backward", 60, False), ("forward", None, True), ("forward", 30, False), ("nearest", 45, True)])
def test_asof_as_brute_force(make, two_sides, direction, tolerance, exact):
    left, right = two_sides
    lefts = make([(i, k, at(t)) for i, k, t in left], "id int, ba_code string, ts string", ("ts",))
    rights = make([(k, at(t), p) for k, t, p in right], "ba_code string, seen string, price double", ("seen",))
    found = asof.asof_join(lefts, rights, ["ba_code"], "ts", "seen", direction=direction, tolerance=tolerance and f"{tolerance} minutes", exact=exact, per_slice=5)
    got = {r.id: (r.price, minutes(r.matched_at)) for r in found.collect()}
    for i, k, t in left:
        best = None
        for k2, t2, p in right:
            if k is None or k != k2 or t is None or t2 is None or (tolerance and abs(t2 - t) > tolerance) or (not exact and t == t2):
                continue
            if (direction == "backward" and t2 > t) or (direction == "forward" and t2 < t):
                continue
            rank = (-abs(t2 - t), t2 <= t, p is not None, p or 0)
            best = max(best or (rank, p, t2), (rank, p, t2), key=lambda x: x[0])
        assert got[i] == ((best[1], best[2]) if best else (None, None)), (i, k, t)
    assert len(got) == len(left)


def test_asof_spreads_a_large_key_and_broadcasts_nothing(spark):
    rows = spark.range(20_000).select(F.lit("A").alias("ba_code"), F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("ts"), F.col("id").alias("v"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = asof.asof_join(rows.select("ba_code", "ts"), rows.where("v % 50 = 0"), ["ba_code"], "ts", per_slice=500)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 10_000
    with pytest.raises(ValueError):
        asof.asof_join(rows, rows, ["ba_code"], "ts")


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_interval_join_as_brute_force(make, closed):
    rng = np.random.default_rng(4)
    points = [(i, "AB"[i % 2], int(rng.integers(-500, 2000))) for i in range(200)] + [(500, "A", None), (501, None, 5)]
    starts = rng.integers(-600, 2000, 60)
    windows = [(i, "AB"[i % 2], int(a), int(a + rng.choice([0, 1, 14, 15, 16, 120, 1500]))) for i, a in enumerate(starts)] + [(90, "A", 5, 4), (91, "A", None, 9), (92, "B", 9, None)]
    p = make([(i, k, at(t)) for i, k, t in points], "id int, ba_code string, ts string", ("ts",))
    w = make([(i, k, at(a), at(z)) for i, k, a, z in windows], "win int, ba_code string, start string, end string", ("start", "end"))
    met = intervals.interval_join(p, w, "ts", by=["ba_code"], base="15 minutes", closed=closed)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    low, high = closed in ("both", "left"), closed in ("both", "right")
    wanted = sorted((i, n) for i, k, t in points for n, k2, a, z in windows if k == k2 and None not in (k, t, a, z) and (a < t or low and a == t) and (t < z or high and t == z) and a <= z)
    assert sorted((r.id, r.win) for r in met.collect()) == wanted


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_interval_totals_as_brute_force(make, monkeypatch, closed):
    monkeypatch.setattr(intervals, "PER_BUCKET", 2)
    rng = np.random.default_rng(14)
    points = [("AB"[i % 2], int(rng.integers(-900, 3000)), None if i % 9 == 0 else float(i)) for i in range(400)] + [("A", None, 1.0), (None, 5, 1.0)]
    starts = rng.integers(-1000, 3000, 80)
    windows = [(i, "AB"[i % 2], int(a), int(a + rng.choice([0, 1, 7, 15, 64, 500, 4000]))) for i, a in enumerate(starts)] + [(0, "A", *windows_end) for windows_end in ((5, 4), (None, 9), (9, None))] + [(3, "B", 0, 2000)]
    p = make([(k, at(t), v) for k, t, v in points], "ba_code string, ts string, v double", ("ts",))
    w = make([(i, k, at(a), at(z)) for i, k, a, z in windows], "win int, ba_code string, start string, end string", ("start", "end"))
    met = intervals.interval_join(p, w, "ts", by=["ba_code"], closed=closed, totals={"n": ("count", "*"), "k": ("count", "v"), "s": ("sum", "v"), "x": ("max", "ts")})
    got = {r.win: (r.n, r.k, r.s, minutes(r.x)) for r in met.groupBy("win").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.max("x").alias("x")).collect()}
    low, high = closed in ("both", "left"), closed in ("both", "right")
    held = {}
    for n, k2, a, z in windows:
        held.setdefault(n, []).extend((t, v) for k, t, v in points if k == k2 and None not in (k, t, a, z) and (a < t or low and a == t) and (t < z or high and t == z) and a <= z)
    known = {n: [v for _, v in h if v is not None] for n, h in held.items()}
    assert got == {n: (len(h), len(known[n]), sum(known[n]) if known[n] else None, max(t for t, _ in h)) for n, h in held.items() if h}
    # a window's rows don't grow with its points
    assert met.groupBy("win", "start").count().agg(F.max("count")).first()[0] < 60 < max(n for n, *_ in got.values())


def test_overlaps_and_flags(make):
    rng = np.random.default_rng(5)

    def some(n):
        return [(i, int(a), int(a + rng.choice([0, 3, 61, 600]))) for i, a in enumerate(rng.integers(-200, 3000, n))]

    a, b = some(60), some(50)
    left = make([(i, at(x), at(y)) for i, x, y in a], "l int, start string, end string", ("start", "end"))
    right = make([(i, at(x), at(y)) for i, x, y in b], "r int, other_start string, other_end string", ("other_start", "other_end"))
    wanted = sorted((i, j) for i, x, y in a for j, u, v in b if x <= v and u <= y)
    assert sorted((r.l, r.r) for r in intervals.overlap_join(left, right).collect()) == wanted
    points = make([(at(m), float(m or 0)) for m in [*range(-300, 3700, 37), None]], "period string, v double")
    flags = {minutes(r.period): r.in_window for r in intervals.flag_windows(points, left).collect()}
    assert flags == {m: m is not None and any(x <= m <= y for _, x, y in a) for m in [*range(-300, 3700, 37), None]}
    none = left.where("false")
    assert not any(r.in_window for r in intervals.flag_windows(points, none).collect()) and intervals.overlap_join(none, right).count() == 0


def test_overlap_totals_as_brute_force(make, monkeypatch):
    monkeypatch.setattr(intervals, "PER_BUCKET", 2)
    rng = np.random.default_rng(15)

    def some(n):
        rows = [(i, "AB"[i % 2], int(a), int(a + rng.choice([0, 1, 7, 61, 600, 4000]))) for i, a in enumerate(rng.integers(-200, 3000, n))]
        return rows + [rows[0], rows[1], (n, None, 5, 9), (n + 1, "A", None, 9), (n + 2, "A", 9, None), (n + 3, "B", 9, 4)]

    a, b = some(90), [(None if i % 13 == 0 else i, *more) for i, *more in some(70)]
    left = make([(i, k, at(x), at(y)) for i, k, x, y in a], "l int, ba_code string, start string, end string", ("start", "end"))
    right = make([(i, k, at(x), at(y)) for i, k, x, y in b], "r int, ba_code string, other_start string, other_end string", ("other_start", "other_end"))
    met = intervals.overlap_join(left, right, by=["ba_code"], totals={"n": ("count", "*"), "known": ("count", "r"), "first": ("min", "r")})
    got = {r.l: (r.n, r.known, r.first) for r in met.groupBy("l").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.min("first").alias("first")).collect()}
    met_by = {}
    for i, k, x, y in a:
        met_by.setdefault(i, []).extend(j for j, k2, u, v in b if k == k2 and None not in (k, x, y, u, v) and x <= y and u <= v and x <= v and u <= y)
    known = {i: [j for j in js if j is not None] for i, js in met_by.items()}
    assert got == {i: (len(js), len(known[i]), min(known[i], default=None)) for i, js in met_by.items() if js}
    # rows don't grow with what is overlapped
    assert met.groupBy("l", "start").count().agg(F.max("count")).first()[0] < 60 and max(n for n, *_ in got.values()) > 25


def test_an_order_on_both_sides_does_not_overlap_itself(spark):
    from wattline.catalog import bindings, scale_queries  # noqa: F401
    from wattline.catalog.registry import QUERIES

    rng = np.random.default_rng(16)
    # few keys, so that many come on both sides, and long windows
    rows = [(int(rng.integers(1, 40)), int(rng.integers(0, 3)), ["1-URGENT", "5-LOW", "3-MEDIUM"][rng.integers(0, 3)], float(rng.integers(10, 9_000_000))) for _ in range(200)] + [(None, 1, "1-URGENT", 9e6), (None, 1, "5-LOW", 9e6)]
    folder = fresh_dir(spark, "both")
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double")
    frame.write.parquet(f"{folder}/orders.parquet")
    area = {r.o_custkey: r.ba for r in frame.select("o_custkey", bindings.ba("o_custkey").alias("ba")).distinct().collect()}
    timed = [(k, area[c], p, k * 104729 % scale_queries.MONTH, k * 104729 % scale_queries.MONTH + int(v // 10)) for k, c, p, v in rows if k is not None]
    wanted = {}
    for k, c, p, x, y in timed:
        for j, c2, p2, u, v in timed:
            if p == "1-URGENT" and p2 == "5-LOW" and c == c2 and k != j and x <= v and u <= y:
                wanted.setdefault(k, []).append(j)
    got = {r.window_id: (r.n, r.first_other) for r in QUERIES["overlap_join"](spark, folder).collect()}
    assert got == {k: (len(js), min(js)) for k, js in wanted.items()} and any(js[0] > k for k, js in wanted.items())


def test_rolling_refit_as_least_squares(make):
    rng = np.random.default_rng(6)
    value = {(h, a): 50 + 20 * np.sin(h / 3.8) + 5 * (h // 24 % 7) + rng.normal() for h in range(24 * 20) for a in "AB" if rng.random() < 0.95}
    panel = make([(at(60 * h), a, float(v)) for (h, a), v in value.items()], "period string, ba_code string, demand_mw double")
    got = rolling.rolling_forecast(panel, least=60).collect()
    for day, area in ((11, "A"), (14, "B"), (19, "A")):
        def row(h):
            x = [value.get((h - n, area)) for n in (24, 168)]
            return None if None in x else [1.0, *x]

        train = [(row(h), value[h, area]) for h in range(24 * (day - 7), 24 * day) if (h, area) in value and row(h)]
        x, y = np.array([r for r, _ in train]), np.array([v for _, v in train])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        spread = np.sqrt(((y - x @ beta) ** 2).sum() / (len(y) - 3))
        wanted = {h - 24 * day + 1: (np.array(row(h)) @ beta, value[h, area]) for h in range(24 * day, 24 * day + 24) if (h, area) in value and row(h)}
        mine = {r.horizon: r for r in got if r.ba_code == area and minutes(r.origin) == 1440 * day}
        assert mine.keys() == wanted.keys()
        for h, (line, actual) in wanted.items():
            assert (mine[h].q50, mine[h].actual, mine[h].q90 - mine[h].q50) == pytest.approx((line, actual, rolling.Z90 * spread))
    # constant lags have no unique line
    flat = make([(at(60 * h), "A", 5.0) for h in range(24 * 16)], "period string, ba_code string, demand_mw double")
    assert rolling.rolling_forecast(flat).count() == 0


def test_refreshes_equal_a_rebuild_and_touch_only_their_days(spark, make):
    home = fresh_dir(spark, "daily")
    schema = "period string, ba_code string, demand_mw double"
    batches = [
        [(at(1440 * d + 60 * h), "A", 1e6 + d * h) for d in range(6) for h in range(5)],
        [(at(1440 * 4 + 7), "A", None), (at(1440 * 3 + 7), "B", -4.0), (at(1440 * 1 + 7), "A", 9e9), (at(1440 * 7), "A", 2.0)],
        [(at(1440 * 4 + 9), "A", 1e6), (at(1440 * 3 + 9), "A", 8e9), (None, "A", 1.0)],
    ]

    def files():
        return {p: os.stat(p).st_mtime_ns for d, _, f in os.walk(f"{home.removeprefix('file:')}/states") for p in (f"{d}/{n}" for n in f) if "day=" in p and p.endswith(".parquet")}

    seen = []
    for i, rows in enumerate(batches):
        before = files()
        daily_state.refresh(make(rows, schema), home, i)
        seen.append({p.split("day=")[1][:10] for p, m in files().items() if before.get(p) != m})
        daily_state.refresh(make(rows, schema), home, i)
    assert seen[1] == {"2024-01-04", "2024-01-05", "2024-01-08"} and seen[2] == {"2024-01-05"}
    # of the second batch one row, of the third two came too late
    kept = batches[0] + [batches[1][i] for i in (0, 1, 3)] + batches[2][:1]
    want = {(r.day, r.ba_code): r for r in make(kept, schema).groupBy(F.date_trunc("day", "period").alias("day"), "ba_code").agg(F.avg("demand_mw").alias("a"), F.max("demand_mw").alias("x"), F.min("demand_mw").alias("n"), F.stddev_samp("demand_mw").alias("s")).collect()}
    got = {(r.day, r.ba_code): r for r in daily_state.summary(spark, home).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.avg_demand, r.peak_demand, r.min_demand) == pytest.approx((want[k].a, want[k].x, want[k].n))
        assert (r.stddev_demand is None) == (want[k].s is None) and (want[k].s is None or r.stddev_demand == pytest.approx(want[k].s, rel=1e-6))
    late = daily_state.log(spark, home).where("NOT counted").agg(F.sum("n_rows")).first()[0]
    assert late == 2
    plan = daily_state.states(spark, home).where(F.col("day").isin([dt.date(2024, 1, 5)]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan


def test_bad_lines_keep_file_and_offset(spark, tmp_path, monkeypatch):
    from wattline.sources import intake

    source, home, schema = tmp_path / "in", str(tmp_path / "out"), "hour string, mw double"
    source.mkdir()
    one = b"hour,mw\n2024-01-01T00,1.5\nshort\r\n2024-01-01T01,2.5\r\n\n2024-01-01T02,many,more\n2024-01-01T03,x\n2024-01-01T04,4"
    (source / "a.csv").write_bytes(one)
    (source / "b.csv").write_bytes(b"hour,mw\n" + b"".join(b"h\xc3\xa9%d,%d\n" % (i, i) if i % 7 else b"cut%d\n" % i for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # files are read in pieces
    try:
        with monkeypatch.context() as m:  # broken off before the ledger says that the batch is done
            m.setattr(intake, "bad", None)
            write = intake.parsed
            m.setattr(intake, "parsed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                intake.intake(spark, str(source), home, schema)
            assert write is not intake.parsed
        intake.intake(spark, str(source), home, schema)
        (source / "c.csv").write_bytes(b"hour,mw\nlate,9\n")
        intake.intake(spark, str(source), home, schema)
        intake.intake(spark, str(source), home, schema)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    bad = intake.bad(spark, home).collect()
    for r in bad:
        raw = (source / r.file.split("/")[-1]).read_bytes()
        assert raw[r.at :].startswith(r.line.encode()) and (r.at == 0 or raw[r.at - 1 : r.at] == b"\n")
    lines = sorted(r.line for r in bad if r.file.endswith("a.csv"))
    assert lines == ["2024-01-01T02,many,more", "2024-01-01T03,x", "short"] and len(bad) == 3 + 58
    got = intake.good(spark, home).collect()
    assert sorted(r.mw for r in got if r.source_file.endswith("a.csv")) == [1.5, 2.5, 4.0]
    counts = {r.file.split("/")[-1]: (r.n_good, r.n_bad) for r in intake.ledger(spark, home).where("status = 'completed'").collect()}
    assert counts == {"a.csv": (3, 3), "b.csv": (342, 58), "c.csv": (1, 0)} and len(got) == 346


def test_truncated_json_goes_aside(spark, tmp_path):
    from wattline.sources import intake

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b"\n[]\n{"a": "no"}\n{"b": "only"}\n')
    intake.intake(spark, str(tmp_path / "in"), str(tmp_path / "out"), "a bigint, b string", "json")
    assert sorted((r.a, r.b) for r in intake.good(spark, str(tmp_path / "out")).collect() if r.a) == [(1, "x")]
    assert '{"a": 2, "b"' in [r.line for r in intake.bad(spark, str(tmp_path / "out")).collect()]


def test_radius_join_over_poles_and_date_line(spark):
    import math

    from wattline.operators import places

    rng = np.random.default_rng(7)

    def some(n, tag):
        lat = np.concatenate([rng.uniform(-90, 90, n), [90, -90, 89.5, -89.5, 89.9, 0, 0, 10]])
        lon = np.concatenate([rng.uniform(-180, 180, n), [0, 50, 179, -179, 10, 180, -180, 179.9]])
        return [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))] + [(tag, None, 3.0), (tag + 1, 91.0, 0.0)]

    points, centres = some(500, 9000), some(120, 9000)
    p, c = spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(centres, "c int, centre_lat double, centre_lon double")
    for km in (60, 900):
        def far(a, o, b, u):
            h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(u - o) / 2) ** 2
            return 2 * places.RADIUS_KM * math.asin(math.sqrt(min(h, 1)))

        wanted = sorted((i, j) for i, a, o in points for j, b, u in centres if None not in (a, b) and abs(a) <= 90 and abs(b) <= 90 and far(a, o, b, u) <= km)
        met = places.radius_join(p, c, km)
        assert sorted((r.p, r.c) for r in met.collect()) == wanted and wanted
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_totals_of_a_radius_are_those_of_its_pairs(spark, monkeypatch):
    from wattline.operators import places

    rng = np.random.default_rng(9)

    def some(n):
        lat = np.concatenate([rng.uniform(-90, 90, n), rng.uniform(86, 90, n // 2), np.full(40, 12.5), [90, -90]])
        lon = np.concatenate([rng.uniform(-180, 180, n + n // 2), np.full(40, 180.0), [0, 50]])
        return [(i if i % 5 else None, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))] + [(7, None, 3.0), (8, 91.0, 0.0)]

    p = spark.createDataFrame(some(600), "p int, lat double, lon double")
    c = spark.createDataFrame(some(150) + some(3), "c int, centre_lat double, centre_lon double")
    totals = {"n": ("count", "*"), "known": ("count", "p"), "first": ("min", "p"), "last": ("max", "p"), "nearest": ("min", "distance_km")}
    by = ["c", "centre_lat", "centre_lon"]
    wanted = places.radius_join(p, c, 700).groupBy(*by).agg(F.count("*").alias("n"), F.count("p").alias("known"), F.min("p").alias("first"), F.max("p").alias("last"), F.min("distance_km").alias("nearest"))

    def rows(df):
        return sorted(((r.c, round(r.centre_lat, 9), r.centre_lon), r.n, r.known, r.first, r.last, round(r.nearest, 6)) for r in df.collect() if r.c is not None)

    assert rows(wanted)
    for dense, points, centres in ((1, 7, 5), (1, 1 << 15, 1 << 13), (1 << 40, 1, 1), (60, 50, 20)):
        monkeypatch.setattr(places, "DENSE", dense), monkeypatch.setattr(places, "POINTS", points), monkeypatch.setattr(places, "CENTRES", centres)
        met = places.radius_join(p, c, 700, totals=totals)
        got = met.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("nearest").alias("nearest"))
        assert rows(got) == rows(wanted)


def test_sketches_merge_within_their_bounds(spark):
    from wattline.operators import sketches

    rng = np.random.default_rng(8)
    rows = [(f"2024-{1 + i % 6:02d}-03 00:00:00", "A", int(rng.integers(0, 5000)), float(np.round(rng.lognormal(3, 2) * rng.choice([1, 1, 1, -1, 0]), 3))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "period string, ba_code string, item int, v double").withColumn("period", F.col("period").cast("timestamp"))
    stored = sketches.monthly(df, ["ba_code"], "item", "v")
    for months in (["2024-02"], [f"2024-{m:02d}" for m in range(1, 7)]):
        kept = [r for r in rows if r[0][:7] in months]
        some = stored.where(F.col("month").isin(months))
        exact = len({r[2] for r in kept})
        assert abs(sketches.distinct_count(some, ["ba_code"]).first().n_distinct - exact) <= 3 * sketches.DISTINCT_ERROR * exact
        values = sorted(r[3] for r in kept)
        for r in sketches.quantiles(some, ["ba_code"], [0.01, 0.3, 0.5, 0.9, 1.0]).collect():
            true = values[max(math.ceil(r.q * len(values) - 1e-9), 1) - 1]
            assert abs(r.value - true) <= sketches.QUANTILE_ERROR * abs(true) * 1.0001


def test_tables_dealt_alike_join_without_exchange(spark, tmp_path):
    from wattline import sinks

    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("ba_code"), F.timestamp_seconds(F.col("id") * 3600).alias("period"), F.col("id").alias("v"))
    keys = ["ba_code", "period"]
    tables = [sinks.write_bucketed(rows.withColumnRenamed("v", f"v{i}"), str(tmp_path / f"t{i}"), keys, 4) for i in range(2)]
    tables.append(sinks.read_bucketed(spark, str(tmp_path / "t0"), "ba_code string, period timestamp, v0 bigint", keys, 4).withColumnRenamed("v0", "v2"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables[0].join(tables[1], keys).join(tables[2], keys)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        assert joined.where("v0 = v1 AND v1 = v2").count() == joined.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
