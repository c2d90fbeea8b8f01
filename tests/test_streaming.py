"""Streaming jobs keep state across restarts and drop what is too late."""

import pytest
from pyspark.sql import functions as F

from wattline.lineage import fresh_dir
from wattline.streaming import jobs

SCHEMA = "period timestamp, ba_code string, demand_mw double"


def put(make, path, rows):
    make(rows, "period string, ba_code string, demand_mw double").coalesce(1).write.mode("append").parquet(path)


def test_late_row_does_not_change_the_day(spark, make):
    home = fresh_dir(spark, "late")
    src = f"{home}/in"
    put(make, src, [("2024-01-01 05:00", "A", 10.0), ("2024-01-09 00:00", "A", 1.0)])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        jobs.run_available(jobs.stream_daily(stream), f"{home}/out", f"{home}/ck")

    run()
    put(make, src, [("2024-01-01 06:00", "A", 90.0), ("2024-01-20 00:00", "A", 2.0)])
    run()
    got = {str(r.day.date()): r.peak_demand for r in spark.read.parquet(f"{home}/out").collect()}
    assert got == {"2024-01-01": 10.0, "2024-01-09": 1.0}


def test_duplicates_across_runs(spark, make):
    home = fresh_dir(spark, "dup")
    src = f"{home}/in"
    row = ("2024-01-01 05:00", "A", 10.0)
    for _ in range(2):
        put(make, src, [row, row])
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        jobs.run_available(jobs.stream_dedupe(stream, ["period", "ba_code"]), f"{home}/out", f"{home}/ck")
    assert spark.read.parquet(f"{home}/out").count() == 1


def test_spikes_use_history_of_earlier_batches(spark, make):
    from wattline.operators.features import spikes

    home = fresh_dir(spark, "spk")
    src = f"{home}/in"
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00", "A", 500.0 if h == 50 else 100.0 + h % 5) for h in range(80)]
    for part in (rows[:30], rows[30:]):
        put(make, src, part)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        jobs.run_available(jobs.stream_spikes(jobs.hourly_readings(stream)), f"{home}/out", f"{home}/ck")
    got = spark.read.parquet(f"{home}/out")
    whole = spikes(make(rows, "period string, ba_code string, demand_mw double"))
    want = {str(r.period): (r.is_spike, None if r.spike_magnitude is None else round(r.spike_magnitude, 6)) for r in whole.collect()}
    for r in got.collect():
        assert want[str(r.period)] == (r.is_spike, None if r.spike_magnitude is None else round(r.spike_magnitude, 6))
    assert got.where("is_spike").count() >= 1 and got.select("period").distinct().count() == got.count() >= 70


def test_merge_run_twice_adds_nothing(spark, make):
    home = fresh_dir(spark, "mrg")
    put(make, f"{home}/in", [("2024-01-01 05:00", "A", 10.0), ("2024-02-01 05:00", "A", 11.0)])
    for i in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{home}/in")
        jobs.stream_merge(stream, f"{home}/t", ["period", "ba_code"], f"{home}/ck{i}")
    assert spark.read.parquet(f"{home}/t").agg(F.count("*")).first()[0] == 2


ROUND = "node_id string, ba_code string, target timestamp, predicted_mw bigint, prob_bp bigint, submitted_at timestamp"


def submissions(make, path, rows):
    made = make(rows, ROUND.replace("timestamp", "string"), ("target", "submitted_at"))
    made.coalesce(1).write.mode("append").parquet(path)


def test_all_submissions_of_a_node_count_and_late_ones_do_not(spark, make):
    home = fresh_dir(spark, "rnd")
    one, two = "2024-01-01 00:00", "2024-01-01 06:00"
    submissions(make, f"{home}/in", [("n1", "A", one, 900, 10, "2024-01-01 00:05"), ("n1", "A", one, 100, 30, "2024-01-01 00:50"), ("n2", "A", one, 7, 10001, "2024-01-01 00:01"), ("n2", "A", one, 7, 5, "2024-01-01 01:00"), ("n3", "A", two, -5, 1, two), ("n4", "A", two, -2, 2, two)])
    for _ in range(2):
        stream = spark.readStream.schema(ROUND).parquet(f"{home}/in")
        jobs.run_available(jobs.stream_rounds(stream), f"{home}/out", f"{home}/ck")
        # the first round is closed by now: this changes nothing; the third closes the second
        submissions(make, f"{home}/in", [("n5", "A", one, 1, 1, one), ("n6", "A", "2024-01-02 00:00", 1, 1, one)])
    got = {str(r.target): (r.median_mw, r.median_prob_bp, r.n_submissions) for r in spark.read.parquet(f"{home}/out").collect()}
    assert got == {f"{one}:00": (500, 20, 2), f"{two}:00": (-3, 1, 2)}


def test_state_survives_a_crash_between_batches(spark, make):
    """One file a batch; the run dies in its second batch and another goes on, with all spikes as in one pass."""
    from wattline.operators.features import spikes

    home = fresh_dir(spark, "crash")
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00", a, 500.0 if h % 50 == 49 else None if h % 17 == 3 else 100.0 + h % 5) for h in range(120) for a in "AB"]
    for i in range(0, len(rows), 60):
        put(make, f"{home}/in", rows[i : i + 60])

    def run(die):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")

        def handle(batch, batch_id):
            if die and batch_id == 2:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

        jobs.run_batches(jobs.stream_spikes(jobs.hourly_readings(stream)), handle, f"{home}/ck")

    with pytest.raises(Exception, match="lost"):
        run(True)
    run(False)
    whole = {(r.period, r.ba_code): r for r in spikes(make(rows, "period string, ba_code string, demand_mw double")).collect()}
    got = spark.read.parquet(f"{home}/out").collect()
    assert len(got) == len({(r.period, r.ba_code) for r in got}) >= 230
    for r in got:
        want = whole[r.period, r.ba_code]
        assert (r.demand_mw, r.is_spike) == (want.demand_mw, want.is_spike)
        assert r.spike_magnitude == pytest.approx(want.spike_magnitude) if r.spike_magnitude is not None else want.spike_magnitude is None
    assert sum(r.is_spike for r in got) >= 2


def test_rows_behind_the_watermark_go(spark, make):
    home = fresh_dir(spark, "behind")
    for rows in ([("2024-01-05 00:00", "A", 1.0), ("2024-01-01 00:00", "A", 2.0)], [("2024-01-01 00:00", "A", 3.0), ("2024-01-04 20:00", "A", 4.0), ("2024-01-04 20:00", "A", 4.0)]):
        put(make, f"{home}/in", rows)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{home}/in")
        jobs.run_available(jobs.drop_late(stream, "12 hours"), f"{home}/out", f"{home}/ck")
    assert sorted(r.demand_mw for r in spark.read.parquet(f"{home}/out").collect()) == [1.0, 2.0, 4.0, 4.0]


def test_rounds_of_the_query_are_hours_and_every_event_counts(spark, tmp_path):
    """Two rounds of one day; the seventh event counts once, though it is sent again a month later."""
    from wattline.catalog import load

    rows = [(i, f"2024-01-01 0{h}:10:00", 12, float(v), f'{{"k": {v % 90}}}') for i, h, v in [(1, 0, 10), (2, 0, 20), (7, 0, 40), (3, 1, 5), (4, 9, 1)]]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, value double, props string")
    df.selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.target.hour: (r.median_mw, r.median_prob_bp, r.n_submissions) for r in load()[0]["stream_rounds"](spark, str(tmp_path)).collect()}
    assert got == {0: (20, 2000, 3), 1: (5, 500, 1)}
