"""Distributed ranks and percentiles are exact."""

import random

import numpy as np
import pandas as pd
import pytest

from wattline.operators import ranks


def skewed(spark, n=4000, seed=1):
    rng = random.Random(seed)
    # one key holds most rows, and one value holds a third of that key
    rows = [("big" if rng.random() < 0.9 else rng.choice("abc"), 7.0 if rng.random() < 0.34 else rng.lognormvariate(0, 3)) for _ in range(n)]
    rows += [("a", None), ("one", 3.0)]
    return pd.DataFrame(rows, columns=["k", "x"]), spark.createDataFrame(rows, "k string, x double")


@pytest.mark.parametrize("slices", [2, 16])
def test_percentiles(spark, slices):
    pdf, df = skewed(spark)
    got = ranks.percentiles(df, ["k"], "x", {"p5": 0.05, "p50": 0.5, "p99": 0.99}, slices).toPandas().set_index("k")
    for k, part in pdf.dropna().groupby("k"):
        for name, p in (("p5", 5), ("p50", 50), ("p99", 99)):
            assert got.loc[k, name] == pytest.approx(np.percentile(part.x, p), rel=1e-12)


def test_percentile_of_whole_table(spark):
    pdf, df = skewed(spark, seed=2)
    assert ranks.percentiles(df, [], "x", {"m": 0.37}).first().m == pytest.approx(np.percentile(pdf.x.dropna(), 37))


def test_average_ranks(spark):
    pdf, df = skewed(spark, 800, 3)
    got = ranks.average_ranks(df, ["k"], "x").toPandas().sort_values(["k", "x"]).reset_index(drop=True)
    want = pdf.assign(r=pdf.groupby("k").x.rank(method="average")).sort_values(["k", "x"]).reset_index(drop=True)
    assert np.allclose(got.avg_rank.to_numpy(float), want.r.to_numpy(float), equal_nan=True)


def test_medians_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 5.0), ("a", 9.0, None), ("b", None, None)], "k string, x double, y double")
    got = {r.k: (r.x, r.y) for r in ranks.medians(df, ["k"], ["x", "y"]).collect()}
    assert got["a"] == (2.0, 5.0)
