"""Registry of bound queries and small helpers to write them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOME: dict[str, str] = {}


class Tables:
    """The tables of one data folder, read lazily and by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)  # footers are read once per table
        return df


def present(df: DataFrame, digits: int = 4) -> DataFrame:
    """Result form: floats cut to ``digits`` places and timestamps without a zone.

    Rounding adds a little more than a half, so that exact halves, which the sum order may push either
    way by one unit in the last place, always go up.
    """
    scale = 10**digits
    cols = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            cols.append(f"floor({c} * {scale} + 0.50003D) / {scale} AS {c}")
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(f"CAST({c} AS TIMESTAMP_NTZ) AS {c}")
        elif isinstance(f.dataType, T.IntegerType | T.ShortType):
            cols.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            cols.append(c)
    return df.selectExpr(*cols)


def oracle(ctes: dict[str, str], body: str, floats: str = "", digits: int = 4) -> str:
    """``body`` behind the table expressions it names, with the float columns cut as in ``present``."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(ctes[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    # a long chain of steps is worked out step by step
    parts = [f"{name} AS {'MATERIALIZED ' if name.startswith('season_') or name == 'fitted' else ''}({ctes[name]})" for name in needed]
    parts.append(f"result AS ({body})")
    scale = 10**digits
    fixes = ", ".join(f"floor({c} * {scale} + 0.50003) / {scale} AS {c}" for c in floats.split())
    star = f"* REPLACE ({fixes})" if fixes else "*"
    return f"WITH {', '.join(parts)} SELECT {star} FROM result"


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 4, ctes: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` together with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(fn(Tables(spark, folder)), digits)

        QUERIES[name] = run
        HOME[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            from wattline.catalog.bindings import CTES

            ORACLES[name] = oracle({**CTES, **(ctes or {})}, sql, floats, digits)
        return fn

    return register
