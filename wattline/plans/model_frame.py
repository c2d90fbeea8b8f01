"""The frame a forecaster is trained on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.measures import clip, crisis_weight, finite_or_null, flag_to_str
from wattline.lineage import stage
from wattline.operators.features import holiday_neighbours, time_index
from wattline.operators.prep import BY, group_median
from wattline.operators.quality import positive_target, select_variant
from wattline.operators.sequences import fill
from wattline.reference_data import CARRIED_COLUMNS, NEWS_REALS, STATIC_REALS, VARIANT_REALS


def model_frame(features: DataFrame, variant: str = "C", scale: float = 2.0, backward: bool = True) -> DataFrame:
    """The complete frame a model is trained on, for variant A, B or C; a column that is missing raises an error.

    ``features`` should be a stored table. Carried values and medians each need the whole table before
    they can be applied, so the frame is staged before and after the carrying.
    """
    df = holiday_neighbours(time_index(features))
    df = df.withColumns(
        {
            **{c: flag_to_str(F.col(c)) for c in ("is_weekend", "is_holiday")},
            **{c: F.col(c).cast("string") for c in ("is_pre_holiday", "is_post_holiday")},
            "renewable_pct": clip(F.col("renewable_pct"), 0.0, 100.0),
        }
    ).drop("oil_price")
    carried = list(dict.fromkeys([*CARRIED_COLUMNS, *VARIANT_REALS[variant]]))
    df = df.withColumns({c: F.col(c).cast("double") for c in carried})
    df = stage(df, "holidays")
    df = stage(fill(df, carried, BY, backward=backward, few_keys=True), "filled")
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in STATIC_REALS})
    df = select_variant(df, variant)
    numeric = [n for n, t in df.dtypes if t == "double"]
    df = df.withColumns({c: finite_or_null(F.col(c)) for c in numeric})
    df = group_median(df, numeric)
    # the target falls back like any other column, so only zero and negative demand is dropped here
    df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in numeric})
    df = positive_target(df)
    signals = [F.col(c) for c in NEWS_REALS if c in df.columns]
    weight = crisis_weight(signals, scale) if signals else F.lit(1.0)
    return df.withColumn("weight", weight)
