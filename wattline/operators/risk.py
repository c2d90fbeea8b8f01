"""Supply risk: neighbours, disruptions, alerts and prediction rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.measures import haversine_miles, ratio
from wattline.lineage import cut
from wattline.operators.ranks import percentile_bounds, percentiles
from wattline.reference_data import BA_CENTRES


def ba_edges(interchange: DataFrame) -> DataFrame:
    """Distinct neighbour pairs, both ways."""
    one = interchange.select(F.col("fromba").alias("src"), F.col("toba").alias("dst"))
    other = interchange.select(F.col("toba").alias("src"), F.col("fromba").alias("dst"))
    return one.unionByName(other).where("src <> dst").distinct()


def neighbour_cover(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """For every hour an area falls short: the surplus of its neighbours and whether it suffices."""
    gap = F.col("generation_mw") - F.col("demand_mw")
    balance = panel.select("period", "ba_code", gap.alias("gap"))
    short = balance.where("gap < 0").select("period", F.col("ba_code").alias("dst"), (-F.col("gap")).alias("deficit_mw"))
    spare = balance.where("gap > 0").select("period", F.col("ba_code").alias("src"), F.col("gap").alias("_spare"))
    help_mw = spare.join(edges, "src").groupBy("period", "dst").agg(F.sum("_spare").alias("neighbour_mw"))
    return short.join(help_mw, ["period", "dst"], "left").select(
        "period",
        F.col("dst").alias("ba_code"),
        "deficit_mw",
        F.coalesce("neighbour_mw", F.lit(0.0)).alias("neighbour_mw"),
        (F.coalesce("neighbour_mw", F.lit(0.0)) >= F.col("deficit_mw")).alias("covered"),
    )


def match_surplus(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """For every hour and short area the neighbour with the largest surplus that covers it alone.

    The best neighbour is a maximum over (surplus, code), so no ranking window is needed.
    """
    gap = F.col("generation_mw") - F.col("demand_mw")
    balance = panel.select("period", "ba_code", gap.alias("gap"))
    short = balance.where("gap < 0").select("period", F.col("ba_code").alias("buyer"), (-F.col("gap")).alias("deficit_mw"))
    spare = balance.where("gap > 0").select("period", F.col("ba_code").alias("src"), F.col("gap").alias("surplus_mw"))
    offers = spare.join(edges, "src").select("period", F.col("dst").alias("buyer"), F.col("src").alias("seller"), "surplus_mw")
    return (
        short.join(offers, ["period", "buyer"])
        .where("surplus_mw >= deficit_mw")
        .groupBy("period", "buyer", "deficit_mw")
        .agg(F.max(F.struct("surplus_mw", "seller")).alias("_best"))
        .select("period", "buyer", F.col("_best.seller").alias("seller"), "deficit_mw", F.col("_best.surplus_mw").alias("surplus_mw"))
    )


def near_ba(
    articles: DataFrame, centres: dict[str, tuple[float, float]] = BA_CENTRES, miles: float = 100.0
) -> DataFrame:
    """Articles within ``miles`` of an area's centre point, once per area.

    The centres are an array literal of fixed size, looked up per row; a latitude band is tested before
    the distance.
    """
    points = F.array(
        *[
            F.struct(F.lit(code).alias("ba_code"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
            for code, (lat, lon) in centres.items()
        ]
    )
    band = miles / 69.0 + 0.05

    def close(p: Column) -> Column:
        return (F.abs(F.col("latitude") - p["lat"]) <= band) & (
            haversine_miles(F.col("latitude"), F.col("longitude"), p["lat"], p["lon"]) <= miles
        )

    return articles.select("*", F.explode(F.filter(points, close)).alias("_p")).select(*articles.columns, "_p.ba_code")


def station_tone(articles: DataFrame, miles: float = 100.0, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Tone of the articles around each centre point."""
    return near_ba(articles, miles=miles).groupBy("ba_code", *by).agg(
        F.count(F.lit(1)).alias("n_articles"), F.avg("tone").alias("avg_tone"), F.min("tone").alias("min_tone")
    )


# --- prediction rounds --------------------------------------------------------------------------


def accepted(submissions: DataFrame) -> DataFrame:
    """Submissions whose probability is one: 0 to 10000 basis points."""
    return submissions.where(F.col("prob_bp").between(0, 10_000))


def consensus(submissions: DataFrame) -> DataFrame:
    """Median megawatts and median probability per (area, target); even counts take the floored mean.

    Submissions with a probability above 10000 basis points are refused.
    """
    submissions = accepted(submissions)
    by = ["ba_code", "target"]
    values = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value")) for c in ("predicted_mw", "prob_bp")]
    )
    long = submissions.select(*by, F.explode(values).alias("_v")).select(*by, "_v.name", "_v.value")
    mids = percentile_bounds(long, [*by, "name"], "value", {"m": 0.5})
    median = F.expr("CASE WHEN m_frac > 0 THEN (m_lo + m_hi) DIV 2 ELSE m_lo END").cast("bigint")
    return mids.groupBy(*by).agg(
        F.max(F.when(F.col("name") == "predicted_mw", median)).alias("median_mw"),
        F.max(F.when(F.col("name") == "prob_bp", median)).alias("median_prob_bp"),
        F.max("total").alias("n_submissions"),
    )


def node_stats(submissions: DataFrame, penalties: DataFrame, stake: int = 100) -> DataFrame:
    """Submissions, penalties and remaining stake of every node.

    A penalty above what is left of the stake is refused. Smaller ones are taken first, so as many count as the stake
    covers, and the order in which they are listed doesn't matter.
    """
    sent = submissions.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_submissions"))
    sizes = penalties.groupBy("node_id", "amount").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("node_id").orderBy("amount").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_left", F.lit(stake) - F.coalesce(F.sum(F.col("_n") * F.col("amount")).over(before), F.lit(0)))
    taken = F.greatest(F.least(F.col("_n"), F.floor(F.col("_left") / F.col("amount"))), F.lit(0))
    lost = sizes.withColumn("_taken", taken).groupBy("node_id").agg(
        F.sum("_taken").alias("n_penalties"), F.sum(F.col("_taken") * F.col("amount")).alias("_lost")
    )
    return sent.join(lost, "node_id", "left").select(
        "node_id",
        "n_submissions",
        F.coalesce("n_penalties", F.lit(0)).alias("n_penalties"),
        (F.lit(stake) - F.coalesce("_lost", F.lit(0))).alias("remaining_stake"),
    )


def settle(submissions: DataFrame, actuals: DataFrame, tol: float = 0.2, penalty: float = 100.0) -> DataFrame:
    """Penalty or reward of every submission of a finished round.

    A submission further than ``tol`` (relative) from the actual loses ``penalty``; the round's penalties
    are split evenly among the submissions inside the tolerance.
    """
    by = ["ba_code", "target"]
    checked = submissions.join(actuals.select(*by, "actual"), by).withColumn(
        "penalised", F.abs(F.col("predicted_mw") - F.col("actual")) > F.lit(tol) * F.abs(F.col("actual"))
    )
    pools = checked.groupBy(*by).agg(
        (F.count_if(F.col("penalised")) * penalty).alias("_pool"), F.count_if(~F.col("penalised")).alias("_winners")
    )
    reward = F.when(F.col("penalised"), F.lit(-penalty)).otherwise(ratio(F.col("_pool"), F.col("_winners").cast("double")))
    return checked.join(pools, by).select("node_id", *by, "predicted_mw", "actual", "penalised", reward.alias("balance"))


# --- alerts and cascades ----------------------------------------------------------------------


def hourly_limits(history: DataFrame, c: str = "demand_mw", q: float = 0.95) -> DataFrame:
    """Percentile of demand per area, hour of day and day of week."""
    keyed = history.select("ba_code", F.hour("period").alias("hour"), F.dayofweek("period").alias("dow"), c)
    return percentiles(keyed, ["ba_code", "hour", "dow"], c, {"limit_mw": q}, few_keys=True)


def alerts(
    forecasts: DataFrame, limits: DataFrame, outage_pct: float = 10.0, renewable_drop: float = 0.5
) -> DataFrame:
    """Rule alerts of every forecast hour.

    ``forecasts`` holds period, ba_code, q50, generation_mw, interchange_mw, renewable_pct,
    renewable_normal and nuclear_outage_pct. The outage and drop limits are parameters.
    """
    keyed = forecasts.withColumns({"hour": F.hour("period"), "dow": F.dayofweek("period")})
    # at most 168 limits per area
    joined = keyed.join(F.broadcast(limits), ["ba_code", "hour", "dow"], "left")

    def rule(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    surge = rule(F.col("q50") > F.col("limit_mw"))
    short = rule(F.col("q50") > F.col("generation_mw") + F.coalesce("interchange_mw", F.lit(0.0)))
    drop = rule(F.col("renewable_pct") < F.col("renewable_normal") * renewable_drop)
    outage = rule(F.col("nuclear_outage_pct") > outage_pct)
    count = surge.cast("int") + short.cast("int") + drop.cast("int") + outage.cast("int")
    return joined.select(
        "period",
        "ba_code",
        surge.alias("demand_surge"),
        short.alias("supply_shortfall"),
        drop.alias("renewable_drop"),
        outage.alias("nuclear_outage"),
        count.alias("n_alerts"),
    )


def cascade(
    disruption: dict[str, float],
    fuel_mw: DataFrame,
    edges: DataFrame,
    hops: int = 2,
    min_share: float = 0.30,
    spare_share: float = 0.10,
) -> DataFrame:
    """Effect of fuel disruptions on areas, with help from neighbours hop by hop.

    ``disruption`` maps a fuel column to the share of it that is lost; ``fuel_mw`` holds one row per area
    with megawatts per fuel and ``total_mw``. An area is affected when the fuel supplies more than
    ``min_share`` of it. Areas without a shortfall offer ``spare_share`` of their total. In each hop, an
    area in need draws on its direct neighbours, each of which splits what it has left in proportion to
    the needs around it. Areas that needed nothing pass power on in later hops through their own
    neighbours' offers, so help reaches ``hops`` edges far. ``impact_hops`` says how soon an area is hit: 0 where need
    stays, else the number of edges (up to ``hops``) to such an area, NULL beyond. All shares here are parameters.
    """
    lost = F.lit(0.0)
    for fuel, part in disruption.items():
        share_of = ratio(F.col(fuel), F.col("total_mw"))
        lost = lost + F.when(share_of > min_share, F.col(fuel) * F.lit(part)).otherwise(0.0)
    state = fuel_mw.select("ba_code", "total_mw", lost.alias("shortfall_mw")).select(
        "*",
        F.col("shortfall_mw").alias("need"),
        F.when(F.col("shortfall_mw") > 0, 0.0).otherwise(F.col("total_mw") * spare_share).alias("offer"),
    )
    reach = edges.select("src", "dst").distinct()
    steps = reach.withColumn("hop", F.lit(1))
    for hop in range(hops):
        if hop:
            # each hop reads the state several times: cut its lineage
            state = cut(state)
            # paths one edge longer; pairs of areas bound their number
            reach = (
                reach.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("_far")).distinct(), "dst")
                .select("src", F.col("_far").alias("dst"))
                .where("src <> dst")
                .distinct()
            )
            steps = steps.unionByName(reach.withColumn("hop", F.lit(hop + 1)))
        needs = state.where("need > 0").select(F.col("ba_code").alias("dst"), "need")
        offers = state.where("offer > 0").select(F.col("ba_code").alias("src"), "offer")
        pairs = reach.join(needs, "dst").join(offers, "src")
        asked = pairs.groupBy("src").agg(F.sum("need").alias("_asked"))
        given = pairs.join(asked, "src").withColumn("_give", F.col("offer") * F.col("need") / F.greatest("_asked", "offer"))
        # where more is offered than needed, every gift shrinks alike: what is given is what is taken
        offered = given.groupBy("dst").agg(F.sum("_give").alias("_offered"))
        given = given.join(offered, "dst").withColumn("_give", F.col("_give") * F.least(F.lit(1.0), F.col("need") / F.col("_offered")))
        used = given.groupBy(F.col("dst").alias("ba_code")).agg(F.least(F.sum("_give"), F.max("need")).alias("_got"))
        spent = given.groupBy(F.col("src").alias("ba_code")).agg(F.sum("_give").alias("_spent"))
        state = (
            state.join(used, "ba_code", "left")
            .join(spent, "ba_code", "left")
            .withColumns(
                {
                    "need": F.col("need") - F.coalesce("_got", F.lit(0.0)),
                    "offer": F.greatest(F.col("offer") - F.coalesce("_spent", F.lit(0.0)), F.lit(0.0)),
                }
            )
            .drop("_got", "_spent")
        )
    state = cut(state)
    unmet = state.where("need > 1e-6").select(F.col("ba_code").alias("dst"))
    near = steps.join(unmet, "dst").groupBy(F.col("src").alias("ba_code")).agg(F.min("hop").alias("_hop"))
    return state.join(near, "ba_code", "left").select(
        "ba_code",
        "shortfall_mw",
        (F.col("shortfall_mw") - F.col("need")).alias("compensated_mw"),
        F.coalesce(ratio(F.col("need"), F.col("total_mw")) * 100, F.lit(0.0)).alias("risk_score"),
        F.when(F.col("need") > 1e-6, 0).otherwise(F.col("_hop")).alias("impact_hops"),
    )


def vulnerability(profiles: DataFrame, shares: list[str], high: float = 0.30, medium: float = 0.15) -> DataFrame:
    """HIGH / MEDIUM / LOW dependence of every area on every fuel share."""
    long = profiles.unpivot(["ba_code"], shares, "fuel", "share")
    level = F.when(F.col("share") > high, "HIGH").when(F.col("share") > medium, "MEDIUM").otherwise("LOW")
    return long.withColumn("vulnerability", level)


# --- prediction log ----------------------------------------------------------------------------


def fill_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Put the observed demand and the resulting percentage error on logged predictions."""
    seen = actuals.select("ba_code", F.col("period").alias("target_period"), F.col("demand_mw").alias("_actual"))
    filled = predictions.drop("mape").join(seen, ["ba_code", "target_period"], "left").withColumn(
        "actual_demand", F.coalesce("_actual", "actual_demand")
    )
    error = F.abs(ratio(F.col("actual_demand") - F.col("predicted_demand"), F.col("actual_demand"))) * 100
    return filled.withColumn("mape", error).drop("_actual")


def verify_predictions(predictions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Compare stored fingerprints with the ones made when the predictions were logged."""
    return predictions.join(ledger.withColumnRenamed("prediction_hash", "_sealed"), ["ba_code", "target_period", "model_name"], "left").withColumn(
        "intact", F.coalesce(F.col("prediction_hash") == F.col("_sealed"), F.lit(False))
    ).drop("_sealed")


def episodes(features: DataFrame, gap_hours: int = 1) -> DataFrame:
    """Alert episodes: spike hours of an area no more than ``gap_hours`` apart.

    ``session_window`` merges sessions from partial ones, so no long window over an area is needed. The
    session ends one gap after its last spike.
    """
    spikes = features.where("is_spike")
    # sessions that touch belong together, so a distance of exactly the gap does
    window = F.session_window("period", F.lit(f"{gap_hours * 3600} seconds"))
    return spikes.groupBy("ba_code", window.alias("_s")).agg(
        F.min("period").alias("first_hour"),
        F.max("period").alias("last_hour"),
        F.count(F.lit(1)).alias("n_hours"),
        F.max("spike_magnitude").alias("max_magnitude"),
    ).drop("_s")


