"""News features, region resolution, event filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.catalog import bindings as b
from wattline.catalog.feature_queries import _THEMED, _themed
from wattline.catalog.registry import query
from wattline.operators import news, panel, regions

_SPINE = {
    "told": "SELECT event_time, event_type, sentiment_score, risk_magnitude, unnest(list_distinct(ba_codes)) AS ba_code FROM news",
    "told_at": """SELECT *, CASE WHEN event_time = date_trunc('hour', event_time) THEN event_time ELSE date_trunc('hour', event_time) + INTERVAL 1 HOUR END AS hour,
                         exp(-ln(2) / 24 * (epoch_us(CASE WHEN event_time = date_trunc('hour', event_time) THEN event_time ELSE date_trunc('hour', event_time) + INTERVAL 1 HOUR END)
                                            - epoch_us(event_time)) / 3600e6) AS aged FROM told""",
    "told_hour": """SELECT hour, hour = event_time AS on_hour, ba_code, sum(sentiment_score * aged) AS s, sum(CASE WHEN sentiment_score IS NOT NULL THEN aged END) AS n,
                           sum(greatest(-sentiment_score, 0) * risk_magnitude * aged * CASE event_type WHEN 'SUPPLY_DISRUPTION' THEN 1.0
                               WHEN 'PRICE' THEN 0.6 WHEN 'POLICY' THEN 0.4 ELSE 0.3 END) AS harm
                    FROM told_at GROUP BY 1, 2, 3""",
}
_SPINE["spine"] = f"""SELECT period, ba_code FROM
    (SELECT unnest(generate_series((SELECT date_trunc('hour', min(event_time)) FROM news), (SELECT date_trunc('hour', max(event_time)) + INTERVAL 25 HOUR FROM news), INTERVAL 1 HOUR)) AS period)
    JOIN (SELECT unnest({b._list(b.FEATURE_BAS)}) AS ba_code) ON TRUE"""


def spine(t):
    areas = t.spark.sql("SELECT explode(array(" + ", ".join(f"'{x}'" for x in b.FEATURE_BAS) + ")) AS ba_code")
    told = b.news(t)
    first, last = told.agg(F.date_trunc("hour", F.min("event_time"))).scalar(), told.agg(F.date_trunc("hour", F.max("event_time"))).scalar()
    return panel.hour_spine(areas, first, last + F.expr("INTERVAL 25 HOURS"))


_ROLLUP = """SELECT s.period, s.ba_code, coalesce(avg(sentiment_score), 0) AS news_sentiment_24h, coalesce(max(risk_magnitude), 0) AS news_max_risk_24h,
                    count(event_time) AS news_event_count_24h, coalesce(bool_or(event_type = 'SUPPLY_DISRUPTION'), FALSE) AS supply_disruption_24h
             FROM spine s LEFT JOIN told n ON n.ba_code = s.ba_code AND n.event_time BETWEEN s.period - INTERVAL 24 HOUR AND s.period GROUP BY 1, 2"""
_ROLLUP_FLOATS = "news_sentiment_24h news_max_risk_24h"


@query("news_rollup_24h", _ROLLUP, _ROLLUP_FLOATS, ctes=_SPINE)
def rollup(t):
    return news.news_rollup(b.news(t), spine(t))


@query(
    "news_in_last_24h",
    f"SELECT * FROM ({_ROLLUP}) WHERE news_event_count_24h > 0",
    _ROLLUP_FLOATS,
    ctes=_SPINE,
)
def _(t):
    return news.news_in_last(b.news(t))


@query(
    "demand_with_news",
    f"""SELECT d.period, d.ba_code, d.demand_mw, n.news_sentiment_24h, n.news_max_risk_24h, n.news_event_count_24h, n.supply_disruption_24h
        FROM demand d LEFT JOIN ({_ROLLUP}) n ON n.period = d.period AND n.ba_code = d.ba_code""",
    "demand_mw " + _ROLLUP_FLOATS,
    ctes=_SPINE,
)
def _(t):
    return news.join_news(b.demand(t).select("period", "ba_code", "demand_mw"), rollup(t))


@query(
    "risk_hourly",
    """SELECT date_trunc('hour', event_time) AS hour, ba_code, avg(sentiment_score) AS avg_sentiment, min(sentiment_score) AS min_sentiment,
              max(risk_magnitude) AS max_risk, count(*) FILTER (WHERE event_type = 'SUPPLY_DISRUPTION') AS disruption_count,
              count(*) FILTER (WHERE event_type = 'POLICY') AS policy_count, count(*) AS total_events FROM told GROUP BY 1, 2""",
    "avg_sentiment min_sentiment max_risk",
    ctes=_SPINE,
)
def _(t):
    return news.risk_hourly(b.news(t))


@query(
    "range_window_24h",
    """SELECT period, ba_code, sum(demand_mw) OVER w AS demand_mw_sum_24h, count(demand_mw) OVER w AS demand_mw_n_24h FROM demand
       WINDOW w AS (PARTITION BY ba_code ORDER BY period RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""",
    "demand_mw_sum_24h",
)
def _(t):
    return news.range_window(b.demand(t), ["ba_code"], "demand_mw")


@query(
    "decayed_sentiment",
    """SELECT period, ba_code, sum(s * wt) / nullif(sum(n * wt), 0) AS decayed_sentiment, sum(n * wt) AS decayed_volume FROM (
         SELECT hour + to_hours(CAST(h AS INTEGER)) AS period, ba_code, s, n, exp(-ln(2) / 24 * h) AS wt
         FROM told_hour JOIN (SELECT unnest(range(0, 49)) AS h) ON on_hour OR h < 48) GROUP BY 1, 2""",
    "decayed_sentiment decayed_volume",
    ctes=_SPINE,
)
def _(t):
    return news.decayed_mean(b.news(t), 24.0, 48)


_RISK = """WITH raw AS (SELECT hour + to_hours(CAST(h AS INTEGER)) AS period, ba_code, sum(harm * exp(-ln(2) / 24 * h)) AS raw_risk
                        FROM told_hour JOIN (SELECT unnest(range(0, 169)) AS h) ON on_hour OR h < 168 GROUP BY 1, 2)
           SELECT *, (raw_risk - (SELECT min(raw_risk) FROM raw)) / nullif((SELECT max(raw_risk) FROM raw) - (SELECT min(raw_risk) FROM raw), 0) * 100 AS risk_index
           FROM raw"""


@query("risk_index", _RISK, "raw_risk risk_index", ctes=_SPINE)
def _(t):
    return news.risk_index(b.news(t))


@query(
    "risk_map",
    f"SELECT ba_code, max(period) AS period, arg_max(risk_index, period) AS risk_index FROM ({_RISK}) GROUP BY 1",
    "risk_index",
    ctes=_SPINE,
)
def _(t):
    return news.risk_map(news.risk_index(b.news(t)))


@query(
    "news_features_of_area",
    f"SELECT * FROM ({_ROLLUP}) WHERE ba_code = 'PJM' AND period >= TIMESTAMP '2024-01-10' AND period < TIMESTAMP '2024-01-12'",
    _ROLLUP_FLOATS,
    ctes=_SPINE,
)
def _(t):
    return news.nlp_features(rollup(t), "PJM", "2024-01-10", "2024-01-12")


@query(
    "recent_alerts",
    """SELECT event_id, event_time, event_type, risk_magnitude, event_type || ' affecting ' || array_to_string(ba_codes, ',') AS description
       FROM news WHERE event_time BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20' AND risk_magnitude >= 0.7""",
    "risk_magnitude",
)
def _(t):
    return news.recent_alerts(b.news(t), F.lit("2024-01-20").cast("timestamp"))


@query(
    "dedupe_articles",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), source)",
)
def _(t):
    return news.dedupe_articles(t.documents).select("doc_id", "source")


@query(
    "conflict_events",
    """SELECT event_id, root_code FROM (SELECT event_id, CAST(10 + k % 11 AS VARCHAR) AS root_code, user_id % 3 AS c,
              CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS d FROM ev)
       WHERE c <> 0 AND root_code IN ('14', '17', '18', '19', '20') AND d >= 20240110""",
)
def _(t):
    e = b.events(t).select(
        "event_id",
        (10 + F.col("k") % 11).cast("string").alias("root_code"),
        F.when(F.col("user_id") % 3 != 0, "US").otherwise("CA").alias("country_code"),
        F.date_format("ts", "yyyyMMdd").alias("sqldate"),
    )
    return news.conflict_events(e, "US", 20240110).select("event_id", "root_code")


@query(
    "energy_articles",
    """SELECT state_code, article_date, themes[1] || ';' || themes[2] AS themes, tone FROM themed
       WHERE state_code LIKE '%N%' AND regexp_matches(themes[1] || ';' || themes[2], 'ENERGY|ENV_OIL|ENV_NATURALGAS|PIPELINE|ELECTRICITY|POWER_GRID')""",
    "tone",
    ctes=_THEMED,
)
def _(t):
    return news.energy_articles(_themed(t).withColumn("locations", F.col("state_code")), "N").select("state_code", "article_date", "themes", "tone")


TAGS = [
    ("type", "SUPPLY_DISRUPTION", "under"), ("type", "SUPPLY_DISRUPTION", "erst"), ("type", "POLICY", "the"), ("type", "DEMAND", "der"),
    ("type", "PRICE", "la"), ("fuel", "NG", "and"), ("fuel", "COL", "in"), ("fuel", "NUC", "un"),
]
_WORDS = "SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS words FROM documents"


def _hit(kind, label):
    return f"list_has_any(words, {b._list([w for k, n, w in TAGS if (k, n) == (kind, label)])})"


@query(
    "tag_articles",
    f"""SELECT doc_id, CASE WHEN {_hit('type', 'SUPPLY_DISRUPTION')} THEN 'SUPPLY_DISRUPTION' WHEN {_hit('type', 'POLICY')} THEN 'POLICY'
               WHEN {_hit('type', 'DEMAND')} THEN 'DEMAND' WHEN {_hit('type', 'PRICE')} THEN 'PRICE' END AS event_type,
               concat_ws(',', CASE WHEN {_hit('fuel', 'NG')} THEN 'NG' END, CASE WHEN {_hit('fuel', 'COL')} THEN 'COL' END,
                         CASE WHEN {_hit('fuel', 'NUC')} THEN 'NUC' END) AS fuel_types FROM ({_WORDS})""",
)
def _(t):
    tagged = news.tag_articles(t.documents, TAGS)
    return tagged.withColumn("fuel_types", F.concat_ws(",", "fuel_types"))


# --- region dictionary -------------------------------------------------------------------------

_NAMES = {
    # the dictionary of the region resolver is bound to the words of the benchmark passages, and their pairs of words
    "item_words": """SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM benchmark""",
    "named": f"""SELECT ba_code, name, min(pos) AS ord FROM (
                   SELECT {b.ba_sql('item_id')} AS ba_code, item_id * 4294967296 AS pos, unnest(w) AS name FROM item_words
                   UNION ALL SELECT {b.ba_sql('item_id')}, item_id * 4294967296, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM item_words)
                 GROUP BY 1, 2""",
    "doc_words": """SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents""",
    "words": """SELECT DISTINCT doc_id, unnest(w) AS entity FROM doc_words
                UNION SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM doc_words""",
}


def dictionary(t):
    """Words of the benchmark passages and their pairs, as region names of twelve areas."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.expr("CASE WHEN size(_w) > 1 THEN transform(sequence(0, size(_w) - 2), i -> concat(_w[i], ' ', _w[i + 1])) ELSE array() END")
    words_of = t.benchmark.select("item_id", words.alias("_w")).select("item_id", F.concat("_w", pairs).alias("_names"))
    return words_of.select(
        b.ba("item_id").alias("ba_code"),
        F.col("item_id").cast("int").alias("ord"),
        F.col("_names").alias("region_names"),
        F.create_map(F.lit("NG"), (F.col("item_id") % 10) / 10.0, F.lit("COL"), (F.col("item_id") % 7) / 10.0).alias("fuel_profile"),
    )


@query("region_names", "SELECT DISTINCT ba_code, name FROM named", ctes=_NAMES)
def _(t):
    return regions.region_names(dictionary(t)).select("ba_code", "name")


@query("match_exact", "SELECT DISTINCT w.entity, w.entity AS name, n.ba_code FROM (SELECT DISTINCT entity FROM words) w JOIN named n ON n.name = w.entity", ctes=_NAMES)
def _(t):
    return regions.match_exact(regions.document_words(t.documents, longest=2), regions.region_names(dictionary(t)))


# Similarity by common subsequence has no SQL counterpart that ends in time on whole tables; it is tested by
# brute force on a small dictionary.
@query("match_fuzzy")
def _(t):
    return regions.match_fuzzy(regions.document_words(t.documents, longest=2), regions.region_names(dictionary(t)))


@query(
    "match_fuel_dependence",
    f"""SELECT DISTINCT d.doc_id, p.ba_code FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'NG' ELSE 'COL' END AS fuel FROM documents WHERE n_chars % 3 = 0) d
        JOIN (SELECT {b.ba_sql('item_id')} AS ba_code, unnest(['NG', 'COL']) AS fuel, unnest([(item_id % 10) / 10.0, (item_id % 7) / 10.0]) AS share FROM benchmark) p
        ON p.fuel = d.fuel AND p.share > 0.30""",
)
def _(t):
    return regions.match_fuel(_stories(t), dictionary(t)).distinct()


def _stories(t):
    return t.documents.select(
        "doc_id", (F.col("n_chars") % 3 == 0).alias("is_commodity"), F.when(F.col("doc_id") % 2 == 0, "NG").otherwise("COL").alias("fuel")
    )


@query("resolve_articles")
def _(t):
    return regions.resolve_articles(regions.document_words(t.documents, longest=2), _stories(t), dictionary(t)).distinct()
