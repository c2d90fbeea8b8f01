"""Schemas of raw files and tables as DDL strings."""

READINGS_JSON = (
    "endpoint string, params map<string,string>, "
    "response struct<total: string, data: array<map<string,string>>>"
)

WEATHER_VARIABLES = [
    "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_direction_10m",
    "cloud_cover", "shortwave_radiation", "precipitation",
]
WEATHER_JSON = (
    "ba_code string, hourly struct<time: array<string>, "
    + ", ".join(f"{v}: array<double>" for v in WEATHER_VARIABLES)
    + ">"
)

EVENTS_US_CSV = (
    "SQLDATE int, event_count int, avg_goldstein double, min_goldstein double, max_goldstein double, "
    "std_goldstein double, avg_tone double, min_tone double, total_mentions bigint, total_articles bigint, "
    "severe_conflict_count int, moderate_conflict_count int, tension_count int, cooperation_count int, "
    "very_negative_article_count int, crisis_event_count int"
)
EVENTS_GLOBAL_CSV = (
    "SQLDATE int, global_event_count int, global_avg_goldstein double, global_min_goldstein double, "
    "global_std_goldstein double, global_avg_tone double, global_total_articles bigint, "
    "oil_region_event_count int, oil_region_avg_goldstein double, severe_conflict_global int, "
    "moderate_conflict_global int, crisis_event_count int, very_negative_article_count int"
)
STATE_NEWS_CSV = (
    "article_date date, state_code string, total_energy_articles bigint, grid_stress_articles bigint, "
    "gas_pipeline_articles bigint, electricity_articles bigint, nuclear_articles bigint, "
    "renewable_articles bigint, avg_energy_tone double, min_energy_tone double"
)
RISK_INDEX_CSV = "date date, GPRD double, GPRD_ACT double, GPRD_THREAT double, GPRD_MA7 double"
