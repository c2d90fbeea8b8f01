"""Fixed values of the domain: code lists, bounds, dictionaries and feature lists.

Every table here is a constant of known size, so joining it by broadcast is always safe.
"""

from __future__ import annotations

# --- fixed values: balancing authorities ----------------------------------------------------

FEATURE_BAS = ["ERCO", "NYIS", "ISNE", "FPL", "CISO", "PJM", "MISO", "SWPP", "SOCO", "TVA", "DUK", "BPAT"]

# code: (latitude, longitude) of the centre point of each of the 25 areas that are pulled
BA_CENTRES = {
    "ERCO": (31.9686, -99.9018),
    "PJM": (40.7128, -74.0060),
    "CISO": (36.7783, -119.4179),
    "MISO": (40.0, -89.0),
    "NYIS": (43.0, -75.0),
    "ISNE": (42.0, -71.5),
    "SWPP": (38.0, -97.0),
    "SOCO": (33.0, -86.0),
    "TVA": (36.0, -86.0),
    "DUK": (35.0, -80.0),
    "FPL": (27.0, -81.0),
    "AECI": (38.0, -92.0),
    "AVA": (47.0, -117.0),
    "BPAT": (45.0, -120.0),
    "LGEE": (38.0, -85.0),
    "NEVP": (39.0, -115.0),
    "PACE": (40.0, -111.0),
    "PACW": (44.0, -120.0),
    "PSCO": (39.0, -105.0),
    "SC": (34.0, -80.0),
    "SCEG": (34.0, -81.0),
    "SEC": (28.0, -82.0),
    "TAL": (30.4383, -84.2807),
    "TEC": (27.9506, -82.4572),
    "WACM": (40.0, -105.0),
}

# physical demand range in MW: (lowest, highest)
DEMAND_BOUNDS = {
    "ERCO": (10000, 90000),
    "PJM": (30000, 170000),
    "MISO": (30000, 135000),
    "CISO": (8000, 55000),
    "NYIS": (8000, 35000),
    "ISNE": (5000, 28000),
    "SWPP": (15000, 55000),
    "SOCO": (8000, 55000),
    "TVA": (8000, 40000),
    "DUK": (4000, 25000),
    "FPL": (5000, 33000),
    "BPAT": (2000, 15000),
}

# news states that feed each area; a state may feed several areas
BA_STATES = {
    "ERCO": ["TX"],
    "NYIS": ["NY"],
    "ISNE": ["ME", "NH", "VT", "MA", "RI", "CT"],
    "FPL": ["FL"],
    "CISO": ["CA"],
    "PJM": ["PA", "NJ", "MD", "DE", "OH", "VA", "WV", "IL", "IN", "MI", "NC", "TN", "KY"],
    "MISO": ["MI", "WI", "MN", "IA", "IL", "IN", "AR", "LA", "MS"],
    "SWPP": ["ND", "SD", "NE", "KS", "OK", "TX", "NM", "AR", "LA"],
    "SOCO": ["GA", "AL", "FL", "MS"],
    "TVA": ["TN", "AL", "MS", "KY", "GA", "NC", "VA"],
    "DUK": ["NC", "SC"],
    "BPAT": ["WA", "OR", "ID", "MT"],
}

# --- fixed values: reading types and fuels ---------------------------------------------------

REGION_TYPES = {"D": "demand_mw", "DF": "forecast_mw", "NG": "generation_mw", "TI": "interchange_mw"}

FUEL_COLUMNS = {
    "COL": "coal_mw",
    "NG": "gas_mw",
    "NUC": "nuclear_mw",
    "OIL": "oil_mw",
    "SUN": "solar_mw",
    "WAT": "hydro_mw",
    "WND": "wind_mw",
    "OTH": "other_mw",
    "UNK": "other_mw",
}

# --- fixed values: region dictionary ----------------------------------------------------------
# (code, name, states, region names, fuel shares)

REGION_DICTIONARY = [
    (
        "ERCO",
        "Electric Reliability Council of Texas",
        ["TX"],
        ["Texas", "ERCOT", "West Texas", "Gulf Coast", "Houston", "Dallas", "Austin"],
        {"NG": 0.45, "WND": 0.25, "COL": 0.15, "NUC": 0.10, "SUN": 0.05},
    ),
    (
        "PJM",
        "PJM Interconnection",
        ["PA", "NJ", "MD", "DE", "OH", "VA", "WV", "IL", "IN", "KY", "MI", "NC", "TN"],
        ["PJM", "Mid-Atlantic", "Appalachia", "Pennsylvania", "New Jersey", "Ohio", "Virginia"],
        {"NG": 0.40, "NUC": 0.33, "COL": 0.20, "WND": 0.04, "SUN": 0.02},
    ),
    (
        "CISO",
        "California Independent System Operator",
        ["CA"],
        ["California", "CAISO", "Los Angeles", "San Francisco", "Silicon Valley"],
        {"NG": 0.40, "SUN": 0.25, "WAT": 0.15, "WND": 0.10, "NUC": 0.08},
    ),
    (
        "MISO",
        "Midcontinent Independent System Operator",
        ["MN", "WI", "MI", "IA", "IL", "IN", "MO", "AR", "MS", "LA"],
        ["Midwest", "MISO", "Michigan", "Minnesota", "Wisconsin", "Louisiana", "Gulf Coast"],
        {"COL": 0.45, "NG": 0.30, "WND": 0.15, "NUC": 0.08},
    ),
    (
        "NYIS",
        "New York Independent System Operator",
        ["NY"],
        ["New York", "NYISO", "NYC", "Long Island", "Upstate New York"],
        {"NG": 0.45, "NUC": 0.25, "WAT": 0.20, "WND": 0.05},
    ),
]

# --- fixed values: crisis windows (key, label, first day, last day, escalation day) -----------

CRISIS_WINDOWS = [
    ("iran_2026", "Iran Crisis — March 2026", "2026-02-25", "2026-03-16", None),
    ("texas_2021", "Texas Winter Storm Uri — Feb 2021", "2021-02-10", "2021-02-25", None),
    ("ukraine_2022", "Russia-Ukraine Invasion — Feb 2022", "2022-02-20", "2022-03-15", None),
]

MONTHLY_CRISIS_WINDOWS = [
    ("iran_2026", "Iran Crisis — Feb/Mar 2026", "2026-02-15", "2026-03-22", "2026-02-28"),
    ("tva_2025", "Shoulder Season Heatwave — TVA 2025", "2025-05-14", "2025-05-18", "2025-05-16"),
]

# --- fixed values: news theme groups ----------------------------------------------------------

THEME_GROUPS = {
    "grid_stress": [
        "POWER_OUTAGE",
        "MANMADE_DISASTER_WITHOUT_POWER",
        "MANMADE_DISASTER_POWER_OUTAGES",
        "ECON_ELECTRICALGRID",
        "MANMADE_DISASTER_POWER_FAILURE",
        "MANMADE_DISASTER_WITHOUT_ELECTRICITY",
        "MANMADE_DISASTER_RESTORE_POWER",
        "MANMADE_DISASTER_POWER_OUTAGE",
    ],
    "gas_pipeline": [
        "ENV_NATURALGAS",
        "WB_2299_PIPELINES",
        "WB_1768_OIL_AND_GAS_PIPELINE",
        "WB_551_GAS_TRANSPORTATION_STORAGE_AND_DISTRIBUTION",
        "WB_1751_LIQUEFIED_NATURAL_GAS",
    ],
    "electricity": [
        "WB_508_POWER_SYSTEMS",
        "ECON_ELECTRICALGENERATION",
        "ECON_ELECTRICALPRICE",
        "ECON_ELECTRICALDEMAND",
    ],
    "nuclear": ["WB_509_NUCLEAR_ENERGY", "ENV_NUCLEARPOWER"],
    "renewable": ["ENV_SOLAR", "WB_525_RENEWABLE_ENERGY", "ENV_WINDPOWER", "ENV_HYDRO"],
}

# parts of theme names that mark an energy article
ENERGY_THEME_PARTS = ["ENERGY", "ENV_OIL", "ENV_NATURALGAS", "PIPELINE", "ELECTRICITY", "POWER_GRID"]

# root codes of conflict and protest events
CONFLICT_ROOT_CODES = ["14", "17", "18", "19", "20"]

NEWS_TYPES = ["SUPPLY_DISRUPTION", "POLICY", "DEMAND", "PRICE"]

# --- fixed values: model frame ---------------------------------------------------------------

QUANTILES = [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98]
QUANTILE_COLUMNS = ["q02", "q10", "q25", "q50", "q75", "q90", "q98"]
HISTORY_HOURS = 168
HORIZON_HOURS = 24

STATIC_REALS = ["gas_sensitivity", "renewable_sensitivity", "nuclear_sensitivity"]
KNOWN_REALS = [
    "hour_of_day", "day_of_week", "month", "temperature_c", "hdd", "cdd",
    "prophet_trend", "prophet_weekly", "prophet_yearly",
]
KNOWN_FLAGS = ["is_weekend", "is_holiday", "is_pre_holiday", "is_post_holiday"]
HISTORY_REALS = [
    "demand_lag_1h", "demand_lag_24h", "demand_lag_168h",
    "demand_rolling_24h", "demand_rolling_168h", "demand_std_24h",
    "humidity_pct", "wind_speed_kmh", "cloud_cover_pct", "solar_radiation",
    "gas_pct", "renewable_pct",
]
EVENT_REALS = ["sentiment_mean_24h", "sentiment_min_24h", "event_count_24h", "geo_risk_index"]
NEWS_REALS = ["grid_stress_zscore", "gas_pipeline_zscore", "electricity_buzz_zscore", "energy_tone_regional"]

# observed columns of the three model variants
VARIANT_REALS = {
    "A": HISTORY_REALS,
    "B": [*HISTORY_REALS, "gas_price", "nuclear_outage_pct", *EVENT_REALS, "gas_price_change_7d"],
    "C": [
        *HISTORY_REALS, "supply_margin_pct", "gas_pct_delta_24h", "gas_price",
        "gas_price_volatility_7d", "nuclear_outage_pct", *NEWS_REALS, "gpr_zscore",
    ],
}

# daily series whose last known value holds until the next one
CARRIED_COLUMNS = [
    "gas_price", "gas_price_change_7d", "nuclear_outage_pct",
    "gas_price_volatility_7d", "gpr_index", "gpr_zscore",
]

# columns refreshed on rows that already exist when features are rebuilt
REFRESHED_COLUMNS = [
    "gas_price", "oil_price", "gas_price_change_7d", "nuclear_outage_pct", "supply_margin_pct",
    "gas_pct_delta_24h", "gas_price_volatility_7d", "demand_lag_168h", "demand_rolling_168h",
]

SPIKE_FEATURES = [
    "hour_of_day", "day_of_week", "month", "is_weekend",
    "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_rolling_24h", "demand_std_24h",
    "temperature_c", "humidity_pct", "wind_speed_kmh", "cloud_cover_pct", "solar_radiation",
    "hdd", "cdd", "sentiment_mean_24h", "geo_risk_index",
]

# split name: (first day, day after the last)
SPLIT_DATES = {
    "train": ("2021-01-01", "2024-07-01"),
    "val": ("2024-07-01", "2025-07-01"),
    "test": ("2025-07-01", "2026-04-01"),
}

# parts of feature names that tell the family of a feature
FEATURE_FAMILIES = {
    "signal": ["gdelt", "sentiment", "geo_risk", "event_count"],
    "price": ["gas_price", "nuclear", "oil"],
}
