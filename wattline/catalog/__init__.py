"""Every operator bound to the shared test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = [
    "panel_queries", "feature_queries", "news_queries", "score_queries", "risk_queries", "file_queries", "stream_queries",
    "scale_queries",
]


def load():
    """All registered queries and their SQL."""
    from wattline.catalog import registry

    for name in MODULES:
        importlib.import_module(f"wattline.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
