"""All registered queries; importing a module registers its queries."""

import importlib

from folioscope.plans.registry import CHECKS, QUERIES

MODULES = (
    "archive_queries",
    "text_queries",
    "change_queries",
    "page_queries",
    "media_queries",
    "stream_queries",
    "snapshot_queries",
)
for _module in MODULES:
    importlib.import_module(f"folioscope.plans.{_module}")

__all__ = ["CHECKS", "QUERIES"]
