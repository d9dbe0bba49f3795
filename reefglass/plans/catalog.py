"""The named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reefglass.operators import eav_wide, units
from reefglass.plans import data_queries as _data  # noqa: F401
from reefglass.plans import filter_queries as _filters  # noqa: F401
from reefglass.plans import search_queries as _search  # noqa: F401
from reefglass.plans import text_queries as _text  # noqa: F401
from reefglass.plans import upkeep_queries as _upkeep  # noqa: F401
from reefglass.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **QUERIES,
        "p5_found": eav_wide.p5_found,
        "p5_wide": eav_wide.p5_wide,
        "p6_found": units.p6_found,
        "p6_units_report": units.p6_units_report,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
