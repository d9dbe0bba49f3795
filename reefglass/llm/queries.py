"""The named queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reefglass.llm import language_id, mixing, packing, survivors, text_stats, truncation, value_mapping


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": value_mapping.p1_found,
        "p1_unmatched": value_mapping.p1_unmatched,
        "p2_found": survivors.p2_found,
        "p2_kept_values": survivors.p2_kept_values,
        "p3_found": language_id.p3_found,
        "p3_segments": language_id.p3_segments,
        "p4_found": truncation.p4_found,
        "p4_cut_share": truncation.p4_cut_share,
        "p7_containers": packing.p7_containers,
        "p7_report": packing.p7_report,
        "p8_selection": mixing.p8_selection,
        "p8_shares": mixing.p8_shares,
        "p9_found": text_stats.p9_found,
        "p9_statistics": text_stats.p9_statistics,
    }


def oracle_sql() -> dict[str, str]:
    return {}
