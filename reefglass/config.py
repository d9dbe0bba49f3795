"""Ranking weights and limits; fixed values where results must agree with the engine this one stands in for."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ranking:
    """Weights of the blended score, and the half-lives in days of each kind of document."""

    w_en: float = 1.0
    w_dv: float = 1.0
    w_latin: float = 0.6
    w_trigram: float = 0.4
    same_language: float = 0.5
    freshness: float = 0.3
    quality: float = 0.2
    expired: float = 0.5
    half_life: dict = field(default_factory=lambda: {"news": 7.0, "job": 14.0, "property": 45.0})
    other_half_life: float = 30.0


#: Weights of a posting by the part of the record it comes from.
WEIGHT_A, WEIGHT_B, WEIGHT_C, WEIGHT_D = 1.0, 0.4, 0.2, 0.1
CANDIDATE_CAP = 500
CLOSING_SOON_DAYS = 7
TERMS_PER_SIDE = 32
SUGGEST_MIN_QUERY, SUGGEST_MIN_TERM, SUGGEST_TERMS, SUGGEST_SIMILARITY = 2, 3, 20_000, 0.2
RUN_CAP = 3
DISCOVERY = {"min_docs": 8, "min_coverage": 0.05, "min_entropy": 0.05, "dominant": 0.70, "facets": 8, "top": 12, "buckets": 10}
RATE_LIMIT, RATE_SECONDS = 20, 3600
PENSION_RATE, WORKING_DAYS, HOURS_PER_DAY = 0.07, 20, 8
CONFIDENCE_FLOOR, MAX_ATTEMPTS = 0.8, 5
LOG_RETENTION_DAYS = 90
