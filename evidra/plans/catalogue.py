"""All registered queries of the evidence engine and their SQL oracles."""

from __future__ import annotations

from evidra.plans import check_plans, crawl_plans, document_plans, markup_plans, review_plans, run_plans, search_plans, series_plans, text_plans
from evidra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "check_plans", "crawl_plans", "document_plans", "markup_plans", "review_plans", "run_plans", "search_plans", "series_plans", "text_plans"]
