"""The whole cleaning plan on tables, with slots for other classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, rules

Step = Callable[[DataFrame], DataFrame]


def run_pipeline(regions: DataFrame, pages: DataFrame | None = None, *, classify: Step = rules.classify_page, eligibility: Step = rules.classify_eligibility, route: Step = rules.route_region, verdict: Step = rules.verdict) -> DataFrame:
    """Regions with features and scores to page reports. Each slot takes and returns a DataFrame; a scorer may be a pandas UDF
    inside it. ``pages`` with features, if given, get their role by ``classify`` and pass it to their regions; a region whose page is not
    there has none. All other steps are projections, so the plan has the shuffles of that join and of the report, by the same key."""
    if pages is not None:
        roles = classify(pages).select("page_id", F.col("role").alias("page_role"), F.col("confidence").alias("page_confidence"))
        regions = regions.drop("page_role", "page_confidence").join(roles, "page_id", "left")
    return metrics.page_report(verdict(route(eligibility(regions))))
