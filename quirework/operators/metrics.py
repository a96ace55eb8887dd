"""Page reports, corpus summary and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, d, safe_ratio
from .rules import RESIDUAL


def n_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def page_report(regions: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row for each group of regions (status, route, action, text_role, reasons, residual_score, hits_protected)."""
    clean = F.col("action") == "clean"
    sfx = F.array_contains("reasons", "sfx-policy")
    g = regions.groupBy(*keys).agg(
        F.count("*").alias("region_count"),
        *(n_if(F.col("route") == r).alias(f"route_{r}") for r in ("flat", "gradient", "artwork")),
        n_if(clean).alias("eligible_count"),
        n_if(clean & (F.col("status") == "repaired")).alias("repaired_count"),
        n_if(clean & (F.col("residual_score") <= d(RESIDUAL))).alias("residual_pass_count"),
        n_if(F.col("status") == "needs_review").alias("needs_review_count"),
        n_if(~clean & ~sfx & ~F.col("hits_protected")).alias("unexpected_count"),
        n_if((F.col("text_role") == "sfx") & ~clean & sfx & ~F.col("hits_protected")).alias("preserved_sfx_count"),
    )
    return g.withColumns({
        "residual_pass_rate": safe_ratio(F.col("residual_pass_count"), F.col("eligible_count")),
        "automatic_pass_rate": safe_ratio(F.col("repaired_count"), F.col("eligible_count")),
        "needs_review_rate": safe_ratio(F.col("needs_review_count"), F.col("region_count"), 0.0),
    })


def category_report(regions: DataFrame) -> DataFrame:
    """Counts per category and for all (category null), in one pass by grouping sets."""
    return regions.rollup("category").agg(F.count("*").alias("region_count"), n_if(F.col("status") == "repaired").alias("repaired_count"), F.grouping("category").cast("int").alias("is_total"))


def corpus_summary(pages: DataFrame, patches: DataFrame | None = None, protected: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """One row over page reports (with total_ms, changed_outside, changed_protected, identical: null where not applicable; the greatest
    peak_rss_mb, if there). ``patches_pass``: none of ``patches`` has ``failed``. ``protected`` pages add their changed_protected.
    ``visual_pass``: ``passed`` of ``reviews``, one row."""
    passed = lambda rate: F.sum(F.bround(F.col(rate) * F.col("eligible_count")).cast("long"))
    s = pages.agg(
        F.bround(F.percentile("total_ms", 0.5)).alias("median_total_ms"), F.bround(F.percentile("total_ms", 0.95)).alias("p95_total_ms"),
        passed("residual_pass_rate").alias("rp"), passed("automatic_pass_rate").alias("ap"), F.sum("eligible_count").alias("e"), F.sum("region_count").alias("r"),
        F.sum("needs_review_count").alias("needs_review_count"), F.sum("unexpected_count").alias("unexpected_count"), F.sum("preserved_sfx_count").alias("preserved_sfx_count"),
        F.sum("changed_outside").alias("changed_outside"), F.sum("changed_protected").alias("changed_protected"), F.coalesce(F.bool_and("identical"), F.lit(True)).alias("text_free_identical"),
        *([F.max("peak_rss_mb").alias("peak_rss_mb")] if "peak_rss_mb" in pages.columns else []),
    )
    # Each of these is one row: a scalar subquery.
    if protected is not None:
        s = s.withColumn("changed_protected", F.col("changed_protected") + protected.agg(F.coalesce(F.sum("changed_protected"), F.lit(0))).scalar())
    if patches is not None:
        s = s.withColumn("patches_pass", patches.agg(~F.coalesce(F.bool_or("failed"), F.lit(False))).scalar())
    if reviews is not None:
        s = s.withColumn("visual_pass", reviews.select("passed").scalar())
    return s.withColumns({"residual_pass_rate": safe_ratio(F.col("rp"), F.col("e")), "automatic_pass_rate": safe_ratio(F.col("ap"), F.col("e")), "needs_review_rate": safe_ratio(F.col("needs_review_count"), F.col("r"), 0.0)}).drop("rp", "ap", "e", "r")


def acceptance_gate(summary: DataFrame) -> DataFrame:
    """The clauses of the gate, each a column, and ``passed``. Needs patches_pass and visual_pass."""
    c = F.col
    clauses = {
        "gate_time": c("median_total_ms") <= 30000, "gate_residual": c("residual_pass_rate") >= d(0.95), "gate_automatic": c("automatic_pass_rate") >= d(0.90), "gate_unexpected": c("unexpected_count") == 0,
        "gate_outside": c("changed_outside") == 0, "gate_protected": c("changed_protected") == 0, "gate_identical": c("text_free_identical"), "gate_patches": c("patches_pass"), "gate_visual": c("visual_pass"),
    }
    out = summary.withColumns(clauses)
    every = F.lit(True)
    for name in clauses:
        every = every & c(name)
    return out.withColumn("passed", every)


def coverage_gate(reviews: DataFrame, required: list[str], passes: int = 12, each: int = 3) -> DataFrame:
    """``passed``: enough passing reviews (decision, categories), and enough of them in each required category."""
    good = reviews.where(F.col("decision") == "pass")
    by = F.struct(*(F.count_if(F.array_contains("categories", c)).alias(f"n_{i}") for i, c in enumerate(required)))
    return good.agg(F.count("*").alias("passes"), by.alias("by")).select("passes", F.least(*(F.col(f"by.n_{i}") for i in range(len(required)))).alias("least_covered")).withColumn("passed", (F.col("passes") >= passes) & (F.col("least_covered") >= each))


def protected_report(pages: DataFrame) -> DataFrame:
    """``identical`` is asked of credit and UI pages alone (categories); null elsewhere."""
    asked = F.arrays_overlap("categories", F.array(F.lit("credits"), F.lit("ui")))
    return pages.withColumn("page_identical", F.when(asked, F.col("changed") == 0))


def patch_score(components: DataFrame) -> DataFrame:
    """Rectangular patches per page: greatest fill and area ratio of components, and whether any full one is too large."""
    fill, ratio = F.col("area") / (F.col("w") * F.col("h")), F.col("area") / (F.col("page_w") * F.col("page_h"))
    return components.groupBy("page_id").agg(F.bround(F.max(fill), 6).alias("max_fill"), F.bround(F.max(ratio), 6).alias("max_ratio"), F.bool_or((fill >= d(0.85)) & (ratio > d(0.01))).alias("failed"))


def page_legend(regions: DataFrame) -> DataFrame:
    return regions.groupBy("page_id").agg(n_if(F.col("status") == "repaired").alias("clean"), n_if(F.col("status") == "needs_review").alias("review"), n_if(F.col("status") == "preserved").alias("protected"), F.min_by("page_role", "ord").alias("page_role"))


def residual_score(pixels: DataFrame, strokes: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """0.75 * mean probability + 0.25 * min(1, strokes / max(1, n / 64)) per region, in [0, 1]; strokes are components of at
    least 3 pixels. Regions with a reading in ``ocr`` (page_id, region, ocr) are blended with it, 0.75 to 0.25."""
    p = pixels.groupBy("page_id", "region").agg(F.avg("prob").alias("mean"), F.count("*").alias("n"))
    s = strokes.groupBy("page_id", "region").agg(F.count_if(F.col("area") >= 3).alias("strokes"))
    score = d(0.75) * F.col("mean") + d(0.25) * F.least(d(1), F.coalesce("strokes", F.lit(0)) / F.greatest(d(1), F.col("n") / 64))
    out = p.join(s, ["page_id", "region"], "left").select("page_id", "region", score.alias("base"))
    if ocr is None:
        return out.select("page_id", "region", clip(F.col("base")).alias("residual"))
    blended = F.when(F.col("ocr").isNull(), F.col("base")).otherwise(d(0.75) * F.col("base") + d(0.25) * clip(F.col("ocr")))
    return out.join(ocr.select("page_id", "region", "ocr"), ["page_id", "region"], "left").select("page_id", "region", clip(blended).alias("residual"))


def text_coverage(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page_id").agg(F.least(d(1), F.sum(F.col("w") * F.col("h")) / F.min(F.col("page_w") * F.col("page_h"))).alias("coverage"))


def ordered_reasons(zones: DataFrame, fallback: str = "low-confidence") -> DataFrame:
    """Distinct reasons of a page in order of first mention."""
    r = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("ord", "reason")))), lambda x: x["reason"]))
    return zones.groupBy("page_id").agg(r.alias("r")).select("page_id", F.when(F.size("r") == 0, F.array(F.lit(fallback))).otherwise(F.col("r")).alias("reasons"))


def stage_timings(events: DataFrame, stages: list[str], key: str = "page_id") -> DataFrame:
    """Milliseconds by stage, and their total."""
    wide = events.groupBy(key).pivot("stage", stages).agg(F.sum("ms")).fillna(0, subset=stages)
    total = F.lit(0)
    for s in stages:
        total = total + F.col(s)
    return wide.withColumn("total", total)


def stage_percentiles(timings: DataFrame, stages: list[str]) -> DataFrame:
    """Over the rows of ``stage_timings``: median and 95th percentile of each stage and of the total, a row each."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms")) for s in [*stages, "total"]))).alias("x")
    return timings.select(each).groupBy("x.stage").agg(F.percentile("x.ms", 0.5).alias("median_ms"), F.percentile("x.ms", 0.95).alias("p95_ms"))


def slice_tally(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("page_id").agg(n_if(F.col("status") != "malformed").alias("ok"), F.count("*").alias("tiles")).withColumn("failed", F.col("ok") == 0)
