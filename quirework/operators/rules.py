"""Rule lists over feature tables. Each decision is one struct, so its parts can't disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clip, d

# Fixed values.
NARRATION, SFX, UI_AREA, UI_HEIGHT, RESIDUAL, BOUNDARY, RETRY_DAMAGE = 0.82, 0.90, 0.012, 0.08, 0.18, 0.25, 0.02


def _reasons(*names: str) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>") if names else F.array().cast("array<string>")


def classify_page(features: DataFrame) -> DataFrame:
    """``role`` and ``confidence`` of a page, the first rule that fits."""
    art, band, cover = F.col("line_art_density"), F.col("horizontal_band_score"), F.col("text_coverage")
    decide = lambda role, conf: F.struct(F.lit(role).alias("role"), conf.alias("confidence"))
    decision = (
        F.when((F.col("qr_count") > 0) & (F.col("margin_text_fraction") >= 0.45), decide("credits", d(0.95)))
        .when((band >= d(0.98)) & (cover < d(0.08)) & F.col("has_regions"), decide("ui", d(0.90)))
        .when((art >= d(0.035)) & F.col("has_regions"), decide("comic", F.least(d(0.98), d(0.70) + d(4) * (art - d(0.035)))))
        .when((band >= d(0.72)) & (cover >= d(0.08)), decide("ui", d(0.90)))
        .otherwise(decide("unknown", d(0.75)))
    )
    return features.withColumn("_d", decision).select(*features.columns, "_d.role", "_d.confidence")


def classify_eligibility(regions: DataFrame) -> DataFrame:
    """text_role, role_confidence, action and reasons of a region, the first rule that fits."""
    c = F.col
    uniform, rect, edge, rough, closed = c("backing_uniformity"), c("rectangular_backing"), c("artwork_edge_density"), c("stroke_irregularity"), c("enclosure_score")
    narration = F.greatest(uniform, d(0.55) * uniform + d(0.45) * rect)
    sfx = d(0.40) * edge + d(0.60) * rough
    label = (
        (c("w") * c("h") / (c("page_w") * c("page_h")) <= d(UI_AREA)) & (c("h") / c("page_h") <= d(UI_HEIGHT))
        & (F.greatest(closed, uniform, rect) < d(0.55)) & (F.greatest(edge, rough) < d(0.35))
    )
    given = lambda fallback: F.when(F.size(F.coalesce("protection_reasons", _reasons())) > 0, F.array_distinct("protection_reasons")).otherwise(_reasons(fallback))

    def decide(role, confidence, action, reasons):
        return F.struct(F.lit(role).alias("text_role"), clip(confidence).alias("role_confidence"), F.lit(action).alias("action"), reasons.alias("reasons"))

    low = _reasons("low-confidence")
    weak = F.greatest(narration, sfx)
    decision = (
        F.when(c("hits_protected"), decide("protected", d(1), "preserve", given("low-confidence")))
        .when(c("page_role") == "credits", decide("protected", c("page_confidence"), "preserve", _reasons("credit-page")))
        .when(c("hits_review") & label, decide("protected", d(1), "preserve", given("margin-mark")))
        .when(c("hits_review"), decide("review", d(1), "clean", given("margin-mark")))
        .when(closed >= d(0.72), decide("dialogue", closed, "clean", _reasons()))
        .when(((uniform >= d(0.55)) | (rect >= d(0.55))) & (narration >= d(NARRATION)), decide("narration", narration, "clean", _reasons()))
        .when((uniform >= d(0.55)) | (rect >= d(0.55)), decide("review", narration, "clean", low))
        .when(((edge >= d(0.35)) | (rough >= d(0.35))) & (sfx >= d(SFX)), decide("sfx", sfx, "preserve", _reasons("sfx-policy")))
        .when((edge >= d(0.35)) | (rough >= d(0.35)), decide("review", sfx, "clean", low))
        .when(label, decide("protected", weak, "preserve", low))
        .otherwise(decide("review", weak, "clean", low))
    )
    return regions.withColumn("_d", decision).select(*regions.columns, "_d.*")


def route_region(features: DataFrame) -> DataFrame:
    """``route`` (flat, gradient, artwork) and ``route_confidence``, which falls towards a rule's border."""
    v, e, g, n = F.col("lab_variance"), F.col("edge_density"), F.col("gradient_coherence"), F.col("entropy")
    decide = lambda route, conf: F.struct(F.lit(route).alias("route"), clip(conf).alias("route_confidence"))
    decision = (
        F.when((v < 18) & (e < d(0.08)), decide("flat", 1 - F.greatest(v / 18, e / d(0.08))))
        .when((v < 45) & (e < d(0.18)) & (g >= d(0.55)), decide("gradient", 1 - F.greatest(v / 45, e / d(0.18), 1 - g)))
        .otherwise(decide("artwork", F.least(d(1), F.greatest(d(0.5), v / 45, e / d(0.18), n / 8))))
    )
    return features.withColumn("_d", decision).select(*features.columns, "_d.*")


def verdict(scores: DataFrame) -> DataFrame:
    """``status``, ``retry_radius`` and ``passes`` from first-pass columns (outside_changed, boundary_error, damage_score,
    residual_score) and those of a second pass, ending in _2. One retry at most; ``preserved`` where nothing was to be done."""
    def accepted(s):
        return (F.col(f"outside_changed{s}") == 0) & (F.col(f"boundary_error{s}") <= d(BOUNDARY)) & (F.col(f"residual_score{s}") <= d(RESIDUAL))

    sound = (F.col("outside_changed") == 0) & (F.col("boundary_error") <= d(BOUNDARY))
    retry = sound & (F.col("residual_score") > d(RESIDUAL)) & (F.col("damage_score") <= d(RETRY_DAMAGE))
    ok = F.when(retry, accepted("_2")).otherwise(accepted(""))
    status = F.when(F.col("action") == "preserve", "preserved").when(ok, "repaired").otherwise("needs_review")
    return scores.withColumns({"retry_radius": F.when(retry & (F.col("action") != "preserve"), 2), "passes": F.when(F.col("action") == "preserve", 0).when(retry, 2).otherwise(1), "status": status})


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """``error``, ``code``, ``retryable`` and ``delay_ms`` of a request attempt (http_status, transport_error, block_reason,
    finish_reason); all null for a success."""
    s = F.col("http_status")
    blocked = F.col("block_reason").isNotNull() | F.col("finish_reason").isin("SAFETY", "PROHIBITED_CONTENT")
    decide = lambda e, code, retry: F.struct(F.lit(e).alias("error"), code.cast("int").alias("code"), retry.alias("retryable"))
    decision = (
        F.when(F.coalesce("transport_error", F.lit(False)), decide("TIMEOUT", F.lit(504), F.lit(True)))
        .when(s == 429, decide("QUOTA", s, F.lit(True)))
        .when(s >= 400, decide("UPSTREAM", s, s >= 500))
        .when(blocked, decide("BLOCKED", F.lit(400), F.lit(False)))
    )
    out = attempts.withColumn("_d", decision).select(*attempts.columns, "_d.*")
    return out.withColumn("delay_ms", F.when(F.col("retryable"), F.when(F.col("error") == "QUOTA", 60000).otherwise(5000)))


def audit_fallback(attempts: DataFrame, budget_s: float = 90.0) -> DataFrame:
    """What a request log should have done next (retry, next-key, next-model, stop) against what it did."""
    w = Window.partitionBy("page_id").orderBy("attempt")
    s, failed = F.col("http_status"), F.coalesce("transport_error", F.lit(False)) | (F.col("http_status") >= 400)
    same = (F.lag("model").over(w) == F.col("model")) & (F.lag("key_index").over(w) == F.col("key_index")) & F.lag("http_status").over(w).isin(500, 503)
    expected = (
        F.when(~failed, "done").when(F.col("elapsed_s") >= d(budget_s), "stop")
        .when(F.coalesce("transport_error", F.lit(False)), "next-model")
        .when(s.isin(500, 503) & ~F.coalesce(same, F.lit(False)), "retry")
        .when(s.isin(400, 403, 429), "next-key").otherwise("next-model")
    )
    nm, nk = F.lead("model").over(w), F.lead("key_index").over(w)
    did = F.when(nm.isNull(), F.when(failed, "stop").otherwise("done")).when(nm != F.col("model"), "next-model").when(nk != F.col("key_index"), "next-key").otherwise("retry")
    return attempts.withColumns({"expected": expected, "did": did, "late": F.col("elapsed_s") >= d(budget_s)})
