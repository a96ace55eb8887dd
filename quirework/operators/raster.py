"""Reductions over raster tables (page_id, y, x, v). Kernels over neighbours are not built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, d

BAND = 64


def _banded(zones: DataFrame, band: int) -> DataFrame:
    """Zones (zone_id, zx, zy, zw, zh), one row for each band of rows that they touch."""
    first, last = F.floor(F.col("zy") / band), F.floor((F.col("zy") + F.col("zh") - 1) / band)
    return zones.withColumn("band", F.explode(F.sequence(first, F.greatest(first, last))))


def in_zones(pixels: DataFrame, zones: DataFrame, band: int = BAND) -> DataFrame:
    """Pixels with each zone that holds them: an equi-join by page and band of rows, then the exact test."""
    p = pixels.withColumn("band", F.floor(F.col("y") / band))
    inside = (F.col("x") >= F.col("zx")) & (F.col("x") < F.col("zx") + F.col("zw")) & (F.col("y") >= F.col("zy")) & (F.col("y") < F.col("zy") + F.col("zh"))
    return p.join(_banded(zones, band), ["page_id", "band"]).where(inside).drop("band")


def zonal_stats(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Mean grey of a zone, whether its ground is light, and the share of pixels that count as text there. The mean decides
    what counts, so a histogram per zone (256 rows at most) is kept and read twice."""
    h = in_zones(pixels, zones).groupBy("page_id", "zone_id", "v").agg(F.count("*").alias("n"))
    m = h.groupBy("page_id", "zone_id").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.sum(F.when(F.col("v") <= 140, F.col("n")).otherwise(0)).alias("dark"), F.sum(F.when(F.col("v") > 115, F.col("n")).otherwise(0)).alias("light"))
    on_light = F.col("mean") > 127
    return m.select("page_id", "zone_id", "mean", on_light.alias("on_light"), (F.when(on_light, F.col("dark")).otherwise(F.col("light")) / F.col("n")).alias("masked_share"))


def page_stats(pixels: DataFrame, sample_stride: int = 1) -> DataFrame:
    """Shares of light, dark and middle grey, contrast, and how upright the page is, 0 to 1. With channels ``r``, ``g``, ``b``
    (0 to 255) also mean saturation and mean spread of a pixel's channels."""
    size = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph")) if sample_stride > 1 else None
    if sample_stride > 1:
        pixels = pixels.where((F.col("x") % sample_stride == 0) & (F.col("y") % sample_stride == 0))
    share = lambda c: F.avg(c.cast("double"))
    v = F.col("v")
    colour = []
    if {"r", "g", "b"} <= set(pixels.columns):
        top, low, mean = F.greatest("r", "g", "b"), F.least("r", "g", "b"), (F.col("r") + F.col("g") + F.col("b")) / 3
        apart = F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in "rgb"), F.lit(0)) / 3)
        colour = [F.avg(F.when(top == 0, d(0)).otherwise(F.round(255 * (top - low) / top) / 255)).alias("saturation"), (F.avg(apart) / 120).alias("channel_spread")]
    out = pixels.groupBy("page_id").agg(share(v >= 238).alias("white"), share(v <= 55).alias("dark"), share((v > 60) & (v < 220)).alias("midtone"), (F.stddev_pop("v") / 96).alias("contrast"), *colour, (F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph"))
    if size is not None:
        out = out.drop("pw", "ph").join(size, "page_id")
    return out.withColumn("portrait", clip((F.col("ph") / F.col("pw") - 1) / 0.8)).drop("pw", "ph")


def page_profile(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """90th percentile over rows of their dark share, and the share of dark pixels in the outer fifth."""
    is_dark = F.col("v") < dark
    w = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph"))
    outer = (F.col("x") < 0.2 * F.col("pw")) | (F.col("x") >= 0.8 * F.col("pw")) | (F.col("y") < 0.2 * F.col("ph")) | (F.col("y") >= 0.8 * F.col("ph"))
    rows = pixels.join(w, "page_id").groupBy("page_id", "y").agg(F.count_if(is_dark).alias("dark"), F.count("*").alias("n"), F.count_if(is_dark & outer).alias("outer_dark"))
    return rows.groupBy("page_id").agg(F.percentile(F.col("dark") / F.col("n"), 0.9).alias("band_score"), F.coalesce(F.try_divide(F.sum("outer_dark"), F.sum("dark")), d(0)).alias("margin_share"))


def raster_diff(original: DataFrame, cleaned: DataFrame, support: DataFrame, protected: DataFrame) -> DataFrame:
    """Changed pixels per page, those outside the support and inside protected masks (pixel tables), and identity. A pixel that
    one side lacks is changed."""
    at = ["page_id", "y", "x"]
    both = original.select(*at, "v").join(cleaned.select(*at, F.col("v").alias("v2")), at, "full")
    both = both.join(support.select(*at).distinct().withColumn("s", F.lit(True)), at, "left").join(protected.select(*at).distinct().withColumn("p", F.lit(True)), at, "left")
    c = ~F.col("v").eqNullSafe(F.col("v2"))
    return both.groupBy("page_id").agg(F.count_if(c).alias("changed"), F.count_if(c & F.col("s").isNull()).alias("outside"), F.count_if(c & F.col("p").isNotNull()).alias("inside_protected"), (F.count_if(c) == 0).alias("identical"))


def mask_bbox(mask: DataFrame) -> DataFrame:
    return mask.groupBy("page_id").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_id", "y", "x").union(b.select("page_id", "y", "x")).distinct()


def mask_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    at = ["page_id", "y", "x"]
    return a.select(*at).join(b.select(*at).distinct(), at, "left_anti")


def zone_texture(pixels: DataFrame, zones: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Entropy of ``v`` in bits, mean distance of a pixel's ``channels`` (``v`` alone if not given) to the point of their medians, and share of v below 80.
    With gradients ``gx``, ``gy`` of the pixels also ``coherence``: the length of their sum by the sum of their lengths, 0 where there is none.

    All come from one joint histogram a zone: its rows are the distinct pixels, summed up in the scan's tasks, and the medians of all channels
    one aggregate over them."""
    inside = in_zones(pixels, zones)
    key, c = ["page_id", "zone_id"], channels or ["v"]
    h = inside.groupBy(*key, *dict.fromkeys(["v", *c])).agg(F.count("*").alias("n"))
    t = h.groupBy(*key).agg(F.sum("n").alias("t"), *(F.expr(f"percentile({x}, 0.5, n)").alias(f"mid_{x}") for x in c))
    apart = F.sqrt(sum(((F.col(x) - F.col(f"mid_{x}")) * (F.col(x) - F.col(f"mid_{x}")) for x in c), d(0)))
    share = F.col("n") / F.col("t")
    spread = h.join(t, key).groupBy(*key).agg((F.sum(apart * F.col("n")) / F.first("t")).alias("spread"), (F.sum(F.when(F.col("v") < 80, F.col("n")).otherwise(0)) / F.first("t")).alias("dark_share"))
    grey = h.groupBy(*key, "v").agg(F.sum("n").alias("n")).join(t.select(*key, "t"), key).groupBy(*key).agg((-F.sum(share * F.log2(share))).alias("entropy"))
    out = grey.join(spread, key)
    if not {"gx", "gy"} <= set(pixels.columns):
        return out
    g = inside.groupBy(*key).agg(F.hypot(F.sum("gx"), F.sum("gy")).alias("along"), F.sum(F.hypot("gx", "gy")).alias("all"))
    return out.join(g.select(*key, F.when(F.col("all") <= 1e-6, d(0)).otherwise(F.least(d(1), F.col("along") / F.col("all"))).alias("coherence")), key)


def backing_uniformity(pixels: DataFrame, mask: DataFrame, zones: DataFrame) -> DataFrame:
    at = ["page_id", "y", "x"]
    ground = in_zones(pixels.join(mask.select(*at).distinct(), at, "left_anti"), zones)
    return ground.groupBy("page_id", "zone_id").agg(clip(1 - F.stddev_pop("v") / 96).alias("uniformity"))
