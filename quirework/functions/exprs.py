"""Column expressions: text repair, keys, scores, geometry helpers. Everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEED = 20260727
CATEGORIES = ["white-bubble", "colored-bubble", "vertical-japanese", "outlined-or-colored-text", "artwork-sfx", "screentone", "complex-color", "dense-text", "text-free"]
LANGUAGE_TAGS = r"(?iu)\[(?:English|Chinese|Thai|中国語版)\]|ภาษาไทย"
EXCLUDED_TAGS = ["[english]", "[chinese]", "[thai]", "ภาษาไทย", "[中国語版]"]


def d(x: float) -> Column:
    """A double literal: thresholds must not become decimals."""
    return F.lit(float(x))


def half_up(x: Column) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(x + 0.5)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(d(low), F.least(d(high), x))


def safe_ratio(n: Column, total: Column, default: float = 1.0) -> Column:
    return F.when(total == 0, d(default)).otherwise(n / total)


# --- LLM payloads -----------------------------------------------------------------------------------------


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; null otherwise. In brackets, trailing text no
    longer parses and two values make two elements."""
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(whole) == 1, F.element_at(whole, 1))


def repair_candidates(text: Column) -> list[Column]:
    """What is tried, in order: without fences; without trailing commas; cut after the last brace and closed; without what
    follows the last brace."""
    base = F.trim(F.regexp_replace(F.regexp_replace(text, "(?i)```json", ""), "```", ""))
    base = F.regexp_replace(base, r"^\s+|\s+$", "")
    plain = F.regexp_replace(base, r",\s*([\]}])", "$1")
    upto = F.regexp_extract(plain, r"(?s)^(.*\})", 1)
    cut = F.when(plain.contains("}"), F.concat(upto, F.lit("]}")))
    return [base, plain, cut, upto]


def repair_json(text: Column) -> Column:
    return F.coalesce(*(strict_json(c) for c in repair_candidates(text)))


# --- keys -------------------------------------------------------------------------------------------------


def natural_key(name: Column) -> Column:
    """Sorts ``page2`` before ``page10``, whatever the case: digit runs are padded."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def anonymise_path(path: Column) -> Column:
    return F.sha2(F.regexp_replace(path, LANGUAGE_TAGS, ""), 256)


def seeded_key(key: Column, seed: int = SEED) -> Column:
    """First 8 bytes of sha256("seed:key") as fixed-width hex, which sorts as the unsigned number does."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)


def cache_key(content: Column, version: Column, models: Column, settings: Column) -> Column:
    """Content-addressed key over bytes, version, model digests and settings (a map, taken in key order)."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(settings))))
    return F.sha2(F.concat(content, version, F.array_join(models, ""), ordered), 256)


def tagged(path: Column) -> Column:
    """Whether a path carries a tag that keeps it out of the corpus."""
    low = F.lower(path)
    return reduce(lambda a, b: a | b, (low.contains(t) for t in EXCLUDED_TAGS))


def split_name(name: Column, default: str = "png") -> tuple[Column, Column]:
    """(base, extension), cut at the last dot."""
    has = name.rlike(r"(?s)^.+\.[^.]+$")
    return F.when(has, F.regexp_extract(name, r"(?s)^(.*)\.([^.]+)$", 1)).otherwise(name), F.when(has, F.regexp_extract(name, r"(?s)^(.*)\.([^.]+)$", 2)).otherwise(F.lit(default))


def media_kind(name: Column) -> Column:
    ext = F.lower(split_name(name, "")[1])
    return F.when(ext.isin("png", "jpg", "jpeg", "webp"), "image").when(ext.isin("zip", "cbz"), "archive").when(ext == "pdf", "pdf").otherwise("other")


def image_type(name: Column) -> Column:
    """Media type of an image by its extension; JPEG if it has another one or none."""
    ext = F.lower(split_name(name, "")[1])
    return F.when(ext.isin("png", "webp", "gif"), F.concat(F.lit("image/"), ext)).otherwise("image/jpeg")


# --- scores -----------------------------------------------------------------------------------------------


def category_scores(white, edge, contrast, saturation, portrait, dark, midtone, laplacian, spread) -> Column:
    """Nine scores, each a weighted sum of page features, as a map in the fixed order of the categories."""
    one = d(1)
    values = [
        d(1.6) * white + edge + d(0.4) * contrast,
        d(1.2) * saturation + edge + d(0.3) * white,
        d(1.5) * portrait + edge + d(0.2) * dark,
        d(1.1) * saturation + d(1.5) * edge + contrast,
        d(1.8) * edge + contrast + d(0.5) * dark,
        d(0.9) * midtone + d(0.8) * F.least(laplacian, d(1.5)) + edge,
        d(1.5) * saturation + spread + contrast,
        d(2.2) * edge + dark + d(0.5) * portrait,
        d(1.8) * (one - F.least(edge * d(8), one)) + d(0.4) * (one - F.least(contrast, one)),
    ]
    return F.map_from_arrays(F.array(*map(F.lit, CATEGORIES)), F.array(*values))


def argmax_category(scores: Column) -> Column:
    """The category of the highest score; of equal ones the first in the fixed order."""
    ranked = F.array(*(F.struct(F.element_at(scores, F.lit(c)).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(CATEGORIES)))
    return F.array_max(ranked)["name"]


def numeric_entries(values: Column) -> Column:
    """Entries of a map of strings whose value is a number, as doubles."""
    return F.transform_values(F.map_filter(values, lambda k, v: v.try_cast("double").isNotNull()), lambda k, v: v.try_cast("double"))


# --- geometry ---------------------------------------------------------------------------------------------


def iou(a, b) -> Column:
    """Intersection over union of structs with x1, y1, x2, y2; null where the union is empty."""
    w = F.greatest(d(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(d(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def retry_key(automatic_key: Column, region_id: Column, mask: Column) -> Column:
    """Key of a retry: the automatic key, the region and the mask's bytes, hashed one after the other."""
    return F.sha2(F.concat(automatic_key.cast("string").cast("binary"), region_id.cast("string").cast("binary"), mask.cast("binary")), 256)


def gap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Distance between two rectangles; 0 if they touch."""
    dx = F.greatest(d(0), F.greatest(ax, bx) - F.least(ax + aw, bx + bw))
    dy = F.greatest(d(0), F.greatest(ay, by) - F.least(ay + ah, by + bh))
    return F.sqrt(dx * dx + dy * dy)
