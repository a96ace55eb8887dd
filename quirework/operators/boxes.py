"""Spatial operators on detected boxes. All are keyed by page; none gathers more than one page's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clip, d, gap, half_up, iou


def detector_candidates(raw: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Rows (…, cx, cy, w, h, obj, cls array) that pass both confidence gates, with the class of the highest score."""
    best = F.array_max("cls")
    out = raw.where(F.col("obj") > d(threshold)).withColumn("conf", F.col("obj") * best).withColumn("class_id", F.array_position("cls", best).cast("int") - 1)
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    out = out.where(F.col("conf") > d(threshold))
    return out.withColumns({"x1": F.col("cx") - half_w, "y1": F.col("cy") - half_h, "x2": F.col("cx") + half_w, "y2": F.col("cy") + half_h})


def greedy_nms(boxes: DataFrame, key: str = "page_id", threshold: float = 0.1, most: int = 300, apart: float = 4096.0) -> DataFrame:
    """Greedy suppression per page: by falling confidence (then det_id), a box stays if it overlaps no kept box of its class
    by more than ``threshold``. Classes are moved apart, so one fold serves all. ``boxes`` has det_id, conf, class_id, x1..y2.

    At most ``most`` stay, and each box is held against those kept before it."""
    shift = F.col("class_id") * d(apart)
    box = F.struct(
        (-F.col("conf")).alias("neg"), "det_id", "class_id", (F.col("x1") + shift).alias("x1"), (F.col("y1") + shift).alias("y1"), (F.col("x2") + shift).alias("x2"), (F.col("y2") + shift).alias("y2")
    )
    pages = boxes.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("all"))
    none = F.slice(F.col("all"), 1, 0)
    kept = F.aggregate("all", none, lambda acc, b: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: F.coalesce(iou(k, b), d(0)) > d(threshold)), acc).otherwise(F.concat(acc, F.array(b))))
    out = pages.select(key, F.posexplode(kept).alias("rank", "b"))
    shift = F.col("b.class_id") * d(apart)
    return out.select(key, "rank", "b.det_id", "b.class_id", (-F.col("b.neg")).alias("conf"), *((F.col(f"b.{c}") - shift).alias(c) for c in ("x1", "y1", "x2", "y2")))


def unletterbox_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes in model pixels to page pixels. Needs page_w, page_h, input_size, and takes pad_x, pad_y if they are there (else the
    page lies at the top left); halves round to even; empty boxes go."""
    scale = F.least(F.col("input_size") / F.col("page_w"), F.col("input_size") / F.col("page_h"))
    pad_x, pad_y = (F.col(c) if c in boxes.columns else d(0) for c in ("pad_x", "pad_y"))
    at = lambda c, pad, most: F.least(F.greatest(F.bround((F.col(c) - pad) / scale), d(0)), F.col(most).cast("double"))
    out = boxes.withColumns({"x1": at("x1", pad_x, "page_w"), "y1": at("y1", pad_y, "page_h"), "x2": at("x2", pad_x, "page_w"), "y2": at("y2", pad_y, "page_h")})
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")})


def by_centre(boxes: DataFrame, key: str = "page_id") -> DataFrame:
    """Boxes numbered by vertical centre."""
    return boxes.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy((F.col("y1") + F.col("y2")) / 2, "det_id")))


def tile_grid(pages: DataFrame, rows: int = 3, cols: int = 2, overlap: float = 0.15) -> DataFrame:
    """Overlapping tiles of each page (page_w, page_h), row by row, clamped to the page."""
    bw, bh = F.col("page_w") / cols, F.col("page_h") / rows
    t = pages.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1)))).withColumns({"row": F.floor(F.col("tile") / cols).cast("int"), "col": (F.col("tile") % cols).cast("int")})
    edge = lambda on, size: F.when(on, size * d(overlap)).otherwise(d(0))
    sx = F.greatest(d(0), F.col("col") * bw - edge(F.col("col") > 0, bw))
    sy = F.greatest(d(0), F.col("row") * bh - edge(F.col("row") > 0, bh))
    ex = F.least(F.col("page_w").cast("double"), (F.col("col") + 1) * bw + edge(F.col("col") < cols - 1, bw))
    ey = F.least(F.col("page_h").cast("double"), (F.col("row") + 1) * bh + edge(F.col("row") < rows - 1, bh))
    return t.withColumns({"sx": sx, "sy": sy, "tile_w": ex - sx, "tile_h": ey - sy})


def flag_invalid_boxes(bubbles: DataFrame) -> DataFrame:
    """``box`` (ymin, xmin, ymax, xmax; 0 to 1000) or the whole page where it isn't four numbers; ``is_invalid_box``."""
    four = F.col("box").isNotNull() & (F.size("box") == 4)
    b = F.when(four, F.col("box")).otherwise(F.array(d(0), d(0), d(1000), d(1000)))
    w, h = b[3] - b[1], b[2] - b[0]
    return bubbles.withColumn("is_invalid_box", ~four | ((w >= 950) & (h >= 950)) | ((w == 0) & (h == 0))).withColumn("box", b)


def tile_to_page(bubbles: DataFrame, whole: bool = True) -> DataFrame:
    """``box`` of a tile or crop (sx, sy, tile_w, tile_h) to the page (page_w, page_h), both 0 to 1000. Tiles give ``whole`` numbers,
    halves up; crops don't round. A box that isn't four numbers stays as it is."""
    put = half_up if whole else lambda c: c
    y = lambda i: put((F.col("box")[i] / 1000 * F.col("tile_h") + F.col("sy")) / F.col("page_h") * 1000).cast("double")
    x = lambda i: put((F.col("box")[i] / 1000 * F.col("tile_w") + F.col("sx")) / F.col("page_w") * 1000).cast("double")
    return bubbles.withColumn("box", F.when(F.size("box") == 4, F.array(y(0), x(1), y(2), x(3))).otherwise(F.col("box")))


def merge_tiles(bubbles: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Bubbles of all tiles of a page, without those that overlap an earlier kept valid one by more than ``threshold``.
    Invalid boxes neither drop others nor are dropped. Order: tile, idx."""
    item = F.struct("tile", "idx", "is_invalid_box", F.col("box")[1].alias("x1"), F.col("box")[0].alias("y1"), F.col("box")[3].alias("x2"), F.col("box")[2].alias("y2"))
    pages = bubbles.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    hit = lambda acc, b: F.exists(acc, lambda k: ~k["is_invalid_box"] & (F.coalesce(iou(k, b), d(0)) > d(threshold)))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(~b["is_invalid_box"] & hit(acc, b), acc).otherwise(F.concat(acc, F.array(b))))
    return pages.select("page_id", F.posexplode(kept).alias("ord", "b")).select("page_id", "ord", "b.*")


def layout_boxes(bubbles: DataFrame) -> DataFrame:
    """Centre and size in per cent, clamped, from ``box`` or x, y, w, h; boxes without a place get a fallback slot, by idx. With page_w and page_h
    also the box in pixels of the page: its top left corner, width and height."""
    box, four = F.col("box"), F.col("box").isNotNull() & (F.size("box") == 4)
    big = (F.coalesce("x", d(50)) > 100) | (F.coalesce("y", d(50)) > 100) | (F.coalesce("w", d(22)) > 100) | (F.coalesce("h", d(10)) > 100)
    own = lambda c, default: F.coalesce(F.col(c), d(default)) / F.when(big, d(10)).otherwise(d(1))
    raw_w = F.when(four, F.abs(box[3] - box[1]) / 10).otherwise(own("w", 22))
    raw_h = F.when(four, F.abs(box[2] - box[0]) / 10).otherwise(own("h", 10))
    b = bubbles.withColumns({
        "rx": F.when(four, (box[1] + box[3]) / 2 / 10).otherwise(own("x", 50)),
        "ry": F.when(four, (box[0] + box[2]) / 2 / 10).otherwise(own("y", 50)),
        "rw": raw_w, "rh": raw_h,
        "bad": F.coalesce("is_invalid_box", F.lit(False)) | F.when(four, ((raw_w >= 85) & (raw_h >= 85)) | ((raw_w == 0) & (raw_h == 0))).otherwise(F.col("x").isNull() & F.col("y").isNull()),
        "placed": four & ((box[1] != 0) | (box[3] != 1000)),
    })
    b = fallback_slots(b, F.col("bad") & ~F.coalesce("placed", F.lit(False)))
    x = F.when(F.col("slot").isNotNull(), d(50)).when(F.col("bad"), (box[1] + box[3]) / 2 / 10).otherwise(F.col("rx"))
    y = F.when(F.col("slot").isNotNull(), F.col("slot")).when(F.col("bad"), (box[0] + box[2]) / 2 / 10).otherwise(F.col("ry"))
    size = [c for c in ("page_w", "page_h") if c in bubbles.columns]
    out = b.select(
        "page_id", "idx", clip(x, 0, 100).alias("cx"), clip(y, 0, 100).alias("cy"),
        clip(F.when(F.col("bad"), d(30)).otherwise(F.col("rw")), 3, 85).alias("bw"), clip(F.when(F.col("bad"), d(15)).otherwise(F.col("rh")), 2, 85).alias("bh"), F.col("bad").alias("is_invalid_box"), *size,
    )
    if len(size) < 2:
        return out
    px = lambda c, whole: F.col(c) / 100 * F.col(whole)
    left, top = px("cx", "page_w") - px("bw", "page_w") / 2, px("cy", "page_h") - px("bh", "page_h") / 2
    return out.withColumns({"px": left, "py": top, "pw": px("bw", "page_w"), "ph": px("bh", "page_h")}).drop(*size)


def fallback_slots(bubbles: DataFrame, needs: Column) -> DataFrame:
    """``slot``: heights for bubbles without a place, from 10 by steps of 12, and from 8 again when the page is full; null for
    others. The running index has a closed form, so this is one window."""
    n = F.sum(needs.cast("int")).over(Window.partitionBy("page_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return bubbles.withColumn("slot", F.when(needs, F.when(n < 7, 10 + 12 * n).otherwise(8 + 12 * ((n - 7) % 7)).cast("double")))


def pad_rect(boxes: DataFrame, pad: float) -> DataFrame:
    """x, y, w, h grown by ``pad`` on all sides, inside page_w, page_h."""
    x, y = F.greatest(d(0), F.col("x") - pad), F.greatest(d(0), F.col("y") - pad)
    right, bottom = F.least(F.col("page_w").cast("double"), F.col("x") + F.col("w") + pad), F.least(F.col("page_h").cast("double"), F.col("y") + F.col("h") + pad)
    return boxes.withColumns({"px": x, "py": y, "pw": right - x, "ph": bottom - y})


def box_pairs(boxes: DataFrame, condition, cell: Column | None = None) -> DataFrame:
    """Pairs (page_id, a, b) of one page, a before b, for which ``condition`` holds on the columns a_* and b_*. ``cell`` (a
    band of y no lower than the longest reach) keeps large pages from meeting themselves whole: neighbours only."""
    at = boxes.withColumn("cell", F.lit(0) if cell is None else cell)
    left = at.select(*(F.col(c).alias(f"a_{c}") for c in at.columns))
    right = at.select(*(F.col(c).alias(f"b_{c}") for c in at.columns))
    if cell is not None:
        right = right.withColumn("b_cell", F.explode(F.array(F.col("b_cell") - 1, F.col("b_cell"), F.col("b_cell") + 1)))
    met = left.join(right, (F.col("a_page_id") == F.col("b_page_id")) & (F.col("a_cell") == F.col("b_cell")) & (F.col("a_box_id") < F.col("b_box_id")) & condition)
    return met.select(F.col("a_page_id").alias("page_id"), F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"))


def near(limit) -> Column:
    return gap(*(F.col(f"{s}_{c}") for s in "ab" for c in ("x", "y", "w", "h"))) <= limit


def aligned() -> Column:
    """The variant by axes: gaps under 4 % of the page both ways, heights within a ratio above 0.6."""
    c = lambda s, n: F.col(f"{s}_{n}")
    dx = F.greatest(d(0), F.greatest(c("a", "x"), c("b", "x")) - F.least(c("a", "x") + c("a", "w"), c("b", "x") + c("b", "w")))
    dy = F.greatest(d(0), F.greatest(c("a", "y"), c("b", "y")) - F.least(c("a", "y") + c("a", "h"), c("b", "y") + c("b", "h")))
    ratio = F.least(c("a", "h"), c("b", "h")) / F.greatest(c("a", "h"), c("b", "h"))
    return (dx < 0.04 * c("a", "page_w")) & (dy < 0.04 * c("a", "page_h")) & (ratio > 0.6)


def reading_order(boxes: DataFrame, band: float = 120.0) -> DataFrame:
    """``ord`` by bands from the top, right to left within a band."""
    row = F.floor((F.col("y") + F.col("h") / 2) / band)
    return boxes.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy(row, F.desc(F.col("x") + F.col("w") / 2), "box_id")))


def overlaps(a: str, b: str) -> Column:
    c = F.col
    return (c(f"{a}x") < c(f"{b}x") + c(f"{b}w")) & (c(f"{b}x") < c(f"{a}x") + c(f"{a}w")) & (c(f"{a}y") < c(f"{b}y") + c(f"{b}h")) & (c(f"{b}y") < c(f"{a}y") + c(f"{a}h"))


def intersects_flag(boxes: DataFrame, zones: DataFrame, name: str, grow: float = 0.0, band: float = 256.0) -> DataFrame:
    """``boxes`` with ``name``: whether any zone of the page (zx, zy, zw, zh), grown by ``grow``, meets the box. Both meet by the
    bands of the page that they lie in."""
    rows = lambda y, h: F.explode(F.sequence(F.floor(F.col(y) / band), F.greatest(F.floor(F.col(y) / band), F.floor((F.col(y) + F.col(h)) / band)))).alias("band")
    z = zones.select("page_id", (F.col("zx") - grow).alias("zx"), (F.col("zy") - grow).alias("zy"), (F.col("zw") + 2 * grow).alias("zw"), (F.col("zh") + 2 * grow).alias("zh"))
    places = boxes.select("page_id", "box_id", "x", "y", "w", "h", rows("y", "h"))
    hit = places.join(z.select("*", rows("zy", "zh")), ["page_id", "band"]).where(overlaps("", "z")).select("page_id", "box_id").distinct().withColumn(name, F.lit(True))
    return boxes.join(hit, ["page_id", "box_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def protect_zones(boxes: DataFrame, zones: DataFrame, dilation: float = 8.0) -> DataFrame:
    """``protected``: the box meets a zone grown by the dilation (exact for upright zones and a square kernel)."""
    return intersects_flag(boxes, zones, "protected", dilation)


def drop_specks(components: DataFrame, floor: int = 6, share: float = 2e-6) -> DataFrame:
    """Components of at least max(floor, round(page area * share)) pixels."""
    return components.where(F.col("area") >= F.greatest(d(floor), F.bround(F.col("page_w") * F.col("page_h") * share)))
