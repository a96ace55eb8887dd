"""Registered queries of the page operators, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import boxes as B
from ..operators import curate, ingest, metrics, regions, rules, state
from .inputs import Reader, oracle
from .page import run_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(fn: Callable[[Reader], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Reader(spark, folder))
        if sql:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return put


def xyxy(df: DataFrame) -> DataFrame:
    return df.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h"), "det_id": F.col("box_id")})


# --- text and payloads ------------------------------------------------------------------------------------

_REPAIRED = r"""c AS (SELECT page_id, tile, body, trim(regexp_replace(regexp_replace(body, '```json', '', 'gi'), '```', '', 'g'), ' ' || chr(10)) AS base FROM payloads),
c2 AS (SELECT *, regexp_replace(base, ',\s*([\]}])', '\1', 'g') AS plain FROM c), c3 AS (SELECT *, regexp_extract(plain, '^(.*\})', 1, 's') AS upto FROM c2),
c4 AS (SELECT page_id, tile, CASE WHEN json_valid(base) AND NOT regexp_matches(base, ',\s*[\]}]') THEN base WHEN json_valid(plain) THEN plain
    WHEN contains(plain, '}') AND json_valid(upto || ']}') THEN upto || ']}' WHEN upto <> '' AND json_valid(upto) THEN upto END AS good FROM c3),
ing AS (SELECT page_id, tile, CASE WHEN good IS NULL OR json_type(good, '$.bubbles') IS DISTINCT FROM 'ARRAY' THEN 'malformed' WHEN json_array_length(good, '$.bubbles') = 0 THEN 'empty' ELSE 'ok' END AS status, good FROM c4),
bub AS (SELECT page_id, tile, CAST(i AS INT) AS idx, json_extract_string(good, '$.bubbles[' || i || '].t') AS t, CAST(json_extract(good, '$.bubbles[' || i || '].box') AS DOUBLE[]) AS box
    FROM (SELECT *, unnest(range(CAST(json_array_length(good, '$.bubbles') AS BIGINT))) AS i FROM ing WHERE status = 'ok'))"""


@query(f"WITH {_REPAIRED} SELECT page_id, tile, status FROM ing")
def repair_json(r):
    return ingest.ingest_bubbles(r.payloads).select("page_id", "tile", "status")


@query(f"WITH {_REPAIRED} SELECT page_id, tile, idx, t, box FROM bub")
def ingest_bubbles(r):
    return ingest.exploded(ingest.ingest_bubbles(r.payloads), "page_id", "tile")


@query(f"WITH {_REPAIRED} SELECT page_id, count(*) FILTER (status <> 'malformed') AS ok, count(*) AS tiles, count(*) FILTER (status <> 'malformed') = 0 AS failed FROM ing GROUP BY page_id")
def slice_tally(r):
    return metrics.slice_tally(ingest.ingest_bubbles(r.payloads))


@query("SELECT page_id, idx, t FROM lines WHERE NOT deleted AND trim(coalesce(nullif(t, ''), translated, '')) <> ''")
def live_bubbles(r):
    return ingest.live_bubbles(r.lines).select("page_id", "idx", "t")


@query("SELECT page_id, idx, t FROM lines QUALIFY row_number() OVER (PARTITION BY page_id, trim(t) ORDER BY idx) <= 3")
def cap_repeats(r):
    return ingest.cap_repeats(r.lines).select("page_id", "idx", "t")


@query("""WITH live AS (SELECT page_id, idx, t FROM lines WHERE NOT deleted AND trim(coalesce(nullif(t, ''), translated, '')) <> ''),
capped AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY page_id, trim(t) ORDER BY idx) <= 3)
SELECT page_id, count(*) AS bubbles, CAST(sum(length(t)) AS BIGINT) AS chars FROM capped GROUP BY page_id""")
def flagship_bubbles(r):
    kept = ingest.cap_repeats(ingest.live_bubbles(r.lines))
    return kept.groupBy("page_id").agg(F.count("*").alias("bubbles"), F.sum(F.length("t")).alias("chars"))


@query("""WITH b AS (SELECT conv_id AS page_id, CASE role WHEN 'user' THEN 1 ELSE 0 END AS src, turn AS idx, text AS t FROM conversations WHERE conv_id % 5 <> 0)
SELECT p.page_id, CASE WHEN l.n IS NULL THEN 'clean-only' ELSE 'render' END AS kind, CAST(coalesce(n, 0) AS INT) AS n_bubbles, coalesce(texts, []) AS texts
FROM (SELECT DISTINCT conv_id AS page_id FROM conversations) p LEFT JOIN (SELECT page_id, count(*) AS n, list(t ORDER BY src, idx) AS texts FROM b GROUP BY page_id) l USING (page_id)""")
def merge_bubbles(r):
    c = r.conversations.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("idx"), F.col("text").alias("t"), "role")
    b = c.where(F.col("page_id") % 5 != 0)
    return ingest.merge_bubbles(c.select("page_id").distinct(), b.where("role <> 'user'"), b.where("role = 'user'"))


@query("""SELECT conv_id AS page_id, 'Translate to th' || chr(10) || '[' || string_agg('{"t":"' || role || '"}', ',' ORDER BY turn) || ']' AS payload FROM conversations GROUP BY conv_id""")
def build_requests(r):
    return ingest.build_requests(r.conversations.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("idx"), F.col("role").alias("t")), F.lit("Translate to th"))


@query(r"""WITH b AS (SELECT conv_id AS page_id, string_agg('{"t":"' || role || '","box":[' || turn || '.0,0.0]}', ',' ORDER BY turn) AS items FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id)
SELECT p.page_id, CASE p.page_id % 3 WHEN 0 THEN 'The source language is ja. ' ELSE '' END || 'Translate this page to ' || CASE WHEN p.page_id % 5 = 0 THEN 'Thai' ELSE 'German' END || '.' || CASE WHEN p.page_id % 2 = 0 THEN chr(10) || 'Look again.' || chr(10) ELSE '' END
    || chr(10) || 'JSON only.' || chr(10) || '{"bubbles":[' || coalesce(items, '') || ']}' AS payload FROM (SELECT DISTINCT conv_id AS page_id FROM conversations) p LEFT JOIN b USING (page_id)""")
def page_requests(r):
    c = r.conversations.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("t"), F.array(F.col("turn").cast("double"), F.lit(0e0)).alias("box"))
    source = F.when(F.col("page_id") % 3 == 0, "ja").when(F.col("page_id") % 3 == 1, "auto")
    pages = c.select("page_id").distinct().withColumns({"source_lang": source, "target_lang": F.when(F.col("page_id") % 5 != 0, "German"), "is_retry": F.col("page_id") % 2 == 0})
    return ingest.page_requests(pages, c.where("page_id % 4 <> 0"), F.lit("Translate this page"), F.lit("Look again."), "JSON only.")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([CASE WHEN NOT l_quantity > 10 THEN 'quantity' END, CASE WHEN NOT l_discount BETWEEN 0.01 AND 0.08 THEN 'discount' END, CASE WHEN NOT l_returnflag IN ('A', 'N') THEN 'flag' END], lambda x: x IS NOT NULL) AS violations FROM lineitem""")
def validate(r):
    checks = {"quantity": F.col("l_quantity") > 10, "discount": F.col("l_discount").between(0.01, 0.08), "flag": F.col("l_returnflag").isin("A", "N")}
    return ingest.validate(r.lineitem, checks).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "violations")


@query("SELECT a.page_id, a.page_w AS w1, a.page_h AS h1, b.page_w + CAST(b.page_id % 2 AS INT) AS w2, b.page_h AS h2 FROM book_pages a JOIN book_pages b USING (page_id) WHERE a.page_w <> b.page_w + CAST(b.page_id % 2 AS INT)")
def dimension_mismatch(r):
    p = r.book_pages.select("page_id", F.col("page_w").alias("width"), F.col("page_h").alias("height"))
    return ingest.dimension_mismatch(p, p.withColumn("width", F.col("width") + (F.col("page_id") % 2).cast("int")))


# --- keys and paths ---------------------------------------------------------------------------------------


@query("""SELECT page_id, name, array_to_string(list_transform(regexp_extract_all(lower(name), '(\\d+|\\D+)', 1), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), '') AS k FROM book_pages""")
def natural_key(r):
    return r.book_pages.select("page_id", "name", X.natural_key(F.col("name")).alias("k"))


@query("SELECT book_id, page_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY array_to_string(list_transform(regexp_extract_all(lower(name), '(\\d+|\\D+)', 1), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), ''), page_id) AS INT) AS place FROM book_pages")
def natural_sort(r):
    from pyspark.sql.window import Window

    return r.book_pages.select("book_id", "page_id", F.row_number().over(Window.partitionBy("book_id").orderBy(X.natural_key(F.col("name")), "page_id")).alias("place"))


@query("SELECT path, sha256(replace(path, '[English]', '')) AS path_hash, substring(sha256('20260727:' || sha256(path)), 1, 16) AS seeded, contains(lower(path), '[english]') AS tagged FROM candidates")
def anonymise_path(r):
    return r.candidates.select("path", X.anonymise_path(F.col("path")).alias("path_hash"), X.seeded_key(F.col("path_hash")).alias("seeded"), X.tagged(F.col("path")).alias("tagged"))


@query("SELECT doc_id, sha256(coalesce(text, '') || 'v1' || lang || source || '{\"a\":\"' || lang || '\",\"b\":\"' || source || '\"}') AS key FROM documents")
def cache_key(r):
    return r.documents.select("doc_id", X.cache_key(F.coalesce("text", F.lit("")), F.lit("v1"), F.array("lang", "source"), F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.col("lang"))).alias("key"))


@query("SELECT page_id, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.([^.]+)$', 1) ELSE name END AS base, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.([^.]+)$', 2) ELSE 'png' END AS ext, CASE WHEN contains(name, '.') THEN 'image' ELSE 'other' END AS kind FROM book_pages")
def split_name(r):
    base, ext = X.split_name(F.col("name"))
    return r.book_pages.select("page_id", base.alias("base"), ext.alias("ext"), X.media_kind(F.col("name")).alias("kind"))


@query("""SELECT book_id, page_index, 'book_' || lpad(CAST(n AS VARCHAR), 3, '0') || '_' || CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.([^.]+)$', 1) ELSE name END || '.' || CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\\.([^.]+)$', 2) ELSE 'png' END AS file
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_index) AS n FROM book_pages) WHERE payload IS NOT NULL""")
def export_plan(r):
    return state.export_plan(r.book_pages, F.lit("book"))


# --- boxes ------------------------------------------------------------------------------------------------

_NMS = """d AS (SELECT page_id, box_id, conf, class_id, x + class_id * 4096e0 AS x1, y + class_id * 4096e0 AS y1, x + w + class_id * 4096e0 AS x2, y + h + class_id * 4096e0 AS y2 FROM boxes),
l AS (SELECT page_id, list({'id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY conf DESC, box_id) AS bs FROM d GROUP BY page_id),
k AS (SELECT page_id, list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda q:
    coalesce(greatest(0e0, least(q.x2, c[1].x2) - greatest(q.x1, c[1].x1)) * greatest(0e0, least(q.y2, c[1].y2) - greatest(q.y1, c[1].y1)) / nullif((q.x2 - q.x1) * (q.y2 - q.y1) + (c[1].x2 - c[1].x1) * (c[1].y2 - c[1].y1)
    - greatest(0e0, least(q.x2, c[1].x2) - greatest(q.x1, c[1].x1)) * greatest(0e0, least(q.y2, c[1].y2) - greatest(q.y1, c[1].y1)), 0), 0) > 1e-1)) > 0 THEN acc ELSE list_concat(acc, c) END) AS kept FROM l)"""


@query(f"WITH {_NMS} SELECT page_id, CAST(i - 1 AS INT) AS rank, kept[i].id AS det_id FROM (SELECT page_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)")
def greedy_nms(r):
    return B.greedy_nms(xyxy(r.boxes)).select("page_id", "rank", "det_id")


@query("SELECT page_id, box_id, conf * greatest(x / 560, y / 720) AS conf, CAST(CASE WHEN x / 560 >= y / 720 THEN 0 ELSE 1 END AS INT) AS class_id, (x - w / 2) AS x1, (y + h / 2) AS y2 FROM boxes WHERE conf > 1e-1 AND conf * greatest(x / 560, y / 720) > 1e-1")
def detector_candidates(r):
    raw = r.boxes.select("page_id", "box_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "w", "h", F.col("conf").alias("obj"), F.array(F.col("x") / 560, F.col("y") / 720).alias("cls"))
    return B.detector_candidates(raw).select("page_id", "box_id", "conf", "class_id", "x1", "y2")


@query("""WITH s AS (SELECT *, least(640 / CAST(page_w AS DOUBLE), 640 / CAST(page_h AS DOUBLE)) AS sc FROM boxes),
t AS (SELECT page_id, box_id, least(greatest(round_even(x / sc, 0), 0), page_w) AS x1, least(greatest(round_even(y / sc, 0), 0), page_h) AS y1,
least(greatest(round_even((x + w) / sc, 0), 0), page_w) AS x2, least(greatest(round_even((y + h) / sc, 0), 0), page_h) AS y2 FROM s)
SELECT page_id, box_id, x1, y1, x2 - x1 AS width, y2 - y1 AS height FROM t WHERE x2 > x1 AND y2 > y1""")
def unletterbox_boxes(r):
    return B.unletterbox_boxes(xyxy(r.boxes).withColumn("input_size", F.lit(640))).select("page_id", "box_id", "x1", "y1", "width", "height")


@query("SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (y + (y + h)) / 2, box_id) AS INT) AS ord FROM boxes")
def by_centre(r):
    return B.by_centre(xyxy(r.boxes)).select("page_id", "box_id", "ord")


@query("SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY floor((y + h / 2) / 120), x + w / 2 DESC, box_id) AS INT) AS ord FROM boxes")
def reading_order(r):
    return B.reading_order(r.boxes).select("page_id", "box_id", "ord")


_TILES = """g AS (SELECT page_id, page_w, page_h, CAST(t AS INT) AS tile, CAST(t // 2 AS INT) AS row, CAST(t % 2 AS INT) AS col, page_w / 2e0 AS bw, page_h / 3e0 AS bh FROM (SELECT *, unnest(range(6)) AS t FROM book_pages)),
tiles AS (SELECT page_id, page_w, page_h, tile, greatest(0e0, col * bw - CASE WHEN col > 0 THEN bw * 15e-2 ELSE 0 END) AS sx, greatest(0e0, row * bh - CASE WHEN row > 0 THEN bh * 15e-2 ELSE 0 END) AS sy,
    least(CAST(page_w AS DOUBLE), (col + 1) * bw + CASE WHEN col < 1 THEN bw * 15e-2 ELSE 0 END) AS ex, least(CAST(page_h AS DOUBLE), (row + 1) * bh + CASE WHEN row < 2 THEN bh * 15e-2 ELSE 0 END) AS ey FROM g)"""


@query(f"WITH {_TILES} SELECT page_id, tile, sx, sy, ex - sx AS tile_w, ey - sy AS tile_h FROM tiles")
def tile_grid(r):
    return B.tile_grid(r.book_pages).select("page_id", "tile", "sx", "sy", "tile_w", "tile_h")


_ON_PAGE = f"""{_REPAIRED}, {_TILES.replace('book_pages', "(SELECT DISTINCT page_id, CAST(700 AS INT) AS page_w, CAST(1000 AS INT) AS page_h FROM payloads)")},
v AS (SELECT b.page_id, b.tile, b.idx, coalesce((box[4] - box[2] >= 950 AND box[3] - box[1] >= 950) OR (box[4] = box[2] AND box[3] = box[1]), false) AS bad,
    floor((box[1] / 1000 * (ey - sy) + sy) / page_h * 1000 + 5e-1) AS y1, floor((box[2] / 1000 * (ex - sx) + sx) / page_w * 1000 + 5e-1) AS x1,
    floor((box[3] / 1000 * (ey - sy) + sy) / page_h * 1000 + 5e-1) AS y2, floor((box[4] / 1000 * (ex - sx) + sx) / page_w * 1000 + 5e-1) AS x2
    FROM bub b JOIN tiles t ON b.page_id = t.page_id AND b.tile = t.tile)"""


def _on_page(r):
    found = B.flag_invalid_boxes(ingest.exploded(ingest.ingest_bubbles(r.payloads), "page_id", "tile"))
    sizes = r.payloads.select("page_id").distinct().withColumns({"page_w": F.lit(700), "page_h": F.lit(1000)})
    return B.tile_to_page(found.join(B.tile_grid(sizes), ["page_id", "tile"]))


@query(f"WITH {_ON_PAGE} SELECT page_id, tile, idx, bad AS is_invalid_box, [y1, x1, y2, x2] AS box FROM v")
def tile_to_page(r):
    return _on_page(r).select("page_id", "tile", "idx", "is_invalid_box", "box")


@query(f"""WITH {_ON_PAGE}, l AS (SELECT page_id, list({{'tile': tile, 'idx': idx, 'bad': bad, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY tile, idx) AS bs FROM v GROUP BY page_id),
k AS (SELECT page_id, list_reduce(list_transform(bs, lambda b: [b]), lambda acc, c: CASE WHEN NOT c[1].bad AND len(list_filter(acc, lambda q: NOT q.bad AND
    coalesce(greatest(0e0, least(q.x2, c[1].x2) - greatest(q.x1, c[1].x1)) * greatest(0e0, least(q.y2, c[1].y2) - greatest(q.y1, c[1].y1)) / nullif((q.x2 - q.x1) * (q.y2 - q.y1) + (c[1].x2 - c[1].x1) * (c[1].y2 - c[1].y1)
    - greatest(0e0, least(q.x2, c[1].x2) - greatest(q.x1, c[1].x1)) * greatest(0e0, least(q.y2, c[1].y2) - greatest(q.y1, c[1].y1)), 0), 0) > 4e-1)) > 0 THEN acc ELSE list_concat(acc, c) END) AS kept FROM l)
SELECT page_id, CAST(i - 1 AS INT) AS ord, kept[i].tile AS tile, kept[i].idx AS idx FROM (SELECT page_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)""")
def merge_tiles(r):
    return B.merge_tiles(_on_page(r)).select("page_id", "ord", "tile", "idx")


_LAY = """s AS (SELECT page_id, box_id AS idx, CASE WHEN pk % 3 = 0 THEN NULL ELSE [y, x, y + h * 5, x + w * 9] END AS box, CASE WHEN pk % 5 = 0 THEN NULL ELSE x END AS bx, CASE WHEN pk % 5 = 0 THEN NULL ELSE y END AS yy, w, h, sk % 13 = 0 AS inv FROM boxes),
raw AS (SELECT *, box IS NOT NULL AS four, coalesce(bx, 50) > 100 OR coalesce(yy, 50) > 100 OR w > 100 OR h > 100 AS big FROM s),
raw2 AS (SELECT *, CASE WHEN four THEN (box[2] + box[4]) / 2 / 10 ELSE coalesce(bx, 50) / CASE WHEN big THEN 10 ELSE 1 END END AS rx, CASE WHEN four THEN (box[1] + box[3]) / 2 / 10 ELSE coalesce(yy, 50) / CASE WHEN big THEN 10 ELSE 1 END END AS ry,
    CASE WHEN four THEN abs(box[4] - box[2]) / 10 ELSE w / CASE WHEN big THEN 10 ELSE 1 END END AS rw, CASE WHEN four THEN abs(box[3] - box[1]) / 10 ELSE h / CASE WHEN big THEN 10 ELSE 1 END END AS rh FROM raw),
raw3 AS (SELECT *, inv OR CASE WHEN four THEN (rw >= 85 AND rh >= 85) OR (rw = 0 AND rh = 0) ELSE bx IS NULL AND yy IS NULL END AS bad, coalesce(four AND (box[2] <> 0 OR box[4] <> 1000), false) AS placed FROM raw2),
raw4 AS (SELECT *, sum(CASE WHEN bad AND NOT placed THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS n FROM raw3)"""


_LAID = """laid AS (SELECT page_id, idx, bad AS is_invalid_box, greatest(0e0, least(100e0, CASE WHEN bad AND NOT placed THEN 50 ELSE rx END)) AS cx,
greatest(0e0, least(100e0, CASE WHEN bad AND NOT placed THEN CASE WHEN n < 7 THEN 10 + 12 * n ELSE 8 + 12 * ((n - 7) % 7) END ELSE ry END)) AS cy,
greatest(3e0, least(85e0, CASE WHEN bad THEN 30 ELSE rw END)) AS bw, greatest(2e0, least(85e0, CASE WHEN bad THEN 15 ELSE rh END)) AS bh FROM raw4)"""


def _placed(r, *more):
    three, five = F.col("pk") % 3 == 0, F.col("pk") % 5 == 0
    b = r.boxes.select(
        "page_id", F.col("box_id").alias("idx"), F.when(~three, F.array("y", "x", F.col("y") + F.col("h") * 5, F.col("x") + F.col("w") * 9)).alias("box"),
        F.when(~five, F.col("x")).alias("x"), F.when(~five, F.col("y")).alias("y"), "w", "h", (F.col("sk") % 13 == 0).alias("is_invalid_box"), *more,
    )
    return B.layout_boxes(b)


@query(f"WITH {_LAY}, {_LAID} SELECT * FROM laid")
def layout_boxes(r):
    return _placed(r)


@query(f"WITH {_LAY}, {_LAID} SELECT *, cx / 100 * 700 - bw / 100 * 700 / 2 AS px, cy / 100 * 800 - bh / 100 * 800 / 2 AS py, bw / 100 * 700 AS pw, bh / 100 * 800 AS ph FROM laid")
def layout_boxes_in_pixels(r):
    return _placed(r, "page_w", "page_h")


@query("SELECT page_id, box_id, greatest(0e0, x - 96) AS px, greatest(0e0, y - 96) AS py, least(7e2, x + w + 96) - greatest(0e0, x - 96) AS pw, least(8e2, y + h + 96) - greatest(0e0, y - 96) AS ph FROM boxes")
def pad_rect(r):
    return B.pad_rect(r.boxes, 96).select("page_id", "box_id", "px", "py", "pw", "ph")


_GAP = "sqrt(greatest(0e0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) * greatest(0e0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) + greatest(0e0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) * greatest(0e0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)))"


@query(f"SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id AND {_GAP} <= 60")
def box_pairs(r):
    return B.box_pairs(r.boxes, B.near(60), F.floor(F.col("y") / 150))


_GROUPED = """walk(page_id, box_id, root) AS (SELECT page_id, box_id, box_id FROM boxes UNION SELECT e.page_id, e.b, w.root FROM walk w JOIN edges e ON e.page_id = w.page_id AND e.a = w.box_id AND w.root < e.b),
roots AS (SELECT page_id, box_id, min(root) AS root FROM walk GROUP BY page_id, box_id)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY root) AS INT) AS region, x, y, x2 - x AS w, y2 - y AS h, stroke, members
FROM (SELECT page_id, root, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2, max(stroke) AS stroke, list(box_id ORDER BY box_id) AS members FROM boxes JOIN roots USING (page_id, box_id) GROUP BY page_id, root)"""


@query(f"""WITH lim AS (SELECT page_id, greatest(1e0, 15e-1 * quantile_cont(h, 0.5), 2e-2 * least(min(page_w), min(page_h))) AS reach FROM boxes GROUP BY page_id),
e0 AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id JOIN lim l ON l.page_id = a.page_id WHERE {_GAP} <= l.reach),
edges AS (SELECT page_id, a, b FROM e0 UNION ALL SELECT page_id, b, a FROM e0), {_GROUPED}""")
def group_regions(r):
    return regions.group_regions(r.boxes)


@query(f"""WITH e0 AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id
WHERE greatest(0e0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) < 4e-2 * a.page_w AND greatest(0e0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) < 4e-2 * a.page_h AND least(a.h, b.h) / greatest(a.h, b.h) > 6e-1),
edges AS (SELECT page_id, a, b FROM e0 UNION ALL SELECT page_id, b, a FROM e0), {_GROUPED}""")
def group_regions_axis(r):
    return regions.group_regions(r.boxes, "axis")


@query("SELECT b.page_id, b.box_id, bool_or(z.zx IS NOT NULL AND b.x < zx - 8 + zw + 16 AND zx - 8 < b.x + b.w AND b.y < zy - 8 + zh + 16 AND zy - 8 < b.y + b.h) AS protected FROM boxes b LEFT JOIN zones z ON z.page_id = b.page_id GROUP BY b.page_id, b.box_id")
def protect_zones(r):
    return B.protect_zones(r.boxes, r.zones).select("page_id", "box_id", "protected")


@query("SELECT page_id, box_id, w * h / 900 AS area FROM boxes WHERE w * h / 900 >= greatest(6e0, round_even(page_w * page_h * 2e-6, 0))")
def drop_specks(r):
    return B.drop_specks(r.boxes.withColumn("area", F.col("w") * F.col("h") / 900)).select("page_id", "box_id", "area")


@query("SELECT page_id, least(1e0, sum(w * h) / min(page_w * page_h)) AS coverage FROM boxes GROUP BY page_id")
def text_coverage(r):
    return metrics.text_coverage(r.boxes)


@query("""SELECT page_id, round_even(max(w * h * (1 - pk % 7 / 2e1) / (w * h)), 6) AS max_fill, round_even(max(w * h * (1 - pk % 7 / 2e1) / (page_w * page_h)), 6) AS max_ratio,
bool_or(w * h * (1 - pk % 7 / 2e1) / (w * h) >= 85e-2 AND w * h * (1 - pk % 7 / 2e1) / (page_w * page_h) > 1e-2) AS failed FROM boxes GROUP BY page_id""")
def patch_score(r):
    return metrics.patch_score(r.boxes.withColumn("area", F.col("w") * F.col("h") * (1 - F.col("pk") % 7 / 20)))


@query("SELECT page_id, CASE WHEN count(reason) = 0 THEN ['low-confidence'] ELSE list_transform(list_sort(list({'o': o, 'r': reason}) FILTER (reason IS NOT NULL)), lambda x: x.r) END AS reasons FROM (SELECT page_id, reason, min(ord) AS o FROM zones GROUP BY page_id, reason) GROUP BY page_id")
def ordered_reasons(r):
    return metrics.ordered_reasons(r.zones)


# --- rules and metrics ------------------------------------------------------------------------------------

_NARR, _SFX = "greatest(backing_uniformity, 55e-2 * backing_uniformity + 45e-2 * rectangular_backing)", "4e-1 * artwork_edge_density + 6e-1 * stroke_irregularity"
_LABEL = "w * h / (page_w * page_h) <= 12e-3 AND h / page_h <= 8e-2 AND greatest(enclosure_score, backing_uniformity, rectangular_backing) < 55e-2 AND greatest(artwork_edge_density, stroke_irregularity) < 35e-2"
_ELIGIBLE = f"""f AS (SELECT *, {_NARR} AS nar, {_SFX} AS sfx, {_LABEL} AS lab, CASE WHEN region % 2 = 0 THEN ['logo', 'qr', 'logo'] ELSE [] END AS pr FROM regions),
rul AS (SELECT *, CASE WHEN hits_protected THEN 1 WHEN page_role = 'credits' THEN 2 WHEN hits_review AND lab THEN 3 WHEN hits_review THEN 4 WHEN enclosure_score >= 72e-2 THEN 5
    WHEN backing_uniformity >= 55e-2 OR rectangular_backing >= 55e-2 THEN CASE WHEN nar >= 82e-2 THEN 6 ELSE 7 END WHEN artwork_edge_density >= 35e-2 OR stroke_irregularity >= 35e-2 THEN CASE WHEN sfx >= 9e-1 THEN 8 ELSE 9 END WHEN lab THEN 10 ELSE 11 END AS rule FROM f),
el AS (SELECT *, CASE WHEN rule IN (1, 2, 3, 10) THEN 'protected' WHEN rule = 5 THEN 'dialogue' WHEN rule = 6 THEN 'narration' WHEN rule = 8 THEN 'sfx' ELSE 'review' END AS text_role, CASE WHEN rule IN (1, 2, 3, 8, 10) THEN 'preserve' ELSE 'clean' END AS action,
    greatest(0e0, least(1e0, CASE WHEN rule IN (1, 3, 4) THEN 1 WHEN rule = 2 THEN page_confidence WHEN rule = 5 THEN enclosure_score WHEN rule IN (6, 7) THEN nar WHEN rule IN (8, 9) THEN sfx ELSE greatest(nar, sfx) END)) AS role_confidence,
    CASE WHEN rule IN (1, 3, 4) THEN CASE WHEN len(pr) > 0 THEN ['logo', 'qr'] WHEN rule = 1 THEN ['low-confidence'] ELSE ['margin-mark'] END WHEN rule = 2 THEN ['credit-page'] WHEN rule IN (5, 6) THEN [] WHEN rule = 8 THEN ['sfx-policy'] ELSE ['low-confidence'] END AS reasons FROM rul),
rt AS (SELECT *, CASE WHEN lab_variance < 18 AND edge_density < 8e-2 THEN 'flat' WHEN lab_variance < 45 AND edge_density < 18e-2 AND gradient_coherence >= 55e-2 THEN 'gradient' ELSE 'artwork' END AS route FROM el),
rc AS (SELECT *, greatest(0e0, least(1e0, CASE route WHEN 'flat' THEN 1 - greatest(lab_variance / 18, edge_density / 8e-2) WHEN 'gradient' THEN 1 - greatest(lab_variance / 45, edge_density / 18e-2, 1 - gradient_coherence) ELSE least(1e0, greatest(5e-1, lab_variance / 45, edge_density / 18e-2, entropy / 8)) END)) AS route_confidence FROM rt),
ret AS (SELECT *, outside_changed = 0 AND boundary_error <= 25e-2 AND residual_score > 18e-2 AND damage_score <= 2e-2 AS again, outside_changed = 0 AND boundary_error <= 25e-2 AND residual_score <= 18e-2 AS ok1, boundary_error_2 <= 25e-2 AND residual_score_2 <= 18e-2 AS ok2 FROM rc),
ver AS (SELECT *, CASE WHEN action = 'preserve' THEN 'preserved' WHEN CASE WHEN again THEN ok2 ELSE ok1 END THEN 'repaired' ELSE 'needs_review' END AS status, CASE WHEN again AND action <> 'preserve' THEN 2 END AS retry_radius, CASE WHEN action = 'preserve' THEN 0 WHEN again THEN 2 ELSE 1 END AS passes FROM ret)"""


def _featured(r):
    return r.regions.withColumn("protection_reasons", F.when(F.col("region") % 2 == 0, F.array(F.lit("logo"), F.lit("qr"), F.lit("logo"))).otherwise(F.array().cast("array<string>")))


def _judged(r):
    return rules.verdict(rules.route_region(rules.classify_eligibility(_featured(r))))


@query(f"WITH {_ELIGIBLE} SELECT page_id, region, text_role, role_confidence, action, reasons FROM el")
def classify_eligibility(r):
    return rules.classify_eligibility(_featured(r)).select("page_id", "region", "text_role", "role_confidence", "action", "reasons")


@query(f"WITH {_ELIGIBLE} SELECT page_id, region, route, route_confidence FROM rc")
def route_region(r):
    return rules.route_region(r.regions).select("page_id", "region", "route", "route_confidence")


@query(f"WITH {_ELIGIBLE} SELECT page_id, region, status, retry_radius, passes FROM ver")
def verdict(r):
    return _judged(r).select("page_id", "region", "status", "retry_radius", "passes")


_PAGE_FEATURES = "SELECT o_orderkey AS page_id, o_orderkey % 13 / 1e2 AS line_art_density, o_custkey % 19 / 1e2 AS text_coverage, o_orderkey % 11 / 1e1 AS margin_text_fraction, o_custkey % 51 / 5e1 AS horizontal_band_score, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS qr_count, o_orderkey % 6 > 0 AS has_regions FROM {orders}"


@query(f"""WITH pf AS ({_PAGE_FEATURES.replace('{orders}', 'orders')}) SELECT page_id, CASE WHEN qr_count > 0 AND margin_text_fraction >= 45e-2 THEN 'credits' WHEN horizontal_band_score >= 98e-2 AND text_coverage < 8e-2 AND has_regions THEN 'ui'
WHEN line_art_density >= 35e-3 AND has_regions THEN 'comic' WHEN horizontal_band_score >= 72e-2 AND text_coverage >= 8e-2 THEN 'ui' ELSE 'unknown' END AS role,
CASE WHEN qr_count > 0 AND margin_text_fraction >= 45e-2 THEN 95e-2 WHEN horizontal_band_score >= 98e-2 AND text_coverage < 8e-2 AND has_regions THEN 9e-1
WHEN line_art_density >= 35e-3 AND has_regions THEN least(98e-2, 7e-1 + 4e0 * (line_art_density - 35e-3)) WHEN horizontal_band_score >= 72e-2 AND text_coverage >= 8e-2 THEN 9e-1 ELSE 75e-2 END AS confidence FROM pf""")
def classify_page(r):
    return rules.classify_page(r.spark.sql(_PAGE_FEATURES, orders=r.orders)).select("page_id", "role", "confidence")


_REPORT = """count(*) AS region_count, count(*) FILTER (route = 'flat') AS route_flat, count(*) FILTER (route = 'gradient') AS route_gradient, count(*) FILTER (route = 'artwork') AS route_artwork, count(*) FILTER (action = 'clean') AS eligible_count,
count(*) FILTER (action = 'clean' AND status = 'repaired') AS repaired_count, count(*) FILTER (action = 'clean' AND residual_score <= 18e-2) AS residual_pass_count, count(*) FILTER (status = 'needs_review') AS needs_review_count,
count(*) FILTER (action <> 'clean' AND NOT list_contains(reasons, 'sfx-policy') AND NOT hits_protected) AS unexpected_count, count(*) FILTER (text_role = 'sfx' AND action <> 'clean' AND list_contains(reasons, 'sfx-policy') AND NOT hits_protected) AS preserved_sfx_count"""
_RATES = "CASE WHEN eligible_count = 0 THEN 1 ELSE residual_pass_count / CAST(eligible_count AS DOUBLE) END AS residual_pass_rate, CASE WHEN eligible_count = 0 THEN 1 ELSE repaired_count / CAST(eligible_count AS DOUBLE) END AS automatic_pass_rate, CASE WHEN region_count = 0 THEN 0 ELSE needs_review_count / CAST(region_count AS DOUBLE) END AS needs_review_rate"


@query(f"WITH {_ELIGIBLE} SELECT *, {_RATES} FROM (SELECT page_id, {_REPORT} FROM ver GROUP BY page_id)")
def page_report(r):
    return run_pipeline(_featured(r))


@query(f"WITH {_ELIGIBLE} SELECT category, count(*) AS region_count, count(*) FILTER (status = 'repaired') AS repaired_count, CAST(grouping(category) AS INT) AS is_total FROM ver GROUP BY ROLLUP (category)")
def category_report(r):
    return metrics.category_report(_judged(r))


_SUMMARY = f"""{_ELIGIBLE}, pr AS (SELECT *, {_RATES}, CAST(page_id % 5000 AS INT) AS total_ms, 0 AS changed_outside, CASE WHEN page_id % 900 = 0 THEN 1 ELSE 0 END AS changed_protected, CASE WHEN page_id % 3 = 0 THEN page_id % 6 >= 0 END AS identical FROM (SELECT page_id, {_REPORT} FROM ver GROUP BY page_id)),
sm AS (SELECT round_even(quantile_cont(total_ms, 0.5), 0) AS median_total_ms, round_even(quantile_cont(total_ms, 0.95), 0) AS p95_total_ms, CAST(sum(needs_review_count) AS BIGINT) AS needs_review_count, CAST(sum(unexpected_count) AS BIGINT) AS unexpected_count, CAST(sum(preserved_sfx_count) AS BIGINT) AS preserved_sfx_count,
    CAST(sum(changed_outside) AS BIGINT) AS changed_outside, CAST(sum(changed_protected) AS BIGINT) AS changed_protected, coalesce(bool_and(identical), true) AS text_free_identical,
    sum(round_even(residual_pass_rate * eligible_count, 0)) / sum(eligible_count) AS residual_pass_rate, sum(round_even(automatic_pass_rate * eligible_count, 0)) / sum(eligible_count) AS automatic_pass_rate, sum(needs_review_count) / CAST(sum(region_count) AS DOUBLE) AS needs_review_rate FROM pr)"""


def _reported(r):
    return run_pipeline(_featured(r)).withColumns({"total_ms": (F.col("page_id") % 5000).cast("int"), "changed_outside": F.lit(0), "changed_protected": F.when(F.col("page_id") % 900 == 0, 1).otherwise(0), "identical": F.when(F.col("page_id") % 3 == 0, F.col("page_id") % 6 >= 0)})


def _summary(r):
    return metrics.corpus_summary(_reported(r))


@query(f"WITH {_SUMMARY} SELECT * FROM sm")
def corpus_summary(r):
    return _summary(r)


@query(f"""WITH {_SUMMARY}, g AS (SELECT median_total_ms <= 30000 AS gate_time, residual_pass_rate >= 95e-2 AS gate_residual, automatic_pass_rate >= 9e-1 AS gate_automatic, unexpected_count = 0 AS gate_unexpected, changed_outside = 0 AS gate_outside, changed_protected = 0 AS gate_protected, text_free_identical AS gate_identical, true AS gate_patches, false AS gate_visual FROM sm)
SELECT *, gate_time AND gate_residual AND gate_automatic AND gate_unexpected AND gate_outside AND gate_protected AND gate_identical AND gate_patches AND gate_visual AS passed FROM g""")
def acceptance_gate(r):
    out = metrics.acceptance_gate(_summary(r).withColumns({"patches_pass": F.lit(True), "visual_pass": F.lit(False)}))
    return out.select(*(c for c in out.columns if c.startswith("gate_")), "passed")


@query("""WITH v AS (SELECT quality, [CASE doc_id % 4 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'narration' WHEN 2 THEN 'sfx' ELSE 'protected-heavy' END] AS c FROM labels)
SELECT count(*) AS passes, least(count(*) FILTER (list_contains(c, 'dialogue')), count(*) FILTER (list_contains(c, 'narration')), count(*) FILTER (list_contains(c, 'sfx')), count(*) FILTER (list_contains(c, 'protected-heavy'))) AS least_covered,
count(*) >= 12 AND least(count(*) FILTER (list_contains(c, 'dialogue')), count(*) FILTER (list_contains(c, 'narration')), count(*) FILTER (list_contains(c, 'sfx')), count(*) FILTER (list_contains(c, 'protected-heavy'))) >= 3 AS passed FROM v WHERE quality = 1""")
def coverage_gate(r):
    kind = F.element_at(F.array(*map(F.lit, ["dialogue", "narration", "sfx", "protected-heavy"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return metrics.coverage_gate(r.labels.select(F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("decision"), F.array(kind).alias("categories")), ["dialogue", "narration", "sfx", "protected-heavy"])


@query("SELECT item_id, CASE WHEN item_id % 3 IN (0, 1) THEN item_id % 2 = 0 END AS page_identical FROM benchmark")
def protected_report(r):
    kind = F.when(F.col("item_id") % 3 == 0, "credits").when(F.col("item_id") % 3 == 1, "ui").otherwise("comic")
    return metrics.protected_report(r.benchmark.select("item_id", F.array(kind).alias("categories"), (F.col("item_id") % 2).alias("changed"))).select("item_id", "page_identical")


@query(f"WITH {_ELIGIBLE} SELECT page_id, count(*) FILTER (status = 'repaired') AS clean, count(*) FILTER (status = 'needs_review') AS review, count(*) FILTER (status = 'preserved') AS protected, arg_min(page_role, region) AS page_role FROM ver GROUP BY page_id")
def page_legend(r):
    return metrics.page_legend(_judged(r).withColumn("ord", F.col("region")))


@query("SELECT page_id, z AS region, greatest(0e0, least(1e0, 75e-2 * avg(v / 255e0) + 25e-2 * least(1e0, count(*) FILTER (v >= 130) / greatest(1e0, count(*) / 64e0)))) AS residual FROM (SELECT *, y // 4 AS z FROM raster) GROUP BY page_id, z")
def residual_score(r):
    px = r.raster.withColumns({"region": F.floor(F.col("y") / 4), "prob": F.col("v") / 255})
    return metrics.residual_score(px, px.where("v >= 130").withColumn("area", F.lit(4)))


@query("""SELECT user_id AS page_id, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type = 'view'), 0) AS BIGINT) AS view,
CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type IN ('click', 'view')), 0) AS BIGINT) AS total FROM events GROUP BY user_id""")
def stage_timings(r):
    return metrics.stage_timings(r.events.select(F.col("user_id").alias("page_id"), F.col("event_type").alias("stage"), F.floor("value").alias("ms")), ["click", "view"])


@query(f"WITH st AS ({ORACLES['stage_timings']}), l AS (SELECT unnest(['click', 'view', 'total']) AS stage, unnest([click, view, total]) AS ms FROM st) SELECT stage, quantile_cont(ms, 0.5) AS median_ms, quantile_cont(ms, 0.95) AS p95_ms FROM l GROUP BY stage")
def stage_percentiles(r):
    return metrics.stage_percentiles(stage_timings(r), ["click", "view"])


@query(f"WITH base AS ({ORACLES['residual_score']}), o AS (SELECT page_id, y // 4 AS region, max(v) / 2e2 AS ocr FROM raster WHERE page_id % 3 = 0 GROUP BY ALL) SELECT page_id, region, CASE WHEN ocr IS NULL THEN residual ELSE greatest(0e0, least(1e0, 75e-2 * residual + 25e-2 * greatest(0e0, least(1e0, ocr)))) END AS residual FROM base LEFT JOIN o USING (page_id, region)")
def residual_score_with_readings(r):
    px = r.raster.withColumns({"region": F.floor(F.col("y") / 4), "prob": F.col("v") / 255})
    ocr = px.where("page_id % 3 = 0").groupBy("page_id", "region").agg((F.max("v") / 200).alias("ocr"))
    return metrics.residual_score(px, px.where("v >= 130").withColumn("area", F.lit(4)), ocr)


_ATT = """a AS (SELECT *, CASE WHEN transport_error THEN 'TIMEOUT' WHEN http_status = 429 THEN 'QUOTA' WHEN http_status >= 400 THEN 'UPSTREAM' WHEN block_reason IS NOT NULL THEN 'BLOCKED' END AS error FROM attempts)"""


@query(f"""WITH {_ATT} SELECT book_id, page_index, attempt, error, CAST(CASE WHEN transport_error THEN 504 WHEN error IN ('QUOTA', 'UPSTREAM') THEN http_status WHEN error = 'BLOCKED' THEN 400 END AS INT) AS code,
CASE WHEN error IS NULL THEN NULL ELSE transport_error OR error = 'QUOTA' OR (error = 'UPSTREAM' AND http_status >= 500) END AS retryable, CASE WHEN error = 'QUOTA' THEN 60000 WHEN transport_error OR (error = 'UPSTREAM' AND http_status >= 500) THEN 5000 END AS delay_ms FROM a""")
def classify_attempts(r):
    return rules.classify_attempts(r.attempts.withColumn("finish_reason", F.lit(None).cast("string"))).select("book_id", "page_index", "attempt", "error", "code", "retryable", "delay_ms")


@query("""WITH w AS (SELECT *, transport_error OR http_status >= 400 AS failed, lag(model) OVER (PARTITION BY page_id ORDER BY attempt) = model AND lag(key_index) OVER (PARTITION BY page_id ORDER BY attempt) = key_index AND lag(http_status) OVER (PARTITION BY page_id ORDER BY attempt) IN (500, 503) AS same,
lead(model) OVER (PARTITION BY page_id ORDER BY attempt) AS nm, lead(key_index) OVER (PARTITION BY page_id ORDER BY attempt) AS nk FROM attempts)
SELECT page_id, attempt, CASE WHEN NOT failed THEN 'done' WHEN elapsed_s >= 90 THEN 'stop' WHEN transport_error THEN 'next-model' WHEN http_status IN (500, 503) AND NOT coalesce(same, false) THEN 'retry' WHEN http_status IN (400, 403, 429) THEN 'next-key' ELSE 'next-model' END AS expected,
CASE WHEN nm IS NULL THEN CASE WHEN failed THEN 'stop' ELSE 'done' END WHEN nm <> model THEN 'next-model' WHEN nk <> key_index THEN 'next-key' ELSE 'retry' END AS did, elapsed_s >= 90 AS late FROM w""")
def audit_fallback(r):
    return rules.audit_fallback(r.attempts).select("page_id", "attempt", "expected", "did", "late")


_OUT = f"""{_ATT}, pg AS (SELECT book_id, page_index, count(*) AS attempts, bool_or(error IS NULL) AS ok, arg_max(error, attempt) FILTER (error IS NOT NULL) AS last_error FROM a WHERE attempt <= 3 GROUP BY book_id, page_index),
oc AS (SELECT *, coalesce(max(CASE WHEN last_error = 'QUOTA' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM pg)"""


def _outcomes(r):
    return state.batch_outcomes(rules.classify_attempts(r.attempts.withColumn("finish_reason", F.lit(None).cast("string"))))


@query(f"WITH {_OUT} SELECT book_id, page_index, attempts, ok, last_error, attempted FROM oc")
def batch_outcomes(r):
    return _outcomes(r)


@query(f"WITH {_OUT} SELECT book_id, count(*) FILTER (attempted AND ok) AS succeeded, coalesce(string_agg(CAST(page_index AS VARCHAR), ', ' ORDER BY page_index) FILTER (attempted AND NOT ok), '') AS failed_pages, count(*) FILTER (NOT attempted) AS skipped FROM oc GROUP BY book_id")
def batch_summary(r):
    return state.batch_summary(_outcomes(r))


@query(f"""WITH {_OUT}, stop AS (SELECT book_id, min(page_index) AS s FROM oc WHERE last_error = 'QUOTA' GROUP BY book_id), un AS (SELECT DISTINCT a.book_id, a.page_index, coalesce(a.page_index < s, true) AS attempted FROM a LEFT JOIN stop USING (book_id) WHERE a.page_index % 13 = 5),
every AS (SELECT book_id, page_index, ok, attempted, 'translation' AS stage FROM oc WHERE page_index % 13 <> 5 UNION ALL SELECT book_id, page_index, false, attempted, 'cleaning' FROM un)
SELECT book_id, count(*) FILTER (attempted AND ok) AS succeeded, coalesce(string_agg(CAST(page_index AS VARCHAR), ', ' ORDER BY page_index) FILTER (attempted AND NOT ok), '') AS failed_pages, count(*) FILTER (NOT attempted) AS skipped,
    coalesce(string_agg(page_index || ':' || stage, ', ' ORDER BY page_index) FILTER (attempted AND NOT ok), '') AS failures FROM every GROUP BY book_id""")
def batch_summary_by_stage(r):
    return state.batch_summary(_outcomes(r), unclean=r.attempts.where("page_index % 13 = 5").select("book_id", "page_index"))


# --- curation ---------------------------------------------------------------------------------------------

_CATS = [
    "16e-1 * white + edge + 4e-1 * contrast", "12e-1 * saturation + edge + 3e-1 * white", "15e-1 * portrait + edge + 2e-1 * dark", "11e-1 * saturation + 15e-1 * edge + contrast", "18e-1 * edge + contrast + 5e-1 * dark",
    "9e-1 * midtone + 8e-1 * least(laplacian, 15e-1) + edge", "15e-1 * saturation + spread + contrast", "22e-1 * edge + dark + 5e-1 * portrait", "18e-1 * (1e0 - least(edge * 8e0, 1e0)) + 4e-1 * (1e0 - least(contrast, 1e0))",
]
_SCORED = "sc AS (SELECT path, path_hash, content_sha, doc_id, substring(sha256('20260727:' || path_hash), 1, 16) AS tie, [" + ", ".join(_CATS) + "] AS s FROM candidates), names AS (SELECT [" + ", ".join(f"'{c}'" for c in X.CATEGORIES) + "] AS n), cat AS (SELECT sc.*, list_max(s) AS best, n[list_position(s, list_max(s))] AS category, n FROM sc CROSS JOIN names)"


def _scored(r):
    f = ("white", "edge", "contrast", "saturation", "portrait", "dark", "midtone", "laplacian", "spread")
    return r.candidates.withColumn("scores", X.category_scores(*map(F.col, f)))


@query(f"WITH {_SCORED} SELECT path_hash, category, best FROM cat")
def category_scores(r):
    return _scored(r).select("path_hash", X.argmax_category(F.col("scores")).alias("category"), F.array_max(F.map_values("scores")).alias("best"))


@query(f"WITH {_SCORED}, l AS (SELECT path_hash, tie, n[i] AS category, s[i] AS score FROM (SELECT *, unnest(range(1, 10)) AS i FROM cat)) SELECT path_hash, category, score, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, tie DESC) AS INT) AS rank FROM l QUALIFY rank <= 5")
def ranked_by_category(r):
    return curate.ranked_by_category(_scored(r), 5).select("path_hash", "category", "score", "rank")


@query(f"WITH {_SCORED} SELECT path_hash, content_sha FROM sc QUALIFY row_number() OVER (PARTITION BY content_sha ORDER BY tie DESC, path_hash) = 1")
def dedupe_content(r):
    return curate.dedupe_content(_scored(r), "content_sha", [F.desc(X.seeded_key(F.col("path_hash"))), F.asc("path_hash")]).select("path_hash", "content_sha")


@query(f"WITH {_SCORED} SELECT path_hash FROM sc ORDER BY tie DESC, path_hash LIMIT 40")
def seeded_sample(r):
    return curate.seeded_sample(r.candidates, "path_hash", 40).select("path_hash")


@query(f"WITH {_SCORED} SELECT path_hash, content_sha, category, best FROM cat ORDER BY best DESC, path_hash LIMIT 25")
def review_selection(r):
    return curate.review_selection(_scored(r), 25)


_STRATA = f"""{_SCORED}, u AS (SELECT * FROM cat),
pick(k, paths, shas) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
    SELECT k + 1, list_append(paths, b.path_hash), list_append(shas, b.content_sha) FROM (SELECT p.k, p.paths, p.shas, (SELECT arg_max({{'path_hash': u.path_hash, 'content_sha': u.content_sha}}, {{'a': u.s[p.k + 1], 'b': u.tie, 'c': u.content_sha}}) FROM u WHERE NOT list_contains(p.paths, u.path_hash) AND NOT list_contains(p.shas, u.content_sha)) AS b FROM pick p WHERE p.k < 9)),
done AS (SELECT paths, shas FROM pick WHERE k = 9), first AS (SELECT unnest(paths) AS path_hash, unnest(shas) AS content_sha, unnest(range(1, 10)) AS i FROM done),
once AS (SELECT * FROM u WHERE path_hash NOT IN (SELECT path_hash FROM first) AND content_sha NOT IN (SELECT content_sha FROM first) QUALIFY row_number() OVER (PARTITION BY content_sha ORDER BY tie DESC, path_hash) = 1),
rest AS (SELECT path_hash, content_sha, category FROM once ORDER BY tie DESC, path_hash LIMIT 21),
chosen AS (SELECT f.path_hash, f.content_sha, names.n[f.i] AS category FROM first f CROSS JOIN names UNION ALL SELECT * FROM rest)"""


@query(f"WITH {_STRATA} SELECT path_hash, content_sha, category FROM chosen")
def stratified_select(r):
    return curate.stratified_select(_scored(r), 30)


@query(f"WITH {_SCORED.replace('FROM candidates)', 'FROM candidates WHERE content_sha IN (SELECT c.content_sha FROM candidates c JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality = 1))')}, {_STRATA.split(', ', 1)[1].split('u AS ', 1)[1].join(['u AS ', ''])} SELECT path_hash, content_sha, category FROM chosen")
def build_manifest(r):
    labels = r.candidates.join(r.labels, "doc_id").select("content_sha", F.when(F.col("quality") == 1, "original_comic").otherwise("reject").alias("label"))
    return curate.build_manifest(_scored(r), labels, 30)


@query("SELECT m.path_hash, CASE WHEN s.path_hash IS NULL THEN 'missing' WHEN s.content_sha <> m.content_sha THEN 'changed' ELSE 'ok' END AS state FROM candidates m LEFT JOIN (SELECT path_hash, CASE WHEN doc_id % 7 = 1 THEN sha256(content_sha) ELSE content_sha END AS content_sha FROM candidates WHERE doc_id % 5 <> 0) s USING (path_hash)")
def resolve_manifest(r):
    scan = r.candidates.where("doc_id % 5 <> 0").select("path_hash", F.when(F.col("doc_id") % 7 == 1, F.sha2("content_sha", 256)).otherwise(F.col("content_sha")).alias("content_sha"))
    return curate.resolve_manifest(scan, r.candidates.select("path_hash", "content_sha")).select("path_hash", "state")


@query("SELECT count(*) = count(DISTINCT content_sha) AS unique_sha, count(*) = count(DISTINCT path_hash) AS unique_path, true AS one_label, count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')) AND count(DISTINCT CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang END) = 4 AS covered, true AS anonymous FROM candidates JOIN documents USING (doc_id)")
def manifest_checks(r):
    m = r.candidates.join(r.documents.select("doc_id", "lang"), "doc_id").select("path_hash", "content_sha", F.col("lang").alias("category"), F.lit("original_comic").alias("label"))
    return curate.manifest_checks(m, ["en", "de", "fr", "es"])


@query("SELECT coalesce(a.doc_id, e.doc_id) AS id, CASE WHEN e.doc_id IS NULL THEN 'unknown' WHEN a.doc_id IS NULL THEN 'missing' WHEN a.content_sha = e.sha THEN 'ok' ELSE 'mismatch' END AS state FROM (SELECT * FROM candidates WHERE doc_id % 4 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 2 THEN 'x' ELSE content_sha END AS sha FROM candidates WHERE doc_id % 3 <> 0) e ON a.doc_id = e.doc_id")
def verify_inventory(r):
    c = r.candidates.select(F.col("doc_id").alias("id"), F.col("content_sha").alias("sha"))
    return curate.verify_inventory(c.where("id % 4 <> 0"), c.where("id % 3 <> 0").withColumn("sha", F.when(F.col("id") % 9 == 2, "x").otherwise(F.col("sha"))))


@query("""SELECT page_id, idx, t FROM lines WHERE page_id % 3 = 0 AND idx % 2 = 0 AND page_id % 5 < 3
UNION ALL SELECT page_id, idx, t FROM lines WHERE page_id % 2 = 0 AND idx % 4 < 2 AND page_id NOT IN (SELECT page_id FROM lines WHERE page_id % 3 = 0 AND page_id % 5 < 3)""")
def manual_bubbles(r):
    cached = r.lines.where("page_id % 3 = 0 AND page_id % 5 < 3").select("page_id", "idx", "t", (F.col("idx") % 2 == 0).alias("is_manual"))
    active = r.lines.where("page_id % 2 = 0").select("page_id", "idx", "t", (F.col("idx") % 4 < 2).alias("is_manual"))
    return ingest.manual_bubbles(cached, active).select("page_id", "idx", "t")


@query("SELECT page_id, box_id, round(1e3 * (20 + y / 1e3 * 400) / page_h, 9) AS y1, round(1e3 * (30 + x / 1e3 * 300) / page_w, 9) AS x1 FROM boxes")
def crop_to_page(r):
    crops = r.boxes.withColumns({"box": F.array("y", "x", "y", "x"), "sx": F.lit(30), "sy": F.lit(20), "tile_w": F.lit(300), "tile_h": F.lit(400)})
    out = B.tile_to_page(crops, whole=False)
    return out.select("page_id", "box_id", F.round(F.col("box")[0], 9).alias("y1"), F.round(F.col("box")[1], 9).alias("x1"))


@query("SELECT page_id, box_id, sha256(CAST(page_id AS VARCHAR) || CAST(box_id AS VARCHAR) || CAST(sk AS VARCHAR)) AS key FROM boxes")
def retry_key(r):
    return r.boxes.select("page_id", "box_id", X.retry_key(F.col("page_id"), F.col("box_id"), F.col("sk").cast("string")).alias("key"))
