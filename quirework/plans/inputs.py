"""Logical inputs of the registered queries, derived from the given tables by plain arithmetic.

Each is a SELECT that both Spark and DuckDB run; ``@sha(x)`` and ``@lines(t)`` stand for the engine's own function.
Names in braces are tables or other inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_KEYS = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_SHARE = lambda c: f"(length(t) - length(replace(t, '{c}', ''))) / (1e0 + length(t))"

INPUTS: dict[str, str] = {
    "boxes": f"""SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS}) AS INT) AS box_id,
        CAST((l_partkey % 40) * 14 AS DOUBLE) AS x, CAST((l_suppkey % 30) * 24 AS DOUBLE) AS y, 20 + l_quantity * 2 AS w, 15 + l_quantity AS h,
        5e-2 + l_discount * 9 AS conf, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id,
        l_linenumber AS stroke, 700 AS page_w, 800 AS page_h, CAST(l_partkey AS INT) AS pk, CAST(l_suppkey AS INT) AS sk
        FROM {{lineitem}}""",
    "zones": """SELECT page_id, x AS zx, y AS zy, w / 2 AS zw, h / 2 AS zh, CASE pk % 4 WHEN 0 THEN 'qr' WHEN 1 THEN 'margin-mark' WHEN 2 THEN 'logo' END AS reason, box_id AS ord
        FROM {boxes} WHERE sk % 9 = 0""",
    "regions": f"""SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS}) AS INT) AS region,
        CAST(l_quantity * 2 AS DOUBLE) AS w, l_quantity / 2 AS h, 600 AS page_w, 400 AS page_h,
        (l_partkey % 101) / 1e2 AS enclosure_score, (l_suppkey % 97) / 96e0 AS backing_uniformity, (l_partkey * 7 % 89) / 88e0 AS rectangular_backing,
        (l_suppkey * 3 % 83) / 82e0 AS artwork_edge_density, ((l_linenumber * 13 + l_partkey) % 79) / 78e0 AS stroke_irregularity,
        l_quantity * 12e-1 AS lab_variance, l_discount * 25e-1 AS edge_density, l_quantity / 7e0 AS entropy, (l_partkey % 21) / 2e1 AS gradient_coherence,
        l_partkey % 17 = 0 AS hits_protected, l_suppkey % 11 = 0 AS hits_review,
        CASE l_orderkey % 5 WHEN 0 THEN 'credits' WHEN 1 THEN 'ui' ELSE 'comic' END AS page_role, 95e-2 AS page_confidence, l_returnflag AS category,
        CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END AS outside_changed, l_tax * 4e0 AS boundary_error, (l_partkey % 5) / 1e2 AS damage_score, (l_suppkey % 40) / 1e2 AS residual_score,
        0 AS outside_changed_2, l_tax * 2e0 AS boundary_error_2, (l_partkey % 30) / 1e2 AS residual_score_2
        FROM {{lineitem}}""",
    "book_pages": """SELECT o_orderkey AS page_id, o_custkey AS book_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS page_index,
        CAST(600 + 200 * (o_orderkey % 3) AS INT) AS page_w, CAST(800 + 100 * (o_orderkey % 4) AS INT) AS page_h, o_totalprice AS price,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS payload, 'Page' || CAST(o_orderkey % 120 AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '.PNG' ELSE '.tar.jpg' END AS name
        FROM {orders}""",
    "candidates": f"""SELECT path, @sha(path) AS path_hash, @sha(t) AS content_sha, doc_id, {_SHARE(' ')} AS white, {_SHARE('t')} AS edge, {_SHARE('a')} AS contrast, {_SHARE('i')} AS saturation,
        CAST(doc_id % 2 AS DOUBLE) AS portrait, {_SHARE('e')} AS dark, {_SHARE('n')} AS midtone, 30e0 * {_SHARE('r')} AS laplacian, {_SHARE('o')} AS spread
        FROM (SELECT doc_id, coalesce(text, '') AS t, source || '/' || CASE WHEN doc_id % 50 = 0 THEN '[English]' ELSE lang END || '/' || CAST(doc_id AS STRING) AS path FROM {{documents}}) d""",
    "payloads": """SELECT conv_id AS page_id, CAST(turn AS INT) AS tile, CASE turn % 7
        WHEN 0 THEN '```JSON' || chr(10) || good || chr(10) || '```' WHEN 1 THEN replace(good, '}]}', '},]}') WHEN 2 THEN replace(good, '}]}', '}')
        WHEN 3 THEN good || chr(10) || 'Hope this helps' WHEN 4 THEN 'sorry, no' WHEN 5 THEN '{"bubbles":[]}' ELSE good END AS body
        FROM (SELECT conv_id, turn, '{"bubbles":[{"t":"' || role || '","box":[10,' || CAST(conv_id % 90 AS STRING) || ',200,300]},{"t":"' || role || CAST(conv_id % 3 AS STRING) || '","box":[' || CAST(turn AS STRING) || ',0,990,1000]}]}' AS good FROM {conversations}) c""",
    "lines": """SELECT doc_id AS page_id, CAST(idx AS INT) AS idx, t, CAST(NULL AS STRING) AS translated, doc_id % 7 = 0 AND idx % 3 = 0 AS deleted FROM @lines({documents})""",
    "attempts": """SELECT user_id AS book_id, page_index, attempt, http_status, transport_error, block_reason, page_id, model, key_index, elapsed_s FROM (
        SELECT user_id, CAST(event_id % 97 AS INT) AS page_index, CAST(row_number() OVER (PARTITION BY user_id, event_id % 97 ORDER BY event_id) AS INT) AS attempt, user_id * 1000 + event_id % 97 AS page_id,
        CAST(CASE WHEN value < 5 THEN 429 WHEN value < 12 THEN 503 WHEN value < 14 THEN 400 ELSE 200 END AS INT) AS http_status, event_type = 'error' AND value > 30 AS transport_error,
        CASE WHEN event_id % 29 = 0 THEN 'SAFETY' END AS block_reason, 'm' || CAST(CAST(floor(value / 9) AS INT) % 3 AS STRING) AS model, CAST(event_id % 2 AS INT) AS key_index, value * 2 AS elapsed_s FROM {events}) e""",
    "job_events": """SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'queued' ELSE 'running' END AS status,
        event_type AS stage, value, user_id % 20 AS page_id, event_id - (event_id % 5) * 10 AS token FROM {events}""",
    "raster": """SELECT vec_id AS page_id, CAST(floor(i / 8e0) AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 1275e-1))) AS INT) AS v, label FROM @cells({embeddings})""",
    "raster2": """SELECT page_id, y, x, CASE WHEN label % 3 = 0 AND x = 2 THEN v + 1 ELSE v END AS v FROM {raster} WHERE NOT (page_id % 5 = 0 AND x = 3 AND y IN (0, 5))""",
    "colour": """SELECT page_id, y, x, v, v AS r, (v * 7 + x * 3) % 256 AS g, (v * 3 + y * 5) % 256 AS b, x - 3e0 AS gx, (v % 5) - 2e0 AS gy FROM {raster}""",
    "retries": """SELECT page_id, 1 + box_id % 3 + CASE WHEN sk % 20 = 0 THEN 100 ELSE 0 END AS region, box_id AS seq, CASE sk % 4 WHEN 0 THEN 'automatic' WHEN 1 THEN 'force-clean' WHEN 2 THEN 'protect' ELSE 'paint' END AS manual_action,
        sk % 8 AS mask_pixels, CASE WHEN sk % 11 = 0 THEN 599 ELSE 600 END AS mask_w, 400 AS mask_h, pk % 4 = 0 AS accepted, CASE WHEN pk % 7 = 0 THEN 'narration' END AS judged_role FROM {boxes} WHERE pk % 3 <> 0""",
    "rects": """SELECT vec_id AS page_id, CAST(z AS INT) AS zone_id, CAST(vec_id % 3 + z AS DOUBLE) AS zx, CAST(z * 2 AS DOUBLE) AS zy, CAST(3 AS DOUBLE) AS zw, CAST(4 AS DOUBLE) AS zh FROM @both({embeddings})""",
}

_SPARK = {
    "sha": "sha2({0}, 256)",
    "lines": "(SELECT doc_id, idx, t FROM {0} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n', -1)) p AS idx, t)",
    "cells": "(SELECT vec_id, label, i, e FROM {0} LATERAL VIEW posexplode(embedding) p AS i, e)",
    "both": "(SELECT vec_id, z FROM {0} LATERAL VIEW explode(array(0, 1)) p AS z)",
}
_DUCK = {
    "sha": "sha256({0})",
    "lines": "(SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {0}))",
    "cells": "(SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM {0})",
    "both": "(SELECT vec_id, unnest([0, 1]) AS z FROM {0})",
}


def _own(sql: str, functions: dict[str, str]) -> str:
    return re.sub(r"@(\w+)\(([^()]*)\)", lambda m: functions[m[1]].format(m[2]), sql)


class Reader:
    """Tables and inputs of a folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUTS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql, frames = _own(INPUTS[name], _SPARK), {x: getattr(self, x) for x in _names(INPUTS[name])}
        # Braces that aren't names are doubled, as the formatter wants them.
        sql = sql.replace("{", "{{").replace("}", "}}")
        for x in frames:
            sql = sql.replace("{{" + x + "}}", "{" + x + "}")
        return self.spark.sql(sql, **frames)


def _names(sql: str) -> set[str]:
    return {x for x in re.findall(r"\{(\w+)\}", sql) if x in TABLES or x in INPUTS}


def oracle(sql: str) -> str:
    """``sql`` with the inputs that it names put before it, for DuckDB."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in INPUTS:
            return
        for x in sorted(_names(INPUTS[name])):
            add(x)
        text = INPUTS[name]
        for x in _names(text):
            text = text.replace("{" + x + "}", x)
        done[name] = _own(text, _DUCK)

    for x in INPUTS:
        if re.search(rf"\b{x}\b", sql):
            add(x)
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in done.items()) + (", " if sql.lstrip().upper().startswith("WITH") else " ") + re.sub(r"^\s*WITH\s+", "", sql, flags=re.I) if done else sql
