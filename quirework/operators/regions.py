"""Regions of nearby boxes: a grid of several levels, and components closed in the pass that sweeps a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.exprs import d
from ..graph import connected_components
from ..scratch import keep
from .boxes import aligned, near

#: Boxes of whole pages that a task takes at once, about, and the pairs that it tests at once.
ROWS, PAIRS = 50_000, 1_000_000
#: Boxes of a page beyond which it is spread over tasks.
HUGE = 1_000_000
_NUMBERS = ["x", "y", "w", "h", "page_w", "page_h"]


def group_regions(boxes: DataFrame, policy: str = "gap", huge: int = HUGE) -> DataFrame:
    """Regions of nearby boxes (page_id, box_id, x, y, w, h, stroke, page_w, page_h): connected components under
    gap <= max(1, 1.5 * median height, 0.02 * shorter side), or by axes. One row a region, numbered by smallest member.

    Each box lies in the level of its own size: cells of that level are at least as long as the box and the reach together, and
    are twice as long from one level to the next. Boxes of a level and smaller ones that are near lie in the same cell of that level or in
    neighbours, so a tall box meets the boxes of its page once and the others stay in small cells. One shuffle by page
    serves all; pages of more than ``huge`` boxes are joined by cell instead."""
    big = boxes.groupBy("page_id").agg(F.count("*").alias("c")).where(F.col("c") > huge).select("page_id")
    whole = _swept(boxes, policy)
    if big.isEmpty():
        return whole
    big = keep(big, "huge")
    return _swept(boxes.join(big, "page_id", "left_anti"), policy).unionByName(_joined(boxes.join(big, "page_id", "left_semi"), policy))


def _result(boxes: DataFrame) -> T.StructType:
    of = lambda c: boxes.schema[c].dataType
    fields = [("page_id", of("page_id")), ("region", T.IntegerType()), *((c, T.DoubleType()) for c in "xywh"), ("stroke", of("stroke")), ("members", T.ArrayType(of("box_id")))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _swept(boxes: DataFrame, policy: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _result(boxes)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < enough:
                continue
            table = pa.Table.from_batches(held)
            # The last page may go on in the next batch.
            at = size - 1 - int(np.argmax(_changes(table.column("page_id"))[::-1]))
            if at:
                yield from regions_of(table.slice(0, at), policy, target)
            held, size = table.slice(at).to_batches(), size - at
            # A page that goes on is looked at again when it has doubled.
            enough = max(ROWS, 2 * size)
        if size:
            yield from regions_of(pa.Table.from_batches(held), policy, target)

    rows = boxes.select("page_id", "box_id", *(F.col(c).cast("double").alias(c) for c in _NUMBERS), "stroke")
    return rows.repartition("page_id").sortWithinPartitions("page_id", "box_id").mapInArrow(run, schema)


def _changes(page: pa.ChunkedArray) -> np.ndarray:
    """Whether a row begins another page than the row before."""
    codes = page.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def regions_of(table: pa.Table, policy: str, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Regions of whole pages; the rows are sorted by page and box."""
    starts = np.flatnonzero(_changes(table.column("page_id")))
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    x, y, w, h, pw, ph = (table.column(c).to_numpy() for c in _NUMBERS)
    pw, ph = np.minimum.reduceat(pw, starts), np.minimum.reduceat(ph, starts)
    if policy == "gap":
        order, n = np.lexsort((h, page)), np.bincount(page)
        low, high = h[order][starts + (n - 1) // 2], h[order][starts + n // 2]
        reach = np.maximum(np.maximum(1, 1.5 * (low + (high - low) * 0.5)), 0.02 * np.minimum(pw, ph))
    else:
        reach = 0.04 * np.maximum(pw, ph)

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dx = np.maximum(0, np.maximum(x[a], x[b]) - np.minimum(x[a] + w[a], x[b] + w[b]))
        dy = np.maximum(0, np.maximum(y[a], y[b]) - np.minimum(y[a] + h[a], y[b] + h[b]))
        p = page[a]
        if policy == "gap":
            return np.hypot(dx, dy) <= reach[p]
        return (dx < 0.04 * pw[p]) & (dy < 0.04 * ph[p]) & (np.minimum(h[a], h[b]) / np.maximum(h[a], h[b]) > 0.6)

    label = np.arange(len(page))
    for a, b in candidate_pairs(page, x, y, np.maximum(w, h), np.maximum(reach, 1e-9)):
        near_by = close(a, b)
        merge(label, a[near_by], b[near_by])

    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) > 0]))
    roots = label[order][first]
    of = page[roots]
    number = np.arange(len(roots)) - np.searchsorted(of, of) + 1
    fold = lambda f, v: f.reduceat(v[order], first)
    left, top, right, bottom = fold(np.minimum, x), fold(np.minimum, y), fold(np.maximum, x + w), fold(np.maximum, y + h)
    members = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), table.column("box_id").combine_chunks().take(pa.array(order)))
    stroke = fold(np.maximum, table.column("stroke").to_numpy())
    columns = [table.column("page_id").combine_chunks().take(pa.array(roots)), number, left, top, right - left, bottom - top, stroke, members]
    yield from pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target).to_batches(max_chunksize=10_000)


def candidate_pairs(page: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of places in the arrays, each once: all that are on one page and within ``reach`` (by page) of each other, and others of
    the cells around."""
    unit = reach[page]
    level = np.ceil(np.log2((size + unit) / unit)).astype(int)
    for top in np.unique(level):
        b = np.flatnonzero(level == top)
        a = np.flatnonzero((level <= top) & np.isin(page, page[b]))
        cell = unit * 2.0**top
        cx, cy = np.floor(x / cell), np.floor(y / cell)
        cx, cy = (cx - cx[a].min() + 1).astype(np.int64), (cy - cy[a].min() + 1).astype(np.int64)
        wide, high = int(cx[a].max()) + 2, int(cy[a].max()) + 2
        key = (page * high + cy) * wide + cx
        b = b[np.argsort(key[b], kind="stable")]
        keys = key[b]
        for row in (-wide, 0, wide):
            lo, hi = np.searchsorted(keys, key[a] + row - 1), np.searchsorted(keys, key[a] + row + 1, side="right")
            ends = np.cumsum(hi - lo)
            for i in range(0, int(ends[-1]), PAIRS):
                j = min(i + PAIRS, int(ends[-1]))
                at = np.arange(i, j)
                k = np.searchsorted(ends, at, side="right")
                left, right = a[k], b[lo[k] + at - (ends[k] - (hi - lo)[k])]
                once = (level[left] < top) | (left < right)
                yield left[once], right[once]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; the label of a group is its least member."""
    while len(a):
        p, q = label[a], label[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _joined(boxes: DataFrame, policy: str) -> DataFrame:
    """The same for huge pages: boxes meet by cell in an equijoin, and links are closed by rounds over all tasks."""
    mid = boxes.groupBy("page_id").agg(F.percentile("h", 0.5).alias("mid"), F.min("page_w").alias("pw"), F.min("page_h").alias("ph"))
    reach = F.greatest(d(1), 1.5 * F.col("mid"), 0.02 * F.least("pw", "ph")) if policy == "gap" else 0.04 * F.greatest("pw", "ph")
    wide = boxes.join(mid.select("page_id", reach.alias("reach")), "page_id").withColumn("node", F.monotonically_increasing_id())
    held = keep(wide.withColumn("level", F.ceil(F.log2((F.greatest("w", "h") + F.col("reach")) / F.col("reach")))), "boxes")
    levels = keep(held.select("page_id", F.col("level").alias("top")).distinct(), "levels")
    place = lambda c, top: F.floor(F.col(c) / (F.col("reach") * F.pow(F.lit(2.0), F.col(top))))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = held.join(levels, "page_id").where(F.col("level") <= F.col("top")).withColumns({"cx": place("x", "top"), "cy": place("y", "top")})
    a = a.withColumn("cx", around("cx")).withColumn("cy", around("cy"))
    b = held.withColumns({"top": F.col("level"), "cx": place("x", "level"), "cy": place("y", "level")})
    a, b = (side.select(*(F.col(c).alias(f"{name}_{c}") for c in side.columns)) for name, side in (("a", a), ("b", b)))
    once = (F.col("a_level") < F.col("b_level")) | (F.col("a_node") < F.col("b_node"))
    met = a.join(b, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("page_id", "top", "cx", "cy")]).where(once & (near(F.col("a_reach")) if policy == "gap" else aligned()))
    found = connected_components(met.select(F.col("a_node").alias("src"), F.col("b_node").alias("dst")))
    tied = held.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    regions = tied.groupBy("page_id", "component").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
        F.max("stroke").alias("stroke"), F.sort_array(F.collect_list("box_id")).alias("members"),
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("members")[0]))
    out = regions.select("page_id", number.alias("region"), "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "stroke", "members")
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in _result(boxes)))
