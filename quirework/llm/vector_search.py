"""Exact top-k search by vector-approximation files (operator 6).

Vectors are cut into parts of bounded size, and each part is stored as an approximation of one byte a component: the
component's cell among 256 even ones between its least and greatest value in the part. Queries are cut into blocks, as large as a task
can hold, and parts are dealt to ``LANES``; a task walks the parts of one lane with one block (a stated query set against all rows). The middles of
the cells give each score within half a cell's width times the query's component, so there is a lower and an upper bound. The task holds the
k-th lower bound that each query has so far: a vector whose upper bound is below it is out. What is left of the lanes is held against the k-th lower bound
among all. Exact vectors are read by id, in the order of the bounds: first the k best of each query, then those whose bound reaches the k-th exact
score so far. All others are certain to score less.

Components become floor(scale * x), so scores are integers; they are exact at any size, and those outside the range of a
long count as its ends. Vectors that are null, or hold a null or non-finite component (before or after scaling), or have no id
take no part; a vector of another length than the query is no candidate for it; rows repeated with the same id and vector
count once, rows of one id with several vectors are candidates each; ties go to the smaller id; very long vectors
make parts of fewer rows; an empty table gives an empty one; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import bloom
from ..scratch import keep
from .text import bounded

#: Components in a part, in a block of queries, and in a row of queries, about.
PART_SIZE, BLOCK_SIZE, ROW_SIZE = 1 << 19, 1 << 23, 1 << 16
#: Tasks that share the parts for each block. Each keeps at least k rows a query.
LANES = 32
#: Queries that meet a part at once; candidates that a task holds before it drops those that are out.
AT_ONCE, HELD = 256, 1_000_000
CELLS = 256
LONG = 2**63


def score(query: np.ndarray, vector: np.ndarray) -> int:
    """Exact inner product of integers held as doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        if np.abs(query).max(initial=0) * np.abs(vector).max(initial=0) * len(query) < 2**53:
            return int(query @ vector)
    return max(-LONG, min(LONG - 1, sum(int(x) * int(y) for x, y in zip(query, vector, strict=True))))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, width): the cell of each component, and each component's least value and cell width."""
    with np.errstate(over="ignore", invalid="ignore"):
        low = vectors.min(axis=0)
        width = np.maximum((vectors.max(axis=0) - low) / CELLS, 1e-9)
        return np.nan_to_num((vectors - low) // width, nan=0, posinf=CELLS - 1).clip(0, CELLS - 1).astype(np.uint8), low, width


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, a row for each query. What can't be bounded has infinite ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        middles = low + (codes + 0.5) * width
        most = np.abs(middles).max(initial=0) + width.max(initial=0)
        size = np.abs(queries).sum(axis=1)
        # The second part stands for what floating point loses.
        error = np.abs(queries) @ (width / 2) + 1e-9 * (1 + size) * (1 + most)
        about = queries @ middles.T
        return np.nan_to_num(about - error[:, None], nan=-np.inf), np.nan_to_num(about + error[:, None], nan=np.inf, posinf=np.inf)


def integers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, h, v, d): valid vectors as integers in doubles, without repeats; a hash and the length of each."""
    x = F.col(vector_column)
    scaled = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    good = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2^53 on a double has no fraction.
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < float(2**53), F.floor(c).cast("double")).otherwise(c))
    rows = vectors.where(good).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["vec_id", "h"]).withColumn("d", F.size("v")).where("d > 0")


def stored(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each part: its approximation."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        codes, low, width = quantised(np.stack(part["v"]))
        return pd.DataFrame({"d": [len(low)], "part": [part["part"].iloc[0]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "hs": [part["h"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()], "width": [width.tobytes()], "cells": [codes.tobytes()]})

    placed = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "h"), F.lit(parts)))
    return keep(placed.groupBy("d", "part").applyInPandas(build, "d int, part long, ids binary, hs binary, low binary, width binary, cells binary"), "cells")


class Walk:
    """One block of queries on its way through the parts of a lane."""

    def __init__(self, k: int):
        self.k, self.ids, self.hs, self.queries, self.best = k, [], [], [], None
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def ask(self, ids: np.ndarray, hs: np.ndarray, queries: np.ndarray) -> None:
        self.ids.append(ids)
        self.hs.append(hs)
        self.queries.append(queries)

    def meet(self, ids: np.ndarray, hs: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        if self.best is None:
            self.ids, self.hs, self.queries = map(np.concatenate, (self.ids, self.hs, self.queries))
            self.best = np.full((len(self.ids), self.k), -np.inf)
        for start in range(0, len(self.queries), AT_ONCE):
            here = slice(start, start + AT_ONCE)
            least, most = bounds(self.queries[here], codes, low, width)
            own = self.ids[here, None] == ids
            least[own] = most[own] = -np.inf
            top = np.partition(least, len(ids) - self.k, axis=1)[:, -self.k :] if len(ids) > self.k else least
            self.best[here] = np.partition(np.concatenate([self.best[here], top], axis=1), top.shape[1] - 1, axis=1)[:, -self.k :] if top.shape[1] else self.best[here]
            q, j = np.nonzero((most >= self.best[here].min(axis=1)[:, None]) & ~own)
            self.found.append((q + start, ids[j], hs[j], least[q, j], most[q, j]))
            self.size += len(q)
        if self.size > HELD:
            self.prune()

    def prune(self) -> None:
        q, ids, hs, least, most = map(np.concatenate, zip(*self.found, strict=True))
        near = most >= self.best[q].min(axis=1)
        self.found = [(q[near], ids[near], hs[near], least[near], most[near])]
        # If hardly any are out, they are all that the exact vectors must tell.
        self.size = int(near.sum()) // 2

    def left(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self.prune()
            q, ids, hs, least, most = self.found[0]
            for i in range(0, len(q), 20_000):
                at = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[q[at]], self.hs[q[at]], ids[at], hs[at], least[at], most[at])], names=["query_id", "query_h", "vec_id", "h", "lower", "upper"])


def candidates(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, query_h, vec_id, h, upper, r): what the cells leave, numbered in the order of the bounds."""
    count = rows.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(is_query, F.col("d"))), F.lit(0)).alias("q")).first()
    parts, blocks, packs = max(1, -(-count.n // PART_SIZE)), max(1, -(-count.q // BLOCK_SIZE)), max(1, -(-count.q // ROW_SIZE))
    lanes = min(parts, LANES)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [len(block["v"].iloc[0])], "part": [block["pack"].iloc[0]], "ids": [block["vec_id"].to_numpy(np.int64).tobytes()], "hs": [block["h"].to_numpy(np.int64).tobytes()], "cells": [np.stack(block["v"]).tobytes()]})

    none = F.lit(None).cast("binary")
    asked = rows.where(is_query).withColumn("pack", F.pmod(F.xxhash64("vec_id", "h", F.lit(2)), F.lit(packs))).groupBy("d", "pack").applyInPandas(packed, "d int, part long, ids binary, hs binary, cells binary")
    columns = ["d", "block", "lane", "follows", "part", "ids", "hs", "low", "width", "cells"]
    asked = asked.withColumns({"block": F.col("part") % blocks, "low": none, "width": none, "follows": F.lit(False)}).withColumn("lane", each(lanes)).select(columns)
    held = stored(rows, parts).withColumns({"lane": F.col("part") % lanes, "follows": F.lit(True)}).withColumn("block", each(blocks)).select(columns)
    stream = asked.unionByName(held).repartition("d", "block", "lane").sortWithinPartitions("d", "block", "lane", "follows", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk = None, Walk(k)
        for batch in batches:
            for d, block, lane, follows, _, ids, hs, low, width, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, block, lane) != at:
                    yield from walk.left()
                    at, walk = (d, block, lane), Walk(k)
                ids, hs = np.frombuffer(ids, np.int64), np.frombuffer(hs, np.int64)
                if not follows:
                    walk.ask(ids, hs, np.frombuffer(cells).reshape(-1, d))
                elif walk.ids is not None and len(walk.ids):
                    walk.meet(ids, hs, np.frombuffer(cells, np.uint8).reshape(-1, d), np.frombuffer(low), np.frombuffer(width))
        yield from walk.left()

    found = bounded(stream).mapInArrow(run, "query_id long, query_h long, vec_id long, h long, lower double, upper double")
    # The numbers that all lanes leave of a query: one exchange for the k-th lower bound and for the order.
    query = Window.partitionBy("query_id", "query_h")
    ranked = found.withColumn("place", F.row_number().over(query.orderBy(F.desc("lower"))))
    kth = F.coalesce(F.max(F.when(F.col("place") == k, F.col("lower"))).over(query), F.lit(float("-inf")))
    left = ranked.withColumn("kth", kth).where(F.col("upper") >= F.col("kth"))
    return keep(left.withColumn("r", F.row_number().over(query.orderBy(F.desc("upper"), "vec_id", "h"))).drop("place", "kth", "lower"), "ordered")


def _kth(found: DataFrame, column: str, k: int) -> DataFrame:
    """(query_id, query_h, kth): the k-th highest value of each query, or minus infinity if there are fewer."""
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "query_h").orderBy(F.desc(column)))).where(F.col("r") <= k)
    return best.groupBy("query_id", "query_h").agg(F.when(F.count("*") == k, F.min(column)).otherwise(F.lit(float("-inf"))).alias("kth"))


def row_scores(queries: pa.ListArray, vectors: pa.ListArray) -> np.ndarray:
    """Exact inner products of the i-th query and the i-th vector, clamped to a long."""
    q, v = queries.flatten().to_numpy(), vectors.flatten().to_numpy()
    n = len(queries)
    d = len(q) // n if n else 0
    if not n or d * n != len(q) or (np.diff(queries.offsets.to_numpy()) != d).any():
        return np.array([score(np.array(a), np.array(b)) for a, b in zip(queries.to_pylist(), vectors.to_pylist(), strict=True)], np.int64)
    q, v = q.reshape(n, d), v.reshape(n, d)
    with np.errstate(over="ignore", invalid="ignore"):
        safe = np.abs(q).max(axis=1) * np.abs(v).max(axis=1) * d < 2**53
        out = np.where(safe, np.einsum("ij,ij->i", q, v), 0).astype(np.int64)
    for i in np.flatnonzero(~safe):
        out[i] = score(q[i], v[i])
    return out


def _read(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` with their exact scores; ``rows`` and ``queries`` hold all vectors that they may name."""
    full = pairs.join(rows.select("vec_id", "h", "v"), ["vec_id", "h"]).join(queries, ["query_id", "query_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(row_scores(batch.column(4), batch.column(5)))], names=[*batch.schema.names[:4], "score"])

    return bounded(full.select("query_id", "query_h", "vec_id", "h", "q", "v")).mapInArrow(run, "query_id long, query_h long, vec_id long, h long, score long")


def scored(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The exact scores that had to be read."""
    left = candidates(rows, is_query, k)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("h").alias("query_h"), F.col("v").alias("q"))
    # Only vectors that some query may want leave the scan.
    bits = bloom.cells(left.select(F.xxhash64("vec_id", "h").alias("key")).distinct(), "key")
    keyed = rows.withColumn("key", F.xxhash64("vec_id", "h"))
    wanted = keyed.where(bloom.passing(keyed, "key", bits))
    first = keep(_read(left.where(F.col("r") <= k), wanted, queries), "scores")
    rest = left.where(F.col("r") > k).join(_kth(first, "score", k), ["query_id", "query_h"]).where(F.col("upper") >= F.col("kth"))
    return first.unionByName(_read(rest, wanted, queries))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on ``vec_id``."""
    rows = keep(integers(vectors, id_column, vector_column, scale), "vectors")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "query_h", "h")
    return scored(rows, is_query, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH rows AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
