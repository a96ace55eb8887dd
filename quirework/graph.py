"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; ``component`` is the smallest node reachable.

    Alternates two steps until the edges are a forest of stars: each node's larger neighbours are tied to the least node
    around it, then its smaller ones are. Rows are narrow, hubs have their minimum taken by partial aggregation, and the
    number of rounds grows with the logarithm of the longest chain."""
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = keep(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        e = keep(e.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v"), (F.col("m") < F.col("w")).alias("moved")), "edges")
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.bool_or("moved").alias("moved"))
        if not least.agg(F.coalesce(F.bool_or(F.col("moved") | (F.col("m") < F.col("top"))), F.lit(False))).first()[0]:
            break
        pair = lambda a: F.struct(F.col(a).alias("u"), F.col("m").alias("v"))
        e = e.join(least.select("u", "m"), "u").select(F.explode(F.array(pair("u"), pair("v"))).alias("x")).select("x.u", "x.v")
        e = keep(e.where(F.col("u") != F.col("v")).distinct(), "edges")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def components_within(edges: DataFrame, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(group, node, component) for edges that never leave a group (a page): one shuffle by group, then one pass over the
    sorted partition that holds the nodes of one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        out: list[tuple[int, int, int]] = []
        at = None

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["g", "node", "component"])

        for batch in batches:
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at:
                    out.extend((at, x, root(x)) for x in parent)
                    parent.clear()
                    at = g
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            yield rows()
            out.clear()
        out.extend((at, x, root(x)) for x in parent)
        yield rows()

    narrow = edges.select(*(F.col(c).cast("long").alias(n) for c, n in ((group, "g"), (src, "a"), (dst, "b"))))
    return narrow.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, node long, component long").withColumnRenamed("g", group)
