"""A Bloom filter of fixed size as a column: tests rows where they are read, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: 1 MB; more keys only let more rows through to the join that must follow.
CELLS, PROBES = 1 << 17, 3


def _place(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(CELLS * 64))


def cells(keys: DataFrame, name: str) -> DataFrame:
    """One row: ``bits``, an array of CELLS longs, whatever the number of keys."""
    places = keys.select(F.explode(F.array(*(_place(F.col(name), i) for i in range(PROBES)))).alias("p"))
    some = places.select(F.expr("p div 64").alias("cell"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("b"))
    grid = keys.sparkSession.range(CELLS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("b"))
    full = some.unionByName(grid).groupBy("cell").agg(F.bit_or("b").alias("b"))
    # Written once, since each probe reads it.
    return keep(full.agg(F.array_sort(F.collect_list(F.struct("cell", "b"))).alias("x")).select(F.col("x.b").alias("bits")), "bits")


def passing(df: DataFrame, name: str, bits: DataFrame) -> Column:
    """Whether the key may be in the filter; true for all that are, false for a null one."""
    table, found = bits.scalar(), F.lit(True)
    for i in range(PROBES):
        p = _place(F.col(name), i)
        found = found & (F.getbit(F.element_at(table, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return F.col(name).isNotNull() & found
