"""Merkle manifest of a dataset by sibling-shift self-joins (operator 11).

Each row is a leaf: the SHA-256 of its fields, each as ``-`` if null, else its number of UTF-8 bytes, a colon and its value.
The leaves of a source stand in the order of doc_id (null first, equal ones by leaf). At every level each run of ``ARITY`` nodes becomes one, until
a source has a single node, its subroot; the subroots, in the order of the sources (null first, by UTF-8 bytes), make one more tree,
whose end is the root. A node asks for its siblings by their computed places (the start of its run and every slot offset),
one equijoin a level; the rows in slot zero emit the parents. A proof is what stands before and after a node in its run, level by level.

Places come from a range sort of narrow rows: a row's place is its place in its partition and the rows of its source in the partitions
before, so a hot source is spread over many tasks. Joins are on (source number, place), whose groups are one run. The driver gets the
root and the sizes of the largest source and of the list of sources.

Null text or any other null field is ``-``; empty and very long texts are hashed whole, in the JVM; rows that repeat are leaves of their own;
a row without doc_id counts as not tampered; an empty table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep

ARITY = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<before:binary,after:binary>>"


@dataclass(frozen=True)
class Manifest:
    """``proofs``: doc_id, leaf, other (the leaf of a second version of the row, or null), subroot, path; digests are binary. ``root``
    is null for an empty table."""

    proofs: DataFrame
    root: str | None


def digest(*parts: Column) -> Column:
    """SHA-256 of texts, one after another, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def leaf(fields: list[Column]) -> Column:
    parts = []
    for c in fields:
        s = c.cast("string")
        parts += [F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))]
    return digest(*parts)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, leaf, ...) with s, the number of the source, idx, the place in it, and n, its number of rows."""
    order = ["source", "doc_id", "leaf", "at"]
    # The last key only spreads rows that are alike.
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("at")
    # Within a partition the number that it gives to rows rises by one from row to row.
    held = keep(ranged.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)), "placed")
    runs = keep(held.groupBy("part", "source").agg(F.min("m").alias("first"), F.count("*").alias("c")), "runs")
    mine = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"before": F.coalesce(F.sum("c").over(mine), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("source"))})
    fresh = runs.where("before = 0").withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1)
    # As many rows as partitions.
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(total), F.lit(0)).alias("start"))
    number = fresh.join(starts, "part").select(F.col("source").alias("of"), (F.col("start") + F.col("k")).alias("s"))
    runs = keep(runs.join(number, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), F.col("source").alias("of"), "s", "n", (F.col("before") - F.col("first")).alias("shift")), "runs")
    both = held.join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    return both.select("s", (F.col("m") + F.col("shift")).alias("idx"), "n", *(c for c in rows.columns if c != "source"))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (s, idx, n, h, own) with ``before`` and ``after``, the digests of their run on either side."""
    start = F.col("idx") - F.col("idx") % arity
    asked = nodes.select("s", "idx", "n", F.explode(F.sequence(start, F.least(start + arity, F.col("n")) - 1)).alias("sib"))
    met = asked.join(nodes.select("s", F.col("idx").alias("sib"), "h", "own"), ["s", "sib"])
    mine = F.col("sib") == F.col("idx")
    # At most ``arity`` rows a group.
    runs = met.groupBy("s", "idx", "n").agg(F.array_sort(F.collect_list(F.struct("sib", "h"))).alias("run"), F.max(F.when(mine, F.struct("h", "own"))).alias("x"))
    joined = lambda keep_it: F.aggregate(F.filter("run", keep_it), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["h"]))
    return runs.select("s", "idx", "n", "x.h", "x.own", joined(lambda x: x["sib"] < F.col("idx")).alias("before"), joined(lambda x: x["sib"] > F.col("idx")).alias("after"))


def climb(nodes: DataFrame, widest: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Trees over the nodes of each s: (tables of levels with siblings, from the leaves; the last node of each s)."""
    levels, ends = [], nodes.where("n = 1").select("s", "h")
    while widest > 1:
        levels.append(keep(with_siblings(nodes.where("n > 1"), arity), "level"))
        slot_zero = levels[-1].where(F.col("idx") % arity == 0)
        up = lambda c: F.floor((F.col(c) + arity - 1) / arity)
        nodes = slot_zero.select("s", up("idx").alias("idx"), up("n").alias("n"), F.unhex(digest(_hex(F.col("h")), _hex(F.col("after")))).alias("h"), F.lit(None).cast("boolean").alias("own"))
        ends = ends.unionByName(nodes.where("n = 1").select("s", "h"))
        widest = -(-widest // arity)
    return levels, ends


def descend(nodes: DataFrame, levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """(own, h, subroot, path) of every node: its siblings, those of its parent and so on, then the path of its s in ``ends`` (s, subroot, path).
    Each step joins a level with the one above, so no more than a run meets one row."""
    above = None
    for depth in reversed(range(len(levels))):
        level = levels[depth].withColumn("step", F.array(F.struct("before", "after"))).withColumn("up", F.floor(F.col("idx") / arity))
        last = level.where(F.col("n") <= arity).join(ends, "s")
        if above is not None:
            rest = level.where(F.col("n") > arity).join(above.select("s", F.col("idx").alias("up"), "subroot", "path"), ["s", "up"])
            last = last.unionByName(rest.select(last.columns))
        above = last.select("s", "idx", "h", "own", "subroot", F.concat("step", "path").alias("path"))
        if depth:
            above = keep(above.drop("h", "own"), "paths")
    alone = nodes.where("n = 1").join(ends, "s").select("own", "h", "subroot", "path")
    return alone if above is None else above.select("own", "h", "subroot", "path").unionByName(alone)


def build(docs: DataFrame, other: DataFrame | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text). ``other`` gives the columns ``changed`` and ``new_text`` of the
    same rows, if there is a second version of some."""
    d = docs.select(*FIELDS) if other is None else other.select(*FIELDS, "changed", "new_text")
    fields = [F.col(c) for c in FIELDS]
    second = F.lit(None).cast("binary") if other is None else F.when(F.col("changed"), F.unhex(leaf([*fields[:-1], F.col("new_text")])))
    rows = keep(d.select("source", "doc_id", F.unhex(leaf(fields)).alias("leaf"), second.alias("other")), "leaves")
    nodes = keep(placed(rows).select("s", "idx", "n", F.col("leaf").alias("h"), F.struct("doc_id", "other").alias("own")), "nodes")
    sizes = nodes.agg(F.max("n").alias("n"), (F.max("s") + 1).alias("s")).first()
    if sizes.n is None:
        return Manifest(nodes.select("own.doc_id", F.col("h").alias("leaf"), "own.other", F.col("h").alias("subroot"), F.lit(None).cast(_PATH).alias("path")), None)
    levels, tops = climb(nodes, sizes.n, arity)
    tops = keep(tops.select(F.lit(0).cast("long").alias("s"), F.col("s").alias("idx"), F.lit(sizes.s).cast("long").alias("n"), "h", F.struct("s").alias("own")), "subroots")
    upper, root = climb(tops, sizes.s, arity)
    # One row.
    root = root.first().h
    end = docs.sparkSession.range(1).select(F.col("id").alias("s"), F.lit(None).cast("binary").alias("subroot"), F.array().cast(_PATH).alias("path"))
    ends = keep(descend(tops, upper, end, arity).select("own.s", F.col("h").alias("subroot"), "path"), "ends")
    proofs = descend(nodes, levels, ends, arity)
    return Manifest(proofs.select("own.doc_id", F.col("h").alias("leaf"), "own.other", "subroot", "path"), bytes(root).hex())


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf (lowercase hex) and a path."""
    return F.aggregate(path, start, lambda acc, x: digest(_hex(x["before"]), acc, _hex(x["after"])))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, each run from left to right."""
    return digest(F.array_join(F.transform(path, lambda x: _hex(F.concat(x["before"], x["after"]))), ""))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = build(docs, docs.withColumns({"changed": hit, "new_text": F.translate("text", upper, upper.lower())}))
    root = F.lit(made.root).cast("string")
    out = made.proofs.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        fold(_hex(F.coalesce("other", "leaf")), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int, top: int, arity: int = ARITY) -> str:
    """SQL for trees of at most ``depth`` levels below a subroot and ``top`` above."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    head = " || ".join(part(c) for c in FIELDS[:-1])
    run = lambda frame, k: f"coalesce(string_agg(h, '') OVER (PARTITION BY s, idx // {arity} ORDER BY idx ROWS BETWEEN {frame}), '') AS {k}"
    tables, folds = [], []
    for tree, levels in (("n", depth), ("t", top)):
        for k in range(levels):
            tables.append(f"{tree}{k}r AS (SELECT *, {run('UNBOUNDED PRECEDING AND 1 PRECEDING', 'b')}, {run('1 FOLLOWING AND UNBOUNDED FOLLOWING', 'a')} FROM {tree}{k})")
            tables.append(f"{tree}{k + 1} AS (SELECT s, idx // {arity} AS idx, (n + {arity - 1}) // {arity} AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {tree}{k} GROUP BY s, idx // {arity}, n)")
            folds.append((f"{tree}{k}r", f"{tree}{k}r.s = {'x.s' if tree == 'n' else '0'} AND {tree}{k}r.idx = {'x.idx' if tree == 'n' else 'x.s'} // {arity**k}"))
        if tree == "n":
            tables.append(f"t0 AS (SELECT 0 AS s, s AS idx, count(*) OVER () AS n, h FROM n{depth})")
    folded = "start"
    for t, _ in folds:
        folded = f"CASE WHEN {t}.n = 1 THEN {folded} ELSE sha256({t}.b || ({folded}) || {t}.a) END"
    proof = " || ".join(f"{t}.b || {t}.a" for t, _ in folds)
    joins = " ".join(f"JOIN {t} ON {on}" for t, on in folds)
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    return f"""WITH d AS (SELECT *, sha256({head} || {part('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {part("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS forged FROM documents),
x AS (SELECT doc_id, leaf, coalesce(forged, leaf) AS start, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
n0 AS (SELECT s, idx, n, leaf AS h FROM x), {", ".join(tables)}
SELECT x.doc_id, x.leaf, n{depth}.h AS subroot, t{top}.h AS root, sha256({proof}) AS proof_sha256, {folded} AS folded_root, ({folded}) = t{top}.h AS verified
FROM x {joins} JOIN n{depth} ON n{depth}.s = x.s CROSS JOIN t{top}"""


#: Enough for 16^5 documents of a source and 16^3 sources.
ORACLE = _oracle(5, 3)
