"""Corpus curation: dedupe, stratified and seeded selection, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import CATEGORIES, argmax_category, seeded_key
from ..scratch import keep


def dedupe_content(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each content in the given order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_review_label(candidates: DataFrame, labels: DataFrame, label: str = "original_comic") -> DataFrame:
    return candidates.join(labels.where(F.col("label") == label).select("content_sha").distinct(), "content_sha")


def ranked_by_category(candidates: DataFrame, most: int) -> DataFrame:
    """The best ``most`` candidates of each category by score, then seeded key, both falling. The limit is pushed into
    the window, so no category is sorted whole."""
    long = candidates.select("path_hash", "content_sha", F.explode("scores").alias("category", "score"))
    w = Window.partitionBy("category").orderBy(F.desc("score"), F.desc(seeded_key(F.col("path_hash"))))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def stratified_select(candidates: DataFrame, count: int) -> DataFrame:
    """``count`` candidates (path_hash, content_sha, scores), unique by path and content: for each category in the fixed order the
    best by score, then seeded key, whose path and content are not taken yet; then the rest by seeded key, with their best
    category. Raises if that can't be met.

    The best of all open categories are one aggregate over the narrow candidates, whatever their number of paths or contents. They are taken in order
    up to the first that clashes with one taken before; the rest are asked for again. The fill is a top-n."""
    if count < len(CATEGORIES):
        raise ValueError(f"count must be at least {len(CATEGORIES)}")
    held = keep(candidates.select("path_hash", "content_sha", "scores", seeded_key(F.col("path_hash")).alias("tie")), "candidates")
    spark, picks = candidates.sparkSession, []
    left = held
    while open_ones := CATEGORIES[len(picks) :]:
        best = lambda c: F.max_by(F.struct("path_hash", "content_sha"), F.struct(F.col("scores")[c], "tie", "content_sha"))
        # One row, with as many picks as there are categories.
        found = left.agg(*(best(c).alias(f"b{i}") for i, c in enumerate(open_ones))).first()
        for category, pick in zip(open_ones, found, strict=True):
            if pick is None:
                raise ValueError(f"no unique candidate for {category}")
            if any(pick.path_hash == path or pick.content_sha == sha for path, sha, _ in picks):
                break
            picks.append((pick.path_hash, pick.content_sha, category))
        left = held.where(~F.col("path_hash").isin([p for p, _, _ in picks]) & ~F.col("content_sha").isin([c for _, c, _ in picks]))
    one = dedupe_content(dedupe_content(left, "content_sha", [F.desc("tie"), F.asc("path_hash")]), "path_hash", [F.asc("content_sha")])
    rest = one.orderBy(F.desc("tie"), "path_hash").limit(count - len(CATEGORIES))
    first = spark.createDataFrame(picks, "path_hash string, content_sha string, category string")
    out = keep(first.unionByName(rest.select("path_hash", "content_sha", argmax_category(F.col("scores")).alias("category"))), "selected")
    if out.count() < count:
        raise ValueError("too few unique candidates")
    return out


def seeded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """A reproducible sample of ``n`` rows."""
    return rows.orderBy(F.desc(seeded_key(F.col(key))), key).limit(n)


def review_selection(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` candidates with the best single score, each with its category."""
    best = F.array_max(F.map_values("scores"))
    return candidates.withColumns({"best": best, "category": argmax_category(F.col("scores"))}).orderBy(F.desc("best"), "path_hash").limit(n).select("path_hash", "content_sha", "category", "best")


def review_template(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list to review, by hashes alone, and the labels to fill in, all ``reject``."""
    return selected.select("path_hash", "content_sha", "category"), selected.select("content_sha", F.lit("reject").alias("label"))


def build_manifest(candidates: DataFrame, labels: DataFrame, count: int) -> DataFrame:
    return stratified_select(with_review_label(candidates, labels), count)


def resolve_manifest(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each manifest row with ``state``: ok, missing (no such path), or changed (other content)."""
    s = scan.select("path_hash", F.col("content_sha").alias("found_sha"))
    state = F.when(F.col("found_sha").isNull(), "missing").when(F.col("found_sha") != F.col("content_sha"), "changed").otherwise("ok")
    return manifest.join(s, "path_hash", "left").withColumn("state", state).drop("found_sha")


def manifest_checks(manifest: DataFrame, required: list[str]) -> DataFrame:
    """One row of booleans: unique content, unique paths, one label, all categories there, no raw path."""
    return manifest.agg(
        (F.count("*") == F.countDistinct("content_sha")).alias("unique_sha"), (F.count("*") == F.countDistinct("path_hash")).alias("unique_path"), (F.countDistinct("label") == 1).alias("one_label"),
        (F.size(F.array_except(F.array(*map(F.lit, required)), F.collect_set("category"))) == 0).alias("covered"), F.bool_and(F.col("path_hash").rlike("^[0-9a-f]{64}$")).alias("anonymous"),
    )


def verify_inventory(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, state): ok, mismatch, unknown (not expected) or missing."""
    a, e = actual.select("id", F.col("sha").alias("a")), expected.select("id", F.col("sha").alias("e"))
    state = F.when(F.col("e").isNull(), "unknown").when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("e"), "ok").otherwise("mismatch")
    return a.join(e, "id", "full").select("id", state.alias("state"))
