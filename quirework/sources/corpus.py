"""Sources and sinks: corpus scans, uploads, JSON documents, stores that keep what they have."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import cache_put

IMAGES = r"(?i)\.(png|jpg|jpeg|webp)$"


def scan_corpus(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Image files below ``root`` in case-folded order; ``content`` is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(IMAGES))
    return files.select("path", "length", "modificationTime", *(["content"] if content else [])).orderBy(F.lower("path"), "path")


def admit_uploads(uploads: DataFrame, most: int, types: list[str]) -> DataFrame:
    """``reject_status`` of an upload (media_type, length, content): 415 for another type, 413 for one too large, 415 for content
    whose first bytes aren't of its type; null if admitted."""
    head = F.hex(F.substring("content", 1, 12))
    real = F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    bad_type = ~F.coalesce(F.col("media_type").isin(*types), F.lit(False))
    return uploads.withColumn("reject_status", F.when(bad_type, 415).when(F.col("length") > most, 413).when(real.isNull() | (real != F.col("media_type")), 415))


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``pages`` of manifest documents, one row each."""
    return spark.read.schema(f"pages array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(content_sha, label) from a document with a ``labels`` map, or one that is the map."""
    text = spark.read.text(path, wholetext=True)
    inner, bare = F.from_json("value", "struct<labels:map<string,string>>")["labels"], F.from_json("value", "map<string,string>")
    return text.select(F.explode(F.coalesce(inner, bare)).alias("content_sha", "label"))


def write_report(summary: DataFrame, pages: DataFrame, path: str) -> None:
    """JSON: the summary row below ``summary``, and the pages, one object a line, in as many files as they have partitions below
    ``pages``. Keys are sorted."""
    summary.select(*sorted(summary.columns)).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    pages.select(*sorted(pages.columns)).write.mode("overwrite").json(f"{path}/pages")


def store_if_absent(spark: SparkSession, new: DataFrame, path: str, key: str = "key") -> None:
    """Append rows whose key isn't stored yet; the commit protocol publishes whole files only."""
    try:
        held = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = new.limit(0)
    cache_put(held, new, key).write.mode("append").parquet(path)
