"""From LLM payloads to bubbles, with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import repair_json


def ingest_bubbles(payloads: DataFrame) -> DataFrame:
    """``payloads`` (…, body) with ``status`` (ok, empty, malformed) and ``bubbles`` (array of struct t, box). No parse, or no
    ``bubbles`` array, is malformed; an empty array is a success."""
    parsed = payloads.withColumn("_v", repair_json(F.col("body")))
    parsed = parsed.withColumn("_b", F.try_variant_get("_v", "$.bubbles", "array<variant>"))
    status = F.when(F.col("_b").isNull(), "malformed").when(F.size("_b") == 0, "empty").otherwise("ok")
    one = lambda v: F.struct(F.try_variant_get(v, "$.t", "string").alias("t"), F.try_variant_get(v, "$.box", "array<double>").alias("box"))
    return parsed.withColumns({"status": status, "bubbles": F.transform("_b", one)}).drop("_v", "_b")


def exploded(ingested: DataFrame, *keys: str) -> DataFrame:
    return ingested.where(F.col("status") == "ok").select(*keys, F.posexplode("bubbles").alias("idx", "b")).select(*keys, "idx", "b.t", "b.box")


def live_bubbles(bubbles: DataFrame) -> DataFrame:
    """Not deleted, and with text (``t``, else ``translated``)."""
    text = F.coalesce(F.when(F.col("t") != "", F.col("t")), F.col("translated"), F.lit(""))
    return bubbles.where(~F.coalesce("deleted", F.lit(False)) & (F.trim(text) != ""))


def cap_repeats(bubbles: DataFrame, n: int = 3, text: str = "t") -> DataFrame:
    """At most ``n`` equal trimmed texts on a page; the first stay."""
    order = Window.partitionBy("page_id", F.trim(text)).orderBy("idx")
    return bubbles.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def merge_bubbles(pages: DataFrame, found: DataFrame, manual: DataFrame) -> DataFrame:
    """One row a page: found bubbles, then manual ones, and ``kind``: render, or clean-only where there are none."""
    both = found.select("page_id", F.lit(0).alias("src"), "idx", "t").unionByName(manual.select("page_id", F.lit(1).alias("src"), "idx", "t"))
    lists = both.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("src", "idx", "t"))).alias("all"))
    out = pages.select("page_id").join(lists, "page_id", "left")
    return out.select("page_id", F.when(F.col("all").isNull(), "clean-only").otherwise("render").alias("kind"), F.coalesce(F.size("all"), F.lit(0)).alias("n_bubbles"), F.coalesce(F.col("all.t"), F.array().cast("array<string>")).alias("texts"))


def manual_bubbles(cached: DataFrame, active: DataFrame, cached_pages: DataFrame | None = None) -> DataFrame:
    """Manual bubbles (is_manual) of each page: from the cache where it has the page, else from the active set. ``cached_pages``
    names the pages of the cache if some of them have no bubbles."""
    held = (cached if cached_pages is None else cached_pages).select("page_id").distinct()
    return cached.where("is_manual").unionByName(active.where("is_manual").join(held, "page_id", "left_anti"))


def request_prompt(task: Column, target: Column, source: Column | None = None, retry: Column | None = None, directive: Column | None = None, default: str = "Thai") -> Column:
    """Prompt of a request: the source language if it is known (not null, empty or ``auto``), the ``task`` to the ``target`` language (``default`` if null or empty),
    and the ``directive`` where ``retry`` holds, on a line of its own."""
    known = F.lit(False) if source is None else F.coalesce(~F.lower(F.trim(source)).isin("", "auto"), F.lit(False))
    hint = F.when(known, F.concat(F.lit("The source language is "), F.lit("") if source is None else source, F.lit(". "))).otherwise("")
    to = F.coalesce(F.when(F.trim(target) != "", target), F.lit(default))
    again = F.when(F.coalesce(retry, F.lit(False)), F.concat(F.lit("\n"), directive, F.lit("\n"))).otherwise("") if retry is not None and directive is not None else F.lit("")
    return F.concat(hint, task, F.lit(" to "), to, F.lit("."), again)


def build_requests(bubbles: DataFrame, prompt: Column) -> DataFrame:
    """One payload a page: the prompt, and the texts by idx as a JSON array."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: F.struct(x["t"].alias("t"))))
    return bubbles.groupBy("page_id").agg(F.concat(F.first(prompt), F.lit("\n"), body).alias("payload"))


def page_requests(pages: DataFrame, bubbles: DataFrame, task: Column, directive: Column, instructions: str = "") -> DataFrame:
    """Requests of pages (page_id, source_lang, target_lang, is_retry): the prompt, the ``instructions`` and the page's texts with their boxes as a JSON object of
    ``bubbles``. Pages without bubbles ask for an empty list."""
    item = F.struct("idx", "t", "box")
    lists = bubbles.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    body = F.transform(F.coalesce("all", F.array().cast("array<struct<idx:int,t:string,box:array<double>>>")), lambda x: F.struct(x["t"].alias("t"), x["box"].alias("box")))
    prompt = request_prompt(task, F.col("target_lang"), F.col("source_lang"), F.col("is_retry"), directive)
    parts = [prompt, F.lit("\n"), *([F.lit(instructions), F.lit("\n")] if instructions else []), F.to_json(F.struct(body.alias("bubbles")))]
    return pages.join(lists, "page_id", "left").select("page_id", F.concat(*parts).alias("payload"))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``violations``: names of the rules (conditions that must hold; unknown fails) that a row breaks."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.withColumn("violations", F.array_compact(broken))


def required_string(c: str) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def finite_within(c: str, least: float | None = None, most: float | None = None) -> Column:
    """A number that is finite and within the bounds given."""
    x = F.col(c).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok & (F.lit(True) if least is None else x >= least) & (F.lit(True) if most is None else x <= most)


def hex_digits(c: str, n: int) -> Column:
    return F.col(c).rlike(f"^[0-9a-f]{{{n}}}$")


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with their ``violations``)."""
    judged = validate(df, rules)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def dimension_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages whose two images differ in size, or have a size that isn't positive."""
    a = left.select("page_id", F.col("width").alias("w1"), F.col("height").alias("h1"))
    b = right.select("page_id", F.col("width").alias("w2"), F.col("height").alias("h2"))
    bad = (F.col("w1") != F.col("w2")) | (F.col("h1") != F.col("h2")) | (F.least("w1", "h1", "w2", "h2") <= 0)
    return a.join(b, "page_id").where(bad)
