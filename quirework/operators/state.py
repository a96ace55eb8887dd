"""State reconciliation: caches, lineage, batches, lookups, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import bloom
from ..scratch import keep


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregation, no sort of a key's history."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def cache_put(held: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``new`` to append: those whose key isn't held, one of each key."""
    return new.dropDuplicates([key]).join(held.select(key).distinct(), key, "left_anti")


def cache_complete(assets: DataFrame, needed: list[str], key: str = "key") -> DataFrame:
    """Keys for which every needed asset is there."""
    return assets.where(F.col("asset").isin(*needed)).groupBy(key).agg(F.countDistinct("asset").alias("n")).where(F.col("n") == len(needed)).select(key)


def pending_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    return pages.join(done.select("page_id").distinct(), "page_id", "left_anti")


def reconcile_results(saved: DataFrame, pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """``state`` of saved results: ignored (already loaded), removed (page gone), stale (page changed) or restored."""
    p = pages.select("page_id", F.col("hash").alias("page_hash"))
    on = loaded.select("page_id").distinct().withColumn("is_loaded", F.lit(True))
    state = F.when(F.col("is_loaded"), "ignored").when(F.col("page_hash").isNull(), "removed").when(F.col("page_hash") != F.col("hash"), "stale").otherwise("restored")
    return saved.join(p, "page_id", "left").join(on, "page_id", "left").select(*[saved[c] for c in saved.columns], state.alias("state"))


def lookup_url(wanted: DataFrame, images: DataFrame, shortest: int = 5, salts: int = 8) -> DataFrame:
    """(id, image_id, tier): the first image with the same url; else the first whose url contains the wanted file name (the
    column ``name``, or else the last segment of the url), if that is longer than ``shortest``.

    For the second tier the urls are indexed by runs of shortest + 1 characters, as far as some wanted name holds them (a filter of fixed size tells
    in the scan). Each name is looked up by the run of its own that the fewest urls hold, and its urls are then tested whole; a name with a run that no url holds
    is in none."""
    first = images.groupBy("url").agg(F.min("image_id").alias("image_id"))
    exact = wanted.join(first, "url").groupBy("id").agg(F.min("image_id").alias("image_id")).withColumn("tier", F.lit(1))
    left = wanted.join(exact.select("id"), "id", "left_anti")
    if "name" not in wanted.columns:
        left = left.withColumn("name", F.element_at(F.split(F.regexp_extract("url", r"^([^?#]*)", 1), "/"), -1))
    left = left.where(F.length("name") > shortest).select("id", "name")
    width = F.lit(shortest + 1)
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - shortest), lambda i: F.substr(c, i, width)))).alias("gram")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("salt")

    asked = keep(left.select("name").distinct().select("name", grams("name")), "asked")
    held = first.where(F.length("url") > shortest).select("image_id", "url", grams("url"))
    index = keep(held.where(bloom.passing(held, "gram", bloom.cells(asked, "gram"))).select("gram", "image_id", "url", salt("url")), "index")
    held_by = index.groupBy("gram").agg(F.count("*").alias("urls"))
    # Salted, as very many names may share a run such as ".jpeg".
    counted = asked.select("name", "gram", salt("name")).join(held_by.select("gram", "urls", spread), ["gram", "salt"], "left")
    rarest = counted.groupBy("name").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "gram")).alias("x")).where("x.urls > 0")
    met = index.join(rarest.select("name", "x.gram", spread), ["gram", "salt"]).where(F.contains("url", "name"))
    names = met.groupBy("name").agg(F.min("image_id").alias("image_id"))
    found = left.join(names, "name").groupBy("id").agg(F.min("image_id").alias("image_id")).withColumn("tier", F.lit(2))
    return exact.unionByName(found)


ACTIONS = ["automatic", "force-clean", "protect"]


def _met(regions: DataFrame, overrides: DataFrame, columns: list[str]) -> tuple[DataFrame, Window]:
    """(rows of both tables, ordered window of a region). Regions and overrides meet as one table dealt by page, so neither is read or shuffled twice: ``_r_`` columns are those of
    ``regions`` (all named ones that it has), ``_o_`` ones those of ``overrides``, ``_over`` tells their rows apart. ``_error`` is null for overrides that apply."""
    keys = ["page_id", "region"]
    sized = {"mask_w", "mask_h"} <= set(overrides.columns) and "page_w" in regions.columns
    mine = [c for c in dict.fromkeys([*columns, *(("page_w", "page_h") if sized else ())]) if c in regions.columns]
    own = regions.select(*keys, F.lit(False).alias("_over"), *(F.col(c).alias(f"_r_{c}") for c in mine))
    rows = own.unionByName(overrides.select(*keys, F.lit(True).alias("_over"), *(F.col(c).alias(f"_o_{c}") for c in overrides.columns)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_over", *(c for c in ("_o_seq",) if c in rows.columns))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A null key meets none.
    rows = rows.withColumns({"_known": F.bool_or(~F.col("_over")).over(whole) & F.col("page_id").isNotNull() & F.col("region").isNotNull(), **{f"_{c}": F.max(f"_r_{c}").over(whole) for c in ("version", "text_role") if c in mine}})
    error = F.when(~F.coalesce(F.col("_o_manual_action").isin(*ACTIONS), F.lit(False)), "unknown-action")
    if sized:
        # Rows are sorted by region, and so by page.
        page = Window.partitionBy("page_id")
        rows = rows.withColumns({f"_{c}": F.max(f"_r_{c}").over(page) for c in ("page_w", "page_h")})
        error = error.when(F.col("page_id").isNotNull() & ((F.col("_o_mask_w") != F.col("_page_w")) | (F.col("_o_mask_h") != F.col("_page_h"))), "wrong-dimensions")
    error = error.when(~F.col("_known"), "unknown-region").when(F.coalesce("_o_mask_pixels", F.lit(0)) <= 0, "empty-mask")
    return rows.withColumn("_error", error), order


def override_errors(regions: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides`` with ``error``, null for those that apply: unknown-action, wrong-dimensions (mask_w and mask_h, where given, against
    page_w and page_h of the page's regions), unknown-region or empty-mask, in this order."""
    rows, _ = _met(regions, overrides, [])
    return rows.where("_over").select(*(F.col(f"_o_{c}").alias(c) for c in overrides.columns), F.col("_error").alias("error"))


def _judged(regions: DataFrame, overrides: DataFrame, columns: list[str]) -> tuple[DataFrame, Window]:
    """``_met`` with what the overrides that apply make of their regions: ``_good``, ``_status``, ``_action`` and ``_new_role``, null in all other rows."""
    rows, order = _met(regions, overrides, ["version", "text_role", *columns])
    judged = F.col("_o_judged_role") if "judged_role" in overrides.columns else F.lit(None).cast("string")
    m = F.col("_o_manual_action")
    keeps = (m == "automatic") & judged.isNotNull()
    done = (m == "force-clean") | F.coalesce("_o_accepted", F.lit(False))
    status = F.when((m == "protect") | keeps, "preserved").when(done, "repaired").otherwise("needs_review")
    action = F.when((m == "protect") | keeps | ~done, "preserve").otherwise("clean")
    role = F.when(m == "protect", "protected").when(m == "force-clean", "dialogue").when(keeps, judged)
    rows = rows.withColumn("_good", F.col("_over") & F.col("_error").isNull())
    return rows.withColumns({f"_{name}": F.when(F.col("_good"), c) for name, c in (("status", status), ("action", action), ("new_role", role))}), order


def override_versions(regions: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row for each override that applies (page_id, region, version, parent_version, seq, manual_action, status, action, text_role): successive retries of a
    region make a chain of versions, each on top of the one before.

    A protected region is preserved. A forced one is repaired, and then counts as dialogue. An automatic one is repaired if ``accepted``, else it needs review and is left
    as it is; it keeps the role that it has by then. If it is judged to be preserved (``judged_role``, where the overrides have it), it is, in that role."""
    rows, order = _judged(regions, overrides, [])
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"version": F.col("_version") + F.count_if("_good").over(so_far).cast("int"), "text_role": F.coalesce(F.last("_new_role", ignorenulls=True).over(so_far), "_text_role")})
    named = {"seq": "_o_seq", "manual_action": "_o_manual_action", "status": "_status", "action": "_action"}
    return rows.where("_good").select("page_id", "region", "version", (F.col("version") - 1).alias("parent_version"), *(F.col(c).alias(name) for name, c in named.items()), "text_role")


def apply_overrides(regions: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual actions on regions: (regions as their last version leaves them, with version and the one it was made from; rejected overrides with their
    ``error``). ``seq`` orders the overrides of a region."""
    keys = ["page_id", "region"]
    rows, order = _judged(regions, overrides, regions.columns)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = {f"_last_{c}": F.last(f"_{c}", ignorenulls=True).over(whole) for c in ("status", "action", "new_role")}
    rows = rows.withColumns({"_n": F.count_if("_good").over(whole).cast("int"), **last}).where("NOT _over")
    new = {"status": F.coalesce("_last_status", "_r_status"), "action": F.coalesce("_last_action", "_r_action"), "text_role": F.coalesce("_last_new_role", "_r_text_role"), "version": F.col("_r_version") + F.col("_n")}
    parent = F.when(F.col("_n") > 0, F.col("_r_version") + F.col("_n") - 1).alias("parent_version")
    out = rows.select(*keys, *(new.get(c, F.col(f"_r_{c}")).alias(c) for c in regions.columns if c not in keys), parent)
    return out, override_errors(regions, overrides).where("error IS NOT NULL").select("page_id", "region", "seq", "error")


def resolve_layer(pages: DataFrame, translated: DataFrame, rendered: DataFrame, clean: DataFrame) -> DataFrame:
    """(page_id, layer, source): the best layer that a page has; the original where there is none."""
    out = pages.select("page_id", F.col("image").alias("original"))
    for name, df in (("translated", translated), ("rendered", rendered), ("clean", clean)):
        out = out.join(df.select("page_id", F.col("image").alias(name)), "page_id", "left")
    order = ["translated", "rendered", "clean", "original"]
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in order))
    return out.select("page_id", F.coalesce(*order).alias("layer"), source.alias("source"))


def restore_order(regions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions joined to their regions by id, numbered in detector order."""
    w = Window.partitionBy("page_id").orderBy("ord")
    return regions.join(decisions, ["page_id", "region"]).withColumn("place", F.row_number().over(w))


def batch_outcomes(attempts: DataFrame, book: str = "book_id") -> DataFrame:
    """One row a page (book_id, page_index, attempt, error): attempts (3 at most), whether one succeeded, the last error that
    was recorded (a later success doesn't clear it), and ``attempted``: no earlier page of the book ran out of quota."""
    used = attempts.where(F.col("attempt") <= 3)
    failed = F.when(F.col("error").isNotNull(), F.struct("attempt", "error"))
    pages = used.groupBy(book, "page_index").agg(F.count("*").alias("attempts"), F.bool_or(F.col("error").isNull()).alias("ok"), F.max(failed)["error"].alias("last_error"))
    before = Window.partitionBy(book).orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max(F.coalesce(F.col("last_error") == "QUOTA", F.lit(False)).cast("int")).over(before)
    return pages.withColumn("attempted", F.coalesce(stopped, F.lit(0)) == 0)


def batch_summary(outcomes: DataFrame, book: str = "book_id", unclean: DataFrame | None = None) -> DataFrame:
    """Pages of a book that succeeded, those that failed and those never tried. ``unclean`` names pages (book, page_index) whose cleaning failed, so that no
    request was made: they fail at the stage ``cleaning``, the others at ``translation``, and ``failures`` lists both as page:stage. A book stopped
    by the quota does not try its later pages."""
    if unclean is None:
        out, stage = outcomes, F.lit("translation")
    else:
        # The quota of a page before stops its cleaning too.
        stop = outcomes.where(F.col("last_error") == "QUOTA").groupBy(book).agg(F.min("page_index").alias("_stop"))
        failed = unclean.select(book, "page_index").distinct().join(stop, book, "left").select(book, "page_index", F.lit(False).alias("ok"), (F.col("_stop").isNull() | (F.col("page_index") < F.col("_stop"))).alias("attempted"), F.lit("cleaning").alias("stage"))
        out = outcomes.join(failed.select(book, "page_index"), [book, "page_index"], "left_anti").select(book, "page_index", "ok", "attempted", F.lit("translation").alias("stage")).unionByName(failed)
        stage = F.col("stage")
    bad = F.when(F.col("attempted") & ~F.col("ok"), F.struct("page_index", stage.alias("stage")))
    joined = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(bad)), f), ", ")
    text = lambda x: x["page_index"].cast("string")
    stages = [] if unclean is None else [joined(lambda x: F.concat(text(x), F.lit(":"), x["stage"])).alias("failures")]
    return out.groupBy(book).agg(F.count_if(F.col("attempted") & F.col("ok")).alias("succeeded"), joined(text).alias("failed_pages"), F.count_if(~F.col("attempted")).alias("skipped"), *stages)


def batch_progress(pages: DataFrame, book: str = "book_id") -> DataFrame:
    w = Window.partitionBy(book)
    return pages.withColumns({"current": F.row_number().over(w.orderBy("page_index")), "total": F.count("*").over(w)}).withColumn("share", F.col("current") / F.col("total"))


def reorder_pages(pages: DataFrame, moves: DataFrame, removed: DataFrame, book: str = "book_id") -> DataFrame:
    """Pages renumbered from 0 after moves (page_id, before_index: a page goes before that place) and removals."""
    left = pages.join(removed.select("page_id").distinct(), "page_id", "left_anti")
    key = F.coalesce(F.col("before_index") - F.lit(0.5), F.col("page_index").cast("double"))
    out = left.join(moves.select("page_id", "before_index"), "page_id", "left").withColumn("_k", key)
    return out.withColumn("new_index", F.row_number().over(Window.partitionBy(book).orderBy("_k", "page_index")) - 1).drop("_k", "before_index")


def append_pages(pages: DataFrame, new: DataFrame, book: str = "book_id") -> DataFrame:
    """``new`` behind ``pages``: page_index goes on where the book ends."""
    end = pages.groupBy(book).agg((F.max("page_index") + 1).alias("_end"))
    shifted = new.join(end, book, "left").withColumn("page_index", F.col("page_index") + F.coalesce("_end", F.lit(0))).drop("_end")
    return pages.unionByName(shifted.select(pages.columns))


def camel_names(df: DataFrame) -> DataFrame:
    """Columns renamed from snake_case to camelCase."""
    camel = lambda name: name.split("_")[0] + "".join(x.capitalize() for x in name.split("_")[1:])
    return df.select(*(F.col(c).alias(camel(c)) for c in df.columns))


def proxied_asset(path: Column, prefix: str) -> Column:
    """``path`` below the proxy's prefix; null unless it is a path of the first API version."""
    return F.when(F.startswith(path, F.lit("/v1/")), F.concat(F.lit(prefix), F.substring(path, 4, 1 << 20)))


def export_plan(pages: DataFrame, prefix: Column, name: str = "name", book: str = "book_id") -> DataFrame:
    """File names PREFIX_001_base.ext in page order, for pages with a payload."""
    from ..functions.exprs import split_name

    base, ext = split_name(F.col(name))
    n = F.row_number().over(Window.partitionBy(book).orderBy("page_index"))
    return pages.withColumn("_n", n).where(F.col("payload").isNotNull()).select(book, "page_index", F.concat(prefix, F.lit("_"), F.lpad(F.col("_n").cast("string"), 3, "0"), F.lit("_"), base, F.lit("."), ext).alias("file"))
