"""Lookups, retries, batches and selections against plain loops."""

import random

from pyspark.sql import functions as F

from quirework.functions.exprs import CATEGORIES, seeded_key
from quirework.operators import boxes, curate, ingest, state


def test_lookup_url_against_contains(spark):
    rnd = random.Random(6)
    part = lambda n: "".join(rnd.choice("ab/.") for _ in range(n))
    images = [(rnd.randrange(400), "https://h/" + part(rnd.randrange(20))) for _ in range(300)] + [(500, None), (501, "héllo/wörld.jpg"), (502, "x")]
    wanted = [(i, f"w{i}", part(rnd.choice([4, 6, 7, 9]))) for i in range(200)] + [(900, "w", "lo/wörld"), (901, images[0][1], "zzzzzz"), (902, None, None), (903, "w", "https://h/"), (904, "w", "nowhere.jpg")]
    want = set()
    for i, url, name in wanted:
        same = [m for m, u in images if u is not None and u == url]
        holds = [m for m, u in images if u is not None and name is not None and len(name) > 5 and name in u]
        if same or holds:
            want.add((i, min(same or holds), 1 if same else 2))
    df = spark.createDataFrame(wanted, "id int, url string, name string")
    got = [tuple(r) for r in state.lookup_url(df, spark.createDataFrame(images, "image_id int, url string")).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 20


def test_successive_retries_make_a_chain(spark):
    base = spark.createDataFrame([(1, 1, "repaired", "clean", "sfx", 1, 60, 40), (1, 2, "repaired", "clean", "dialogue", 3, 60, 40), (2, 1, "preserved", "preserve", "protected", 1, 30, 30)], "page_id int, region int, status string, action string, text_role string, version int, page_w int, page_h int")
    rows = [
        (1, 1, 5, "automatic", 9, 60, 40, False, None), (1, 1, 7, "force-clean", 9, 60, 40, False, None), (1, 1, 6, "protect", 9, 60, 40, None, None), (1, 1, 8, "automatic", 9, 60, 40, True, None), (1, 1, 9, "automatic", 9, 60, 40, True, "sfx"),
        (1, 2, 1, "force-clean", 9, 61, 40, True, None), (1, 2, 2, "protect", 0, 60, 40, True, None), (1, 9, 3, "protect", 9, 60, 40, True, None), (1, 2, 4, None, 9, 60, 40, True, None), (2, 1, 1, "automatic", 9, 30, 30, True, None),
    ]
    o = spark.createDataFrame(rows, "page_id int, region int, seq int, manual_action string, mask_pixels int, mask_w int, mask_h int, accepted boolean, judged_role string")
    chain = [tuple(r)[2:] for r in state.override_versions(base, o).where("page_id = 1 AND region = 1").orderBy("version").collect()]
    assert chain == [
        (2, 1, 5, "automatic", "needs_review", "preserve", "sfx"), (3, 2, 6, "protect", "preserved", "preserve", "protected"), (4, 3, 7, "force-clean", "repaired", "clean", "dialogue"),
        (5, 4, 8, "automatic", "repaired", "clean", "dialogue"), (6, 5, 9, "automatic", "preserved", "preserve", "sfx"),
    ]
    last, rejected = state.apply_overrides(base, o)
    assert {(r.page_id, r.region): (r.status, r.action, r.text_role, r.version, r.parent_version) for r in last.collect()} == {
        (1, 1): ("preserved", "preserve", "sfx", 6, 5), (1, 2): ("repaired", "clean", "dialogue", 3, None), (2, 1): ("repaired", "clean", "protected", 2, 1),
    }
    assert {(r.region, r.seq): r.error for r in rejected.collect()} == {(2, 1): "wrong-dimensions", (2, 2): "empty-mask", (9, 3): "unknown-region", (2, 4): "unknown-action"}


def test_overrides_meet_their_regions_in_one_shuffle(spark, capsys):
    base = spark.createDataFrame([(1, 1, "a", "b", "c", 1, 60, 40), (1, None, "a", "b", "c", 1, 60, 40), (None, 1, "a", "b", "c", 4, 60, 40)], "page_id int, region int, status string, action string, text_role string, version int, page_w int, page_h int")
    rows = [(1, 1, 1, "protect", 9, 60, 40, True), (1, None, 2, "protect", 9, 60, 40, True), (None, 1, 3, "protect", 9, 61, 40, True), (1, 1, 4, "automatic", 9, None, None, None)]
    o = spark.createDataFrame(rows, "page_id int, region int, seq int, manual_action string, mask_pixels int, mask_w int, mask_h int, accepted boolean")
    last, rejected = state.apply_overrides(base, o)
    assert last.columns == [*base.columns, "parent_version"]
    # A null key meets none.
    assert {tuple(r) for r in last.collect()} == {(1, 1, "needs_review", "preserve", "protected", 3, 60, 40, 2), (1, None, "a", "b", "c", 1, 60, 40, None), (None, 1, "a", "b", "c", 4, 60, 40, None)}
    assert {(r.seq, r.error) for r in rejected.collect()} == {(2, "unknown-region"), (3, "unknown-region")}
    for df in (last, rejected, state.override_versions(base, o)):
        capsys.readouterr()
        df.select("*").explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_batches_name_the_stage_that_failed(spark):
    rows = [(1, 0, 1, None), (1, 1, 1, "UPSTREAM"), (1, 3, 1, "QUOTA"), (1, 5, 1, None), (2, 0, 1, None)]
    out = state.batch_outcomes(spark.createDataFrame(rows, "book_id int, page_index int, attempt int, error string"))
    unclean = spark.createDataFrame([(1, 2), (1, 2), (1, 4), (3, 0)], "book_id int, page_index int")
    got = {r.book_id: (r.succeeded, r.failed_pages, r.skipped, r.failures) for r in state.batch_summary(out, unclean=unclean).collect()}
    assert got == {1: (1, "1, 2, 3", 2, "1:translation, 2:cleaning, 3:translation"), 2: (1, "", 0, ""), 3: (0, "0", 0, "0:cleaning")}


def test_prompts_name_languages_and_retries(spark):
    pages = spark.createDataFrame([(1, "ja", "German", False), (2, "auto", None, True), (3, None, " ", None), (4, "", "th", True)], "page_id int, source_lang string, target_lang string, is_retry boolean")
    b = spark.createDataFrame([(1, 1, 'say "b"', [1.0, 2.0, 3.0, 4.0]), (1, 0, "a", None)], "page_id int, idx int, t string, box array<double>")
    got = {r.page_id: r.payload for r in ingest.page_requests(pages, b, F.lit("Translate"), F.lit("LOOK AGAIN"), "JSON only").collect()}
    assert got == {
        1: 'The source language is ja. Translate to German.\nJSON only\n{"bubbles":[{"t":"a"},{"t":"say \\"b\\"","box":[1.0,2.0,3.0,4.0]}]}',
        2: 'Translate to Thai.\nLOOK AGAIN\n\nJSON only\n{"bubbles":[]}', 3: 'Translate to Thai.\nJSON only\n{"bubbles":[]}', 4: 'Translate to th.\nLOOK AGAIN\n\nJSON only\n{"bubbles":[]}',
    }


def test_selection_with_clashes(spark):
    rnd = random.Random(9)
    rows = [(f"p{rnd.randrange(25)}", f"c{rnd.randrange(20)}", {c: float(rnd.randrange(4)) for c in CATEGORIES}) for _ in range(120)]
    df = spark.createDataFrame(rows, "path_hash string, content_sha string, scores map<string,double>")
    ties = {r.path_hash: r.k for r in df.select("path_hash", seeded_key(F.col("path_hash")).alias("k")).collect()}
    paths, shas, want = set(), set(), []
    for c in CATEGORIES:
        p, s, _ = max((r for r in rows if r[0] not in paths and r[1] not in shas), key=lambda r: (r[2][c], ties[r[0]], r[1]))
        paths.add(p)
        shas.add(s)
        want.append((p, s, c))
    got = [tuple(r) for r in curate.stratified_select(df, 12).collect()]
    assert set(want) <= set(got) and len(got) == 12 and len({g[0] for g in got}) == 12 and len({g[1] for g in got}) == 12


def test_layout_in_pixels(spark):
    b = spark.createDataFrame([(1, 0, [100.0, 200.0, 300.0, 600.0], 1000, 2000), (1, 1, None, 1000, 2000)], "page_id int, idx int, box array<double>, page_w int, page_h int")
    b = b.withColumns({c: F.lit(None).cast("double") for c in "xywh"}).withColumn("is_invalid_box", F.lit(False))
    got = {r.idx: (r.px, r.py, r.pw, r.ph) for r in boxes.layout_boxes(b).collect()}
    assert got == {0: (200, 200, 400, 400), 1: (350, 50, 300, 300)}
