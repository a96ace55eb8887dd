"""Fixed expectations of single operators."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.functions import exprs as X
from quirework.graph import connected_components
from quirework.operators import boxes as B
from quirework.operators import curate, ingest, metrics, regions, rules, state
from quirework.sources import corpus
from quirework.streaming import events as E


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    ("body", "status", "first"),
    [
        ('{"bubbles":[{"t":"สวัสดี"}]}', "ok", "สวัสดี"), ('```json\n{"bubbles":[{"t":"a"}]}\n```', "ok", "a"), ('```\n{"bubbles":[{"t":"a"}]}```', "ok", "a"), ('{"bubbles":[{"t":"เฮ้",}]}', "ok", "เฮ้"),
        ('{"bubbles":[{"t":"ทดสอบ"}', "ok", "ทดสอบ"), ('{"bubbles":[{"t":"b"}]} and that is all', "ok", "b"), ("fdsfafdas", "malformed", None), ("", "malformed", None), (None, "malformed", None),
        ('{"bubbles":{}}', "malformed", None), ('{"other":[]}', "malformed", None), ('{"bubbles":[]}', "empty", None), ('{"a":1}{"b":2}', "malformed", None),
    ],
)
def test_payload_repair(spark, body, status, first):
    r = one(ingest.ingest_bubbles(spark.createDataFrame([(1, body)], "page_id long, body string")))
    assert r.status == status and (r.bubbles[0].t if r.bubbles else None) == first


def test_repeat_cap_and_live(spark):
    df = spark.createDataFrame([(1, i, " hi " if i % 2 else "hi", None, i == 9) for i in range(6)] + [(2, 0, "", "x", False), (2, 1, " ", None, False)], "page_id long, idx int, t string, translated string, deleted boolean")
    assert [r.idx for r in ingest.cap_repeats(df.where("page_id = 1")).orderBy("idx").collect()] == [0, 1, 2]
    assert ingest.live_bubbles(df).where("page_id = 2").count() == 1


def test_detector_boxes(spark):
    raw = spark.createDataFrame([(1, 1, 50.0, 50.0, 20.0, 20.0, 0.9, [0.9]), (1, 2, 50.0, 50.0, 20.0, 20.0, 0.8, [0.9]), (1, 3, 5.0, 5.0, 2.0, 2.0, 0.1, [0.9])], "page_id long, det_id int, cx double, cy double, w double, h double, obj double, cls array<double>")
    kept = B.greedy_nms(B.detector_candidates(raw)).collect()
    assert len(kept) == 1 and abs(kept[0].conf - 0.81) < 1e-12
    box = spark.createDataFrame([(1, 1, 256.0, 128.0, 512.0, 384.0, 400, 200, 1024)], "page_id long, det_id int, x1 double, y1 double, x2 double, y2 double, page_w int, page_h int, input_size int")
    r = one(B.unletterbox_boxes(box))
    assert (r.x1, r.width, r.height) == (100, 100, 100)


def test_grouping_and_components(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 5.0, 4.0, 10.0, 1, 48, 48), (1, 2, 12.0, 6.0, 10.0, 4.0, 2, 48, 48), (1, 3, 40.0, 40.0, 4.0, 4.0, 1, 48, 48)], "page_id long, box_id int, x double, y double, w double, h double, stroke int, page_w int, page_h int")
    got = {r.region: r.members for r in regions.group_regions(df).collect()}
    assert got == {1: [1, 2], 2: [3]}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 90)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(chain).collect()} == {**dict.fromkeys(range(41), 0), 90: 0}
    assert connected_components(chain.limit(0)).count() == 0


def region(**over):
    base = dict(hits_protected=False, hits_review=False, page_role="comic", page_confidence=0.9, protection_reasons=[], enclosure_score=0.0, backing_uniformity=0.0, rectangular_backing=0.0, artwork_edge_density=0.0, stroke_irregularity=0.0, w=40.0, h=20.0, page_w=100, page_h=100)
    return base | over


@pytest.mark.parametrize(
    ("over", "want"),
    [
        (dict(backing_uniformity=0.819, rectangular_backing=0.819), ("review", "clean", ["low-confidence"])), (dict(backing_uniformity=0.820, rectangular_backing=0.820), ("narration", "clean", [])),
        (dict(artwork_edge_density=0.899, stroke_irregularity=0.899), ("review", "clean", ["low-confidence"])), (dict(artwork_edge_density=0.9, stroke_irregularity=0.9), ("sfx", "preserve", ["sfx-policy"])),
        (dict(w=10.0, h=4.0), ("protected", "preserve", ["low-confidence"])), (dict(hits_protected=True, protection_reasons=["qr", "logo", "qr"]), ("protected", "preserve", ["qr", "logo"])),
        (dict(page_role="credits"), ("protected", "preserve", ["credit-page"])), (dict(enclosure_score=0.72), ("dialogue", "clean", [])), (dict(hits_review=True), ("review", "clean", ["margin-mark"])),
    ],
)
def test_eligibility(spark, over, want):
    schema = "hits_protected boolean, hits_review boolean, page_role string, page_confidence double, protection_reasons array<string>, enclosure_score double, backing_uniformity double, rectangular_backing double, artwork_edge_density double, stroke_irregularity double, w double, h double, page_w int, page_h int"
    r = one(rules.classify_eligibility(spark.createDataFrame([tuple(region(**over).values())], schema)))
    assert (r.text_role, r.action, r.reasons) == want


def test_routes_verdicts_and_attempts(spark):
    f = spark.createDataFrame([(1.0, 0.01, 0.5, 0.2), (30.0, 0.1, 1.0, 0.9), (90.0, 0.3, 7.0, 0.1)], "lab_variance double, edge_density double, entropy double, gradient_coherence double")
    got = rules.route_region(f).collect()
    assert [r.route for r in got] == ["flat", "gradient", "artwork"] and got[0].route_confidence >= 0.8
    s = "action string, outside_changed int, boundary_error double, damage_score double, residual_score double, outside_changed_2 int, boundary_error_2 double, residual_score_2 double"
    v = rules.verdict(spark.createDataFrame([("clean", 1, 0.0, 0.0, 0.0, 0, 0.0, 0.0), ("clean", 0, 0.0, 0.0, 0.4, 0, 0.0, 0.1), ("clean", 0, 0.0, 0.0, 0.5, 0, 0.0, 0.5), ("preserve", 0, 0.0, 0.0, 0.5, 0, 0.0, 0.5)], s)).collect()
    assert [(r.status, r.retry_radius) for r in v] == [("needs_review", None), ("repaired", 2), ("needs_review", 2), ("preserved", None)]
    a = spark.createDataFrame([(429, False, None), (None, True, None), (400, False, None), (503, False, None), (200, False, "SAFETY"), (200, False, None)], "http_status int, transport_error boolean, block_reason string").withColumn("finish_reason", F.lit(None).cast("string"))
    assert [(r.error, r.delay_ms) for r in rules.classify_attempts(a).collect()] == [("QUOTA", 60000), ("TIMEOUT", 5000), ("UPSTREAM", None), ("UPSTREAM", 5000), ("BLOCKED", None), (None, None)]


def test_scores_keys_and_tags(spark):
    df = spark.createDataFrame([("page10.PNG",), ("Page2.png",), ("[English]/01.webp",)], "name string")
    assert [r.name for r in df.orderBy(X.natural_key(F.col("name"))).collect()][1:] == ["Page2.png", "page10.PNG"]
    assert df.where(X.tagged(F.col("name"))).count() == 1
    px = spark.createDataFrame([(1, 1, 0.2)] * 64, "page_id int, region int, prob double")
    assert abs(one(metrics.residual_score(px, spark.createDataFrame([], "page_id int, region int, area int"))).residual - 0.15) < 1e-12


def test_selection_errors(spark):
    empty = spark.createDataFrame([], "path_hash string, content_sha string, scores map<string,double>")
    with pytest.raises(ValueError):
        curate.stratified_select(empty, 8)
    with pytest.raises(ValueError):
        curate.stratified_select(empty, 9)


def test_quota_stops_the_batch(spark):
    rows = [(1, 0, 1, None), (1, 1, 1, "QUOTA"), (1, 1, 2, None), (1, 2, 1, None)]
    out = state.batch_outcomes(spark.createDataFrame(rows, "book_id int, page_index int, attempt int, error string")).orderBy("page_index").collect()
    assert [(r.ok, r.attempted) for r in out] == [(True, True), (True, True), (True, False)]


def test_uploads_scan_and_stores(spark, tmp_path):
    png, jpg = b"\x89PNG\r\n\x1a\n0000", b"\xff\xd8\xff\xe0aaaaaaaa"
    u = spark.createDataFrame([("image/png", 12, bytearray(png)), ("text/html", 12, bytearray(png)), ("image/png", 99, bytearray(png)), ("image/png", 12, bytearray(jpg))], "media_type string, length long, content binary")
    assert [r.reject_status for r in corpus.admit_uploads(u, 50, ["image/png", "image/jpeg"]).collect()] == [None, 415, 413, 415]
    for name in ("B.png", "a.JPG", "c.txt"):
        (tmp_path / name).write_bytes(png)
    assert [r.path.rsplit("/", 1)[1] for r in corpus.scan_corpus(spark, str(tmp_path)).collect()] == ["a.JPG", "B.png"]
    store = str(tmp_path / "store")
    for rows in ([("k1", 1)], [("k1", 2), ("k2", 3)]):
        corpus.store_if_absent(spark, spark.createDataFrame(rows, "key string, v int"), store)
    assert sorted(map(tuple, spark.read.parquet(store).collect())) == [("k1", 1), ("k2", 3)]


def test_streams_match_their_batch_twins(spark, tmp_path):
    rows = [(i % 5, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i)).to_pydatetime(), ["queued", "running", "running", "failed", "succeeded"][i * 7 % 5], f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, status string, value string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def ran(out, mode, name):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert ran(E.job_state_stream(stream()), "update", "s1") == sorted(map(tuple, E.job_state(df).collect()))
    assert ran(E.job_throughput(stream(), "1 hour", delay="10 minutes"), "complete", "s2") == sorted(map(tuple, E.job_throughput(df, "1 hour").collect()))
    assert ran(E.debounce_last(stream().withWatermark("ts", "1 hour"), "10 minutes", "job_id"), "complete", "s3") == sorted(map(tuple, E.debounce_last(df, "10 minutes", "job_id").collect()))
    assert len(ran(E.first_seen(stream(), ["job_id"], "9 hours").select("job_id"), "append", "s4")) == 5


def test_edit_replay(spark):
    ops = [("push", "a"), ("push", "b"), ("undo", None), ("push", "c"), ("redo", None), ("undo", None)]
    log = spark.createDataFrame([(1, 1, i, op, v) for i, (op, v) in enumerate(ops)], "session_id long, page_id long, seq int, op string, value string")
    r = one(E.replay_edits(log))
    assert (r.value, r.depth) == ("a", 2)
    many = spark.createDataFrame([(1, 1, i, "push", str(i)) for i in range(70)], "session_id long, page_id long, seq int, op string, value string")
    assert one(E.replay_edits(many)).depth == 50


def test_lookup_url_finds_names_within_stretches(spark):
    images = [(1, "https://h/x/other.png"), (2, "https://h/thumb_page01.jpg"), (3, "https://h/page01.jpg.webp"), (4, "https://h/a/page02.jpg"), (5, None), (6, "https://h/q?f=page03.jpg&w=2"), (0, "tiny")]
    wanted = [(1, "https://w/page01.jpg?v=1"), (2, "https://h/a/page02.jpg"), (3, "https://w/page03.jpg"), (4, "https://w/a.jpg"), (5, "https://w/page04.jpg"), (6, None), (7, "https://w/page01.jpg")]
    i = spark.createDataFrame(images, "image_id int, url string")
    w = spark.createDataFrame(wanted, "id int, url string")
    assert sorted(map(tuple, state.lookup_url(w, i).collect())) == [(1, 2, 2), (2, 4, 1), (3, 6, 2), (7, 2, 2)]
    named = spark.createDataFrame([(1, "u", "a/page0"), (2, "u", "page")], "id int, url string, name string")
    assert [tuple(r) for r in state.lookup_url(named, i).collect()] == [(1, 4, 2)]


def test_components_within_pages(spark):
    from quirework.graph import components_within

    edges = [(1, 1, 2), (1, 5, 4), (1, 2, 4), (2, 1, 2), (2, 8, 9), (3, 7, 3)]
    got = components_within(spark.createDataFrame(edges, "page_id long, src int, dst int"), "page_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 1), (1, 4, 1), (1, 5, 1), (2, 1, 1), (2, 2, 1), (2, 8, 8), (2, 9, 8), (3, 3, 3), (3, 7, 3)]
    assert components_within(spark.createDataFrame([], "page_id long, src int, dst int"), "page_id").count() == 0


def test_page_stats_of_upright_coloured_pages(spark):
    from quirework.operators import raster

    pixels = [(1, y, x, 100, 200, 100, 0) for y in range(14) for x in range(10)] + [(2, y, x, 0, 0, 0, 0) for y in range(4) for x in range(8)]
    got = {r.page_id: r for r in raster.page_stats(spark.createDataFrame(pixels, "page_id long, y int, x int, v int, r int, g int, b int")).collect()}
    assert abs(got[1].portrait - 0.5) < 1e-9 and got[2].portrait == 0 and got[1].saturation == 1 and got[2].saturation == 0
    assert abs(got[1].channel_spread - (20000 / 3) ** 0.5 / 120) < 1e-9


def test_missing_pixels_count_as_changed(spark):
    from quirework.operators import raster

    a = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 5)], "page_id long, y int, x int, v int")
    none = a.where("false")
    r = raster.raster_diff(a, a.where("x = 0"), a.where("x = 0"), none).collect()[0]
    assert (r.changed, r.outside, r.identical) == (1, 1, False)


def test_zone_coherence_and_ocr_blend(spark):
    from quirework.operators import metrics, raster

    px = spark.createDataFrame([(1, 0, x, 9, 3.0, 4.0 if x else -4.0) for x in range(2)], "page_id long, y int, x int, v int, gx double, gy double")
    zone = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 1.0)], "page_id long, zone_id int, zx double, zy double, zw double, zh double")
    assert abs(raster.zone_texture(px, zone).collect()[0].coherence - 0.6) < 1e-9
    probs = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.4)], "page_id long, region int, prob double")
    strokes = spark.createDataFrame([(1, 1, 9)], "page_id long, region int, area int")
    ocr = spark.createDataFrame([(1, 2, 2.0)], "page_id long, region int, ocr double")
    got = {r.region: round(r.residual, 9) for r in metrics.residual_score(probs, strokes, ocr).collect()}
    assert got == {1: 0.55, 2: 0.475}


def test_selection_takes_the_better_of_one_path(spark):
    from quirework.functions.exprs import CATEGORIES
    from quirework.operators import curate

    scores = lambda **x: {c: x.get(c.replace("-", "_"), 0.1) for c in CATEGORIES}
    top = CATEGORIES[0].replace("-", "_")
    rows = [("p0", "a", scores(**{top: 0.5})), ("p0", "b", scores(**{top: 0.9}))] + [(f"p{i}", f"c{i}", scores()) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "path_hash string, content_sha string, scores map<string,double>")
    got = curate.stratified_select(df, 10).collect()
    assert len(got) == 10 and len({r.path_hash for r in got}) == 10 and ("b", CATEGORIES[0]) in {(r.content_sha, r.category) for r in got}


def test_sources_and_sinks(spark, tmp_path):
    from quirework.operators import ingest
    from quirework.sources import corpus

    (tmp_path / "m.json").write_text('{"pages": [{"path": "a.png", "n": 1}, {"path": "b.png", "n": 2}]}')
    (tmp_path / "l.json").write_text('{"labels": {"x": "reject"}}')
    (tmp_path / "k.json").write_text('{"y": "original_comic"}')
    assert [tuple(r) for r in corpus.read_pages(spark, str(tmp_path / "m.json"), "path:string,n:int").collect()] == [("a.png", 1), ("b.png", 2)]
    assert [tuple(r) for n in "lk" for r in corpus.read_labels(spark, str(tmp_path / f"{n}.json")).collect()] == [("x", "reject"), ("y", "original_comic")]
    pages = spark.range(20).withColumnRenamed("id", "page_id").repartition(4)
    corpus.write_report(pages.selectExpr("count(*) AS n"), pages, str(tmp_path / "r"))
    assert spark.read.json(f"{tmp_path}/r/summary").first().n == 20 and spark.read.json(f"{tmp_path}/r/pages").count() == 20
    rules = {"name": ingest.required_string("name"), "score": ingest.finite_within("score", 0, 1), "sha": ingest.hex_digits("sha", 4)}
    rows = spark.createDataFrame([("a", 0.5, "00ff"), (" ", float("nan"), "XY"), (None, 2.0, None)], "name string, score double, sha string")
    valid, bad = ingest.split_valid(rows, rules)
    assert valid.count() == 1 and [r.violations for r in bad.collect()] == [["name", "score", "sha"]] * 2


def test_streams_of_durations_and_invalidation(spark, tmp_path):
    import datetime as dt
    import random

    from quirework.streaming import events as E

    rnd = random.Random(3)
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)

    def ran(make, name, mode, **parts):
        """Runs over the files of each table, one a micro-batch; rows in the order of the micro-batches."""
        streams, out = {}, []
        for table, (schema, batches) in parts.items():
            for i, rows in enumerate(batches):
                # Files are read in the order of their times.
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-{table}/{i}")
                for f in (tmp_path / f"{name}-{table}" / str(i)).glob("*.parquet"):
                    os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
            streams[table] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}-{table}")
        df = make(**streams)
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return out

    # Events come up to 40 seconds late; the last one of all lets the watermark pass the others.
    events = sorted(((i % 4, i, at(10 * i), f"s{i % 3}") for i in range(40)), key=lambda e: e[1] + rnd.randrange(4))
    schema = "job_id long, event_id long, ts timestamp, stage string"
    end = (9, 99, at(9000), "end")
    batch = {tuple(r) for r in E.stage_durations(spark.createDataFrame([*events, end], schema)).collect()}
    got = ran(lambda e: E.stage_durations_stream(e, delay="1 minute"), "durations", "append", e=(schema, [events[:15], events[15:30], events[30:], [end]]))
    assert len(got) == len(batch) == 36 and set(map(tuple, got)) == batch
    short = ran(lambda e: E.stage_durations_stream(e, 1000, "1 minute"), "short", "append", e=(schema, [[(1, 1, at(0), "a")], [end], [(9, 98, at(9001), "end")], [(1, 2, at(9002), "b")], [(9, 100, at(19_000), "end")]]))
    assert [(r.job_id, r.event_id) for r in short] == [(9, 99)]  # job 1 had expired

    derived = [(i % 3, i, at(i)) for i in range(30)]
    recleans = [(0, at(7)), (1, at(16)), (0, at(21))]
    d, r = "page_id long, event_id long, ts timestamp", "page_id long, ts timestamp"
    want = {x.event_id: x.valid for x in E.invalidate_derived(spark.createDataFrame(derived, d), spark.createDataFrame(recleans, r)).collect()}
    got = ran(E.invalidate_derived_stream, "derived", "update", derived=(d, [derived[:12], derived[12:]]), recleans=(r, [recleans[:1], recleans[1:]]))
    assert {x.event_id: x.valid for x in got} == want and len(got) > len(want)


def test_summary_of_patches_protected_pages_and_reviews(spark):
    pages = spark.createDataFrame([(1, 4, 10, 100, 1, 2, True, 0.5, 0.5, 9.5), (2, 2, 4, 300, 0, 0, None, 1.0, 0.5, 7.0)], "page_id int, eligible_count long, region_count long, total_ms int, changed_outside long, changed_protected long, identical boolean, residual_pass_rate double, automatic_pass_rate double, peak_rss_mb double")
    pages = pages.withColumns({c: F.lit(0) for c in ("needs_review_count", "unexpected_count", "preserved_sfx_count")})
    patch = lambda *x: spark.createDataFrame([(v,) for v in x], "failed boolean")
    other = spark.createDataFrame([(3,), (4,)], "changed_protected long")
    r = one(metrics.corpus_summary(pages, patch(False, True), other, spark.createDataFrame([(True,)], "passed boolean")))
    assert (r.median_total_ms, r.peak_rss_mb, r.patches_pass, r.visual_pass, r.changed_outside, r.changed_protected, r.residual_pass_rate) == (200, 9.5, False, True, 1, 9, 4 / 6)
    r = one(metrics.corpus_summary(pages, patch(), other.limit(0)))
    assert r.patches_pass and r.changed_protected == 2 and "visual_pass" not in r


def test_slots_take_other_steps_and_vectorised_scorers(spark):
    from quirework.plans.page import run_pipeline

    @F.pandas_udf("double")
    def score(area: pd.Series) -> pd.Series:
        return 1 / area

    regions = spark.createDataFrame([(1, 2.0, "none"), (1, 10.0, "none"), (2, 10.0, "none"), (3, 10.0, "none")], "page_id int, area double, page_role string").withColumn("hits_protected", F.lit(False))
    pages = spark.createDataFrame([(1, "comic"), (2, "credits")], "page_id int, kind string")
    classify = lambda p: p.withColumns({"role": F.col("kind"), "confidence": F.lit(1.0)})
    eligibility = lambda d: d.withColumns({"action": F.when(F.col("page_role") == "comic", "clean").otherwise("preserve"), "text_role": F.lit("dialogue"), "reasons": F.array(F.lit("x"))})
    verdict = lambda d: d.withColumn("residual_score", score("area")).withColumn("status", F.when(F.col("residual_score") < 0.2, "repaired").otherwise("needs_review"))
    out = run_pipeline(regions, pages, classify=classify, eligibility=eligibility, route=lambda d: d.withColumn("route", F.lit("flat")), verdict=verdict)
    assert {r.page_id: (r.region_count, r.eligible_count, r.repaired_count, r.residual_pass_count) for r in out.collect()} == {1: (2, 2, 1, 1), 2: (1, 0, 0, 0), 3: (1, 0, 0, 0)}


def test_image_types(spark):
    names = spark.createDataFrame([("a.PNG",), ("b.x.webp",), ("c.gif",), ("d.jpg",), ("e",), ("f.bmp",)], "name string")
    assert [r[0] for r in names.select(X.image_type(F.col("name"))).collect()] == ["image/png", "image/webp", "image/gif", "image/jpeg", "image/jpeg", "image/jpeg"]
