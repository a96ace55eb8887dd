"""Streams with timers and buffers against their batch twins, on shuffled micro-batches."""

import datetime as dt
import os
import random

import pytest

from quirework.streaming import events as E


def at(s):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def ran(spark, tmp_path):
    def run(make, name, mode, **parts):
        """Runs over the batches of each table, one a micro-batch: (rows in the order of the micro-batches, rows of state that are left)."""
        streams, out = {}, []
        for table, (schema, batches) in parts.items():
            for i, rows in enumerate(batches):
                # Files are read in the order of their times.
                spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-{table}/{i}")
                for f in (tmp_path / f"{name}-{table}" / str(i)).glob("*.parquet"):
                    os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
            streams[table] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}-{table}")
        q = make(**streams).writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        return out, q.lastProgress["stateOperators"][0]["numRowsTotal"]

    return run


def test_watchdog_gives_one_outcome_a_start_and_forgets(spark, ran):
    starts = [(1, at(0)), (2, at(1)), (3, at(2)), (4, at(3)), (5, at(900)), (6, at(4)), (6, at(5)), (7, at(6))]
    # 1 in time and twice more; 2 late, twice; 3 never; 4 after the grace; 5 in time; 6 started twice; 7 first late, then one in time that came after it.
    ends = [(1, at(5)), (1, at(6)), (1, at(200)), (2, at(100)), (2, at(120)), (4, at(2000)), (5, at(901)), (6, at(33)), (7, at(40)), (7, at(20))]
    schema = "id long, ts timestamp"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    batch = {r.id: r.outcome for r in E.watchdog(frame(starts), frame(ends), 30, 600).collect()}
    assert batch == {1: "published", 2: "late", 3: "missing", 4: "missing", 5: "published", 6: "published", 7: "published"}
    far = [(99, at(9000)), (99, at(20_000))]
    cuts = [[ends[0], ends[8]], [ends[1], ends[9], ends[3]], [ends[7], ends[2]], [ends[6], ends[4]], [ends[5]], [(98, at(9000))], [(98, at(20_000))]]
    for name, begun in (("first", [starts[:4] + starts[5:], [], [], [starts[4]], [], [far[0]], [far[1]]]), ("after", [[starts[0]], starts[1:4] + starts[5:], [], [starts[4]], [], [far[0]], [far[1]]])):
        got, left = ran(lambda s, e: E.watchdog_stream(s, e, 30, 600, "1 minute"), f"dogs-{name}", "append", s=(schema, begun), e=(schema, cuts))
        assert sorted((r.id, r.outcome) for r in got if r.id < 90) == sorted(batch.items())
        assert left <= 2  # 98 and 99 alone


@pytest.mark.parametrize("seed", [1, 2])
def test_stale_tokens_in_event_order_with_removed_pages(spark, ran, seed):
    rnd = random.Random(seed)
    results = [(i % 3, at(10 * i), i, i - rnd.choice([0, 0, 4])) for i in range(60)]
    changes = [(0, at(145), False), (1, at(290), False), (1, at(400), True), (0, at(150), True), (0, at(305), False), (2, at(200), False), (2, at(200), True)]
    schema, moved = "page_id long, ts timestamp, event_id long, token long", "page_id long, ts timestamp, exists boolean"
    want = sorted((r.page_id, r.event_id) for r in E.drop_stale(spark.createDataFrame(results, schema), changes=spark.createDataFrame(changes, moved)).collect())
    assert 10 < len(want) < 40 and {p for p, _ in want} == {0, 1, 2}
    # Rows come up to 100 seconds late; removals in other micro-batches than the results around them.
    late = sorted(results, key=lambda r: r[2] + rnd.randrange(10))
    rnd.shuffle(changes)
    end = (9, at(99_999), 99, 1)
    cuts = [late[:7], late[7:30], late[30:31], late[31:], [end]]
    got, left = ran(lambda r, c: E.drop_stale_stream(r, c, expire_ms=60_000, delay="2 hours"), f"tokens{seed}", "append", r=(schema, cuts), c=(moved, [changes[:3], [], changes[3:], [], []]))
    assert sorted((r.page_id, r.event_id) for r in got) == want
    assert left <= 1


def test_stale_tokens_without_changes(spark, ran):
    rows = [(7, at(1), 1, 10), (7, at(2), 2, 9), (7, at(3), 3, 12), (7, at(4), 4, 12), (8, at(1), 5, 1)]
    schema = "page_id long, ts timestamp, event_id long, token long"
    table = spark.createDataFrame(rows, schema)
    batch = E.drop_stale(table, table).select("page_id", "event_id")
    got, _ = ran(lambda r: E.drop_stale_stream(r, delay="1 minute"), "plain", "append", r=(schema, [rows[3:], rows[:3], [(9, at(9000), 6, 1)]]))
    assert sorted((r.page_id, r.event_id) for r in got) == sorted(map(tuple, batch.collect())) == [(7, 1), (7, 3), (7, 4), (8, 5)]


LOG = "session_id long, page_id long, seq int, op string, value string, ts timestamp"


def edits(n, seed):
    rnd = random.Random(seed)
    return [(i % 2, 5, i // 2 + 1, rnd.choice(["push", "push", "push", "undo", "redo", "clear"] if i < 40 else ["push", "push", "undo"]), f"v{i}" if i % 5 else None, at(i)) for i in range(n)]


def final(rows):
    return sorted({r.session_id: tuple(r)[:4] for r in rows}.values())


@pytest.mark.parametrize("seed", [3, 4])
def test_edits_that_cross_micro_batches(spark, ran, seed):
    rnd = random.Random(seed)
    ops = edits(120, seed)
    want = sorted(map(tuple, E.replay_edits(spark.createDataFrame(ops, LOG), 7).collect()))
    late = sorted(ops, key=lambda r: r[2] + rnd.randrange(15))
    again = rnd.sample(ops, 9)  # delivered twice
    got, _ = ran(lambda x: E.replay_edits_stream(x, 7), f"edits{seed}", "update", x=(LOG, [late[:30], late[30:31], late[31:90] + again, late[90:]]))
    assert final(got) == want and max(r.depth for r in got) == 7
    assert [r.applied for r in got if r.session_id == 0] == sorted({r.applied for r in got if r.session_id == 0})
    twice = spark.createDataFrame(ops + again, LOG)
    assert sorted(map(tuple, E.replay_edits(twice, 7).collect())) == want


def test_gaps_are_given_up_by_the_watermark_or_the_bound(spark, ran):
    ops = [(0, 5, s, "push", f"v{s}", at(s)) for s in (1, 2, 4, 5, 7)]  # 3 and 6 never come
    end = (9, 9, 1, "push", "x", at(99_999))
    got, left = ran(lambda x: E.replay_edits_stream(x, expire_ms=1000), "gaps", "update", x=(LOG, [[ops[4], ops[0]], [ops[3], ops[1]], [ops[2]], [end]]))
    mine = [(r.applied, r.value, r.depth) for r in got if r.session_id == 0]
    assert mine == [(1, "v1", 1), (2, "v2", 2), (7, "v7", 5)] and left == 1
    # At most two entries are held.
    got, _ = ran(lambda x: E.replay_edits_stream(x, most=2), "bound", "update", x=(LOG, [[(0, 5, 9, "push", "v9", at(9))], [(0, 5, 8, "push", "v8", at(8))], [(0, 5, 6, "push", "v6", at(6))], [(0, 5, 3, "push", "v3", at(3))]]))
    assert [(r.applied, r.value) for r in got] == [(6, "v6")]
