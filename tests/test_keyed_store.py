"""Keyed stores: latest rows, compaction of touched buckets, failures, streams; and tables that are kept between jobs."""

import os
import random

import pytest
from pyspark.sql import types as T

from quirework import scratch
from quirework.operators.state import latest_by_key
from quirework.sources.keyed_store import KeyedStore

SCHEMA = T.StructType().add("key", "string").add("sub", "integer").add("v", "integer").add("at", "integer").add("deleted", "boolean")


def store(tmp_path, buckets=8):
    return KeyedStore(str(tmp_path / "store"), SCHEMA, ("key", "sub"), ("at", "v"), buckets)


def change(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def parquet_files(spark, s):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(s.path) for n in names if n.endswith(".parquet") and "manifest" not in d for f in [os.path.join(d, n)]}


def test_latest_rows_through_changes_and_compactions(spark, tmp_path):
    rnd, s, all_rows = random.Random(1), store(tmp_path), []
    assert rows(s.get_all(spark)) == [] and s.compact(spark) == []
    for step in range(6):
        new = [(rnd.choice("abcdef"), rnd.choice([1, 2, None]), rnd.randrange(100), 100 * step + i, rnd.random() < 0.2) for i in range(15)]
        all_rows += new
        s.put(change(spark, new))
        if step in (2, 4):
            s.compact(spark)
            s.vacuum(spark)
        want = [r for r in rows(latest_by_key(change(spark, all_rows), ["key", "sub"], ["at", "v"]).select(*SCHEMA.names)) if not r[4]]
        assert rows(s.get_all(spark)) == want
    s.clear(spark)
    assert rows(s.get_all(spark)) == []
    s.put(change(spark, [("z", 1, 1, 1, False)]))
    assert rows(s.get_all(spark)) == [("z", 1, 1, 1, False)]


def test_compaction_rewrites_touched_buckets_and_bounds_reading(spark, tmp_path):
    s = store(tmp_path)
    s.put(change(spark, [(f"k{i}", 1, 0, 0, False) for i in range(200)]))
    assert len(s.compact(spark)) == 8
    s.vacuum(spark)
    before = parquet_files(spark, s)
    for i in range(5):
        s.put(change(spark, [("k7", 1, i, i + 1, False)]))
    touched = s.compact(spark)
    assert len(touched) == 1
    s.vacuum(spark)
    after = parquet_files(spark, s)
    # History has gone: one row a key, and all other buckets' files are the same.
    assert spark.read.option("recursiveFileLookup", True).schema(SCHEMA).parquet(*after).count() == 200
    assert len(set(before) - set(after)) == 1 and all(before[f] == after[f] for f in set(before) & set(after))
    assert rows(s.get(spark.createDataFrame([("k7", 1), ("k8", 1), ("none", 1)], "key string, sub int"))) == [("k7", 1, 4, 5, False), ("k8", 1, 0, 0, False)]


def test_failed_compaction_leaves_the_old_state(spark, tmp_path, monkeypatch):
    s = store(tmp_path)
    s.put(change(spark, [("a", 1, 1, 1, False), ("b", 1, 1, 1, False)]))
    s.put(change(spark, [("a", 1, 2, 2, False)]))
    want = rows(s.get_all(spark))
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.compact(spark)
    # The start of a manifest that was never finished.
    os.makedirs(f"{s.path}/manifest/{s.manifest(spark)[0] + 1}/_temporary/0")
    assert rows(s.get_all(spark)) == want == [("a", 1, 2, 2, False), ("b", 1, 1, 1, False)]
    s.compact(spark)
    s.vacuum(spark)
    assert rows(s.get_all(spark)) == want
    assert sum(f.startswith("base-") for f in os.listdir(s.path)) == 1 and not any(f.startswith("delta-") for f in os.listdir(s.path))


def test_stream_of_changes_counts_once(spark, tmp_path):
    s = store(tmp_path)
    s.put(change(spark, [("k", 1, 0, 0, False), ("i", 1, 0, 0, False)]))
    change(spark, [("k", 1, 1, 1, False), ("k", 1, 2, 2, False), ("j", 1, 3, 1, False)]).write.parquet(f"{tmp_path}/in")
    for i in range(2):  # the second run, without its checkpoint, puts all again
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = s.put_stream(stream, "changes").option("checkpointLocation", f"{tmp_path}/c{i}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {r.key: r.v for r in s.get_all(spark).collect()} == {"k": 2, "j": 3, "i": 0}
    assert len({f for _, f in s.manifest(spark)[1] if "changes" in f}) == len([f for _, f in s.manifest(spark)[1] if "changes" in f])


def test_kept_tables_are_deleted_when_the_result_is_written(spark, tmp_path):
    root = scratch.scratch_root(spark)
    held = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = held()
    with scratch.cleared(spark):
        outer = scratch.keep(spark.range(5), "outer")
        with scratch.cleared(spark):
            inner = scratch.keep(outer.where("id > 1"), "inner")
            assert len(held() - before) == 2
            inner.write.parquet(f"{tmp_path}/out")
        assert len(held() - before) == 1
        assert outer.count() == 5
    assert held() == before and spark.read.parquet(f"{tmp_path}/out").count() == 3
    with pytest.raises(ZeroDivisionError), scratch.cleared(spark):
        scratch.keep(spark.range(5), "failed")
        1 / 0
    assert held() == before
