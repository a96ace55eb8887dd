"""Event-stream operators. Each takes a batch or a streaming DataFrame where that makes sense. Stateful ones have a batch twin with
the same outcome once the watermark has passed all events; where a stream gives rows before that, its docstring says which."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

TERMINAL = ["succeeded", "failed"]
RANK = {"queued": 0, "running": 1, "succeeded": 2, "failed": 2}


def micros(ts):
    """Microseconds since the epoch of a timestamp, with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def _rank(status):
    out = F.lit(-1)
    for name, r in RANK.items():
        out = F.when(status == name, r).otherwise(out)
    return out


def _expire(state: GroupState, at_ms: int, expire_ms: int) -> None:
    """Let the state go when the watermark is ``expire_ms`` past ``at_ms``."""
    state.setTimeoutTimestamp(max(int(at_ms) + expire_ms, state.getCurrentWatermarkMs() + 1))


def job_state(events: DataFrame) -> DataFrame:
    """Batch: state of each job (job_id, ts, event_id, status). The first terminal event sticks and freezes the elapsed time;
    before one, the furthest status counts, and among equal ones the latest."""
    terminal = F.col("status").isin(*TERMINAL)
    end = F.min(F.when(terminal, F.struct("ts", "event_id", "status")))
    go = F.max(F.when(~terminal, F.struct(_rank(F.col("status")).alias("r"), "ts", "event_id", "status")))
    s = events.groupBy("job_id").agg(F.min("ts").alias("begun"), F.max("ts").alias("seen"), end.alias("end"), go.alias("go"))
    last = F.when(F.col("end").isNotNull(), F.col("end.ts")).otherwise(F.col("seen"))
    return s.select("job_id", F.coalesce("end.status", "go.status").alias("status"), (micros(last) - micros(F.col("begun"))).alias("elapsed_us"), F.col("end").isNotNull().alias("final"))


def job_state_stream(events: DataFrame, expire_ms: int = 86_400_000, delay: str = "1 day") -> DataFrame:
    """Streaming twin: a row for each job and micro-batch that changed it. State is a few numbers a job, dropped when the job had no
    event for ``expire_ms`` by the watermark, which is ``delay`` behind."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, seen, status, rank, at, end = state.get if state.exists else (None, None, None, -1, None, None)
        for batch in batches:
            for ts, event_id, new in zip(batch["ts"].astype("int64") // 1000, batch["event_id"], batch["status"], strict=True):
                begun, seen = ts if begun is None else min(begun, ts), ts if seen is None else max(seen, ts)
                order = (int(ts), int(event_id))
                if new in TERMINAL:
                    if end is None or order < tuple(end[:2]):
                        end, status = [*order], new
                elif end is None and (RANK.get(new, -1), *order) > (rank, *(at or (0, 0))):
                    rank, at, status = RANK.get(new, -1), [*order], new
        state.update((begun, seen, status, rank, at, end))
        _expire(state, seen // 1000, expire_ms)
        last = end[0] if end else seen
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "elapsed_us": [last - begun], "final": [end is not None]})

    return events.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, elapsed_us long, final boolean", "begun long, seen long, status string, rank int, at array<long>, end array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def stage_durations(events: DataFrame) -> DataFrame:
    """Time from each stage event of a job to the next."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    nxt = F.lead("ts").over(w)
    return events.select("job_id", "event_id", "stage", (micros(nxt) - micros(F.col("ts"))).alias("duration_us")).where("duration_us IS NOT NULL")


def watchdog(starts: DataFrame, ends: DataFrame, seconds: int, grace: int | None = None) -> DataFrame:
    """(id, outcome) for each started id, by its earliest start: published if its first completion came within ``seconds``; late if it came
    after (with ``grace``: at most as many seconds after); else missing."""
    begun, first = starts.groupBy("id").agg(F.min("ts").alias("ts")), ends.groupBy("id").agg(F.min("ts").alias("done"))
    until = lambda s: F.col("done") <= F.col("ts") + F.make_dt_interval(secs=F.lit(s))
    late = F.col("done").isNotNull() if grace is None else until(seconds + grace)
    return begun.join(first, "id", "left").select("id", F.when(until(seconds), "published").when(late, "late").otherwise("missing").alias("outcome"))


def watchdog_stream(starts: DataFrame, ends: DataFrame, seconds: int, grace: int = 3600, delay: str = "1 minute") -> DataFrame:
    """Streaming twin: one row for each started id. It is published as soon as a completion in time is there; late once the watermark,
    ``delay`` behind, has passed the time and there is a later one; missing when it has passed ``grace`` seconds more. Further completions
    are quiet. A timer an id, set to the next of these times, wakes it; the last one drops its state, which is four numbers. A
    completion whose start hasn't come waits as long."""
    allowed, most = seconds * 1_000_000, (seconds + grace) * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, done, told = state.get if state.exists else (None, None, False)
        watermark, out = state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            for batch in batches:
                for ts, is_start in zip((batch["ts"].astype("int64") // 1000).tolist(), batch["is_start"], strict=True):
                    if is_start:
                        begun = ts if begun is None else min(begun, ts)
                    else:
                        done = ts if done is None else min(done, ts)
        if begun is not None and not told:
            if done is not None and done <= begun + allowed:
                out, told = ["published"], True
            elif watermark > begun + allowed and done is not None and done <= begun + most:
                out, told = ["late"], True
            elif watermark > begun + most:
                out, told = ["missing"], True
        end = (done if begun is None else begun) + most
        if watermark > end:
            state.remove()
        else:
            state.update((begun, done, told))
            wake = begun + allowed if begun is not None and not told and done is not None and watermark <= begun + allowed else end
            state.setTimeoutTimestamp(max(wake // 1000 + 1, watermark // 1000 + 1))
        yield pd.DataFrame({"id": [key[0]] * len(out), "outcome": out})

    rows = starts.select("id", "ts", F.lit(True).alias("is_start")).unionByName(ends.select("id", "ts", F.lit(False).alias("is_start")))
    return rows.withWatermark("ts", delay).groupBy("id").applyInPandasWithState(step, "id long, outcome string", "begun long, done long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def drop_stale_stream(results: DataFrame, changes: DataFrame | None = None, expire_ms: int = 86_400_000, delay: str = "1 day") -> DataFrame:
    """Streaming twin of ``drop_stale`` with ``changes``: results (page_id, ts, event_id, token) that apply. Results and changes of pages are held until the
    watermark, ``delay`` behind, has passed them and then judged in the order of their times, so neither the order in which they come nor the cut
    into micro-batches matters. The state of a page is its newest token, whether it exists and what is held; it goes when the page
    had neither for ``expire_ms`` by the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, there, seen, *held = state.get if state.exists else (None, True, 0, [], [], [], [])
        held, watermark = list(zip(*held, strict=True)), state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for batch in batches:
                held += zip((batch["ts"].astype("int64") // 1000).tolist(), *(batch[c].tolist() for c in ("event_id", "token", "here")), strict=True)
            seen = max([seen, *(h[0] for h in held)])
        # Changes of a page come before results of the same time.
        held.sort(key=lambda h: (h[0], h[3] < 0, h[1], h[3]))
        ripe, out = [h for h in held if h[0] < watermark], []
        for ts, event_id, token, here in ripe:
            if here >= 0:
                there = here == 1
                continue
            newest = token if newest is None else max(newest, token)
            if there and token == newest:
                out.append((key[0], pd.Timestamp(ts, unit="us"), event_id, token))
        held = held[len(ripe) :]
        if not held and seen + expire_ms * 1000 < watermark:
            state.remove()
        else:
            state.update((newest, there, seen, *(map(list, zip(*held, strict=True)) if held else ([], [], [], []))))
            wake = held[0][0] // 1000 + 1 if held else seen // 1000 + expire_ms + 1
            state.setTimeoutTimestamp(max(wake, watermark // 1000 + 1))
        yield pd.DataFrame(out, columns=["page_id", "ts", "event_id", "token"])

    rows = results.where("token IS NOT NULL").select("page_id", "ts", *(F.col(c).cast("long").alias(c) for c in ("event_id", "token")), F.lit(-1).alias("here"))
    if changes is not None:
        none = F.lit(0).cast("long")
        rows = rows.unionByName(changes.select("page_id", "ts", none.alias("event_id"), none.alias("token"), F.col("exists").cast("int").alias("here")))
    result = T.StructType([rows.schema[c] for c in ("page_id", "ts", "event_id", "token")])
    held = "newest long, there boolean, seen long, ts array<long>, event_id array<long>, token array<long>, here array<int>"
    return rows.withWatermark("ts", delay).groupBy("page_id").applyInPandasWithState(step, result, held, "append", GroupStateTimeout.EventTimeTimeout)


def stage_durations_stream(events: DataFrame, expire_ms: int = 86_400_000, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``stage_durations``: an event's duration comes once the watermark, ``delay`` behind, has passed the next event of its
    job, so late events take their place. The state is a job's events since then, and the last one before; it goes in the first
    micro-batch without events of the job in which the watermark is ``expire_ms`` past it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:
                held += zip((batch["ts"].astype("int64") // 1000).tolist(), batch["event_id"].tolist(), batch["stage"].tolist(), strict=True)
        held.sort(key=lambda e: e[:2])
        ripe = sum(ts // 1000 < watermark for ts, *_ in held[1:])
        out = [(key[0], event_id, stage, after[0] - ts) for (ts, event_id, stage), after in zip(held[:ripe], held[1:], strict=False)]
        held = held[ripe:]
        if len(held) == 1 and held[0][0] // 1000 + expire_ms < watermark:
            state.remove()
        else:
            state.update(tuple(map(list, zip(*held, strict=True))))
            # The next event that becomes ripe, or the end of the last one's time.
            wake = held[1][0] // 1000 + 1 if len(held) > 1 else held[0][0] // 1000 + expire_ms
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "stage", "duration_us"])

    rows = events.select("job_id", "ts", "event_id", "stage")
    return rows.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(step, "job_id long, event_id long, stage string, duration_us long", "ts array<long>, event_id array<long>, stage array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_last(edits: DataFrame, quiet: str, key: str = "key") -> DataFrame:
    """The last value of each burst of a key: bursts end after ``quiet`` without an edit. Works on streams (complete mode)."""
    return edits.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n")).select(key, F.col("w.start").alias("begun"), "value", "n")


def drop_stale(results: DataFrame, pages: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Results that carry the newest token seen so far for their page, of pages that exist: those of ``pages``, and with ``changes`` (page_id,
    ts, exists) those that the last change up to the result's own time left there (a page without one exists)."""
    order = Window.partitionBy("page_id").orderBy("ts", "_late", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumns({"_late": F.lit(1), "_here": F.lit(None).cast("int")})
    if changes is not None:
        moved = changes.select("page_id", "ts", F.lit(0).alias("_late"), F.col("exists").cast("int").alias("_here"))
        rows = rows.unionByName(moved, allowMissingColumns=True)
        # Of several changes at one time, being there wins, as it comes last.
        order = order.orderBy("ts", "_late", "event_id", "_here")
    there = F.coalesce(F.last("_here", ignorenulls=True).over(order), F.lit(1)) == 1
    out = rows.withColumns({"_t": F.max("token").over(order), "_there": there}).where((F.col("_late") == 1) & F.col("_there") & (F.col("token") >= F.col("_t")))
    out = out.drop("_t", "_there", "_late", "_here")
    return out if pages is None else out.join(pages.select("page_id").distinct(), "page_id", "left_semi")


def first_seen(events: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """One event of each key; on a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay or "1 hour").dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def invalidate_derived(derived: DataFrame, recleans: DataFrame) -> DataFrame:
    """``valid``: the derived row is newer than the last re-clean of its page."""
    last = recleans.groupBy("page_id").agg(F.max("ts").alias("_at"))
    return derived.join(last, "page_id", "left").withColumn("valid", F.col("_at").isNull() | (F.col("ts") > F.col("_at"))).drop("_at")


def invalidate_derived_stream(derived: DataFrame, recleans: DataFrame, expire_ms: int = 86_400_000, delay: str = "1 day") -> DataFrame:
    """Streaming twin (page_id, event_id, valid): a row for each derived row when it comes, and one more if a later re-clean of its page
    makes it invalid. The state of a page is its last re-clean and the rows still valid, dropped when the page had neither for
    ``expire_ms`` by the watermark, which is ``delay`` behind."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, ids, times = state.get if state.exists else (None, 0, [], [])
        fresh = []
        for batch in batches:
            for ts, event_id in zip((batch["ts"].astype("int64") // 1000).tolist(), batch["event_id"], strict=True):
                seen = max(seen, ts)
                if pd.isna(event_id):
                    last = ts if last is None else max(last, ts)
                else:
                    fresh.append((int(event_id), ts))
        valid = lambda ts: last is None or ts > last
        gone = [i for i, ts in zip(ids, times, strict=True) if not valid(ts)]
        kept = [(i, ts) for i, ts in [*zip(ids, times, strict=True), *fresh] if valid(ts)]
        state.update((last, seen, [i for i, _ in kept], [ts for _, ts in kept]))
        _expire(state, seen // 1000, expire_ms)
        out = [(i, False) for i in gone] + [(i, valid(ts)) for i, ts in fresh]
        yield pd.DataFrame({"page_id": [key[0]] * len(out), "event_id": [i for i, _ in out], "valid": [v for _, v in out]})

    rows = derived.select("page_id", "ts", F.col("event_id").cast("long").alias("event_id"))
    rows = rows.unionByName(recleans.select("page_id", "ts", F.lit(None).cast("long").alias("event_id")))
    return rows.withWatermark("ts", delay).groupBy("page_id").applyInPandasWithState(step, "page_id long, event_id long, valid boolean", "last long, seen long, ids array<long>, times array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def applied(stack: list, at: int, op: str, value: str | None, depth: int) -> tuple[list, int]:
    """The stack of an edit log and the place in it, after one more entry."""
    if op == "push":
        stack = [*stack[:at], value][-depth:]
        return stack, len(stack)
    if op == "undo":
        return stack, max(0, at - 1)
    return (stack, min(len(stack), at + 1)) if op == "redo" else ([], 0)


def replay_edits_stream(log: DataFrame, depth: int = 50, first: int = 1, most: int = 1000, expire_ms: int = 86_400_000, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``replay_edits`` (session_id, page_id, seq, op, value, ts): a row for each log and micro-batch in which entries of it were
    applied, with ``applied``, the seq up to which they are. Entries are applied in the order of ``seq``, which rises by one from ``first``:
    one that comes early is held until all before it have come, and one that comes again counts once. A gap is given up, and what follows it
    applied, when the watermark, ``delay`` behind, has passed an entry behind it (what is missing can't come any more), or when more
    than ``most`` entries are held: then as far as makes room for them. The state is the log's stack, at most ``depth`` entries, and what is
    held; it goes when the log had no entry for ``expire_ms`` by the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack, at, last, seen, *held = state.get if state.exists else ([], 0, first - 1, 0, [], [], [], [])
        held, watermark = {seq: rest for seq, *rest in zip(*held, strict=True)}, state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for batch in batches:
                for seq, op, value, ts in zip(batch["seq"].tolist(), batch["op"], batch["value"], (batch["ts"].astype("int64") // 1000).tolist(), strict=True):
                    entry = (op, None if pd.isna(value) else value, ts)
                    seen = max(seen, ts)
                    if seq > last and (seq not in held or _before(entry, held[seq])):
                        held[seq] = entry
        order = sorted(held)
        # Up to here gaps are given up.
        passed = max([last, *(seq for seq in order if held[seq][2] < watermark), *order[: max(0, len(order) - most)]])
        begun = last
        for seq in order:
            if seq > passed and seq != last + 1:
                break
            op, value, _ = held.pop(seq)
            stack, at = applied(stack, at, op, value, depth)
            last = seq
        if not held and seen + expire_ms * 1000 < watermark:
            state.remove()
        else:
            left = [(seq, *held[seq]) for seq in sorted(held)]
            state.update((stack, at, last, seen, *(map(list, zip(*left, strict=True)) if left else ([], [], [], []))))
            wake = min(x[3] for x in left) // 1000 + 1 if left else seen // 1000 + expire_ms + 1
            state.setTimeoutTimestamp(max(wake, watermark // 1000 + 1))
        if last > begun:
            yield pd.DataFrame({"session_id": [key[0]], "page_id": [key[1]], "value": [stack[at - 1] if at else None], "depth": [len(stack)], "applied": [last]})

    rows = log.select("session_id", "page_id", F.col("seq").cast("long").alias("seq"), "op", F.col("value").cast("string").alias("value"), "ts")
    held = "stack array<string>, at int, last long, seen long, seq array<long>, op array<string>, value array<string>, ts array<long>"
    return rows.withWatermark("ts", delay).groupBy("session_id", "page_id").applyInPandasWithState(step, "session_id long, page_id long, value string, depth int, applied long", held, "update", GroupStateTimeout.EventTimeTimeout)


def _before(a: tuple, b: tuple) -> bool:
    """Order of two entries with one seq: by op, then value, null first."""
    return (a[0], a[1] is not None, a[1] or "") < (b[0], b[1] is not None, b[1] or "")


def replay_edits(log: DataFrame, depth: int = 50) -> DataFrame:
    """Value that each edit log (session_id, page_id, seq, op, value) ends on: push, undo, redo, clear. A push cuts what could be
    redone; at most ``depth`` entries are kept; of entries with one seq the first by op and value counts. Logs are sorted within partitions and folded row by row, so a task holds one
    log's stack, however long the log."""
    keys = ["session_id", "page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack, at, last, out = None, [], 0, None, []

        def done() -> list[tuple]:
            return [] if key is None else [(*key, stack[at - 1] if at else None, len(stack))]

        for batch in batches:
            for *new, op, value, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if new != key:
                    out += done()
                    key, stack, at, last = new, [], 0, None
                if seq != last:
                    stack, at = applied(stack, at, op, value, depth)
                last = seq
            yield batch_of(out)
            out = []
        yield batch_of(done())

    from pyspark.sql.pandas.types import to_arrow_schema

    rows = log.select(*keys, "op", F.col("value").cast("string").alias("value"), "seq").repartition(*keys).sortWithinPartitions(*keys, "seq", "op", "value")
    result = T.StructType([*(rows.schema[k] for k in keys), T.StructField("value", T.StringType()), T.StructField("depth", T.IntegerType())])
    target = to_arrow_schema(result)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.mapInArrow(run, result)


def job_throughput(events: DataFrame, length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Events and failures per window, tumbling or sliding; with ``delay``, a watermark for late rows."""
    e = events.withWatermark("ts", delay) if delay else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).select(F.col("w.start").alias("begun"), "n", "failed")
