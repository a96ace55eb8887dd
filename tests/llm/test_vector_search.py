import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirework.llm import vector_search as vs


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (700, 16)).round(2)
    base[100:160] = base[100]  # ties
    rows = [(int(i), [float(x) for x in v], 1) for i, v in enumerate(base)]
    bad = [(1000, None, 1), (1100, [float("nan")] * 16, 1), (1200, [float("inf")] + [0.0] * 15, 1), (1300, [None] + [0.0] * 15, 1), (None, [0.1] * 16, 1), (1400, [1.0, 2.0], 1), (1500, [3.0, 1.0], 1)]
    df = spark.createDataFrame([*rows, *bad, rows[0], rows[7]], "vec_id long, embedding array<double>, score int")
    vs_rows = vs.top_k(df, F.col("vec_id") % 100 == 0).collect()
    ints = np.floor(1024 * base).astype(np.int64)
    want = set()
    for q in range(0, 700, 100):
        s = ints @ ints[q]
        best = sorted((-int(s[i]), i) for i in range(700) if i != q)[:10]
        want |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(best)}
    s = 1024 * 1024 * (3 + 2)
    want |= {(1400, 1, 1500, s), (1500, 1, 1400, s)}
    assert {tuple(r) for r in vs_rows} == want and len(vs_rows) == len(want)
    assert vs.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(500)], "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in vs.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    monkeypatch.setattr(vs, "PART_SIZE", 480)
    monkeypatch.setattr(vs, "BLOCK_SIZE", 88)
    monkeypatch.setattr(vs, "ROW_SIZE", 24)
    monkeypatch.setattr(vs, "LANES", 3)
    monkeypatch.setattr(vs, "AT_ONCE", 2)
    monkeypatch.setattr(vs, "HELD", 50)
    assert {tuple(r) for r in vs.top_k(df, F.col("vec_id") % 10 == 0).collect()} == whole and len(whole) == 500


def test_lanes_leave_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(vs, "PART_SIZE", 3200)
    monkeypatch.setattr(vs, "LANES", 4)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(0, 0.3, 32)]) for i in range(4000)], "vec_id long, embedding array<double>")
    rows = vs.keep(vs.integers(df, "vec_id", "embedding", 1024), "vectors")
    left = vs.candidates(rows, F.col("vec_id") % 100 == 0, 10)
    # 40 parts, but each query keeps what its four lanes leave, and of these what all lanes leave.
    assert 40 * 10 <= left.count() < 40 * 60 and left.agg(F.max("r")).first()[0] < 120


def test_very_long_vectors_and_other_lengths(spark):
    rng = np.random.default_rng(9)
    long = [(int(i), [float(x) for x in rng.normal(0, 0.3, 70_000)]) for i in range(0, 400, 100)]
    short = [(int(i), [float(x) for x in rng.normal(0, 0.3, 3)]) for i in range(1, 40)] + [(500, [0.5, 0.25, 0.125]), (600, [])]
    got = {}
    for r in vs.top_k(spark.createDataFrame(long + short, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 2).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = {i: np.floor(1024 * np.array(v)) for i, v in long + short}
    for q in (0, 100, 200, 300, 500):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:2]
        assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {0, 100, 200, 300, 500}


def test_row_scores():
    a = pa.array([[1.0, 2.0], [2.0**52, 2.0**52], [1e300, 1.0], [3.0, 4.0]])
    b = pa.array([[3.0, 4.0], [3.0, 5.0], [1e10, 1.0], [-1.0, -2.0]])
    assert vs.row_scores(a, b).tolist() == [11, 2**55, 2**63 - 1, -11]
    assert vs.row_scores(a.slice(1), b.slice(1)).tolist() == [2**55, 2**63 - 1, -11]
    assert vs.row_scores(pa.array([[1.0], [1.0, 2.0]]), pa.array([[5.0], [1.0, 3.0]])).tolist() == [5, 7]
    assert vs.row_scores(a.slice(0, 0), b.slice(0, 0)).tolist() == []


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(0, 0.3, 32)]) for i in range(3000)], "vec_id long, embedding array<double>")
    rows = vs.keep(vs.integers(df, "vec_id", "embedding", 1024), "vectors")
    read = vs.scored(rows, F.col("vec_id") % 100 == 0, 10).count()
    assert 300 <= read < 0.05 * 30 * 3000


def test_huge_values_and_shared_ids(spark):
    big = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.001, 2.0]), (4, [1e10, 3.0]), (5, [1e308, 1e308]), (7, [1.0, 1.0]), (7, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in big], "vec_id long, embedding array<double>, h string")
    got = [tuple(r) for r in vs.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    want = []
    q = [int(1024 * x) for x in big[0][1]]
    for i, v in big[1:]:
        if all(abs(1024 * x) < float("inf") for x in v):
            s = sum(a * int(np.floor(1024 * b)) for a, b in zip(q, v))
            want.append((-max(-(2**63), min(2**63 - 1, s)), i))
    assert [(-s, i) for _, _, i, s in got] == sorted(want) and [r[1] for r in got] == list(range(1, len(want) + 1))
