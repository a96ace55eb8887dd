import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.llm import near_dedup as nd


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    common = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    rows = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.3:  # near copies of one text, more and more changed
            w = list(base)
            for _ in range(rnd.randrange(12)):
                w[rnd.randrange(len(w))] = word()
        elif kind < 0.6:  # unrelated texts round one passage
            w = [word() for _ in range(rnd.randrange(20))] + common + [word() for _ in range(rnd.randrange(20))]
        elif kind < 0.8 and rows:
            w = (rnd.choice(rows)[1] or "").split()
            if w and rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rnd.randrange(0, 60))]
        rows.append((len(rows) * 3 + 1, " ".join(w) if w or rnd.random() < 0.5 else None))
    rnd.shuffle(rows)
    return [*rows, (9001, "One two"), (9002, "one TWO"), (9003, "one two three"), (9004, " \n"), (9005, "É x"), (9006, "é x")]


@pytest.mark.parametrize(("seed", "short", "width", "percent"), [(1, 32, 3, 85), (2, 4, 3, 85), (3, 3, 5, 80)])
def test_against_brute_force(spark, monkeypatch, seed, short, width, percent):
    monkeypatch.setattr(nd, "SHORT", short)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: r for r in nd.near_duplicates(docs, width, percent).collect()}
    want = brute(rows, width, percent)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_dropping_and_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(5, a, "x"), (3, a, "y"), (4, a.replace("w50 ", ""), "z"), (None, a, "n"), (None, None, "m"), (7, "other text", "o"), (7, "other text", "o"), (8, None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = nd.drop_near_duplicates(docs, 3, 85)
    assert sorted(r.digest for r in out.collect()) == ["m", "o", "p", "y"] and out.columns == docs.columns
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.drop_near_duplicates(docs.limit(0)).count() == 0


def test_shared_and_missing_ids(spark):
    rnd = random.Random(3)
    text = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    a, b, c = text(), text(), text()
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(1, " ".join(a), "a1"), (1, " ".join(b), "b1"), (2, near(a), "a2"), (3, near(b), "b3"), (None, " ".join(c), "c0"), (None, near(c), "c1"), (9, near(b), "b9"), (None, "alone it stands", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe string").withColumn("place", F.lit("x"))
    out = nd.drop_near_duplicates(docs, 3, 85)
    kept = sorted(r.maybe for r in out.collect())
    assert len(kept) == 4 and [k[0] for k in kept] == ["a", "b", "c", "d"] and kept[:2] == ["a1", "b1"] and out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in nd.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (9, 1)]


def test_many_copies_round_one_text(spark, monkeypatch):
    monkeypatch.setattr(nd, "HUB_PAIRS", 7)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: (k := rnd.randrange(119))], f"x{i}", *base[k + 1 :]])) for i in range(100, 200)] + [(50, " ".join(base))]
    docs = spark.createDataFrame([*rows, *rows[:30]], "doc_id long, text string")
    assert {(r.component_id, r.kept == (r.doc_id == 50)) for r in nd.near_duplicates(docs, 3, 85).collect()} == {(50, True)}
    assert [r.doc_id for r in nd.drop_near_duplicates(docs, 3, 85).collect()] == [50]
