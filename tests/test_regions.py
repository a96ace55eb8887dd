"""Regions on the grid of levels against brute force, large pages, pages spread over tasks."""

import math
import random

import numpy as np
import pytest

from quirework.operators import regions as R

SCHEMA = "page_id long, box_id int, x double, y double, w double, h double, stroke int, page_w int, page_h int"


def brute(rows, policy):
    pages = {}
    for r in rows:
        pages.setdefault(r[0], []).append(r)
    out = []
    for p, boxes in pages.items():
        boxes.sort(key=lambda r: r[1])
        hs = sorted(b[5] for b in boxes)
        mid = (hs[(len(hs) - 1) // 2] + hs[len(hs) // 2]) / 2
        pw, ph = min(b[7] for b in boxes), min(b[8] for b in boxes)
        reach = max(1, 1.5 * mid, 0.02 * min(pw, ph))
        parent = list(range(len(boxes)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a in enumerate(boxes):
            for j in range(i + 1, len(boxes)):
                b = boxes[j]
                dx = max(0, max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4]))
                dy = max(0, max(a[3], b[3]) - min(a[3] + a[5], b[3] + b[5]))
                ok = math.hypot(dx, dy) <= reach if policy == "gap" else dx < 0.04 * pw and dy < 0.04 * ph and min(a[5], b[5]) / max(a[5], b[5]) > 0.6
                if ok:
                    ri, rj = root(i), root(j)
                    parent[max(ri, rj)] = min(ri, rj)
        groups = {}
        for i in range(len(boxes)):
            groups.setdefault(root(i), []).append(boxes[i])
        for n, k in enumerate(sorted(groups)):
            g = groups[k]
            x, y = min(b[2] for b in g), min(b[3] for b in g)
            out.append((p, n + 1, x, y, max(b[2] + b[4] for b in g) - x, max(b[3] + b[5] for b in g) - y, max(b[6] for b in g), [b[1] for b in g]))
    return sorted(out)


def sample(seed, pages=30):
    rnd = random.Random(seed)
    rows = []
    for p in range(pages):
        wide, high = rnd.choice([300, 2000]), rnd.choice([400, 3000])
        for i in range(rnd.choice([1, 2, 12, 60])):
            size = rnd.choice([4, 8, 20, 20, 100])
            rows.append((p, 3 * i + rnd.randrange(3), float(rnd.randrange(-20, wide)), float(rnd.randrange(high)), float(rnd.randrange(1, size + 1)), float(rnd.randrange(1, size + 1)), rnd.randrange(5), wide, high))
        if p % 3 == 0:
            rows.append((p, 999, wide / 2, 0.0, 5.0, float(high), 1, wide, high))  # from top to bottom
    return rows


@pytest.mark.parametrize("policy", ["gap", "axis"])
def test_against_brute_force(spark, policy, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 100)
    monkeypatch.setattr(R, "PAIRS", 50)
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, policy)
    assert len({len(r[7]) for r in want}) > 3
    assert sorted(map(tuple, R.group_regions(df, policy).collect())) == want
    assert R.group_regions(df.limit(0), policy).collect() == []


@pytest.mark.parametrize("policy", ["gap", "axis"])
def test_huge_pages_are_spread_and_the_same(spark, policy):
    rows = sample(2, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, R.group_regions(df, policy, huge=10).collect())) == brute(rows, policy)


def test_pairs_stay_few_on_a_large_page_with_a_tall_box():
    rng = np.random.default_rng(3)
    met = {}
    for n in (25_000, 100_000):
        side = math.sqrt(n) * 30
        x, y, size = rng.uniform(0, side, n), rng.uniform(0, side, n), rng.uniform(5, 12, n)
        x[0], y[0], size[0] = side / 2, 0, side
        met[n] = sum(len(a) for a, _ in R.candidate_pairs(np.zeros(n, np.int64), x, y, size, np.array([12.0])))
    assert met[100_000] < 5 * met[25_000] and met[100_000] < 12 * 100_000


def test_a_page_of_many_boxes_in_one_region(spark):
    rows = [(7, i, 3.0 * i, 5.0, 2.0, 2.0, 1, 70_000, 50) for i in range(20_000)] + [(8, 1, 0.0, 0.0, 1.0, 1.0, 1, 50, 50)]
    got = {r.page_id: r for r in R.group_regions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[7].members == list(range(20_000)) and got[7].w == 3.0 * 19_999 + 2 and got[8].members == [1]
