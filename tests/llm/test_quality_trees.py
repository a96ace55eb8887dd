import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import quality_trees as qt

TEXTS = [
    "", " ", "\n\n", "One.", "Hello World, this is it. Hello World again!\nA second line\n\nA second line", "aaa aaa aaa aaa aaa aaa aaa aaa", "ALL CAPS HERE!! 12 34 a1b #tag x|y",
    "é ü ß 漢字 " * 30, "a\tb\x0bc\x0cd\re", "x" * 5000, "no stop " * 700 + "\n" + "l1\nl1\nl2\n" * 20, "\nend\n", "a b c d e a b c d e f a b c d e", ". . .",
]


def by_hand(text):
    """The statistics of one text by plain loops."""
    raw = text.encode()
    n = len(raw)
    share = lambda k: sum(b in k for b in raw) / n if n else 0
    counts = Counter(raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    w = len(words)
    ratio = lambda a, b: a / b if b else 0
    mean = ratio(sum(map(len, words)), w)
    upper, lower = (sum(b in qt._KINDS[k] for b in raw) for k in ("upper", "lower"))
    pairs, windows = list(zip(words, words[1:])), [tuple(words[i : i + 5]) for i in range(w - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = re.findall(rb"[^\n]*\n|[^\n]+$", raw)
    filled = [x.strip(b"\n") for x in lines if x.split()]
    has = lambda k: sum(any(b in qt._KINDS[k] for b in x) for x in words)
    return [
        math.log1p(n), *(share(k) for k in qt._KINDS.values()), -sum(c / n * math.log2(c / n) for c in counts.values()), ratio(upper, upper + lower), math.log1p(w), mean,
        math.sqrt(max(0, ratio(sum(len(x) ** 2 for x in words), w) - mean**2)), math.log1p(max(map(len, words), default=0)), ratio(len(set(words)), w), ratio(max(Counter(words).values(), default=0), w),
        ratio(len(set(pairs)), len(pairs)), ratio(len(covered), w), ratio(sum(x[0] in qt._KINDS["upper"] for x in words), w), ratio(sum(len(x) > 1 and all(b in qt._KINDS["upper"] for b in x) for x in words), w),
        ratio(has("symbols"), w), ratio(has("digits"), w), ratio(sum(x[-1:] in (b".", b",", b";", b":", b"!", b"?") for x in words), w), w / (raw.count(b".") + 1), math.log1p(len(lines)), ratio(w, len(lines)),
        math.log1p(max(map(len, lines), default=0)), ratio(len(lines) - len(filled), len(lines)), ratio(len(filled) - len(set(filled)), len(filled)),
    ]


def test_statistics_against_plain_loops():
    raw = [t.encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = qt.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.shape == (len(TEXTS), len(qt.NAMES))
    for text, row in zip(TEXTS, got, strict=True):
        for name, a, b in zip(qt.NAMES, row, by_hand(text), strict=True):
            assert a == pytest.approx(b, abs=1e-9), (text[:30], name)
    assert qt.statistics(np.empty(0, np.uint8), np.array([0])).shape == (0, len(qt.NAMES))


def test_trees_against_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    t = qt.fit(x, y, np.ones(600), rounds=25)
    score = t.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.97

    def walk(row):
        out = t.start
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            out += t.value[node]
        return 1 / (1 + math.exp(-out))

    assert np.allclose(score, [walk(r) for r in x])
    assert qt.fit(x, np.ones(600), np.ones(600)).score(x[:2]) == pytest.approx(601 / 602)
    assert qt.fit(np.empty((0, 5)), np.empty(0), np.empty(0)).score(x[:1]) == pytest.approx(0.5)


def corpus(seed=4, n=500):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 40, 300]))]
        good = rnd.random() < 0.7
        if not good:
            kind = rnd.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "$$#" for w in words] if kind == 1 else words[:1] * len(words)
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    rows, labels = corpus()
    texts = dict(rows)
    rows += [(9000, None), (9001, ""), (9002, "Long text here. " * 40_000), (None, rows[0][1])] + [rows[1]] * 2
    folder = str(tmp_path)
    wide = [(i, t, "en", 0.3, 1, b"x") for i, t in rows]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, score double, y int, `w.x` binary").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (3, 0, 1), (3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = qt.op13_quality_trees(spark, folder).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in labels if i != 3}
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(judged) > 100 and sum(p == q for p, q in judged) >= 0.97 * len(judged)
    by = {}
    for r in got:
        by.setdefault(texts.get(r.doc_id, "") if r.doc_id is not None else texts[0], set()).add(r.score)
    assert len(by[texts[1]]) == 1 and len(by[texts[0]]) == 1

    # Labels of held-out rows are never learned from: turning them round changes nothing.
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    d = spark.read.parquet(f"{folder}/documents.parquet")
    mask = ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    a, b = qt.train(d, frame(labels), mask), qt.train(d, frame(turned), mask)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_bounded_sample_is_weighted(spark):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    rows = qt.training_rows(labels, F.lit(True), rows=50).collect()
    assert Counter(r.y for r in rows) == {0: 50, 1: 50}
    assert {r.y: r.w for r in rows} == {0: 4.0, 1: 16.0}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert qt.op13_quality_trees(spark, str(tmp_path)).collect() == []
