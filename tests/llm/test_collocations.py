import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirework.llm import collocations as co


def expected(rows, least, longest=5, most=2000):
    f, n, words = defaultdict(Counter), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= least}
        best = []
        for p, a in good.items():
            if len(p) < 2:
                continue
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        best.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(best[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    vocabulary = ["the", "of", "An", "an", "é", "É", "ß!", "x:y", "data", "lake", "New", "york", " ", "a b", *(f"w{i}" for i in range(60))]
    fixed = ["new york data lake of", "New York, data. lake", "the the the the the the", "a b c d e", "of\tthe   data"]
    rows = []
    for i in range(400):
        words = [rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 5, 40]))]
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und", "éa"]), rnd.choice([" ", "  ", "\t"]).join(words) + rnd.choice(["", ".", "\n", " ;"])))
    rows += [("en", None), ("en", ""), ("fr", " . , "), (None, None), ("en", "new york data lake of. " * 3000)]
    return rows + rows[:20]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


def test_against_brute_force(spark, rows):
    assert len(expected(rows, 6)) > 40
    assert run(spark, rows, least=6) == expected(rows, 6)


def test_small_summaries_and_buffers_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "BUFFER", 500)
    monkeypatch.setattr(co, "PHRASES", 50)
    monkeypatch.setattr(co, "ROW", 64)
    monkeypatch.setattr(co, "CHUNK", 700)
    assert run(spark, rows, least=20, most=7) == expected(rows, 20, most=7)


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(2)
    keys = np.concatenate([np.repeat(np.arange(1, 30), 40), rng.integers(1000, 1 << 60, 20_000)]).astype(np.uint64)
    rng.shuffle(keys)
    halves = []
    for part in np.array_split(keys, 2):
        s = co.Summary(2 * len(keys) // 40, 40)
        for some in np.array_split(part, 50):
            s.add(*np.unique(some, return_counts=True))
        halves.append(s)
        assert len(s.keys) <= s.capacity == 2 * len(keys) // 40
    merged, other = halves
    merged.add(other.keys, other.counts)
    merged.lost += other.lost
    assert merged.lost > 0 and set(range(1, 30)) <= set(merged.frequent().tolist())
    # Too small a capacity grows rather than losing a key.
    s = co.Summary(3, 40)
    for some in np.array_split(keys, 50):
        s.add(*np.unique(some, return_counts=True))
    assert s.lost < 40 and set(range(1, 30)) <= set(s.frequent().tolist())


def test_words_with_one_key_are_told_apart():
    data = np.frombuffer("Aa bb aa. cc Bb\tbb ; aa".encode(), np.uint8)
    w = co.Words(data, np.array([0, len(data)]))
    assert [w.word(i) for i in range(len(w.starts))] == [b"aa", b"bb", b"aa", b"cc", b"bb", b"bb", b"aa"] and w.at.tolist() == [0, 1, 2, 4, 5, 6, 8] and w.size == 10
    words = [w.word(i) for i in range(7)]
    for keys in (w.keys(np.zeros(1, np.uint64)), np.full(7, 5, np.uint64), np.array([5, 5, 5, 9, 9, 5, 5], np.uint64)):
        tally = co.Tally()
        for lang in (np.zeros(7, int), np.zeros(7, int), np.ones(7, int)):
            number = tally.words(w, keys, lang)
            named = [tally.data[tally.starts[i - 1] : tally.starts[i - 1] + tally.lengths[i - 1]].tobytes() for i in number]
            assert named == words and (tally.lang[number - 1] == lang).all()
        assert len(tally.starts) == 6


def test_planes():
    keys = np.array([1, 2**39 + 7, 2**40 - 1], np.uint64)
    assert co._numbers(co._planes(keys, 5), 5, np.uint64).tolist() == keys.tolist()
    assert co._numbers(co._planes(np.array([1, 70_000], np.int32), 4), 4, np.int32).tolist() == [1, 70_000]


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", None, 0, 40 * big), ("en", "a", 1, 2 * big), ("en", "b", 1, 3 * big), ("en", "a b", 2, big + 7)], "lang string, phrase string, w int, a long")
    assert co.scored(counts).first().score == 1000 * (big + 7) * 40 * big // (6 * big * big)


def test_empty_tables_and_clashing_names(spark):
    schema = "lang string, text string, phrase string, w int, `Lang_` long, h double, `a.b` int"
    assert co.collocations(spark.createDataFrame([], schema)).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None, "x", 1, 2, 0.5, 3)], schema)).collect() == []
    rows = [("en", "Big Data rocks. " * 200, "x", 1, 2, 0.5, 3)]
    got = co.collocations(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "big data rocks", 200, 200, 200, 600, 3000)]
