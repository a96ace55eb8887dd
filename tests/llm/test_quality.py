import math
import random
import re
from collections import Counter

import numpy as np

from quirework.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))


def write(spark, path, texts, labels):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")


def test_counts_match_brute_force_and_junk_goes(spark, tmp_path):
    rnd = random.Random(3)
    base = [None, "", " ", "a b c", "x\n\nx\n x\nx", "a b c d e f a b c d e f a b c d e", "#*$ 😀 <é>\n" * 3]
    base += ["".join(rnd.choice(["a ", "b ", "c ", "\n", "\t", "| "]) for _ in range(60)) for _ in range(60)]
    good = [" ".join(rnd.choice(["the", "of", "and", "thing", "other", "some", "more", "less", "many", "few", "house", "tree"]) for _ in range(80)) for _ in range(300)]
    junk = [" ".join(rnd.choice(["THE!!", "OF!!", "AND!!", "| x", "THING###", "SOME!!", "q%%%", "ZZ***"]) for _ in range(80)) for _ in range(300)]
    texts = base + good + junk
    n = len(base)
    labels = [(n + i, 1, 0) for i in range(0, 300, 2)] + [(n + 300 + i, 0, 0) for i in range(0, 300, 2)] + [(n, 1, 0), (None, 1, 0)]
    write(spark, tmp_path, texts, labels)
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)
    assert all(got[n + i].kept or got[n + i].base_failed for i in range(300))
    assert not any(got[n + 300 + i].kept for i in range(300))


def test_no_labels_and_empty(spark, tmp_path):
    write(spark, tmp_path, ["one two three four five six seven eight nine ten eleven", "short", None], [])
    assert {r.doc_id: r.kept for r in quality.op8_quality_rules(spark, str(tmp_path)).collect()} == {0: True, 1: False, 2: False}
    docs = spark.createDataFrame([(1, "short", "s"), (2, " ".join(map(str, range(20))), "s")], "doc_id long, text string, score string")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert [tuple(r)[::2] for r in quality.filter_documents(docs, model).collect()] == [(2, "s")]
    write(spark, tmp_path, [], [])
    assert quality.op8_quality_rules(spark, str(tmp_path)).count() == 0


def test_threshold_ignores_rows_that_the_rules_reject(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    good = [" ".join(prose(80)) for _ in range(400)]
    bad = [" ".join(w if rnd.random() < 0.6 else w + "%%%" for w in prose(80)) for _ in range(400)]
    short = [f"lone{i} word{i}" for i in range(60)]  # labelled good, too short for the rules
    texts = good + bad + short
    labels = [(i, 1, 0) for i in range(0, 400, 2)] + [(i, 0, 0) for i in range(400, 800, 2)] + [(i, 1, 0) for i in range(800, 860)]
    write(spark, tmp_path, texts, labels)
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, str(tmp_path)).collect()}
    # rows without a label: shares of bad caught and good lost
    assert sum(not got[i].kept for i in range(401, 800, 2)) >= 0.98 * 200
    assert sum(not got[i].kept and not got[i].base_failed for i in range(1, 400, 2)) <= 0.02 * 200


def test_threshold_from_scores():
    choose = lambda good, bad: quality.choose_threshold(np.array(good, float), np.ones(len(good)), np.array(bad, float))
    assert choose([], []) == choose([], [1]) == -np.inf
    assert choose([0.0], []) == -quality.MARGIN
    assert choose([0.0, 0.1, 0.2], [-0.06, -0.04]) == -0.02
    assert choose([0.0] * 9 + [-1], [-2, -0.04]) == -0.02
    assert choose([0.0, 0.0], [1.0]) == -quality.MARGIN


def brute_verdicts(texts, roles):
    """(score, kept) by plain loops; n-grams are counted by themselves, not by hash buckets."""
    grams = [[(x,) for x in w] + list(zip(w, w[1:], strict=False)) for w in (WORD.findall(t or "") for t in texts)]
    raw, trusted = Counter(g for x in grams for g in x), Counter(g for i, x in enumerate(grams) if roles.get(i) == "trusted" for g in x)
    n, m = sum(raw.values()), sum(trusted.values())
    whole = {g: (c + 1) / (n + quality.BUCKETS) for g, c in raw.items()}
    ratio = {g: math.log((trusted[g] + quality.PRIOR * p) / (m + quality.PRIOR)) - math.log(p) for g, p in whole.items()}
    scores = [sum(ratio[g] for g in x) / len(x) if x else 0.0 for x in grams]
    failed = [brute(t)[-1] for t in texts]
    held = {r: sorted((scores[i], len(WORD.findall(texts[i]))) for i, x in roles.items() if x == r and not failed[i]) for r in ("held", "bad")}
    weight, lowest = 0, None
    for s, w in held["held"]:
        weight += w
        if weight >= quality.QUANTILE * sum(x for _, x in held["held"]):
            lowest = s
            break
    every = sorted({s for x in held.values() for s, _ in x})
    cuts = [-math.inf, *((a + b) / 2 for a, b in zip(every, every[1:], strict=False))]
    cost = lambda cut: round(sum(s < cut for s, _ in held["held"]) / len(held["held"]) + sum(s >= cut for s, _ in held["bad"]) / len(held["bad"]), 12)
    threshold = max(lowest - quality.MARGIN, min(cuts, key=lambda cut: (cost(cut), cut)))
    return [(s, not f and s >= threshold, abs(s - threshold) < 1e-9) for s, f in zip(scores, failed, strict=True)]


def test_verdicts_match_brute_force(spark, tmp_path):
    rnd = random.Random(41)
    pick = lambda weights: " ".join(rnd.choices(["uno", "dos", "tres", "four%", "FIVE"], weights, k=rnd.randrange(6, 50)))
    texts = [pick([5, 4, 3, 1, 1]) for _ in range(150)] + [pick([2, 2, 3, 3, 3]) for _ in range(150)] + [None, "", "\n \t"]
    labels = [(i, int(i < 150), 0) for i in range(0, 300, 2)] + [(4, 0, 0), (6, 1, 1), (10_000, 1, 0)]
    write(spark, tmp_path, texts, labels)
    roles = {r.doc_id: r.role for r in quality.labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() if r.doc_id < 300}
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, str(tmp_path)).collect()}
    want = brute_verdicts(texts, roles)
    assert np.allclose([got[i].score for i in range(len(texts))], [s for s, *_ in want], atol=1e-9)
    assert all(got[i].kept == kept for i, (_, kept, edge) in enumerate(want) if not edge)
    decided = [kept for t, (_, kept, _) in zip(texts, want, strict=True) if not brute(t)[-1]]
    assert 0 < sum(decided) < len(decided)


def test_every_labelled_row_counts(spark):
    labels = spark.range(100_000).selectExpr("id AS doc_id", "CAST(id % 4 <> 0 AS INT) AS quality", "CAST(id % 40 = 1 AS INT) AS toxic")
    got = {r.role: r["count"] for r in quality.labelled(labels).groupBy("role").count().collect()}
    assert got["bad"] == 25_000 and got["trusted"] + got["held"] == 72_500 and abs(got["trusted"] - got["held"]) < 2_000


def test_threshold_of_tables_is_that_of_arrays(spark):
    rnd = random.Random(12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, small as the tables are
    try:
        for k in (4, 10**9):  # many and few equal scores
            rows = [(i % 3 == 0, rnd.randrange(10, 900), math.floor(rnd.gauss(-0.4 if i % 3 == 0 else 0.3, 0.3) * k) / k) for i in range(3000)]
            for some in (rows, [r for r in rows if not r[0]], [r for r in rows if r[0]]):
                arrays = [np.array([r[j] for r in some if r[0] == bad], float) for bad, j in ((False, 2), (False, 1), (True, 2))]
                assert quality.threshold(spark.createDataFrame(some, "bad boolean, n long, score double")) == quality.choose_threshold(*arrays)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
