import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers

from quirework.llm import lm_score as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, pieces):
    if not text:
        return [[]]
    return [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in pieces for rest in segmentations(text[n:], pieces)]


def test_lattice_sums_all_segmentations():
    model = lm.load(PATH)
    logs = [-7 - (i % 11) / 3 for i in range(model.get_piece_size())]
    lattice = lm.Lattice(model, logs)
    for word in ["a", "the", "ther", "tion", "été"]:
        want = sum(math.exp(sum(lattice.logs[p] for p in s)) for s in segmentations(lm.MARK + word, lattice.logs))
        assert math.isclose(lattice.log_probability(word), math.log(want), rel_tol=1e-12)
    odd = "\U0001f9ff" if "\U0001f9ff" not in lattice.logs else "\U00010348"
    want = lattice.logs[lm.MARK] + sum(lattice.bytes[b] for b in odd.encode())
    assert math.isclose(lattice.log_probability(odd), want, rel_tol=1e-12)


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_ROWS", 20)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["The", "of", "thing", "Été", "x1", "漢字", "other\nword", "rare%d" % rnd.randrange(50)]) for _ in range(rnd.randrange(30))) for _ in range(120)]
    texts += [None, "", "  ", texts[0], texts[0], "z" * 3000]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    rows = {r.doc_id: r for r in lm.score(docs, PATH).collect()}
    tokens = {i: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for i, t in enumerate(texts)}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(texts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    model = lm.load(PATH)
    pieces = Counter()
    for w, c in train.items():
        if w != "\n":
            for p in model.encode(w):
                pieces[p] += c
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = sum(pieces[i] for i in usable) + train["\n"] + len(usable) + 1
    lattice = lm.Lattice(model, [math.log((pieces[i] + 1) / total) for i in range(model.get_piece_size())])
    for i, ws in tokens.items():
        want = sum(lattice.log_probability(w) for w in ws[:-1]) + math.log((train["\n"] + 1) / total)
        assert math.isclose(rows[i].score, want / math.log(10), rel_tol=1e-9)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lm.score(docs, PATH).collect()) == [1, 3]
    assert lm.score(docs.limit(0), PATH).count() == 0
