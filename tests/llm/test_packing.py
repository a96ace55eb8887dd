import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quirework.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(8)
    bits = ["the ", "Thing", "é", "É ", "ß", "1", "½", "漢字 ", "😀", "it's ", "!!", "\n", "\x1c", "\x85", "İ", "<|endoftext|>", "of other words and more "]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(400))) for _ in range(300)]
    return [*out, None, "", "word " * 4095, "word " * 4096, "word " * 9000, out[0], out[0], "x" * 30_000]


def test_pieces_and_packing(spark):
    source = texts()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(source)] + [(None, "null id", 5)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, PATH).collect()
    full, got, total = Tokenizer.from_file(PATH), defaultdict(list), 0
    for r in rows:
        got[r.doc_id].append(r)
    for i, t in [*enumerate(source), (None, "null id")]:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        mine = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 4096)))
        for r in mine:
            part = ids[4096 * r.piece : 4096 * (r.piece + 1)]
            assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_plan_places_every_piece_once():
    rnd = np.random.default_rng(1)
    for size, most in ((16, 3), (16, 500), (64, 20), (4096, 2)):
        for _ in range(20):
            counts = rnd.integers(0, most, size + 1)
            counts[0] = 0
            runs = packing.plan(counts, size)
            ranks, bins = defaultdict(list), defaultdict(list)
            for length, first, n, sequence, offset in runs:
                ranks[length] += range(first, first + n)
                for k in range(n):
                    bins[sequence + k].append((offset, length))
            assert all(sorted(ranks[x]) == list(range(counts[x])) for x in range(1, size + 1))
            for items in bins.values():
                at = 0
                for offset, length in sorted(items):
                    assert offset == at
                    at += length
                assert at <= size


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    found = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 4096L, 1 + id % 7) AS length", "id AS ids_crc32")
    rows = packing.pack(found).collect()
    assert len(rows) == 1000 and len({(r.sequence_id, r.offset) for r in rows}) == 1000


def test_exact_complements():
    left = packing.Available(np.bincount([3, 5, 5, 9], minlength=17))
    assert left.exact(9) == (9,) and left.exact(8) == (5, 3) and left.exact(10) == (5, 5) and left.exact(13) == (5, 5, 3) and left.exact(6) is None
