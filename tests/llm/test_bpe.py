import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from quirework.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
ENCODING = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "1", "²", "½", "漢", "字", "😀", "'s", "'re", "'", "!!", "한", "́", "İ", "ſ", "​", "...", "ing", "=", "א", "<|endoftext|>"]


def texts():
    rnd = random.Random(1)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(40))) for _ in range(1500)]


def test_encoding_is_that_of_the_merges():
    codec, split = bpe.MergeTransducer(RANKS), bpe.Splitter(public_tokenizers.PATTERN)
    for t in texts():
        assert np.frombuffer(codec.encode_pieces(split(t)), "<u4").tolist() == ENCODING.encode_ordinary(t), t


def test_tables_stay_bounded():
    codec, rnd = bpe.MergeTransducer(RANKS, max_states=40, max_pieces=5), random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice("abcdehilmnoprstu") for _ in range(rnd.randrange(1, 120)))
        assert np.frombuffer(codec.encode_bytes(t.encode()), "<u4").tolist() == ENCODING.encode_ordinary(t)
        assert len(codec.states) <= 41 and len(codec.pieces) <= 5
    long = "ab" * 30_000
    assert np.frombuffer(codec.encode_bytes(long.encode()), "<u4").tolist() == ENCODING.encode_ordinary(long)


def test_streaming_decoder():
    codec, rnd = bpe.shared_codec(PATH), random.Random(3)
    for t in texts()[:200]:
        ids, out, decoder = ENCODING.encode_ordinary(t), [], bpe.StreamDecoder(codec.bytes_of)
        while ids:
            n = rnd.randrange(1, 4)
            out.append(decoder.feed(ids[:n]))
            ids = ids[n:]
        assert "".join(out) + decoder.finish() == t
    for _ in range(2000):
        raw = bytes(rnd.choice([0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rnd.randrange(8)))
        m = bpe.Utf8Machine()
        assert "".join(m.feed(raw[i : i + 1]) for i in range(len(raw))) + m.finish() == raw.decode("utf-8", "replace")


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(60, None), (61, ""), (61, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op10_byte_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][1] or ""
        ids = ENCODING.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.decoded for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()} == {t or "" for _, t in rows}
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
