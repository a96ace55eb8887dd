import random

import public_tokenizers
import tiktoken

from quirework.llm import token_counts as tc
from quirework.llm.bpe import Splitter, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})
BITS = ["the", " of", "  ", "\n", "\n\n ", "'s", "'", "re", "'ll", "é", "漢字", "1", "23", "!!", " .", "\t", "x", "😀", " and other", "'l", "l"]


def test_edits_keep_counts_exact():
    rnd = random.Random(7)
    split, count = Splitter(public_tokenizers.PATTERN), tc.CountMemo(ENCODING)
    for trial in range(150):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.choice([0, 3, 40, 700])))
        held = tc.CountedText(text, split, count)
        for _ in range(12):
            start, length = rnd.randrange(len(text) + 3), rnd.choice([0, 0, 1, 5, 60, 2000])
            new = "".join(rnd.choice(BITS) for _ in range(rnd.choice([0, 1, 3, 30, 900 if trial % 10 == 0 else 2])))
            s = min(start, len(text))
            text = text[:s] + new + text[s + length :]
            held.replace(start, length, new)
            assert held.text() == text and len(held) == len(text)
            assert held.n_tokens == len(ENCODING.encode_ordinary(text))
            assert [p for x in held.leaves for p in x] == split(text)


def test_only_the_touched_region_is_encoded():
    split, count = Splitter(public_tokenizers.PATTERN), tc.CountMemo(ENCODING)
    held = tc.CountedText("some words and more of them " * 5000, split, count)
    held.replace(60_000, 4, "other")
    assert held.reencoded < 12


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randrange(300))), "en", "src1") for i in range(50)] + [(50, None, None, None), (51, "", "fr", "s"), (51, "", "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = tc.op5_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        _, t, lang, source = rows[r.doc_id]
        t, n = t or "", len(t or "")
        assert r.n_tokens == len(ENCODING.encode_ordinary(t))
        for at, length, new in ((n // 3, 0, f" {lang or ''} "), (n // 2, 7, ""), (2 * n // 3, 5, source or "")):
            t = t[:at] + new + t[at + length :]
        assert (r.n_tokens_after, r.n_chars_after) == (len(ENCODING.encode_ordinary(t)), len(t)), (r, rows[r.doc_id])


def test_null_edits_and_edits_past_the_end(spark):
    whole, some = "hello there world", [None, (None, None, None), (5, 6, None), None, (1000, 5, "!"), (-3, 2, "J")]
    rows = [(1, whole, some, "x"), (2, whole, None, "x"), (3, None, [(0, 0, "new words")], "x"), (None, "", [], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,length:int,insert:string>>, n_edits string")
    got = {r.doc_id: r for r in tc.edited_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    count = lambda t: (len(ENCODING.encode_ordinary(t)), len(t))
    want = {1: (whole, "Jllo world!", 4), 2: (whole, whole, 0), 3: ("", "new words", 1), None: ("", "", 0)}
    for doc_id, (before, after, n) in want.items():
        r = got[doc_id]
        assert (r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) == (count(before)[0], n, *count(after)), r


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tc.op5_token_counts(spark, str(tmp_path)).count() == 0
