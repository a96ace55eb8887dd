import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline



def make(spark, path):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    good = [prose(80) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100 + i, good[i]) for i in range(10)]  # copies
    rows += [(200 + i, good[20 + i].rsplit(" ", 2)[0]) for i in range(10)]  # near copies
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(40)]  # junk
    rows += [(400, "too short"), (401, None), (402, ""), (403, prose(9000)), (404, prose(50) + " mail bob.x@mail.example.com now " + prose(20)), (None, prose(40))]
    docs = spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(300 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return dict(rows), docs


def test_stages_take_effect(spark, tmp_path):
    texts, docs = make(spark, tmp_path)
    held = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
        held.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(held)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "packing"]
    assert all(df.columns == docs.columns for df in seen[:3])
    after = [{r.doc_id for r in df.collect()} for df in seen]
    assert {*range(60), *range(100, 110), *range(200, 210), 403, 404, None} == after[0]
    assert after[1] == after[0] - {*range(100, 110), *range(200, 210)}
    kept = {r.doc_id: r for r in seen[2].collect()}
    assert set(kept) == after[1] and "<EMAIL>" in kept[404].text and "bob.x" not in kept[404].text
    assert all(r.text == texts[i] for i, r in kept.items() if i != 404) and kept[404].n_chars == len(kept[404].text)
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {}
    for r in seen[3].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(full.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in kept.items()}
    direct = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(str, direct.collect())) == sorted(map(str, seen[3].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    _, docs = make(spark, tmp_path)
    extra = {"Place": "P", "MAYBE": "M", "a.b": "dot", "key": "k", "row": "r", "found": "f", "we`ird": "w"}
    wide = docs
    for name, value in extra.items():
        wide = wide.withColumn(name, F.concat(F.lit(value), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")))
    wide.write.parquet(f"{tmp_path}/wide/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/wide/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/wide/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, f"{tmp_path}/wide")
        assert held.columns == wide.columns
        rows = held.collect()
        assert rows and all(tuple(r)[5:] == tuple(f"{v}{-1 if r.doc_id is None else r.doc_id}" for v in extra.values()) for r in rows)
        held = spark.createDataFrame(rows, wide.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, held, f"{tmp_path}/wide").count() > 60


def test_repeats_ties_and_very_long_texts(spark, tmp_path):
    texts, docs = make(spark, tmp_path)
    rows = [(1, texts[1]), (1, texts[1]), (1, texts[2]), (2, texts[1]), (None, texts[1]), (500, texts[403] * 12), (501, texts[403] * 12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    kept = corpus_pipeline.near_dedup_stage(spark, more, str(tmp_path))
    # One row of each text: of the smallest id that has one; near copies of any length are one group.
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, texts[1]), (1, texts[2]), (500, texts[403] * 12)])
    assert corpus_pipeline.pii_stage(spark, more, str(tmp_path)).count() == len(rows)
    packed = corpus_pipeline.packing_stage(spark, more, str(tmp_path)).where("doc_id = 500").collect()
    assert len(packed) > 20 and sorted(r.piece for r in packed) == list(range(len(packed)))


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
