"""LM scoring by subword lattice likelihood (operator 4).

The model is a unigram over the pieces of an existing vocabulary. A text is its words, each opened by the vocabulary's
word mark, and one end; its probability is the sum, over all ways to cut the words into pieces, of the product of piece
probabilities. A word's part is a forward recursion in log space over its characters; words are independent,
so a document's log probability is the sum over its words and the end. Piece probabilities come from the training
documents: the vocabulary's own segmentation of each training word is counted, with one added for each piece, byte
pieces included, so every text has a probability. A character outside the vocabulary is spelt by its byte pieces.

The corpus is gathered as word counts: documents fall into blocks of bounded size, and each block lists its distinct
words once. Words are counted and scored in one table, and each block gets back the rows of its own words. Nothing that
grows with the corpus goes through the driver or a broadcast (the piece table is as large as the vocabulary).

Null text counts as empty (the end alone); very long texts are scored whole; repeated rows each give a row; an empty table
gives an empty one; other columns, whatever their names, don't matter. Without training documents N and V are 0 and every piece is equally likely.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import keep
from .text import bounded, map_rows, words

#: Characters of text in a block, about, its most rows, and its distinct words, about (a document's words stay together).
BLOCK_CHARS, BLOCK_ROWS, BLOCK_WORDS = 32_000_000, 20_000, 1_000_000
FOLDS, HELD_OUT = 7, 2
MARK = "▁"
LN10 = math.log(10)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """All segmentations of a word, weighted by piece probabilities (natural logs by id)."""

    def __init__(self, model, logs: list[float]):
        n = model.get_piece_size()
        self.logs = {model.id_to_piece(i): logs[i] for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): logs[i] for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.logs))
        self.single = {p for p in self.logs if len(p) == 1}

    def log_probability(self, word: str) -> float:
        text = MARK + word
        get, longest, exp = self.logs.get, self.longest, math.exp
        # alpha[i]: log probability of all segmentations of the first i characters.
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            terms = [alpha[start] + p for start in range(max(0, end - longest), end) if (p := get(text[start:end])) is not None]
            if text[end - 1] not in self.single:
                terms.append(alpha[end - 1] + sum(self.bytes[b] for b in text[end - 1].encode("utf-8", "surrogatepass")))
            top = max(terms)
            alpha.append(top + math.log(sum([exp(t - top) for t in terms])))
        return alpha[-1]


def gathered(docs: DataFrame) -> DataFrame:
    """One table of two kinds of rows, by block. Documents: (block, doc_id, held, tokens), tokens as places in the block's
    list of words. Words: (block, i, word, n), n of them in training documents of the block. A block is a stretch of
    one input partition, so nothing is shuffled, and texts needn't be read again."""
    schema = "block long, doc_id long, held boolean, tokens binary, i int, word string, n long"
    names = [x.split()[0] for x in schema.split(", ")]
    target = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("tokens", pa.binary()), ("i", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        place: dict[bytes, int] = defaultdict(lambda: len(place))
        train: Counter = Counter()
        chars = rows = 0

        def batch_of(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            columns["block"] = [block] * size
            return pa.RecordBatch.from_arrays([pa.array(columns[x], target.field(x).type) if x in columns else pa.nulls(size, target.field(x).type) for x in names], schema=target)

        def word_rows() -> Iterator[pa.RecordBatch]:
            held = list(place.items())
            for at in range(0, len(held), 20_000):
                part = held[at : at + 20_000]
                yield batch_of(i=[i for _, i in part], word=[w.decode("utf-8", "surrogatepass") for w, _ in part], n=[train[w] for w, _ in part])
            place.clear()
            train.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids, held, coded = part.column(0).to_pylist(), [], []
                for doc_id, text in zip(ids, part.column(1).to_pylist(), strict=True):
                    tokens = words(text, lower=True)
                    held.append(fold(doc_id) == HELD_OUT)
                    coded.append(np.fromiter(map(place.__getitem__, tokens), np.uint32, len(tokens)).tobytes())
                    if not held[-1]:
                        train.update(tokens)
                    chars += len(text or "")
                rows += len(ids)
                yield batch_of(doc_id=ids, held=held, tokens=coded)
                if chars > BLOCK_CHARS or rows > BLOCK_ROWS or len(place) > BLOCK_WORDS:
                    yield from word_rows()
                    block, chars, rows = block + 1, 0, 0
        yield from word_rows()

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def piece_logs(vocabulary: DataFrame, documents: int, model_path: str) -> tuple[list[float], float]:
    """Natural logs of the probability of each piece, by id, and of the end. At most one row per piece reaches the driver."""

    def setup():
        model, counts = load(model_path), Counter()

        def one(word, c):
            for i in model.encode(word):
                counts[i] += c
            return []

        return one, lambda: list(counts.items())

    table = map_rows(vocabulary.where("c > 0"), ["word", "c"], "piece int, n long", setup).groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    model = load(model_path)
    counts = np.zeros(model.get_piece_size())
    counts[table.piece] = table.n
    usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(len(counts))])
    counts[~usable] = 0
    total = math.log(counts.sum() + documents + usable.sum() + 1)
    return (np.log(counts + 1) - total).tolist(), math.log(documents + 1) - total


def score(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word unigram) and score (lattice), both log10."""
    table = keep(gathered(docs), "words")
    coded, listed = table.where(F.col("tokens").isNotNull()).select("block", "doc_id", "held", "tokens"), table.where(F.col("word").isNotNull()).select("block", "i", "word", "n")
    vocabulary = keep(listed.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    documents = coded.where(~F.col("held")).count()
    known = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train_tokens, distinct = known.n + documents, known.v + (documents > 0)
    logs, end_log = piece_logs(vocabulary, documents, model_path)
    floor = math.log10(train_tokens + distinct + 1)
    end_base = math.log10(documents + 1) - floor

    def setup():
        lattice = Lattice(load(model_path), logs)
        return lambda word, c: [(word, math.log10(c + 1) - floor, lattice.log_probability(word) / LN10, c > 0)]

    scored = map_rows(vocabulary, ["word", "c"], "word string, base double, sub double, known boolean", setup)
    asked = listed.select("block", "i", "word").join(scored, "word").select("block", "i", "base", "sub", "known")

    def meet(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        size = int(table["i"].max()) + 1 if len(table) else 0
        base, sub, seen = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        if size:
            base[table["i"]], sub[table["i"]], seen[table["i"]] = table["base"], table["sub"], table["known"]
        out = []
        for doc_id, held, tokens in zip(texts["doc_id"], texts["held"], texts["tokens"], strict=True):
            t = np.frombuffer(tokens, np.uint32)
            out.append((doc_id, held, len(t) + 1, int(seen[t].sum()) + (documents > 0), train_tokens, float(base[t].sum()) + end_base, float(sub[t].sum()) + end_log / LN10))
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).astype({"doc_id": "Int64"})

    coded, asked = coded.withColumn("own", F.col("block") + 0).drop("block"), asked.withColumn("of", F.col("block") + 0).drop("block")
    return coded.groupBy("own").cogroup(asked.groupBy("of")).applyInPandas(meet, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
