"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text (operator 8).

Words and word pairs fall into ``BUCKETS`` hash buckets. All documents fill the raw multinomial; the trusted one
comes from labelled good documents, with ``PRIOR`` n-grams spread as in raw text added. A document's score is the mean over its n-grams of log(trusted / raw), and it
fails below a fixed threshold. All labelled rows count: half of the good ones, by hash, make the trusted multinomial. The other half
and the bad ones, as far as the rules keep them, set the threshold: where the share of good lost and that of bad kept
have the least sum, but not below the good ones' ``QUANTILE``, weighted by length, less ``MARGIN``. Distinct scores are dealt by range, and each range is
searched by itself, from what lies below it. Without good rows the method keeps every document that the rules keep.

Null text counts as empty (no words, so it fails the rules); very long texts are judged whole; repeated rows each give a row;
equal scores are judged alike, and of equally good thresholds the lowest counts; an empty table gives an empty one;
other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bloom
from ..scratch import keep
from .text import WordHashes, bounded, map_rows, ngram_hashes, release, words

BUCKETS = 1 << 16
QUANTILE, MARGIN, PRIOR = 0.001, 0.05, 2000.0
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    threshold: float


def buckets(tokens: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Bucket of each word and of each pair of neighbours."""
    h = hashes.of(tokens)
    return (np.concatenate([ngram_hashes(h, 1), ngram_hashes(h, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, role) of the good and the bad labelled documents: ``trusted`` and ``held`` are good and
    not toxic, ``bad`` are of quality 0. A document with several labels counts by its worst."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = (F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)
    role = F.when(good, F.when(F.xxhash64("doc_id") % 2 == 0, "trusted").otherwise("held")).when(F.col("q") == 0, "bad")
    return one.select("doc_id", role.alias("role")).where("role IS NOT NULL")


def _span(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, n: np.ndarray, before: tuple, totals: tuple) -> tuple:
    """(the good rows' quantile if it lies here, else infinity; cost, cut) for a run of ascending, distinct scores with the good and bad rows at each and the good ones' length.
    ``before`` has the last score, good, bad and length below the run; ``totals`` has good, bad and length of all."""
    least = QUANTILE * totals[2]
    at = int(np.searchsorted(before[3] + np.cumsum(n), least))
    # Rows below a cut fail. The cuts lie halfway between neighbouring scores; of equal ones the lowest counts. The cost is in whole numbers: the sum of shares times all pairs.
    cuts = (np.concatenate([[before[0]], scores[:-1]]) + scores) / 2
    cost = (before[1] + np.cumsum(good) - good) * totals[1] - (before[2] + np.cumsum(bad) - bad) * totals[0]
    best = int(np.argmin(cost))
    return float(scores[at]) if before[3] < least and at < len(scores) else np.inf, int(cost[best]), float(cuts[best])


def _settled(found: list[tuple]) -> float:
    return max(min(q for q, *_ in found) - MARGIN, min(x for _, *x in found)[1])


def choose_threshold(good: np.ndarray, weights: np.ndarray, bad: np.ndarray) -> float:
    """From scores of held good rows, their lengths, and scores of bad rows; all pass the base rules. ``threshold`` does the same on tables."""
    if not len(good):
        return -np.inf
    scores = np.unique(np.concatenate([good, bad]))
    good_at, bad_at = np.searchsorted(scores, good), np.searchsorted(scores, bad)
    per = [np.bincount(good_at, minlength=len(scores)), np.bincount(bad_at, minlength=len(scores)), np.bincount(good_at, weights, len(scores))]
    return _settled([_span(scores, *per, (-np.inf, 0, 0, 0), (len(good), len(bad), per[2].sum()))])


def threshold(scored: DataFrame) -> float:
    """From rows (bad, n, score) that pass the base rules. Each range of scores is one group; the driver gets one row for each."""
    good = ~F.col("bad")
    each = scored.groupBy("score").agg(F.count_if(good).alias("good"), F.count_if("bad").alias("bad"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n"))
    # Written, as two readings must agree on the ranges.
    spans = keep(each.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    sums = spans.groupBy("part").agg(F.max("score").alias("last"), *(F.sum(c).alias(c) for c in ("good", "bad", "n"))).orderBy("part").collect()
    totals = tuple(sum(r[c] for r in sums) for c in ("good", "bad", "n"))
    if not totals[0]:
        return -np.inf
    before, below = {}, (-np.inf, 0, 0, 0)
    for r in sums:
        before[r.part] = below
        below = (r.last, below[1] + r.good, below[2] + r.bad, below[3] + r.n)

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("score")
        found = _span(*(rows[c].to_numpy() for c in ("score", "good", "bad", "n")), before[key[0].as_py()], totals)
        return pa.table({c: [x] for c, x in zip(("quantile", "cost", "cut"), found, strict=True)})

    return _settled([tuple(r) for r in spans.groupBy("part").applyInArrow(search, "quantile double, cost long, cut double").collect()])


def tally(docs: DataFrame) -> np.ndarray:
    """How many n-grams of the texts fall into each bucket. At most BUCKETS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(start, 256).to_pylist():
                    if tokens := words(text):
                        sums += np.bincount(buckets(tokens, hashes), minlength=BUCKETS)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sums[full])], names=["bucket", "n"])
        del hashes, sums
        release()

    table = bounded(docs.select("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[table.bucket] = table.n
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    roles = keep(labelled(labels), "roles")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def of(condition: str) -> DataFrame:
        """Documents with such a role. A filter of fixed size keeps most other texts out of the shuffle."""
        some = roles.where(condition)
        return keyed.where(bloom.passing(keyed, "doc_id", bloom.cells(some, "doc_id"))).join(some, "doc_id")

    trusted = tally(of("role = 'trusted'"))
    if not trusted.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    raw = tally(docs)
    whole = (raw + 1) / (raw.sum() + BUCKETS)
    ratio = np.log((trusted + PRIOR * whole) / (trusted.sum() + PRIOR)) - np.log(whole)

    def setup():
        hashes = WordHashes()

        def score(doc_id: int, text: str | None, role: str) -> list[tuple]:
            tokens = words(text)
            return [] if base_failed(len(tokens), repeated_words(hashes.of(tokens))) else [(doc_id, role == "bad", len(tokens), float(ratio[buckets(tokens, hashes)].mean()))]

        return score

    held = map_rows(of("role IN ('held', 'bad')"), ["doc_id", "text", "role"], "doc_id long, bad boolean, n long, score double", setup)
    # An id that the table holds several times counts once, by its worst row.
    held = held.groupBy("doc_id", "bad").agg(F.min(F.struct("score", "n")).alias("x")).select("bad", "x.n", "x.score")
    return Model(ratio, threshold(held))


def base_failed(n_words: int, repeats: int) -> bool:
    return n_words < 10 or 100 * repeats > 20 * n_words


def repeated_words(h: np.ndarray, width: int = 5) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more."""
    windows = ngram_hashes(h, width)
    if len(windows) < 2:
        return 0
    _, inverse, n = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(h) + 1, np.int64)
    places = np.flatnonzero(n[inverse] > 1)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + width, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def judge(text: str | None, model: Model, hashes: WordHashes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    text = text or ""
    tokens = words(text)
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeats = repeated_words(hashes.of(tokens))
    failed = base_failed(len(tokens), repeats)
    score = float(model.ratio[buckets(tokens, hashes)].mean()) if tokens else 0.0
    return (
        len(tokens),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        score,
        not failed and score >= model.threshold,
    )


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, score and verdict for each document."""

    def setup():
        hashes = WordHashes()
        return lambda key, text: [(key, *judge(text, model, hashes))]

    return map_rows(
        docs, ["doc_id", "text"], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean", setup
    )


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. Python gets the texts alone."""

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            yield pa.array((judge(text.as_py(), model, hashes)[-1] for text in texts), pa.bool_(), size=len(texts))
        del hashes
        release()

    return bounded(docs).where(kept(F.col("text")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
