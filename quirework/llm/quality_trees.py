"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 13).

A text's statistics (``NAMES``) come from its bytes alone: shares of kinds of bytes, words, repeated words, windows and lines. They are taken for
a whole batch of texts at once, in numpy, on the bytes that Arrow holds. Trees are fitted to logistic loss on histograms of ``BINS`` bins a statistic, level by
level, and then flattened into arrays, which every row of a batch descends together.

Fitted are the ``FIT_ROWS`` rows of each label of least hash (a bound on what is fitted, not on what is scored), weighted to stand for all
labelled rows, of those that ``training`` lets in; a document with several labels counts by its worst. With no or only one label to learn from, scores are its smoothed share.

Null text counts as empty, and an empty text is scored like others; very long texts are read whole (about 40 bytes of memory for each of theirs); repeated rows
each give a row; equal statistics give equal scores, a score of 0.5 predicts 1; an empty table gives an empty one; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bounded, mix, ngram_hashes, span_hashes, spans, text_chunks

FIT_ROWS = 20_000
BINS, DEPTH, ROUNDS, RATE = 64, 4, 60, 0.15
RIDGE, LEAST_WEIGHT = 1.0, 2.0
#: Bytes of text whose statistics are taken at once, about.
CHUNK = 1 << 19
_U = np.uint64

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "space": b" \t\x0b\x0c\r", "newline": b"\n", "stops": b".", "commas": b",;:",
    "calls": b"!?", "symbols": b"#*$%&|<>", "quotes": b"\"'`()[]{}", "joins": b"-_/\\=+~^@", "high": bytes(range(128, 256)),
}
_ONE_HOT = np.array([[byte in kind for kind in _KINDS.values()] for byte in range(256)], np.float64)
_IS = {name: _ONE_HOT[:, i] > 0 for i, name in enumerate(_KINDS)}
_SPACE = _IS["space"] | _IS["newline"]
_PUNCTUATION = _IS["stops"] | _IS["commas"] | _IS["calls"]
NAMES = [
    "log_bytes", *(f"share_{k}" for k in _KINDS), "entropy", "upper_of_letters", "log_words", "word_length", "word_spread", "log_longest_word", "distinct_words", "top_word", "distinct_pairs", "repeated_windows",
    "capitalised", "all_capitals", "with_symbol", "with_digit", "ends_in_punctuation", "words_per_stop", "log_lines", "words_per_line", "log_longest_line", "blank_lines", "repeated_lines",
]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _again(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys of each document, count of its commonest, for each key whether it occurs again in it)."""
    _, first, inverse, counts = np.unique(mix(keys ^ mix(of.astype(_U) + _U(1))), return_index=True, return_inverse=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, of[first], counts)
    return np.bincount(of[first], minlength=n), top, counts[inverse] > 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text, the i-th being bytes offsets[i] to offsets[i + 1] of ``data``."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(doc * np.int64(256) + data, minlength=n * 256).reshape(n, 256)
    kinds = counts @ _ONE_HOT
    share = _ratio(counts.ravel(), np.repeat(sizes, 256)).reshape(n, 256)
    entropy = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(axis=1)

    space = _SPACE[data]
    starts, ends = spans(space, offsets)
    lengths, of = ends - starts, doc[starts]
    solid, at = data[~space], np.cumsum(ends - starts) - (ends - starts)
    per = lambda weights: np.bincount(of, weights, minlength=n)
    words = per(None).astype(float)
    mean = _ratio(per(lengths), words)
    spread = np.sqrt(np.maximum(_ratio(per(lengths.astype(float) ** 2), words) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, lengths)
    hashes = span_hashes(solid, at, lengths)
    distinct, top, _ = _again(hashes, of, n)
    inside = lambda k: of[: max(len(of) - k + 1, 0)] == of[k - 1 :]  # noqa: E731  windows of k words within one text
    pairs, windows = inside(2), inside(5)
    pair_of = of[: len(pairs)][pairs]
    distinct_pairs, _, _ = _again(ngram_hashes(hashes, 2)[pairs], pair_of, n)
    _, _, again = _again(ngram_hashes(hashes, 5)[windows], of[: len(windows)][windows], n)
    covered = np.zeros(len(of) + 1, np.int64)
    places = np.flatnonzero(windows)[again]
    covered[places] += 1
    covered[places + 5] -= 1
    covered = np.cumsum(covered)[:-1] > 0
    holding = lambda mask: np.add.reduceat(mask[solid].astype(np.int64), at) if len(at) else np.empty(0, np.int64)

    line_starts = np.union1d(offsets[:-1][sizes > 0], np.flatnonzero(_IS["newline"][data]) + 1)
    line_starts = line_starts[line_starts < len(data)].astype(np.int64)
    line_sizes, line_of = np.diff(np.append(line_starts, len(data))), doc[line_starts]
    lines = np.bincount(line_of, minlength=n).astype(float)
    line_words = np.diff(np.append(np.searchsorted(starts, line_starts), len(starts)))
    long_line = np.zeros(n)
    np.maximum.at(long_line, line_of, line_sizes)
    spoken = line_words > 0
    distinct_lines, _, _ = _again(span_hashes(np.where(_IS["newline"][data], 0, data), line_starts, line_sizes)[spoken], line_of[spoken], n)
    filled = np.bincount(line_of[spoken], minlength=n)

    columns = [
        np.log1p(sizes), *(_ratio(kinds[:, i], sizes) for i in range(len(_KINDS))), entropy, _ratio(kinds[:, 0], kinds[:, 0] + kinds[:, 1]), np.log1p(words), mean, spread, np.log1p(longest),
        _ratio(distinct, words), _ratio(top, words), _ratio(distinct_pairs, np.bincount(pair_of, minlength=n)), _ratio(per(covered), words),
        _ratio(per(_IS["upper"][data[starts]]), words), _ratio(per((holding(_IS["upper"]) == lengths) & (lengths > 1)), words), _ratio(per(holding(_IS["symbols"]) > 0), words),
        _ratio(per(holding(_IS["digits"]) > 0), words), _ratio(per(_PUNCTUATION[data[ends - 1]]), words), _ratio(words, kinds[:, 5] + 1), np.log1p(lines), _ratio(words, lines), np.log1p(long_line),
        _ratio(lines - filled, lines), _ratio(filled - distinct_lines, filled),
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in one set of arrays. A row goes to ``left`` where its statistic is at most the threshold; leaves lead to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Trees for labels ``y`` (0 or 1). Ties between splits go to the first statistic, then the lowest bin."""
    good, bad = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    start = float(np.log((good + 1) / (bad + 1)))
    if not good or not bad:
        rounds = 0
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.empty((0, m), np.int64)
    slot = codes + BINS * np.arange(m)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for array, blank in ((feature, 0), (threshold, np.inf), (value, 0.0)):
            array.append(blank)
        left.append(len(left))
        right.append(len(right))
        return len(left) - 1

    f = np.full(n, start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(node())
        at, level = np.zeros(n, np.int64), [roots[-1]]  # place of each row among the nodes of the level; -1 once it has come to a leaf
        out = np.zeros(n)
        for deep in range(depth + 1):
            live = at >= 0
            some, k = at[live], len(level)
            gain = None
            total_g, total_h = np.bincount(some, g[live], minlength=k), np.bincount(some, h[live], minlength=k)
            if deep < depth:
                places = (some[:, None] * (m * BINS) + slot[live]).ravel()
                hist = lambda w: np.bincount(places, np.repeat(w[live], m), minlength=k * m * BINS).reshape(k, m, BINS).cumsum(axis=2)  # noqa: B023, E731
                gl, hl = hist(g), hist(h)
                gr, hr = total_g[:, None, None] - gl, total_h[:, None, None] - hl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None, None]
                gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = 0
                gain = gain.reshape(k, -1)
            move, below = np.full((k, 2), -1), []
            cut = np.zeros((k, 2), np.int64)
            for i, at_node in enumerate(level):
                best = int(np.argmax(gain[i])) if gain is not None else 0
                if gain is None or gain[i, best] <= 1e-9:
                    value[at_node] = float(-RATE * total_g[i] / (total_h[i] + RIDGE))
                    continue
                j, b = divmod(best, BINS)
                cut[i] = j, b
                feature[at_node], threshold[at_node] = j, float(edges[j][b])
                left[at_node], right[at_node] = node(), node()
                move[i] = len(below), len(below) + 1
                below += [left[at_node], right[at_node]]
            leaves = move[some, 0] < 0
            rows = np.flatnonzero(live)
            out[rows[leaves]] = [value[level[i]] for i in some[leaves]]
            go_right = codes[rows, cut[some, 0]] > cut[some, 1]
            at[rows] = move[some, go_right.astype(int)]
            level = below
            if not level:
                break
        f = f + out
    return Trees(*(np.array(a, t) for a, t in zip((roots, feature, threshold, left, right, value), (int, int, float, int, int, float), strict=True)), start, depth)


def training_rows(labels: DataFrame, training: Column, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y, w): at most ``rows`` labelled documents of each label, with the weight that makes them stand for all."""
    one = labels.where(F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.min("quality").alias("y")).where("y IN (0, 1)").withColumn("h", F.xxhash64("doc_id"))
    # Each label has its own top-n, whose tasks keep ``rows`` rows at most.
    parts = [one.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows).select("doc_id", "y") for y in (0, 1)]
    sizes = one.groupBy("y").agg(F.count("*").alias("all"))
    return parts[0].unionByName(parts[1]).join(F.broadcast(sizes), "y").select("doc_id", "y", (F.greatest("all", F.lit(rows)) / rows).alias("w"))


def train(docs: DataFrame, labels: DataFrame, training: Column, rows: int = FIT_ROWS) -> Trees:
    # At most 2 * FIT_ROWS short rows.
    tagged = docs.select("doc_id", "text").join(F.broadcast(training_rows(labels, training, rows)), "doc_id").select("text", "doc_id", "y", "w")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, *chunk in text_chunks(batch.column(0), CHUNK):
                x = statistics(*chunk)
                part = batch.slice(first, end - first)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), values], names=["doc_id", "y", "w", "x"])

    found = bounded(tagged).mapInArrow(measure, "doc_id long, y int, w double, x array<double>")
    # An id that the table holds several times counts once. At most 2 * FIT_ROWS rows of len(NAMES) numbers reach the driver.
    table = found.groupBy("doc_id").agg(F.min(F.struct("x", "y", "w")).alias("r")).orderBy("doc_id").select("r.*").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, table["y"].to_numpy().astype(float), table["w"].to_numpy().astype(float))


def score_documents(docs: DataFrame, trees: Trees, held_out: Column) -> DataFrame:
    """doc_id, held_out, score (that the label is 1), predicted, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, *chunk in text_chunks(batch.column(2), CHUNK):
                part, score = batch.slice(first, end - first), trees.score(statistics(*chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return bounded(docs.select("doc_id", held_out.alias("held_out"), "text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score_documents(docs, train(docs, labels, ~held_out), held_out)
