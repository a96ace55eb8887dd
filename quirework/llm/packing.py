"""Best-fit packing of tokenised documents into fixed sequences (operator 2).

Only lengths matter for where a piece goes, and there are at most ``SEQUENCE`` different ones. So the plan is made on
the histogram of lengths: a table of at most ``SEQUENCE`` rows, whatever the corpus. From the longest length down, the
gap that a sequence leaves is looked up among the lengths still available, then among sums of two and of three (exact
complements), which are consumed together as often as their counts allow; what finds no complement takes the longest
piece that fits (best fit), and its new gap is looked up again. The plan is a list of runs: pieces of one length, by
rank, go to consecutive sequences at one offset. Pieces get their rank within a length by salted buckets, so a length
that a third of all rows share is ranked by many tasks.

Null text is an empty document (the end token alone); very long texts are cut into pieces. Every row is packed, repeated rows
too; which of several pieces of one length gets which place is any; an empty table gives an empty one; columns of ``docs``
other than the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep
from .text import map_rows, release

SEQUENCE, END = 4096, 1
#: Words whose ids a worker remembers.
MEMO = 500_000
#: Pieces that are ranked together within a length, about.
RANKED = 2_000


class WordMemo(dict):
    """Ids of words as the tokenizer's model gives them (its pre-tokenizer hands it one word at a time)."""

    def __init__(self, model):
        self.model = model
        # The printable stand-ins for bytes that the byte-level pre-tokenizer uses.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.stand_in = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        seen = word.encode("utf-8").decode("latin-1").translate(self.stand_in)
        ids = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
        if len(self) < MEMO and len(word) <= 48:
            self[word] = ids
        return ids


class WordTokenizer:
    """``ids(text)`` as the tokenizer file gives them. Texts within Latin-1 and without special tokens are cut into words
    here, with the file's pattern, and each word is encoded once; any other text goes to the tokenizer as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        release()  # what parsing the file took
        self.memo = WordMemo(self.full.model)
        # The file's pattern with letters, numbers and white space up to U+00FF.
        letters, numbers, spaces = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        self.other = re.compile("[^\0-\xff]|[\x1c-\x1f]|<\\|").search

    def ids(self, text: str) -> bytes:
        if self.other(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, self.split(text.lower())))


def pieces(docs: DataFrame, tokenizer: Callable[[], Callable[[str], bytes]], sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only those above ``sequence`` are cut."""

    def setup():
        ids, last = tokenizer(), np.array([end], "<u4").tobytes()

        def one(doc_id, text):
            data = ids(text or "") + last
            return [(doc_id, i, at // 4, len(x) // 4, zlib.crc32(x)) for i, at in enumerate(range(0, len(data), 4 * sequence)) for x in [data[at : at + 4 * sequence]]]

        return one

    return map_rows(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", setup)


class Available:
    """Counts by length, with an index of exact complements: for each sum a length that opens a pair, or three, of that sum.
    Counts only fall, so an entry that fails is moved down for good."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self.there = self.counts > 0
        size, lengths = len(counts), np.flatnonzero(self.there)
        self.pairs, self.triples = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for a in lengths:  # the largest comes last and stays
            sums = a + lengths[lengths <= (a if self.counts[a] > 1 else a - 1)]
            self.pairs[sums[sums < size]] = a
        two = np.flatnonzero(self.pairs)
        for a in lengths:
            sums = a + two
            self.triples[sums[sums < size]] = a

    def take(self, lengths: tuple[int, ...], n: int) -> None:
        for x in lengths:
            self.counts[x] -= n
            self.there[x] = self.counts[x] > 0

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def pair(self, gap: int, besides: int = 0) -> tuple[int, int] | None:
        """Two lengths that add up to ``gap``, the larger one as large as possible, while one of ``besides`` is spoken for."""
        a = int(self.pairs[gap])
        while a:
            if self.there[a] and self.there[gap - a] and self.times((a, gap - a)):
                used = [x for x in (a, gap - a, besides) if x]
                if not besides or self.times(tuple(used)):
                    return a, gap - a
            elif a == self.pairs[gap]:
                self.pairs[gap] = -a  # out of use; the next one found takes its place
            half = np.arange(a - 1, (gap - 1) // 2, -1)
            rest = half[self.there[half] & self.there[gap - half]]
            a = int(rest[0]) if len(rest) else 0
            if self.pairs[gap] < 0:
                self.pairs[gap] = a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap``."""
        if self.there[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        while a := int(self.triples[gap]):
            if self.there[a] and (two := self.pair(gap - a, a)):
                return a, *two
            rest = np.arange(a)
            rest = np.flatnonzero(self.there[:a] & (self.pairs[gap - rest] > 0))
            self.triples[gap] = rest[-1] if len(rest) else 0
        return None

    def largest(self, gap: int) -> int:
        found = np.flatnonzero(self.there[: gap + 1])
        return int(found[-1]) if len(found) else 0


def plan(counts: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) for ``counts[length]`` pieces of each length."""
    left, used, runs, sequences = Available(counts), np.zeros(sequence + 1, np.int64), [], 0

    def place(pattern: list[int], n: int) -> None:
        nonlocal sequences
        at = 0
        for x in pattern:
            runs.append((x, int(used[x]), n, sequences, at))
            used[x] += n
            at += x
        sequences += n

    for length in range(sequence, 0, -1):
        while (n := int(left.counts[length])) > 0:
            # Where two of a length fit one sequence, half of them begin sequences that the rest may join.
            if 2 * length <= sequence:
                n = max(1, n // 2)
            left.take((length,), n)
            _fill([length], n, left, sequence, place)
    return runs


def _fill(pattern: list[int], n: int, left: Available, sequence: int, place: Callable[[list[int], int], None]) -> None:
    """Fill ``n`` sequences that hold ``pattern``; each step uses up a length, or the sequences."""
    groups = [(pattern, n)]
    while groups:
        pattern, n = groups.pop()
        gap = sequence - sum(pattern)
        more = (left.exact(gap) or (((x := left.largest(gap)),) if left.largest(gap) else None)) if gap else None
        if not more:
            place(pattern, n)
            continue
        m = min(n, left.times(more))
        left.take(more, m)
        if n > m:
            groups.append((pattern, n - m))
        groups.append((pattern + list(more), m))


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``found`` (pieces with a ``length``, a written table) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    sizes = found.groupBy("length").agg(F.count("*").alias("n"))
    # At most SEQUENCE rows reach the driver.
    table = sizes.toPandas()
    counts = np.zeros(sequence + 1, np.int64)
    counts[table.length.astype(int)] = table.n
    buckets = max(1, int(counts.max()) // RANKED + 1)
    runs = spark.createDataFrame(plan(counts, sequence) or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")
    # By place in the table, so that repeated rows are spread as well; written, as two readings must agree on it.
    salted = found.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    if buckets > 1:
        salted = keep(salted, "buckets")
    order = Window.partitionBy("length").orderBy("bucket")
    before = salted.groupBy("length", "bucket").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(order) - F.col("m")).drop("m")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("before")).drop("r", "before", "bucket")
    # Runs of one length lie in an array sorted by first rank (their number is bounded by the plan's steps); each piece finds its own by halving.
    by_length = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("runs"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("runs") + F.lit(1))).cast("int"))
    ends = F.struct(F.lit(0).alias("lo"), F.size("runs").alias("hi"))  # the last run that doesn't begin behind the rank is in lo..hi - 1
    middle = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")

    def halve(a: Column, _: Column) -> Column:
        beyond = F.get("runs", middle(a))["first"] > F.col("rank")
        return F.when(a["hi"] - a["lo"] <= 1, a).otherwise(F.struct(F.when(beyond, a["lo"]).otherwise(middle(a)).alias("lo"), F.when(beyond, middle(a)).otherwise(a["hi"]).alias("hi")))

    hit = F.get("runs", F.aggregate(steps, ends, halve, lambda a: a["lo"]))
    return (
        ranked.join(F.broadcast(by_length), "length")
        .withColumn("run", hit)
        .withColumn("sequence_id", F.col("run.sequence") + F.col("rank") - F.col("run.first"))
        .withColumn("offset", F.col("run.offset"))
        .drop("run", "runs", "rank")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = keep(pieces(docs, lambda: WordTokenizer(tokenizer_path).ids), "pieces")
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
