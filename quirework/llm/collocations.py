"""Phrase collocation mining with mergeable Misra-Gries summaries (operator 12).

Phrases of 2 to ``LONGEST`` words that occur at least ``LEAST`` times in their language, scored by how far their words belong together.
Word runs are found level by level, by 64-bit keys that hold the language too. Tasks count the keys of a level and cut the counts by
hash partition: small summaries, a row each, that are merged into one Misra-Gries summary of the partition. Its capacity exceeds the partition's mass divided
by ``LEAST``, so what all its decrements take away stays below ``LEAST`` and every frequent phrase survives (a summary whose partition is
heavier than the mean grows instead of decrementing too far). A run of n words is counted only if both its runs of n - 1 words
survived, by a Bloom filter of fixed size. The texts are encoded once, words that did not survive becoming breaks. A second pass over
the texts counts the survivors exactly, by their words and not their keys, so neither collisions nor false positives show.

Sizes: a task holds ``BUFFER`` keys or a summary of about 2 * ``MASS`` / ``LEAST`` counters; the driver gets the cells of one filter a level and two totals.
Words ``the`` or such are parts of very many phrases: joins by parts are salted.

Words are ``[^\\x20\\x09]+`` within pieces, which end at ``[.,;:!?\\x0A-\\x0D]``; A-Z are lower-cased. Null language is ``und``; null, empty or wordless
text adds nothing; very long texts are read whole (about 60 bytes of memory for each of theirs); repeated rows count as often as they occur; an empty table gives an empty result; ties are
broken as ``collocations`` says; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import keep
from .text import bounded, mix, ngram_hashes, span_hashes, spans, text_chunks

LEAST, LONGEST, MOST = 100, 5, 2000
#: Occurrences of phrases that one hash partition gets, about.
MASS = 20_000_000
#: Keys that a task gathers before it counts them, and distinct phrases before it passes their counts on.
BUFFER, PHRASES = 2_000_000, 500_000
#: Bytes of text that are taken at once, and words in a row of the encoded texts, about.
CHUNK, ROW = 1 << 20, 1 << 15
#: Cells of 64 bits in a level's filter (8 MB).
CELLS = 1 << 20
SALTS = 8
BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.isin(np.arange(256), list(BREAKS))
_OUTSIDE = _BREAK | np.isin(np.arange(256), list(b" \t"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_U = np.uint64


class Words:
    """The words of some texts, in order. ``at`` are their places in a stream that has one more place for each break: between pieces and texts,
    and at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        self.starts, ends = spans(_OUTSIDE[data], offsets)
        self.lengths = ends - self.starts
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)
        apart = (breaks[self.starts[1:]] != breaks[ends[:-1] - 1]) | (self.text[1:] != self.text[:-1])
        self.at = np.arange(len(self.starts)) + np.concatenate([[0], np.cumsum(apart)]) if len(self.starts) else np.empty(0, np.int64)
        self.size = int(self.at[-1]) + 2 if len(self.at) else 1

    def keys(self, salts: np.ndarray) -> np.ndarray:
        """A key for each word, none of them zero; ``salts``, one a text, tells languages apart."""
        solid = self.data[~_OUTSIDE[self.data]]
        at = np.cumsum(self.lengths) - self.lengths
        return mix(span_hashes(solid, at, self.lengths) ^ salts[self.text]) | _U(1)

    def stream(self, values: np.ndarray) -> np.ndarray:
        """Values of the words (0: none) at their places, zero at breaks."""
        out = np.zeros(self.size, values.dtype)
        out[self.at] = values
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


class Salts(dict):
    """A number for each language."""

    def __missing__(self, lang: str) -> int:
        if len(self) > 10_000:
            self.clear()
        self[lang] = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=12)
        return self[lang]

    def of(self, langs: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, langs), _U, len(langs))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    for batch in batches:
        for first, end, data, offsets in text_chunks(batch.column(1), CHUNK):
            yield batch.column(0).slice(first, end - first).to_pylist(), Words(data, offsets)


def runs(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each window of ``n`` words, and whether it has no break."""
    size = max(len(words) - n + 1, 0)
    whole = np.ones(size, bool)
    for i in range(n if size else 0):
        whole &= words[i : i + size] != 0
    return (words if n == 1 else ngram_hashes(words, n)), whole


def reduced(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Keys as the summaries hold them: the hash partition above, 40 bits within it. As partitions are of bounded mass, few of them
    share a key by chance, and those that do only let each other survive."""
    return ((keys & _U((1 << 24) - 1)) % _U(partitions)) << _U(40) | keys >> _U(24)


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of keys."""

    bits: np.ndarray
    partitions: int

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """A key that fails at one place is not looked up at the next."""
        h = mix(reduced(keys, self.partitions))
        found = np.arange(len(keys))
        for shift in _SHIFTS:
            place = (h[found] >> _U(shift)) & _U(CELLS * 64 - 1)
            found = found[(self.bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1]
        out = np.zeros(len(keys), bool)
        out[found] = True
        return out


#: Where the places of a key are taken from its scrambled bits.
_SHIFTS = (0, 19, 38)


def _mark(bits: np.ndarray, reduced_keys: np.ndarray) -> None:
    h = mix(reduced_keys)
    for shift in _SHIFTS:
        place = (h >> _U(shift)) & _U(CELLS * 64 - 1)
        np.bitwise_or.at(bits, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes, then all second ones: sorted numbers shrink well so."""
    return values.view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(planes) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


class Summary:
    """Misra-Gries counters of keys. ``lost`` is what all decrements took from any one counter at most: a key that occurred c times has at
    least c - ``lost``, and ``lost`` never reaches ``least``. Two summaries merge by adding the counters of one to the other."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.lost = capacity, least, 0
        self.keys, self.counts = np.empty(0, _U), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        over = len(self.keys) - self.capacity
        if over <= 0:
            return
        # The largest counter that doesn't fit.
        down = int(np.partition(self.counts, over - 1)[over - 1])
        if self.lost + down >= self.least:
            self.capacity = 2 * len(self.keys)
            return
        self.lost += down
        stay = self.counts > down
        self.keys, self.counts = self.keys[stay], self.counts[stay] - down

    def frequent(self) -> np.ndarray:
        """Keys that may occur ``least`` times: all that do, and few more."""
        return self.keys[self.counts + self.lost >= self.least]


def _counted(parts: Iterator[np.ndarray], partitions: int) -> Iterator[pa.RecordBatch]:
    """(part, keys, counts): the keys of a task, at most BUFFER at a time, counted and cut by hash partition."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(reduced(np.concatenate(held), partitions), return_counts=True)
        counts, cuts = counts.astype(np.int32), np.searchsorted(keys, np.arange(partitions + 1, dtype=_U) << _U(40))
        for i in range(0, partitions, 64):
            full = [j for j in range(i, min(i + 64, partitions)) if cuts[j] < cuts[j + 1]]
            cut = lambda a, width: pa.array([_planes(a[cuts[j] : cuts[j + 1]], width) for j in full], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(keys, 5), cut(counts, 4)], names=["part", "keys", "counts"])

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= BUFFER:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


_COUNTS = "part int, keys binary, counts binary"


def partitions_of(df: DataFrame, mass: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mass // MASS))


def survivors(counts: DataFrame, mass: int, least: int) -> Filter:
    """The filter of the keys whose summaries say that they may occur ``least`` times."""
    partitions = partitions_of(counts, mass)
    capacity = 2 * mass // (partitions * least) + 1024

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, at, held, size, summary = np.zeros(CELLS, _U), None, [], 0, None

        def merge() -> None:
            nonlocal held, size
            if held:
                summary.add(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0

        def close() -> None:
            merge()
            if summary is not None:
                _mark(bits, summary.frequent() | _U(at << 40))

        for batch in batches:
            for part, keys, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    close()
                    at, summary = part, Summary(capacity, least)
                held.append((_numbers(keys, 5, _U), _numbers(some, 4, np.int32).astype(np.int64)))
                size += len(held[-1][0])
                if size >= max(capacity, 1 << 16):
                    merge()
        close()
        # As cells of the filter, which is what the next level reads.
        full = np.flatnonzero(bits)
        for i in range(0, len(full), 1 << 16):
            some = full[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], names=["cell", "b"])

    dealt = counts.repartition(partitions, "part").sortWithinPartitions("part")
    cells = bounded(dealt).mapInArrow(fold, "cell int, b long").groupBy("cell").agg(F.bit_or("b").alias("b"))
    # At most CELLS rows of 12 bytes.
    table, bits = cells.toArrow(), np.zeros(CELLS, _U)
    bits[table["cell"].to_numpy()] = table["b"].to_numpy().view(_U)
    return Filter(bits, partitions)


def filters(docs: DataFrame, least: int, longest: int) -> list[Filter]:
    """For each length from 1 word, a filter that all runs of it that occur ``least`` times in a language pass."""
    size = docs.agg(F.sum(F.octet_length("text") + 1).alias("n")).first().n or 0
    mass = -(-size // 2)  # words, at most
    partitions = partitions_of(docs, mass)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = Salts()
        yield from _counted((w.keys(salts.of(langs)) for langs, w in chunks(batches)), partitions)

    found = [survivors(bounded(docs).mapInArrow(words, _COUNTS), mass, least)]
    common = found[0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = Salts()
        for langs, w in chunks(batches):
            keys = w.keys(salts.of(langs))
            keys[~common.may_hold(keys)] = 0
            stream = w.stream(keys)
            # One break in a row says as much as several.
            yield _rows(stream[(stream != 0) | np.concatenate([[True], stream[:-1] != 0])])

    # Only runs of two words or more are left to find.
    coded = keep(bounded(docs).mapInArrow(encode, "w array<long>"), "encoded") if longest > 1 else None
    for n in range(2, longest + 1):

        def level(batches: Iterator[pa.RecordBatch], n: int = n, below: Filter = found[-1]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[np.ndarray]:
                for batch in batches:
                    w = batch.column(0).flatten().to_numpy().view(_U)
                    keys, ok = runs(w, n)
                    if n > 2:
                        at = np.flatnonzero(ok)
                        inner = below.may_hold(runs(w, n - 1)[0])
                        ok[at] = inner[at] & inner[at + 1]
                    yield keys[ok]

            yield from _counted(each(), partitions)

        found.append(survivors(bounded(coded).mapInArrow(level, _COUNTS), mass, least))
    return found


def _rows(flat: np.ndarray) -> pa.RecordBatch:
    # Rows end behind a break, so long texts give several.
    breaks = np.flatnonzero(flat == 0) + 1
    cuts = sorted({0, len(flat), *breaks[np.searchsorted(breaks, np.arange(ROW, len(flat), ROW))].tolist()})
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts if len(flat) else [0], pa.int32()), pa.array(flat.view(np.int64)))], names=["w"])


class Tally:
    """Exact counts of phrases, as a task gathers them. A word has a number for each language; a longer phrase has one for the pair of its
    numbers, that of the phrase without its last word and that of this word."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.totals = np.zeros(0, np.int64)
        self.keys, self.numbers = np.empty(0, _U), np.empty(0, np.int64)  # sorted keys of words, and the words' numbers
        self.data, self.starts, self.lengths, self.lang = np.empty(0, np.uint8), *(np.empty(0, np.int64) for _ in range(3))
        self.odd: dict[tuple[int, bytes], int] = {}
        self.levels: list[_Level] = []

    def size(self) -> int:
        return len(self.starts) + sum(len(x.codes) for x in self.levels)

    def _enter(self, data: np.ndarray, lengths: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Numbers, from 1, of new words."""
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.data) + np.cumsum(lengths) - lengths])
        self.data, self.lengths, self.lang = (np.concatenate(x) for x in ((self.data, data), (self.lengths, lengths), (self.lang, lang)))
        return np.arange(first, len(self.starts)) + 1

    def words(self, w: Words, keys: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The number of each word. Keys find it; the bytes decide."""
        u, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        new = np.ones(len(u), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != u[at < len(self.keys)]
        i = first[new]
        entered = self._enter(w.data[_places_in(w.starts[i], w.lengths[i])], w.lengths[i], lang[i])
        self.keys, self.numbers = np.insert(self.keys, at[new], u[new]), np.insert(self.numbers, at[new], entered)
        out = self.numbers[np.searchsorted(self.keys, u)][inverse]
        same = (w.lengths == self.lengths[out - 1]) & (lang == self.lang[out - 1])
        ok = np.flatnonzero(same)
        mine, theirs = w.data[_places_in(w.starts[ok], w.lengths[ok])], self.data[_places_in(self.starts[out[ok] - 1], w.lengths[ok])]
        if len(ok) and not np.array_equal(mine, theirs):
            same[ok] = ~np.logical_or.reduceat(mine != theirs, np.cumsum(w.lengths[ok]) - w.lengths[ok])
        for j in np.flatnonzero(~same).tolist():  # another word has the key
            name = (int(lang[j]), w.word(j))
            if name not in self.odd:
                self.odd[name] = int(self._enter(np.frombuffer(name[1], np.uint8), w.lengths[j : j + 1], lang[j : j + 1])[0])
            out[j] = self.odd[name]
        return out

    def add(self, langs: list[str], w: Words, salts: Salts, found: list[Filter]) -> None:
        """The phrases of some texts that pass the filters."""
        lang = np.fromiter((self.langs.setdefault(x, len(self.langs)) for x in langs), np.int64, len(langs))[w.text]
        self.totals = _plus(self.totals, lang)
        keys = w.keys(salts.of(langs))
        often = found[0].may_hold(keys)
        w.starts, w.lengths, w.at, w.text, keys, lang = w.starts[often], w.lengths[often], w.at[often], w.text[often], keys[often], lang[often]
        if not len(keys):
            return
        stream, word = w.stream(keys), w.stream(self.words(w, keys, lang))
        run = word
        for n, common in enumerate(found, 1):
            if n > len(self.levels):
                self.levels.append(_Level())
            key, ok = runs(stream, n)
            at = np.flatnonzero(ok)
            # What a frequent run begins with is frequent too, so it has a number.
            at = at[run[at] > 0]
            at = at[common.may_hold(key[at])]
            if not len(at):
                return  # no longer run can be frequent either
            codes = run[at] if n == 1 else (run[at] << 32) | word[at + n - 1]
            run = np.zeros(len(stream), np.int64)
            run[at] = self.levels[n - 1].add(codes)

    def batches(self, partitions: int) -> Iterator[pa.RecordBatch]:
        """What was counted, by hash partition of the phrase, a row each: part, and lists of lang, phrase, w and a. The number of all words of a language has w = 0 and
        no phrase."""
        names = pa.array(list(self.langs), pa.string())
        n = len(self.totals)
        yield _by_part(np.zeros(n, np.int64), names.slice(0, n), pa.nulls(n, pa.string()), 0, self.totals)
        ends = np.append(self.starts, len(self.data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data)))
        before = words
        for n, level in enumerate(self.levels, 1):
            last = (level.code & 0xFFFFFFFF) - 1
            phrases = words.take(pa.array(last))
            if n > 1:
                phrases = pc.binary_join_element_wise(before.take(pa.array((level.code >> 32) - 1)), phrases, " ")
            before = phrases
            _, offsets, data = phrases.buffers()
            offsets = np.frombuffer(offsets, np.int32)[phrases.offset : phrases.offset + len(phrases) + 1].astype(np.int64)
            hashes = span_hashes(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets))
            yield _by_part((hashes % _U(partitions)).astype(np.int64), names.take(pa.array(self.lang[last])), phrases, n, level.counts)


def _by_part(part: np.ndarray, lang: pa.Array, phrases: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    full, first = np.unique(part[order], return_index=True)
    cuts, at = pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(order)
    lists = [pa.ListArray.from_arrays(cuts, x) for x in (lang.take(at), phrases.take(at), pa.array(np.full(len(order), n, np.int32)), pa.array(counts[order]))]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *lists], names=["part", *_NAMES])


class _Level:
    """Phrases of one length: their codes, sorted, with their numbers; code and count by number."""

    def __init__(self):
        self.codes, self.numbers, self.code, self.counts = (np.empty(0, np.int64) for _ in range(4))

    def add(self, codes: np.ndarray) -> np.ndarray:
        u, inverse, c = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.codes, u)
        new = np.ones(len(u), bool)
        new[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] != u[at < len(self.codes)]
        entered = len(self.code) + 1 + np.arange(int(new.sum()))
        self.codes, self.numbers = np.insert(self.codes, at[new], u[new]), np.insert(self.numbers, at[new], entered)
        self.code, self.counts = np.concatenate([self.code, u[new]]), np.concatenate([self.counts, np.zeros(len(entered), np.int64)])
        out = self.numbers[np.searchsorted(self.codes, u)]
        self.counts[out - 1] += c
        return out[inverse]


def _places_in(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of some spans, one span after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _plus(totals: np.ndarray, places: np.ndarray) -> np.ndarray:
    more = np.bincount(places, minlength=len(totals)).astype(np.int64)
    more[: len(totals)] += totals
    return more


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, w, a): words and runs of up to ``longest`` words that occur at least ``least`` times in a language, with their exact
    counts; and a row with w = 0 and no phrase with the number of all words of each language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = filters(texts, least, longest)

    partitions = found[0].partitions

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, tally = Salts(), Tally()

        for langs, w in chunks(batches):
            tally.add(langs, w, salts, found)
            if tally.size() >= PHRASES:
                yield from tally.batches(partitions)
                tally = Tally()
        yield from tally.batches(partitions)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by(_NAMES[:3]).aggregate([("a", "sum")]).rename_columns(_NAMES)

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                t = total()
                for batch in t.filter((pc.field("a") >= least) | (pc.field("w") == 0)).to_batches(max_chunksize=10_000):
                    yield batch

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if (part := row.column(0)[0].as_py()) != at:
                    yield from close()
                    at, held, size = part, [], 0
                some = pa.Table.from_arrays([c.flatten() for c in row.columns[1:]], names=_NAMES)
                held.append(some)
                size += some.num_rows
                if size >= 1_000_000:
                    held = [total()]
                    size = held[0].num_rows // 2
        yield from close()

    rows = bounded(texts).mapInArrow(count, "part int, lang array<string>, phrase array<string>, w array<int>, a array<long>")
    return keep(bounded(rows.repartition(partitions, "part").sortWithinPartitions("part")).mapInArrow(add, "lang string, phrase string, w int, a long"), "phrases")


_NAMES = ["lang", "phrase", "w", "a"]


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("ws", F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length), " ")


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, w, a, l, r, n, score) of phrases of two words or more: each is cut after its first words, at the place where
    floor(1000 * a * n / (l * r)) is least (of equal ones the first); l and r count the parts and n all words of the language."""
    total = counts.where("w = 0").select("lang", F.col("a").alias("n"))
    phrases = counts.where("w > 1").withColumn("ws", F.split("phrase", " "))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt")
    cut = lambda side, part: F.struct("k", F.lit(side).alias("side"), part.alias("part"))
    asked = phrases.select("*", salt, F.explode(F.sequence(F.lit(1), F.col("w") - 1)).alias("k"))
    asked = asked.select("lang", "phrase", "w", "a", "salt", F.explode(F.array(cut("l", _part(1, F.col("k"))), cut("r", _part(F.col("k") + 1, F.col("w"))))).alias("x"))
    parts = counts.where((F.col("w") > 0) & (F.col("w") < longest)).select("lang", F.col("phrase").alias("part"), F.col("a").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = asked.select("lang", "phrase", "w", "a", "salt", "x.*").join(parts, ["lang", "part", "salt"])
    ks = range(1, longest)
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("c"))).alias(f"{side}{k}")
    both = met.groupBy("lang", "phrase", "w", "a").agg(*(of(k, side) for k in ks for side in "lr")).join(total, "lang")
    # Decimals of 38 digits hold the products.
    score = lambda k: F.expr(f"(1000 * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l{k} AS DECIMAL(19, 0)) * CAST(r{k} AS DECIMAL(19, 0)))")
    cuts = F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in ks))
    return both.withColumn("x", F.array_min(cuts)).select("lang", "phrase", "w", "a", "x.l", "x.r", "n", "x.score")


def within_longer(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of phrases that lie inside a longer one that occurs at least ``percent`` per cent as often."""
    longer = counts.where("w > 2").select("lang", "w", F.col("a").alias("b"), F.split("phrase", " ").alias("ws"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("w") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("w") - F.col("size") + 1)))
    inner = longer.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "b").groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    return counts.where("w > 1").join(inner, ["lang", "phrase"]).where(100 * F.col("b") >= percent * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = 100, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language by score, then a, both falling, then by the phrase's bytes, without
    those inside a longer one that occurs at least ``percent`` per cent as often."""
    counts = phrase_counts(docs, least, longest)
    left = scored(counts, longest).join(within_longer(counts, percent), ["lang", "phrase"], "left_anti")
    # Tasks keep their best rows of a language before any are sent.
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CUTS = " UNION ALL ".join(f"SELECT *, {k} AS k, array_to_string(ws[1:{k}], ' ') AS lp, array_to_string(ws[{k + 1}:], ' ') AS rp FROM c WHERE w > {k}" for k in range(1, LONGEST))
_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS w, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) AS phrase FROM pieces WHERE len(ws) >= {n}" for n in range(1, LONGEST + 1))
ORACLE = rf"""WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, w, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE w > 1),
cut AS (SELECT x.lang, x.phrase, x.a, n, k, l.a AS l, r.a AS r, (1000::HUGEINT * x.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM ({_CUTS}) x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp JOIN total ON total.lang = x.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, a, unnest(list_transform(range(1, w - z + 2), lambda i: array_to_string(ws[i:i + z - 1], ' '))) AS phrase FROM c, (SELECT unnest(range(2, {LONGEST})) AS z) WHERE z < w),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = best.lang AND o.phrase = best.phrase AND o.a >= best.a))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM top WHERE rank <= {MOST}"""
