"""Helpers shared by the text operators: words, stable word hashes, row-wise Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes in one Arrow batch that a Python task gets, about: texts differ in length by orders of magnitude.
BATCH_BYTES = 4 << 20

#: Rows in one Arrow batch that a Python task returns, and bytes of input after which what is there leaves, about.
OUT_ROWS, OUT_BYTES = 2000, 1 << 20
#: Distinct words whose hash a worker remembers; others are hashed anew each time.
MEMO = 60_000
_U = np.uint64


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The maximal runs outside space and \\x09-\\x0D, as UTF-8. Lower-casing is of A-Z alone. Null gives none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO and len(word) <= 64:
            self[word] = value
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), _U, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word hashes, in order of place."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, _U)
    out = mix(hashes[:size] + _U(n))
    for i in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : i + size])
    return out


def text_chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes, offsets) of consecutive texts of about ``size`` bytes together, as Arrow holds them; null ones are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(outside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes that aren't ``outside``, none beyond its own text."""
    before, after = outside.copy(), outside.copy()
    before[1:], after[:-1] = outside[:-1], outside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    return np.flatnonzero(~outside & before), np.flatnonzero(~outside & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each of the consecutive, non-empty spans that make up ``data``."""
    if not len(starts):
        return np.empty(0, _U)
    powers = np.cumprod(np.full(int(lengths.max()), _U(0x9E3779B97F4A7C15), _U))
    terms = powers[np.arange(len(data)) - np.repeat(starts, lengths)]
    terms *= data
    return mix(np.add.reduceat(terms, starts))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Arrow batches of at most BATCH_BYTES to Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def release() -> None:
    """Give the memory that a task has freed back to the system: workers live on, and what they hold adds up beside the JVM's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str, setup: Callable[[], Callable | tuple[Callable, Callable]]) -> DataFrame:
    """Apply ``setup()(*values)`` to the named columns of each row; it yields any number of output rows.
    ``setup`` runs once in a task; it may return a pair, whose second function gives the rows that end the task.
    Batches leave in small pieces, so memory follows a few rows."""
    target = _arrow(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup()
        fn, end = fn if isinstance(fn, tuple) else (fn, list)
        out: list[tuple] = []
        taken = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for row in zip(*(part.column(i).to_pylist() for i in range(len(columns))), strict=True):
                    out.extend(fn(*row))
                    if len(out) >= OUT_ROWS:
                        yield _batch(out, target)
                        out, taken = [], 0
                taken += part.nbytes
                if out and taken >= OUT_BYTES:
                    yield _batch(out, target)
                    out, taken = [], 0
        out.extend(end())
        for start in range(0, len(out), 10 * OUT_ROWS):
            yield _batch(out[start : start + 10 * OUT_ROWS], target)
        del fn, end, out
        release()

    return bounded(df).select(*columns).mapInArrow(run, schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
