"""Byte-level BPE by a lazily determinised finite-state transducer (operator 10).

The merges (ranks) are compiled on demand into a transducer that reads bytes and writes token ids. For
every prefix of a piece the last token of its encoding is unique, and it begins where another prefix ended;
so the encodings of all prefixes form a tree. A state holds the bytes that are not yet settled, with that
tree over them; tokens leave as soon as all places where a later token can begin agree on them, which is
after a lookahead bounded by the longest token. States are made when first met and dropped together
when the table is full, so memory is bounded for any text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .text import map_rows

#: States kept before the table is dropped; whole pieces whose output is remembered; their greatest length.
MAX_STATES, MAX_PIECES, PIECE_CHARS = 300_000, 400_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State(dict):
    """byte -> (next state, ids written on the way)."""

    __slots__ = ("before", "flush", "live", "pending", "tail")

    def __init__(self, before: int | None, pending: bytes, tail: dict[int, tuple[int, int]], live: tuple[int, ...]):
        self.before = before  # the last token already written; None if no later token can begin right after it
        self.pending = pending  # bytes read since
        self.tail = tail  # place -> (place where its last token begins, that token)
        self.live = live  # places where a later token can begin
        self.flush = b""


class MergeTransducer:
    """Encoder of single pieces. ``ranks`` maps token bytes to rank, which is also the token id."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.ranks, self.max_states, self.max_pieces = ranks, max_states, max_pieces
        self.bytes_of = {i: t for t, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"ranks lack the single bytes {missing[:5]}")
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.pieces = PieceMemo(self, max_pieces)
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[int | None, bytes], State] = {}
        self.start = self._state(None, b"", {}, (0,))

    def _state(self, before: int | None, pending: bytes, tail: dict[int, tuple[int, int]], live: tuple[int, ...]) -> State:
        if live[0]:
            before = None
        key = (before, pending)
        if (state := self.states.get(key)) is None:
            state = self.states[key] = State(before, pending, tail, live)
            state.flush = b"".join(i.to_bytes(4, "little") for i in self._path(tail, len(pending)))
        return state

    @staticmethod
    def _path(tail: dict[int, tuple[int, int]], place: int) -> list[int]:
        ids = []
        while place:
            place, token = tail[place]
            ids.append(token)
        return ids[::-1]

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if len(token) == 1:
            return None
        if (pair := self.parts.get(token)) is None:
            units = [token[i : i + 1] for i in range(len(token))]
            while len(units) > 2:
                found = min(((r, i) for i in range(len(units) - 1) if (r := self.ranks.get(units[i] + units[i + 1])) is not None), default=None)
                if found is None:
                    break
                i = found[1]
                units[i : i + 2] = [units[i] + units[i + 1]]
            pair = self.parts[token] = (units[0], b"".join(units[1:]))
        return pair

    def _edge(self, token: bytes, side: int) -> Iterator[tuple[bytes, float]]:
        """What stands at one edge of a token while it is built, each with the rank that ends it."""
        until = float("inf")
        while True:
            yield token, until
            if (pair := self._split(token)) is None:
                return
            until, token = self.ranks[token], pair[side]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left``: no merge across their border comes before those inside."""
        key = (left, right)
        if (fit := self.fits.get(key)) is None:
            fit, rights = True, list(self._edge(self.bytes_of[right], 0))
            for a, a_until in self._edge(self.bytes_of[left], 1):
                for b, b_until in rights:
                    rank = self.ranks.get(a + b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        fit = False
                        break
                if not fit:
                    break
            if len(self.fits) > 4 * self.max_states:
                self.fits.clear()
            self.fits[key] = fit
        return fit

    def _step(self, state: State, byte: int) -> tuple[State, bytes]:
        pending = state.pending + bytes([byte])
        end = len(pending)
        for place in state.live:
            token = self.ranks.get(pending[place:])
            if token is None:
                continue
            last = state.tail[place][1] if place else state.before
            if last is None or self.follows(last, token):
                break
        else:
            raise ValueError(f"no token ends here: {pending!r}")
        prefixes, tail = self.prefixes, {**state.tail, end: (place, token)}
        live = [p for p in state.live if pending[p:] in prefixes]
        live.append(end)
        # Settle what all live places share: the root moves up to the last place on all their ways.
        root = live[0]
        for p in live[1:]:
            while p != root:
                if p > root:
                    p = tail[p][0]
                else:
                    root = tail[root][0]
        used: dict[int, tuple[int, int]] = {}
        for p in live:
            while p > root and p - root not in used:
                start, last = tail[p]
                used[p - root] = (start - root, last)
                p = start
        out = self._path(tail, root)
        nxt = self._state(out[-1] if out else state.before, pending[root:], used, tuple([p - root for p in live]))
        edge = (nxt, b"".join([i.to_bytes(4, "little") for i in out]))
        state[byte] = edge
        return edge

    def encode_bytes(self, data: bytes) -> bytes:
        """Token ids of one piece, as little-endian unsigned 32-bit integers."""
        state, out = self.start, []
        for byte in data:
            edge = state.get(byte)
            if edge is None:
                if len(self.states) >= self.max_states:
                    # Same state, new table: what was read so far is in the state itself.
                    self._reset()
                    state = self._state(state.before, state.pending, state.tail, state.live)
                edge = self._step(state, byte)
            state, ids = edge
            if ids:
                out.append(ids)
        out.append(state.flush)
        return b"".join(out)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """The ids of all pieces, one after the other."""
        return b"".join(map(self.pieces.__getitem__, pieces))


class PieceMemo(dict):
    """Way of whole pieces through the transducer, from its start to its end; up to a fixed number of them."""

    def __init__(self, codec: MergeTransducer, most: int):
        self.codec, self.most = codec, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_bytes(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= PIECE_CHARS and len(self) < self.most:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=1)
def shared_codec(ranks_path: str) -> MergeTransducer:
    """The transducer of this worker process; its tables outlive a task."""
    return MergeTransducer(load_ranks(ranks_path))


class Splitter:
    """Cuts text into the matches of a pattern. Texts within Latin-1 take the standard library's engine with
    the Unicode classes written out; any other text takes ``regex``, with the pattern as it is."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        # Letters, numbers and white space up to U+00FF.
        letters, numbers, spaces = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
        inside = pattern.replace(r"\p{L}", "\0").replace(r"\p{N}", "\1")
        inside = re.sub(r"\[([^\]]*)\]", lambda m: "[" + m[1].replace("\0", letters).replace("\1", numbers).replace(r"\s", spaces) + "]", inside)
        inside = inside.replace("\0", f"[{letters}]").replace("\1", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
        self.latin = re.compile(inside)
        self.wide = re.compile("[^\0-\xff]").search

    def __call__(self, text: str) -> list[str]:
        return self.full.findall(text) if self.wide(text) else self.latin.findall(text)


class Utf8Machine:
    """Incremental UTF-8 decoding: feed bytes in any cut, get the characters that are complete so far. Ill-formed
    sequences become U+FFFD at the end of their longest valid part."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        if not self.need:
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for i in range(len(data)):
            self._byte(data[i], out)
        return "".join(out)

    def _byte(self, byte: int, out: list[str]) -> None:
        if self.need:
            if self.low <= byte <= self.high:
                self.held += bytes([byte])
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode("utf-8"))
                    self.held = b""
                return
            out.append("�")
            self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xF4:
            self.need, self.held = 1 + (byte >= 0xE0) + (byte >= 0xF0), bytes([byte])
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        else:
            out.append("�")

    def finish(self) -> str:
        rest, self.need, self.held = "�" if self.need else "", 0, b""
        return rest


class StreamDecoder:
    """Token ids to text, a few ids at a time."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine = bytes_of, Utf8Machine()

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.feed(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.finish()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` (array of int: the text's tokens, null text as empty) and
    ``decoded`` (the text got back from them). Equal and repeated rows stay; other columns don't matter; an
    empty table gives an empty one."""

    def setup():
        codec, split = shared_codec(ranks_path), Splitter(pattern)

        def one(key, text):
            ids = np.frombuffer(codec.encode_pieces(split(text or "")), "<u4").tolist()
            decoder = StreamDecoder(codec.bytes_of)
            return [(key, ids, "".join([*(decoder.feed(ids[i : i + 4096]) for i in range(0, len(ids), 4096)), decoder.finish()]))]

        return one

    return map_rows(docs, [id_column, text_column], f"{id_column} {docs.schema[id_column].dataType.simpleString()}, ids array<int>, decoded string", setup)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode, and give for each document ``n_tokens`` and the SHA-256 of the ids (little-endian unsigned
    32-bit) and of the decoded bytes. Digests are taken where the ids are, so that ids needn't leave the task.
    Null text counts as empty; equal rows each give a row."""

    def setup():
        codec, split = shared_codec(ranks_path), Splitter(pattern)

        def one(key, text):
            ids = codec.encode_pieces(split(text or ""))
            decoder, sha = StreamDecoder(codec.bytes_of), hashlib.sha256()
            numbers = np.frombuffer(ids, "<u4").tolist()
            for i in range(0, len(numbers), 4096):
                sha.update(decoder.feed(numbers[i : i + 4096]).encode("utf-8", "surrogatepass"))
            sha.update(decoder.finish().encode())
            return [(key, len(numbers), hashlib.sha256(ids).hexdigest(), sha.hexdigest())]

        return one

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", setup)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
