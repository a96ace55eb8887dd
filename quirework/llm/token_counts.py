"""Edit-aware token counts (operator 5).

A document is held as its pre-tokens in small leaves under a segment tree of sums (characters, tokens). An edit finds its
place by descending the tree, cuts anew only from a boundary a few characters before it to the first old
boundary behind it at which old and new cuts agree, encodes those pre-tokens, and updates the sums above the touched
leaves. The cut of a pre-token looks at most ``LOOK`` characters past its end, so what stands before is unaffected;
and as every cut depends on the text after it alone, all behind the agreed boundary stays as it was.

Null text counts as empty; an edit beyond the end is moved to it; null edits, one or all, are none, and a null place,
length or insertion is 0 or empty; very long texts are held whole, and an edit costs what it touches; repeated rows each give a row; an
empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PIECE_CHARS, Splitter, load_ranks
from .text import map_rows

LEAF, LOOK, WINDOW = 64, 3, 256
#: Pre-tokens whose count a worker remembers.
MEMO = 400_000


class CountMemo(dict):
    """Tokens of a pre-token."""

    def __init__(self, encoding):
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= PIECE_CHARS and len(self) < MEMO:
            self[piece] = n
        return n


class CountedText:
    """A text under edits, with its token count."""

    def __init__(self, text: str, split: Callable[[str], list[str]], count: CountMemo):
        self.split, self.count, self.reencoded = split, count, 0
        self._build(split(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        n = self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, leaf in enumerate(self.leaves):
            self._sum(i, leaf)
        for i in range(n - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _sum(self, i: int, leaf: list[str]) -> None:
        self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, leaf)), sum(map(self.count.__getitem__, leaf))

    def _update(self, i: int) -> None:
        self._sum(i, self.leaves[i])
        i = (self.size + i) // 2
        while i:
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join(map("".join, self.leaves))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one, at the end), and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if place >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.size, begin

    def _boundary(self, place: int) -> tuple[int, int, int]:
        """(leaf, pre-token, start) of the pre-token at ``place``."""
        leaf, at = self._leaf_at(place)
        for k, piece in enumerate(self.leaves[leaf]):
            if at + len(piece) > place:
                return leaf, k, at
            at += len(piece)
        return leaf, len(self.leaves[leaf]), at

    def replace(self, start: int, length: int, new: str) -> None:
        start = min(max(0, start), len(self))
        end = min(start + max(0, length), len(self))
        leaf, k, begin = self._boundary(max(0, start - LOOK))
        old, ends, ahead = [], [], self._pieces_from(leaf, k)  # old pre-tokens from there, with their ends
        at, want = begin, WINDOW
        while True:
            while at < end + want and (piece := next(ahead, None)) is not None:
                old.append(piece)
                at += len(piece)
                ends.append(at)
            text = "".join(old)
            text = text[: start - begin] + new + text[end - begin :]
            whole = at == len(self)
            known, shift = set(ends) | {begin}, len(new) - (end - start)
            cut, place = [], 0
            agreed = None
            for piece in self.split(text):
                if place + begin - shift >= end and place + begin - shift in known and place >= start - begin + len(new):
                    agreed = place + begin - shift
                    break
                if not whole and place + len(piece) + LOOK > len(text):
                    break
                cut.append(piece)
                place += len(piece)
            else:
                if whole:
                    agreed = at
            if agreed is not None:
                break
            want *= 2
        gone = ends.index(agreed) + 1 if agreed > begin else 0
        self.reencoded += len(cut)
        self._swap(leaf, k, gone, cut)

    def _pieces_from(self, leaf: int, k: int):
        for i in range(leaf, len(self.leaves)):
            yield from self.leaves[i][k:]
            k = 0

    def _swap(self, leaf: int, k: int, gone: int, new: list[str]) -> None:
        i, first = leaf, self.leaves[leaf][:k] + new
        touched = [leaf]
        rest = self.leaves[leaf][k:]
        while gone >= len(rest) and i + 1 < len(self.leaves) and gone:
            gone -= len(rest)
            if i != leaf:
                self.leaves[i] = []
                touched.append(i)
            i += 1
            rest = self.leaves[i]
        if i == leaf:
            self.leaves[leaf] = first + rest[gone:]
        else:
            self.leaves[leaf] = first
            self.leaves[i] = rest[gone:]
            touched.append(i)
        if len(self.leaves[leaf]) > 8 * LEAF:
            self._build([p for x in self.leaves for p in x])
        else:
            for j in touched:
                self._update(j)


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` holds doc_id, text and edits (array of struct start, length, insert; in order, each on the text that the one
    before left). Returns doc_id, n_pretokens, n_tokens (before), n_edits, n_reencoded (pre-tokens that the edits made
    anew), n_tokens_after and n_chars_after."""

    def setup():
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        split, count = Splitter(pattern), CountMemo(encoding)
        lone = re.compile("[\ud800-\udfff]")

        def one(doc_id, text, edits):
            held = CountedText(text or "", split, count)
            before = held.n_pieces, held.n_tokens
            edits = [e for e in edits or [] if e]
            for e in edits:
                held.replace(e["start"] or 0, e["length"] or 0, lone.sub("", e["insert"] or ""))
            return [(doc_id, *before, len(edits), held.reencoded, held.n_tokens, len(held))]

        return one

    return map_rows(docs, ["doc_id", "text", "edits"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long, n_chars_after long", setup)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under three edits that follow from its own row: its language written in at a third of its length,
    seven characters taken out in the middle, five replaced by its source at two thirds."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, length, insert: F.struct(F.floor(at).cast("int").alias("start"), F.lit(length).alias("length"), insert.alias("insert"))
    edits = F.array(edit(n / 3, 0, F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" "))), edit(n / 2, 7, F.lit("")), edit(2 * n / 3, 5, F.coalesce("source", F.lit(""))))
    return edited_counts(docs.select("doc_id", "text", edits.alias("edits")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
