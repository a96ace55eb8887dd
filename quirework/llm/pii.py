"""Personal data by rule, and information-theoretic sanitisation of terms that give it away (operator 7).

Values found by rule are the protected entities. A term's disclosure of an entity is estimated from the corpus: of the
documents that hold the term, the share ``p(e|t)`` in which it stands within ``WINDOW`` words of the entity, on the same
line; the pointwise information is log2 of p(e|t) / p(e), where p(e) counts the documents with a term near the entity. Both are taken at the lower bound of p(e|t) (Wilson's, SURE standard
errors), so a rare term needs a purer record. A term is sensitive if, for some entity, it was seen in at least ``CONTEXTS``
different surroundings (exact copies of a passage are one), p(e|t) >= ``DISCLOSURE`` and the information is at least ``BITS``. An
entity is the same however its digits are grouped. Sensitive terms are marked wherever they stand. In redaction those with p(e|t) >=
``REMOVE`` are removed, others give way to a general word.

Counts cover all documents. To count the documents of candidate terms and to find sensitive ones, a Bloom filter of
fixed size goes to the tasks; terms that pass it by chance fall out of the join that follows, so results are exact at any number of terms.

Null text counts as empty; very long texts are read whole; repeated rows each give a row; of spans that start alike the
longer comes last; other columns, whatever their names, don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bloom as bloom_filter
from ..scratch import keep
from .text import WordHashes, map_rows, words

KINDS = ["email", "ip", "card", "phone"]
WINDOW, CONTEXTS, DISCLOSURE, BITS, REMOVE = 5, 2, 0.5, 4.0, 0.9
#: Standard errors of the confidence bound on p(e|t).
SURE = 1.0
#: Bits in the Bloom filter (1 MB), and probes for each term.
BLOOM_BITS, PROBES = 1 << 23, 4

# The patterns of the rules. Those that could backtrack are possessive; what they match is the same.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left over the local part, to the right over the domain; linear in any text."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: list[int]) -> bool:
    return (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0


def rules(text: str) -> list[tuple[str, int, int]]:
    """All spans found by rule, by kind as listed, then start; ends are exclusive."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x := part.lstrip("0") or "0") < 4 and int(x) < 256 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = [int(c) for c in m[0] if c in "0123456789"]
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


class TermHashes(WordHashes):
    """Hashes of words without the marks at their edges."""

    def __missing__(self, word: bytes) -> int:
        return super().__missing__(word) if (bare := word.strip(EDGE.encode())) == word else self[bare]


def terms(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Words of text[start:end] without marks at their edges, A-Z lower-cased, with places; at least 3 bytes, one a letter."""
    out = []
    for m in WORD.finditer(text, start, end):
        word = m[0].lstrip(EDGE)
        a = m.end() - len(word)
        word = word.rstrip(EDGE)
        term = word.encode("utf-8", "surrogatepass").lower()
        if len(term) >= 3 and any(map(str.isalpha, word)):
            out.append((term.decode("utf-8", "surrogatepass"), a, a + len(word)))
    return out


def entity_of(kind: str, value: str) -> int:
    """Hash of what a value names, however it is written: digits of a card or phone, numbers of an ip, small letters."""
    if kind in ("card", "phone"):
        value = "".join(c for c in value if c in "0123456789")
    elif kind == "ip":
        value = ".".join(x.lstrip("0") or "0" for x in value.split("."))
    return xxhash.xxh64_intdigest(f"{kind}:{value.lower()}") >> 1


def nearby(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, hash of the entity, hash of the surroundings) for the terms around each span."""
    out = set()
    # Spans joined where they overlap: ordered by start as by end, so each term is held against one of them.
    joined: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    starts = [s for s, _ in joined]
    for kind, s, e in spans:
        entity = entity_of(kind, text[s:e])
        left, right = text.rfind("\n", 0, s) + 1, text.find("\n", e)
        right = len(text) if right < 0 else right
        # A few words are looked for in a stretch that doubles until it holds them, so long lines cost little.
        size = 128
        while True:
            a, b = max(left, s - size), min(right, e + size)
            before, after = list(WORD.finditer(text, a, s)), list(WORD.finditer(text, e, b))
            if (a == left or len(before) > WINDOW) and (b == right or len(after) > WINDOW):
                break
            size *= 2
        a = before[-WINDOW].start() if len(before) >= WINDOW else a
        b = after[WINDOW - 1].end() if len(after) >= WINDOW else b
        around = xxhash.xxh64_intdigest(text[a:s] + "\0" + text[e:b]) >> 1
        for word, x, y in terms(text, a, s) + terms(text, e, b):
            i = bisect_left(starts, y) - 1  # the last that begins before the term ends
            if i < 0 or joined[i][1] <= x:
                out.add((word, entity, around))
    return sorted(out)


def _probes(h: np.ndarray) -> np.ndarray:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[..., None] + step[..., None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOOM_BITS)


def locate(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, key), ``key`` a hash of its text: the spans found by rule, and the terms nearby."""

    def setup():
        def one(doc_id, text):
            text = text or ""
            spans = rules(text)
            return [(doc_id, text_key(text), [dict(kind=k, s=s, e=e) for k, s, e in spans], [dict(term=t, entity=x, around=y) for t, x, y in nearby(text, spans)])]

        return one

    return map_rows(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, base array<struct<kind:string,s:int,e:int>>, near array<struct<term:string,entity:long,around:long>>", setup)


def candidates(located: DataFrame) -> DataFrame:
    """(term, entity, docs, holders): terms seen near an entity in enough surroundings, in how many documents; and the
    documents that hold the entity."""
    # Copies of a document are one row with a count, before anything is exploded.
    once = located.where(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("n"), F.first("near").alias("near"))
    near = once.select("key", "n", F.explode("near").alias("x")).select("key", "n", "x.*")
    holders = near.groupBy("entity", "key").agg(F.first("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("holders"))
    around = near.groupBy("term", "entity", "around").agg(F.lit(1).alias("one")).groupBy("term", "entity").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    docs = near.groupBy("term", "entity", "key").agg(F.first("n").alias("n")).groupBy("term", "entity").agg(F.sum("n").alias("docs"))
    return around.join(docs, ["term", "entity"]).join(holders, "entity").select("term", "entity", "docs", "holders")


def bloom(wanted: DataFrame) -> np.ndarray:
    """Bits of all terms, at most BLOOM_BITS / 32 rows of which reach the driver."""

    def setup():
        def one(term):
            places = _probes(np.array([xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))], np.uint64))[0]
            return [(int(p) // 32, 1 << (int(p) % 32)) for p in places]

        return one

    cells = map_rows(wanted.select("term").distinct(), ["term"], "cell long, bits long", setup).groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(BLOOM_BITS // 32, np.uint32)
    bits[cells.cell] = cells.bits
    return bits


def _passing(tokens: list[bytes], hashes: TermHashes, bits: np.ndarray) -> set[str]:
    """The terms among ``tokens`` that pass the filter."""
    unique, first = np.unique(hashes.of(tokens), return_index=True)
    p = _probes(unique)
    hit = ((bits[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32)) & 1).all(axis=-1)
    return {tokens[i].strip(EDGE.encode()).decode("utf-8", "surrogatepass") for i in first[hit]}


def document_counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(term, df): documents that hold each term that passes the filter."""

    def setup():
        hashes, df = TermHashes(), Counter()

        def one(text):
            df.update(_passing(words(text, lower=True), hashes, bits))
            if len(df) > 200_000:
                out = list(df.items())
                df.clear()
                return out
            return []

        return one, lambda: list(df.items())

    return map_rows(docs, ["text"], "term string, df long", setup).groupBy("term").agg(F.sum("df").alias("df"))


def occurrences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, key, term, places): terms that pass the filter."""

    def setup():
        hashes = TermHashes()

        def one(doc_id, text):
            text = text or ""
            hits = _passing(words(text, lower=True), hashes, bits)
            if not hits:
                return []
            places: dict[str, list[dict]] = {}
            for term, s, e in terms(text, 0, len(text)):
                if term in hits:
                    places.setdefault(term, []).append(dict(s=s, e=e))
            key = text_key(text)
            return [(doc_id, key, term, x) for term, x in places.items()]

        return one

    return map_rows(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, term string, places array<struct<s:int,e:int>>", setup)


def sensitive(df: DataFrame, wanted: DataFrame, n_docs: int) -> DataFrame:
    """(term, risk): terms whose disclosure of some entity exceeds the thresholds."""
    risk = F.least(F.col("docs") / F.col("df"), F.lit(1.0))
    n, z2 = F.col("df"), SURE**2
    sure = (risk + z2 / (2 * n) - SURE * F.sqrt(risk * (1 - risk) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    bits = F.log2(sure * n_docs / F.col("holders"))
    return wanted.join(df, "term").where((sure >= DISCLOSURE) & (bits >= BITS)).groupBy("term").agg(F.max(risk).alias("risk"))


def method_spans(docs: DataFrame, located: DataFrame) -> DataFrame | None:
    """(doc_id, key, found): spans of sensitive terms, by document; None if there are no such terms."""
    wanted = keep(candidates(located), "pii-terms")
    bits = bloom(wanted)
    if not bits.any():
        return None
    marks = keep(sensitive(document_counts(docs, bits), wanted, located.count()), "pii-sensitive")
    bits = bloom(marks)
    if not bits.any():
        return None
    marked = occurrences(docs, bits).join(marks, "term")
    # Rows that are the same in every way have the same spans; one of them will do.
    return (
        marked.select("doc_id", "key", F.explode("places").alias("p"), "risk")
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set(F.struct("p.s", "p.e", "risk"))).alias("found"))
    )


def _with_spans(docs: DataFrame, spans: DataFrame | None) -> DataFrame:
    if spans is None:
        return docs.withColumn("found", F.lit(None).cast("array<struct<s:int,e:int,risk:double>>"))
    a, b = docs.alias("a"), spans.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left").select("a.*", "b.found")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the spans found by rule, and all spans, for each document."""
    located = keep(locate(docs), "pii-rules")
    full = _with_spans(located, method_spans(docs, located))

    def setup():
        def one(doc_id, base, found):
            said = [f"{x['kind']}:{x['s']}:{x['e']}" for x in base]
            extra = [f"term:{x['s']}:{x['e']}" for x in found or []]
            return [(doc_id, *(sum(x["kind"] == k for x in base) for k in KINDS), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(said + extra), len(said + extra))]

        return one

    return map_rows(full, ["doc_id", "base", "found"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", setup)


def cut(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced; where spans overlap, the first stands for all."""
    out, at = [], 0
    for s, e, word in sorted(spans):
        if s >= at:
            out += [text[at:s], word]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by the name of its kind, and sensitive terms generalised or
    removed; ``n_chars``, if there, follows the text. Null text stays null. All other columns stay."""
    located = keep(locate(docs), "pii-rules")
    spans = method_spans(docs, located)
    target = docs.schema
    columns = [f"c{i}" for i in range(len(target))]
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def setup():
        def one(found, *row):
            row, text = list(row), row[at]
            if text:
                new = [(s, e, f"<{kind.upper()}>") for kind, s, e in rules(text)]
                new += [(x["s"], x["e"], "" if x["risk"] >= REMOVE else "<TERM>") for x in found or []]
                if new:
                    row[at] = cut(text, new)
                    if counted is not None:
                        row[counted] = len(row[at])
            return [tuple(row)]

        return one

    renamed = docs.toDF(*columns)
    if spans is None:
        full = renamed.withColumn("found", F.lit(None).cast("array<struct<s:int,e:int,risk:double>>"))
    else:
        # Only rows that may have spans are shuffled; a filter of fixed size lets all others pass by.
        b = keep(spans.withColumnRenamed("doc_id", "b_id").withColumnRenamed("key", "b_key"), "pii-spans")
        key = keyed(renamed, f"c{at}")
        tagged = key.withColumn("maybe", bloom_filter.passing(key, "key", bloom_filter.cells(b, "b_key")))
        met = tagged.where("maybe").join(b, F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")), "left")
        clear = tagged.where(~F.col("maybe")).withColumn("found", F.lit(None).cast(b.schema["found"].dataType))
        full = clear.select("found", *columns).unionByName(met.select("found", *columns))
    out = map_rows(full, ["found", *columns], ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, target, strict=True)), setup)
    return out.select(*(F.col(c).alias(f.name) for c, f in zip(columns, target, strict=True)))


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42) >> 1


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``key``, the ``text_key`` of its text, which Spark's own hash is too."""
    return docs.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
