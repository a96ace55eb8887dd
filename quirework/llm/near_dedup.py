"""Near duplicates by bottom-k sketches of one hash function (operator 3).

A document's sketch is the ``K`` smallest hashes of its word shingles. Exact copies of a shingle set become one class
first. Inverted lists of the ``LISTED`` smallest of them then give candidate pairs of classes; the sketch of the union of a pair
(the K smallest of both sketches) estimates its similarity and drops pairs that can't reach the threshold (one in 10^9
of those that do may be dropped by chance); the full sets of the rest are compared exactly. Links are joined into connected
components.

No list gives all its pairs at once. First every member of a list meets two of its members: the one that lies in most lists
(the text that near copies were made from, if it is there) and one picked by hash. Links make components; lists within
one component leave. Of the lists left, those of at most ``SHORT`` classes are expanded whole, across components. After that,
only pairs that share nothing but long lists can be missing, and only across components. Classes with too few long lists
leave. What is left is compared by an exact prefix filter on what sets differ in from their lists' core. Nothing is capped.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than a shingle has is one shingle. Null or
wordless text has an empty set and no links; very long texts are hashed whole. Repeated rows each give a row with the same
component. Rows that share an id but not their text, and rows without an id, are documents of their own: they are
compared like all others, and the component is the least id in it (null if it has none). Ties go to the smaller id. An empty table
gives an empty one; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bloom
from ..graph import connected_components
from ..scratch import keep
from .text import WordHashes, map_rows, ngram_hashes, words

K, LISTED, SHORT = 48, 24, 32
#: Members that meet one copy of a hub's text, about: a hub with more partners is copied to several tasks.
HUB_PAIRS = 256
#: Chance that a pair at the threshold is dropped by its sketches.
MISS = 1e-9


def shingles(tokens: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(ngram_hashes(hashes.of(tokens), min(width, len(tokens)))) if tokens else np.empty(0, np.uint64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, place, n, digest, sketch): hash of the text, which tells rows of one id apart; size of the set, a 128-bit
    digest of all of it, its K smallest hashes."""

    def setup():
        hashes = WordHashes()

        def one(doc_id, place, text):
            s = shingles(words(text, lower=True), hashes, width)
            return [(doc_id, place, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, (s[:K] >> np.uint64(1)).astype(np.int64).tolist())]

        return one

    rows = docs.select("doc_id", F.xxhash64("text").alias("place"), "text")
    return map_rows(rows, ["doc_id", "place", "text"], "doc_id long, place long, n long, digest binary, sketch array<long>", setup)


def least_shared(percent: int, most: int = K) -> list[int]:
    """For a union sketch of 0..most values, how many must be shared: a pair at the threshold has fewer by chance MISS."""
    t, out = percent / 100, []
    for size in range(most + 1):
        below, s = 0.0, 0
        while s < size and below + comb(size, s) * t**s * (1 - t) ** (size - s) <= MISS:
            below += comb(size, s) * t**s * (1 - t) ** (size - s)
            s += 1
        out.append(s)
    return out


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def classes_of(found: DataFrame) -> DataFrame:
    """(rep, doc_id, place, n, digest, sketch), a row for each distinct set: its first row and its node ``rep``. That is the
    row's id; where there is none, or other sets have it too, a number below all ids."""
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "place", "n", "sketch")
    held = keep(found.where("n > 0").groupBy("digest").agg(F.min(row).alias("x")).select("x.doc_id", "x.place", "x.n", "digest", "x.sketch"), "classes")
    clash = held.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("other"), F.lit(True).alias("clash"))
    if clash.isEmpty():
        return held.withColumn("rep", F.col("doc_id"))
    below = held.agg(F.coalesce(F.min("doc_id"), F.lit(0))).first()[0]
    named = held.join(clash, F.col("doc_id").eqNullSafe(F.col("other")), "left")
    return keep(named.withColumn("rep", F.when(F.col("clash"), F.lit(below) - 1 - F.monotonically_increasing_id()).otherwise(F.col("doc_id"))).drop("other", "clash"), "classes")


def texts_of(reps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the wanted classes; a row that the table holds several times comes several times."""
    key = F.xxhash64("doc_id", "place").alias("key")
    rows = keep(classes.select("rep", "doc_id", "place").join(reps, "rep", "left_semi").select("rep", F.col("doc_id").alias("id"), F.col("place").alias("at"), key), "rows")
    source = docs.select("doc_id", F.xxhash64("text").alias("place"), "text").withColumn("key", key)
    source = source.where(bloom.passing(source, "key", bloom.cells(rows, "key"))).drop("key")
    return keep(source.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("place") == F.col("at"))).select("rep", "text"), "texts")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, member) whose union sketches allow them to be similar."""
    need = F.array(*(F.lit(x) for x in least_shared(percent)))
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"))
    union = F.slice(F.array_sort(F.array_union("s_hub", "s_member")), 1, K)
    shared = F.size(F.array_intersect("union", F.array_intersect("s_hub", "s_member")))
    return pairs.join(side("member"), "member").join(side("hub"), "hub").withColumn("union", union).where(shared >= F.element_at(need, F.size("union") + 1)).select("hub", "member")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (hub, member) that are similar by their full sets. The hub's text leads a group of about
    HUB_PAIRS members at most, whose own texts follow it in the order of the partition."""
    degree = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("salts"))
    both = keep(pairs.join(degree, "hub").select("hub", F.pmod(F.xxhash64("member"), "salts").alias("salt"), "member"), "oriented")
    texts = texts_of(both.select(F.explode(F.array("hub", "member")).alias("rep")).distinct(), classes, docs)
    members = both.join(texts.toDF("member", "text"), "member").select("hub", "salt", F.lit(True).alias("follows"), "member", "text")
    hubs = both.select("hub", "salt").distinct().join(texts.toDF("hub", "text"), "hub").select("hub", "salt", F.lit(False).alias("follows"), F.col("hub").alias("member"), "text")
    stream = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "follows", "member")

    def setup():
        hashes, last = WordHashes(), [None, None, None, None]  # hub, salt, the hub's set, the last member

        def one(hub, salt, follows, member, text):
            if last[:2] == [hub, salt] and last[3] == (follows, member):
                return []  # a repeated row
            x = shingles(words(text, lower=True), hashes, width)
            if not follows:
                last[:] = [hub, salt, x, (follows, member)]
                return []
            last[3] = (follows, member)
            y = last[2]
            both = len(np.intersect1d(x, y, assume_unique=True))
            return [(min(hub, member), max(hub, member))] if 100 * both >= percent * (len(x) + len(y) - both) and both else []

        return one

    return map_rows(stream, ["hub", "salt", "follows", "member", "text"], "a long, b long", setup)


def _lists(entries: DataFrame, by: str) -> DataFrame:
    """Entries (v, rep, n, ...) in lists with more than one group, with the list's size."""
    size = entries.groupBy("v").agg(F.count("*").alias("c"), F.min(by).alias("lo"), F.max(by).alias("hi"))
    return entries.join(size.where("lo < hi").drop("lo", "hi"), "v")


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once."""
    return pairs.groupBy(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).agg(F.min("hub").alias("hub")).select("hub", (F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("member"))


def _expanded(listed: DataFrame, percent: int, by: str) -> DataFrame:
    """Pairs within lists, across groups."""
    a = listed.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col(by).alias("ga"))
    b = listed.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col(by).alias("gb"))
    fit = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _sizes_fit(F.col("na"), F.col("nb"), percent)
    return a.join(b.withColumnRenamed("v", "w"), (F.col("v") == F.col("w")) & fit).select(F.col("a").alias("hub"), F.col("b").alias("member"))


def _with_pivots(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of lists and two members of each: the one in most lists, and one by hash. They are plain
    minima, so no list is gathered."""
    central = listed.groupBy("rep").agg((-F.count("*")).alias("m"))
    h = F.xxhash64("rep").alias("h")
    pivots = listed.join(central, "rep").groupBy("v").agg(F.min(F.struct("m", h, "rep", "n")).alias("x"), F.min(F.struct(h, "rep", "n")).alias("y"))
    pivot = lambda c: F.struct(F.col(f"{c}.rep").alias("rep"), F.col(f"{c}.n").alias("n"))
    pivots = keep(pivots.select("v", F.array_distinct(F.array(pivot("x"), pivot("y"))).alias("ps")), "pivots")
    met = listed.join(pivots, "v").select("rep", "n", F.explode("ps").alias("p")).where((F.col("rep") != F.col("p.rep")) & _sizes_fit(F.col("n"), F.col("p.n"), percent))
    return met.select(F.col("p.rep").alias("hub"), F.col("rep").alias("member"))


def components(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, component) for the classes that are linked to another one."""
    entries = classes.select("rep", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    listed = keep(_lists(entries, "rep"), "lists")
    tried = keep(likely(_once(_with_pivots(listed, percent)), classes, percent), "likely")
    links = keep(confirmed(tried, classes, docs, width, percent), "links")
    joined = keep(connected_components(links, "a", "b"), "joined")

    # The entries in lists that span components.
    named = listed.select("v", "rep", "n").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    spanning = keep(_lists(named.select("v", "rep", "n", F.coalesce("component", "rep").alias("group")), "group"), "spanning")
    pairs = _expanded(spanning.where(F.col("c") <= SHORT), percent, "group")
    long = spanning.where(F.col("c") > SHORT).select("v", "rep", "n", "group")
    if not long.isEmpty():
        pairs = pairs.unionByName(_by_difference(long, classes, docs, width, percent))
    both = tried.unionByName(tried.select(F.col("member").alias("hub"), F.col("hub").alias("member")))
    new = keep(likely(_once(pairs).join(both, ["hub", "member"], "left_anti"), classes, percent), "likely")
    if not new.isEmpty():
        # Those of the components stand for the links found before.
        joined = connected_components(confirmed(new, classes, docs, width, percent).unionByName(joined.toDF("a", "b")), "a", "b")
    return joined.withColumnRenamed("node", "rep")


def _by_difference(long: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs of ``long`` (list v, rep, n, group), across groups, among members of one list.

    Similar sets share at least ``fewest`` lists by their sketches, so members of fewer leave. Each list belongs to its
    member p that lies in most lists, and a member is held under the p's of its lists but for the last fewest - 1 of them in
    the order of p, which a similar pair can't have alone in common. Each p has a core C: the shingles of p that more than half of
    its members hold. With D(A) the symmetric difference of A and C, A and B are similar if and only if D(A) and D(B)
    differ in at most r * (|A| + |B|) places, r = (1 - t) / (1 + t). Let A1 be the member of least |D|. Every A with |D(A)| +
    |D(A1)| within its bound is surely similar to A1, and is paired with A1 alone. Two others can only be similar
    without a common element of D if the larger sizes of some texts leave room for that; such A are few and meet all within bounds. All
    the rest share at least (|D(A)| + |D(B)| - r * (|A| + |B|)) / 2 elements; one of them is among the first (1 - t) / t * |A| + 1
    of both in any common order, and not too far back for the rest to be shared. The order takes shingles outside the core
    first, then those of the core that most members hold; so texts that were changed in different places don't meet,
    and only these first elements leave the row. A pair meets under the first p it has in common. Bounds are compared in
    integers, with t = percent / 100."""
    c, less, more = F.col, 100 - percent, 100 + percent
    fewest = F.when(c("n") < LISTED, F.lit(1)).otherwise(F.lit(least_shared(percent, LISTED)[LISTED]))
    ids = long.groupBy("rep").agg(F.first("n").alias("n"), F.count("*").alias("m")).where(c("m") >= fewest).select("rep", "m")
    left = keep(long.join(ids, "rep").select("v", "rep", "n", "group", "m"), "left")
    pivots = keep(left.groupBy("v").agg(F.min(F.struct((-c("m")).alias("m"), "rep")).alias("x")).select("v", c("x.rep").alias("q")), "pivots")
    some = left.join(pivots, "v").groupBy("rep").agg(F.first("n").alias("n"), F.first("group").alias("group"), F.sort_array(F.collect_list("q")).alias("all"))
    some = some.select("rep", "n", "group", F.array_distinct(F.slice("all", F.lit(1), F.greatest(F.size("all") - fewest + 1, F.lit(1)))).alias("ps"))
    some = keep(some.withColumn("p", F.explode("ps")), "held")
    spanning = keep(some.groupBy("p").agg(F.count("*").alias("members"), F.max("n").alias("top"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("p", "members", "top"), "cores")
    some = some.join(spanning.select("p"), "p", "left_semi")

    def setup():
        hashes = WordHashes()
        return lambda rep, text: [(rep, (shingles(words(text, lower=True), hashes, width) >> np.uint64(1)).astype(np.int64).tolist())]

    wanted = some.select("rep").unionByName(spanning.select(c("p").alias("rep"))).distinct()
    sets = map_rows(texts_of(wanted, classes, docs), ["rep", "text"], "rep long, s array<long>", setup)
    sets = keep(sets.groupBy("rep").agg(F.min("s").alias("s")), "sets")
    held = keep(some.join(sets, "rep"), "members")
    own = keep(spanning.select("p").join(sets.toDF("p", "own"), "p"), "own")
    core = held.select("p", "s").join(own, "p").select("p", F.explode(F.array_intersect("s", "own")).alias("v")).groupBy("p", "v").agg(F.count("*").alias("k"))
    core = core.join(spanning, "p").where(2 * c("k") > c("members")).groupBy("p").agg(F.sort_array(F.collect_list(F.struct((-c("k")).alias("k"), "v"))).alias("x")).select("p", c("x.v").alias("core"))
    apart = held.join(keep(core, "core"), "p", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    apart = apart.select("rep", "n", "group", "ps", "p", F.concat(F.array_except("s", "core"), F.array_except("core", "s")).alias("d"))
    first = F.slice("d", F.lit(1), (F.floor(c("n") * less / percent) + 1).cast("int"))
    apart = keep(apart.select("rep", "n", "group", "ps", "p", F.size("d").cast("long").alias("size"), first.alias("first")), "apart")
    least = apart.groupBy("p").agg(F.min(F.struct("size", "rep", "n", "group")).alias("one"))
    sum_size = more * (c("size") + c("one.size"))
    apart = apart.join(keep(least.join(spanning.select("p", "top"), "p"), "least"), "p").withColumn("near", sum_size <= less * (c("n") + c("one.n"))).withColumn("between", ~c("near") & (sum_size <= less * (c("n") + c("top"))))
    each = keep(apart.select("rep", "n", "group", "ps", "p", "size", "near", F.posexplode("first").alias("i", "v")), "first")
    a, b = (each.select(*(c(x).alias(f"{side}_{x}") for x in each.columns)) for side in "ab")
    rest = F.least(c("a_size") - c("a_i"), c("b_size") - c("b_i"))
    shared = more * (c("a_size") + c("b_size")) - less * (c("a_n") + c("b_n"))
    met = (c("a_p") == c("b_p")) & (c("a_v") == c("b_v")) & (c("a_rep") < c("b_rep")) & (c("a_group") != c("b_group")) & ~(c("a_near") & c("b_near")) & _sizes_fit(c("a_n"), c("b_n"), percent) & (2 * more * rest >= shared)
    met = met & (c("a_p") == F.element_at(F.array_intersect("a_ps", "b_ps"), 1))
    pairs = a.join(b, met).select(c("a_rep").alias("hub"), c("b_rep").alias("member"))
    to_one = apart.where(c("near") & (c("group") != c("one.group"))).select(c("one.rep").alias("hub"), c("rep").alias("member"))
    x, y = apart.where("between").select("p", c("rep").alias("a"), c("n").alias("na"), c("size").alias("da"), c("group").alias("ga")), apart.select(c("p").alias("q"), c("rep").alias("b"), c("n").alias("nb"), c("size").alias("db"), c("group").alias("gb"))
    odd = x.join(y, (c("p") == c("q")) & (c("ga") != c("gb")) & (more * (c("da") + c("db")) <= less * (c("na") + c("nb")))).select(c("b").alias("hub"), c("a").alias("member"))
    return pairs.unionByName(to_one).unionByName(odd)


def judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, place, n, component_id, stays) for each row; ``stays`` holds for the rows that are the one of their component,
    which is that of the least id, then the least place, and for rows without words."""
    found = keep(sketches(docs, width), "sketches")
    classes = classes_of(found)
    linked = components(classes, docs, width, percent)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "place")
    named = linked.join(classes.select("rep", "doc_id", "place"), "rep")
    chosen = named.groupBy("component").agg(F.min(row).alias("x"))
    linked = keep(linked.join(chosen, "component").select("rep", "x"), "chosen")
    # Only classes with copies or links say more than a document says of itself, but all are small rows.
    told = keep(classes.select("rep", "digest", row.alias("own")).join(linked, "rep", "left").select(F.col("digest").alias("of"), F.coalesce("x", "own").alias("x")), "told")
    full = found.select("doc_id", "place", "n", "digest").join(told, F.col("digest") == F.col("of"), "left")
    stays = F.col("of").isNull() | (F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("place") == F.col("x.place")))
    component = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("x.doc_id"))
    return full.select("doc_id", "place", "n", component.alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id, or the row has no id and its component neither):
    documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of at least ``percent`` in a hundred."""
    return judged(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each component, and all rows without words. The texts of rows that stay aren't
    shuffled, but for the few that a Bloom filter of the others lets through. A row travels as one value, so its columns may have any names."""
    verdicts = judged(docs, width, percent).groupBy("doc_id", "place").agg(F.count("*").alias("c"), F.bool_or("stays").alias("stays"), F.max("n").alias("n"))
    # Rows that go, and repeated rows of which one stays.
    suspects = keep(verdicts.where("n > 0 AND (NOT stays OR c > 1)").select(F.xxhash64("doc_id", "place").alias("key"), F.col("doc_id").alias("id"), F.col("place").alias("at"), "stays"), "suspects")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("place")).withColumn("key", F.xxhash64("own", "place"))
    tagged = keyed.withColumn("maybe", bloom.passing(keyed, "key", bloom.cells(suspects, "key"))).drop("key")
    clear, others = tagged.where(~F.col("maybe")), tagged.where("maybe")
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("place") == F.col("at"))
    wanted = suspects.select("id", "at", "stays")
    once = others.join(wanted.where("stays"), same, "left_semi").dropDuplicates(["own", "place"])
    return clear.unionByName(others.join(wanted, same, "left_anti")).unionByName(once).select("row.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.doc_id WHERE walk.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(walk.root) AS component_id, d.doc_id = min(walk.root) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN walk ON walk.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
