"""Secret scans by rules and by character Markov models (operator 9). DataFrame and SQL functions only.

Three kinds are found by rule. A fourth, ``random``, comes from two character models, one of random strings and one of ordinary
identifiers. Their labelled samples come from the corpus itself: what the rules found is random; a run outside all spans found by rule
whose parts are letters, digits, or letters and a short number is ordinary. Every run of at least ``MIN_RUN`` characters outside those spans,
of whatever shape, is a secret if its log-likelihood ratio exceeds ``THRESHOLD`` per character, and ``LEAST`` in all, which is more for short runs.

Both models fold digits, which are alike in either, and the case of letters, which is told by one of four patterns (lower, upper, capitalised parts, other). Ordinary runs are a
second-order chain, begun at the edge of the run, with absolute discounting of one: what a single run alone has shown says nothing for
another, so a secret that stands in the text does not make itself ordinary. Random strings are a first-order chain within the
run's own kind of characters (letters, digits, signs and their unions, or hexadecimal; all kinds and cases are held equally likely before), mixed half and half with the even choice.
All documents train the models; each distinct run counts once, so that copies of a secret don't make it ordinary either. The models are tables of fixed
size (``CODES`` ** 3 and ``KINDS`` * ``CODES`` ** 2 rows), which are broadcast. Distinct runs are scored, and the few that are secrets are looked up in the texts.

Null text counts as empty; very long texts and texts of very many matches take time little above proportion; repeated
rows each give a row; equal runs are judged alike; other columns don't matter; an empty table gives an empty one. Without samples of both classes the models say nothing.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bloom
from ..scratch import keep

#: Nats per character by which the random model must be likelier.
THRESHOLD = 0.5
#: Nats in all by which the random model must be likelier: the log odds against a secret if one run in e^12, about 160,000, is one.
LEAST = 12.0
MIN_RUN = 8
#: Kind, pattern, group that is the secret, least length of it, test that must hold for any match.
RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("=", ":")),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20, ("AKIA",)),
    ("hex", r"([0-9a-f]{24,})", 1, 24, ()),
]
#: Fixed values. A run is labelled ordinary if none of these is in it: a digit before a letter, five digits after a letter. So
#: its parts are letters, digits, or letters and a short number.
MIXED = r"[0-9][A-Za-z]|[A-Za-z][0-9]{5}"
RUN = rf"([A-Za-z0-9+/_-]{{{MIN_RUN},}})"
#: Spans found by rule, in stretches with their bounds, so that a run is held against few of them however many there are.
STRETCHES = """transform(IF(size(base) = 0, CAST(array() AS array<bigint>), sequence(0L, CAST(size(base) - 1 AS bigint), CAST(ceil(sqrt(size(base))) AS bigint))),
    i -> slice(base, CAST(i AS int) + 1, CAST(ceil(sqrt(size(base))) AS int)))"""
BOUNDED = f"transform({STRETCHES}, k -> named_struct('lo', array_min(transform(k, b -> b.s)), 'hi', array_max(transform(k, b -> b.e)), 'all', k))"
#: Holds for a run ``x`` outside all of them.
OUTSIDE = "NOT exists(stretches, k -> k.lo < x.e AND x.s < k.hi AND exists(k.all, b -> b.s < x.e AND x.s < b.e))"
#: Characters by number: letters without case, any digit, ``+/_-``, the edge of a run, all others.
CODES, DIGIT, EDGE, OTHER = 33, 26, 31, 32
CODE = f"""CASE WHEN x BETWEEN 97 AND 122 THEN x - 97 WHEN x BETWEEN 65 AND 90 THEN x - 65 WHEN x BETWEEN 48 AND 57 THEN {DIGIT}
    WHEN x = 43 THEN 27 WHEN x = 47 THEN 28 WHEN x = 95 THEN 29 WHEN x = 45 THEN 30 ELSE {OTHER} END"""
#: Weight of what the ordinary model takes for granted, in characters, pairs and triples: matters for small corpora alone.
PRIOR = (2000.0, 60.0, 3.0)
#: Kinds of runs: bits for letters, digits and signs; the last is hexadecimal with both.
KINDS, HEX = 9, 8
#: Kinds and cases that a random string may have, held equally likely.
CHOICES = 16
SALTS = 8
_ITEM = "struct<s:bigint,e:bigint,r:int,kind:string,v:string>"


def _gate(text: Column, needs: tuple[str, ...]) -> Column:
    """Whether the text holds one of some strings that every match must have; true if there are none."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in needs)) if needs else F.lit(True)


def _found(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, gate: Column, name: str) -> list[tuple[str, Column]]:
    """Columns (in steps) for the leftmost non-overlapping matches with their places in code points, none where the gate is shut. The text
    between matches, cut out by ``split``, gives the places."""
    empty = F.array().cast("array<string>")
    # Where the group is all of the match, the matches serve for both.
    inner = F.when(F.size(f"{name}_h") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(empty) if group > 1 else F.col(f"{name}_h")
    return [
        (f"{name}_h", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)),
        (f"{name}_g", inner),
        (f"{name}_p", F.when(F.size(f"{name}_h") > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))),
        # Where matches begin is summed up in stretches of about the square root of their number, so no long array is copied
        # for each match.
        (f"{name}_w", F.expr(f"CAST(greatest(1, ceil(sqrt(size({name}_h)))) AS int)")),
        (f"{name}_l", F.expr(f"transform({name}_h, (h, i) -> length(h) + {name}_p[i])")),
        (
            f"{name}_b",
            F.expr(
                f"""aggregate(transform(sequence(0, greatest(size({name}_h) - 1, 0), {name}_w), i -> aggregate(slice({name}_l, i + 1, {name}_w), 0L, (t, x) -> t + x)),
                named_struct('at', 0L, 'out', CAST(array() AS array<bigint>)), (a, n) -> named_struct('at', a.at + n, 'out', concat(a.out, array(a.at))), a -> a.out)"""
            ),
        ),
        (
            name,
            F.expr(
                f"""CASE WHEN size({name}_h) = 0 THEN CAST(array() AS array<{_ITEM}>) ELSE filter(flatten(transform({name}_b, (start, k) -> aggregate(
                sequence(k * {name}_w, least((k + 1) * {name}_w, size({name}_h)) - 1), named_struct('at', start, 'out', CAST(array() AS array<{_ITEM}>)),
                (a, i) -> named_struct('at', a.at + {name}_l[i], 'out', concat(a.out, array(named_struct(
                    's', a.at + {name}_p[i], 'e', a.at + {name}_l[i], 'r', {rank}, 'kind', '{kind}', 'v', {name}_g[i])))),
                a -> a.out))), x -> length(x.v) >= {least}) END"""
            ),
        ),
    ]


def _with_runs(df: DataFrame, gate: Column, name: str) -> DataFrame:
    """``df`` (text, base) with the runs outside the spans of ``base``, with their places; none where the gate is shut."""
    for step, column in _found(F.col("text"), "random", len(RULES), RUN, 1, MIN_RUN, gate, "_random"):
        df = df.withColumn(step, column)
    outside = F.when(F.size("base") == 0, F.col("_random")).otherwise(F.expr(f"filter(_random, x -> {OUTSIDE})"))
    return df.withColumn("stretches", F.expr(BOUNDED)).withColumn(name, outside).drop("stretches", *(f"_random{x}" for x in ("", "_h", "_g", "_p", "_w", "_l", "_b")))


def locate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document a number ``row`` (to be written before it is used twice), its text, its spans found by rule (``base``), and the values of its long runs outside them
    (``values``). Only where there are spans must the places of runs be known for that."""
    df = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    for rank, (kind, pattern, group, least, needs) in enumerate(RULES):
        for name, column in _found(F.col("text"), kind, rank, pattern, group, least, _gate(F.col("text"), needs), f"_{kind}"):
            df = df.withColumn(name, column)
    df = df.select(F.monotonically_increasing_id().alias("row"), id_column, "text", F.array_sort(F.concat(*(f"_{kind}" for kind, *_ in RULES))).alias("base"))
    df = _with_runs(df, F.size("base") > 0, "runs")
    return df.withColumn("values", F.when(F.size("base") > 0, F.col("runs.v")).otherwise(F.regexp_extract_all("text", F.lit(RUN), F.lit(1)))).drop("runs")


def coded(values: DataFrame) -> DataFrame:
    """Runs ``v`` with ``codes``, ``kind``, ``pattern`` of case (0 to 3) and number of ``letters``."""
    has = lambda p: F.col("v").rlike(p).cast("int")
    kind = has("[A-Za-z]") + 2 * has("[0-9]") + 4 * has("[^A-Za-z0-9]")
    hexadecimal = F.col("v").rlike("^[0-9a-f]+$") & (kind == 3)
    pattern = F.when(~F.col("v").rlike("[A-Z]"), 0).when(~F.col("v").rlike("[a-z]"), 1).when(~F.col("v").rlike("[A-Za-z][A-Z]"), 2).otherwise(3)
    return values.select(
        "v", F.expr(f"transform(transform(split(v, ''), c -> ascii(c)), x -> {CODE})").alias("codes"), F.when(hexadecimal, HEX).otherwise(kind).alias("kind"), pattern.alias("pattern"),
        F.length(F.regexp_replace("v", "[^A-Za-z]", "")).alias("letters"),
    )


def chains(runs: DataFrame, *keep_columns: str) -> DataFrame:
    """A row for each character of each run: ``t``, the number of it and the two before it."""
    before = lambda k: f"IF(i < {k}, {EDGE}, codes[i - {k}])"
    return runs.select(*keep_columns, F.explode(F.expr(f"transform(sequence(0, size(codes) - 1), i -> ({before(2)} * {CODES} + {before(1)}) * {CODES} + codes[i])")).alias("t"))


def _of_kind(code: Column, kind: Column) -> Column:
    """Whether strings of a kind may have the character."""
    some = ((code < DIGIT) & (kind.bitwiseAND(1) > 0)) | ((code == DIGIT) & (kind.bitwiseAND(2) > 0)) | ((code > DIGIT) & (code < EDGE) & (kind.bitwiseAND(4) > 0))
    return F.when(kind == HEX, (code < 6) | (code == DIGIT)).otherwise(some)


def train_ordinary(runs: DataFrame) -> DataFrame:
    """(t, ordinary): log P(character | the two before) for every ``t``, by absolute discounting. CODES ** 3 rows."""
    counts = keep(chains(runs.where(~F.col("v").rlike(MIXED))).groupBy("t").agg(F.count("*").alias("n")), "counts")
    spark, c = runs.sparkSession, F.col
    whole = lambda x, k: F.floor(F.col(x) / k)
    known = lambda n: F.coalesce(n, F.lit(0))
    less = F.greatest(known("n") - 1, F.lit(0))
    # All tables below have a fixed number of rows.
    pairs = counts.groupBy((c("t") % CODES**2).alias("p")).agg(F.sum("n").alias("n"))
    single = counts.groupBy((c("t") % CODES).alias("b")).agg(F.sum("n").alias("n1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    p1 = spark.range(CODES).select(c("id").alias("b")).join(F.broadcast(single), "b", "left").select("b", ((F.coalesce("n1", F.lit(0)) + PRIOR[0] / EDGE) / (total.scalar() + PRIOR[0])).alias("p1"))
    after = pairs.groupBy(whole("p", CODES).alias("a")).agg(F.sum("n").alias("na"), F.count("*").alias("ta"))
    p2 = spark.range(CODES**2).select(c("id").alias("p"), whole("id", CODES).alias("a"), (c("id") % CODES).alias("b"))
    p2 = p2.join(F.broadcast(pairs), "p", "left").join(F.broadcast(after), "a", "left").join(F.broadcast(p1), "b")
    p2 = p2.select("p", ((less + (known("ta") + PRIOR[1]) * c("p1")) / (known("na") + PRIOR[1])).alias("p2"))
    context = counts.groupBy(whole("t", CODES).alias("za")).agg(F.sum("n").alias("nz"), F.count("*").alias("tz"))
    p3 = spark.range(CODES**3).select(c("id").alias("t"), whole("id", CODES).alias("za"), (c("id") % CODES**2).alias("p"))
    p3 = p3.join(F.broadcast(counts), "t", "left").join(F.broadcast(context), "za", "left").join(F.broadcast(p2), "p")
    return keep(p3.select("t", F.log((less + (known("tz") + PRIOR[2]) * c("p2")) / (known("nz") + PRIOR[2])).alias("ordinary")), "ordinary")


def train_random(samples: DataFrame) -> DataFrame:
    """(kind, p, random): log P(character | the one before, kind) for every pair ``p``, half of it the even choice. KINDS * CODES ** 2 rows."""
    c = F.col
    pairs = chains(samples).where(F.floor(c("t") / CODES) % CODES != EDGE).groupBy((c("t") % CODES**2).alias("p")).agg(F.count("*").alias("n"))
    grid = samples.sparkSession.range(KINDS * CODES**2).select(F.floor(c("id") / CODES**2).cast("int").alias("kind"), (c("id") % CODES**2).alias("p"))
    grid = grid.withColumns({"a": F.floor(c("p") / CODES), "own": _of_kind(c("p") % CODES, c("kind"))}).join(F.broadcast(pairs), "p", "left")
    weight = F.when(c("p") % CODES == DIGIT, 10).otherwise(1)
    # One row for each kind and character before.
    sums = grid.where("own").groupBy("kind", "a").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.sum(weight).alias("size"))
    even = weight / c("size")
    drawn = F.when(c("all") > 0, F.coalesce("n", F.lit(0)) / c("all")).otherwise(even)
    return keep(grid.where("own").join(F.broadcast(sums), ["kind", "a"]).select("kind", "p", F.log(0.5 * drawn + 0.5 * even).alias("random")), "random")


def secrets_of(located: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The distinct runs ``v`` that are secrets by the models."""
    c = F.col
    runs = keep(coded(located.select(F.explode("values").alias("v")).distinct()), "runs")
    samples = keep(coded(located.select(F.explode("base.v").alias("v")).distinct()), "samples")
    plain = runs.where(~c("v").rlike(MIXED))
    if samples.isEmpty() or plain.isEmpty():
        return runs.limit(0).select("v")
    cases = plain.groupBy("pattern").agg(F.count("*").alias("n"))
    # Four rows.
    seen = {r.pattern: r.n for r in cases.collect()}
    spread = -c("letters") * log(2)
    case = reduce(lambda e, k: e.when(c("pattern") == k, -log((seen.get(k, 0) + 1) / (sum(seen.values()) + 4))), range(1, 4), F.when(c("pattern") == 0, -log((seen.get(0, 0) + 1) / (sum(seen.values()) + 4))))
    # Letters of both cases: random ones have either each; of ordinary runs only those without a pattern do.
    case = case + F.when(c("pattern") == 2, spread).otherwise(0.0)
    each = chains(runs, "v", "kind").withColumn("p", c("t") % CODES**2)
    each = each.join(F.broadcast(train_ordinary(runs)), "t").join(F.broadcast(train_random(samples)), ["kind", "p"])
    sums = each.groupBy("v").agg(F.sum(c("random") - c("ordinary")).alias("s"))
    ratio = c("s") + case - log(CHOICES)
    return keep(runs.select("v", "pattern", "letters").join(sums, "v").where(ratio > F.greatest(F.lit(LEAST), threshold * (F.length("v") - 1))).select("v"), "found")


def scan(located: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``located`` (a written table) with ``found``, the spans of the models, in place of text and values. Texts that hold no secret are not looked at again."""
    secrets = secrets_of(located, threshold)
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    runs = located.select("row", F.explode("values").alias("v"))
    # A secret that is copied very often is met by several tasks.
    some = runs.where(bloom.passing(runs, "v", bloom.cells(secrets, "v"))).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    hits = keep(some.join(secrets.select("v", spread), ["v", "salt"]).groupBy("row").agg(F.collect_set("v").alias("secrets")), "hits")
    maybe = bloom.passing(located, "row", bloom.cells(hits, "row"))
    none = F.expr(f"CAST(array() AS array<{_ITEM}>)")
    clear = located.where(~maybe).drop("text", "values").withColumn("found", none)
    met = _with_runs(located.drop("values").where(maybe).join(hits, "row", "left"), F.col("secrets").isNotNull(), "runs")
    found = F.filter("runs", lambda x: F.coalesce(F.array_contains(F.col("secrets"), x["v"]), F.lit(False)))
    return clear.unionByName(met.withColumn("found", found).drop("text", "runs", "secrets").select(clear.columns))


def redact(docs: DataFrame, threshold: float = THRESHOLD, mask: str = "<SECRET>") -> DataFrame:
    """The documents with all secrets found in ``text`` replaced; every other column stays."""
    tagged = docs.select(F.col("text"), F.struct("*").alias("_row"))
    located = keep(locate(tagged, "_row", "text"), "secrets")
    out = scan(located, threshold)
    cut = F.expr(
        f"""aggregate(array_sort(concat(base, found)), named_struct('at', 0L, 'out', ''), (a, x) -> CASE WHEN x.s < a.at
        THEN named_struct('at', greatest(a.at, x.e), 'out', a.out)
        ELSE named_struct('at', x.e, 'out', concat(a.out, substring(_row.text, CAST(a.at AS INT) + 1, CAST(x.s - a.at AS INT)), '{mask}')) END,
        a -> concat(a.out, substring(_row.text, CAST(a.at AS INT) + 1)))"""
    )
    return out.withColumn("_cut", cut).select(F.col("_row").withField("text", F.col("_cut")).alias("_row")).select("_row.*")


def report(located: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind, *_ in RULES]
    return located.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "found"))).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    located = keep(locate(docs), "secrets")
    return report(scan(located))
