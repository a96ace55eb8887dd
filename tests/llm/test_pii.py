import hashlib
import math
import random
import re
import string
from collections import defaultdict

from quirework.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(d)) % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.findall("[0-9]", m[0])) <= 15),
]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m)]


def run(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r for r in pii.op7_pii(spark, str(tmp_path)).collect()}


def test_rules_match_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    bits = ["a", "b.c", "@", "@", ".", "x-1", "1", "23", "255", "256", "007", " ", "-", "+", "(4", ")", "4041894974608795", "\n", "é", "😀", "a@b.c", "+1 (988) 555-2485", "1.2.3.4", "%"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(600)]
    texts += [None, "", "1" * 50_000, "a" * 50_000 + "@", "a@" * 5_000, "+1" * 5_000, "4041 8949 7460 8795", texts[3], texts[3]]
    got = run(spark, tmp_path, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t) if len(t or "") < 20_000 else None
        if want is not None:
            assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
            assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
            assert not set(want) - set(got[i].spans.split(",")) - {""}


def test_terms_that_disclose(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [f"{word()} {word()} please ask Zorbulon, at z.bul@mail.example.com about {word()}" for _ in range(6)]
    texts += [f"nothing of note about {word()} {word()} please ask" for _ in range(300)]
    texts += ["we met zorbulon there", "ask them about it please"]
    got = run(spark, tmp_path, texts)
    n = len(texts)
    at = texts[0].index("Zorbulon")
    assert f"term:{at}:{at + 8}" in got[0].spans and got[n - 2].spans == "term:7:15" and got[n - 1].spans == ""
    assert all(got[i].spans == "" for i in range(6, 306))
    # copies of one passage are one surrounding
    got = run(spark, tmp_path, [texts[0]] * 20 + texts[6:])
    assert all("term" not in r.spans for r in got.values())
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)] + [(None, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "Zorbulon" not in out[0].text and "<EMAIL>" in out[0].text and out[0].n_chars == len(out[0].text)
    assert "zorbulon" not in out[n - 2].text and out[n - 1].text == texts[n - 1] and out[None].text is None
    assert out[50].n_chars == 0 and pii.redact(docs).schema == docs.schema


def shuffled_bytes(spark):
    jvm, context = spark._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_redaction_shuffles_only_texts_with_sensitive_terms(spark):
    rnd = random.Random(8)
    filler = lambda n: " ".join("".join(rnd.choice(string.ascii_lowercase) for _ in range(9)) for _ in range(n))
    rows = [(i, filler(2000)) for i in range(400)]
    rows += [(1000 + i, f"{filler(30)}\nmail Quibbleton at q.x@mail.example.com {chr(97 + i)}{filler(3)}\n") for i in range(12)]
    rows += [(2000, f"{filler(10)} Quibbleton {filler(10)}"), (2000, f"{filler(10)} Quibbleton {filler(10)}"), (None, "so says Quibbleton"), (None, None), (2001, None), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled_bytes(spark)
    out = pii.redact(docs).collect()
    assert shuffled_bytes(spark) - before < 4_000_000  # the filter takes under 2 MB, the 400 long texts over 5 MB
    # Each row comes once, with its own text; those that name the term don't name it any more.
    plain = lambda found: sorted((str(i), t or "") for i, t in found if "Quibbleton" not in (t or ""))
    assert len(out) == len(rows) and not any("Quibbleton" in (r.text or "") for r in out)
    kept = [(str(r.doc_id), r.text or "") for r in out]
    for row in plain(rows):
        kept.remove(row)
    assert len(kept) == 15 and [t for i, t in kept if i == "None"] in (["so says "], ["so says <TERM>"])
    assert sum(r.text is None for r in out) == 2


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_hostile_texts(spark, tmp_path):
    texts = ["0" * 5000 + ".1.1.1", "+1 988 555 2485 ab cd " * 20_000, "1.2.3.4 " * 30_000, "word " * 200_000, "a@b.c" * 50_000]
    got = run(spark, tmp_path, texts)
    assert [got[0].n_ip, got[1].n_phone, got[2].n_ip, got[3].n_spans] == [1, 20_000, 30_000, 0] and got[4].n_email > 0


def test_planted_links_are_found(spark, tmp_path):
    rnd = random.Random(12)
    word = lambda n=5: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    common = [word() for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    people = [(word(9).capitalize(), f"{word(6)}@mail.example.com", f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}") for _ in range(30)]
    texts, holds = [], {}
    for name, mail, phone in people:
        digits = phone.replace("(", "").replace(")", "")
        for value in [(mail, mail.upper(), mail.title(), mail), (phone, digits, digits.replace(" ", "-"), phone)][len(holds) % 2]:
            texts.append(f"{prose(20)}\n{prose(2)} {name} at {value} {prose(3)}\n{prose(10)}")
        texts.append(f"{prose(12)} {name} was seen {prose(12)}")
        holds[len(texts) - 1] = name
    # Names that stand without data as often as with it, and text without any.
    neutral = [word(8) for _ in range(20)]
    for n in neutral:
        texts += [f"{prose(4)} {n} {prose(2)} x{rnd.randrange(10**6)}@mail.example.com {prose(3)}", *(f"{prose(10)} {n} {prose(10)}" for _ in range(3))]
    texts += [prose(40) for _ in range(600)]
    got = run(spark, tmp_path, texts)
    marked = {i: [texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in r.spans.split(",") if x.startswith("term")] for i, r in got.items()}
    names = {n for n, *_ in people}
    caught = sum(name in marked[i] for i, name in holds.items())
    terms = [t for x in marked.values() for t in x]
    assert caught >= 0.95 * len(holds) and sum(t in names for t in terms) >= 0.95 * len(terms) and not {*neutral} & {*terms}


def brute_terms(texts):
    """The spans of terms that disclose, by plain loops over all texts."""
    edge, word = string.punctuation, re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda x: "".join(c.lower() if c in string.ascii_uppercase else c for c in x)

    def found(text, s, e):
        for m in word.finditer(text, s, e):
            bare = m[0].strip(edge)
            at = m.start() + len(m[0]) - len(m[0].lstrip(edge))
            if len(bare.encode()) >= 3 and any(c.isalpha() for c in bare):
                yield lower(bare), at, at + len(bare)

    near, around, holders, df = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        text = text or ""
        spans = [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text) if ok(m)]
        for term, _, _ in found(text, 0, len(text)):
            df[term].add(i)
        for kind, s, e in spans:
            value = text[s:e].lower()
            entity = kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else ".".join(str(int(x)) for x in value.split(".")) if kind == "ip" else value
            left, right = text.rfind("\n", 0, s) + 1, (text + "\n").index("\n", e)
            before, after = list(word.finditer(text, left, s))[-5:], list(word.finditer(text, e, right))[:5]
            a, b = before[0].start() if len(before) == 5 else left, after[-1].end() if len(after) == 5 else right
            for term, x, y in [*found(text, a, s), *found(text, e, b)]:
                if not any(p < y and x < q for _, p, q in spans):
                    near[term, entity].add(i)
                    around[term, entity].add((text[a:s], text[e:b]))
                    holders[entity].add(i)
    marked = set()
    for (term, entity), docs in near.items():
        n = len(df[term])
        p = min(1, len(docs) / n)
        sure = (p + 1 / (2 * n) - math.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)
        if len(around[term, entity]) >= 2 and sure >= 0.5 and math.log2(sure * len(texts) / len(holders[entity])) >= 4:
            marked.add(term)
    return [[f"term:{s}:{e}" for term, s, e in found(t or "", 0, len(t or "")) if term in marked] for t in texts]


def test_spans_of_terms_match_brute_force(spark, tmp_path):
    rnd = random.Random(31)
    word = lambda n: "".join(rnd.choice("abcdefghijk") for _ in range(n))
    common = [word(4) for _ in range(60)] + ["Über", "naïve", "(x)", "it's", "of", "…", "7"]
    people = [(word(7).capitalize(), f"{word(5)}@mail.example.com") for _ in range(12)] + [(word(7), f"+1 (988) 555-{rnd.randrange(1000, 9999)}") for _ in range(6)] + [("Ängström", "10.0.7.1")]
    prose = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    texts = [prose(rnd.randrange(30)) for _ in range(250)]
    for _ in range(120):
        name, value = rnd.choice(people)
        texts.append(rnd.choice(["{0} {2}, ({1}) {0}", "{0}\n{1} {2} {0}", "{0} {1}; {0}", "{2} {0} {1}\n{0}", "{1}:{2}"]).format(prose(rnd.randrange(9)), name, value))
    texts += [None, "", *texts[250:270]]
    got = run(spark, tmp_path, texts)
    want = brute_terms(texts)
    assert [[x for x in got[i].spans.split(",") if x.startswith("term")] for i in range(len(texts))] == want
    assert sum(map(len, want)) > 30 and any(not x for x in want[250:])
