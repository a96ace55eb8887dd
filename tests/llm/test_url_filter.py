import random

from quirework.llm import url_filter as uf


def brute(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    cut = min([url.find(c) for c in "?#" if c in url], default=None) if url and "://" in url else None
    return host, path, None, "block" if cut is not None and url[:cut] in listed else "allow"


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "http://org/", "http://org", "http://xorg/", "http://a.com?x=/fr/", "x://y://b.com/de/z", "http://É.org/#f", "http://a.org/en/1"]
    for _ in range(500):
        urls.append(rnd.choice(["http", "https"]) + "://" + rnd.choice(["a.", "b.c.", "", "X."]) + rnd.choice(["example.org", "example.com", "example.net", "forg", "com"]) + rnd.choice(["", "/", "/es/", "/en/1", "/en/12", "/fr/", "/de/", "/de"]) + rnd.choice(["", "7", "/x"]) + rnd.choice(["", "", "?q=1", "#top", "?a#b"]))
    urls += urls[:5] * 2
    spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, rule string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    listed = {u for u in urls if u is not None and "?" not in u and "#" not in u}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: brute(u, uf.RULES, listed) for i, u in enumerate(urls)}
    assert {v for *_, rule, v in got.values() if rule is None} == {"allow", "block"}


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(uf, "digests", lambda strings: uf.np.array([len(s) for s in strings], uf.np.uint64))
    array = uf.DigestArray(["aa", "bb", "ccc", "aa"], str(tmp_path))
    assert [None if j < 0 else array.keys[j] for j in array.probe(["aa", "bb", "xx", "ccc", "dddd", ""])] == ["aa", "bb", None, "ccc", None, None]
    assert (uf.DigestArray([], str(tmp_path)).probe(["a"]) == -1).all()


def test_shards_and_empty(spark):
    df = spark.range(300).selectExpr("concat('http://h/', id) AS url")
    assert uf.on_list(df, df.where("url LIKE '%7%'"), rows=10).count() == df.where("url LIKE '%7%'").count()
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.filter_urls(empty, uf.RULES, empty).count() == 0


def test_long_hosts(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 500_000 + "example.org/es/" + "x" * 1000), (2, "http://" + "." * 1000 + "com/de/")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in uf.filter_urls(df, uf.RULES, df).collect()} == {1: ("example.org/es/", "block"), 2: ("com/de/", "block")}
