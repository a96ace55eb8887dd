import hashlib
import random
import zlib

from quirework.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def expected(rows, arity):
    """Brute force: every row's leaf, subroot, root, proof and folded root, over explicit trees."""
    none_first = lambda v: (v is not None, v)
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)

    def tree(digests):
        steps, place = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, at in enumerate(place):
                a = at - at % arity
                steps[i].append((digests[a:at], digests[at + 1 : a + arity]))
                place[i] = at // arity
            digests = [h(*digests[a : a + arity]) for a in range(0, len(digests), arity)]
        return digests[0], steps

    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        groups[s].sort(key=lambda r: (none_first(r[0]), leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, upper = tree([trees[s][0] for s in keys])
    out = []
    for k, s in enumerate(keys):
        for row, steps in zip(groups[s], trees[s][1], strict=True):
            path = steps + upper[k]
            at = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                at = (*row[:4], ascii_lower(row[4]))
            folded = leaf(at)
            for before, after in path:
                folded = h(*before, folded, *after)
            proof = h(*("".join(b + a) for b, a in path))
            out.append((row[0], leaf(row), trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows, name, extra=""):
    schema = "doc_id long, source string, lang string, n_chars int, text string" + extra
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = manifest.op11_merkle_manifest(spark, f"{tmp_path}/{name}")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_hot_source_nulls_repeats_long_texts(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, "hot", "en", 3, rnd.choice(["Abc", "ABC é", "xyz", None, ""])) for i in range(700)]
    rows += [(1000 + i, f"s{i % 40}", None, None, f"Text {i}") for i in range(90)]
    rows += [(2000 + i, None, "de", i, "Ärger") for i in range(17)]
    rows += [(3000, "one", "fr", 1, "Lone Leaf"), (None, "hot", "en", 1, "No Id"), (None, None, None, None, None), (3001, "é", "es", 2, "Z" * 300_000), (5, "hot", "en", 3, "other Text of an id")]
    rows += [rows[7]] * 3
    assert run(spark, tmp_path, rows, "a") == expected(rows, 16)


def test_exact_powers_and_one_more(spark, tmp_path):
    for n in (1, 2, 16, 17, 256, 257):
        rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
        assert run(spark, tmp_path, rows, f"n{n}") == expected(rows, 16), n


def test_many_sources_one_document_each(spark, tmp_path):
    rows = [(i, f"s{i}", "en", 1, f"T{i}") for i in range(300)]
    assert run(spark, tmp_path, rows, "b") == expected(rows, 16)


def test_binary_tree(spark):
    rows = [(i, "s" if i % 3 else "t", "en", 1, f"T{i}") for i in range(23)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    made = manifest.build(df, arity=2)
    got = {r.doc_id: (bytes(r.leaf).hex(), bytes(r.subroot).hex(), [(bytes(x.before).hex(), bytes(x.after).hex()) for x in r.path]) for r in made.proofs.collect()}
    want = expected(rows, 2)
    assert {k: v[:2] for k, v in got.items()} == {r[0]: (r[1], r[2]) for r in want} and made.root == want[0][3]
    for start, _, path in got.values():
        for before, after in path:
            start = h(before, start, after)
        assert start == made.root


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert run(spark, tmp_path, [], "none") == []
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(40)]
    wide = [(*r, 9, "x", b"y", 1.0) for r in rows]
    assert run(spark, tmp_path, wide, "wide", ", leaf int, h string, `Path` binary, `a.b` double") == expected(rows, 16)
