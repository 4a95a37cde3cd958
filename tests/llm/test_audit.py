"""Divergence audit, Merkle manifest and decontamination against brute force, DuckDB and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cubeflux.llm import decontamination, divergence, merkle, queries

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, p double, tree string, term string, n long, salt int, items string"
TABLES = ("documents", "benchmark")


def frame(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0.5, "t", "x", 3, 1, "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(9000))
    texts = ["a b c d e f g h i j k", "A B c d e f g h i j", None, "", " \n\t", "one", long, long + " TAIL", "É é 漢字 ÀB", "a b c d e f g h i j k"]
    out = [(i, t, None if i % 4 == 0 else "en" if i % 3 else "", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[1], (1, "another of this id", "en", "s1", None), (None, "A b c d e f g h i j k", "en", "s2", 3), (None, None, None, None, None)]


@pytest.mark.parametrize("name", ["op11_merkle", "op12_divergence", "op13_decontamination"])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The top of a tree, and of each node the (left, right) siblings, lowest first."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, at in enumerate(place):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            place[k] = at // 8
        level = [sha(*level[a : a + 8]) for a in range(0, len(level), 8)]
    return level[0], paths


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, subroots = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r[:5])))
        top, paths = climb([leaf_of(*r[:5]) for r in own])
        trees.append((own, paths))
        subroots.append(top)
    root, above = climb(subroots)
    out = []
    for k, (own, paths) in enumerate(trees):
        for r, path in zip(own, paths, strict=True):
            leaf = leaf_of(*r[:5])
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf_of(r[0], None if r[1] is None else r[1].translate(LOWER), *r[2:5]) if tampered else leaf
            proof = ""
            for a, b in [*path, *above[k]]:
                fold, proof = sha(a, fold, b), proof + a + b
            out.append((r[0], leaf, subroots[k], root, sha(proof), fold, fold == root))
    return sorted(out, key=repr)


def made(spark, rows):
    return sorted(map(tuple, merkle.manifest(frame(spark, rows)).collect()), key=repr)


def test_manifest_of_odd_rows(spark, rows):
    assert made(spark, rows) == brute_manifest(rows)
    assert made(spark, []) == []
    assert made(spark, rows[:1]) == brute_manifest(rows[:1])


def test_manifest_of_trees_over_several_buckets(spark):
    """Buckets of 8 leaves, so that trees of 1, 8, 9, 64, 65 and 600 leaves cross them."""
    rows, k = [], 0
    for lang, n in (("a", 1), ("b", 8), ("c", 9), (None, 64), ("é", 65), ("Z", 600)):
        for _ in range(n):
            rows.append((k, f"Text {k}", lang, None, k))
            k += 1
    random.Random(1).shuffle(rows)
    got = sorted(map(tuple, merkle.manifest(frame(spark, rows), levels=1).collect()), key=repr)
    assert got == brute_manifest(rows)


def test_manifest_tells_tampering_apart(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(100)]
    got = {r.doc_id: r for r in merkle.manifest(frame(spark, rows)).collect()}
    for i, r in got.items():
        assert r.verified == (not (zlib.crc32(str(i).encode()) % 3 == 0 and i % 2 == 1))


def test_one_key_in_a_third_of_the_rows(spark):
    """Equal rows of one id and language are numbered like any others."""
    rows = [(7, "same", "en", "s", 4)] * 400 + [(i, f"T{i}", "en", "s", 1) for i in range(800)]
    assert made(spark, rows) == brute_manifest(rows)


# Divergence


def brute_divergence(rows, least, top):
    docs = [(r[2] or "", r[3] or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, total = collections.Counter(), collections.Counter()
        groups = {d[1]: collections.Counter() for d in docs if d[0] == lang}
        for kind, source, words in docs:
            if kind == lang:
                held.update(set(words))
                groups[source].update(words)
        kept = sorted(t for t, n in held.items() if n >= least)
        for c in groups.values():
            for t in kept:
                total[t] += c[t]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in groups:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, **kw):
    df = divergence.divergence(frame(spark, rows), **kw)
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_of_odd_rows(spark, rows):
    for least in (1, 2, 10):
        assert audited(spark, rows, least=least, top=3) == brute_divergence(rows, least, 3)
    assert audited(spark, []) == []


def test_divergence_with_a_hot_source(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "Été", "x1y", "_z", "Ab"]) for _ in range(rng.randrange(12))), rng.choice(["en", "fr"]), "hot" if i % 3 else f"s{i % 7}", 1) for i in range(400)]
    assert audited(spark, rows) == brute_divergence(rows, 10, 10)


def test_shares_of_counts_past_longs(spark):
    n, total, v = 10**13, 3 * 10**13, 5 * 10**9
    df = spark.createDataFrame([(n, total, v), (9 * 10**9 - 1, total, v), (9 * 10**9, total, v)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (k + 2) // (total + 2 * v) for k in (n, 9 * 10**9 - 1, 9 * 10**9)]


# Decontamination


def words_in(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(docs, items, size):
    where = collections.defaultdict(set)
    for i, t in items:
        w = words_in(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            where[tuple(w[k : k + size])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words_in(t)
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in where}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in where:
                    hit[k : k + n] = [True] * n
                    found |= where[tuple(w[k : k + n])]
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return sorted(out, key=repr)


ITEMS = "item_id long, text string, doc_id string, file string"


def searched(spark, docs, items, size=10):
    df = decontamination.contamination(frame(spark, docs), spark.createDataFrame([(*x, "a", "b") for x in items], ITEMS), size)
    return sorted(map(tuple, df.drop("items").collect()), key=repr)


def test_contamination_of_odd_rows(spark, rows):
    items = [(1, "b c d e f g h i j k"), (2, "A-B c"), (3, None), (4, "..."), (5, "one"), (5, "é 漢字"), (None, "h i j k"), (12, "w1x1 w2x2"), (6, "zz"), (7, " ".join(f"w{i % 997}x{i % 31}" for i in range(500, 530)))]
    for size in (2, 3, 10):
        assert searched(spark, rows, items, size) == brute_contamination([r[:2] for r in rows], items, size)
    assert searched(spark, rows, []) == brute_contamination([r[:2] for r in rows], [], 10)
    assert searched(spark, [], items) == []


def test_contamination_of_few_words(spark):
    """Few words, so that lists are long and phrases overlap."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(300)]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(9)))) for i in range(60)]
    assert searched(spark, docs, items, 5) == brute_contamination([d[:2] for d in docs], items, 5)


def test_a_phrase_that_a_third_of_the_documents_share(spark):
    line = "this line stands in every third document of the whole table"
    docs = [(i, f"start {i} {line} end" if i % 3 == 0 else f"other {i}", "en", "s", 1) for i in range(900)]
    got = searched(spark, docs, [(1, line), (2, line + " end")])
    assert got == brute_contamination([d[:2] for d in docs], [(1, line), (2, line + " end")], 10)


def test_searches_of_one_segment_against_brute_force():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(30)]
    seg = decontamination.Segment(decontamination._pack(**decontamination.index(np.arange(30), np.ones(30, bool), pa.array(texts))))
    queries_ = ["a b", "c d e", "h", "a a", "b z"]
    raw = decontamination._pack(**decontamination.index(np.arange(5), np.ones(5, bool), pa.array(queries_)))
    assert seg.length == sum(len(t.split()) + 1 for t in texts) and raw
    names = {t: k for k, t in enumerate(sorted({w for t in texts for w in t.split()}, key=lambda w: int(decontamination.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])))}
    for within in (2, 3, 6):
        for q in queries_:
            term = np.array([names.get(w, -1) for w in q.split()])
            start, end = seg.near(term, within)
            got = set()
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                d = int(np.searchsorted(seg.docs, a, side="right")) - 1
                got.add((d, a - int(seg.docs[d]), b - int(seg.docs[d])))
            want = set()
            for d, t in enumerate(texts):
                w, need = t.split(), set(q.split())
                fits = [(a, b) for a in range(len(w)) for b in range(a, min(a + within, len(w))) if need <= set(w[a : b + 1])]
                want |= {(d, a, b) for a, b in fits if not any((c, e) != (a, b) and a <= c and e <= b for c, e in fits)}
            assert got == want, (within, q)


def test_proximity_over_a_table(spark):
    docs = [(1, "the red old fox ran", "en", "s", 1), (2, "fox and a very long way to the red", "en", "s", 1), (None, "Red! Fox?", "en", "s", 1), (4, None, "en", "s", 1)]
    got = decontamination.proximity(frame(spark, docs), spark.createDataFrame([("q", "fox red"), ("n", "absent fox")], "id string, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "q", 1, 3), (None, "q", 0, 1)], key=repr)
