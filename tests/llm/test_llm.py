"""Training-data operators against brute force, round trips and edge cases on small tables."""

import base64
import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cubeflux.llm import bm25, html_text, line_dedup, mixing, mpeg_audio, near_dup, packing, queries, token_files, toxicity, warc
from cubeflux.llm.common import likely_members
from cubeflux.llm.fasttok import ChunkEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, extra string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(9000))
    rows = [(1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (3, None), (4, ""), (5, " \n\t"), (6, "one"), (7, long), (8, long + " tail"), (9, "a b c d e f g h i j"), (9, "a b c d e f g h i j"), (10, "x y\nx y\nq r s t u v\nq r s t u v w"), (None, "a b c d e f g h i j"), (11, "漢字 é <|endoftext|> b c")]
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else "s", 1, 0.5, "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, size, num):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            k = len(sets[a] & sets[b])
            if 100 * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in d.collect()], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(d, 3, 85).collect()}
    assert got == want


def test_near_duplicates_edge_cases(odd, none):
    got = collections.defaultdict(list)
    for r in near_dup.near_duplicates(odd, 3, 85).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[2] == [(8, 1, False)] and got[1] == [(8, 1, True)] and got[9] == [(8, 1, False)] * 2
    assert got[3] == [(0, 3, True)] and got[5] == [(0, 5, True)] and got[6] == [(1, 6, True)]
    assert got[None] == [(8, 1, False)] and got[8][0][1] == 7
    assert near_dup.near_duplicates(none).count() == 0


def test_large_nodes_and_clusters_are_split(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(d, 3, 85, limit=8, depth=2, block=10).collect()}
    assert got == brute_components(rows, 3, 85)


def test_large_clusters_with_parts_and_strays(spark):
    rows = []
    for g in range(3):  # chains: each document is like the next few, not like far ones
        words_ = [f"g{g}w{i}" for i in range(400)]
        rows += [(100 * g + k, " ".join(words_[2 * k : 2 * k + 100])) for k in range(40)]
    rows += [(1000 + k, " ".join([f"s{k}x{i}" for i in range(60)])) for k in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(d, 3, 85, limit=8, depth=1, block=6, margin=12.0).collect()}
    assert got == brute_components(rows, 3, 85)


def brute_lines(rows, num=80):
    seen, out = [], {}
    for i, t in sorted(rows):
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(words(line))
            if w and any(100 * len(w & s) >= num * len(w | s) for s in seen):
                gone.append(k)
            if w:
                seen.append(w)
        out[i] = gone
    return out


def test_line_dedup_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for r in line_dedup.dedup_lines(d).collect():
        assert list(r.removed) == want[r.doc_id]
        lines = (dict(rows)[r.doc_id] or "").split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in want[r.doc_id])


def test_line_dedup_blocks_of_frequent_words(spark, monkeypatch):
    rows = [(i, f"a b c d e f g h i {i % 7} {i % 11}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    assert {r.doc_id: list(r.removed) for r in line_dedup.dedup_lines(d).collect()} == brute_lines(rows)


def test_line_dedup_edge_cases(odd, none):
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(odd).collect():
        got[r.doc_id].append((r.text, list(r.removed)))
    assert got[3] == [(None, [])] and got[4] == [("", [])] and got[5] == [(" \n\t", [])]
    assert got[10] == [("x y\nq r s t u v", [1, 3])] and got[9] == [("", [0])] * 2 and got[None] == [("", [0])]
    assert line_dedup.dedup_lines(none).count() == 0


def test_chunk_encoder_equals_library():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    alphabet = [*"ab Zé \n\t  .,'s0%|<>#", "<|endoftext|>", " ", "ñ", "漢", "é", " ", "'ll", "İ", "ß", "\x1c"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(3000)] + ["", None]
    for name in (queries.BYTE_BPE, queries.WORD_BPE):
        path = queries.tokenizer_path(name)
        ids, offs = ChunkEncoder(path).encode(pa.array(texts))
        tok = Tokenizer.from_file(path)
        for i, t in enumerate(texts):
            assert ids[offs[i] : offs[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_token_files_round_trip(odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BYTE_BPE)
    tok = Tokenizer.from_file(path)
    rows = [(r.doc_id, np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in odd.collect()]
    got = sorted(token_files.token_files(odd, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), zlib.crc32(x)) for i, x in rows)
    assert token_files.token_files(none, path).count() == 0


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(odd, none, spark, sf):
    path = queries.tokenizer_path(queries.WORD_BPE)
    assert packing.pack(none, path).count() == 0
    check_packing(packing.pack(odd, path).collect(), 4096)
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), path).collect()
    assert check_packing(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_pieces_equal_the_library(odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_BPE)
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in odd.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096])] += 1
    got = packing.pack(odd.withColumns({"length": F.lit(1), "piece": F.lit("p"), "pid": F.lit(2)}), path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


@pytest.mark.parametrize("seed", range(4))
def test_nnls_is_optimal_and_patterns_place_most(seed):
    rng = np.random.default_rng(seed)
    classes = 32
    pats = packing.patterns(classes)
    assert all(sum(p) == classes and min(p) > 0 for p in pats) and len(set(pats)) == len(pats)
    a = np.array([np.bincount(p, minlength=classes + 1)[1:] for p in pats], float).T
    b = rng.poisson(300 * np.exp(-np.arange(classes) / (3 + 2 * seed))).astype(float)
    w = 1 / np.sqrt(np.maximum(b, 1))
    x = packing.nnls(a, b, w)
    gain = (a * w[:, None]).T @ (w * (b - a @ x))
    assert (x >= 0).all() and gain.max() < 1e-4 and np.abs(gain[x > 0]).max() < 1e-4 and (x > 0).sum() <= classes
    assert (a @ np.floor(packing.PATTERNED * x)).sum() > 0.8 * b.sum()


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.exponential(60 * (seed + 1), 3000).astype(int) + 1, 1, 512)
    hist = np.bincount(lengths, minlength=513)
    rows, used = packing.plan(hist, 512, 64)
    assert (np.bincount(rows[:, 0], weights=rows[:, 2], minlength=513) == hist).all()
    assert used <= -(-lengths.sum() // 512) * 1.02 + 2


def test_mpeg_round_trip(odd, none):
    odd = odd.withColumns({"media": F.lit("m"), "feature": F.lit(1), "payload": F.lit(b"x")})
    want, got = collections.Counter(), collections.Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        want[r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    media = {}
    for r in mpeg_audio.media_columns(odd).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32] += 1
        assert "0bad" in r.feature and r.duration_us == r.n_frames * 24000
        assert media.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    for text in ("", "hello " * 500):
        payload, n = mpeg_audio.padded(text)
        data = mpeg_audio.encode(payload, n)
        if not text:
            assert media[hashlib.sha256(bytes(64)).hexdigest() + "0"][:2] == (len(data), hashlib.sha256(data).hexdigest())
    assert got == want and mpeg_audio.media_columns(none).count() == 0


def test_mpeg_reader_resynchronises_and_verifies():
    payload, n = mpeg_audio.padded("hello " * 1000)
    data = mpeg_audio.encode(payload, n)
    clean = mpeg_audio.decode(data)
    assert mpeg_audio.payload_of(data, clean) == (payload, n) and clean.vbr["frames"] == len(clean.offsets)
    assert clean.vbr["bytes"] == len(data) - clean.tag_bytes and not clean.junk
    at = clean.offsets[2]
    broken = data[:at] + b"\xff\xfbjunk\xff" + data[at:] + b"TAG" + bytes(125)
    s = mpeg_audio.decode(broken)
    assert s.id3v1 and len(s.offsets) == len(clean.offsets) and s.junk == 7
    flipped = bytearray(data)
    flipped[at + 10] ^= 1
    assert mpeg_audio.decode(bytes(flipped)).crc_bad == 1


def test_mpeg_reader_drops_a_cut_frame_and_keeps_the_next():
    payload, n = mpeg_audio.padded("hello " * 1000)
    data = mpeg_audio.encode(payload, n)
    clean = mpeg_audio.decode(data)
    for k in range(1, len(clean.offsets) - 1):
        at = clean.offsets[k]
        s = mpeg_audio.decode(data[: at + 100] + data[at + 130 :])
        assert len(s.offsets) == len(clean.offsets) - 1 and at not in s.offsets and s.junk == clean.offsets[k + 1] - at - 30
    assert clean.samples == 1152 * len(clean.offsets) and clean.rate == 48000


def test_warc_chain_rejects_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "a"), (2, "u", fake), (3, "u", "a"), (4, None, None), (5, "u", ""), (6, "u", "x" * 70000 + fake * 20), (None, "u", "a"), (8, "u\r\nX: y", "a")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, k in rows if j is not None and (k or "") == (h or ""))
        want[i] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
    for split in (9000, 1 << 20):
        got = warc.warc(d, split).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
        assert all(r.block_ok for r in got)
    assert warc.warc(d.filter("false")).count() == 0


def test_warc_survives_false_headers(spark):
    head = "WARC/1.1\r\nContent-Length: "
    odd = [f"{head}\u00b2\r\n\r\nx", f"{head}{'9' * 5000}\r\n\r\n", f"{head}-1\r\n\r\n", f"{head}999999999999999999\r\n\r\n", head, "WARC/1.1\r\n" * 20000, f"{head}4\r\n\r\nabcd\r\n\r\n" * 50]
    rows = [(i, "u" * (300_000 if i == 1 else 3), h) for i, h in enumerate(odd)] + [(50, None, odd[0])]
    got = {r.page_id: r for r in warc.warc(spark.createDataFrame(rows, "page_id long, url string, html string"), 7000).collect()}
    for i, _, h in rows:
        raw = h.encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), warc.sha1_base32(raw)) and got[i].block_ok
    assert got[50].refers_to == 0 and len(got) == len(rows)
    many = b"WARC/1.1\r\n" * 20000
    started = time.monotonic()
    assert warc._candidates(many, 0, len(many), len(many)) == {} and time.monotonic() - started < 1


def test_warc_extra_columns_and_repeated_ids(spark):
    d = spark.createDataFrame([(1, "u", "a", "x", 1), (1, "v", "a", "y", 2), (None, "u", "b", "z", 3), (None, "u", "b", "z", 4)], "page_id long, url string, html string, digest string, `first` long")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.warc(d).collect())
    assert got == [(0, "response", None), (0, "response", None), (1, "response", None), (1, "response", None)]


def test_html_text(spark):
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a>Menu</a></ul></nav><div class='ad'>Buy this now, it is a very long advert text for you</div><article><h1>Head &amp; line</h1><p><b>First&nbsp; para<br>more.<p>Second</p></article><div id='comments'><p>nice</p></div><footer>foot</footer></body></html>"
    assert html_text.extract(page) == "Head & line\n\nFirst para more.\n\nSecond"
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("plain &lt; text") == "plain < text"
    noart = "<body><div class='menu'><a>x</a></div><div><p>" + "word " * 40 + "</p><p>short</p></div><div class='sidebar'>side</div></body>"
    assert html_text.extract(noart) == ("word " * 40).strip() + "\n\nshort"
    d = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract_pages(d).collect()} == {1: len("Head & line") + 2 + len("First para more.") + 2 + len("Second"), 2: 0}


def test_html_keeps_what_only_sounds_like_a_role():
    long = ("word " * 40).strip()
    for name in ("social-history", "related-work"):
        assert html_text.extract(f"<body><article><p>{long}</p><div class='{name}'><p>{long} b</p></div></article></body>") == f"{long}\n\n{long} b"
    assert html_text.extract(f"<body><nav><a href='/'>Home</a><article><p>{long}</p></article></body>").endswith(long)
    assert html_text.extract(f"<body><nav><a href='/'>Home</a></nav><article><p>{long}</p></article><footer><p>{long}</p></footer></body>") == long


def test_html_work_is_linear():
    long = ("word " * 40).strip()
    for page in ("<div>" * 20000 + "</p>" * 20000, "<p><article>" + "<div>" * 20000 + "</p>" * 20000, "<div class='sidebar'>" * 20000 + "<article>" * 50, "<nav>" * 20000):
        started = time.monotonic()
        html_text.extract(page + f"<p>{long}</p>")
        assert time.monotonic() - started < 2


def test_html_pages_edge_cases(spark):
    d = spark.createDataFrame([(1, None, None, "x"), (1, None, "<p>a b</p>", "y"), (None, "u", "<p>" + "a b " * 50000 + "</p>", "z")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html_text.extract_pages(d).collect()), key=str)
    assert got == [(1, None, 0), (1, None, 3), (None, "u", 199999)] and html_text.extract_pages(d.filter("false")).count() == 0


def test_html_regions_follow_the_ratio():
    long = "word " * 40
    card = f"<body><article><p>Card text</p></article><div><p>{long}</p><p>{long}</p><p>end</p></div></body>"
    assert html_text.extract(card) == "\n\n".join([long.strip(), long.strip(), "end"])
    links = "".join(f"<li><a href='/{i}'>See {i}</a></li>" for i in range(6))
    assert html_text.extract(f"<body><article><h1><a>Head</a></h1><p>{long}</p><p>{long}</p><ul>{links}</ul><p>end</p></article></body>") == "\n\n".join(["Head", long.strip(), long.strip(), "end"])

def test_html_class_words_do_not_drop_the_page():
    text = "word " * 40
    side = "<div class='left-sidebar'><p>side</p></div><div id='comments'><article class='comment'><p>nice</p></article></div>"
    for head in ("<div class='layout with-sidebar'><article>", "<div><article class='post comments-open'>", "<div class='content related-enabled'><article>", "<div class='widgets'><article>", "<div class='content'><article class='related'>", "<div class='sidebar'>"):
        close = "</article></div>" if "<article" in head else "</div>"
        assert html_text.extract(f"<body>{head}<p>{text}</p><p>end</p>{close}{side}</body>") == text.strip() + "\n\nend", head
    card = f"<body><div><p>{text}</p><p>{text}</p></div><div class='sidebar'><article><p>{text[:60]}</p></article></div></body>"
    assert html_text.extract(card) == text.strip() + "\n\n" + text.strip()


def test_bm25_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: collections.Counter(words(r.text)) for r in d.collect()}
    n, length = len(rows), {i: sum(c.values()) for i, c in rows.items()}
    mean = sum(length.values()) / n
    df = collections.Counter(w for c in rows.values() for w in c)
    got = collections.defaultdict(list)
    for r in bm25.top_k(d, d.filter("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    for q in (i for i in rows if i % 20 == 0):
        score = {i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w in rows[q] if w in c) for i, c in rows.items() if i != q}
        want = sorted((i for i in score if score[i] > 0), key=lambda i: (-round(score[i], 6), i))[:10]
        assert got[q] == want


def test_bm25_edge_cases(odd, none):
    assert bm25.top_k(none, none).count() == 0
    ids = {r.doc_id for r in bm25.top_k(odd, odd.filter("doc_id = 1")).collect()}
    assert ids == {2, 9}


def test_mixing_meets_marginals(spark, sf, odd, none):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cells = mixing.rake(mixing.prepared(d).groupBy(*(F.col(f"_{x}").alias(x) for x in mixing.DIMS)).agg(F.sum("_tokens").alias("tokens")), rounds=40)
    for dim in mixing.DIMS:
        for r in cells.groupBy(dim).agg(F.sum("w").alias("w"), F.first(f"{dim}_share").alias("s"), F.first("total").alias("t")).collect():
            assert r.w == pytest.approx(r.s * r.t, rel=0.02)
    m = mixing.mix(d).agg(F.sum(F.col("probability") * F.col("mix_tokens")).alias("e"), F.sum("mix_tokens").alias("t"), F.max("probability").alias("m")).first()
    assert m.e == pytest.approx(0.5 * m.t, rel=1e-6) and m.m <= 1
    out = mixing.mix(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert mixing.mix(none).count() == 0

def test_mixing_exact_probabilities_meet_the_targets(spark, sf, odd, none):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(d, exact=True).withColumns({"e": F.col("probability") * F.col("mix_tokens"), "source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit(""))}).cache()
    all_ = out.agg(F.sum("e").alias("e"), F.sum("mix_tokens").alias("t"), F.max("probability").alias("m"), F.min("probability").alias("l")).first()
    assert 0 < all_.l and all_.m <= 1 and 0.01 < all_.e / all_.t <= 0.5
    for dim, col in (("source", "source"), ("lang", "lang"), ("topic", "mix_topic")):
        rows = out.groupBy(col).agg(F.sum("e").alias("e"), F.sum("mix_tokens").alias("t")).collect()
        raised = sum(r.t ** mixing.POWERS[dim] for r in rows)
        for r in rows:
            assert r.e / all_.e == pytest.approx(r.t ** mixing.POWERS[dim] / raised, rel=0.02, abs=1e-9), (dim, r)
    assert mixing.mix(odd, exact=True).count() == odd.count() and mixing.mix(none, exact=True).count() == 0


def test_toxicity_held_out(spark, sf, odd, none):
    rng = np.random.default_rng(0)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base, 40))
        if i % 3 == 0:
            for k in rng.integers(0, 40, 4):
                w[k] = rng.choice(["blargh", "snorfle", "gribbit"])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    held = [r for r in out.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.9 * len(held)
    model = toxicity.fit(d, y)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and scored.filter("score is null").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, y.filter("false")).collect()} == {0.0}

def test_toxicity_windows_hold_every_byte():
    rng = np.random.default_rng(5)
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        text = "".join(rng.choice(list("abcdé1 "), n))
        data, pieces = text.encode(), toxicity.windows(text)
        assert bool(pieces) == bool(data) and all(len(p) == min(len(data), toxicity.WIDTH) for p in pieces)
        for k in range(len(data) - 16):
            assert any(data[k : k + 17] in p for p in pieces)


def test_toxicity_sees_a_term_anywhere():
    plain = "the house and garden by the window in the street was cold in winter and warm in summer " * 40
    toxic = [toxicity.windows(plain[k : k + 200] + " blarghous snorflegrib " + plain[k : k + 90]) for k in range(0, 300, 7)]
    model = toxicity.dictionaries([w for t in toxic for w in t], [w for k in range(0, 300, 7) for w in toxicity.windows(plain[k : k + 300])])
    scorer = toxicity.Scorer(model)
    for at in range(0, 1000, 61):
        text = plain[:at] + " snorflegrib " + plain[at:]
        assert scorer.features(text)[-2] > scorer.features(plain)[-2], at


def test_membership_filter_loses_no_row(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    ids = spark.range(0, 5000, 7)
    got = {r.k for r in likely_members(rows, ids).collect()}
    assert {*range(0, 5000, 7)} <= got and len(got) < 800


def test_pipeline_stages_keep_columns_and_clean_rows(spark, sf, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    clash = odd.withColumns({c: F.lit(7) for c in ("predicted", "n_lines", "removed", "sampled", "probability", "row", "kept")})
    docs = clash
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf)
        rows = out.collect()
        assert out.columns == clash.columns, name
        assert all((r.score, r.predicted, r.n_lines, r.removed, r.sampled, r.probability) == (0.5, 7, 7, 7, 7, 7) for r in rows), name
        assert stage(spark, none, sf).count() == 0 and stage(spark, none, sf).columns == none.columns
        if name in ("toxicity", "line dedup"):
            assert len(rows) == docs.count(), name
        if name == "near-duplicates":
            assert sorted(r.doc_id for r in rows) == [1, 3, 4, 5, 6, 7, 10, 11]
    assert pipeline.STAGES[-1][1](spark, none, sf).count() == 0


def test_pipeline_runs(spark, sf, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.filter("doc_id < 60").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    check_packing(rows, 4096)
    assert rows and {r.doc_id for r in rows} <= set(range(60))
