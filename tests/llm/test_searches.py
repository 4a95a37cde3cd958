"""BM25 on equal rows and shared ids; packing on lengths of every kind with the production classes; pages in forms."""

import collections
import math
import time

import numpy as np
import pytest

from cubeflux.llm import bm25, html_text, packing

DOCS = "doc_id long, text string"


def brute(rows, queries, k=10):
    """Ids by rank of each query id; the words of all its rows are one query."""
    docs = [(i, collections.Counter(t.split())) for i, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = collections.Counter(w for _, c in docs for w in c)
    asked = collections.defaultdict(set)
    for i, t in queries:
        asked[i] |= set(t.split())
    out = {}
    for q, words in asked.items():
        score = [(round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(words) if w in c), 6), i) for i, c in docs if i != q]
        out[q] = [(i, s) for s, i in sorted(score, key=lambda z: (-z[0], z[1])) if s > 0][:k]
    return out


def found(spark, rows, queries):
    out = collections.defaultdict(list)
    for r in bm25.top_k(spark.createDataFrame(rows, DOCS), spark.createDataFrame(queries, DOCS)).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.doc_id, pytest.approx(r.score, abs=2e-6)))
    return out


def test_equal_rows(spark):
    """No word is rare in any shard."""
    rows = [(i, "alpha beta gamma") for i in range(20)]
    assert found(spark, rows, rows[:1]) == brute(rows, rows[:1])
    assert found(spark, rows, rows) == brute(rows, rows)


def test_rows_that_share_an_id_are_one_query(spark):
    """With words that are rare and words that are not."""
    rows = [(i, f"common word{i % 5} rare{i} other" if i % 2 else f"common word{i % 3}") for i in range(60)]
    asked = [(7, "common rare7 word1"), (7, "common rare7 rare9"), (400, "rare11 other"), (400, "rare11")]
    assert found(spark, rows, asked) == brute(rows, asked)


@pytest.mark.parametrize(("low", "high", "n"), [(1, 16, 500_000), (5, 60, 1_000_000), (33, 200, 300_000), (1, 500, 200_000), (300, 900, 100_000), (1, 4096, 50_000), (1, 1, 10_000)])
def test_sequences_are_near_the_bound_for_any_lengths(low, high, n):
    hist = np.bincount(np.random.default_rng(0).integers(low, high + 1, n), minlength=4097)
    rows, used = packing.plan(hist, 4096)
    assert (np.bincount(rows[:, 0], weights=rows[:, 2], minlength=4097) == hist).all()
    assert used <= -(-int((hist * np.arange(4097)).sum()) // 4096) * 1.005 + 1


def test_patterns_place_long_pieces():
    hist = np.bincount(np.random.default_rng(0).integers(300, 900, 100_000), minlength=4097)
    assert packing.plan(hist, 4096)[1] < packing._plan(hist.astype(np.int64), 4096, 128, 129)[1]


LONG = "This is a long paragraph of the article, with many words in it and no tags at all between them. " * 3


@pytest.mark.parametrize("page", ["<form>{}</form>", "<form><div>{}</div></form>", "<form><article>{}</article></form>", "<form><fieldset><main>{}</main></fieldset></form>"])
def test_a_page_in_a_form_keeps_its_text(page):
    text = html_text.extract("<body>" + page.format(f"<p>{LONG}</p><p>{LONG}</p>") + "</body>")
    assert text == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_other_forms_go():
    article = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    form = "<form><label>Name</label><p>Tell us what you think about this.</p><input><button>Send</button></form>"
    for page in (article + form, form + article, f"<article><p>{LONG}</p>{form}<p>{LONG}</p></article>", f"<div><p>{LONG}</p><p>{LONG}</p>{form}</div>"):
        assert html_text.extract(page) == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_comments_that_never_end_are_linear():
    def took(n):
        began = time.process_time()
        text = html_text.extract(f"<article><p>{LONG}</p>" + "<!-- <p>" * n)
        assert text.startswith(LONG.strip())
        return time.process_time() - began

    took(100)
    assert took(40_000) < 40 * max(took(4000), 0.01)
    assert html_text.extract("<p>a<!-- b --></p><p>c<!-- d") == "a\n\nc<!-- d"


def test_text_hidden_until_it_is_found_stays():
    assert html_text.extract(f'<div hidden="until-found"><p>{LONG}</p></div>') == LONG.strip() and html_text.extract(f"<p>{LONG}</p><p hidden>no</p>") == LONG.strip()
