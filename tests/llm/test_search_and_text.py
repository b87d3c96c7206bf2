"""Exact top-k, document fingerprints, HTML text and language ID."""

import random

import pytest

from recallspark.llm import html_text, language_id, minhash, topk
from recallspark.llm.catalog import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_top_k_with_ties_repeats_and_nulls(spark):
    from pyspark.sql import functions as F

    dice = random.Random(1)
    rows = [(k, [dice.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(20)]) for k in range(300)]
    rows += [(301, None), (302, [None] * 20), (303, [float("nan")] * 20), (304, [float("inf")] * 20), (None, [1.0] * 20), (5, rows[5][1]), (350, rows[50][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    vectors = df.select("vec_id", topk.quantised(F.col("embedding")).alias("embedding"))
    for block in (8192, 40):
        out = topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, query_block=3, vector_block=block).collect()
        good = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v and None not in v and all(abs(x) < 9 for x in v)]
        want = []
        for q, e in good:
            if q % 50 == 0:
                scored = sorted((-sum(a * b for a, b in zip(e, f)), c) for c, f in good if c != q)[:5]
                want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
        assert sorted(map(tuple, out)) == sorted(want)


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1]), (7, [3])], "vec_id long, embedding array<long>")
    assert [tuple(r) for r in topk.top_k(few.where("vec_id = 0"), few).collect()] == [(0, 1, 7, 3)]
    assert topk.top_k(few.limit(0), few.limit(0)).count() == 0


def test_registered_top_k_equals_its_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = db.sql(ORACLES["op1_exact_topk"])
    got = QUERIES["op1_exact_topk"](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def shingles(text, n=5):
    w = brute.words(text)
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))}


def test_fingerprints_estimate_likeness(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(brute.EDGE_TEXTS)]
    out = minhash.edited_fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, edited string").repartition(4)).collect()
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts)
    error, same = [], {}  # of sets of some size: few shingles may share a bin
    for r in out:
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert same.setdefault(text, r.packed) == r.packed and same.setdefault(edited, r.edited_packed) == r.edited_packed
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(text), shingles(other)
            if min(len(a), len(b)) >= 20:
                error.append(abs(near - len(a & b) / len(a | b)))
            assert 0 <= near <= 1
    assert len(out) == len(rows) and sum(error) / len(error) < 0.03 and max(error) < 0.35
    assert minhash.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = minhash.edited_fingerprints(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).first()
    assert (alone.edited, alone.near_next) == ("a b c a", 1.0)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body>
<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h2>Head &amp; tail</h2><p>One  <b>two</b>\nthree&nbsp;four.</p><aside>Side</aside><div class="advert">Buy</div>
<form><input value=1><button>Go</button></form><ul><li>a<li>b</ul></article><div id="comments"><p>Nice</p></div><footer>Foot</footer></body></html>"""


def test_html_text(spark):
    loose = "<body><div>Home</div><div>menu one two three four five six seven eight nine</div><p>own words of page {k} are here</p></body>"
    rows = [(1, "http://h/a", PAGE), (2, None, None), (3, "http://h/b", ""), (None, "x", "plain &lt;b&gt; text")]
    rows += [(10 + k, f"https://loose.example/{k}", loose.format(k=k)) for k in range(5)]
    out = {r.page_id: r.text for r in html_text.html_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, blocks int")).collect()}
    assert out[1] == "Head & tail\n\nOne two three four.\n\na\n\nb"
    assert (out[2], out[3], out[None]) == ("", "", "plain <b> text")
    assert all(out[10 + k] == f"own words of page {k} are here" for k in range(5))
    assert html_text.html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_runs_equal_brute_force():
    dice = random.Random(5)
    streams = [[dice.choice("abc") for _ in range(dice.randrange(0, 60))] for _ in range(12)]
    for run, pages in ((3, 2), (8, 3), (5, 4)):
        where = {}
        for p, s in enumerate(streams):
            for k in range(len(s) - run + 1):
                where.setdefault(tuple(s[k : k + run]), set()).add(p)
        want = []
        for s in streams:
            gone = set()
            for k in range(len(s) - run + 1):
                if len(where[tuple(s[k : k + run])]) >= pages:
                    gone.update(range(k, k + run))
            want.append([k in gone for k in range(len(s))])
        assert [list(map(bool, m)) for m in html_text.repeated(streams, run, pages)] == want


def test_repeated_runs_of_few_and_empty_pages():
    for streams in ([[]], [[], []], [["a"]], [[], ["a"], []], [["a", "b"], ["a"]]):
        assert [m.tolist() for m in html_text.repeated(streams)] == [[False] * len(s) for s in streams]


def test_language_id_on_held_out_rows(spark):
    rows = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(k, t, ("en", "fr", None)[k % 3], k) for k, t in enumerate(["the cat", "le chat", "x", None, "", "123"] * 4)], "doc_id long, text string, lang string, score int")
    model = language_id.train(docs)
    out = language_id.identify(docs, model).collect()
    assert all((r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in r.text or "")) for r in out)
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_html_hosts_of_several_shards(spark, monkeypatch):
    page = "<body><div>one two three four five six seven eight nine</div><div>own words of page {0}</div></body>"
    rows = [(k, "https://hot.example/a", page.format(k)) for k in range(40)] + [(40, None, page.format(40)), (41, "https://cold.example/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "SHARD", 10)
    broadcast = sorted(html_text.html_text(df).select("page_id", "text").collect())
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", -1)
    assert sorted(html_text.html_text(df).select("page_id", "text").collect()) == broadcast
    text = dict(broadcast)
    assert [text[k] for k in range(40)] == [f"own words of page {k}" for k in range(40)]
    assert text[40].startswith("one two three") and text[41] == ""


def test_html_runs_on_few_pages_of_a_large_host(spark, monkeypatch):
    """A run on three pages goes, one on two stays, at any host size."""
    lines = [" ".join(f"{name}{n}" for n in range(9)) for name in ("thrice", "twice")]
    rows = [(k, f"https://hot.example/{k}", f"<body><div>{lines[0] if k % 20 == 0 else ''}</div><div>{lines[1] if k in (1, 2) else ''}</div><p>own words of page {k}</p></body>") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    small = sorted(html_text.html_text(df).select("page_id", "text").collect())
    monkeypatch.setattr(html_text, "SHARD", 5)
    assert sorted(html_text.html_text(df).select("page_id", "text").collect()) == small
    assert all(r.text == (f"{lines[1]}\n\n" if r.page_id in (1, 2) else "") + f"own words of page {r.page_id}" for r in small)


def test_html_names_within_an_article_rule_out_nothing_alone(spark):
    inside = "<section class='social-history'>a social history</section><p id='search'>the search goes on</p><h2 class='banner'>On banners</h2><p>the <span class='share'>value of a share rose</span> again</p><div class='share'>this page alone shares this</div>"
    share = "<div class='share'>tell your friends on all of these fine networks today</div>"
    rows = [(1, "http://own/1", f"<article>{inside}</article>"), (2, "http://own/2", "<article><p>text</p><div class='ad'>Buy</div></article><article class='comment'><p>First!</p></article>")]
    rows += [(10 + k, f"http://many/{k}", f"<main><p>text {k}</p>{share}<p>the same last words that every page of this host repeats</p></main>") for k in range(3)]
    out = {r.page_id: r.text for r in html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "a social history\n\nthe search goes on\n\nOn banners\n\nthe value of a share rose again\n\nthis page alone shares this"
    assert out[2] == "text"
    assert all(out[10 + k] == f"text {k}\n\nthe same last words that every page of this host repeats" for k in range(3))


def test_top_k_of_queries_that_share_an_id(spark):
    rows = [(0, [1, 2]), (0, [2, 1]), (1, [3, 0]), (2, [0, 3])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    out = topk.top_k(vectors.where("vec_id = 0"), vectors, k=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(0, 1, 1, 6), (0, 1, 2, 6)]


def test_top_k_is_exact_beyond_doubles_and_over_many_blocks(spark):
    big = 1 << 30
    rows = [(k, [big + k, big - k, k]) for k in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    want = []
    for q, v in rows[:4]:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for query_block, vector_block in ((512, 8192), (2, 3)):
        out = topk.top_k(vectors.where("vec_id < 4"), vectors, k=3, query_block=query_block, vector_block=vector_block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == sorted(want)


def test_fingerprints_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60] + brute.EDGE_TEXTS
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.f for r in df.select("doc_id", minhash.fingerprint("text").alias("f")).collect()}
    assert got == {k: brute.fingerprint(t) for k, t in enumerate(texts)}


def test_registered_html_text_equals_a_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op10_html_text"](spark, sf).collect()}
    assert got == {k: (t := brute.article(h), len(t)) for k, h in pages.items()}


def page_text(page):
    texts, kinds = html_text.blocks(page)
    return html_text.main_text(texts, kinds, __import__("numpy").zeros(sum(t.count(" ") + 1 for t in html_text.undecided(texts, kinds)), bool))


LONG = "The harbour was rebuilt in stone after the great storm, and for a century its two lamps were lit by hand each night while the keepers logged the weather, the ships and the price of oil in a book that the town still has today, bound in sealskin and kept dry."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<main><div class="notice">We use cookies</div><p>Body text.</p></main>', "Body text."),
        ('<article><p>One.</p><div class="cookie-consent">Accept all?</div><div class="ad-box">Buy now</div><p>Two.</p></article>', "One.\n\nTwo."),
        ('<article><section id="ads"><p>What ads cost in 1900</p></section><ol id="replies"><li>Survey replies</li></ol></article>', "What ads cost in 1900\n\nSurvey replies"),
        ('<div class="search-guide"><p>How to search a library.</p></div>', "How to search a library."),
        ('<article><p>One.</p><div id="comments"><p>First!</p></div><div class="comment-list"><p>Me too</p></div></article>', "One."),
        ('<article><p>One.</p><div class="related"><ul><li><a href="/a">' + LONG + '</a></li><li><a href="/b">More</a></li></ul></div></article>', "One."),
        ('<article><div class="notice"><p>' + LONG + "</p></div></article>", LONG),
        ('<article><p>One.</p><div class="shareButtons"><a href="#">Share this</a></div><div role="dialog"><p>Sign in</p></div><section aria-label="Advertisement"><p>' + LONG + "</p></section></article>", "One."),
        ('<article><div class="related-work"><p>Earlier studies.</p></div><div class="adsorption"><p>Gas on charcoal.</p></div></article>', "Earlier studies.\n\nGas on charcoal."),
    ],
)
def test_names_are_evidence_only(page, text):
    assert page_text(page) == text


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    """Through the query, against a brute-force count of runs over all pages of a host; one path per host size."""
    dice = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(dice.choice(words) for _ in range(n))
    common = [line(12) for _ in range(4)]
    rows = []
    for k in range(460):
        host = "large.example" if k < 420 else f"small{k % 4}.example"
        parts = [line(dice.choice([3, 9, 30])) for _ in range(3)] + [dice.choice(common)] + ([line(5) + " " + common[0] + " " + line(4)] if k % 5 == 0 else [])
        dice.shuffle(parts)
        rows.append((k, f"https://{host}/{k}", "".join(f"<p>{p}</p>" for p in parts)))
    runs = {}
    for k, url, page in rows:
        tokens = [t for b in html_text.blocks(page)[0] for t in b.split(" ")]
        for j in range(len(tokens) - html_text.RUN + 1):
            runs.setdefault((url.split("/")[2], tuple(tokens[j : j + html_text.RUN])), set()).add(k)
    want = {}
    for k, url, page in rows:
        texts = html_text.blocks(page)[0]
        tokens = [t for b in texts for t in b.split(" ")]
        gone = [False] * len(tokens)
        for j in range(len(tokens) - html_text.RUN + 1):
            if len(runs[url.split("/")[2], tuple(tokens[j : j + html_text.RUN])]) >= html_text.PAGES:
                gone[j : j + html_text.RUN] = [True] * html_text.RUN
        at, kept = 0, []
        for b in texts:
            own, mask = b.split(" "), gone[at : at + b.count(" ") + 1]
            at += len(own)
            if all(mask):
                continue
            j = 0
            while j < len(mask):
                e = j
                while e < len(mask) and mask[e]:
                    e += 1
                if 0 < e - j < html_text.RUN:
                    mask[j:e] = [False] * (e - j)
                j = max(e, j + 1)
            kept.append(" ".join(w for w, g in zip(own, mask) if not g))
        want[k] = "\n\n".join(kept)
    out = html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    assert not any(common[0] in t for k, t in want.items() if k < 420)


def test_top_k_of_long_vectors_in_blocks_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1 << 20)  # 87 vectors of 1,500 dimensions
    dice = __import__("numpy").random.default_rng(7)
    rows = [(k, dice.integers(-200, 200, 1500).tolist()) for k in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors.where("vec_id % 50 = 0"), vectors).collect())
    want = []
    for q, e in rows:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), c) for c, f in rows if c != q)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert out == sorted(want)
