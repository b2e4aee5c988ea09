"""Tokenizers, packing, URLs, HTML and quality against the libraries or brute force."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from granary.llm import bpe, html_extract, packing, quality, token_counts, url_filter

ROOT = Path(__file__).resolve().parents[2]
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'LL", "don't", "é", "²", "日本", "😀", "\x1c", "\x85", "　", "<|endoftext|>", "<|endof", "!!", "23", "_", "aaaaaaaaaa", "e", "́", "İ", "Σ ", "The ", "ing", "\t", "\x00", "ẞ", "'"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["", "word " * 3000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_backtracking_encoder_equals_the_library(byte_library):
    own = bpe.load(bpe.read_vocabulary(BYTE))
    for t in texts(1500):
        ids = byte_library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(np.array(ids)) == byte_library.decode(ids, skip_special_tokens=False)


def test_prefix_counts_equal_encoding_every_prefix(byte_library):
    own = token_counts.counter(bpe.read_vocabulary(BYTE))
    for t in texts(300, 2):
        if len(t) > 500:
            continue
        want = [len(byte_library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert own.counts(t) == want
        assert own.count(t) == want[-1]
        cut = own.truncate(t, 5)
        assert len(byte_library.encode(cut, add_special_tokens=False).ids) <= 5


def test_bpe_and_count_queries(spark, byte_library):
    rows = [(i, t) for i, t in enumerate(texts(40))] + [(900, None), (900, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "text as decoded")
    got = bpe.encode_documents(docs, BYTE).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        ids = np.array(byte_library.encode(t or "", add_special_tokens=False).ids, "<u4")
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    counted = {r.doc_id: r for r in token_counts.count_tokens(docs, BYTE, limit=8).collect()}
    for i, t in rows:
        assert (counted[i].n_tokens, counted[i].n_bytes) == (by[i].n_tokens, len((t or "").encode()))
        assert counted[i].over_limit == (by[i].n_tokens > 8)
    assert bpe.encode_documents(docs.where("doc_id < 0"), BYTE).count() == 0


def test_counts_of_a_prefix_above_those_of_the_whole(spark, byte_library):
    word = "qz" * 127 + "folder"  # 255 tokens, but a prefix has 256
    own = token_counts.counter(bpe.read_vocabulary(BYTE))
    assert own.counts(word)[-1] == 255 and max(own.counts(word)) == 256
    rows = [(1, word), (2, "x" * 100_000), (2, "x" * 100_000), (3, word + " " + word), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as over_limit")
    got = token_counts.count_tokens(docs, BYTE, limit=512).collect()
    want = [(i, len((t or "").encode()), len(byte_library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or 0, b, n, n > 512) for i, b, n in want)
    assert token_counts.count_tokens(docs.where("false"), BYTE).collect() == []


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD), packing.WordTokenizer(bpe.read_vocabulary(WORD))
    many = texts(1500, 3)
    for t, raw in zip(many, own.encode_many(many), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(WORD), random.Random(4)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta 12 !!".split()) for _ in range(rng.choice([0, 3, 40, 90, 300])))) for i in range(200)] + [(500, None), (501, ""), (501, ""), (None, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD, capacity=64).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    used = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 64 * r.piece and len(part) == r.length <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(ids[i]) for i, _ in rows)
    assert sum(r.length for r in got) == total
    assert len(used) <= 1.1 * -(-total // 64)


@pytest.mark.parametrize("weigh", [True, False])
def test_sum_of_squares_equals_trying_every_place(weigh):
    for seed in range(30):
        rng = random.Random(seed)
        capacity = rng.choice([5, 12, 30])
        sizes = [rng.randint(1, capacity) for _ in range(120)]
        bins, offsets, gaps = packing.pack(np.array(sizes), capacity, weigh)
        left = []  # gap of each bin
        for size, b, offset in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
            ways = {}
            for at, gap in [*enumerate(left), (len(left), capacity)]:
                if gap >= size:
                    after = [*left[:at], gap - size, *left[at + 1 :]]
                    ways[at] = sum(sum(g == h for g in after) ** 2 for h in range(1, capacity))
            if not weigh and len(ways) > 1:
                del ways[len(left)]
            if b == len(left):
                left.append(capacity)
            assert ways[b] == min(ways.values()) and offset == capacity - left[b]
            left[b] -= size
        assert gaps.tolist() == left


def test_packing_edges(spark):
    rows = [(-(1 << 63), "x"), (None, "y"), (None, None), (3, ""), (3, ""), (4, "long word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "'a' as start", "2 as sequence_id", "0 as settled")
    got = packing.pack_documents(docs, WORD, capacity=2048, together=2).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length) for r in got) == [(False, -(1 << 63), 0, 2), (False, 3, 0, 1), (False, 3, 0, 1), *((False, 4, k, min(2048, 10001 - 2048 * k)) for k in range(5)), (True, 0, 0, 1), (True, 0, 0, 2)]
    assert packing.pack_documents(docs.where("false"), WORD).collect() == []


def test_url_rules(spark):
    urls = ["https://a.b.com/en/x", "http://EXAMPLE.com/en/7?q#f", "https://example.com/en/8", "http://www.example.net/de/8/z", "http://x.net/de/1", "ftp://notcom/en/", "http://com/en/", "http://a.org?/es/", "plain", None, "", "://", "http://evilexample.com/en/7"]
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        body = rest.split("?")[0].split("#")[0]
        host, path = body.split("/")[0].lower(), body[len(body.split("/")[0]) :]
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


PAGE = """<html><head><title>t</title><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
<div class="content"><h2>Head &amp; line</h2><p>First paragraph of the article with quite some text &nbsp; in it, and more so that it counts.</p>
<p>Second <a href=x>with a link</a> and &lt;text&gt;.<br>after<p>Third, unclosed<ul><li>one<li>two</ul><form><input value="a>b">Search</form></div>
<div class="sidebar"><p>Side text that is not short at all, but it is a sidebar and not the article.</p></div><div id="comments"><p>A long remark of some reader about the article above.</p></div>
<div class="cookie-notice">We use cookies.</div><footer>foot</footer></body></html>"""


def test_html():
    lines = html_extract.extract(PAGE).split("\n")
    assert lines == ["Head & line", "First paragraph of the article with quite some text in it, and more so that it counts.", "Second with a link and <text>. after", "Third, unclosed", "one", "two"]
    for odd in (None, "", "<div>", "<script>", "<p class=\"x", "<!-- open"):
        assert html_extract.extract(odd) == ""
    assert html_extract.extract("plain") == "plain"


def test_html_long_attribute_values():
    value = "{a > b} 'c' " * 400
    assert html_extract.extract(f'<body><div data-x="{value}"><p>Text of the article.</p></div><p title=it\'s>More &gt; text.</p></body>').split("\n") == ["Text of the article.", "More > text."]


def plain_densities(page):
    """Densities of a well-formed page by walking the tree for every node."""
    from xml.etree import ElementTree

    tree = ElementTree.fromstring(page)
    text = lambda e: sum(len("".join(t.split())) for t in e.itertext())
    links = lambda e: [e] if e.tag == "a" else [a for c in e for a in links(c)]
    every = list(tree.iter())
    ratio = sum(text(a) for a in links(tree)) / text(tree)
    out = []
    for e in every:
        c, t = text(e), sum(x.tag != "br" for x in e.iter())
        lc, lt = sum(text(a) for a in links(e)), sum(x.tag == "a" for x in e.iter())
        out.append(html_extract.density(c, t, lc, lt, ratio))
    return every, out, [sum(out[every.index(c)] for c in e) for e in every]


def test_densities_equal_a_plain_computation():
    rng = random.Random(2)

    def some(depth):
        kind = rng.choice(["div", "section", "p", "b", "a"]) if depth else "p"
        inner = "".join(some(depth - 1) for _ in range(rng.randint(1, 4))) if depth and kind not in ("p", "b", "a") else "word " * rng.randint(0, 30) + "<br/>" * rng.randint(0, 1)
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(40):
        page = f"<body>{''.join(some(3) for _ in range(4))} x</body>"
        every, own, total = plain_densities(page)
        tree = html_extract.parse(page)
        _, found, sums = html_extract.densities(tree)
        assert tree.tag[1:] == [e.tag for e in every]
        assert np.allclose(found[1:], own) and np.allclose(sums[1:], total)


def test_html_density_finds_the_article_without_its_tag(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        tree = html_extract.parse(page)
        assert [tree.tag[i] for i in html_extract.select(tree)] == ["article"]
        assert html_extract.extract(page.replace("<article>", "<div>").replace("</article>", "</div>")) == html_extract.extract(page)


def test_html_sections_and_unmarked_noise():
    words = "Several words of running text, as an article has them, in one paragraph. "
    part = lambda k: f"<section><h2>Part {k}</h2><p>{words * 3}</p><p>{words * k}</p><p>Short one.</p></section>"
    links = "<ul>" + "".join(f"<li><a href=x>Link number {k} to somewhere</a></li>" for k in range(9)) + "</ul>"
    page = f"<body><div>{links}</div><div><h1>Title</h1>{part(2)}{part(6)}{part(1)}</div><div>{links}</div></body>"
    got = html_extract.extract(page).split("\n")
    assert got[0] == "Title" and [x for x in got if x.startswith("Part")] == ["Part 2", "Part 6", "Part 1"]
    assert got.count("Short one.") == 3 and not any("Link" in x for x in got)


def test_html_stray_and_unclosed_tags_cost_nothing_extra():
    import time

    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<b>" * 60_000 + "<p></p>" * 60_000, "<i><table><td>" + "<b>" * 60_000 + "</i>" * 60_000, "<ul>" + "<b>" * 60_000 + "<li>" * 60_000):
        began = time.process_time()
        html_extract.extract(page + "text")
        assert time.process_time() - began < 10


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "é" * 10)], "page_id long, url string, html string").selectExpr("*", "url as text")
    assert html_extract.extract_pages(pages.where("false")).collect() == []
    rows = html_extract.extract_pages(pages).collect()
    assert len(rows) == 4 and sorted(r.n_chars for r in rows)[:2] == [0, 10]


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("the quiet house stands near a river and people walk there often".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "x|y"]) for _ in range(60))
    rows = [(i, good() if i % 5 else bad()) for i in range(600)]
    docs = spark.createDataFrame([*rows, (9000, None), (9000, None)], "doc_id long, text string").selectExpr("*", "0.5 as score")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 602
    held = [r for r in got if r.doc_id < 9000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 > 0) for r in held) >= 0.97 * len(held)
    none = quality.score_quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_risk_and_gradient():
    rng = np.random.default_rng(7)
    pos, unl, w, prior = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), rng.normal(0, 1, 5), 0.3
    loss = lambda x, v, sign: float(np.mean([math.log(1 + math.exp(-sign * (sum(a * b for a, b in zip(r, v, strict=False)) + v[4]))) for r in x]))
    parts = lambda v: (prior * loss(pos, v, 1), loss(unl, v, -1) - prior * loss(pos, v, -1))
    gain, rest, up, down = quality.risk(w, pos, unl, prior)
    assert np.allclose((gain, rest), parts(w))
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        slope = (np.array(parts(w + step)) - np.array(parts(w - step))) / 2e-6
        assert np.allclose(slope, (up[i], down[i]), atol=1e-6)


def test_quality_features_do_not_depend_on_hashing():
    import subprocess
    import sys

    code = "from granary.llm import quality; print(quality.features('dd cc bb aa dd aa aa ' * 3).tolist())"
    found = {subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": str(ROOT), "PYTHONHASHSEED": str(k)}, capture_output=True, text=True, check=True).stdout for k in range(4)}
    assert len(found) == 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "a text"), (None, "x"), (2, ""), (3, None), (4, "w" * 200_000)], "doc_id long, text string").selectExpr("*", "1 as c0", "2 as predicted")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels, carry=["c0"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.c0 == 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and [r.held_out for r in got if r.doc_id is None] == [None]
    assert quality.score_quality(docs.where("false"), labels).collect() == []


def test_url_edges(spark):
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    pages = spark.createDataFrame([(None, "http://a.com/en/" + "x" * 50_000), (2, "http://a.com/en/")] + [(k, "http://www.hot.com/en/1") for k in range(3, 400)], "page_id long, url string").selectExpr("*", "'h' as host", "1 as lead", "2 as urls", "3 as best")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == 399 and {(r.rule, r.verdict) for r in got} == {("com/en/", "block")}
    assert url_filter.judge_urls(pages.where("false"), rules).collect() == []


def test_prior_estimate():
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(2, 1, 5000), np.concatenate([rng.normal(2, 1, 3500), rng.normal(-3, 1, 1500)])
    assert abs(quality.estimate_prior(pos, unl) - 0.7) < 0.05


def test_samples_are_bounded_where_an_id_is_on_most_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda pos, unl: seen.append((len(pos), len(unl))))
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = spark.range(3000).selectExpr(f"if(id < 2000, {hot}, id) as doc_id", "concat('text number ', id) as text")
    copies = spark.range(3000).selectExpr(f"{hot} as doc_id", "'the same text' as text")
    labels = spark.range(6000).selectExpr("id as doc_id", "1 as quality")
    quality.fit_quality(rows.unionByName(copies), labels, sample_rows=100)
    assert all(10 < n < 400 for n in seen[0])


def test_null_urls_are_spread(spark):
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    pages = spark.range(4000).selectExpr("id as page_id", "if(id % 2 = 0, null, concat('http://h', id, '.example.com/en/7')) as url")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        found = url_filter.judge_urls(pages, rules)
        sizes = found.rdd.glom().map(len).collect()
        assert found.where("verdict = 'allow'").count() == 4000 and found.where("rule is null").count() == 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) < 1200
