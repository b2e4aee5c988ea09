"""Substring removal, joins and vector search against brute force."""

import hashlib
import random

import numpy as np
import pytest

from granary.llm import ann_hilbert, deal, embedding_dedup, graph, jaccard_join, scratch, suffix_dedup


def repeated_texts(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab ") for _ in range(1500))
    rows = []
    for i in range(40):
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 1400)
            t += base[a : a + rng.randint(1, 300)] + rng.choice(["", "x", "aaaa" * 60, "é" * 80])
        rows.append((i * 3 % 41, t if rng.random() > 0.1 else None))
    return [*rows, (1000, rows[0][1]), (1001, "")]


def removed(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length", [8, 20, 100])
def test_substrings(spark, length):
    rows = repeated_texts(length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "text as kept")
    assert {r[0]: tuple(r[1:5]) for r in suffix_dedup.remove_repeats(docs, length).collect()} == removed(rows, length)


def test_substrings_edges(spark):
    rows = [(1, "x" * 300, 1), (1, "x" * 300, 1), (None, "y" * 120, 2), (2, None, 3), (None, "y" * 120, 2), ((1 << 63) - 2, "y" * 110, 4), (5, "é" * 200_000 + "tail" * 30, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").selectExpr("*", "text as kept", "'a' as block_id")
    got = suffix_dedup.remove_repeats(docs, 100, keep_text=True, carry=[]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=key) == [(1, 300, 299), (1, 300, 300), (2, 0, 0), (5, 400_120, 400_114), ((1 << 63) - 2, 110, 109), (None, 120, 120), (None, 120, 120)]
    none = suffix_dedup.remove_repeats(docs.where("false"), 100)
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(300):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12))}) for _ in range(rng.randint(1, 9))]
        out = list(suffix_dedup.merge([suffix_dedup.decode_run(*suffix_dedup.front_code(r)) for r in runs]))
        assert [o[0] for o in out] == sorted(s for r in runs for s in r)
        for (a, _, _), (b, _, h) in zip(out, out[1:], strict=False):
            assert suffix_dedup.shared(a, b, 0) == h


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 120]))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) * 7 % 211, ("  ".join(t)).upper() if g % 3 == 0 else "\n".join(t)))
    return [*rows, (500, None), (501, " \t"), (502, ""), (503, "W1 w2"), (504, "w1\x0bW2")]


def classes(rows, percent, n):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("percent", "n", "cluster"), [(90, 3, 1024), (80, 5, 3), (60, 2, 4)])
def test_jaccard(spark, percent, n, cluster):
    rows = near_texts(percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs, percent, n, cluster=cluster, rare=2).collect()}
    assert got == classes(rows, percent, n)


def test_word_hashes_tell_words_apart():
    texts = [b"A b  a\tB", b"", b"b", b"x" * 70_000 + b" y " + b"X" * 70_000, b" " * 9, "É é".encode(), b"word " * 60_000]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes, edges = jaccard_join.word_hashes(data, starts)
    names: dict[int, bytes] = {}
    for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        words = t.lower().split()
        assert len(words) == b - a
        for w, h in zip(words, hashes[a:b].tolist(), strict=True):
            assert names.setdefault(h, w) == w
    assert len(names) == len(set(names.values()))


def test_word_hashes_take_no_call_for_each_word(monkeypatch):
    """Words of usual lengths are digested together: a call for each different one made most of the join's time."""
    called = []
    digest = jaccard_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard_join.xxhash, "xxh3_64_intdigest", lambda *a: called.append(a[0]) or digest(*a))
    words = [bytes([97 + i % 26]) * i for i in range(1, 300)] + [b"b" * i + b"c" for i in range(299)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    hashes, _ = jaccard_join.word_hashes(data, np.array([0, len(data)]))
    again, _ = jaccard_join.word_hashes(np.frombuffer(b"\t ".join(words[::-1]), np.uint8), np.array([0, len(data) + len(words) - 1]))
    assert len(set(hashes.tolist())) == len(words) and hashes.tolist() == again.tolist()[::-1]
    assert all(len(w) > jaccard_join.LONG for w in called)


@pytest.mark.parametrize("percent", [55, 60, 80, 90, 95])
def test_similar_sets_share_a_key(percent):
    """Sets at the edge of similarity, over all mixtures of rare, middle and frequent tokens."""
    rng = np.random.default_rng(percent)
    bands = jaccard_join.size_edges(percent)
    tested = 0
    for _ in range(3000):
        size = int(rng.integers(1, 60))
        mix = rng.dirichlet([0.4, 0.4, 0.4])
        pool = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        level = dict(zip(pool.tolist(), rng.choice([3, 40, 255], 200, p=mix), strict=True))
        a = set(rng.choice(pool, size, replace=False).tolist())
        for _ in range(4):
            b = set(a)
            lost = int(rng.integers(0, len(a) + 1)) if rng.random() < 0.3 else int(rng.integers(0, 1 + len(a) * (100 - percent) // 100))
            for x in rng.permutation(sorted(b))[:lost].tolist():
                b.discard(x)
            b |= set(rng.choice(pool, int(rng.integers(0, 2 + len(a) * (100 - percent) // percent)), replace=False).tolist())
            if not b or 100 * len(a & b) < percent * len(a | b) or a == b:
                continue
            tested += 1
            keys = []
            for x in (a, b):
                tokens = np.array(sorted(x), np.uint64)
                band = int(np.searchsorted(bands, len(x), side="right"))
                found = jaccard_join.signatures(tokens, np.array([level[t] for t in tokens.tolist()]), percent)
                keys.append({(k, at) for k in found.tolist() for at in (band, band + 1)})
            assert keys[0] & keys[1]
    assert tested > 500


def test_large_clusters_are_joined_key_by_key(spark, monkeypatch):
    rng, called = random.Random(3), []
    rows, step = [], jaccard_join._by_key
    words = [f"w{i}" for i in range(260)]
    for i in range(60):  # a chain: every text shares most with the next, the first and the last share nothing
        rows.append((i * 7 % 60, " ".join(words[3 * i : 3 * i + 60])))
    rows += [(100 + i, " ".join(rng.choice("abcdef") for _ in range(6))) for i in range(60)]
    monkeypatch.setattr(jaccard_join, "_by_key", lambda *a: called.append(1) or step(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs, 80, 3, cluster=2, rare=2, middle=4).collect()}
    assert got == classes(rows, 80, 3) and called


def test_jaccard_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q"), (None, None), (7, "A  b c\nd"), (8, "q"), (9, ""), (9, ""), (10, "long " * 40_000 + "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'k' as digest", "2 as comp", "3 as n")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs).collect()), key=key)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, 8), (None, 0, None), (7, 2, 1), (8, 1, 8), (9, 0, 9), (9, 0, 9), (10, 2, 10)], key=key)
    assert jaccard_join.similar_documents(docs.where("false")).collect() == []
    kept = jaccard_join.keep_one(docs, 90, 3)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:3]) for r in kept.collect()), key=key) == sorted([(1, "a b"), (8, "q"), (9, ""), (10, "lon"), (None, "")], key=key)


def test_keep_one(spark):
    rows = near_texts(7)
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    kept = jaccard_join.keep_one(docs, 80, 5)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in classes(rows, 80, 5).values()})
    assert jaccard_join.keep_one(docs.where("false")).count() == 0


def test_keep_one_of_unlike_texts_with_one_id(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (1, other), (1, one), (2, other), (3, ""), (3, None), (4, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, one), (1, other), (3, ""), (4, "")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 40), (60, 60)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 40, 40: 40}


def test_components_of_a_star(spark):
    edges = spark.range(2, 3000).selectExpr("id as a", "1 as b").unionByName(spark.createDataFrame([(5000, 6000)], "a long, b long"))
    roots = graph.components(edges)
    assert {(r.root, r["count"]) for r in roots.groupBy("root").count().collect()} == {(1, 2999), (5000, 2)}
    assert graph.components(edges.where("false")).collect() == []


def test_components_take_as_many_tasks_as_their_edges_need(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        roots = graph.components(spark.range(4000).selectExpr("id as a", "id - id % 40 + least(id % 40 + 1, 39) as b"))
        assert {r["count"] for r in roots.groupBy("root").count().collect()} == {40}
        assert len(roots.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sets_that_share_much_but_do_not_link_are_counted_together(monkeypatch):
    random_ = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(20), random_.integers(1000, 10**9, 5)])).astype(np.uint64) for _ in range(120)]
    sets += [np.append(np.setdiff1d(s, s[-1:]), np.uint64(10**10 + i)) for i, s in enumerate(sets[:40])]
    tests, plain = [], jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda *x: tests.append(0) or plain(*x))
    assert jaccard_join.join_sets(sets, 80) == [*range(120), *range(40)]
    assert len(tests) <= 4 * len(sets)
    # Sets of one component known before are not met with one another.
    tests.clear()
    assert jaccard_join.join_sets(sets, 80, [0] * 159 + [159])[159] == 0
    assert len(tests) <= 8


def test_dealt_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(deal, "FREQUENT", 10)
    many = spark.range(500).selectExpr("if(id < 300, 1, id) as k", "id as v")
    one = many.where("k % 2 = 1").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 as w")
    for how in ("inner", "left"):
        assert sorted(map(tuple, deal.join_dealt(many, one, ["k"], "n", many.v, how).select("k", "v", "w").collect()), key=str) == sorted(map(tuple, many.join(one, "k", how).select("k", "v", "w").collect()), key=str)


def test_scratch_is_swept(spark):
    before = scratch.mark(spark)
    kept, gone = scratch.materialize(spark.range(3), "kept"), scratch.materialize(spark.range(4), "gone")
    assert scratch.sweep(spark, before, (kept,)) == 1
    assert kept.count() == 3
    with pytest.raises(Exception, match="granary-gone"):
        gone.count()
    scratch.discard(kept)
    jaccard_join.similar_documents(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert any(t.name.startswith("granary_blocks") for t in spark.catalog.listTables())
    scratch.sweep(spark, before)
    assert scratch.mark(spark) == before


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:90] = x[0] + 0.03 * rng.standard_normal((40, dim))
    x[100:110] = x[99]
    rows = [(i, v.tolist(), int(i % 3) if i >= 110 else 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [None] + [1.0] * (dim - 1), 1), (1004, x[0].tolist(), None), (1005, [1.0], 1)]
    return rows, odd


@pytest.mark.parametrize("block", [4096, 16])
def test_embedding_links(spark, block):
    rows, odd = vectors(3)
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, 0.93, leaf_rows=64, block_rows=block).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for _, _, c in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(len(rows))] == link.sum(1).tolist()
    assert got[55].component_id == 0 and not got[55].kept and got[105].component_id == 99
    assert all(got[i].n_links == 0 and got[i].kept for i, _, _ in odd)


def test_embedding_edges(spark):
    one, other = [1.0, 0.0, 2.0], [0.0, 1.0, 0.0]
    rows = [(1, one, 1), (1, None, 1), (1, one, 1), (2, other, 1), (2, one, None), (None, one, 1), (None, None, None), (3, [2.0, 0.0, 4.0], 1), (4, one, 2), (2, [1.0, 0.0, 2.1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as x", "3 as c", "4 as n_links")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r[:4]) for r in embedding_dedup.near_duplicates(table, 0.93).collect()), key=key)
    linked = [(1, 3, 1, True), (1, 3, 1, True), (3, 3, 1, False), (2, 3, 1, False)]
    assert got == sorted([*linked, (1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (4, 0, 4, True), (None, None, None, None), (None, None, None, None)], key=key)
    assert embedding_dedup.near_duplicates(table.where("false")).collect() == []
    assert embedding_dedup.near_duplicates(table.where("label is null")).count() == 2


def deep_vectors(n=6000, dim=32):
    """Vectors of one label, with partners of cosines from the threshold on."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n // 3, dim))
    side -= (side * x[: n // 3]).sum(1, keepdims=True) * x[: n // 3]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.93, 0.95, (n // 3, 1))
    x[n // 3 : 2 * (n // 3)] = cos * x[: n // 3] + np.sqrt(1 - cos**2) * side
    return x


@pytest.mark.parametrize("sample", [20_000, 300])
def test_embedding_recall_in_deep_trees(spark, sample):
    x = deep_vectors()
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, 0.93, leaf_rows=10, block_rows=40, sample_rows=sample).collect()}
    link = np.triu(x @ x.T >= 0.93, 1)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.98 * 2 * link.sum() <= found <= 2 * link.sum()
    # Ten levels, by the sample or at the leaves' own medians.
    assert np.log2(len(x) / 10) > 9


def neighbours(x, ids, q, k):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -np.round(s, 9))) if i != q][:k]
    return order, s[order]


def test_nearest(spark):
    rows, odd = vectors(4)
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    pool, ids = np.vstack([x, x[0]]), np.array([*range(len(rows)), 1004])
    for more in ({"window": 1 << 40, "query_rows": 8, "block": (16, 32)}, {"recall": 1.0, "probes": 1000, "block": (16, 64)}):
        by = {}
        for r in ann_hilbert.nearest(table, "vec_id % 20 = 0", k=7, **more).collect():
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in range(0, len(rows), 20):
            found = sorted(by[q])
            assert [f[0] for f in found] == list(range(1, 8))
            assert np.allclose([f[2] for f in found], neighbours(pool, ids, q, 7)[1])
    assert ann_hilbert.nearest(table.where("false"), "vec_id % 20 = 0").count() == 0
    assert ann_hilbert.nearest(table, "vec_id < 0").count() == 0


def test_nearest_edges(spark):
    one, other = [1.0, 0.0], [0.6, 0.8]
    rows = [(20, one, 1), (20, other, 1), (20, one, 1), (3, one, 0), (2, one, 0), (None, one, 1), (40, None, 1), (5, [0.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as query", "3 as score", "4 as class", "5 as h")
    got = [tuple(r) for r in ann_hilbert.nearest(table, "label = 1 and vec_id > 0", k=2).collect()]
    assert sorted(got) == sorted([(20, 1, 2, 1.0), (20, 2, 3, 1.0), (20, 1, 5, 0.8), (20, 2, 2, 0.6)])


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_windows(spark, clustered):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 24))
    if clustered:
        x = x[rng.integers(0, 150, 6000)] + 0.2 * x
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in ann_hilbert.nearest(table, "vec_id % 20 = 0").collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(len(x))
    assert sorted(by) == list(range(0, 6000, 20))
    assert np.mean([len(by[q] & set(neighbours(x, ids, q, 20)[0])) / 20 for q in by]) >= 0.9


def test_windows_are_chosen_by_cost():
    far = np.array([[10, 900], [900, 10], [20, 20], [900, 900]])
    assert ann_hilbert.choose_windows(far, 0.75, 10_000) == (2, 20)
    assert ann_hilbert.choose_windows(far, 1.0, 10_000) == (2, 900)
    three = np.array([[500, 500, 1], [500, 1, 500]])
    assert ann_hilbert.choose_windows(three, 1.0, 10_000) == (3, 1)


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([(a, b) for a in range(8) for b in range(8)])
    keys = ann_hilbert.hilbert_keys(cells, bits=3)
    assert sorted(keys) == list(range(64))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_words_that_polynomials_confuse_stay_apart(spark):
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"X {a.upper()} Y")]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_before_tables(spark, seed):
    rng = random.Random(seed)
    cell = {"0": "|-------", "1": "|======="}
    rows = []
    for g in range(6):
        head = "".join(rng.choice("abcdefghij ") for _ in range(100))
        for tail in ("1001", "0110", "1100")[: 2 + g % 2]:
            rows.append((len(rows), head + "".join(cell[c] for c in tail) + "|" * rng.randint(0, 3)))
    rows += [(len(rows) + i, "".join(cell[rng.choice("01")] for _ in range(rng.randint(5, 60)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.remove_repeats(docs, 100).collect()}
    assert got == removed(rows, 100) and got[1][1] >= 100


def test_small_labels_go_through_the_trees(spark, monkeypatch):
    built = []
    plant = embedding_dedup.Tree.__init__

    def noted(self, sample, depth, *more):
        built.append(depth)
        plant(self, sample, depth, *more)

    monkeypatch.setattr(embedding_dedup.Tree, "__init__", noted)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + 0.03 * rng.normal(size=16)).tolist(), 1) for i in range(180)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93).sum(1) - 1
    assert built == [3] * 4 and {i: n for i, (n, _) in got.items()} == {i: int(near[i]) for i in range(180)}
    assert all(c == i % 60 for i, (_, c) in got.items())
