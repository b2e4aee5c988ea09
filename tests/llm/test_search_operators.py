"""Ranked search, fingerprints and alignment against brute force and the libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import alignment, fingerprints, ranked_search

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_carry_arithmetic():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, terms = int(rng.integers(1, 200)), int(rng.integers(1, 5))
        width = -(-n // 64) * 64
        values = rng.integers(0, 1 << 20, (terms, width)) * (rng.random((terms, width)) < 0.4)
        values[:, n:] = 0
        slices = np.packbits(((values[None] >> np.arange(20)[:, None, None]) & 1).astype(np.uint8), axis=2, bitorder="little").view(np.uint64)
        factors = rng.integers(0, 30_000, terms)
        product = ranked_search.times(slices, factors)
        total = np.zeros((len(product) + 3, width // 64), np.uint64)
        for t in range(terms):
            ranked_search.add(total, product[:, t], t % 2)
        want = (values * factors[:, None] * (1 + np.arange(terms) % 2)[:, None]).sum(0)
        assert ranked_search.numbers_at(total, np.arange(width)).tolist() == want.tolist()
        for k in (1, 3, 500):
            best = sorted((i for i in range(n) if want[i] > 0), key=lambda i: (-want[i], i))[:k]
            assert ranked_search.top(total, k).tolist() == sorted(best)


def ranked(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(d, Counter(words(t))) for d, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for d, c in counts:
            m = 25 + (75 * c.total() * n) // total if total else 0
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def test_ranked_search(spark):
    rng = random.Random(2)
    words = ["A", "b", "été", "日本", "x1", "The", "the", "zz", "Q", "rare"]
    docs = [(i * 7 % 301, rng.choice(["", " ", "--"]).join(rng.choice(words) + rng.choice([" ", "-", "\n", ""]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "!?"), (None, "rare x1"), (None, "rare x1"), (3, "THE the b"), (600, "b " * 40_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(20)] + [(90, None), (91, "nothing?"), (None, "rare rare"), (92, "the " * 300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as terms").repartition(3)
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string").selectExpr("*", "1 as rank")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(ranked(docs, items, 10), key=key)
    assert sorted(map(tuple, ranked_search.ranked_search(table, asked, 10).collect()), key=key) == want
    index, n, _ = ranked_search.build_index(table, block_bytes=200, block_docs=7)
    assert sorted(map(tuple, ranked_search.search(index, n, asked, 10).collect()), key=key) == want
    assert ranked_search.ranked_search(table.where("false"), asked).count() == 0 and ranked_search.ranked_search(table, asked.where("false")).count() == 0
    assert ranked_search.ranked_search(table.where("doc_id = 502"), asked).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 2)
    docs, items = [(i, f"a{i % 3} b{i % 5} c") for i in range(30)], [(i, f"a{i % 3} b{i % 4} b1") for i in range(9)]
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(ranked(docs, items, 4))


def test_fingerprints_of_documents(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = [(i * 11 % 97, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 200])))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "é😀日"), (1003, "long " * 30_000), (1004, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as n_chars").repartition(5)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (i, text), (_, other) in zip(order, [*order[1:], order[0]], strict=True):
        text, other = text or "", other or ""
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.fingerprint(text), fingerprints.fingerprint(edited))
        a, b, c = (fingerprints.read(fingerprints.fingerprint(t)) for t in (text, edited, other))
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1.0 if text == edited else True) and (r.near_next == 1.0 if text == other else True)
        if len(text) > 1000 and text != other:
            assert r.near_edited > 0.5 > r.near_next
    assert fingerprints.fingerprint_documents(docs.where("false")).count() == 0
    one = fingerprints.fingerprint_documents(docs.where("doc_id = 1002")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_repeated_and_null_ids(spark):
    rows = [(5, "same text here")] * 40 + [(5, "another"), (None, "null one"), (None, None), (1, "x")]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r.near_next == 1.0 for r in got if r.n_chars == 14) >= 39
    assert len({r.fingerprint for r in got if r.n_chars == 14}) == 1


def test_a_walk_is_what_its_definition_says():
    moves = np.random.default_rng(12).integers(0, 2, (fingerprints.PERIOD, fingerprints.CLASSES), np.int8)
    moves[-1] = 1
    text = "".join(random.Random(1).choice("abc é") for _ in range(3000))
    walk = fingerprints.Walk(text)
    step, steps = 0, []
    for c in walk.classes.tolist():
        steps.append(step)
        while not moves[step % fingerprints.PERIOD, c]:
            step += 1
        step += 1
    assert walk.steps.tolist() == [*steps, step]


def test_near_documents_by_bands(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = []
    for g in range(25):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(400, 3000)))
        texts += [(len(texts) + j, base if j < 2 else base[:-3] + "x" * j) for j in range(4)]
    texts += [(500 + i, "short") for i in range(3)] + [(600, "shorn")]
    prints = spark.createDataFrame([(i, fingerprints.fingerprint(t)) for i, t in texts] + [(700, None)], "doc_id long, fingerprint string")
    got = {r.doc_id: r.component_id for r in fingerprints.near_documents(prints, 0.8, together=3).collect()}
    assert got == {i: (i // 4 * 4 if i < 100 else 500 if i < 600 else i) for i, _ in texts} | {700: 700}


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


SOME = ["a", "b", " ", "  ", "\n", "'s", "don't", "é", "²", "日本", "😀", "\x1c", "\x85", "　", "<|endoftext|>", "!!", "23", "_", "aaaaaaaaaa", "́", "The ", "ing", "\t", "\x00", "'", "▁", "<s>", " hello", " world"]


def brute(text, libraries):
    from granary.llm.bpe import byte_alphabet

    a, b = libraries
    if not text:
        return None
    names, alphabet = {v: k for k, v in a.get_vocab().items()}, byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, out_type=int)
    raw_a = [bytes(alphabet[c] for c in names[i]) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    spans = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))]
    sa, sb = spans(raw_a), spans(raw_b)
    groups, i, j = [], 0, 0
    for end in sorted({e for _, e in sa} & {e for _, e in sb}):
        x, y = [], []
        while i < len(sa) and sa[i][1] <= end:
            x.append(ids_a[i])
            i += 1
        while j < len(sb) and sb[j][1] <= end:
            y.append(ids_b[j])
            j += 1
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
    links = [(ids_a[p], ids_b[q]) for p, (a0, a1) in enumerate(sa) for q, (b0, b1) in enumerate(sb) if a0 < b1 and b0 < a1]
    return len(ids_a), len(ids_b), ";".join(groups), links


@pytest.mark.parametrize(("frequent", "stretch", "unbroken"), [(0, 1 << 16, 1 << 11), (40, 5, 4), (1 << 18, 1 << 16, 1 << 11)])
def test_alignment(spark, libraries, monkeypatch, frequent, stretch, unbroken):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "UNBROKEN", unbroken)
    rng = random.Random(frequent)
    texts = [(i * 7 % 211, "".join(rng.choice(SOME) for _ in range(rng.randint(0, 20)))) for i in range(120)] + [(400, None), (400, None), (401, ""), (None, "the end"), (402, "word " * 200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n_a", "'x' as pairs").repartition(3)
    found = [(i, brute(t, libraries)) for i, t in texts]
    counts = Counter(p for _, f in found if f for p in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = [(i, 0, 0, 0, 0, 0, 0, "", "") if f is None else (i, f[0], f[1], f[2].count(";") + 1, len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(f[2].encode()).hexdigest(), f[2]) for i, f in found]
    got = [tuple(r) for r in alignment.align_documents(docs, BYTE, PIECE, keep_groups=True, frequent=frequent).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[8])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert alignment.align_documents(docs.where("false"), BYTE, PIECE).count() == 0


def test_long_unbroken_texts_are_aligned(libraries):
    with open(PIECE, "rb") as f:
        own = alignment.Aligner(open(BYTE).read(), f.read())
    for text in ("x" * 5000, " " * 3000 + "a", "ab" * 40_000 + " tail", "one two " * 20_000):
        found = own.align(text)
        assert found["a"].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids and found["b"].tolist() == libraries[1].encode(text, out_type=int)
