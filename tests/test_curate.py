from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import curate


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scrub_keeps_the_order_of_patterns(spark):
    row = docs(spark, ["mail a.b@c.org or 123-45-6789, host 10.0.0.1, call (555) 123-4567"]).select(T.scrub(F.col("text"))).first()[0]
    assert row == "mail [EMAIL] or [SSN], host [IP], call [PHONE]"


def test_language_and_quality(spark):
    english = "the cat sat on the mat and it was happy with the sun in the window for a long time of day"
    rows = docs(spark, [english, "бвг деж", "", "123 456"]).select(T.language(F.col("text")), T.quality_ok(F.col("text"))).collect()
    assert [r[0] for r in rows] == ["en", "unknown", "unknown", "unknown"]
    assert [r[1] for r in rows] == [True, False, False, False]


def test_near_duplicates_keep_first_along_a_chain(spark):
    every = docs(spark, list("abc"))
    chain = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert sorted(r[0] for r in curate.keep_first(every, chain).select("doc_id").collect()) == [0, 2]


def test_near_duplicates_keep_first_along_a_long_chain(spark):
    kept = lambda n, **more: sorted(r[0] for r in curate.keep_first(spark.range(n).withColumnRenamed("id", "doc_id"), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"), **more).select("doc_id").collect())
    assert kept(400) == list(range(0, 400, 2))
    assert kept(110, small=0) == list(range(0, 110, 2))


def test_near_duplicate_pairs(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100", "x")
    far = " ".join(f"z{i}" for i in range(200))
    pairs = curate.near_duplicate_pairs(docs(spark, [base, base, near, far, "short"])).collect()
    assert {(r.a, r.b) for r in pairs} == {(0, 1), (0, 2)}  # 1 is a copy of 0


def test_decontamination(spark):
    passage = " ".join(f"t{i}" for i in range(20))
    every = docs(spark, [f"before {passage} after", "clean text of some words", " ".join(passage.split()[:10])])
    evals = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r[0] for r in curate.decontaminated(every, evals).select("doc_id").collect()) == [1, 2]


def test_mixture_is_deterministic_and_cycles(spark):
    a, b = docs(spark, ["a0", "a1"]), docs(spark, ["b0"])
    draw = lambda: [(r.draw, r.text) for r in curate.mixture({"a": (a, 0.5), "b": (b, 0.5)}, 50, 3).orderBy("draw").collect()]
    first = draw()
    assert len(first) == 50 and first == draw()
    assert [t for _, t in first if t.startswith("a")][:4] == ["a0", "a1", "a0", "a1"]


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("doc_id < 0")
    assert curate.near_duplicate_pairs(none).count() == 0
    assert curate.exact_duplicates(none).count() == 0


def test_near_duplicate_pairs_count_ngrams_once(spark):
    """Against brute force, and n-grams are ranked and met once: what is verified is read back, no window over all n-grams stands in the plan."""
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(3, 40))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(5):
            some = list(words)
            for _ in range(rng.randint(0, 2)):
                some[rng.randrange(len(some))] = f"w{rng.randrange(60)}"
            texts.append(" ".join(some))
    texts += [None, "", "one two three four"]
    pairs = curate.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in enumerate(texts) for w in [(t or "").split()]}
    first = {}
    for i, g in grams.items():
        if g:
            first.setdefault(frozenset(g), i)
    want = {(first[frozenset(g)], i) for i, g in grams.items() if g and first[frozenset(g)] != i}
    want |= {(a, b) for a in first.values() for b in first.values() if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 10
    assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_a_copy_goes_with_its_first(spark):
    """1 goes for 0, and so does its copy 2; 3 is near to 1 and 2 only and stays, as they are gone; its copy 4 goes."""
    base = [f"w{i}" for i in range(100)]
    changed = lambda words, at: [*words[:at], "x", *words[at + 1 :]]
    near = changed(changed(base, 50), 35)
    far = changed(near, 20)
    texts = [" ".join(w) for w in (base, near, near, far, far)]
    assert sorted(r[0] for r in curate.first_of_near_duplicates(docs(spark, texts)).select("doc_id").collect()) == [0, 3]


def test_near_duplicates_kept_by_all_pairs(spark):
    import random

    rng = random.Random(8)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(8)]
    texts = []
    for _ in range(120):
        words = list(rng.choice(base))
        for at in rng.sample(range(4), rng.randrange(3)):
            words[10 + 14 * at] = "x"
        texts.append(" ".join(words))
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    kept = []
    for i, g in enumerate(grams):
        if all(len(g & grams[k]) < 0.8 * len(g | grams[k]) for k in kept):
            kept.append(i)
    assert sorted(r[0] for r in curate.first_of_near_duplicates(docs(spark, texts)).select("doc_id").collect()) == kept and len(kept) > 10


def test_curated_corpus_drops_copies_with_their_first(spark):
    words = "the cat sat on a mat and it was happy with warm sun in its window for some long time of day".split()
    base = [f"{w}{'abcdefgh'[i // len(words)]}" if i % 4 else w for i in range(5 * len(words)) for w in [words[i % len(words)]]]
    changed = lambda words, at: [*words[:at], "other", *words[at + 1 :]]
    near = changed(changed(base, 50), 35)
    far = changed(near, 20)
    texts = docs(spark, [" ".join(w) for w in (base, near, near, far, far)]).withColumn("source", F.lit("site-1"))
    assert sorted(r[0] for r in curate.curate(texts, docs(spark, ["nothing of this"]), ["mit"]).select("doc_id").collect()) == [0, 3]


def test_shared_ngrams_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(curate, "COUNTED", 3)
    sets = spark.createDataFrame([(1, [-5, 2, 1 << 40]), (2, [2, 7]), (3, [-5, 2]), (4, [])], "doc_id long, s array<long>")
    assert sorted(map(tuple, curate._shared(sets).collect())) == [(1, -5, 2), (1, 2, 3), (2, 2, 3), (3, -5, 2), (3, 2, 3)]
    assert curate._shared(sets.where("doc_id > 9")).count() == 0


def test_curated_corpus_scrubs_once(spark):
    """What is read twice, to be told contaminated and to be returned, was scrubbed before."""
    texts = docs(spark, ["a text"]).withColumn("source", F.lit("site-1"))
    assert "PHONE" not in curate.curate(texts, docs(spark, ["nothing of this"]), ["mit"])._jdf.queryExecution().toString()


def test_letters_and_scrubbing_by_parts(spark):
    text = "é1ß 𝒜b, call 555-123-4567 or 1.2.3.4, a@b.org"
    found = docs(spark, [text, "", None]).select(T.letters(F.col("text")), T.scrub(F.col("text"))).collect()
    assert found[0][0] == sum(c.isalpha() for c in text) and found[0][1] == "é1ß 𝒜b, call [PHONE] or [IP], [EMAIL]"
    assert tuple(found[1]) == (0, "") and tuple(found[2]) == (None, None)
