"""Toxicity, language model and quality classifier."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import lm, neardup, quality_knn, toxicity
from docframe.llm.arrowmap import shared_dir

CALM = "the house by the lake was quiet and the boats lay still in the morning".split()
RUDE = ["idiot", "scum", "moron"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        words = list(rng.choice(CALM, int(rng.integers(5, 60))))
        toxic = int(i % 6 == 0)
        if toxic:
            words[:: max(1, len(words) // 4)] = rng.choice(RUDE, len(words[:: max(1, len(words) // 4)]))
        good = int(i % 5 != 0)
        text = " ".join(words) if good else " | ".join(w + "%%%" for w in words)
        rows.append((i, text, toxic, good))
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, toxic int, quality int")
    return docs, labels, rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("module, place, cut", [(toxicity, 2, 0.5), (quality_knn, 3, 0.3)])
def test_held_out_accuracy(corpus, module, place, cut):
    docs, labels, rows = corpus
    got = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
    held = [r for r in rows if held_out(r[0])]
    assert all(0 <= got[r[0]] <= 1 for r in rows)
    assert np.mean([(got[r[0]] >= cut) == r[place] for r in held]) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality_knn])
def test_edge_cases_of_classifiers(spark, corpus, module):
    docs, labels, _ = corpus
    model = module.fit(docs, labels)
    odd = spark.createDataFrame([(None, "the house", 1.0), (1, None, 2.0), (1, "", 3.0), (2, "w " * 50_000, 4.0)], "doc_id long, text string, score double")
    out = module.score(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert module.score(odd.limit(0), model).count() == 0
    nothing = module.fit(docs.limit(0), labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(odd, nothing).collect())
    one_class = module.fit(docs, labels.where("toxic = 0 AND quality = 1"))
    assert all(0 <= r.score <= 1 for r in module.score(odd, one_class).collect())
    twice = module.fit(docs, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, None)], labels.schema)))
    assert module.score(docs, twice).count() == docs.count()


def test_toxicity_shares_backoff():
    words = [b"calm", b"calmly", b"scum", b"scummy"]
    model = toxicity.fit_words(words, np.array([50_000, 9_000, 0, 0]), np.array([20_000, 3_000, 600, 90]))
    buf = np.frombuffer(b"scumcalmzzzz", np.uint8)
    score = model.words(buf, np.array([0, 4, 8]), np.array([4, 8, 12]))
    assert score[0] > 1 and score[1] < 0.1 and abs(score[2]) < 0.5  # an unknown word is no evidence


def spelling(words, ordinary, toxic, order, share):
    """The evidence of each word by dictionaries: class-conditional Kneser-Ney over a shared model, the toxic one refitted."""
    discount, strength = toxicity.DISCOUNT, toxicity.STRENGTH
    padded = {w: [None] * order + ["^", *w] for w in words}
    grams = lambda w, k: [tuple(padded[w][i - k : i + 1]) for i in range(order + 1, len(padded[w]))]

    def smoothed(counts, low):
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += n > 0
        return {g: (max(n - discount, 0) + discount * kinds[g[:-1]] * low(g)) / total[g[:-1]] for g, n in counts.items()}

    shared = {}
    for k in range(order + 1):
        if k < order:  # different longer grams that end so
            counts = Counter(g[1:] for g in {g for w in words for g in grams(w, k + 1)})
        else:
            counts = Counter()
            for w, n in zip(words, ordinary + toxic, strict=True):
                for g in grams(w, k):
                    counts[g] += int(n)
        lower = shared
        shared = smoothed(counts, (lambda g: lower[g[1:]]) if k else (lambda g: 1 / 256))

    def fit(weights):
        counts, total, kinds = Counter(), Counter(), Counter()
        for w, n in zip(words, weights, strict=True):
            for g in grams(w, order):
                counts[g] += n
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += n > 0
        return {g: math.log((max(n - discount, 0) + (strength + discount * kinds[g[:-1]]) * shared[g]) / (total[g[:-1]] + strength)) for g, n in counts.items()}

    mine = np.ones(len(words))
    for again in range(toxicity.REFITS + 1):
        a, b = fit(toxic * mine), fit(ordinary + toxic * (1 - mine if again else 0))
        ratio = np.array([sum(a[g] - b[g] for g in grams(w, order)) for w in words])
        odds = share * np.exp(np.minimum(ratio, 40))
        mine = odds / (1 - share + odds)
    return np.log1p(share * np.expm1(np.minimum(ratio, 40)))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_toxicity_against_brute_force(order):
    rng = np.random.default_rng(order)
    words = sorted({bytes(rng.choice(list(b"abcde"), int(rng.integers(1, 9)))) for _ in range(60)})
    ordinary, toxic = rng.integers(0, 30, len(words)), rng.integers(0, 6, len(words)) * (rng.random(len(words)) < 0.4)
    ordinary[ordinary + toxic == 0] = 1
    model = toxicity.fit_words(words, ordinary, toxic, order=order, share=0.05)
    buf = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    got = model.words(buf, stop - [len(w) for w in words], stop)
    assert np.allclose(got, spelling(words, ordinary, toxic, order, 0.05), atol=1e-4)


def test_votes_against_brute_force():
    """Every document's nearest labelled ones by all cosines, their votes weighted by a power of the cosine."""
    rng = np.random.default_rng(6)
    size = quality_knn.PAIRS + quality_knn.STYLES
    draw = lambda n: np.log1p(rng.poisson(rng.random((n, size)) ** 6 * 3)).astype(np.float32)
    counts, good = draw(120), rng.integers(0, 2, 120)
    model = quality_knn.fit_terms(counts, good, (300, 900))
    tested = draw(25)
    tested[3] = 0
    score, nearest = model.score(tested)
    vectors = model.project(tested).astype(np.float64)
    weights = [300 / (good == 0).sum(), 900 / (good == 1).sum()]
    for i, v in enumerate(vectors):
        if i == 3:
            assert math.isclose(score[i], 0.75, rel_tol=1e-6) and nearest[i] == 0  # without terms: the share of good labels
            continue
        cosines = sorted(((float(v @ u), int(g)) for u, g in zip(model.vectors, good, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(max(c, 1e-3) ** quality_knn.POWER * weights[g], g) for c, g in cosines]
        assert math.isclose(score[i], sum(w for w, g in votes if g) / sum(w for w, _ in votes), rel_tol=1e-3, abs_tol=1e-6)
        assert math.isclose(nearest[i], cosines[0][0], rel_tol=1e-4)


def test_the_sample_is_bounded(spark):
    """An id that the documents list a thousand times is one row of the sample."""
    from docframe.llm import labelled

    docs = spark.range(2000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows, _ = labelled.sample(docs, labels, "toxic", 50)
    found = rows.collect()
    assert len(found) <= 100 and len({r._id for r in found}) == len(found) and all(r._fold for r in found)


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def kneser_ney(train):
    """Trigram model by dictionaries: the probability of a word after two, its words, their counts and the number of tokens."""
    rows = [tokens(t) for t in train]
    c = Counter(w for r in rows for w in r)
    total, words = sum(c.values()), len(c)
    padded = [["<0>", "<s>", *r] for r in rows]
    triples = Counter((r[i - 2], r[i - 1], r[i]) for r in padded for i in range(3, len(r)))
    pairs = Counter({k[1:]: 0 for k in triples})
    for _, v, w in triples:
        pairs[v, w] += 1  # different words before the pair
    pairs.update(("<s>", r[0]) for r in rows)  # none can be before these: their count
    before = Counter(w for _, w in pairs)
    d3, d2, d1 = ([0, *lm.discounts_of([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)])] for x in (triples, pairs, before))
    n3, n2, off3, off2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, _), k in triples.items():
        n3[u, v] += k
        off3[u, v] += d3[min(k, 3)]
    for (v, _), k in pairs.items():
        n2[v] += k
        off2[v] += d2[min(k, 3)]
    rest = sum(d1[min(v, 3)] for v in before.values()) / len(pairs) if pairs else 1

    def probability(u, v, w):
        p = (max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) if pairs else 0) + rest / (words + 1)
        if n2[v]:
            p = (max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) + off2[v] * p) / n2[v]
        if n3[u, v]:
            p = (max(triples[u, v, w] - d3[min(triples[u, v, w], 3)], 0) + off3[u, v] * p) / n3[u, v]
        return p

    return probability, c, total


def brute_force(train, texts):
    probability, c, total = kneser_ney(train)
    out = []
    for t in texts:
        base = score = 0.0
        row = ["<0>", "<s>", *tokens(t)]
        for i in range(2, len(row)):
            score += math.log10(probability(row[i - 2], row[i - 1], row[i]))
            base += math.log10((c[row[i]] + 1) / (total + len(c) + 1))
        out.append((len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), base, score))
    return out, total


@pytest.mark.parametrize("pair_tokens", [50, 2_000_000])
def test_language_model_against_brute_force(spark, monkeypatch, pair_tokens):
    monkeypatch.setattr(lm, "PAIR_TOKENS", pair_tokens)  # many ranges, and frequent words cut by their second word
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(CALM, int(rng.integers(0, 40)))) for _ in range(80)] + [None, "", "Lake LAKE lake"] + ["the " * 300]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = lm.train(train, shared_dir(spark))
    tested = [*texts, "an unseen boat", "the unseen"]
    out = lm.score(spark.createDataFrame(list(enumerate(tested)), "i int, text string"), model).orderBy("i").collect()
    want, total = brute_force(texts, tested)
    assert model.tokens == total
    for r, w in zip(out, want, strict=True):
        assert (r.n_tokens, r.n_known) == w[:2]
        assert math.isclose(r.base_score, w[2], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, w[3], rel_tol=1e-9, abs_tol=1e-9)


def test_language_model_with_hot_words_of_one_successor(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIR_TOKENS", 50)  # each first word is cut in seven, and six parts hold no pair
    texts = [f"{a} {b}" for a, b in zip(CALM, CALM[1:], strict=False)] * 300
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), shared_dir(spark))
    tested = [*sorted(set(texts)), *(f"{w} unseen" for w in CALM)]
    out = lm.score(spark.createDataFrame(list(enumerate(tested)), "i int, text string"), model).orderBy("i").collect()
    for r, w in zip(out, brute_force(texts, tested)[0], strict=True):
        assert math.isclose(r.score, w[3], rel_tol=1e-9, abs_tol=1e-9), r.text


def test_language_model_is_a_distribution(spark):
    """After every context the probabilities of all words, of the end and of one unknown word add up to one, and scores are
    made of these probabilities."""
    texts = ["a b a c a b a", "b a b", "c c a b a c", "a b", "", "d a b a"]
    probability, c, _ = kneser_ney(texts)
    contexts = [["<0>", "<s>"], ["<s>", b"a"], [b"a", b"b"], [b"b", b"a"], [b"c", b"a"], [b"a", b"unknown"], [b"unknown", b"a"], [b"d", b"d"]]
    for u, v in contexts:
        assert math.isclose(sum(probability(u, v, w) for w in [*c, b"another"]), 1, rel_tol=1e-12), (u, v)
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), shared_dir(spark))
    asked = [f"{x} {y} {z}".strip() for x in ("", "a", "b", "unknown") for y in ("a", "c", "d") for z in ("a", "b", "unknown", "")]
    found = [r.score for r in lm.score(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model).orderBy("i").collect()]
    assert all(math.isclose(x, w[3], rel_tol=1e-9) for x, w in zip(found, brute_force(texts, asked)[0], strict=True))


def test_language_model_input_cases(spark):
    """Names that clash, null ids, an empty table, and a very long text."""
    train = spark.createDataFrame([("a b c", 1), (None, 2), ("a b " * 60_000, 3)], "text string, score int")
    model = lm.train(train, shared_dir(spark))
    odd = spark.createDataFrame([(None, "a b", 1, 2), (None, None, 1, 2), (7, "b a " * 50_000, 1, 2)], "doc_id long, text string, score int, n_tokens int")
    out = lm.score(odd, model)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_tokens", "n_known", "base_score", "score"])
    rows = {(r.doc_id, r.text is None): r for r in out.collect()}
    assert rows[None, True].n_tokens == 1 and rows[None, False].n_tokens == 3 and rows[7, False].n_tokens == 100_001
    want = brute_force(["a b c", None, "a b " * 60_000], ["b a " * 50_000])[0][0]
    assert math.isclose(rows[7, False].score, want[3], rel_tol=1e-9)
    assert lm.score(odd.limit(0), model).count() == 0


def test_empty_language_model(spark):
    model = lm.train(spark.createDataFrame([], "text string"), shared_dir(spark))
    out = lm.score(spark.createDataFrame([("a b",), (None,)], "text string"), model).collect()
    assert [(r.n_tokens, r.n_known, r.score, r.base_score) for r in out] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


# -- near-duplicates --


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 4 * n >= 3 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    texts = []
    passage = " ".join(word() for _ in range(60))
    for f in range(12):  # families of copies, near copies and chains, some of which share a passage
        base = [word() for _ in range(int(rng.integers(6, 120)))]
        for k in range(7):
            changed = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 12)))):
                changed[int(rng.integers(0, len(changed)))] = word()
            texts.append(" ".join(changed) + (" " + passage if f % 3 == 0 else ""))
            if k % 3 == 0:
                base = changed  # the family drifts
    texts += ["one two three", "One  two three", "one two", "", None, " \n", "a b c d e", "A B C D E f"] + ["copy of a text that many have"] * 40
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component_id long").repartition(3)
    want, sizes = linked(rows)
    got = {r.doc_id: r for r in neardup.groups(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == sizes[i] and got[i].kept == (want[i] == i) for i in want)


def test_stars_try_all_pairs_of_mixed_buckets(spark, tmp_path):
    """In one bucket, the first member is like none, the others are alike in pairs: later centres find them."""
    texts = {1: "a b c d e f g h", 2: "q r s t u v w x", 3: "q r s t u v w x y", 4: "k l m n o p q1 r1", 5: "k l m n o p q1 r1 s1"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "_id long, _text string")
    signed = neardup._signed(docs, "_text").drop("_text").withColumn("_keys", F.array(F.lit(77).cast("long")))
    roots = {r.node: r.root for r in neardup._links(docs, signed, f"file://{tmp_path}/x").collect()}
    assert roots == {2: 2, 3: 2, 4: 4, 5: 4}


def _sets(texts):
    found = {}
    for i, text in texts.items():
        w = text.lower().split()
        found[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    return found


def _brute(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def test_groups_equal_brute_force_near_the_border(spark):
    """A large family of copies with similarities around 0.75, passages that many documents share, and small texts."""
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    template, passage, texts = fresh(140), fresh(60), {}
    for i in range(150):
        words = list(template)
        for k in rng.choice(len(words), int(rng.integers(1, 8)), replace=False):
            words[k] = f"x{rng.integers(0, 10**9)}"
        texts[i] = " ".join(words)
    for i in range(150, 230):
        texts[i] = " ".join(fresh(int(rng.integers(5, 40))) + passage + fresh(int(rng.integers(5, 40))))
    for i in range(230, 330):
        base = fresh(int(rng.integers(1, 30)))
        texts[i], texts[i + 100] = " ".join(base), " ".join([*base, *fresh(int(rng.integers(0, 4)))])
    sets = _sets(texts)
    want = _brute(sets)
    got = neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 800, 5000):
        for _ in range(20):
            h = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            a, b = h[rng.random(n) < 0.8], h[rng.random(n) < 0.8]
            bits = sum(int(x).bit_count() for x in (neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))


def test_groups_edge_cases(spark):
    kind = "doc_id long, text string"
    assert neardup.groups(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "a b c d e f"), (3, None), (5, "x"), (5, "x"), (4, "x"), (9, "w%d " * 30000 % tuple(range(30000)))]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.groups(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 0, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (9, 9, True)]
    clash = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b", 7, 8, 9)], "doc_id long, text string, root long, _keys long, component_id long")
    assert sorted((r.doc_id, r.component_id) for r in neardup.groups(clash).collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_densified_signatures_estimate_similarity(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    signer = neardup.Signer()
    one = signer.signature(a)
    assert set(one) <= set(a) and (one == signer.signature(a)).all()
    both = np.unique(np.concatenate([a, rng.integers(0, 2**63, max(1, n // 4)).astype(np.uint64)]))
    two = signer.signature(both)
    share = (one == two).mean()
    assert abs(share - len(a) / len(both)) < 0.25
