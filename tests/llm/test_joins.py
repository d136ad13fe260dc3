"""The n-gram join, the alignment of tokenizers and whitening against plain versions of their contracts."""

import hashlib
import json
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docframe.llm import alignment, ngramjoin, queries, whitening
from docframe.llm.bytebpe import ByteBpe
from docframe.llm.piecebpe import PieceBpe
from docframe.llm.wordbpe import _byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# n-gram join


def _set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def brute(rows, least=80):
    """component of each id; rows may repeat an id with other texts."""
    known = [(i, _set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, s) in enumerate(known):
        for j, t in known[k + 1 :]:
            if s and t and 100 * len(s & t) >= least * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def families(rng):
    """Copies around the limit, chains, passages that many share, small texts and a text that is one passage for the most part."""
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    template, passage, common, texts = fresh(140), fresh(60), fresh(90), []
    for _ in range(140):
        words = list(template)
        for k in rng.choice(len(words), int(rng.integers(1, 7)), replace=False):
            words[k] = f"x{rng.integers(0, 10**9)}"
        texts.append(words)
    for _ in range(60):
        texts.append(fresh(int(rng.integers(5, 40))) + passage + fresh(int(rng.integers(5, 40))))
    for _ in range(60):
        texts.append(fresh(int(rng.integers(4, 22))) + common + fresh(int(rng.integers(0, 6))))
    for _ in range(60):
        base = fresh(int(rng.integers(1, 40)))
        texts += [base, [*base, *fresh(int(rng.integers(0, 5)))], [*fresh(int(rng.integers(0, 3))), *base]]
    for _ in range(6):
        drift = fresh(90)
        for _ in range(8):
            drift = list(drift)
            drift[int(rng.integers(0, 90))] = fresh(1)[0]
            texts.append(drift)
    texts += [["same", "text"]] * 30 + [fresh(3000)] * 2
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("cells, small", [(1 << 4, 2), (1 << 16, 3), (1 << 12, 16)])
def test_join_equals_brute_force(spark, monkeypatch, cells, small):
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    rows = list(enumerate(families(np.random.default_rng(cells))))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One two"), (5004, "one  TWO"), (7, rows[300][1]), (5005, "É é x y z"), (5006, "é é x y z")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, "one two", 1, 2)], "doc_id long, text string, component_id int, root int").repartition(4)
    found = ngramjoin.classes(df, cells=cells).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == brute(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in found if r.doc_id is not None) == sorted((i, len(_set(t))) for i, t in rows)
    assert [(r.n_shingles, r.component_id) for r in found if r.doc_id is None] == [(1, None)]


def test_linked_sets_share_what_their_prefixes_need():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 120, 1 << 10).astype(np.uint8)
    needs = Counter()
    for n in (1, 2, 4, 5, 9, 30, 200, 900):
        for _ in range(60):
            cutter = ngramjoin.Prefixes(levels, float(rng.choice([0.1, 40.0, 3000.0])))
            pool = np.unique(rng.integers(0, 2**63, 2 * n + 3).astype(np.uint64) * np.uint64(2))
            x = np.sort(rng.choice(pool, n, replace=False))
            y = np.sort(np.unique(np.concatenate([x[rng.random(n) < 0.93], rng.choice(pool, max(0, n // 20))])))
            same = len(np.intersect1d(x, y))
            if not len(y) or 100 * same < 80 * (len(x) + len(y) - same):
                continue
            (p, kp, np_), (q, kq, nq) = cutter.cut(x), cutter.cut(y)
            needs[min(np_, nq)] += 1
            assert len(np.intersect1d(p, q)) >= min(np_, nq)
            first = next(h for h in p[:kp] if h in set(y.tolist()))
            assert first in q[:kq]
            least = -(-80 * (len(x) + len(y)) // 180)
            assert least <= len(x) - p.tolist().index(first) and least <= len(y) - q.tolist().index(first)
    assert len(needs) > 3  # needs of several sizes were tried


def test_frequent_shingles_leave_the_prefix_and_lengthen_it():
    hashes = np.arange(1, 101, dtype=np.uint64)
    levels = np.zeros(256, np.uint8)
    levels[1:51] = 100
    plain, keys, need = ngramjoin.Prefixes(levels, 0.5).cut(hashes)
    assert (keys, need) == (21, 1) and plain.min() > 50  # the rare half comes first
    levels[:] = 100
    longer, keys, need = ngramjoin.Prefixes(levels, 0.5).cut(hashes)
    assert keys == 21 and need > 1 and len(longer) == 20 + need


def test_pairs_of_a_key_are_not_all_made(spark, monkeypatch):
    """Documents that share most of a passage without linking: candidates stay far under all pairs."""
    rng = np.random.default_rng(2)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(60)
    rows = [(i, " ".join(fresh(int(rng.integers(20, 40))) + passage)) for i in range(400)]
    tried = []
    confirmed = ngramjoin._confirmed

    def spy(candidates, *more):
        tried.append(candidates.count())
        return confirmed(candidates, *more)

    monkeypatch.setattr(ngramjoin, "_confirmed", spy)
    found = ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in found) and sum(tried) < 800


# alignment


def _plain(text):
    """n_a, n_b, groups and linked pairs of one text, a token at a time."""
    if not text:
        return None
    lib_a = Tokenizer.from_file(A)
    lib_a.encode_special_tokens = True
    back = {c: b for b, c in enumerate(_byte_symbols())}
    names = {i: bytes(back[c] for c in s) for s, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    a = [(i, names[i]) for i in lib_a.encode(" " + text, add_special_tokens=False).ids]
    lib_b = sentencepiece.SentencePieceProcessor(model_file=B)
    b = []
    for i in lib_b.encode(text):
        p = lib_b.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    ends = lambda t: list(np.cumsum([len(x) for _, x in t]))
    ends_a, ends_b = ends(a), ends(b)
    cuts = sorted(set(ends_a) & set(ends_b))
    parts, links, low = [], [], 0
    for c in cuts:
        parts.append(",".join(str(i) for (i, _), e in zip(a, ends_a, strict=True) if low < e <= c) + "|" + ",".join(str(i) for (i, _), e in zip(b, ends_b, strict=True) if low < e <= c))
        links += [(i, j) for (i, _), e in zip(a, ends_a, strict=True) if e == c for (j, _), f in zip(b, ends_b, strict=True) if f == c]
        low = c
    return len(a), len(b), parts, links


ODD = ["one two", "Hello, world! it's 12,345 o'clock", None, "", " ", "\n\n x", "日本語 ok é ñ", "▁mark", "a ▁ b", "<|endoftext|> </s> <0x41>", "\x00\x01   z", "tab\there  two", "ﬁ ﬂ 🙂 x", "long " * 400, "x" * 700, "'s 're \t's", "one two", "naïve café’s “q” — 50 €"]


def test_alignment_equals_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two three")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, links string").repartition(3)
    found = {r.doc_id: r for r in alignment.linked(df, A, B).collect()}
    plain = {i: _plain(t) for i, t in rows}
    count = Counter(p for x in plain.values() if x for p in x[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    assert set(found) == set(plain)
    for i, x in plain.items():
        r = found[i]
        if x is None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, ""), i
            continue
        n_a, n_b, parts, links = x
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, len(parts), len(links)), i
        assert r.groups_sha256 == hashlib.sha256(";".join(parts).encode()).hexdigest(), i
        assert r.n_best == sum(count[p] == best[p[1]] for p in links) and r.count_sum == sum(count[p] for p in links), i
    assert plain[7] is None and plain[8] is None  # a literal mark isn't a space
    pairs = alignment.Pairs(ByteBpe(A).tokens, PieceBpe(B).pieces)
    out = alignment.align(df, A, B, pairs, groups=True).collect()
    assert {r.doc_id: r.groups for r in out} == {i: ";".join(x[2]) if x else "" for i, x in plain.items()}
    with pytest.raises(ValueError):
        alignment.align(df, A, B, pairs, keep=("links",))


def test_links_of_ends_that_several_tokens_have():
    rng = np.random.default_rng(1)
    for _ in range(200):
        rows = int(rng.integers(1, 4))
        cut = []
        for _ in range(rows):
            total = int(rng.integers(1, 12))
            pair = []
            for _ in range(2):
                ends = sorted([*rng.integers(0, total + 1, int(rng.integers(0, 6))).tolist(), total])
                pair.append(np.diff([0, *ends]))
            cut.append(pair)
        length = [np.concatenate([c[s] for c in cut]) for s in (0, 1)]
        row = [np.repeat(np.arange(rows), [len(c[s]) for c in cut]) for s in (0, 1)]
        found = alignment.Aligned(length[0], row[0], length[1], row[1])
        ends = [[(int(r), int(e)) for k, c in enumerate(cut) for r, e in ((k, x) for x in np.cumsum(c[s]))] for s in (0, 1)]
        want = [(i, j) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
        assert sorted(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == sorted(want)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        assert found.row_of_group.tolist() == [r for r, _ in cuts]
        assert found.group_a.tolist() == [sum(c < x for c in cuts) for x in ends[0]]


def test_pairs_that_can_end_together():
    a, b = [b"ab", b"b", b"", b"cab", b"b"], [b"b", b"xab", b"ab", b""]
    pairs = alignment.Pairs(a, b)
    want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]
    assert sorted(divmod(int(k), 4) for k in pairs.keys) == sorted(want)
    left, right = np.array([i for i, _ in want]), np.array([j for _, j in want])
    assert [divmod(int(pairs.keys[k]), 4) for k in pairs.numbers(left, right)] == want
    with pytest.raises(ValueError):
        pairs.numbers(np.array([0]), np.array([3]))


def test_salts_leave_counts_alone(spark):
    pairs = alignment.Pairs([b"x"] * 40, [b"x"])
    rows = [([int(v) for v in np.random.default_rng(k).integers(0, 40, k)],) for k in range(60)]
    df = spark.createDataFrame(rows, "links array<int>").repartition(7)
    want = Counter(v for (r,) in rows for v in r)
    for salts in (1, 3):
        assert {r["pair"]: r.links for r in alignment.pair_counts(df, pairs, salts).collect()} == want


# whitening


def _vectors(rng, n=300, d=6):
    x = rng.normal(0, [3, 2, 1, 0.5, 0.2, 0.1][:d], (n, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return x.astype(np.float32)


def _whole(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(256 * Fraction(c)) for c in v)


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    x = _vectors(rng)
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows += [(300 + i, rows[5][1], "k") for i in range(100)] + [(500, None, "k"), (501, [None, *rows[0][1][1:]], "k"), (502, [math.nan, *rows[0][1][1:]], "k"), (503, [math.inf, *rows[0][1][1:]], "k"), (504, [], "k"), (505, [1.0, 2.0], "k"), (506, [1e300, *rows[0][1][1:]], "k")]
    rows += [(None, rows[9][1], "k"), (7, rows[7][1], "k"), (8, [-0.0, -0.001, 0.0, 0.001, 1.0, -1.0], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(5)
    model = whitening.fit(df)
    found = whitening.whiten(df, model).collect()
    kept = [(i, w) for i, v, _ in rows if (w := _whole(v)) is not None and len(w) == 6 and i != 506]
    fit = sorted({w for _, w in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[float(c - Fraction(t, n)) for c, t in zip(w, s, strict=True)] for w in fit])
    cov = exact.T @ exact / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = Counter((i, k, n, sum((n * c - t) ** 2 for c, t in zip(w, s, strict=True))) for i, w in kept for k in range(1, 5))
    assert Counter((r.vec_id, r.component, r.n, int(r.deviation)) for r in found) == want
    whitened = {w: (np.array([float(c - Fraction(t, n)) for c, t in zip(w, s, strict=True)]) @ axes[:, :4]) / np.sqrt(values[:4]) for _, w in kept}
    of = defaultdict(set)
    for i, w in kept:
        of[i].add(w)
    sign = np.sign(np.sum(axes[:, :4] * model.components, axis=0))
    for r in found:
        assert any(abs(r.whitened - sign[r.component - 1] * whitened[w][r.component - 1]) < 1e-9 for w in of[r.vec_id])
        assert abs(r.explained / (values[r.component - 1] / cov.trace()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_deviations_are_exact_at_any_size():
    rng = np.random.default_rng(0)
    for n, most in ((1, 5), (10**4, 10**3), (10**10, 10**4), (10**9, 10**9), (10**15, 10**15)):
        x = rng.integers(-most, most + 1, (7, 5))
        sums = [int(v) * n for v in rng.integers(-most, most + 1, 5)]
        assert whitening.deviations(x, sums, n) == [sum((n * int(c) - t) ** 2 for c, t in zip(r, sums, strict=True)) for r in x]
        z = whitening.centred(x, sums, n)
        assert np.allclose(z, [[float(Fraction(int(c)) - Fraction(t, n)) for c, t in zip(r, sums, strict=True)] for r in x], rtol=1e-14)


def test_packed_vectors_come_back():
    rng = np.random.default_rng(9)
    rows = np.stack([rng.integers(-(2**b), 2**b, 8) for b in (1, 7, 8, 14, 15, 31, 40, 62) for _ in range(5)])
    packed = whitening.pack(rows)
    assert (whitening.unpack(pa.array(packed, pa.binary()), 8) == rows).all()
    assert (whitening.unpack(pa.array(packed, pa.binary())[3:9], 8) == rows[3:9]).all()
    assert len(set(packed)) == len(np.unique(rows, axis=0))


def test_vectors_without_variance(spark):
    kind = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(whitening.whiten(one, whitening.fit(one)).collect())] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    flat = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0]), (3, [1e9, 2.0, 5.0])], kind)
    found = sorted(whitening.whiten(flat, whitening.fit(flat)).collect(), key=lambda r: (r.vec_id, r.component))
    assert [r.whitened is None for r in found] == [False, True, True] * 3 and found[0].identity_error < 1e-9 and found[0].explained == 1
    for rows in ([], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, kind)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []


def test_queries_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_a long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, n int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_ngram_join", "op12_token_alignment", "op13_whitening"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
