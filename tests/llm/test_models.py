"""Whitening, source divergence and language-model scores against brute force, on awkward rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from binomia.llm import divergence, ppm, whitening
from binomia.llm.queries import op11_embedding_whitening, op13_lm_scoring

DOCS = "doc_id long, text string, lang string, source string, words string, grams string"
VECTORS = "vec_id long, embedding array<float>, label int, x string"


def rows_of(r, n):
    """Texts of several languages and sources: nulls, empties, repeats, ties, junk, long words, clashing columns."""
    words = [f"w{k}" for k in range(40)] + ["É", "straße", "日本", "X-1", "don't", "a" * 90, " b"]
    out = []
    for k in range(n):
        text = "  ".join(r.choice(words) for _ in range(r.randrange(30)))
        text = r.choice([text, text.upper(), text.replace("  ", "\n\t"), text, None, "", "!?"])
        out.append((k, text, r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s1", "s2", None, "s3"]), "clash", "clash"))
    out += [out[3], (None, "w1 w2 w3", "en", "s1", "", ""), (n, "w1 " * 3000, "en", "s2", "", ""), (n + 1, "only here", "xx", "lone", "", "")]
    return out


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(7), 150)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


# whitening


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    dev = [sum(int(v) ** 2 for v in n * row.astype(object) - s.astype(object)) for row in x]
    c = (x - s // n) - (s - n * (s // n)) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, dev, c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_equals_dense_eigenvectors(spark):
    g = np.random.default_rng(3)
    good = (g.standard_normal((120, 12)) * np.linspace(3, 0.4, 12)).astype(np.float32)
    good[50:60] = good[40]  # copies
    bad = [None, [], [1.0] * 11 + [None], [float("nan")] + [0.0] * 11, [0.0] * 11 + [float("-inf")], [1e30] + [0.0] * 11, [1.0, 2.0]]
    rows = [(k, v.tolist(), k % 3, "c") for k, v in enumerate(good)] + [(1000 + k, v, 0, None) for k, v in enumerate(bad)] + [(None, good[0].tolist(), 0, None), (5, good[5].tolist(), 0, None)]
    used = [r[1] for r in rows[:120]] + [rows[-2][1], rows[-1][1]]
    n, dev, white, share = brute_whitening(used, 5)
    out = whitening.whitened_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), components=5, block=3).toPandas()
    assert len(out) == 5 * n and set(out["n"]) == {n} and set(out["component"]) == {1, 2, 3, 4, 5}
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    for c in range(5):
        part = out[out["component"] == c + 1]
        assert np.allclose(part["explained"], share[c], rtol=1e-10)
        got = part.drop_duplicates("vec_id").set_index("vec_id")
        sign = np.sign(got.loc[0, "whitened"] * white[0, c])
        for k in range(120):
            assert abs(got.loc[k, "whitened"] * sign - white[k, c]) < 1e-8 and int(got.loc[k, "deviation"]) == dev[k]
    assert len(out[out["vec_id"] == 5]) == 10 and out["vec_id"].isna().sum() == 5


def test_whitening_of_low_rank_constant_and_empty_tables(spark):
    g = np.random.default_rng(4)
    flat = np.outer(g.standard_normal(50), np.ones(4)).round(2)
    rows = lambda m: [(k, v.tolist(), 0, "") for k, v in enumerate(m)]
    out = whitening.whitened_vectors(spark.createDataFrame(rows(np.hstack([flat, np.zeros((50, 3))])), VECTORS)).toPandas()
    assert set(out["component"]) == {1} and abs(out["explained"].iloc[0] - 1) < 1e-12  # one direction, constant dimensions
    assert whitening.whitened_vectors(spark.createDataFrame(rows(np.ones((9, 3))), VECTORS)).count() == 0
    assert whitening.whitened_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened_vectors(spark.createDataFrame([(1, [2.0, 3.0], 0, "")], VECTORS)).count() == 0


@pytest.mark.parametrize(("block", "blocks"), [(2, 5), (4, 3), (8, 12), (50, 12)])
def test_lanczos_restarts_breaks_down_and_converges(block, blocks):
    g = np.random.default_rng(5)
    q = np.linalg.qr(g.standard_normal((60, 60)))[0]
    for e in (np.geomspace(100, 0.01, 60), np.r_[np.full(5, 7.0), np.full(55, 1.0)], np.r_[9.0, 4.0, np.zeros(58)]):
        a = (q * e) @ q.T
        passes = []
        values, vectors = whitening.block_lanczos(lambda x, a=a, passes=passes: passes.append(x.shape[1]) or a @ x, 60, 6, block, blocks)
        assert np.allclose(values, np.sort(e)[::-1][:6], atol=1e-9 * e.max())
        assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-9 * e.max()


def test_deviations_of_very_large_sums_are_exact(spark):
    big = 1e11
    rows = [(k, [big * (k % 3), -big, 0.5], 0, "") for k in range(7)]
    got = whitening.whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string"), components=1).collect()
    x = [[int(math.floor(64 * v)) + 1_000_000 for v in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {k: sum((7 * v - t) ** 2 for v, t in zip(r, s, strict=True)) for k, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want and max(want.values()) > 2**63
    assert {r[0] for r in op11_rows(spark, rows)} == {None}


def op11_rows(spark, rows):
    df = whitening.whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string"), components=1)
    return df.select(F.col("deviation").try_cast("long")).distinct().collect()


def test_whitening_query(spark):
    out = op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert out.count() == 32 * n and out.agg(F.max("identity_error")).first()[0] < 1e-9


# source divergence


def brute_divergence(rows, least, top):
    docs = [("" if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows]
    found = [[w for w in "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in lower(t)).split(" ") if w] for t, _, _ in docs]
    in_docs = Counter((lang, w) for (_, lang, _), ws in zip(docs, found, strict=True) for w in set(ws))
    kept = defaultdict(list)
    for (lang, w), n in in_docs.items():
        if n >= least:
            kept[lang].append(w)
    count = defaultdict(Counter)
    for (_, lang, source), ws in zip(docs, found, strict=True):
        for key in ((lang, source), lang):
            count[key].update(w for w in ws if w in set(kept[lang]))
    share = lambda key, lang, w: 1 + 10**9 * (count[key][w] + 1) // (sum(count[key].values()) + len(kept[lang]))
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    groups = sorted({(lang, s) for _, lang, s in docs})
    for lang, s in groups:
        pairs = [(o, sum(f(share((lang, s), lang, w), share((lang, o), lang, w)) for w in kept[lang])) for x, o in groups if x == lang and o != s]
        terms = [(w, share((lang, s), lang, w), share(lang, lang, w)) for w in kept[lang] if count[lang, s][w]]
        terms = [(w, f(p, q)) for w, p, q in terms if p > q]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "held"), [(3, 200, 500_000), (1, 3, 10), (10**6, 5, 10)])
def test_divergence_equals_brute_force(docs, rows, least, top, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, least, top).collect())
    assert got == brute_divergence(rows, least, top)


def test_divergence_of_an_empty_table_and_lone_sources(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    one = spark.createDataFrame([(k, "a b c", "en", "s", "", "") for k in range(3)], DOCS)
    assert divergence.source_divergence(one).count() == 0  # its shares are those of its language


# language-model scores


def brute_ppm(texts, learns, order):
    """Dictionaries of contexts, one byte after the other."""
    words = [lower(t).replace(" ", "").encode().replace("".encode(), " ".encode()).split() for t in texts]
    coded = [b"".join(w + b" " for w in ws) + b"\n" for ws in words]
    trie = defaultdict(Counter)
    contexts = lambda data, i: [(b" " + data)[max(0, i + 1 - k) : i + 1] for k in range(min(order, i + 1), -1, -1)]
    for data, ok in zip(coded, learns, strict=True):
        for i in range(len(data) if ok else 0):
            for c in contexts(data, i):
                trie[c][data[i]] += 1

    def code(data, i):
        out, gone = 0.0, set()
        for c in contexts(data, i):
            left = {s: n for s, n in trie[c].items() if s not in gone} if c in trie else {}
            total = sum(left.values())
            if data[i] in left:
                return out + math.log10((2 * left[data[i]] - 1) / (2 * total))
            if left:
                out += math.log10(len(left) / (2 * total))
            gone |= set(left)
        return out - math.log10(ppm.SYMBOLS - len(gone))

    known = Counter()
    for ws, ok in zip(words, learns, strict=True):
        known.update([*ws, None] if ok else [])
    n, v = sum(known.values()), len(known)
    out = []
    for ws, data in zip(words, coded, strict=True):
        tokens = [*ws, None]
        base = sum(math.log10((known[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens) if n else None
        out.append((len(tokens), sum(known[t] > 0 for t in tokens), n, base, sum(code(data, i) for i in range(len(data)))))
    return out


@pytest.mark.parametrize(("order", "small"), [(5, False), (3, True), (6, True)])
def test_scores_equal_brute_force(docs, rows, order, small, monkeypatch):
    if small:  # next to nothing is frequent, tasks hand on early
        for name, value in (("FREQUENT", 20), ("FREQUENT_WORDS", 5), ("HELD_WORDS", 10), ("HELD_GRAMS", 50), ("BLOCK", 500), ("STEP", 30), ("PART", 200), ("SEEN", 3)):
            monkeypatch.setattr(ppm, name, value)
    learns = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1 for r in rows]
    want = defaultdict(list)
    for r, ok, w in zip(rows, learns, brute_ppm([r[1] for r in rows], learns, order), strict=True):
        want[r[0], ok].append(w)
    got = defaultdict(list)
    for r in ppm.lm_scores(docs, ~ppm.held_out(), order).collect():
        got[r.doc_id, r.learns].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == want.keys()
    for key in want:
        for g, w in zip(sorted(got[key]), sorted(want[key]), strict=True):
            assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9) and g[4] == pytest.approx(w[4], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    """Over all symbols, in contexts that were seen and in ones that weren't."""
    texts = [ppm.coded(t.split()) for t in (b"abra cadabra", b"abracadabra", b"barbara", "é à".encode())]
    grams, n = ppm._merged(ppm._NONE, ppm.grams_of(texts)[0], True)
    low = ppm.low_levels(grams, n)
    symbols = np.array([s for s in range(256) if s not in (9, 11, 12, 13)], np.uint64)
    assert len(symbols) == ppm.SYMBOLS
    for context in (b" abra", b"abr", b"cadab", b"zzzzz", b" ", b"brazz", "é".encode()):
        asked = symbols | np.uint64(int.from_bytes(context, "big") << 8) | np.uint64(len(context) << 56)
        every = np.union1d(asked, grams)
        trie = ppm.levels(grams, n, low, ppm.ORDER)
        assert 10.0 ** ppm.log_probabilities(asked, trie) @ np.ones(len(asked)) == pytest.approx(1.0)
        assert len(every) >= len(asked)


def test_scores_without_training_texts_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab c", "", "", "", ""), (2, None, "", "", "", "")], DOCS)
    got = {r.doc_id: r for r in ppm.lm_scores(docs, F.lit(None).cast("boolean")).collect()}
    assert got[2].n_tokens == 1 and got[2].n_known == 0 and got[2].base_score is None
    assert got[1].score == pytest.approx(-6 * math.log10(ppm.SYMBOLS)) and got[2].score == pytest.approx(-math.log10(ppm.SYMBOLS))
    assert ppm.lm_scores(docs.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="contexts"):
        ppm.lm_scores(docs, F.lit(True), 2)


def test_places_in_hash_tables():
    g = np.random.default_rng(1)
    keys = np.unique(g.integers(0, 1 << 50, 5000).astype(np.uint64))
    places = ppm.Places(keys)
    asked = np.concatenate([keys, g.integers(0, 1 << 50, 5000).astype(np.uint64)])
    want = [int(np.searchsorted(keys, q)) if q in set(keys.tolist()) else -1 for q in asked[:300].tolist()]
    assert places(asked)[: len(keys)].tolist() == list(range(len(keys))) and places(asked[:300]).tolist() == want
    assert ppm.Places(keys[:0])(asked[:3]).tolist() == [-1, -1, -1]


def test_scores_of_held_out_texts_beat_word_counts(spark):
    """On whole tables: the trie is better than smoothed word frequencies, on texts that it didn't learn from, too."""
    out = op13_lm_scoring(spark, "/root/testdata/sf0.1")
    s = {r.held_out: r for r in out.groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).collect()}
    assert s[True].s > s[True].b and s[False].s > s[False].b and s[True].n + s[False].n == out.count()
