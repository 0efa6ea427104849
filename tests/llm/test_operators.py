"""Operators against brute force, exact round trips and held-out accuracy, on awkward rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import binomia.llm.jaccard as jaccard_module
from binomia.llm import decontam, license_scan, media, packing, pii, quality, secret_scan, suffix, warc
from binomia.llm.common import Scratch
from binomia.llm.components import components
from binomia.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def corpus(seed=3, n=120):
    """Copies, near copies, shared passages, nulls, empties, short and long texts, a repeated row."""
    r = random.Random(seed)
    words = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(300)]
    passage = [r.choice(words) for _ in range(70)]
    texts = []
    for k in range(n):
        if k % 5 == 1 and texts:
            base = (texts[r.randrange(len(texts))] or "x").split(" ")
            for _ in range(max(1, len(base) // r.choice([8, 30, 60, 200]))):
                base[r.randrange(len(base))] = r.choice(words)
            texts.append(" ".join(base))
        elif k % 5 == 2 and texts:
            texts.append(texts[r.randrange(len(texts))])
        elif k % 5 == 3:
            own = [r.choice(words) for _ in range(r.choice([3, 40, 200]))]
            at = r.randrange(len(own))
            texts.append(" ".join([*own[:at], *passage[r.randrange(0, 15) :], *own[at:]]))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 12, 30, 200, 900]))))
    texts += [None, "", " \n\t ", "one", "ONE", "a b", "x" * 20000, "short  text \n with breaks"]
    return [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], SCHEMA)
    # clashing extra columns must not matter
    return df.withColumns({"n": F.lit(1), "key": F.lit("k"), "id": F.lit(7), "spans": F.lit("s"), "score": F.lit(9.0)}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


@pytest.mark.parametrize(("k", "num", "sub"), [(3, 90, 2048), (5, 80, 2048), (2, 60, 3)])
def test_jaccard_equals_brute_force(spark, docs, rows, k, num, sub, monkeypatch):
    monkeypatch.setattr(jaccard_module, "SUB_BLOCK", sub)
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        parent[i] = i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= num * len(sets[a] | sets[b]):
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    got = jaccard_components(docs, words=k, num=num, den=100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), find(parent, i)) for i in ids}


@pytest.mark.parametrize(("edits", "sub"), [((1, 2, 3, 4), 16), ((0, 1, 1, 1, 1, 1, 3), 24), ((3, 4), 2048)])
def test_jaccard_of_a_large_group_of_borderline_copies(spark, edits, sub, monkeypatch):
    monkeypatch.setattr(jaccard_module, "SUB_BLOCK", sub)
    r = random.Random(sub)
    base, texts = [f"b{k}" for k in range(70)], []
    for _ in range(260):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(66)} for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5, num=80).collect()
    assert {x.doc_id: x.component_id for x in got} == {a: find(parent, a) for a in range(len(texts))}


def test_forest_edges_of_a_block():
    import pyarrow as pa

    rng, rows = np.random.default_rng(5), 90
    base = np.unique(rng.integers(0, 2**62, 60))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 2**62, 2)])) for _ in range(rows)]
    cols = {"key": [1] * rows, "i": [0] * rows, "j": [1] * rows, "id": list(range(rows)), "root": [0 if k < 9 else k for k in range(rows)], "sub": [k % 2 for k in range(rows)], "grams": sets}
    table = pa.table({k: pa.array(v) for k, v in cols.items()})
    edges = [e for b in jaccard_module._forest(8, 10)(iter(table.to_batches(max_chunksize=7))) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert 0 < len(edges) < rows and all(a % 2 != b % 2 for a, b in edges)
    linked = lambda a, b: 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))
    assert all(linked(a, b) for a, b in edges)
    want, got = list(range(rows)), list(range(rows))
    for parent, links in ((want, [(a, b) for a in range(0, rows, 2) for b in range(1, rows, 2) if linked(a, b)]), (got, edges)):
        for a, b in [*((0, k) for k in range(9)), *links]:
            p, q = find(parent, a), find(parent, b)
            parent[max(p, q)] = min(p, q)
    assert [find(want, k) for k in range(rows)] == [find(got, k) for k in range(rows)]


def test_jaccard_small_sets_and_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9, 30, 200):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for _ in range(30):
            other = base[rng.random(len(base)) > 0.06]
            if len(other) and 10 * len(other) >= 9 * len(base):
                assert np.intersect1d(jaccard_module.group_keys(base, 90, 100), jaccard_module.group_keys(other, 90, 100)).size
    points, sizes = rng.integers(0, 5, (300, 32)), None
    sizes = points.sum(1)
    tree = jaccard_module.CountTree(points, sizes)
    for q in range(0, 300, 17):
        bound = np.minimum(points, points[q]).sum(1)
        want = np.flatnonzero(190 * bound >= 90 * (sizes + sizes[q]))
        assert sorted(tree.search(points[q], sizes[q], 90, 100)) == want.tolist()


@pytest.mark.parametrize("levels", [1, 2])
def test_sets_that_reach_the_last_level_meet(monkeypatch, levels):
    monkeypatch.setattr(jaccard_module, "LEVELS", levels)
    rng, met = np.random.default_rng(7), 0
    for n in (4, 5, 8, 12, 15, 20):
        for _ in range(150):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            other = np.unique(np.append(base[rng.random(len(base)) > 0.1], rng.integers(0, 2**63, 1, dtype=np.uint64)))
            if 100 * len(np.intersect1d(base, other)) >= 80 * len(np.union1d(base, other)):
                met += 1
                assert np.intersect1d(jaccard_module.group_keys(base, 80, 100), jaccard_module.group_keys(other, 80, 100)).size
    assert met > 100


def test_components(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (50, 40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 50: 0, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages_equal_brute_force(docs, rows):
    length, seen, words = 50, {}, []
    for _, t in rows:
        words.append(re.findall(r"[^\x20\x09-\x0D]+", lower(t)))
        for s in range(len(words[-1]) - length + 1):
            g = tuple(words[-1][s : s + length])
            seen[g] = seen.get(g, 0) + 1
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        mark = np.zeros(len(w) + 1, int)
        spans = []
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
        del mark
        want.append((i, len(w), sum(b - a for a, b in spans), tuple(map(tuple, spans))))
    got = [(r.doc_id, r.n_words, r.n_repeated, tuple((s.start, s.stop) for s in r.spans)) for r in suffix.repeated_passages(docs, length).collect()]
    assert sorted(got) == sorted(want)


def test_repeated_passages_of_texts_without_or_under_one_id(spark):
    r = random.Random(3)
    own = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    shared = own(55)
    rows = [(None, own(30) + " " + shared), (None, own(20)), (7, own(10) + " " + shared + " " + own(9)), (7, own(70)), (8, shared)]
    got = sorted((x.n_words, x.n_repeated, [(s.start, s.stop) for s in x.spans]) for x in suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(20, 0, []), (55, 55, [(0, 55)]), (70, 0, []), (74, 55, [(10, 65)]), (85, 55, [(30, 85)])]


def test_sorted_neighbours_over_partition_bounds(spark, monkeypatch):
    """Many partitions and batches of few rows give what one task gives."""
    monkeypatch.setattr(suffix, "SORTED", 3)
    monkeypatch.setattr(suffix, "FEW", 3)
    r, words = random.Random(4), [f"w{k}" for k in range(40)]
    base = [r.choice(words) for _ in range(300)]
    texts = []
    for k in range(25):
        a = r.randrange(200)
        texts.append(" ".join([*(r.choice(words) for _ in range(k)), *base[a : a + r.randrange(20, 100)], *(r.choice(words) for _ in range(9))]))
    seen = {}
    for t in texts:
        w = t.split()
        for s in range(len(w) - 19):
            seen[tuple(w[s : s + 20])] = seen.get(tuple(w[s : s + 20]), 0) + 1
    want = {}
    for i, t in enumerate(texts):
        w, marked = t.split(), set()
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] > 1:
                marked.update(range(s, s + 20))
        want[i] = len(marked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.n_repeated for x in suffix.repeated_passages(df, 20).collect()} == want


def test_warc_round_trip(spark):
    pages = [(3, "http://a/é", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "n", "<p>x</p>"), (9, "s", "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1))
    index = warc.write_archives(df)
    back = warc.read_records(index).collect()
    want = {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), 9: ("response", None), None: ("revisit", 1)}
    assert len(back) == len(pages)
    text = {i: (h or "").encode() for i, _, h in pages}
    for r in back:
        assert (r.record_type, r.refers_to) == want[r.page_id]
        assert r.payload_digest == warc.digest32(text[r.page_id]) and r.payload_bytes == len(text[r.page_id])
        assert r.payload is None or bytes(r.payload) == text[r.page_id]
    some = warc.read_records(index.filter("page_id in (5, 9)")).select("page_id").collect()
    assert sorted(x[0] for x in some) == [5, 5, 9]
    assert all(r.record_type == "response" for r in warc.read_records(warc.write_archives(df, min_bytes=10_001)).collect())
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.MAX_GAP, 5), ("a", 40 + 3 * warc.MAX_GAP, 5), ("b", 0, 5)]
    assert [len(x) for x in warc._ranges(rows)] == [3, 1, 1]


def test_pii_surrogates(spark, empty):
    t = "Write to Ann.Lee@mail3.example.com or ann.lee@mail3.example.com, call +1 (743) 555-3824; 10.1.2.3 and 233.9.171.252; card 4785 3805 9239 1139, not 4785380592391130. Mr. John Smith met Mrs Mary Smith."
    df = spark.createDataFrame([(1, t), (2, "again: +1 (743) 555-3824 Mr. John Smith"), (3, None), (4, ""), (5, "nothing 12")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "k").collect()}
    assert [e.kind for e in got[1].entities] == ["email", "email", "phone", "ip", "ip", "card", "name", "name"]
    new = got[1].text
    for old in ("Ann.Lee@", "(743) 555-3824", "10.1.2.3", "233.9.171.252", "4785 3805 9239 1139", "John", "Smith"):
        assert old not in new
    assert "4785380592391130" in new and "+1 (" in new
    mails = re.findall(r"\S+@\S+\.com", new)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new).group()
    assert pii.luhn(card.replace(" ", "")) == 0
    assert re.search(r"\b10\.\d+\.\d+\.\d+", new)
    names = re.findall(r"(Mr|Mrs)\.? (\w+) (\w+)", new)
    assert names[0][1] in pii._MALE and names[1][1] in pii._FEMALE and names[0][2] == names[1][2]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new).group() in got[2].text
    assert got[3].text is None and got[4].text == "" and got[5].text == "nothing 12"
    assert pii.collisions(df, "k").count() == 0
    assert pii.pseudonymised(df, "other").filter("doc_id = 1").first().text != new
    assert pii.pseudonymised(empty, "k").count() == 0


def test_pii_of_all_scripts_without_fixed_points(spark):
    names = ["李明", "Bo", "Ли", "हिन्दी", "محمد", "김철수", "İ", "ß", "Øß", "ΣΑΣ"]
    phones = ["743-555-3824", "743.555.3824", "1-743-555-3824"]
    cards = ["Order 41 4111 1111 1111 1111", "4111-1111-1111-1111 12", "no 4111 1111 1111 1112 end"]
    texts = [f"Mr. {n}" for n in names] + phones + cards + ["met John Smith today", "1٣.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r for r in pii.pseudonymised(df, "k").collect()}
    for n in names:
        assert [e.kind for e in got[f"Mr. {n}"].entities] == ["name"] and n not in got[f"Mr. {n}"].text
    assert all([(e.kind, e.start, e.stop) for e in got[p].entities] == [("phone", 0, len(p))] and got[p].text != p for p in phones)
    assert got[phones[2]].text.startswith("1-")
    assert [[(e.kind, e.start, e.stop) for e in got[c].entities] for c in cards] == [[("card", 9, 28)], [("card", 0, 19)], []]
    assert pii.luhn("".join(c for c in got[cards[0]].text[9:] if c.isdigit())) == 0
    assert not re.search("John|Smith", got["met John Smith today"].text) and got["1٣.1.1.1"].entities == []
    assert pii.collisions(df, "k").count() == 0


def test_pii_of_later_mentions_and_awkward_rows(spark, empty):
    t = "Mr. John Smith met Mrs Lee. Smith paid; John Smith left, Smithson and blacksmith stayed. smith"
    long = "x " * 300_000 + "Mr. Bo " + "y" * 300_000
    rows = [(1, t, "k"), (1, t, "k"), (None, t, None), (2, None, "k"), (3, "", "k"), (4, long, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities string").withColumns({"kind": F.lit("k"), "surrogate": F.lit(1)})
    out = pii.pseudonymised(df, "k").collect()
    assert len(out) == len(rows)
    same = {r.text for r in out if r.text and r.text.startswith("Mr")}
    assert len(same) == 1
    new = same.pop()
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+)\. (\w+) paid; (\w+) (\w+) left, Smithson and blacksmith stayed\. smith", new)
    assert m and m[2] == m[4] == m[6] != "Smith" and m[1] == m[5] in pii._MALE and m[3] != "Lee"
    got = next(r for r in out if r.doc_id == 4)
    assert got.text[: 600_000] == long[:600_000] and got.text[-300_000:] == long[-300_000:] and "Mr. Bo" not in got.text
    assert pii.distinct_key(df, "k") == "k" and pii.distinct_key(empty, "k") == "k"


def test_colliding_keys_are_changed_by_rule(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Mr. Bo")], "doc_id long, text string")
    real = pii.collisions
    monkeypatch.setattr(pii, "collisions", lambda d, k: d.select("text") if "#" not in k else real(d, k))
    assert pii.distinct_key(df, "own") == "own#1"
    monkeypatch.setattr(pii, "collisions", lambda d, k: d)
    with pytest.raises(RuntimeError):
        pii.distinct_key(df, "own")


def test_short_names_have_surrogates_of_their_own():
    every = [a.upper() + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouy"]
    for key in ("a", "b", "c"):
        made = pii.Surrogates(key)
        new = [made.of("name", f"Mr. {n}") for n in every]
        assert sorted(new) == sorted(f"Mr. {n}" for n in every) and not any(x == f"Mr. {n}" for x, n in zip(new, every, strict=True))
    assert all(pii.permute(v, n, b"k" * 16, "t") != v for n in (2, 3, 12, 100) for v in range(n))


def test_permutation_is_one():
    for size in (1, 2, 7, 100, 257):
        assert sorted(pii.permute(v, size, b"k" * 16, "t") for v in range(size)) == list(range(size))


def test_license_scan(spark, empty):
    texts = ["Foo bar.\nReleased under the MIT License.\nMore text here.", "x\n" + license_scan.TEMPLATES["MIT"][3].replace("free of charge", "at no cost") + "\ny", "This work is licensed under the GNU General Public License, version 2.", "all rights reserved", "MIT license is nice", None, "", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_matches(df).collect()}
    assert [got[k].license for k in range(8)] == ["MIT", "MIT", "GPL-2.0", "all-rights-reserved", None, None, None, "Apache-2.0"]
    assert {m.license for m in got[7].licenses} == {"Apache-2.0", "CC-BY-NC-4.0"} and got[0].dice == 1.0 and 0.8 <= got[1].dice < 1
    assert license_scan.license_matches(empty).count() == 0


def best_run(words, templates, most):
    """Best Dice of any run of words, one start and end after the other."""
    best = 0.0
    for a in range(len(words) - 1):
        own, shared = set(), [0] * len(templates)
        for e in range(a, len(words) - 1):
            pair = (words[e], words[e + 1])
            if pair not in own:
                own.add(pair)
                for k, t in enumerate(templates):
                    shared[k] += pair in t
            best = max([best, *(2 * o / (len(own) + len(t)) for o, t, m in zip(shared, templates, most, strict=True) if e - a < m)])
    return best


def test_license_scan_equals_brute_force():
    short = {n: tuple(t for t in ts if len(t) < 200) for n, ts in license_scan.TEMPLATES.items()}
    rng, m = random.Random(1), license_scan.Matcher(short, 0.8)
    for k in range(40):
        parts = [rng.choice([t for ts in short.values() for t in ts] + ["Some other line of words"] * 5) for _ in range(3)]
        text = ("\n" if k % 2 else " ").join(" ".join(w for w in p.split() if rng.random() > 0.04) for p in parts * (1 + k % 3 // 2))
        best = best_run(license_scan.alnum_words(text), [t for _, t in m.templates], m.most)
        found = m.find(text)
        assert (found[0][0] if found else 0) == (best if best >= 0.8 else 0)
        spans = sorted(x[2:] for x in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_license_inside_a_sentence_and_whole_files(monkeypatch):
    m = license_scan.Matcher(license_scan.TEMPLATES, 0.8)
    assert m.find("Copyright (c) 2020 Acme, released under the MIT License.")[0] == (1.0, "MIT", 4, 9)
    for name, at in (("MIT", -1), ("BSD-3-Clause", -1), ("BSD-2-Clause", -1), ("ISC", -1), ("Unlicense", -1), ("Zlib", -1)):
        body = license_scan.TEMPLATES[name][at]
        whole = f"{name} License\n\nCopyright (c) 2024 Some One\n\n" + body.replace(". ", ".\n\n").replace("the", "THE", 3)
        found = m.find("some code\n" * 50 + whole + "\nmore code" * 50)
        assert (found[0][1], found[0][0]) == (name, 1.0)
        assert 0 <= len(license_scan.alnum_words(body)) - (found[0][3] - found[0][2]) <= 4  # words at the ends that only repeat
    text = "x " * 500 + license_scan.TEMPLATES["ISC"][-1] + " y" * 300
    whole = m.find(text)
    monkeypatch.setattr(license_scan, "CELLS", 97)  # slices don't matter
    assert m.find(text) == whole


def test_license_scan_of_many_equal_lines_is_fast():
    import time

    m = license_scan.Matcher(license_scan.TEMPLATES, 0.8)
    for line in ("the License\n", "Licensed under the MIT License today\n", "of this software and associated documentation files the\n"):
        t = time.time()
        found = m.find(line * 10_000)
        assert time.time() - t < 2 and len(found) == (10_000 if "MIT" in line else 0)


def test_license_templates_from_files(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may use this\nfor any purpose whatsoever.")
    own = license_scan.read_templates(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "x. You may use this for any purpose whatsoever", "k")], "doc_id long, text string, license string")
    assert [tuple(r)[:3] for r in license_scan.license_matches(df, own).collect()] == [(1, "Own-1.0", 1.0)]


def test_quality(spark, docs, empty):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "tree", "grows", "well", "in", "spring", "rain."]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY", "NOW"]) + "!!" for _ in range(60))
    data = [(k, good() if k % 3 else bad(), k % 3 > 0) for k in range(600)]
    df = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(q)) for k, _, q in data] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, max_sample=300)
    out = quality.score(df.select("*", quality.held_out().alias("h")), model).toPandas()
    held = out[out.h]
    assert (held.h.size > 100) and ((held.score >= 0.5) == (held.doc_id % 3 > 0)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.h, strict=True))
    scored = quality.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert quality.train(df, labels.limit(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_trees_equal_a_walk_of_single_rows():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, len(quality.FEATURES))), 2)
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    model = quality.fit(x, y, trees=25)

    def walk(row):
        total = model.base
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] if row[model.feature[k]] <= model.cut[k] else model.right[k]
            total += model.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x]) and len({*model.score(x).round(6)}) > 50
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.85


def test_held_out_quality(spark):
    """The labels of the fold that nothing is learnt from are ranked well."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).join(labels, "doc_id").filter(quality.held_out()).toPandas()
    rank, good = out.score.rank(), out.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(out) > 20 and auc > 0.9, auc


def brute_hits(text, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, marks, found = split(text), set(), set()
    for i, t in items:
        v = split(t)
        for s in range(max(1, len(v) - n + 1) if v else 0):
            g = v[s : s + n]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    marks.update(range(p, p + len(g)))
                    found.add(str(i))
    return len(w), len(marks), sorted(found)


@pytest.mark.parametrize("most", [200_000, 40])
def test_decontamination(spark, docs, rows, empty, most):
    r, long = random.Random(8), next(t for _, t in rows if t and len(t.split()) > 150)
    items = [(1, " ".join(long.split()[20:60])), (2, "W1 w2! zz"), (3, "one"), (4, None), (5, ""), (6, " ".join(f"W{r.randrange(300)}" for _ in range(30))), (6, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.benchmark_hits(docs, bench, 13, most).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in got) == sorted((i, *b[:2], tuple(b[2])) for i, t in rows for b in [brute_hits(t, items)])
    assert all(sum(s.stop - s.start for s in x.spans) == x.n_hit for x in got)
    clean = decontam.decontaminated(docs, bench, 13, most)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not (b[1] and 20 * b[1] >= b[0]) for _, t in rows for b in [brute_hits(t, items)])
    assert decontam.benchmark_hits(empty, bench).count() == 0
    assert decontam.benchmark_hits(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_tokens_equal_the_tokenizers_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(1)
    tok.encode_special_tokens = True
    ids = packing.encoder(packing.default_tokenizer())
    texts = ["", "a  b", "<|endoftext|> hi", "\x00\x01", "x" * 3000, " \n\n\t ", "　 a", "'s 'S"]
    texts += ["".join(rng.choice(["a", "B", " ", " ", "\n", "\t", "'s", "1", ".", "é", " ", "漢", "🙂", "‍", "ſ"]) for _ in range(40)) for _ in range(500)]
    assert all(ids(t).tolist() == e.ids for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True))


def test_packing_matches_added_tokens_as_the_library_does(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(2)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a  <|endoftext|>  \n b", "<|endoftext| >", "<|<|endoftext|>|>", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(["a", " ", "\n", "'s", "1", "é", "<|", "|>", "endoftext", "<|endoftext|>"]) for _ in range(20)) for _ in range(300)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == [(k, len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for k, w in enumerate(want)]


def test_packing_of_long_runs(spark, monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(5)
    long = [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "x\n" + "\n" * 1_200_000 + "<|endoftext|>" + "\t " * 400_000, "z" * 300_000, "." * 300_000, "\u3000" * 20_000 + "漢", "a" + "\x1c" * 9000 + "b"]
    got = packing.pack(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), 1 << 22).collect()
    want = [e.ids for e in tok.encode_batch(long, add_special_tokens=False)]
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == [(k, len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for k, w in enumerate(want)]
    monkeypatch.setattr(packing, "_BLANKS", re.compile(packing._BLANKS.pattern.replace("4096", "3")))  # short runs by the same way
    ids = packing.encoder.__wrapped__(packing.default_tokenizer(), tuple(packing.default_added().items()))
    texts = ["".join(rng.choice([" ", " ", "\n", "\t", "a", "1", ".", "'s", "\u2003", "<|endoftext|>"]) for _ in range(60)) for _ in range(400)]
    assert all(ids(t).tolist() == e.ids for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True))


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing(docs, rows, empty, capacity):
    got = packing.pack(docs, capacity).toPandas()
    ids = packing.encoder(packing.default_tokenizer())
    want = []
    for i, t in rows:
        raw = [*ids(t or "").tolist(), 0]
        start, size, k = 0, len(raw) % capacity or capacity, 0
        while start < len(raw):
            want.append((i, k, start, size, zlib.crc32(np.array(raw[start : start + size], "<u4").tobytes())))
            start, size, k = start + size, capacity, k + 1
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= capacity
    assert packing.pack(empty, capacity).count() == 0


def test_packing_plan_is_best_fit_decreasing_for_small_pieces():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.choice([10, 50, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        segments, used = packing.plan(counts, capacity)
        fill: dict[int, list[tuple[int, int]]] = {}
        for n, a, b, first, offset, per in segments:
            for r in range(b - a):
                fill.setdefault(first + r // per, []).append((offset + r % per * n, n))
        assert sum(len(v) for v in fill.values()) == sum(counts.values()) and set(fill) == set(range(used))
        for v in fill.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= capacity
        pieces = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        bins: list[int] = []
        for n in pieces:  # best fit decreasing, one piece at a time
            room = [k for k in range(len(bins)) if bins[k] >= n]
            if room:
                bins[min(room, key=lambda k: bins[k])] -= n
            else:
                bins.append(capacity - n)
        assert used <= len(bins) + 1 and used >= -(-sum(pieces) // capacity)


BASE = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
SECRETS = ["é token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x", "token=token:abcdefg", "password: abc Passwd='longer1'", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " AKIAB", "f" * 23, "f" * 24 + "g" + "0" * 30, "ſecret=abcdefg api_key=ABCDEF", None, "", "-----BEGIN RSA PRIVATE KEY-----", "🙂 apikey : 'x1y2z3w4'", "token=abcdef", "token=abcdef"]


def test_secrets(spark, empty):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").withColumn("blob", F.lit("x"))
    got = {r.doc_id: [(s.ord, s.start, s.stop) for s in r.spans] for r in secret_scan.secret_spans(df).collect()}
    for i, t in enumerate(SECRETS):
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in re.finditer(p, t or "", re.ASCII) if len(m.group(g)) >= least)
        assert [(s, o, e) for o, s, e in got[i] if o < 3] == want
    assert [o for o, _, _ in got[10]] == [3]
    assert secret_scan.secret_spans(empty).count() == 0


def test_secrets_of_added_rules_have_exact_places(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    texts = ["é " + key + " x", "a ghp_" + "A1" * 18 + " b", "t=eyJab.eyJcd.ef-g z", "token=" + "ghp_" + "A1" * 18, "ghp_short"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0]])] + [(0, texts[0])], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r.doc_id, [(s.ord, s.start, s.stop) for s in r.spans]) for r in secret_scan.secret_spans(df).collect())
    first = [(3, 2, 2 + len(key))]
    assert got == [(0, first), (0, first), (1, [(4, 2, 42)]), (2, [(5, 2, 18)]), (3, [(0, 0, 46), (4, 6, 46)]), (4, []), (5, first)]


def test_secrets_and_masks_of_texts_with_very_many_matches(spark):
    import time

    parts = [f"token=abcdef{k} 漢🙂" for k in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(parts)), (2, "key " * 100_000)], "doc_id long, text string")
    t = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.secret_spans(df).collect()}
    assert [(s.start, s.stop) for s in got[1]] == [m.span() for m in re.finditer(r"token=\w+", df.first().text, re.ASCII)] and got[2] == []
    masked = {r.doc_id: r.text for r in secret_scan.redacted_documents(df).collect()}
    assert masked[1] == " ".join(["[secret] 漢🙂"] * 30_000) and masked[2] == "key " * 100_000
    assert time.time() - t < 60


def test_redaction_joins_overlaps_and_keeps_rows(spark, empty):
    rows = [(1, "x token=AKIA" + "A" * 16 + " y 🙂 password: " + "f" * 30, 0), (None, "token=abcdef", None), (1, "token=abcdef", 3), (2, "", 0)] * 2
    out = secret_scan.redacted_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("blob", F.lit("b")))
    assert out.columns == ["doc_id", "text", "n_chars", "blob"] and dict(out.dtypes)["n_chars"] == "int"
    got = sorted(map(tuple, out.drop("blob").collect()), key=repr)
    assert got == sorted([(1, "x [secret] y 🙂 [secret]", 23), (None, "[secret]", 8), (1, "[secret]", 8), (2, "", 0)] * 2, key=repr)
    assert secret_scan.redacted_documents(empty).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "plain")], "doc_id long, text string")
    assert secret_scan.secret_spans(one, ledger).filter("size(spans) > 0").count() == 2
    two = one.union(spark.createDataFrame([(4, "token=abcdef"), (5, "secret=zyxwvu")], one.schema))
    assert secret_scan.secret_spans(two, ledger).filter("size(spans) > 0").count() == 4
    seen = secret_scan.read_ledger(spark, ledger, "seen", "blob string, version string")
    assert seen.count() == seen.distinct().count() == 3
    found = secret_scan.read_ledger(spark, ledger, "findings", "blob string, version string")
    assert found.count() == 2


def test_ledger_is_compacted(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    for k in range(3):
        df = spark.createDataFrame([(k, f"token=abcdef{k}"), (9, "token=abcdef0"), (k, "plain")], "doc_id long, text string")
        secret_scan.update_ledger(df.repartition(3), ledger)
    tables = {n: sorted(map(tuple, secret_scan.read_ledger(spark, ledger, n, "blob string, version string").distinct().collect())) for n in ("findings", "seen")}
    secret_scan.compact(spark, ledger, 2)
    for n, want in tables.items():
        assert sorted(map(tuple, secret_scan.read_ledger(spark, ledger, n, "blob string, version string").collect())) == want
        assert 1 <= len(list((tmp_path / "ledger" / n).glob("part-*"))) <= 2
    assert secret_scan.secret_spans(df, ledger).filter("size(spans) > 0").count() == 2
    secret_scan.compact(spark, f"file://{tmp_path}/none")


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdef, x", 17), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long").withColumn("extra", F.lit(1))
    got = {r.doc_id: r for r in secret_scan.redacted_documents(df).collect()}
    assert got[1].text == "é [secret], x" and got[1].n_chars == len(got[1].text) and got[2].text == "clean" and got[3].text is None
    assert len(got[1]) == 4


def test_media_round_trip(docs, rows, empty):
    got = media.media_features(media.media_column(docs)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        n, p = media.padded(t)
        want[i] = (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in got)
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.thumbnail_hash))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_features(media.media_column(empty)).count() == 0


def test_jpeg_of_another_encoder():
    """Runs, zero runs, differential DC and no restart markers: a scan as other programs write them."""
    rng = np.random.default_rng(1)
    blocks = np.zeros((4, 64), int)
    blocks[:, 0] = [5, -3, 200, 0]
    for b in blocks:
        b[rng.integers(1, 64, 6)] = rng.integers(-100, 100, 6)
    blocks[2, 1:60] = 0
    blocks[2, 60] = 9  # three runs of sixteen zeros
    symbols = sorted({(r << 4) | c for r in range(16) for c in range(1, 8)} | {0, 0xF0})
    bits = [0] * 7 + [len(symbols)] + [0] * 8
    code = {s: format(k, "08b") for k, s in enumerate(symbols)}
    dc = {c: format(k, "04b") for k, c in enumerate(range(12))}

    def mag(v, c):
        return "" if c == 0 else format(v if v > 0 else v + (1 << c) - 1, f"0{c}b")

    out, past = "", 0
    for b in blocks:
        c = int(abs(b[0] - past)).bit_length()
        out += dc[c] + mag(int(b[0] - past), c)
        past, run = b[0], 0
        last = max([k for k in range(1, 64) if b[k]], default=0)
        for v in b[1 : last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                out += code[0xF0]
                run -= 16
            c = int(abs(v)).bit_length()
            out += code[(run << 4) | c] + mag(int(v), c)
            run = 0
        if last < 63:
            out += code[0]
    out += "1" * (-len(out) % 8)
    raw = bytes(int(out[k : k + 8], 2) for k in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\x00") + seg(0xDB, bytes([0, *[3] * 64])) + seg(0xC0, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0]))
    data += seg(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])) + seg(0xC4, bytes([0x10, *bits, *symbols])) + seg(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + raw + b"\xff\xd9"
    (m, coef), (m2, c2) = media.decode([data, media.encode(b"\x80" * 576)])
    assert (coef == blocks).all() and (m.width, m.height, m.quant) == (16, 16, 3)
    assert media.payload(m2, c2) == b"\x80" * 576
    assert media.thumbnail(m, coef).tolist() == [[130, 127], [203, 128]]


def colour_jpeg(blocks, wide, high, sampling, apart=False):
    """A YCbCr image of blocks per component (rows x columns x 64), interleaved or a scan each."""
    seg, symbols = media._segment, sorted({(r << 4) | c for r in range(16) for c in range(1, 8)} | {0, 0xF0})
    mag = lambda v, c: "" if c == 0 else format(v if v > 0 else v + (1 << c) - 1, f"0{c}b")

    def coded(b, past):
        c = int(abs(b[0] - past)).bit_length()
        out, run = format(c, "04b") + mag(int(b[0] - past), c), 0
        for v in b[1 : 1 + max([k for k in range(1, 64) if b[k]], default=0)]:
            if not v:
                run += 1
                continue
            out, run = out + format(symbols.index(0xF0), "08b") * (run // 16), run % 16
            c = int(abs(v)).bit_length()
            out, run = out + format(symbols.index((run << 4) | c), "08b") + mag(int(v), c), 0
        return out if b[63] else out + format(symbols.index(0), "08b")

    def scan(parts):
        out, past = "", [0, 0, 0]
        step = [(1, 1)] if len(parts) == 1 else [sampling[k] for k in parts]
        rows, cols = blocks[parts[0]].shape[0] // step[0][1], blocks[parts[0]].shape[1] // step[0][0]
        for y in range(rows):
            for x in range(cols):
                for k, (h, v) in zip(parts, step, strict=True):
                    for b in (blocks[k][y * v + j, x * h + i] for j in range(v) for i in range(h)):
                        out, past[k] = out + coded(b, past[k]), b[0]
        out += "1" * (-len(out) % 8)
        raw = bytes(int(out[k : k + 8], 2) for k in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
        return seg(0xDA, bytes([len(parts), *[x for k in parts for x in (k + 1, 0)], 0, 63, 0])) + raw

    frame = bytes([8, 0, high, 0, wide, 3, *[x for k, (h, v) in enumerate(sampling) for x in (k + 1, h << 4 | v, 0)]])
    head = b"\xff\xd8" + seg(0xDB, bytes([0, *[3] * 64])) + seg(0xC0, frame)
    head += seg(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])) + seg(0xC4, bytes([0x10, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    return head + b"".join(map(scan, [[1], [0], [2]] if apart else [[0, 1, 2]])) + b"\xff\xd9"


def test_colour_and_unreadable_images(spark):
    rng = np.random.default_rng(4)

    def some(rows, cols):
        b = np.zeros((rows, cols, 64), int)
        b[..., 0] = rng.integers(-200, 200, (rows, cols))
        b[..., rng.integers(1, 64, 5)] = rng.integers(-100, 100, (rows, cols, 5))
        return b

    y = some(4, 4)
    half = colour_jpeg([y, some(2, 2), some(2, 2)], 24, 20, [(2, 2), (1, 1), (1, 1)])
    full = colour_jpeg([y, some(4, 4), some(4, 4)], 32, 32, [(1, 1)] * 3)
    apart = colour_jpeg([y[:3, :3], some(2, 2), some(2, 2)], 24, 20, [(2, 2), (1, 1), (1, 1)], True)
    (m, c), (_, c2), (_, c3) = media.decode([half, full, apart])
    assert m.blocks == (3, 3) and (c == y[:3, :3].reshape(-1, 64)).all() and (c2 == y.reshape(-1, 64)).all() and (c3 == c).all()
    own = media.encode(b"\x80" * 576)
    grey = own.replace(b"bytes=576", b"by anyone")
    data = [own, half, grey, b"", b"not an image", None, own[:-300], half[: len(half) // 2], half.replace(b"\xff\xc0", b"\xff\xc2")]
    got = media.media_features(spark.createDataFrame([(k, 1, d) for k, d in enumerate(data)], "doc_id long, n_bytes long, media binary").coalesce(1)).collect()
    got = {r.doc_id: r for r in got}
    assert len(got) == len(data)
    assert [r for r in got if got[r].thumbnail_hash is not None] == [0, 1, 2] and [r for r in got if got[r].payload_sha256] == [0]
    assert (got[1].width, got[1].height) == (24, 20) and got[5].media_bytes is None and got[3].media_bytes == 0
    want = np.clip((y[:3, :3, 0] * 3 + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    assert got[1].thumbnail_sha256 == hashlib.sha256(want.tobytes()).hexdigest()


def test_near_copies_of_a_template_never_meet(spark):
    """Texts of one template with a word of their own, below the threshold: rows grow with the texts, pairs don't exist."""
    template = " ".join(f"w{i}" for i in range(15))
    for n in (500, 1000):
        docs = spark.createDataFrame([(i, f"{template} own{i}") for i in range(n)], "doc_id long, text string")
        tagged = spark.createDataFrame([(1, i, 14, i) for i in range(n)], "key long, id long, n long, root long")
        tables = Scratch(spark, "apart")
        blocks, sets, _ = jaccard_module._apart(tagged, docs, 3, 90, 100, tables)
        assert blocks.count() == 0 and sets.count() == n
    got = jaccard_components(docs, words=3, num=90, den=100).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_first_grams_of_one_set_are_not_stored(spark):
    """Texts in one block that share no n-gram: neither their sets nor their first n-grams reach a table."""

    class Seen(Scratch):
        def put(self, df):
            out = super().put(df)
            tables.append((dict(out[0].dtypes), out[0].count()))
            return out

    docs = spark.createDataFrame([(i, " ".join(f"w{i}of{j}" for j in range(60))) for i in range(200)], "doc_id long, text string")
    tagged, tables = spark.createDataFrame([(1, i, 56, i) for i in range(200)], "key long, id long, n long, root long"), []
    blocks, texts, _ = jaccard_module._apart(tagged, docs, 5, 80, 100, Seen(spark, "apart"))
    assert blocks.count() == 0 and texts.count() == 200
    assert not any(kind.startswith("array") for t, _ in tables for kind in t.values())
    assert [n for t, n in tables if {"id", "gram"} <= set(t)] == [0]


@pytest.mark.parametrize("hot", [-1, 4])
def test_frequent_first_grams_meet_outside_the_window(spark, hot, monkeypatch):
    """Links stay the same whatever counts as frequent."""
    monkeypatch.setattr(jaccard_module, "HOT", hot)
    monkeypatch.setattr(jaccard_module, "HOT_MEANS", 0)
    test_jaccard_of_a_large_group_of_borderline_copies(spark, (1, 2, 3, 4), 16, monkeypatch)


def test_counters_of_tasks_add_up():
    rng, rows = np.random.default_rng(8), []
    for top in (3, 300, 70_000):
        rows += jaccard_module._counter_rows({p: rng.integers(0, top, jaccard_module.COUNTER_ROW) for p in (0, 5)})
    (out,) = jaccard_module._summed(iter(rows))
    for p, data in zip(*(c.to_pylist() for c in out.columns), strict=True):
        want = sum(jaccard_module._counters_of(d) for b in rows for q, d in zip(*(c.to_pylist() for c in b.columns), strict=True) if q == p)
        assert (jaccard_module._counters_of(data) == want).all() and want.max() > 60_000


@pytest.mark.parametrize("num", [80, 90])
def test_first_grams_of_sets_that_reach_the_threshold_meet(num):
    rng = np.random.default_rng(num)
    counts = np.zeros(jaccard_module.COUNTERS, np.int64)
    counts[rng.integers(0, len(counts), 50_000)] = rng.integers(1, 50, 50_000)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for drop, add in ((0, int(n * (100 - num) // num)), (int(n * (100 - num) // 100), 0), (n // 20, n // 20)):
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            a, b = np.unique(base), other
            o = len(np.intersect1d(a, b))
            if (num + 100) * o < num * (len(a) + len(b)):
                continue
            fa, fb = (jaccard_module.first_grams(x, counts, num, 100) for x in (a, b))
            common = [(i, j) for i, g in enumerate(fa[0].tolist()) for j, h in enumerate(fb[0].tolist()) if g == h]
            assert any((num + 100) * min(fa[3] - i, fb[3] - j) >= num * (fa[3] + fb[3]) for i, j in common)


def test_pii_of_given_names_titles_and_dates():
    made = pii.Surrogates("k")

    def new(text):
        found, parts, at = made.find(text), [], 0
        for _, start, stop, word in found:
            parts += [text[at:start], word]
            at = stop
        return "".join([*parts, text[at:]])

    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left\.", new("Mr. John Smith came. John left."))
    assert m and m[1] == m[3] in pii._MALE and m[1] != "John" and m[2] != "Smith"
    m = re.fullmatch(r"Mr\. (\w+) met in May 2020, in May, on 3 May and May 4\. (\w+) left\.", new("Mr. May met in May 2020, in May, on 3 May and May 4. May left."))
    assert m and m[1] == m[2] != "May"
    for title in ("Dr.", "Prof.", "Sir", "Mx", "M.", "Dr", "Mlle"):
        m = re.fullmatch(re.escape(title) + r" (\w+) was there; (\w+) spoke", new(f"{title} Okoro was there; Okoro spoke"))
        assert m and m[1] == m[2] != "Okoro", title
    assert new("a sir with a dr note, M5 and 5 M. of it") == "a sir with a dr note, M5 and 5 M. of it"
    words = [f"{a}{b}" for a in ("Ba", "Be", "Hu", "Ot") for b in ("go", "to", "ko", "na")]
    words = sorted({*words, *pii._LISTED})
    made_of = {w: pii._word(w, made.key) for w in words}
    assert len(set(made_of.values())) == len(words) and all(w != n for w, n in made_of.items())
    assert all((n in pii._LISTED) == (w in pii._LISTED) for w, n in made_of.items())


def test_pii_of_very_many_names_in_one_text_is_linear():
    made, took = pii.Surrogates("k"), []
    for n in (1000, 4000):
        text = " ".join(f"Mr. Na{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} said so." for k in range(n))
        start = time.perf_counter()
        assert len(made.find(text)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5
