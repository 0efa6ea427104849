"""Registered text queries against their SQL, and the pipeline's stages one by one."""

import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from binomia.llm import packing, quality
from binomia.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(cols).collect())))
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_all_rows(spark, name):
    df = QUERIES[name](spark, DIR)
    table, key = ("documents", "doc_id") if "doc_id" in df.columns else ("embeddings", "vec_id")
    ids = spark.read.parquet(f"{DIR}/{table}.parquet").select(key).distinct().count()
    assert df.select(key).distinct().count() == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DIR)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.toPandas(), docs.schema)
        assert kept.count() <= docs.count()
    assert kept.count() > 0.5 * docs.count()
    pieces = corpus_pipeline.run(spark, DIR)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_pipeline_on_nothing_and_nulls(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "token=abcdef0 and so on", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, DIR)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
        assert len(out) == (3 if data else 0)


def words_of(text, pattern):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, lower)


def near_copies_by_brute_force(rows):
    """The rows that stay: the smallest id of each component of five-word shingles at 0.8."""
    sets = {}
    for r in rows:
        w = words_of(r["text"], r"[^\x20\x09-\x0D]+")
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids, group = sorted(sets), {}
    for a in ids:
        hits = [b for b in group if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
        group[a] = a
        lead = min([group[b] for b in hits], default=a)
        joined = {group[b] for b in hits} | {a}
        group |= {b: lead for b, g in group.items() if g in joined}
    first = {r["doc_id"]: r for r in rows}
    return [first[i] for i in ids if group[i] == i]


def test_pipeline_equals_brute_force(spark):
    """Every stage on what the one before kept, against plain Python over the same rows."""
    from tests.llm.test_operators import BASE, brute_hits

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    good = model.score(np.array([quality.statistics(r["text"]) for r in rows], float)) >= 0.5
    by_id = lambda found: sorted(({c: r[c] for c in docs.columns} for r in found), key=repr)

    def check(name, kept, want):
        out = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in kept], docs.schema)
        got = stages[name](spark, out.repartition(3), DIR)
        assert got.columns == docs.columns
        assert by_id(r.asDict() for r in got.collect()) == by_id(want), name
        return want

    kept = check("quality", rows, [r for r, g in zip(rows, good, strict=True) if g])
    kept = check("near_copies", kept, near_copies_by_brute_force(kept))
    spoilt = lambda t: (lambda n, hit, _: hit and 20 * hit >= n)(*brute_hits(t, bench))
    kept = check("decontamination", kept, [r for r in kept if not spoilt(r["text"])])
    masked = []
    for r in kept:
        spans = sorted((m.start(), m.end()) for _, p, g, least in BASE for m in re.finditer(p, r["text"] or "", re.ASCII) if len(m.group(g)) >= least)
        text, at, parts = r["text"], 0, []
        for a, b in spans:
            parts += [] if a < at else [text[at:a], "[secret]"]
            at = max(at, b)
        masked.append(r | ({"text": "".join([*parts, text[at:]]), "n_chars": len("".join([*parts, text[at:]]))} if spans else {}))
    kept = check("secrets", kept, masked)
    pieces = corpus_pipeline.run(spark, DIR).toPandas()
    sizes = pieces.groupby("doc_id").length.sum().to_dict()
    ids = packing.encoder(packing.default_tokenizer(), tuple(packing.default_added().items()))
    assert sizes == {r["doc_id"]: len(ids(r["text"] or "")) + 1 for r in kept}
    room = pieces.groupby("sequence_id").length.sum()
    assert room.max() <= 2048 and len(room) <= 1.05 * -(-room.sum() // 2048) + 1


def test_stages_keep_columns_texts_and_nulls(spark):
    """Columns named like the operators' own, nulls in every column, different texts under one id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, blob string, component_id long, spans string"
    long = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, long, "en", "s", 1, 9.0, 5, "b", 3, "x"), (1, long, "en", "s", 1, 9.0, 5, "b", 3, "x"),
        (1, "another text of its own with seven more words", None, None, None, None, None, None, None, None),
        (2, long + " end", "en", "s", 1, 8.0, 5, "b", 3, "x"), (3, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, 1.0, 1, "", 1, ""), (None, long, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_copies", "decontamination", "secrets"):
        out = stages[name](spark, docs, DIR)
        assert out.schema == docs.schema and set(map(tuple, out.collect())) <= set(rows), name
        assert stages[name](spark, docs.limit(0), DIR).count() == 0
    out = sorted(map(tuple, stages["near_copies"](spark, docs, DIR).collect()), key=repr)
    assert out == sorted([rows[0], *rows[2:3], *rows[4:]], key=repr)
    assert {r.score for r in stages["quality"](spark, docs, DIR).collect()} <= {9.0, 8.0, 1.0, None}
    assert stages["packing"](spark, docs, DIR).count() == len(rows)
