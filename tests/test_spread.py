"""Results of distinct names on all rows: long texts are kept once, checklists are gone through once."""

import pytest
from pyspark.sql import functions as F

from binomia.operators import backbone, spread
from binomia.operators.backbone import build_backbone, candidates, index_rows, key_index, keyed
from binomia.plans import queries
from binomia.sources.staging import staged
from tests.test_versions import CHECKLIST, as_rows, random_checklist, taxon

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limits", [{}, {"BROADCAST_BYTES": 0}, {"NAMES": 0}])
def test_long_texts_join_last(spark, how, limits, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(spread, k, v)
    name = F.when(F.col("id") % 11 < 10, F.concat(F.lit("n"), F.col("id") % 11))
    rows = staged(spark.range(1000).select("id", name.alias("input_name")), "rows")
    text = F.when(F.col("k") % 4 == 0, F.repeat(F.lit("long|"), 100)).when(F.col("k") % 4 == 1, F.repeat(F.lit("also long|"), 100)).when(F.col("k") % 4 == 2, "short")
    found = staged(spark.range(8).select(F.col("id").alias("k")).select(F.concat(F.lit("n"), "k").alias("input_name"), "k", text.alias("text")), "found")
    out = spread.spread(rows, found, ["input_name"], "text", how)
    assert as_rows(out.select("id", "input_name", "k", "text")) == as_rows(rows.join(found, "input_name", how).select("id", "input_name", "k", "text"))
    assert out.count() == (1000 if how == "left" else 728)
    if not limits:  # rows are neither sorted nor sent anywhere
        assert "SortMergeJoin" not in plan(out) and "hashpartitioning" not in plan(out) and "BuildLeft" not in plan(out)


def test_counts_become_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK", 7)
    counted = spark.createDataFrame([("a", 20), ("b", 7), ("c", 1), ("d", 0)], "x string, n long")
    assert sorted(r.x for r in spread.repeated(counted, "x", "n").collect()) == ["a"] * 20 + ["b"] * 7 + ["c"]


@pytest.mark.parametrize("name", ["exact_cascade", "inspect_review", "resolve_chain"])
def test_lines_are_gone_through_once(spark, name, monkeypatch):
    """Results of names meet the rows without a sort, and the lines are not joined to the parts again."""
    monkeypatch.setattr(spread, "LONG", 20)
    text = plan(queries.QUERIES[name](spark, DIR))
    assert "lineitem.parquet" not in text and "SortMergeJoin" not in text and "BuildLeft" not in text


@pytest.mark.parametrize("seed", [4, 5])
def test_index_by_name_equals_one_by_taxon(spark, seed, monkeypatch):
    import random

    stored = {}
    monkeypatch.setattr(backbone, "staged", lambda df, name, *a: stored.setdefault(name, staged(df, name, *a)))
    r = random.Random(seed)
    rows = list(random_checklist(r, 80).values())
    # one key of several names, whose best tiers differ or are alike
    rows += [taxon("x1", "G1", "E3"), taxon("x2", "G1", "e3", "x1"), taxon("x3", "g1", "e3"), taxon("x4", "G1", "ey3"), taxon("x5", "G1", "ei3"), (None, "G2 e1", "SPECIES", "ACCEPTED", None, "Fam", "G2", "e1", "L."), ("x6", None, "SPECIES", "ACCEPTED", None, None, None, None, None)]
    built = build_backbone(spark.createDataFrame(rows, CHECKLIST), arranged=False)
    stored.clear()
    got = key_index(built)
    assert as_rows(got) == as_rows(index_rows(keyed(candidates(built))).select(got.columns))
    assert stored["named"].count() == len({r[1] for r in rows if r[1]}) < stored["candidates"].count()


def test_ids_of_a_checklist_are_not_broadcast(spark):
    """Millions of ids pack into a few megabytes of shuffle."""
    assert "Broadcast" not in plan(backbone.embed_accepted(spark.createDataFrame([taxon("a", "G", "e"), taxon("b", "G", "f", "a")], CHECKLIST)))
