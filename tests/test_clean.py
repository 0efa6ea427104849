import pytest
from pyspark.sql import functions as F

from binomia.functions.text import canon_agg_marker, normalize_epithets
from binomia.operators.clean import clean_names, hybrid_parents, qualifier_match

CASES = [
    ("Quercus robur L.", "Quercus robur", None, None),
    ("Rosa canina var. dumalis (Bechst.) Baker", "Rosa canina dumalis", "var.", "species"),
    ("Pinus cf. sylvestris", "Pinus sylvestris", "cf.", "species"),
    ("Cf. Pinus sylvestris", "Pinus sylvestris", "cf.", "genus"),
    ("Affinis major", "Affinis major", None, None),
    ("Festuca ovina sensu lato", "Festuca ovina", "s.l.", "species"),
    ("Festuca ovina s. str.", "Festuca ovina", "s.str.", "species"),
    ("QUERCUS ROBUR", "QUERCUS robur", None, None),
    ("Quercus Robur", "Quercus", None, None),
    ("Quercus robur (123)", "Quercus robur", None, None),
    ("Quercus \t  robur", "Quercus robur", None, None),
    ("Festuca rubra L. ex Huds.", "Festuca rubra", None, None),
    ("Carex spp.", "Carex", "sp.", "species"),
    ("Taraxacum aggr.", "Taraxacum", "agg.", "species"),
    (None, None, None, None),
    ("", None, None, None),
    ("   ", None, None, None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    names = [c[0] for c in CASES] + ["× Festulolium", "Salix x fragilis", "Quercus pyrenaica x Q. petraea", "Saxifraga granulata", "Q. robur"]
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, input_name string")
    return {r.row_idx: r for r in clean_names(df).collect()}, names


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cleaning(cleaned, k):
    r = cleaned[0][k]
    assert (r.cleaned, r.qualifier, r.qualifier_position) == CASES[k][1:]


def test_hybrids_and_flags(cleaned):
    rows, names = cleaned
    at = {n: rows[k] for k, n in enumerate(names) if n}
    assert at["× Festulolium"].is_hybrid and at["× Festulolium"].cleaned == "Festulolium"
    assert at["Salix x fragilis"].hybrid_name == "Salix × fragilis"
    assert at["Quercus pyrenaica x Q. petraea"].cleaned == "Quercus pyrenaica"
    assert not at["Saxifraga granulata"].is_hybrid
    assert at["Q. robur"].genus_abbrev and at["Carex spp."].genus_only and at["Taraxacum aggr."].is_aggregate


def test_parents(spark):
    df = spark.createDataFrame([("Salix alba × S. fragilis",), ("Salix alba",), (None,)], "n string")
    rows = hybrid_parents(df, "n").collect()
    assert (rows[0].hybrid_type, rows[0].parent_1, rows[0].parent_2) == ("formula", "Salix alba", "Salix fragilis")
    assert rows[1].hybrid_type is None and rows[2].parent_1 is None


def test_keys(spark):
    pairs = [("Genus phyllothalamus", "genus fillotalamus"), ("A bœhmii", "a bihmi"), ("A boehmii", "a bihmi"), ("A hirtaeformis", "a hirtiformis"), ("A müllerianum", "a muellerianum"), ("Abies", "abies"), (None, None)]
    df = spark.createDataFrame([(n,) for n, _ in pairs], "n string")
    got = [r[0] for r in df.select(normalize_epithets(F.col("n"))).collect()]
    assert got[0] == "genus fillotalamus" and got[1] == got[2] and got[5] == "abies" and got[6] is None


def test_aggregate_spellings(spark):
    forms = ["X y aggr.", "X y agg.", "X y agg", "X y-agg.", "X y s.l.", "X y s. l.", "X y sensu lato", "X y coll.", "X y coll. species"]
    df = spark.createDataFrame([(f,) for f in forms], "n string")
    assert {r[0] for r in df.select(canon_agg_marker(F.col("n"))).collect()} == {"X y aggr."}


def test_qualifier_place(spark):
    df = spark.createDataFrame([("Pinus cf. abies",), ("Pinus abies",)], "n string")
    q, at = qualifier_match(F.col("n"))
    assert [tuple(r) for r in df.select(q, at).collect()] == [("cf.", 7), (None, None)]
