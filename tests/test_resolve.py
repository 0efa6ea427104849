import pytest

from binomia.operators.backbone import build_backbone, embed_accepted, key_index
from binomia.operators.region import Ranges
from binomia.plans.resolve import RESULT, Backend, Options, resolve
from binomia.sources.staging import staged
from binomia.streaming.stream import resolve_stream

SCHEMA = "taxon_id string, canonical_name string, taxon_rank string, taxonomic_status string, accepted_name_usage_id string, family string, genus string, specific_epithet string, authorship string"
ROWS = [
    ("1", "Quercus robur", "SPECIES", "ACCEPTED", None, "Fagaceae", "Quercus", "robur", "L."),
    ("2", "Quercus pedunculata", "SPECIES", "SYNONYM", "1", "Fagaceae", "Quercus", "pedunculata", "Ehrh."),
    ("3", "Quercus petraea", "SPECIES", "ACCEPTED", None, "Fagaceae", "Quercus", "petraea", "Liebl."),
    ("4", "Quercus", "GENUS", "ACCEPTED", None, "Fagaceae", "Quercus", None, "L."),
    ("5", "Abies alba", "SPECIES", "ACCEPTED", None, "Pinaceae", "Abies", "alba", "Mill."),
    ("6", "Acacia alba", "SPECIES", "ACCEPTED", None, "Fabaceae", "Acacia", "alba", "X."),
    ("7", "Salix × fragilis", "SPECIES", "ACCEPTED", None, "Salicaceae", "Salix", "fragilis", "L."),
    ("8", "Festuca ovina aggr.", "SPECIES AGGREGATE", "ACCEPTED", None, "Poaceae", "Festuca", "ovina", None),
    ("9", "Festuca ovina", "SPECIES", "ACCEPTED", None, "Poaceae", "Festuca", "ovina", "L."),
    ("10", "Pinus abies", "SPECIES", "SYNONYM", "11", "Pinaceae", "Pinus", "abies", "L."),
    ("11", "Picea abies", "SPECIES", "ACCEPTED", None, "Pinaceae", "Picea", "abies", "Karst."),
    ("12", "Pinus abies", "SPECIES", "SYNONYM", "13", "Pinaceae", "Pinus", "abies", "Thunb."),
    ("13", "Picea polita", "SPECIES", "ACCEPTED", None, "Pinaceae", "Picea", "polita", "Carr."),
    ("14", "Larix dubia", "SPECIES", "SYNONYM", "5", "Pinaceae", "Larix", "dubia", None),
    ("15", "Larix dubia", "SPECIES", "SYNONYM", "13", "Pinaceae", "Larix", "dubia", None),
]


@pytest.fixture(scope="module")
def ix(spark):
    return staged(key_index(build_backbone(spark.createDataFrame(ROWS, SCHEMA))), "ix")


def run(spark, ix, names, **kw):
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, input_name string")
    backends = kw.pop("backends", None) or [Backend("wfo", ix, "wfo:1")]
    out = resolve(df, backends, kw.pop("options", Options()), **kw)
    assert out.df.columns == ["row_idx", *RESULT]
    return {r.row_idx: r for r in out.df.collect()}


def test_cascade(spark, ix):
    names = ["Quercus robur L.", "Quercus pedunculata", "quercus ROBUR", "Q. petraea", "A. alba", "Abies alba", "Zzz yyy", None, "Salix x fragilis", "Quercus sp.", "Quercus ropbur", "Festuca ovina agg.", "Pinus abies", "Larix dubia", "Quercus robur subsp. minor"]
    r = run(spark, ix, names)
    assert len(r) == len(names)
    kinds = [r[k].match_type for k in range(len(names))]
    assert kinds == ["exact", "exact", "exact_ci", "abbrev", "abbrev", "exact", "none", None, "exact", "exact", "fuzzy", "exact", "exact", "exact", "exact_ci"]
    assert r[1].accepted_name == "Quercus robur" and r[1].is_synonym
    assert r[4].accepted_name == "Abies alba"  # spelled out in the batch
    assert r[9].rank == "genus" and r[11].taxon_id == "8"
    assert r[12].accepted_name == "Picea abies" and not r[12].is_ambiguous  # the epithet is kept
    assert r[13].is_ambiguous and r[13].ambiguous_targets == "13|5"
    assert r[10].fuzzy_dist == pytest.approx(1 / 14) and r[0].backbone_version == "wfo:1"


def test_abbreviation_without_context_is_flagged(spark, ix):
    r = run(spark, ix, ["A. alba"], options=Options(fuzzy=False))[0]
    assert r.match_type == "none" and r.is_ambiguous and r.ambiguous_targets == "5|6"


def test_collapse_and_threshold(spark, ix):
    assert run(spark, ix, ["Festuca ovina agg."], options=Options(aggregates="collapse"))[0].taxon_id == "9"
    assert run(spark, ix, ["Quercus rxxxr"], options=Options(fuzzy_threshold=0.05))[0].match_type == "none"
    assert run(spark, ix, ["Quercus rxbxr"], options=Options(fuzzy_threshold=2))[0].match_type == "fuzzy"
    with pytest.raises(ValueError):
        run(spark, ix, ["Quercus rxxxr"], options=Options(fuzzy_method="jw", fuzzy_threshold=2))


def test_chain_scope_and_classes(spark, ix):
    other = staged(key_index(build_backbone(spark.createDataFrame([("a1", "Boletus edulis", "SPECIES", "ACCEPTED", None, "Boletaceae", "Boletus", "edulis", "Bull.")], SCHEMA))), "ix")
    reg = spark.createDataFrame([("Boletus", "fungi", "fungus", "fungus"), ("Amanita", "fungi", "fungus", "fungus"), ("Quercus", "plantae", "angiosperm", "tree")], "genus string, kingdom_group string, taxon_group string, life_form string")
    cover = spark.createDataFrame([("Quercus", "wfo"), ("Boletus", "col")], "genus string, backend string")
    names = ["Quercus robur", "Boletus edulis", "Amanita muscaria", "Zzz yyy", None]
    r = run(spark, ix, names, backends=[Backend("wfo", ix), Backend("col", other)], register=reg, coverage=cover)
    assert [r[k].match_type for k in range(5)] == ["exact", "exact", "out_of_scope", "none", None]
    assert r[1].backend == "col" and r[2].life_form == "fungus" and r[0].kingdom_group == "plantae" and r[3].kingdom_group is None


def test_region_drops_only_where_another_stays(spark, ix):
    table = spark.createDataFrame([("Quercus robur", "GER", "native"), ("Quercus petraea", "JAP", "native")], "canonical_name string, tdwg_code string, native_status string")
    r = run(spark, ix, ["Quercus robuur"], ranges=Ranges(table, ("JAP",)))
    assert r[0].accepted_name == "Quercus robur"  # the only candidate


def test_synonym_chain_cycle_and_dangling(spark):
    rows = [(f"s{k}", f"A n{k}", "SPECIES", "SYNONYM", f"s{k + 1}", "F", "A", f"n{k}", None) for k in range(12)]
    rows += [("s12", "A n12", "SPECIES", "ACCEPTED", None, "F", "A", "n12", None), ("x", "A x", "SPECIES", "SYNONYM", "y", "F", "A", "x", None), ("y", "A y", "SPECIES", "SYNONYM", "x", "F", "A", "y", None), ("d", "A d", "SPECIES", "HOMOTYPIC_SYNONYM", "gone", "F", "A", "d", None)]
    got = {r.taxon_id: r for r in embed_accepted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[f"s{k}"].accepted_taxon_id == "s12" for k in range(13))
    assert got["x"].accepted_taxon_id == "x" and got["y"].accepted_taxon_id == "y"
    assert got["d"].is_synonym and got["d"].accepted_taxon_id == "d"


def test_row_local_stream_plan_equals_batch(spark, ix):
    df = spark.createDataFrame([(0, "Quercus robur L."), (1, "quercus robur"), (2, "no such"), (3, None)], "row_idx long, input_name string")
    assert [r.match_type for r in resolve_stream(df, ix).orderBy("row_idx").collect()] == ["exact", "exact_ci", "none", None]


def test_scope_comes_before_fuzzy_and_abbreviations(spark, ix):
    reg = spark.createDataFrame([("Quercis", "animalia", "beetle", "beetle"), ("Quercus", "plantae", "tree", "tree")], "genus string, kingdom_group string, taxon_group string, life_form string")
    cover = spark.createDataFrame([("Quercus", "wfo"), ("Quercis", "col")], "genus string, backend string")
    names = ["Quercis robur", "Quercus robuur", "Quercis robur"]
    assert run(spark, ix, names)[0].match_type == "fuzzy"  # by first letters, where scope isn't known
    r = run(spark, ix, names, register=reg, coverage=cover.filter("backend = 'wfo'"))
    assert [r[k].match_type for k in range(3)] == ["out_of_scope", "fuzzy", "out_of_scope"]
    r = run(spark, ix, names, register=reg, coverage=cover, backends=[Backend("wfo", ix), Backend("col", ix)])
    assert r[0].match_type == "fuzzy" and r[0].backend == "col"  # the second checklist covers it


def test_resolution_by_region_names_and_coordinates(spark, ix):
    from binomia.operators.region import Geography

    regs = spark.createDataFrame([("GER", "Germany", "11", "M", "1", "Europe"), ("JAP", "Japan", "38", "E", "3", "Asia")], "code string, name string, level2_code string, level2_name string, level1_code string, level1_name string")
    rng = spark.createDataFrame([("Quercus robur", "GER", "native"), ("Quercus petraea", "JAP", "native")], "canonical_name string, tdwg_code string, native_status string")
    box = [[[100.0, 0.0], [110.0, 0.0], [110.0, 10.0], [100.0, 10.0]]]
    geo = Geography(rng, regs, spark.createDataFrame([(0, "JAP", [box])], "feature_idx int, code string, polys array<array<array<array<double>>>>"))
    names = ["Quercus pobraea"]
    opts = Options(fuzzy_threshold=0.6, prefer_closest=False)
    assert run(spark, ix, names, options=opts)[0].accepted_name == "Quercus robur"
    assert run(spark, ix, names, options=opts, where="Japan", geography=geo)[0].accepted_name == "Quercus petraea"
    assert run(spark, ix, names, options=opts, coords=(105.0, 5.0), geography=geo)[0].accepted_name == "Quercus petraea"
    with pytest.raises(ValueError, match="geography"):
        run(spark, ix, names, where="Japan")


def test_frequent_names_are_cleaned_once_and_stream_takes_all_keys(spark, ix):
    names = ["Quercus robur L."] * 50 + ["Festuca ovina agg.", "Salix x fragilis", "Quercus sp.", "Quercus robur subsp. minor", "QUERCUS ROBUR", "Quercus pedvnculata", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, input_name string")
    batch = run(spark, ix, names, options=Options(fuzzy=False))
    stream = {r.row_idx: r for r in resolve_stream(df, ix).collect()}
    assert len(stream) == len(batch) == len(names)
    for k in range(len(names)):
        assert (stream[k].match_type, stream[k].taxon_id) == (batch[k].match_type, batch[k].taxon_id), names[k]
    assert batch[50].taxon_id == "8" and batch[51].taxon_id == "7" and batch[57].match_type is None
