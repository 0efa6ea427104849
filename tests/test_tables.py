import json

import pytest
from pyspark.sql import functions as F

from binomia.operators import doors, enrich, inspect, region, register, report, reshape, traits
from binomia.operators.add_data import add_data, conflicts
from binomia.operators.backbone import build_backbone, key_index
from binomia.plans.resolve import Backend, Options, Result
from binomia.sources.catalog import Catalog, format_version, is_outdated, parse_meta, resolve_manifest_entry
from binomia.sources.io import export, read_polygons, read_table
from binomia.sources.staging import staged
from tests.test_resolve import ROWS, SCHEMA


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_inheritance_goes_down_only(spark):
    res = spark.createDataFrame([("A b", None), ("A b aggr.", "agg."), ("C d", "agg."), (None, None)], "accepted_name string, qualifier string")
    tab = spark.createDataFrame([("A b agg.", 1.0), ("C d", 2.0), ("C d", 9.0)], "canonical_name string, x double")
    got = rows(enrich.enrich(res, tab, {"x": "x"}, inherited="i"), "accepted_name", "x", "i")
    assert got == sorted([("A b", 1.0, True), ("A b aggr.", 1.0, False), ("C d", None, None), (None, None, None)], key=repr)


def test_missing_source_columns_and_doors(spark):
    res = spark.createDataFrame([("A b", "A")], "accepted_name string, genus string")
    tab = spark.createDataFrame([("A b", 3.0, "x")], "canonical_name string, body_mass_g double, habitat string")
    out = enrich.enrich(res, tab, {"y": "nope"}, types={"y": "double"})
    assert out.schema["y"].dataType.simpleString() == "double"
    assert doors.open_door(res, "avonet", {"avonet": tab}).columns[-2:] == ["avonet_body_mass_g", "habitat"]
    assert doors.open_door(res, "avonet", {"avonet": tab}, cols=["habitat"]).columns[-1] == "habitat"
    with pytest.raises(ValueError):
        doors.open_door(res, "avonet", {"avonet": tab}, cols=["zzz"])
    with pytest.raises(ValueError):
        doors.open_door(res, "nope", {})
    gen = spark.createDataFrame([("A", "EM")], "genus string, mycorrhizal_type string")
    assert doors.open_door(res, "fungalroot", {"fungalroot": gen}).first().mycorrhizal_type == "EM"


def test_pivot_and_long(spark):
    res = spark.createDataFrame([("A b",), ("C d",)], "accepted_name string")
    tab = spark.createDataFrame([("A b", "AT", "inv"), ("A b", "DE", "nat"), ("A b", None, "?")], "canonical_name string, country_code string, status string")
    wide = enrich.enrich_grouped(res, tab, "country_code", ["status"])
    assert wide.columns == ["accepted_name", "status_AT", "status_DE"]
    assert enrich.enrich_grouped(res, tab, "country_code", ["status"], "AT").columns[-1] == "status"
    assert len(rows(reshape.to_long(wide, ["status"], "c"), "c")) == 4
    assert rows(reshape.to_long(wide, ["status"], "c", drop_na=True), "accepted_name", "c", "status") == [("A b", "AT", "inv"), ("A b", "DE", "nat")]
    with pytest.raises(ValueError):
        reshape.to_long(res, ["status"])


def test_traits(spark):
    res = spark.createDataFrame([("A b",), ("C d",)], "accepted_name string")
    t = {
        "amniote": spark.createDataFrame([("A b", "-999", "365.25")], "canonical_name string, litter_clutch_size string, female_maturity_d string"),
        "combine": spark.createDataFrame([("A b", "4")], "canonical_name string, litter_size_n string"),
        "pantheria": spark.createDataFrame([("A b", "6")], "canonical_name string, litter_size string"),
    }
    r = traits.add_trait(res, "clutch_litter_size", t, mode="coalesce").filter("accepted_name = 'A b'").first()
    assert (r.clutch_litter_size, r.clutch_litter_size_source, r.clutch_litter_size_n) == (5.0, "combine,pantheria", 2)
    assert traits.add_trait(res, "age_at_maturity", t).filter("accepted_name = 'A b'").first().age_at_maturity_amniote == 1.0
    with pytest.raises(ValueError, match="did you mean"):
        traits.trait("seed_mas")
    with pytest.raises(ValueError):
        traits.add_trait(res, "woodiness", t, mode="coalesce", combine="median") if traits.combiner("categorical", "median") else None
    vals = spark.createDataFrame([("herbaceous woody",), ("semi_woody",), ("herbaceous",), ("woody",), ("",)], "v string")
    assert [x[0] for x in vals.select(traits.TRAITS["woodiness"].sources["austraits"].map(F.col("v"))).collect()] == ["variable", "variable", "non-woody", "woody", None]
    life = spark.createDataFrame([("annual perennial",), ("short_lived_perennial",), ("ephemeral",), ("x",)], "v string")
    assert [x[0] for x in life.select(traits.TRAITS["life_history"].sources["gift"].map(F.col("v"))).collect()] == ["variable", "perennial", "annual", None]
    assert len(traits.list_traits()) == 40


def test_regions_and_points(spark):
    regs = spark.createDataFrame([("GER", "Germany", "11", "Middle Europe", "1", "Europe"), ("JAP", "Japan", "38", "Eastern Asia", "3", "Asia-Temperate")], "code string, name string, level2_code string, level2_name string, level1_code string, level1_name string")
    assert region.resolve_regions(regs, ["Éurope", "38", "??"]) == (["GER", "JAP"], ["??"])
    assert [r.code for r in region.search_regions(regs, "EAST").collect()] == ["JAP"]
    box = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]]
    f = spark.createDataFrame([(0, "A", [box]), (1, "B", [[box[0]]])], "feature_idx int, code string, polys array<array<array<array<double>>>>")
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 20.0, 1.0), (3, -1.0, 5.0)], "point_id int, lon double, lat double")
    assert rows(region.locate_points(p, f), "point_id", "code") == [(0, "A"), (1, "B"), (2, None), (3, None)]


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1]]
    feats = [{"type": "Feature", "properties": {"LEVEL3_COD": "X"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"LEVEL3_COD": "Y"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    at = tmp_path / "a.geojson"
    at.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    assert [(r.code, len(r.polys)) for r in read_polygons(spark, str(at)).orderBy("feature_idx").collect()] == [("X", 1), ("Y", 2)]


def test_register(spark):
    schema = "genus string, kingdom string, phylum string, class string, `order` string, family string"
    g = {"worms": spark.createDataFrame([("A", None, "P1", None, None, "Fa"), ("V", None, None, None, None, "Xviridae")], schema), "col": spark.createDataFrame([("A", "Metazoa", "P2", "C", None, None), ("B", None, None, None, None, "Fa")], schema)}
    fam = spark.createDataFrame([], "family string, kingdom_group string, taxon_group string, life_form string")
    got = {r.genus: r for r in register.build_register(g, fam).collect()}
    assert (got["A"].kingdom, got["A"].phylum, got["A"]["class"], got["A"].family) == ("Animalia", "P1", "C", "Fa")
    assert got["B"].kingdom == "Animalia" and got["B"].kingdom_group == "animalia" and got["V"].kingdom_group == "viruses"


def test_inspect(spark):
    names = ["Carexus mysteriosa"] * 6 + ["Carexus mysteryosa"] + ["Aus bus", None]
    df = spark.createDataFrame([(n,) for n in names], "input_name string")
    reg = spark.createDataFrame([("Carexus", "plantae")], "genus string, kingdom_group string")
    out = {r.input_name: r for r in inspect.inspect(df, reg).collect()}
    assert out["Carexus mysteryosa"].suggestion == "Carexus mysteriosa" and out["Carexus mysteryosa"].anomalies == "near_duplicate"
    assert out["Aus bus"].anomalies == "unknown" and out["Aus bus"].tier == "unresolved" and "Carexus mysteriosa" not in out
    twice = spark.createDataFrame([("Carexus mysteriosa",), ("Carexus mysteryosa",)], "input_name string")
    assert inspect.inspect(twice).count() == 0  # equally frequent


def test_inspect_groups_and_ranges(spark):
    res = spark.createDataFrame([(f"P n{k}x", f"P n{k}x", "exact", "plantae") for k in range(9)] + [("A zzzzz", "A zzzzz", "exact", "animalia")], "input_name string, accepted_name string, match_type string, kingdom_group string")
    regs = spark.createDataFrame([("G", "1"), ("N", "5")], "code string, level1_code string")
    rng = spark.createDataFrame([(f"P n{k}x", "G", "native") for k in range(8)] + [("P n8x", "N", "native")], "canonical_name string, tdwg_code string, native_status string")
    out = {r.input_name: r.anomalies for r in inspect.inspect(res, ranges=rng, regions=regs).collect()}
    assert out == {"A zzzzz": "outlier_group", "P n8x": "out_of_range"}
    geo = {r.input_name: r.anomalies for r in inspect.inspect(res, ranges=rng, codes=["G"], min_tier="review").collect()}
    assert geo["P n8x"] == "geographic"


def test_add_data(spark):
    ix = staged(key_index(build_backbone(spark.createDataFrame(ROWS, SCHEMA))), "ix")
    be, opts = [Backend("col", ix, prefix_fallback=False)], Options(fuzzy=False)
    res = spark.createDataFrame([("1", "Quercus robur"), ("5", "Abies alba")], "accepted_id string, accepted_name string")
    data = spark.createDataFrame([("Quercus pedunculata", 1.0), ("Quercus robur", 1.0), ("junk", 3.0)], "species string, height double")
    assert rows(add_data(res, data, be, "species", options=opts), "accepted_id", "height") == [("1", 1.0), ("5", None)]
    bad = data.withColumn("height", F.col("height") + F.when(F.col("species") == "Quercus robur", 1).otherwise(0))
    with pytest.raises(ValueError, match="differ"):
        add_data(res, bad, be, "species", options=opts)
    assert conflicts(bad.withColumn("k", F.lit(1)), "k", ["height"]).count() == 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, v string")
    for end in ("", ".parquet", ".csv", ".tsv"):
        export(df, str(tmp_path / f"out{end}"))
        if end:
            assert read_table(spark, str(tmp_path / f"out{end}")).count() == 2
        with pytest.raises(Exception, match="exist"):
            export(df, str(tmp_path / f"out{end}"))
    import sqlite3

    with sqlite3.connect(tmp_path / "a.sqlite") as con:
        con.execute("create table t (a int)")
        con.execute("insert into t values (5)")
    assert read_table(spark, str(tmp_path / "a.sqlite"), table="t").first()[0] == 5
    for bad in ((str(tmp_path / "a.sqlite"), None), ("x.doc", None)):
        with pytest.raises(ValueError):
            read_table(spark, *bad)


def test_catalog_and_reports(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    df = spark.createDataFrame([(1,)], "a int")
    c.install("backbone", "wfo", df, "2024", {"citation": {"title": "T", "year": 2020, "authors": "A"}})
    c.install("backbone", "wfo", df, "2025")
    assert c.installed("backbone") == ["wfo"] and c.meta("backbone", "wfo")["version"] == "2025" and c.table("backbone", "wfo", "2024").count() == 1
    with pytest.raises(FileNotFoundError):
        c.table("backbone", "wfo", "1999")
    assert format_version("wfo", parse_meta("version=1\nbuild_date=2020")) == "wfo:1 (2020)"
    assert resolve_manifest_entry({"backbones": {"wfo": {"version": 3}}}, "wfo")["version"] == 3
    assert is_outdated({"version": "1"}, {"version": "2"}) and not is_outdated({"version": "1"}, {"version": "2", "static": True})
    meta = {"backends": ["wfo"], "enrichments": []}
    assert report.cite(meta, {"wfo": c.meta("backbone", "wfo", "2024")}) == ["A (2020). T."]
    assert report.cite(meta, {"wfo": c.meta("backbone", "wfo", "2024")}, "bibtex")[0].startswith("@misc{ref,")
    res = spark.createDataFrame([("x", "exact", "g"), ("y", "none", None), (None, None, None)], "input_name string, match_type string, taxon_group string")
    assert "exact: 1" in report.summary(res, meta)
    assert rows(report.taxon_tally(res), "taxon_group", "n", "n_unmatched") == [("g", 1, 0), ("unknown", 1, 1)]


def test_regions_by_name_and_coordinates(spark):
    regs = spark.createDataFrame([("GER", "Germany", "11", "Middle Europe", "1", "Europe"), ("JAP", "Japan", "38", "Eastern Asia", "3", "Asia")], "code string, name string, level2_code string, level2_name string, level1_code string, level1_name string")
    box = lambda x: [[[x, 0.0], [x + 10, 0.0], [x + 10, 10.0], [x, 10.0]]]
    feats = spark.createDataFrame([(0, "GER", [box(0.0)]), (1, "JAP", [box(100.0)])], "feature_idx int, code string, polys array<array<array<array<double>>>>")
    ranges = spark.createDataFrame([("A b", "JAP", "native"), ("C d", "GER", "introduced")], "canonical_name string, tdwg_code string, native_status string")
    geo = region.Geography(ranges, regs, feats)
    assert region.region_codes(geo, "Germany", (105.0, 5.0)) == ["GER", "JAP"]
    assert region.region_codes(geo, None, [(1.0, 1.0), (50.0, 50.0)]) == ["GER"]
    assert region.region_codes(geo, ["asia"], spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "lon double, lat double")) == ["GER", "JAP"]
    assert region.ranges_of(geo) is None and region.ranges_of(geo, "Asia", mode="native").codes == ("JAP",)
    with pytest.raises(ValueError, match="Atlantis"):
        region.region_codes(geo, ["Atlantis"])
    with pytest.raises(ValueError, match="180"):
        region.region_codes(geo, None, (200.0, 0.0))
    with pytest.raises(ValueError, match="polygons"):
        region.region_codes(region.Geography(ranges, regs), None, (0.0, 0.0))


def test_points_far_apart_and_over_cell_bounds(spark):
    star = [[[0.0, 0.0], [30.0, 4.0], [60.0, 0.0], [34.0, 30.0], [60.0, 60.0], [30.0, 56.0], [0.0, 60.0], [26.0, 30.0]]]
    far = [[[-179.0, -89.0], [-170.0, -89.0], [-170.0, -80.0]]]
    f = spark.createDataFrame([(0, "S", [star]), (1, "F", [far, star])], "feature_idx int, code string, polys array<array<array<array<double>>>>")
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in range(-180, 181, 9) for y in range(-90, 91, 7))]

    def inside(x, y, ring):
        odd = False
        for (xi, yi), (xj, yj) in zip(ring, ring[-1:] + ring[:-1], strict=True):
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                odd = not odd
        return odd

    got = dict(rows(region.locate_points(spark.createDataFrame(pts, "point_id int, lon double, lat double"), f), "point_id", "code"))
    assert got == {k: "S" if inside(x, y, star[0]) else "F" if inside(x, y, far[0]) else None for k, x, y in pts}


def test_log_of_enrichments(spark):
    res = Result(spark.createDataFrame([("A b", "A b", "exact"), ("C d", "C d", "exact"), (None, None, "none")], "accepted_name string, matched_name string, match_type string"), {"backends": ["wfo"], "enrichments": []})
    griis = spark.createDataFrame([("A b", "AT", "inv"), ("A b", "DE", "nat")], "canonical_name string, country_code string, status string")
    leda = spark.createDataFrame([("C d", 1.5)], "canonical_name string, sla_mm2_mg double")
    out = doors.logged_door(doors.logged_door(res, "griis", {"griis": griis}, version="2024"), "leda", {"leda": leda}, source="LEDA")
    assert [e["name"] for e in out.meta["enrichments"]] == ["griis", "leda"] and res.meta["enrichments"] == []
    text = report.summary(out.df, out.meta)
    assert "griis 2024: 1 of 2" in text and "leda : 1 of 2" in text
    assert rows(reshape.long_of(out, drop_na=True), "accepted_name", "country_code", "status") == [("A b", "AT", "inv"), ("A b", "DE", "nat")]
    with pytest.raises(ValueError, match="name"):
        reshape.long_of(res)
    assert report.cite(out.meta, {"leda": {"citation": {"title": "L", "year": 2008, "authors": "K"}}}) == ["K (2008). L."]


def test_door_and_trait_listings(spark, tmp_path):
    gift = spark.createDataFrame([("A b", "woody", 2.0, "x")], "canonical_name string, woodiness_1 string, plant_height_max double, rare string")
    assert doors.door_columns("gift", {"gift": gift}) == [("gift_woodiness_1", "character"), ("gift_plant_height_max", "numeric"), ("gift_rare", "character")]
    res = spark.createDataFrame([("A b",)], "accepted_name string")
    assert doors.open_door(res, "gift", {"gift": gift}).columns == ["accepted_name", "gift_woodiness_1", "gift_plant_height_max"]
    assert "gift_rare" in doors.open_door(res, "gift", {"gift": gift}, cols="all").columns
    info = traits.trait_info("seed_mass")
    assert info[0] == {"trait": "seed_mass", "kind": "numeric", "unit": "mg", "source": "diaz", "enrichment": "diaz_traits", "column": "seed_mass_mg", "note": "as given"} and info[1]["note"] == "to mg"
    c = Catalog(spark, str(tmp_path))
    c.install("enrichment", "gift", gift, "3", {"static": True, "source_url": "u"})
    c.register("enrichment", "own", res.withColumn("x", F.lit(1)))
    assert [tuple(r) for r in c.enrichments().collect()] == [("gift", "3", 1, True, "woodiness_1, plant_height_max, rare", "u"), ("own", None, None, False, "x", None)]
    with pytest.raises(FileExistsError):
        c.install("enrichment", "gift", gift, "3")
    c.remove("enrichment", "gift", "3")
    assert c.installed("enrichment") == []


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(enrich, "MAX_GROUPS", 3)
    res = spark.createDataFrame([("A",)], "accepted_name string")
    tab = spark.range(5).select(F.lit("A").alias("canonical_name"), F.col("id").cast("string").alias("g"), F.lit(1).alias("v"))
    with pytest.raises(ValueError, match="3 groups"):
        enrich.enrich_grouped(res, tab, "g", ["v"])
    assert len(enrich.enrich_grouped(res, tab, "g", ["v"], ["0", "1"]).columns) == 3


def test_custom_data_clashes_and_hints(spark):
    ix = staged(key_index(build_backbone(spark.createDataFrame(ROWS, SCHEMA))), "ix")
    be, opts = [Backend("col", ix, prefix_fallback=False)], Options(fuzzy=False)
    res = spark.createDataFrame([("1", "Quercus robur", 9.0)], "accepted_id string, accepted_name string, height double")
    data = spark.createDataFrame([("Quercus robur", 1.0, "AT"), ("Quercus pedunculata", 1.0, "DE")] * 4, "species string, height double, land string")
    with pytest.warns(UserWarning, match="7 rows"):
        out = add_data(res, data, be, "species", ["height"], options=opts)
    assert rows(out, "accepted_id", "height", "data_height") == [("1", 9.0, 1.0)]
    differ = data.withColumn("height", F.when(F.col("land") == "AT", 1.0).otherwise(2.0))
    with pytest.raises(ValueError, match="group_col='land'"):
        add_data(res, differ, be, "species", ["height"], options=opts)
    wide = add_data(res, differ, be, "species", ["height"], "land", options=opts)
    assert rows(wide, "height", "height_AT", "height_DE") == [(9.0, 1.0, 2.0)]


def test_sqlite_by_ranges_and_features_by_line(spark, tmp_path, monkeypatch):
    import sqlite3

    from binomia.sources import io

    monkeypatch.setattr(io, "SQLITE_ROWS", 7)
    path = str(tmp_path / "b.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("create table t (a int, b text, c real, d blob)")
        con.executemany("insert into t values (?, ?, ?, ?)", [(k, f"n{k}", k / 2, b"x") for k in range(20)] + [("odd", None, "x", None)])
        con.execute("delete from t where a = 9")
        con.execute("create view v as select a, b from t")
        con.execute("create table none (a int)")
    df = read_table(spark, path, table="t")
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "binary"] and df.count() == 20
    assert df.filter("a = 19").first()[:3] == (19, "n19", 9.5) and df.filter("a is null and c is null").count() == 1
    assert read_table(spark, path, table="v").count() == 20 and read_table(spark, path, table="none").count() == 0
    ring = [[0, 0], [1, 0], [1, 1]]
    feats = [{"type": "Feature", "properties": {"LEVEL3_COD": k}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for k in "XY"]
    (tmp_path / "a.geojsonl").write_text("\n".join(map(json.dumps, feats)))
    assert [r.code for r in read_table(spark, str(tmp_path / "a.geojsonl")).orderBy("feature_idx").collect()] == ["X", "Y"]
