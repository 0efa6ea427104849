"""Versions and deltas of checklists, layouts for lookups, the ladder of attribute tables, state over batches, spreadsheets, covers, letters."""

import math
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from binomia.functions.distance import jw_many
from binomia.operators import add_data, enrich, inspect, region, traits
from binomia.operators.backbone import build_backbone, embed_accepted, key_index
from binomia.operators.delta import apply_delta, diff_versions, patch_index
from binomia.operators.clean import attach_agg_key, clean_names
from binomia.operators.exact import lookup_exact, match_exact
from binomia.operators.fuzzy import letter_pairs, lookup_fuzzy
from binomia.operators.pick import dedup_fuzzy_targets
from binomia.operators.register import extract_genera
from binomia.plans import queries
from binomia.plans import resolve as resolving
from binomia.plans.resolve import Backend, Options, resolve
from binomia.sources import spreadsheet
from binomia.sources.buckets import save_index
from binomia.sources.catalog import Catalog, Source, version_key
from binomia.sources.staging import staged, staging_scope
from binomia.streaming import stateful
from binomia.streaming import stream as streaming
from binomia.streaming.stream import resolve_batch

CHECKLIST = "taxon_id string, canonical_name string, taxon_rank string, taxonomic_status string, accepted_name_usage_id string, family string, genus string, specific_epithet string, authorship string"


def taxon(i, genus, epithet, target=None, status=None):
    return (i, f"{genus} {epithet}", "SPECIES", status or ("SYNONYM" if target else "ACCEPTED"), target, "Fam", genus, epithet, "L.")


def as_rows(df):
    return sorted(map(str, df.collect()))


def random_checklist(r, n):
    rows = {}
    for k in range(n):
        target = f"t{r.randrange(n + 5)}" if r.random() < 0.5 else None
        rows[f"t{k}"] = taxon(f"t{k}", f"G{r.randrange(4)}", f"e{r.randrange(12)}", None if target == f"t{k}" else target)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patched_index_equals_one_built_afresh(spark, seed):
    """Random inserts, updates and deletes in chains of synonyms, some of them circles or without target."""
    r = random.Random(seed)
    old = random_checklist(r, 60)
    new = {k: v for k, v in old.items() if r.random() > 0.08}
    for k, v in random_checklist(r, 70).items():
        if r.random() < 0.15 or (k not in old and r.random() < 0.5):
            new[k] = v
    a, b = (spark.createDataFrame(list(x.values()), CHECKLIST) for x in (old, new))
    built = build_backbone(a)
    changes = diff_versions(a, b)
    assert as_rows(apply_delta(a, changes).select(b.columns)) == as_rows(b)
    index, patched = patch_index(key_index(built), built, changes)
    fresh = build_backbone(b)
    assert as_rows(patched.select(fresh.columns)) == as_rows(fresh)
    assert as_rows(index) == as_rows(key_index(fresh))


def test_delta_of_nothing_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], CHECKLIST)
    some = spark.createDataFrame([taxon("a", "Aus", "bus"), (None, *taxon(None, "Cus", "dus")[1:]), (*taxon("e", "Eus", "fus")[:8], None)], CHECKLIST)
    assert diff_versions(some, some).count() == 0 and diff_versions(none, none).count() == 0
    assert {(x.op, x.taxon_id) for x in diff_versions(none, some).collect()} == {("insert", "a"), ("insert", "e")}
    assert {(x.op, x.taxon_id) for x in diff_versions(some, none).collect()} == {("delete", "a"), ("delete", "e")}
    blank = some.withColumn("authorship", F.coalesce("authorship", F.lit("")))
    assert [x.taxon_id for x in diff_versions(some, blank).filter("op = 'update'").collect()] == ["e"]  # null isn't ''


def test_rows_without_id_and_repeated_ids(spark):
    rows = [taxon(None, "Aus", "bus"), taxon("x", "Bus", "cus"), taxon("x", "Aus", "aus"), taxon("y", "Dus", "dus", "x")]
    out = embed_accepted(spark.createDataFrame(rows, CHECKLIST)).collect()
    assert len(out) == 4
    assert next(r for r in out if r.taxon_id is None).accepted_name == "Aus bus"
    assert {r.accepted_name for r in out if r.taxon_id in ("x", "y")} == {"Aus aus"}  # the least row stands for the taxon


def test_ranks_of_homonyms_are_not_mixed(spark):
    rows = [("2", "Oenanthe", "GENUS", "Animalia", "Muscicapidae"), ("1", "Oenanthe", "GENUS", "Plantae", None)]
    built = spark.createDataFrame(rows, "taxon_id string, canonical_name string, taxon_rank string, kingdom string, family string")
    got = extract_genera(built, "wfo").first()
    assert (got.kingdom, got.family) == ("Plantae", None)


def test_lookups_shuffle_names_only(spark, tmp_path):
    r = random.Random(5)
    rows = [taxon(f"t{k}", f"Genus{k % 40}", f"epi{k}") for k in range(2000)]
    ix = key_index(build_backbone(spark.createDataFrame(rows, CHECKLIST)))
    laid = save_index(ix, "laid_out_index", path=f"file://{tmp_path}/index")
    names = spark.createDataFrame([(k, f"Genus{k % 40} epi{k + r.randrange(2)}") for k in range(300)], "row_idx long, input_name string")
    assert as_rows(resolve_batch(names, laid)) == as_rows(resolve_batch(names, ix))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        from binomia.operators.clean import attach_agg_key, clean_names

        found = match_exact(attach_agg_key(clean_names(names)), laid)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table laid_out_index")
    lines = plan.splitlines()
    at = next(k for k, x in enumerate(lines) if "laid_out_index" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            above.append(x)
            level = depth(x)
        if "SortMergeJoin" in x and depth(x) <= level:
            break
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)


def test_versions_go_by_number(spark, tmp_path):
    assert sorted(["10", "9", "9.1", "2024-12", "2024-2", "9a"], key=version_key) == ["9", "9.1", "9a", "10", "2024-2", "2024-12"]
    c = Catalog(spark, f"file://{tmp_path}/cat")
    for v in ("10", "9", "9.5"):
        c.install("backbone", "b", spark.createDataFrame([taxon("a", "Aus", f"v{v}")], CHECKLIST), v)
    assert c.versions("backbone", "b") == ["9", "9.5", "10"] and c.path("backbone", "b").endswith("/10")
    change = diff_versions(c.table("backbone", "b"), spark.createDataFrame([taxon("b", "Bus", "bus")], CHECKLIST))
    c.install_delta("backbone", "b", change, "11")
    assert [r.taxon_id for r in c.table("backbone", "b").collect()] == ["b"] and c.meta("backbone", "b")["base"] == "10"
    assert {(r.op, r.taxon_id) for r in c.delta("backbone", "b", "10").collect()} == {("insert", "b"), ("delete", "a")}


def test_ladder_of_enrichments(spark, tmp_path):
    c, asked = Catalog(spark, f"file://{tmp_path}/cat"), []
    of = lambda v: spark.createDataFrame([("Aus bus", v)], "canonical_name string, v double")
    value = lambda t: None if t is None else t.first().v

    def newest(v):
        def ask():
            asked.append(v)
            return v

        return ask

    def fails(*_):
        raise OSError("unreachable")

    c.install("enrichment", "e", of(9.0), "9")
    assert value(c.ensure("enrichment", "e", Source(newest("10"), lambda v: of(float(v))))) == 10.0  # a newer version
    c.install("enrichment", "e", of(11.0), "11")
    assert value(c.ensure("enrichment", "e", Source(newest("12"), lambda v: of(float(v))))) == 10.0  # asked once, then pinned
    assert asked == ["10"]
    c.clear()
    with pytest.warns(UserWarning, match="could not be updated"):
        assert value(c.ensure("enrichment", "e", Source(fails, fails))) == 11.0
    c.clear()
    assert value(c.ensure("enrichment", "e", Source(newest("2"), fails))) == 11.0  # an older one isn't fetched
    assert value(c.ensure("enrichment", "f", Source(newest("3"), lambda v: of(3.0)))) == 3.0
    with pytest.warns(UserWarning, match="could not be fetched"):
        assert value(c.ensure("enrichment", "g", Source(newest("3"), fails, lambda: of(4.0)))) == 4.0
    with pytest.warns(UserWarning, match="could not be built"):
        assert value(c.ensure("enrichment", "h", Source(build=fails, in_memory=lambda: of(5.0)))) == 5.0
    assert c.versions("enrichment", "h") == [] and c.versions("enrichment", "g") == ["built"]
    assert c.ensure("enrichment", "none") is None
    out = enrich.enrich(spark.createDataFrame([("Aus bus",)], "accepted_name string"), c.ensure("enrichment", "none"), {"v": "v"}, types={"v": "double"})
    assert out.dtypes == [("accepted_name", "string"), ("v", "double")] and out.first().v is None


def test_closest_per_target_over_batches(spark, tmp_path):
    """Ties, nulls, distance 0, targets that come back: after the last batch as over all rows at once."""
    r = random.Random(11)
    rows = [(f"t{r.randrange(9)}" if r.random() > 0.1 else None, k, r.choice([None, 0.0, 0.1, 0.2, 0.2, 0.3])) for k in range(300)]
    df = spark.createDataFrame(rows, "taxon_id string, row_idx long, fuzzy_dist double")
    for k in range(4):
        df.filter(F.col("row_idx") % 4 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with stateful.rocksdb(spark):
        q = stateful.closest_changes(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/log")
        q.trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"file://{tmp_path}/out")
    assert changes.filter("change = -1").count() > 0
    got = stateful.net_changes(changes).unionByName(stateful.free_matches(df))
    assert as_rows(got) == as_rows(dedup_fuzzy_targets(df).select(got.columns))


def test_rates_are_corrected_by_late_answers(spark, tmp_path):
    asked = spark.createDataFrame([(k, 60 * k) for k in range(120)], "id long, at long").select("id", F.timestamp_seconds("at").alias("ts"))
    answers = asked.filter("id % 3 <> 0").select("id", (F.col("ts") + F.expr("interval 50 minutes")).alias("answered_at"), (F.col("id") % 2 == 0).alias("hit"))
    for name, df, order in (("asked", asked, "ts"), ("answers", answers, "answered_at")):
        df.repartitionByRange(4, order).write.parquet(f"file://{tmp_path}/{name}")
    one, two = (spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{n}") for n, x in (("asked", asked), ("answers", answers)))
    w = stateful.monitor_rates(stateful.answered_share(one, two, "id", "ts", "answered_at", "1 hour", "1 day"), f"file://{tmp_path}/rates")
    w.option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = {r.window_start.hour: (r.n, r.n_matched) for r in stateful.rates(spark.read.parquet(f"file://{tmp_path}/rates")).collect()}
    want = {h: (60, sum(k % 3 != 0 and k % 2 == 0 for k in range(60 * h, 60 * h + 60))) for h in (0, 1)}
    assert got == want
    assert stateful.rates(spark.read.parquet(f"file://{tmp_path}/rates")).filter("n_corrections > 0").count() > 0


def test_names_of_answers_are_looked_up_once_per_batch(spark, tmp_path):
    asked = spark.createDataFrame([(k, 60 * k) for k in range(120)], "id long, at long").select("id", F.timestamp_seconds("at").alias("ts"))
    answers = asked.filter("id % 3 <> 0").select("id", (F.col("ts") + F.make_dt_interval(mins=(F.col("id") % 90).cast("int"))).alias("answered_at"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), (F.col("id") % 4).cast("string"))).alias("input_name"))
    for name, df, order in (("asked", asked, "ts"), ("answers", answers, "answered_at")):
        df.repartitionByRange(3, order).write.parquet(f"file://{tmp_path}/{name}")
    one, two = (spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{n}") for n, x in (("asked", asked), ("answers", answers)))
    seen = []

    def hits(names):
        seen.append(sorted(r[0] for r in names.collect()))
        return names.select("input_name", F.col("input_name").isin("n1", "n2").alias("hit"))

    w = stateful.monitor_rates(stateful.answered_share(one, two, "id", "ts", "answered_at", "1 hour", "1 day"), f"file://{tmp_path}/rates", hits=hits)
    w.option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert sum(map(len, seen)) > 0 and all(names == sorted(set(names)) and set(names) <= {"n0", "n1", "n2", "n3"} for names in seen)
    got = {r.window_start.hour: (r.n, r.n_matched) for r in stateful.rates(spark.read.parquet(f"file://{tmp_path}/rates")).collect()}
    assert got == {h: (60, sum(k % 3 != 0 and k % 90 <= 60 and k % 5 > 0 and k % 4 in (1, 2) for k in range(60 * h, 60 * h + 60))) for h in (0, 1)}


def test_lists_of_taxa_stay_out_of_matching(spark):
    """Homonyms make lists of taxa as long as the checklist: plans of lookups never read them, results still list them."""
    rows = [taxon(f"a{k:02d}", "Quercus", "robur") for k in range(30)] + [taxon("b", "Quercus", "alba")]
    ix = staged(key_index(build_backbone(spark.createDataFrame(rows, CHECKLIST))), "homonyms")
    names = spark.createDataFrame([(0, "Quercus robur"), (1, "Quercus robuur"), (2, "Quercus alba"), (3, "Q. robur"), (4, None)], "row_idx long, input_name string")
    clean = attach_agg_key(clean_names(names))
    read = lambda df: " ".join(re.findall("ReadSchema: (.*)", df._jdf.queryExecution().executedPlan().toString()))
    for df in (resolve_batch(names, ix).select("row_idx", "match_type", "taxon_id"), lookup_fuzzy(names.select("row_idx", F.col("input_name").alias("cleaned")), ix).select("cleaned", "taxon_id"), lookup_exact(clean, ix).select("nk", "taxon_id")):
        assert "tier" in read(df) and "ids" not in read(df)
    every = "|".join(f"a{k:02d}" for k in range(30))
    got = {r.row_idx: (r.match_type, r.ambiguous_targets) for r in resolve(names, [Backend("col", ix), Backend("wfo", ix)]).df.collect()}
    assert got[0] == ("exact", every) and got[1] == ("fuzzy", every) and got[2] == ("exact", None) and got[3][1] == every and got[4] == (None, None)
    assert {r.nk.split("\u0001")[0]: r.ambiguous_targets for r in match_exact(clean, ix).collect()} == {"Quercus robur": every, "Quercus alba": None}


@pytest.mark.parametrize("name", ["stream_chain", "stream_resolve_all"])
def test_streams_resolve_and_store_distinct_names(spark, name, monkeypatch):
    """Rows of a batch are joined to the results of its distinct names: cleaning and lists of taxa are not per row."""
    cleaned = []
    for module in (resolving, streaming):
        monkeypatch.setattr(module, "clean_names", lambda df, *a: cleaned.append(df) or clean_names(df, *a))
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert cleaned and all("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in cleaned)
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    if name == "stream_chain":
        wide = [f for f in out.inputFiles() if "ambiguous_targets" in spark.read.parquet(f).columns]
        once = queries.names(spark, "/root/testdata/sf0.001").select("input_name").distinct().count()
        assert 0 < spark.read.parquet(*wide).count() <= once


def sheet(path, sheets, shared=()):
    """A spreadsheet as other programs write it: shared strings, sparse rows and cells."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_spreadsheets_of_other_programs(spark, tmp_path):
    shared = ["<t>species</t>", "<r><t>Aus </t></r><r><t>bus</t></r><rPh><t>x</t></rPh>", "<t>height</t>", "<t>height</t>"]
    body = '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>2</v></c><c r="D3" t="s"><v>3</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5"><v>2.0</v></c><c r="D5" t="str"><v>a&amp;b</v></c></row><row r="6"/><row r="7"><c r="A7" t="inlineStr"><is><t>Cus dus</t></is></c><c r="B7" t="b"><v>1</v></c><c r="C7"><v>3</v></c><c r="D7" t="e"><v>#N/A</v></c></row>'
    sheet(f"{tmp_path}/a.xlsx", {"notes": '<row r="1"><c r="A1" t="inlineStr"><is><t>hello</t></is></c></row>', "data": body}, shared)
    df = spreadsheet.read_sheet(spark, f"{tmp_path}/a.xlsx", "data", 3)
    assert df.dtypes == [("species", "string"), ("column_2", "string"), ("height", "bigint"), ("height_2", "string")]
    assert [tuple(r) for r in df.orderBy("species").collect()] == [("Aus bus", None, 2, "a&b"), ("Cus dus", "true", 3, None)]
    assert spreadsheet.cells(spark, f"{tmp_path}/a.xlsx").rdd.getNumPartitions() == 2  # one a sheet
    with pytest.raises(Exception, match="no sheet 'x'"):
        spreadsheet.read_sheet(spark, f"{tmp_path}/a.xlsx", "x")


def test_layout_of_a_spreadsheet_is_found(spark, tmp_path):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    line = lambda *vs: "<row>" + "".join(map(cell, vs)) + "</row>"
    body = line("A title") + line("made by hand") + line("no", "taxon") + "".join(line(k, f"Aus bu{c}") for k, c in enumerate("abcdef"))
    sheet(f"{tmp_path}/b.xlsx", {"about": line("Aus bua", "x") + line("y", "z"), "plants": body})
    ix = key_index(build_backbone(spark.createDataFrame([taxon(c, "Aus", f"bu{c}") for c in "abcdef"], CHECKLIST)))
    data, column = add_data.read_data(spark, f"{tmp_path}/b.xlsx", [Backend("wfo", ix, prefix_fallback=False)])
    assert column == "taxon" and data.columns == ["no", "taxon"] and data.count() == 6
    with pytest.raises(ValueError, match="no column of names"):
        spreadsheet.detect_sheet(spark, f"{tmp_path}/b.xlsx", lambda names: names.filter("false"))


def test_whole_spreadsheets_written_and_read(spark, tmp_path, monkeypatch):
    rows = [(k, f"n {k} <&> é", None if k % 5 == 0 else k / 4, k % 2 == 0) for k in range(2500)]
    df = spark.createDataFrame(rows, "k long, name string, x double, even boolean").repartition(3)
    spreadsheet.write_sheets(df, f"{tmp_path}/out.xlsx")
    got = spreadsheet.read_sheet(spark, f"{tmp_path}/out.xlsx")
    assert got.select("k", "name", "x", F.col("even").cast("boolean").alias("even")).orderBy("k").collect() == df.orderBy("k").collect()
    with pytest.raises(FileExistsError):
        spreadsheet.write_sheets(df, f"{tmp_path}/out.xlsx")


def test_inspection_sends_no_rows_to_the_driver(spark):
    """Many alike rows in small files, as a resolution leaves them: neither join may broadcast them."""
    targets = F.concat_ws("|", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.format_string("t%06d", k)))
    rows = spark.range(20000).select((F.concat(F.lit("Genus "), F.substring(F.lit("abcdefgh"), (F.col("id") % 4 + 1).cast("int"), 5))).alias("input_name"), F.lit("exact").alias("match_type"), F.lit(True).alias("is_ambiguous"), targets.alias("ambiguous_targets"))
    res = staged(rows, "alike_rows")
    out = inspect.inspect(res)
    joins = re.findall(r"\w+Join\b[^\n]*", out._jdf.queryExecution().executedPlan().toString())
    assert "__alike" in joins[0] and "Broadcast" not in joins[0]
    counted = res.groupBy(*res.columns).agg(F.count(F.lit(1)).alias("n"))
    once = inspect.inspect(counted, weight="n")
    assert out.count() == 20000 and once.count() == 4
    assert as_rows(out.distinct()) == as_rows(once)


@pytest.mark.parametrize("name", ["inspect_report", "inspect_review"])
def test_inspection_keeps_distinct_names_only(spark, name, monkeypatch):
    """Nothing of a row's length is stored: the query joins its names back at the end."""
    stored = []
    monkeypatch.setattr(queries, "staged", lambda df, label: stored.append(staged(df, label)) or stored[-1])
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    names = queries.names(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= names.count()
    once = names.select("input_name").distinct().count()
    assert all("input_name" not in df.columns or df.count() <= once for df in stored)


def test_inspection_of_names_counts_repeats(spark):
    ix = key_index(build_backbone(spark.createDataFrame([taxon("a", "Quercus", "robur"), taxon("b", "Quercus", "alba", "a")], CHECKLIST)))
    reg = spark.createDataFrame([("Quercus", "plantae", "land_plant", "tree")], "genus string, kingdom_group string, taxon_group string, life_form string")
    listed = ["Quercus robur"] * 5 + ["Quercus robus", "Quercus alba", "Bogus fakus", None, "Carexus mysteriosa", "Carexus mysteriosa", "Carexus mysteryosa", "Quercus robus"]
    names = spark.createDataFrame([(n,) for n in listed], "input_name string")
    bare = inspect.inspect_names(names, reg)
    assert {(r.input_name, r.anomalies) for r in bare.collect()} >= {("Bogus fakus", "unknown"), ("Carexus mysteryosa", "unknown|near_duplicate"), ("Quercus robus", "near_duplicate")}
    assert bare.filter("input_name = 'Quercus robus'").count() == 2
    with_rows = names.withColumn("row_idx", F.monotonically_increasing_id())
    done = resolve(with_rows, [Backend("wfo", ix)], Options(), reg).df
    want = inspect.inspect(done, reg)
    got = inspect.inspect_names(names, reg, backbones=[Backend("wfo", ix)])
    assert as_rows(got.select(want.columns)) == as_rows(want) and got.filter("tier_rank > 0").count() > 0
    with pytest.warns(UserWarning, match="no checklists"):
        assert as_rows(inspect.inspect_names(names, reg, backbones=[])) == as_rows(bare)
    assert inspect.inspect_names(names.limit(0), reg).count() == 0


def test_cover_by_masks_equals_the_greedy_rule():
    r = random.Random(3)
    for _ in range(200):
        bits = [f"R{k}" for k in range(r.randint(1, 6))]
        lists = [[b for b in bits if r.random() < 0.4] for _ in range(r.randint(0, 30))]
        masks = {}
        for x in lists:
            m = sum(1 << bits.index(b) for b in x)
            masks[m] = masks.get(m, 0) + 1
        limits = inspect.Limits()
        left, chosen, covered = lists, [], 0
        target = math.ceil(len(lists) * limits.coverage)
        while len(lists) >= limits.min_batch and covered < target and len(chosen) <= limits.max_continents:
            n = {b: sum(b in x for x in left) for b in bits}
            best = min((b for b in bits if n[b]), key=lambda b: (-n[b], b), default=None)
            if best is None:
                break
            chosen.append(best)
            covered += n[best]
            left = [x for x in left if best not in x]
        assert inspect.cover(masks, bits) == (chosen if 0 < len(chosen) <= limits.max_continents else [])


def test_cover_of_polygons_equals_ray_casting(spark):
    """Random outlines with holes, two of them over the date line; edges are met from boundary cells alone."""
    r = random.Random(2)
    wrap = lambda ring: [[(x + 180) % 360 - 180, y] for x, y in ring]
    feats = []
    for k in range(8):
        cx, cy, n = (178.0, 10.0, 9) if k == 1 else (-179.0, -40.0, 12) if k == 5 else (r.uniform(-150, 150), r.uniform(-70, 70), r.randint(5, 30))
        turn = [2 * math.pi * i / n for i in range(n)]
        ring = [[cx + r.uniform(6, 25) * math.cos(t), max(-89.0, min(89.0, cy + r.uniform(4, 15) * math.sin(t)))] for t in turn]
        hole = [[cx + 2 * math.cos(t), cy + 1.5 * math.sin(t)] for t in turn[:: max(1, n // 4)]]
        feats.append((k, f"F{k}", [[wrap(ring), wrap(hole)]]))
    f = spark.createDataFrame(feats, "feature_idx int, code string, polys array<array<array<array<double>>>>")
    pts = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(3000)] + [(3000 + k, 178.5 + 3 * k % 3, 10.0) for k in range(3)] + [(4000, None, 1.0)]

    def inside(ring, x, y):
        odd = False
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                odd = not odd
        return odd

    def code(x, y):
        for _, c, [rings] in feats:
            if any(abs(a[0] - b[0]) > 180 for g in rings for a, b in zip(g, [*g[1:], g[0]], strict=True)):
                rings = [[[a + 360 if a < 0 else a, b] for a, b in g] for g in rings]
            if x is not None and any(inside(rings[0], e, y) and not any(inside(h, e, y) for h in rings[1:]) for e in ([x] if x >= 0 else [x, x + 360])):
                return c
        return None

    got = {p.point_id: p.code for p in region.locate_points(spark.createDataFrame(pts, "point_id int, lon double, lat double"), f).collect()}
    want = {i: code(x, y) for i, x, y in pts}
    assert got == want and {"F1", "F5"} <= set(want.values())
    cells, boundary, _ = region.polygon_cover(f)
    assert cells.filter("level < 2").count() > 0 and boundary.count() > 0
    assert cells.filter("level = 2").join(boundary, ["feature_idx", "cx", "cy"]).count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.1, 0.15, 0.25])
def test_letters_lose_no_pair(spark, threshold):
    r = random.Random(1)
    word = lambda: "ab" + "".join(r.choice("abcdeistqz") for _ in range(r.randint(0, 10)))
    a = sorted({word() for _ in range(120)})
    b = sorted({word() for _ in range(150)} | {x[:-1] + "x" for x in a[:40]} | set(a[:10]))
    q, n = spark.createDataFrame([(x,) for x in a], "q string"), spark.createDataFrame([(x,) for x in b], "n string")
    rows = letter_pairs(q, "q", n, "n", F.substring("q", 1, 2), F.substring("n", 1, 2), threshold).collect()
    met = {(x.q, x.n) for x in rows}
    pairs = [(x, y) for x in a for y in b]
    near = {p for p, s in zip(pairs, jw_many([x for x, _ in pairs], [y for _, y in pairs]), strict=True) if 1 - s <= threshold}
    assert near <= met and len(met) == len(rows)
    if threshold < 0.2:
        assert len(met) < 0.8 * len(pairs)


def test_staged_tables_go_with_their_scope(spark):
    with staging_scope(spark):
        inner = staged(spark.range(3).toDF("id"), "kept")
        path = inner.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert inner.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
    assert staged(spark.range(2).toDF("id"), "kept").count() == 2  # without a scope nothing goes


def test_provenance_of_trait_values(spark):
    names = spark.createDataFrame([("Aus bus",), ("Cus dus",), ("Eus fus",)], "accepted_name string")
    diaz = spark.createDataFrame([("Aus bus", 1.0), ("Cus dus aggr.", 2.0)], "canonical_name string, plant_height_m double")
    bien = spark.createDataFrame([("Cus dus", 4.0)], "canonical_name string, plant_height_m double")
    wide = traits.add_trait(names, "plant_height", {"diaz_traits": diaz, "bien": bien}, provenance=True)
    got = {r.accepted_name: (r.plant_height_diaz_inherited, r.plant_height_bien_inherited) for r in wide.collect()}
    assert got == {"Aus bus": (False, None), "Cus dus": (True, False), "Eus fus": (None, None)}
    for combine, want in (("first", {"Aus bus": False, "Cus dus": True, "Eus fus": None}), ("mean", {"Aus bus": False, "Cus dus": True, "Eus fus": None})):
        one = traits.add_trait(names, "plant_height", {"diaz_traits": diaz, "bien": bien}, mode="coalesce", combine=combine, provenance=True)
        assert {r.accepted_name: r.plant_height_inherited for r in one.collect()} == want
    assert traits.add_trait(names, "plant_height", {}, mode="coalesce", provenance=True).first().plant_height_inherited is None
