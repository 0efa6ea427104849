"""Registered queries: each operator on inputs derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.functions.text import is_aggregate_name, normalize_aggregate_name, normalize_epithets
from binomia.operators import add_data, backbone, delta, doors, enrich, fuzzy, inspect, pick, region, register, report, reshape, scope, traits
from binomia.operators.clean import CLEAN_COLUMNS, attach_agg_key, clean_names, clean_rows, hybrid_parents, qualifier_match, strip_qualifiers
from binomia.operators.exact import lookup_exact, match_exact, name_key
from binomia.operators.spread import repeated, spread
from binomia.plans import inputs
from binomia.plans.inputs import table
from binomia.plans.resolve import Backend, Options, Result, of_rows, resolve
from binomia.sources.catalog import Catalog, Source
from binomia.sources.files import Files
from binomia.sources.io import export, read_table
from binomia.sources.staging import staged, staging_path
from binomia.streaming.stateful import answered_share, closest_changes, free_matches, monitor_rates, net_changes, rates, rocksdb
from binomia.streaming.stream import each_batch, resolve_batch, session_tally, window_tally

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Rows of a file of names at most: tasks that read them are even.
ROWS_PER_FILE = 250_000


def query(f: Query) -> Query:
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, inputs.NAMES)


def listed(s: SparkSession, d: str) -> DataFrame:
    """The names in files: for queries that go through them several times."""
    return staged(names(s, d), "listed", ROWS_PER_FILE)


def built(s: SparkSession, d: str, where: str = "true") -> DataFrame:
    return backbone.build_backbone(table(s, d, inputs.BACKBONE).filter(where))


def index(s: SparkSession, d: str, where: str = "true") -> DataFrame:
    return staged(backbone.key_index(backbone.build_backbone(table(s, d, inputs.BACKBONE).filter(where), arranged=False)), "key_index")


def accepted(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, inputs.BACKBONE).select(F.col("canonical_name").alias("accepted_name")).distinct()


def cleaned(s: SparkSession, d: str) -> DataFrame:
    """Distinct names, cleaned, with the key of what decides their match."""
    return cleaned_once(names(s, d))


def cleaned_once(rows: DataFrame) -> DataFrame:
    once = rows.select("input_name").filter("input_name is not null").distinct()
    return staged(attach_agg_key(clean_names(once)).withColumn("nk", name_key()), "clean")


def matched(s: SparkSession, d: str) -> DataFrame:
    """Names with their keys and exact matches, all rows; each distinct name is cleaned and matched once."""
    n = cleaned(s, d)
    return names(s, d).join(n.join(match_exact(n, index(s, d)), "nk", "left"), "input_name", "left")


@query
def q_clean_names(s, d):
    return clean_rows(names(s, d)).select("row_idx", "input_name", *CLEAN_COLUMNS)


@query
def q_clean_marked(s, d):
    return clean_names(table(s, d, inputs.MARKED)).select("row_idx", "input_name", *CLEAN_COLUMNS)


@query
def q_normalize_epithets(s, d):
    return table(s, d, inputs.WHOLE_TEXTS).select("row_idx", normalize_epithets(F.col("input_name")).alias("key"))


@query
def q_normalize_epithets_all(s, d):
    """Keys of every name of the lines, and of every whole text."""
    rows = [table(s, d, q).select(F.lit(k).alias("source"), "row_idx", "input_name") for k, q in (("name", inputs.NAMES), ("text", inputs.WHOLE_TEXTS))]
    return rows[0].unionByName(rows[1]).select("source", "row_idx", normalize_epithets(F.col("input_name")).alias("key"))


@query
def q_normalize_aggregate(s, d):
    n = F.col("input_name")
    return table(s, d, inputs.MARKED).select("row_idx", normalize_aggregate_name(n, F.col("taxon_rank")).alias("name"), is_aggregate_name(n).alias("marked"))


@query
def q_hybrid_parents(s, d):
    return hybrid_parents(table(s, d, inputs.MARKED), "input_name").select("row_idx", "hybrid_type", "parent_1", "parent_2")


@query
def q_precompute_keys(s, d):
    return backbone.precompute_keys(table(s, d, inputs.BACKBONE)).select("taxon_id", "key_ci", "key_normalized", "key_species", "fuzzy_block")


@query
def q_embed_accepted(s, d):
    return backbone.embed_accepted(table(s, d, inputs.BACKBONE)).select("taxon_id", "accepted_taxon_id", "accepted_name", "accepted_family", "accepted_genus", "accepted_authorship", "is_synonym")


@query
def q_pick_best(s, d):
    c = backbone.candidates(built(s, d)).withColumnRenamed("matched_name", "canonical_name")
    out = pick.pick_best(c, ["canonical_name"], "taxon_id", "accepted_id", ["taxon_id", "accepted_name", "accepted_id", "is_synonym"])
    return out.select("canonical_name", "taxon_id", "accepted_name", "accepted_id", "is_synonym", "is_ambiguous", "ambiguous_targets")


@query
def q_exact_cascade(s, d):
    rows = listed(s, d)
    n = cleaned_once(rows)
    columns = ["match_type", "taxon_id", "matched_name", "accepted_name", "accepted_id", "is_synonym", "is_ambiguous", "ambiguous_targets"]
    hits = staged(n.select("input_name", "nk").join(match_exact(n, index(s, d)), "nk").select("input_name", *columns), "hits")
    return spread(rows, hits, ["input_name"], "ambiguous_targets").select("row_idx", *columns)


def _pairs(s, d, method: str, threshold: float, block: str = "genus") -> DataFrame:
    """Distances of names without exact match to checklist names of their block."""
    ix = index(s, d)
    n = staged(cleaned(s, d).select("nk", "cleaned", "agg_key", "genus_only", "hybrid_name", "genus_abbrev").distinct(), "names")
    open_ = n.filter("cleaned is not null and not genus_abbrev").join(lookup_exact(n, ix).select("nk"), "nk", "left_anti").select("cleaned").distinct()
    known = ix.filter("kind = 'name'").select(F.col("key").alias("name"), F.col("best.own_genus").alias("g"))
    left, right = (F.substring_index("cleaned", " ", 1), F.col("g")) if block == "genus" else (F.lower(F.substring("cleaned", 1, 2)), F.lower(F.substring("name", 1, 2)))
    pairs = fuzzy.block_pairs(open_, "cleaned", known, "name", left, right, method, threshold)
    return fuzzy.distances(pairs, "cleaned", "name", method, threshold).select("cleaned", "name", F.round("fuzzy_dist", 6).alias("fuzzy_dist"))


@query
def q_fuzzy_levenshtein(s, d):
    return _pairs(s, d, "levenshtein", 0.2)


@query
def q_fuzzy_dl(s, d):
    return _pairs(s, d, "dl", 0.2)


@query
def q_fuzzy_dl_prefix(s, d):
    return _pairs(s, d, "dl", 0.2, "prefix")


@query
def q_fuzzy_edits(s, d):
    return _pairs(s, d, "dl", 2)


@query
def q_fuzzy_jaro_winkler(s, d):
    return _pairs(s, d, "jw", 0.1)


@query
def q_fuzzy_dedup(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("row_idx")).agg(((F.min("l_linenumber") - 1).cast("double") / 8).alias("fuzzy_dist"))
    rows = rows.withColumn("taxon_id", F.concat(F.lit("p"), (F.col("row_idx") % 17).cast("string")))
    return pick.dedup_fuzzy_targets(rows).select("row_idx", "taxon_id", "fuzzy_dist")


@query
def q_abbreviated_genus(s, d):
    n = cleaned(s, d).select("cleaned", "genus_abbrev").distinct()
    out = fuzzy.match_abbreviated(n.filter("genus_abbrev"), fuzzy.spelled_genera(n), index(s, d))
    return out.select("cleaned", "taxon_id", "matched_name", "accepted_name", "accepted_id", "is_synonym", "is_ambiguous", "ambiguous_targets")


def _register(s, d) -> DataFrame:
    g = table(s, d, inputs.BACKBONE).select("genus").distinct()
    kg = F.element_at(F.array(*map(F.lit, ("plantae", "animalia", "fungi"))), F.ascii("genus") % 3 + 1)
    extra = s.createDataFrame([("Zyzzyx", "fungi")], "genus string, kingdom_group string")
    return g.select("genus", kg.alias("kingdom_group")).union(extra).withColumns({"taxon_group": F.concat(F.lit("tg-"), "kingdom_group"), "life_form": F.concat(F.lit("lf-"), "kingdom_group")})


@query
def q_resolve_chain(s, d):
    """Two checklists in order, fuzzy and abbreviated matches, scope and classes."""
    reg = staged(_register(s, d), "register")
    cover = register.build_coverage({"wfo": table(s, d, inputs.BACKBONE), "col": table(s, d, inputs.BACKBONE)})
    chain = [Backend("wfo", index(s, d, "k % 2 = 0")), Backend("col", index(s, d, "k % 2 = 1"))]
    return resolve(listed(s, d), chain, Options(), reg, cover).df


@query
def q_enrich_species(s, d):
    out = enrich.enrich(accepted(s, d), table(s, d, inputs.TRAIT_TABLE), {"growth_form": "growth_form", "seed_mass_mg": "seed_mass_mg"}, order="src_ord", inherited="inherited")
    return out.withColumn("seed_mass_mg", F.round("seed_mass_mg", 2))


@query
def q_enrich_genus(s, d):
    bb = table(s, d, inputs.BACKBONE)
    given = F.col("k") % 5 == 1  # rows without a family come last in the file
    lead = bb.select("genus", F.when(given, F.col("family")).alias("lead_family"), F.struct((~given).alias("late"), "k").alias("src_ord"))
    return enrich.enrich(bb.select("taxon_id", "genus"), lead, {"lead_family": "lead_family"}, by="genus", order="src_ord")


@query
def q_enrich_grouped(s, d):
    return enrich.enrich_grouped(accepted(s, d), table(s, d, inputs.GROUP_TABLE), "country_code", ["invasive_status"], ["AT", "DE", "XX"], order="src_ord")


@query
def q_unpivot_long(s, d):
    wide = enrich.enrich_grouped(accepted(s, d), table(s, d, inputs.GROUP_TABLE), "country_code", ["invasive_status"], order="src_ord")
    return reshape.to_long(wide, ["invasive_status"], "country_code", drop_na=True)


@query
def q_info_door(s, d):
    bb = table(s, d, inputs.BACKBONE)
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), F.format_string("p%09d", "l_partkey").alias("taxon_id"), F.when(F.col("l_orderkey") % 2 == 0, "wfo").otherwise("col").alias("backend"))
    return enrich.info_door(rows, bb, "wfo", {"wfo_status": "nomenclaturalStatus"}).select("row_idx", "wfo_status")


def _trait_tables(s, d) -> dict[str, DataFrame]:
    p = s.read.parquet(f"{d}/part.parquet").withColumn("canonical_name", F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30)))
    bien = p.groupBy("canonical_name").agg(F.min(F.when(F.col("p_partkey") % 3 == 1, F.col("p_size") * 2.0)).alias("plant_height_m"))
    brot = p.groupBy("canonical_name").agg(F.max(F.when(F.col("p_partkey") % 11 == 1, F.col("p_size") + 0.0)).alias("height_m"))
    diaz = table(s, d, inputs.TRAIT_TABLE).groupBy("canonical_name").agg(F.min_by("plant_height_m", "src_ord").alias("plant_height_m"))
    return {"diaz_traits": diaz, "bien": bien, "brot": brot}


def _trait(s, d, **how) -> DataFrame:
    return traits.add_trait(accepted(s, d), "plant_height", _trait_tables(s, d), **how)


@query
def q_trait_wide(s, d):
    return _trait(s, d)


@query
def q_trait_provenance(s, d):
    """Which values come from the aggregate of a species, by source and after they are combined."""
    wide = _trait(s, d, provenance=True)
    out = traits.add_trait(wide, "plant_height", _trait_tables(s, d), mode="coalesce", provenance=True)
    return out.select("accepted_name", "plant_height_diaz_inherited", "plant_height_bien_inherited", F.col("plant_height_inherited").alias("inherited"))


@query
def q_region_union(s, d):
    """Ranges in the union of a named region and the regions of all customers' points, as polygons and names give them."""
    points, features = _points(s, d)
    near = points.filter("lon between 0 and 60")
    geography = region.Geography(table(s, d, inputs.RANGES), table(s, d, inputs.REGIONS), features)
    return region.range_sets(region.ranges_of(geography, ["Asia"], near.select("lon", "lat")))


@query
def q_trait_median(s, d):
    return _trait(s, d, mode="coalesce")


@query
def q_trait_mean(s, d):
    return _trait(s, d, mode="coalesce", combine="mean").withColumn("plant_height", F.round("plant_height", 6))


@query
def q_trait_first(s, d):
    return _trait(s, d, mode="coalesce", combine="first")


@query
def q_trait_vote(s, d):
    p = s.read.parquet(f"{d}/part.parquet").withColumn("canonical_name", F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30)))
    g = p.groupBy("canonical_name").agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"), F.min("p_partkey").alias("c"))
    gift = g.select("canonical_name", F.when(F.col("a") % 3 == 0, "Tree").when(F.col("a") % 3 == 1, "shrubs").otherwise("?").alias("gift_growth_form_1"))
    aus = g.select("canonical_name", F.when(F.col("b") % 2 == 0, "shrub tall").otherwise("forb").alias("plant_growth_form"))
    bien = g.select("canonical_name", F.when(F.col("c") % 2 == 0, "HERB").otherwise("mallee").alias("growth_form"))
    return traits.add_trait(accepted(s, d), "growth_form", {"gift": gift, "austraits": aus, "bien": bien}, mode="coalesce", combine="vote")


@query
def q_range_sets(s, d):
    return region.range_sets(region.Ranges(table(s, d, inputs.RANGES), ("N1", "N2", "N3"), "native"))


@query
def q_region_filter(s, d):
    rows = table(s, d, "select l_orderkey as row_idx, upper(substr(p_name, 1, 1))||substr(p_name, 2) as accepted_name from {lineitem} join {part} on l_partkey = p_partkey")
    return region.region_filter(rows, "row_idx", "accepted_name", region.Ranges(table(s, d, inputs.RANGES), ("N1", "N2", "N3"))).select("row_idx", "accepted_name")


@query
def q_region_tokens(s, d):
    return region.named_codes(table(s, d, inputs.REGIONS), ["Éurope", "Nation_7", "n3", "L2-1", "nowhere"])


@query
def q_range_continents(s, d):
    out = inspect.continents(table(s, d, inputs.RANGES), table(s, d, inputs.REGIONS))
    return out.select("accepted_name", F.array_join(F.array_sort("continents"), ",").alias("continents"))


def _points(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A point per customer, and an octagon with a hole per nation."""
    p = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 53 % 1800 / 10.0 - 90).alias("lat"))
    n = s.read.parquet(f"{d}/nation.parquet")
    x, y = F.col("n_nationkey") % 5 * 60 - 170.05, F.floor(F.col("n_nationkey") / 5) * 30 - 80.05
    at = lambda dx, dy: F.array((x + dx).cast("double"), (y + dy).cast("double"))
    outline = F.array(at(7.5, 0), at(62.5, 0), at(70, 7.5), at(70, 27.5), at(62.5, 35), at(7.5, 35), at(0, 27.5), at(0, 7.5))
    hole = F.array(at(20, 10), at(30, 10), at(30, 20), at(20, 20))
    f = n.select(F.col("n_nationkey").alias("feature_idx"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.array(F.array(outline, hole)).alias("polys"))
    return p, f


@query
def q_points_in_polygons(s, d):
    return region.locate_points(*_points(s, d))


@query
def q_points_in_files(s, d):
    """The same with the polygons through a file of GeoJSON lines."""
    points, features = _points(s, d)
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polys").alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("code").alias("LEVEL3_COD")).alias("properties"), shape.alias("geometry")))
    path = staging_path(s, "features") + ".geojsonl"
    features.sort("feature_idx").coalesce(1).select(line.alias("value")).write.text(path)
    return region.locate_points(points, read_table(s, path))


@query
def q_register_resolve(s, d):
    part = {b: table(s, d, inputs.GENERA, m=3, r=k) for k, b in enumerate(("worms", "col", "wfo"))}
    out = register.resolve_classification(part)
    return out.withColumn("kingdom", register.normalize_kingdom(F.col("kingdom"))).select("genus", "kingdom", "phylum", "class", "family")


@query
def q_kingdom_majority(s, d):
    return register.majority(s.read.parquet(f"{d}/customer.parquet"), "c_nationkey", "c_mktsegment", "top_segment")


@query
def q_kingdom_walk(s, d):
    taxa = staged(table(s, d, inputs.TAXA), "taxa")
    return register.kingdom_walk(taxa, taxa.filter("taxon_rank = 'GENUS'").select(F.col("canonical_name").alias("genus")))


@query
def q_coverage(s, d):
    bb = table(s, d, inputs.BACKBONE)
    return register.build_coverage({"wfo": bb.filter("k % 2 = 0"), "col": bb.filter("k % 2 = 1")}).select("genus", "backend")


@query
def q_near_duplicates(s, d):
    return inspect.near_duplicates(table(s, d, "select case when c_custkey % 10 = 0 then n_name||'x' when c_custkey % 10 = 1 then substr(n_name, 1, 2)||substr(n_name, 4) else n_name end as input_name from {customer} join {nation} on c_nationkey = n_nationkey"))


@query
def q_outlier_groups(s, d):
    rows = table(s, d, "select case when c_custkey % 40 = 0 then 'fungi' when c_custkey % 30 = 1 then 'animalia' else 'plantae' end as kingdom_group from {customer}")
    return inspect.dominant_group(rows, "kingdom_group")


def _inspected(s, d, min_tier: str = "note") -> DataFrame:
    """Anomalies of all names: distinct names are matched and inspected with their numbers, and repeated as often at the end."""
    counted = names(s, d).filter("input_name is not null").groupBy("input_name").agg(F.count(F.lit(1)).alias("n"))
    once = staged(attach_agg_key(clean_names(counted)).withColumn("nk", name_key()), "clean")
    r = once.join(match_exact(once, index(s, d)), "nk", "left").withColumn("match_type", F.coalesce("match_type", F.lit("none")))
    r = r.withColumns({"backend": F.lit("wfo"), "fuzzy_dist": F.lit(None).cast("double")})
    found = inspect.inspect(r, _register(s, d), table(s, d, inputs.RANGES), table(s, d, inputs.REGIONS), min_tier=min_tier, weight="n")
    found = staged(found, "found")
    return spread(repeated(once.join(found, "input_name", "left_semi"), "input_name", "n"), found, ["input_name"], "reason")


@query
def q_inspect_report(s, d):
    """Anomalies of all names, resolved without fuzzy matching."""
    return _inspected(s, d)


@query
def q_inspect_review(s, d):
    """The same without notes."""
    return _inspected(s, d, "review")


@query
def q_match_tally(s, d):
    r = matched(s, d)
    return report.match_tally(r.withColumn("match_type", F.coalesce("match_type", F.when(F.col("input_name").isNotNull(), "none"))))


@query
def q_qualifiers(s, d):
    n = F.col("input_name")
    found, place = qualifier_match(n)
    return table(s, d, inputs.MARKED).select("row_idx", found.alias("qualifier"), place.cast("long").alias("place"), strip_qualifiers(n).alias("stripped"))


@query
def q_extract_genera(s, d):
    return register.extract_genera(table(s, d, inputs.BACKBONE), "reptiledb").select("genus", "family")


@query
def q_genus_coverage(s, d):
    bb = table(s, d, inputs.BACKBONE)
    known = lambda where: bb.withColumn("genus", F.when(F.expr(where), F.col("genus")))
    cover = register.build_coverage({"wfo": known("k % 2 = 0"), "col": known("k % 7 = 1")})
    return scope.genus_coverage(cover, known("k % 3 = 1")).select("genus", "backend")


@query
def q_family_kingdom(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    reg = c.select(F.col("c_name").alias("genus"), F.col("c_nationkey").cast("string").alias("family"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("kingdom"))
    return register.infer_kingdom_from_family(reg)


@query
def q_profile_flags(s, d):
    bb = table(s, d, inputs.BACKBONE)
    known = F.when(F.col("k") % 2 == 0, "TRUE").otherwise("false")
    profile = bb.select(F.col("taxon_id").alias("taxonID"), F.when(F.col("k") % 3 == 1, known).alias("isExtinct"))
    return enrich.flags(bb.select("taxon_id"), profile, {"is_extinct": "isExtinct"})


def _listed(s, d) -> DataFrame:
    """A result-like list: customers as names, match types and groups by key."""
    kind = F.element_at(F.array(*map(F.lit, ("exact", "none", "out_of_scope", "fuzzy"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    group = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("input_name"), kind.alias("match_type"), group.alias("taxon_group"), F.when(F.col("c_custkey") % 4 != 1, F.col("c_name")).alias("matched_name"))


@query
def q_scope_tally(s, d):
    return report.scope_tally(_listed(s, d), "wfo")


@query
def q_taxon_tally(s, d):
    return report.taxon_tally(_listed(s, d))


@query
def q_provenance(s, d):
    return enrich.provenance(_listed(s, d), ["taxon_group"])


@query
def q_coordinates(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 400 - 200).cast("double").alias("lon"), (F.col("c_custkey") % 190 - 95).cast("double").alias("lat"))
    return region.valid_coordinates(c)


@query
def q_data_conflicts(s, d):
    return add_data.conflicts(s.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_name", "key"), "key", ["p_size"])


@query
def q_window_tally(s, d):
    return window_tally(s.read.parquet(f"{d}/events.parquet"), "ts", "event_type")


@query
def q_session_tally(s, d):
    return session_tally(s.read.parquet(f"{d}/events.parquet"), "ts", "user_id")


def _resolved_stream(s, d) -> DataFrame:
    """All names as a stream, resolved batch by batch into a folder per batch: a batch's distinct names are cleaned and matched once."""
    feed = staged(names(s, d), "feed")
    stream = s.readStream.schema(feed.schema).parquet(feed.inputFiles()[0].rpartition("/")[0])
    ix, path = index(s, d), staging_path(s, "batches")
    step = lambda df: resolve_batch(df, ix).select("row_idx", "match_type", "taxon_id")
    writer = each_batch(stream, step, lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/{epoch}"))
    writer.option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("row_idx long, match_type string, taxon_id string").option("recursiveFileLookup", True).parquet(path)


@query
def q_stream_resolve(s, d):
    """Every name, nulls included, as a stream against the static key index, batch by batch."""
    return _resolved_stream(s, d)


@query
def q_stream_resolve_all(s, d):
    """Every name, nulls included, as a stream against the static key index, into files."""
    return _resolved_stream(s, d)


@query
def q_stream_chain(s, d):
    """The whole chain on every micro-batch of a stream: spelled-out genera, one query per target and scope within the batch."""
    feed = listed(s, d)
    stream = s.readStream.schema(feed.schema).parquet(feed.inputFiles()[0].rpartition("/")[0])
    reg = staged(_register(s, d), "register")
    cover = staged(register.build_coverage({"wfo": table(s, d, inputs.BACKBONE), "col": table(s, d, inputs.BACKBONE)}), "coverage")
    chain = [Backend("wfo", index(s, d, "k % 2 = 0")), Backend("col", index(s, d, "k % 2 = 1"))]
    path, made = staging_path(s, "chain"), []

    def write(df: DataFrame, epoch: int) -> None:
        """A batch's rows and the results of its distinct names: lists of taxa are stored once per name, not per row."""
        found = resolve(df, chain, Options(), reg, cover).by_name
        for part, what in (("rows", df.select("row_idx", "input_name")), ("names", found)):
            what.write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("overwrite").parquet(f"{path}/{part}/batch={epoch}")
        made.append(found.schema)

    writer = each_batch(stream, lambda df: df, write)
    writer.option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    rows, found = (s.read.schema(schema.add("batch", "long")).parquet(f"{path}/{part}") for part, schema in (("rows", feed.select("row_idx", "input_name").schema), ("names", made[0])))
    return of_rows(rows, found, ("batch",))


@query
def q_door_defaults(s, d):
    """A door's default columns of those that its table has."""
    p = s.read.parquet(f"{d}/part.parquet").withColumn("canonical_name", F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30)))
    gift = p.groupBy("canonical_name").agg(F.min("p_type").alias("gift_woodiness_1"), F.max("p_size").cast("double").alias("gift_plant_height_max"), F.min("p_brand").alias("gift_something_else"))
    return doors.open_door(accepted(s, d), "gift", {"gift": gift})


@query
def q_long_logged(s, d):
    """A grouped door on a logged result, unpivoted by its log alone."""
    done = doors.logged_door(Result(accepted(s, d), {}), "griis", {"griis": table(s, d, inputs.GROUP_TABLE)})
    return reshape.long_of(done, drop_na=True)


@query
def q_stream_window_tally(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    feed = staged(events.withColumn("ts", F.col("ts").cast("timestamp")), "events")
    stream = s.readStream.schema(feed.schema).parquet(feed.inputFiles()[0].rpartition("/")[0])
    tally, path = window_tally(stream, "ts", "event_type"), staging_path(s, "windows")
    writer = tally.writeStream.outputMode("complete").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/{epoch:09d}"))
    writer.option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(tally.schema).parquet(f"{path}/{Files(s).names(path)[-1]}")  # the last batch holds all windows


@query
def q_fuzzy_pick(s, d):
    """Picks and ambiguity of fuzzy matches by genus, the closest query per target."""
    ix, n = index(s, d), cleaned(s, d)
    open_ = n.filter("cleaned is not null and not genus_abbrev").join(lookup_exact(n, ix).select("nk"), "nk", "left_anti")
    first = names(s, d).filter("input_name is not null").groupBy("input_name").agg(F.min("row_idx").alias("row_idx"))
    out = fuzzy.match_fuzzy(open_.join(first, "input_name").select("cleaned", "row_idx"), ix)
    return out.select("cleaned", "taxon_id", "matched_name", "accepted_name", "accepted_id", "is_synonym", F.round("fuzzy_dist", 6).alias("fuzzy_dist"), "is_ambiguous", "ambiguous_targets")


@query
def q_region_candidates(s, d):
    """Fuzzy pairs that stay when names outside a region give way to others inside."""
    ix = index(s, d)
    pairs = _pairs(s, d, "dl", 0.2, "prefix").join(ix.filter("kind = 'name'").select(F.col("key").alias("name"), "best"), "name")
    return region.filter_candidates(pairs, region.Ranges(table(s, d, inputs.RANGES), ("N1", "N2", "N3"), "introduced")).select("cleaned", "name", "fuzzy_dist")


@query
def q_range_introduced(s, d):
    return region.range_sets(region.Ranges(table(s, d, inputs.RANGES), ("N1", "N6", "N11"), "introduced"))


@query
def q_region_search(s, d):
    return region.search_regions(table(s, d, inputs.REGIONS), "asiÁ").select("code", "name", "level1_name")


@query
def q_register_lookup(s, d):
    """Classes of all rows by genus, accepted or written."""
    r = matched(s, d).withColumn("match_type", F.coalesce("match_type", F.when(F.col("input_name").isNotNull(), "none")))
    return scope.with_register(r, _register(s, d)).select("row_idx", *scope.CLASSES)


@query
def q_out_of_scope(s, d):
    """Open names of registered genera that no checklist covers."""
    n, known = cleaned(s, d), staged(_register(s, d), "register")
    left = n.join(lookup_exact(n, index(s, d)).select("nk"), "nk", "left_anti")
    cover = register.build_coverage({"wfo": table(s, d, inputs.BACKBONE)})
    return scope.out_of_scope(left, known, cover, ["wfo"]).select("input_name")


@query
def q_life_form(s, d):
    part = {b: table(s, d, inputs.GENERA, m=3, r=k) for k, b in enumerate(("worms", "col", "wfo"))}
    reg = register.resolve_classification(part).withColumn("kingdom", register.normalize_kingdom(F.col("kingdom")))
    return register.assign_life_form(reg, table(s, d, inputs.FAMILIES)).select("genus", "family", "kingdom_group", "taxon_group", "life_form")


@query
def q_register_build(s, d):
    """The register from three checklists and the table of families, end to end."""
    part = {b: table(s, d, inputs.GENERA, m=3, r=k) for k, b in enumerate(("worms", "col", "wfo"))}
    return register.build_register(part, table(s, d, inputs.FAMILIES)).select("genus", "kingdom", "family", "kingdom_group", "taxon_group", "life_form")


@query
def q_doors(s, d):
    """Three doors of the registry, one after the other: by name with a prefix, by genus, by group."""
    t = table(s, d, inputs.TRAIT_TABLE)
    genus = table(s, d, inputs.BACKBONE).groupBy("genus").agg(F.min("family").alias("habit"))
    tables = {"avonet": t.select("canonical_name", "src_ord", F.col("seed_mass_mg").alias("body_mass_g"), F.col("growth_form").alias("trophic_niche")), "fungalroot": genus, "griis": table(s, d, inputs.GROUP_TABLE)}
    out = accepted(s, d).withColumn("genus", F.substring_index("accepted_name", " ", 1))
    for name, how in (("avonet", {}), ("fungalroot", {}), ("griis", {"groups": ["AT", "FR"]})):
        out = doors.open_door(out, name, tables, **how)
    return out.withColumn("avonet_body_mass_g", F.round("avonet_body_mass_g", 2))


@query
def q_trait_min(s, d):
    return _trait(s, d, mode="coalesce", combine="min")


@query
def q_trait_max(s, d):
    return _trait(s, d, mode="coalesce", combine="max", priority=["brot", "bien"])


@query
def q_trait_units(s, d):
    """Sources in grams and milligrams brought together."""
    t = table(s, d, inputs.TRAIT_TABLE).filter("canonical_name is not null")
    t = t.groupBy(F.replace("canonical_name", F.lit(" agg."), F.lit("")).alias("canonical_name")).agg(F.min("seed_mass_mg").alias("mg"), F.max("seed_mass_mg").alias("most"))
    tables = {"diaz_traits": t.select("canonical_name", F.col("mg").alias("seed_mass_mg")), "gift": t.select("canonical_name", (F.col("most") / 1000).cast("string").alias("gift_seed_mass_mean"))}
    out = traits.add_trait(accepted(s, d), "seed_mass", tables)
    return out.select("accepted_name", F.round("seed_mass_diaz", 3).alias("diaz"), F.round("seed_mass_gift", 3).alias("gift"))


def _targets(s, d) -> DataFrame:
    """Picked taxa of all checklist names as a result has them, one row per accepted taxon."""
    best = index(s, d).filter("kind = 'name'").select("best.*")
    return best.groupBy("accepted_id").agg(F.min("accepted_name").alias("accepted_name"), F.min("family").alias("family"))


@query
def q_add_data(s, d):
    """A user's table joined by accepted taxon; its family column clashes and is kept apart."""
    be = Backend("wfo", index(s, d), prefix_fallback=False)
    return add_data.add_data(_targets(s, d), staged(table(s, d, inputs.OWN_DATA), "own"), [be], "species", ["size", "family"], options=Options(fuzzy=False))


@query
def q_add_data_grouped(s, d):
    be = Backend("wfo", index(s, d), prefix_fallback=False)
    return add_data.add_data(accepted(s, d), staged(table(s, d, inputs.OWN_GROUPS), "own"), [be], "species", ["top_size"], "country", options=Options(fuzzy=False))


@query
def q_text_files(s, d):
    """Nations through CSV and TSV files and back."""
    n, at = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), staging_path(s, "files")
    for k in ("csv", "tsv"):
        export(n, f"{at}/{k}.{k}")
    back = [read_table(s, f"{at}/{k}.{k}").select(F.lit(k).alias("file"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name") for k in ("csv", "tsv")]
    return back[0].union(back[1])


@query
def q_spreadsheets(s, d):
    """Every part through spreadsheets, one a task, and back; sheet, header and column of names are found, not told."""
    p, at = s.read.parquet(f"{d}/part.parquet"), staging_path(s, "sheets") + ".xlsx"
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30))
    export(p.select("p_partkey", "p_retailprice", name.alias("species"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size")).repartition(3, "p_partkey"), at)
    data, column = add_data.read_data(s, at, [Backend("wfo", index(s, d), prefix_fallback=False)])
    return data.select("p_partkey", F.round("p_retailprice", 2).alias("price"), F.col(column).alias("name"), F.col("size").cast("long").alias("size"))


@query
def q_catalog(s, d):
    """Two versions of a table in the catalogue, read back by pin and as the newest (10 after 9)."""
    c = Catalog(s, staging_path(s, "catalog"))
    p = s.read.parquet(f"{d}/part.parquet")
    c.install("backbone", "parts", p.select("p_partkey", "p_name"), "9")
    c.install("backbone", "parts", p.select("p_partkey", F.lower("p_type").alias("p_name")), "10")
    old, new = c.table("backbone", "parts", "9"), c.table("backbone", "parts")
    return old.select(F.lit("9").alias("version"), "*").union(new.select(F.lit(c.meta("backbone", "parts")["version"]).alias("version"), "*"))


@query
def q_enrichment_ladder(s, d):
    """One column per rung: a newer version, one that stays pinned, fetched, built, in memory, none."""
    p = s.read.parquet(f"{d}/part.parquet").withColumn("canonical_name", F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30)))
    t = p.groupBy("canonical_name").agg(F.min("p_size").cast("double").alias("least"), F.max("p_size").cast("double").alias("most"))
    of = lambda c: t.select("canonical_name", c.alias("v"))
    least, most = F.col("least"), F.col("most")
    c = Catalog(s, staging_path(s, "catalog"))
    c.install("enrichment", "newest", of(least), "9")
    c.install("enrichment", "pinned", of(least), "9")

    def fails() -> str:
        raise OSError("no network")

    sources = {
        "newest": Source(lambda: "10", lambda v: of(most)),
        "pinned": Source(fails),
        "fetched": Source(lambda: "1.2", lambda v: of(most + 1)),
        "built": Source(fails, build=lambda: of(least + 1)),
        "in_memory": Source(fails, in_memory=lambda: of(most + least)),
        "missing": Source(),
    }
    out = accepted(s, d)
    for name, source in sources.items():
        out = enrich.enrich(out, c.ensure("enrichment", name, source), {name: "v"}, types={name: "double"})
    return out


@query
def q_delta_versions(s, d):
    """What turns the checklist before into the present one."""
    return delta.diff_versions(table(s, d, inputs.BACKBONE_BEFORE), table(s, d, inputs.BACKBONE)).select("op", "taxon_id", "canonical_name", "taxonomic_status")


@query
def q_delta_index(s, d):
    """The key index of the checklist before, brought up to date by the delta alone."""
    before = staged(backbone.build_backbone(table(s, d, inputs.BACKBONE_BEFORE)), "before")
    changes = delta.diff_versions(table(s, d, inputs.BACKBONE_BEFORE), table(s, d, inputs.BACKBONE))
    ix, _ = delta.patch_index(staged(backbone.key_index(before), "key_index"), before, changes)
    own = [F.col("best")[c].alias(c) for c in ("taxon_id", "matched_name", "accepted_name", "accepted_id", "is_synonym")]
    many = F.size("ids") >= 2
    return ix.select("kind", "key", *own, many.alias("is_ambiguous"), F.when(many, F.array_join("ids", "|")).alias("ambiguous_targets"))


#: Files that a batch of a fed stream comes in, at most: as many tasks write and read it.
FILES = 12


def _fed(s: SparkSession, df: DataFrame, name: str, batches: int, order: str) -> DataFrame:
    """A stream of a table in about as many batches, rows by ``order``: a batch's files are written after those before it, for streams read the oldest first."""
    feed, parts = staging_path(s, name), staging_path(s, f"{name}-parts")
    rows = df.repartitionByRange(batches * FILES, order)
    rows.withColumn("__part", F.floor(F.spark_partition_id() / FILES).cast("int")).write.partitionBy("__part").parquet(parts)
    there = Files(s).names(parts)
    for k in range(batches):
        part = s.read.schema(df.schema).parquet(f"{parts}/__part={k}") if f"__part={k}" in there else None
        if part is not None:
            part.repartition(FILES).write.mode("append").parquet(feed)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(feed)


@query
def q_stream_fuzzy_dedup(s, d):
    """The closest match per target over all batches of a stream, by state per target and corrections."""
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("row_idx")).agg(((F.min("l_linenumber") - 1).cast("double") / 8).alias("fuzzy_dist"))
    rows = rows.withColumn("taxon_id", F.concat(F.lit("p"), (F.col("row_idx") % 17).cast("string")))
    stream, path = _fed(s, rows, "matches", 4, "row_idx"), staging_path(s, "changes")
    with rocksdb(s):
        out = closest_changes(stream).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-log")
        out.trigger(availableNow=True).start().awaitTermination()
    changes = s.read.schema("taxon_id string, row_idx long, fuzzy_dist double, change int").parquet(path)
    return net_changes(changes).unionByName(free_matches(rows)).select("row_idx", "taxon_id", "fuzzy_dist")


@query
def q_stream_match_rates(s, d):
    """Share of events whose name was resolved within an hour, per window, from two streams; later answers correct earlier windows."""
    events = table(s, d, inputs.EVENT_NAMES).withColumn("ts", F.col("ts").cast("timestamp"))
    answer = F.col("ts") + F.make_dt_interval(mins=(F.col("row_idx") % 90).cast("int"))
    sent = events.filter("row_idx % 7 <> 0").select("row_idx", "input_name", answer.alias("answered_at"))
    asked, answers = _fed(s, events.select("row_idx", "ts"), "asked", 3, "ts"), _fed(s, sent, "answers", 3, "answered_at")
    ix, path = index(s, d), staging_path(s, "rates")
    hits = lambda once: resolve_batch(once, ix).select("input_name", F.col("match_type").isin(*inspect.MATCHED).alias("hit"))
    with rocksdb(s):  # an hour's questions and answers needn't fit the memory
        writer = monitor_rates(answered_share(asked, answers, "row_idx", "ts", "answered_at", "1 hour", "2 days"), path, hits=hits)
        writer.option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return rates(s.read.parquet(path)).select("window_start", "n", "n_matched", "rate")


@query
def q_inspect_names(s, d):
    """Anomalies of all names as written, without matching."""
    return inspect.inspect_names(names(s, d), _register(s, d))


@query
def q_kingdom_patterns(s, d):
    """Kingdoms of genera that only the form of a name or family tells."""
    c, k = s.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey") % 5
    genus = F.when(k == 0, F.concat("c_name", F.lit("Virus"))).when(k == 1, F.concat(F.lit("Candidatus "), "c_name")).otherwise(F.col("c_name"))
    family = F.when(k == 2, "Xviridae").when(k == 3, "Alphasatellitidae").otherwise("Fabaceae")
    return c.select("c_custkey", genus.alias("genus"), family.alias("family")).select("c_custkey", register.kingdom_by_pattern().alias("kingdom"))
