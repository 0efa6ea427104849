"""Regions: hierarchy lookups, ranges of taxa, and points in polygons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions.text import fold_key
from binomia.sources.staging import staged

MODES = ("present", "native", "introduced")


@dataclass(frozen=True)
class Ranges:
    """Native and introduced ranges (canonical_name, tdwg_code, native_status) and the wanted codes."""

    table: DataFrame
    codes: tuple[str, ...]
    mode: str = "present"


def range_status_ok(status: Column, mode: str = "present") -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return status.isNotNull() if mode == "present" else F.coalesce(status == mode, F.lit(False))


def range_sets(r: Ranges) -> DataFrame:
    """``accepted_name, present, has_data``: is a name in the region, is it anywhere."""
    inside = F.col("tdwg_code").isin(*r.codes) & range_status_ok(F.col("native_status"), r.mode)
    return r.table.groupBy(F.col("canonical_name").alias("accepted_name")).agg(F.max(inside).alias("present"), F.lit(True).alias("has_data"))


def filter_candidates(near: DataFrame, r: Ranges) -> DataFrame:
    """Drops fuzzy candidates (cleaned, best, ..) outside the region if the same name keeps another."""
    sets = range_sets(r).select(F.col("accepted_name").alias("__a"), "present")
    out = near.withColumn("__a", F.col("best.accepted_name")).join(sets, "__a", "left")
    away = F.coalesce(~F.col("present"), F.lit(False))
    kept = out.filter(~away).select("cleaned", F.lit(True).alias("__other")).distinct()
    out = out.withColumn("__away", away).join(kept, "cleaned", "left")
    return out.filter(~F.col("__away") | F.col("__other").isNull()).drop("__a", "present", "__away", "__other")


def region_filter(df: DataFrame, group: str, name: str, r: Ranges) -> DataFrame:
    """The same soft filter for any candidate table."""
    sets = range_sets(r).select(F.col("accepted_name").alias(name), "present")
    out = df.join(sets, name, "left").withColumn("__away", F.coalesce(~F.col("present"), F.lit(False)))
    keeps = out.groupBy(group).agg(F.min("__away").alias("__all"))
    return out.join(keeps, group).filter(~F.col("__away") | F.col("__all")).drop("present", "__away", "__all")


def alias_map(regions: DataFrame) -> DataFrame:
    """``key, code``: each level-3 code under its folded code and names of all levels."""
    keys = [f"level{k}_{what}" for k in (1, 2) for what in ("code", "name")] + ["code", "name"]
    each = F.explode(F.array(*[fold_key(F.col(c)) for c in keys]))
    return regions.select(each.alias("key"), "code").filter("key <> ''").distinct()


def resolve_regions(regions: DataFrame, tokens: list[str]) -> tuple[list[str], list[str]]:
    """Level-3 codes of region names or codes of any level, and the tokens that name none."""
    spark = regions.sparkSession
    if not tokens:
        return [], []
    asked = spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("key", fold_key(F.col("token")))
    rows = asked.join(alias_map(regions), "key", "left").groupBy("token").agg(F.collect_set("code").alias("codes")).collect()
    return sorted({c for r in rows for c in r["codes"]}), sorted(r["token"] for r in rows if not r["codes"])


def named_codes(regions: DataFrame, tokens: list[str]) -> DataFrame:
    """``code`` of the regions that any of ``tokens`` names, as a table: nothing passes through the driver."""
    asked = [fold_key(F.lit(t)) for t in tokens]
    return alias_map(regions).filter(F.col("key").isin(*asked) if asked else F.lit(False)).select("code").distinct()


def search_regions(regions: DataFrame, text: str) -> DataFrame:
    """Regions whose code or names contain ``text``, accents and case aside."""
    cols = ["code", "name", "level2_code", "level2_name", "level1_code", "level1_name"]
    whole = fold_key(F.concat_ws(" ", *cols))
    return regions.filter(F.contains(whole, fold_key(F.lit(text)))).orderBy("code")


def valid_coordinates(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return points.filter(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90))


def edges(features: DataFrame) -> DataFrame:
    """Edges of polygon features (code, feature_idx, polys: array of polygons of rings of [lon, lat]).

    Columns: feature_idx, code, poly, ring, bbox, and both ends; ring 0 is the outline.
    """
    f = features.select("feature_idx", "code", F.posexplode("polys").alias("poly", "rings"))
    f = f.select("feature_idx", "code", "poly", F.posexplode("rings").alias("ring", "pts")).filter(F.size("pts") >= 3)
    at = lambda p, k: F.get(p, k)
    box = F.struct(*[fn(F.transform("pts", lambda p: at(p, k))).alias(n) for n, fn, k in (("x0", F.array_min, 0), ("x1", F.array_max, 0), ("y0", F.array_min, 1), ("y1", F.array_max, 1))])
    f = f.withColumn("box", box).select("feature_idx", "code", "poly", "ring", "box", F.posexplode("pts").alias("k", "p"), "pts")
    before = F.when(F.col("k") == 0, F.element_at("pts", -1)).otherwise(F.get("pts", F.col("k") - 1))
    return f.select("feature_idx", "code", "poly", "ring", "box", *[at(F.col("p"), k).alias(f"{n}i") for n, k in (("x", 0), ("y", 1))], *[at(before, k).alias(f"{n}j") for n, k in (("x", 0), ("y", 1))])


#: Degrees of the cells of a cover, each level a whole part of the one before, and of a band in which points meet edges.
CELLS, BAND = (8.0, 2.0, 0.5), 1.0


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def unwrapped(features: DataFrame) -> DataFrame:
    """Features whose rings cross the date line (a step of more than 180 degrees) with longitudes that go on beyond 180."""
    at = lambda p: F.get(p, 0)
    jumps = lambda ring: F.exists(F.transform(ring, lambda p, i: F.abs(at(p) - at(F.get(ring, (i + 1) % F.size(ring)))) > 180), lambda x: x)
    east = lambda ring: F.transform(ring, lambda p: F.array(F.when(at(p) < 0, at(p) + 360).otherwise(at(p)), F.get(p, 1)))
    return features.withColumn("polys", F.transform("polys", lambda poly: F.when(F.exists(poly, jumps), F.transform(poly, east)).otherwise(poly)))


def _touches(size: float) -> Column:
    """An edge (xi, yi)-(xj, yj) touches the cell (cx, cy): their boxes meet, and the cell lies on both sides of its line or on it."""
    half, slack = size / 2, 1e-9
    x, y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    near = lambda c, i, j: (c + half + slack >= F.least(i, j)) & (c - half - slack <= F.greatest(i, j))
    line = F.abs(dy * (x - F.col("xi")) - dx * (y - F.col("yi"))) <= half * (F.abs(dx) + F.abs(dy)) + slack
    return near(x, "xi", "xj") & near(y, "yi", "yj") & line


def _inside(near: DataFrame, e: DataFrame) -> DataFrame:
    """``point_id, feature_idx, code`` of the pairs (point_id, lon, lat, feature_idx) inside by even-odd ray casting.

    A ray to the east counts the crossings with the feature's edges of its latitude band, per
    ring; holes are taken out.
    """
    low, high = F.least("yi", "yj"), F.greatest("yi", "yj")
    e = e.withColumn("band", F.explode(F.sequence(_cell(low, BAND), _cell(high, BAND)))).drop("box")
    crosses = ((F.col("yi") > F.col("lat")) != (F.col("yj") > F.col("lat"))) & (
        F.col("lon") < (F.col("xj") - F.col("xi")) * (F.col("lat") - F.col("yi")) / F.when(F.col("yj") != F.col("yi"), F.col("yj") - F.col("yi")) + F.col("xi")
    )
    hit = near.withColumn("band", _cell(F.col("lat"), BAND)).join(e, ["feature_idx", "band"]).filter(crosses)
    rings = hit.groupBy("point_id", "lon", "feature_idx", "code", "poly", "ring").agg((F.count(F.lit(1)) % 2 == 1).alias("inside"))
    polys = rings.filter("inside").groupBy("point_id", "lon", "feature_idx", "code", "poly").agg(F.max(F.col("ring") == 0).alias("outer"), F.max(F.col("ring") > 0).alias("hole"))
    return polys.filter("outer and not hole").select("point_id", "feature_idx", "code").distinct()


def polygon_cover(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inside cells, boundary cells, edges) of features: ``feature_idx, code, level, cx, cy``; ``feature_idx, cx, cy``.

    From the largest cells of :data:`CELLS` down: cells that an edge touches are split, the
    others are inside as a whole if their centre is, or dropped. What touches an edge still at
    the last level is boundary. An edge is carried down by the cells that it touches, so the
    work follows the length of outlines, not the area.
    """
    f = unwrapped(features)
    e = staged(edges(f), "edges")
    box = e.groupBy("feature_idx", "code").agg(*[fn(F.least(i, j) if fn is F.min else F.greatest(i, j)).alias(n) for n, fn, i, j in (("x0", F.min, "xi", "xj"), ("x1", F.max, "xi", "xj"), ("y0", F.min, "yi", "yj"), ("y1", F.max, "yi", "yj"))])
    over = lambda df, x0, x1, y0, y1, size: df.withColumn("cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size)))).withColumn("cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))
    cells = over(box, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), CELLS[0]).select("feature_idx", "code", "cx", "cy")
    lines = over(e, F.least("xi", "xj"), F.greatest("xi", "xj"), F.least("yi", "yj"), F.greatest("yi", "yj"), CELLS[0])
    whole = []
    for level, size in enumerate(CELLS):
        if level:
            parts = round(CELLS[level - 1] / size)
            down = lambda df, parts=parts: df.withColumn("cx", F.explode(F.sequence(F.col("cx") * parts, F.col("cx") * parts + parts - 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") * parts, F.col("cy") * parts + parts - 1)))
            cells, lines = down(edge_cells), down(lines)
        lines = staged(lines.filter(_touches(size)), "lines")
        edge_cells = lines.select("feature_idx", "code", "cx", "cy").distinct()
        whole.append(cells.join(edge_cells, ["feature_idx", "cx", "cy"], "left_anti").select("feature_idx", F.lit(level).alias("level"), "cx", "cy", F.lit(size).alias("size")))
    plain = reduce(DataFrame.unionByName, whole)
    plain = plain.withColumn("point_id", F.struct("level", "cx", "cy")).withColumns({"lon": (F.col("cx") + 0.5) * F.col("size"), "lat": (F.col("cy") + 0.5) * F.col("size")})
    inside = _inside(staged(plain.select("point_id", "lon", "lat", "feature_idx"), "cells"), e)
    return staged(inside.select("feature_idx", "code", "point_id.*"), "cover"), staged(edge_cells.select("feature_idx", "cx", "cy"), "boundary"), e


def locate_points(points: DataFrame, features: DataFrame) -> DataFrame:
    """``point_id, code`` of points (point_id, lon, lat), as by even-odd ray casting with holes taken out.

    Points in an inside cell of the features' cover (:func:`polygon_cover`) are settled by
    equi-joins on cells; only points in boundary cells meet edges. Features may cross the date
    line. The first feature in order wins; points in none, or without coordinates, have a null
    code.
    """
    inside, boundary, e = polygon_cover(features)
    p = points.select("point_id", "lon", "lat").filter("lon is not null and lat is not null")
    p = p.withColumn("lon", F.explode(F.when(F.col("lon") < 0, F.array(F.col("lon"), F.col("lon") + 360)).otherwise(F.array("lon"))))
    at = F.array(*[F.struct(F.lit(k).alias("level"), _cell(F.col("lon"), size).alias("cx"), _cell(F.col("lat"), size).alias("cy")) for k, size in enumerate(CELLS)])
    sure = p.select("point_id", F.explode(at).alias("c")).select("point_id", "c.*").join(inside, ["level", "cx", "cy"]).select("point_id", "feature_idx", "code")
    near = p.withColumns({"cx": _cell(F.col("lon"), CELLS[-1]), "cy": _cell(F.col("lat"), CELLS[-1])}).join(boundary, ["cx", "cy"])
    close = _inside(near.select("point_id", "lon", "lat", "feature_idx"), e)
    found = sure.unionByName(close).groupBy("point_id").agg(F.min(F.struct("feature_idx", "code")).alias("f"))
    return points.join(found.select("point_id", F.col("f.code").alias("code")), "point_id", "left").select("point_id", "code")


@dataclass(frozen=True)
class Geography:
    """What region names and coordinates are looked up in: ranges of taxa, regions, and their polygons."""

    ranges: DataFrame
    regions: DataFrame
    features: DataFrame | None = None


def region_codes(geography: Geography, names: list[str] | str | None = None, coords: DataFrame | list[tuple[float, float]] | None = None) -> list[str]:
    """Level-3 codes that ``names`` (codes or names of any level) or points of ``coords`` (lon, lat) stand for.

    Unknown names and coordinates off the globe are errors; points at sea add nothing. The
    codes are at most as many as there are regions.
    """
    names = [names] if isinstance(names, str) else list(names or [])
    codes, unknown = resolve_regions(geography.regions, names)
    if unknown:
        raise ValueError(f"no region {', '.join(map(repr, unknown))}; see search_regions")
    if coords is not None:
        if geography.features is None:
            raise ValueError("coordinates need the regions' polygons")
        spark = geography.regions.sparkSession
        if not isinstance(coords, DataFrame):
            pairs = [coords] if len(coords) == 2 and not hasattr(coords[0], "__len__") else coords
            coords = spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "lon double, lat double")
        points = coords.select("lon", "lat").filter("lon is not null and lat is not null").distinct()
        if not points.join(valid_coordinates(points), ["lon", "lat"], "left_anti").isEmpty():
            raise ValueError("longitudes go from -180 to 180, latitudes from -90 to 90, in this order")
        points = points.withColumn("point_id", F.struct("lon", "lat"))
        codes += [r[0] for r in locate_points(points, geography.features).select("code").filter("code is not null").distinct().collect()]
    return sorted(set(codes))


def ranges_of(geography: Geography, names: list[str] | str | None = None, coords=None, mode: str = "present") -> Ranges | None:
    """The wanted ranges, or None where neither names nor coordinates ask for any."""
    codes = region_codes(geography, names, coords)
    return Ranges(geography.ranges, tuple(codes), mode) if codes else None
