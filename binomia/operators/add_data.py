"""Custom data: a user's table, its names resolved like the list's, joined to it."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.operators.enrich import enrich_grouped
from binomia.plans.resolve import Backend, Options, resolve
from binomia.sources.io import read_table
from binomia.sources.spreadsheet import detect_sheet
from binomia.sources.staging import staged

#: Rows that tell which column holds the names, and the share of them that must match.
PROBE_ROWS, PROBE_SHARE = 10, 0.5


def detect_species_column(data: DataFrame, backends: list[Backend]) -> str:
    """The text column of which most of the first rows match exactly or fuzzily."""
    head = data.limit(PROBE_ROWS).collect()
    texts = [c for c, t in data.dtypes if t == "string"]
    rows = [(k, c, r[c]) for c in texts for k, r in enumerate(head)]
    if not rows:
        raise ValueError("no text column")
    names = data.sparkSession.createDataFrame([(i, n) for i, (_, _, n) in enumerate(rows)], "row_idx long, input_name string")
    good = {r[0] for r in resolve(names, backends).df.filter("match_type in ('exact', 'fuzzy')").select("row_idx").collect()}
    share = {c: sum(i in good for i, (_, d, _) in enumerate(rows) if d == c) / max(1, len(head)) for c in texts}
    best = max(texts, key=lambda c: share[c])
    if share[best] < PROBE_SHARE:
        raise ValueError("no column of names found; name it")
    return best


def read_data(spark: SparkSession, path: str, backends: list[Backend], table: str | None = None, sheet: str | int | None = None, start_row: int | None = None) -> tuple[DataFrame, str]:
    """A user's file and its column of names. Sheet and header row of a spreadsheet are found by what matches, if they aren't given."""
    if path.lower().rstrip("/").endswith(".xlsx") and (sheet is None or start_row is None):
        def matches(names: DataFrame) -> DataFrame:
            asked = staged(names.withColumn("row_idx", F.xxhash64("input_name")), "cells")
            return resolve(asked, backends).df.filter("match_type <> 'none'")

        sheet, start_row, species = detect_sheet(spark, path, matches)
        return read_table(spark, path, sheet=sheet, start_row=start_row), species
    data = read_table(spark, path, table, sheet, start_row or 1)
    return data, detect_species_column(data, backends)


def resolved_data(data: DataFrame, species: str, backends: list[Backend], options: Options = Options()) -> DataFrame:
    """``data`` with the accepted_id and accepted_name of its names."""
    names = data.select(F.col(species).alias("input_name")).filter(F.col(species).isNotNull()).distinct()
    names = staged(names.withColumn("row_idx", F.xxhash64("input_name")), "data_names")
    found = resolve(names, backends, options).df.filter("accepted_id is not null").select(F.col("input_name").alias(species), "accepted_id", "accepted_name")
    return data.drop("accepted_id", "accepted_name").join(found, species)


def conflicts(resolved: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keys whose rows differ: ``key, n_rows, n_distinct``."""
    n = resolved.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*cols)).alias("n_distinct"))
    return n.filter("n_distinct > 1")


#: A text column with at most this share of distinct values, of this median length, looks like a group.
GROUP_SHARE, GROUP_LENGTH = 0.3, 5


def group_hint(data: DataFrame, skip: list[str]) -> str | None:
    """The first text column besides ``skip`` that looks like codes of groups."""
    texts = [c for c, t in data.dtypes if t == "string" and c not in skip]
    if not texts:
        return None
    row = data.agg(*[F.struct(F.approx_count_distinct(c).alias("d"), F.count(c).alias("n"), F.percentile_approx(F.length(c), 0.5).alias("m")).alias(c) for c in texts]).first()
    return next((c for c in texts if row[c]["n"] and row[c]["d"] / row[c]["n"] < GROUP_SHARE and row[c]["m"] <= GROUP_LENGTH), None)


def add_data(
    result: DataFrame, data: DataFrame, backends: list[Backend], species_col: str | None = None, cols: list[str] | None = None,
    group_col: str | None = None, groups: list[str] | str = "all", options: Options = Options(),
) -> DataFrame:
    """Join a user's columns by accepted taxon (with ``group_col``: pivoted, by accepted name).

    Rows of one taxon that agree count once, with a warning; rows that differ are an error
    that names some of them, and a column that looks like a group. A column that ``result``
    has already comes as ``data_<column>``, here and in the pivot: nothing is overwritten.
    """
    species = species_col or detect_species_column(data, backends)
    cols = cols or [c for c in data.columns if c not in (species, group_col)]
    found = staged(resolved_data(data, species, backends, options), "data")
    if group_col:
        wide = enrich_grouped(result.select("accepted_name").distinct(), found.drop("canonical_name"), group_col, cols, groups)
        return _joined(result, wide, "accepted_name")
    n = found.groupBy("accepted_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*cols)).alias("n_distinct"), F.min("accepted_name").alias("name"))
    n = staged(n.filter("n_rows > 1"), "repeated")
    if bad := n.filter("n_distinct > 1").orderBy("accepted_id").limit(3).collect():
        hint = group_hint(found, [species, *cols, "accepted_id", "accepted_name"])
        raise ValueError(
            f"rows of one taxon differ: {', '.join(f'{r.name!r} ({r.accepted_id})' for r in bad)}" + (f"; grouped data? try group_col={hint!r}" if hint else "")
        )
    if again := n.agg(F.sum(F.col("n_rows") - 1)).first()[0]:
        warnings.warn(f"{again} rows repeat a taxon with equal values and count once", stacklevel=2)
    rows = found.groupBy("accepted_id").agg(F.first(F.struct(*cols)).alias("__r")).select("accepted_id", "__r.*")
    return _joined(result, rows, "accepted_id")


def _joined(result: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows``; columns that both have get a prefix."""
    rows = rows.select(key, *[F.col(c).alias(f"data_{c}" if c in result.columns else c) for c in rows.columns if c != key])
    return result.join(rows, key, "left").select(*result.columns, *[c for c in rows.columns if c != key])
