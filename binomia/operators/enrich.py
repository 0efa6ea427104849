"""Enrichment: attribute tables joined to resolved names by species, genus, group or taxon id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions.text import canon_agg_marker, strip_agg_marker


#: Groups that a pivot may have: each is a set of columns.
MAX_GROUPS = 2000


def _first_per_key(table: DataFrame, key: list[str], cols: list[str], order: str | None) -> DataFrame:
    """The first row per key: lowest ``order`` column, or the least row where there is none."""
    body = F.struct(*([order] if order else []), *cols)
    out = table.groupBy(*key).agg(F.min(body).alias("__r"))
    return out.select(*key, *[F.col("__r")[c].alias(c) for c in cols])


def _key_column(table: DataFrame, by: str) -> str:
    for c in (["genus"] if by == "genus" else []) + ["canonical_name", "accepted_name"]:
        if c in table.columns:
            return c
    raise ValueError(f"the table has no column to join {by} on")


def select_columns(columns: dict[str, str], cols: list[str] | str | None, default: list[str] | None = None, prefix: str | None = None) -> dict[str, str]:
    """Output columns to attach: the default ones, ``"all"``, or names with or without prefix."""
    if cols == "all" or (cols is None and default is None):
        return columns
    wanted = default if cols is None else [cols] if isinstance(cols, str) else cols
    out = {}
    for w in wanted:
        name = w if w in columns else f"{prefix or ''}{w}"
        if name not in columns:
            raise ValueError(f"no column {w!r}; there are {', '.join(columns)}")
        out[name] = columns[name]
    return out


def enrich(
    result: DataFrame,
    table: DataFrame | None,
    columns: dict[str, str],
    by: str = "accepted_name",
    types: dict[str, str] | None = None,
    order: str | None = None,
    inherited: str | None = None,
) -> DataFrame:
    """Left join of ``columns`` (output name -> source column) on ``by``: a name or ``genus``.

    Sources that the table lacks give nulls of the declared type, and so does a missing table. Names join aggregate-aware:
    an aggregate reaches its own row, a species inherits the row of its aggregate if it has
    none, never the other way. ``inherited`` names a column that tells which. Each table key
    keeps one row, so the join adds no rows.
    """
    types = types or {}
    there = {o: s for o, s in columns.items() if table is not None and s in table.columns}
    blank = {o: F.lit(None).cast(types.get(o, "string")) for o in columns if o not in there}
    result = result.drop(*columns)
    if there:
        key = _key_column(table, by)
        aware = by == "accepted_name"
        keyed = table.withColumn("__k", canon_agg_marker(F.col(key)) if aware else F.col(key)).filter("__k is not null")
        keyed = keyed.select("__k", *([order] if order else []), *[F.col(s).cast(types[o]).alias(o) if o in types else F.col(s).alias(o) for o, s in there.items()])
        rows = _first_per_key(keyed, ["__k"], list(there), order).withColumn("__hit", F.lit(True))
        if not aware:
            result = result.join(rows.withColumnRenamed("__k", by).drop("__hit"), by, "left")
        else:
            name = canon_agg_marker(F.col(by))
            group = name.endswith(" aggr.")
            if "qualifier" in result.columns:
                group = group | F.coalesce(F.col("qualifier").isin("agg.", "s.l."), F.lit(False))
            base = F.concat(strip_agg_marker(F.col(by)), F.lit(" aggr."))
            keys = F.when(group, F.array(base)).otherwise(F.array(name, base))
            # both keys of a name in one join: the table is read and shuffled once
            asked = result.select(by, *([c for c in ["qualifier"] if c in result.columns])).distinct().filter(F.col(by).isNotNull())
            hits = asked.select(*asked.columns, F.posexplode(keys).alias("__p", "__k")).join(rows, "__k")
            best = hits.groupBy(*asked.columns).agg(F.min(F.struct("__p", *there)).alias("__b"))
            flag = [(F.col("__b.__p") == 1).alias(inherited)] if inherited else []
            own = [f"__j{k}" for k in range(len(asked.columns))]
            best = best.select(*[F.col(c).alias(j) for c, j in zip(asked.columns, own, strict=True)], *[F.col("__b")[o].alias(o) for o in there], *flag)
            on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(j)) for c, j in zip(asked.columns, own, strict=True)])
            result = result.join(best, on, "left").drop(*own)
    return result.withColumns(blank) if blank else result


def enrich_grouped(
    result: DataFrame,
    table: DataFrame,
    group: str,
    values: list[str],
    groups: list[str] | str = "all",
    by: str = "accepted_name",
    order: str | None = None,
    listed: list[str] | None = None,
) -> DataFrame:
    """Pivot of ``values`` by ``group`` joined on names: one column per group and value.

    One group keeps the plain names, several get ``<value>_<group>``; asked groups that the
    table lacks are null columns. ``"all"`` takes ``listed`` groups, else those of the table.
    """
    if groups == "all":
        groups = listed or [r[0] for r in table.select(group).filter(F.col(group).isNotNull()).distinct().limit(MAX_GROUPS + 1).collect()]
        if len(groups) > MAX_GROUPS:
            raise ValueError(f"{group} has more than {MAX_GROUPS} groups: name those that become columns")
        groups = groups if listed else sorted(groups)
    groups = [groups] if isinstance(groups, str) else list(groups)
    key = _key_column(table, by)
    rows = table.filter(F.col(group).isin(groups)).select(F.col(key).alias("__k"), F.col(group).alias("__g"), *([order] if order else []), *values)
    first = _first_per_key(rows, ["__k", "__g"], values, order)
    at = lambda v, g: F.max(F.when(F.col("__g") == g, F.col(v)))
    name = lambda v, g: v if len(groups) == 1 else f"{v}_{g}"
    wide = first.groupBy("__k").agg(*[at(v, g).alias(name(v, g)) for g in groups for v in values])
    result = result.drop(*[name(v, g) for g in groups for v in values])
    return result.join(wide.withColumnRenamed("__k", by), by, "left")


def info_door(result: DataFrame, backbone: DataFrame, backend: str, columns: dict[str, str], order: str | None = None) -> DataFrame:
    """Checklist columns by taxon id, for rows that this checklist resolved."""
    there = {o: s for o, s in columns.items() if s in backbone.columns}
    rows = backbone.select(F.col("taxon_id").alias("__t"), *([order] if order else []), *[F.col(s).alias(o) for o, s in there.items()])
    rows = _first_per_key(rows.filter("__t is not null"), ["__t"], list(there), order)
    own = F.when(F.col("backend") == backend, F.col("taxon_id"))
    out = result.drop(*columns).withColumn("__t", own).join(rows, "__t", "left").drop("__t")
    return out.withColumns({o: F.lit(None).cast("string") for o in columns if o not in there})


def flags(result: DataFrame, profile: DataFrame, columns: dict[str, str], id_col: str = "taxonID") -> DataFrame:
    """Text flags (``true``/``false``) of a species profile as booleans, by taxon id."""
    is_true = {o: (F.lower(F.col(s).cast("string")) == "true").alias(o) for o, s in columns.items()}
    rows = profile.select(F.col(id_col).alias("taxon_id"), *is_true.values())
    rows = _first_per_key(rows.filter("taxon_id is not null"), ["taxon_id"], list(columns), None)
    return result.drop(*columns).join(rows, "taxon_id", "left")


def provenance(result: DataFrame, columns: list[str]) -> DataFrame:
    """``n_matched`` rows with a value in any of ``columns``, ``n_total`` rows with a match."""
    some: Column = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    return result.agg(F.count_if(some).alias("n_matched"), F.count("matched_name").alias("n_total"))
