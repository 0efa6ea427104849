"""Wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups_of(columns: list[str], bases: list[str]) -> list[str]:
    """Suffixes of ``<base>_<group>`` columns; the longest base claims a column."""
    out: dict[str, None] = {}
    for c in columns:
        for b in sorted(bases, key=len, reverse=True):
            if c.startswith(f"{b}_"):
                out[c[len(b) + 1 :]] = None
                break
    return list(out)


def to_long(df: DataFrame, bases: list[str], group_name: str = "group", drop_na: bool = False) -> DataFrame:
    """One row per row and group, the values of ``bases`` in columns of their names.

    Columns without suffix give one null group; missing combinations are null. The groups
    come from one array per row, so the table is read once.
    """
    groups = groups_of(df.columns, bases)
    plain = [b for b in bases if b in df.columns]
    if not groups and not plain:
        raise ValueError("no column named after a base")
    types = {b: next(t for c, t in df.dtypes if c == b or c.startswith(f"{b}_")) for b in bases if any(c == b or c.startswith(f"{b}_") for c in df.columns)}
    ids = [c for c in df.columns if c not in plain and not any(c == f"{b}_{g}" for b in bases for g in groups)]
    cell = lambda b, g: (F.col(f"{b}_{g}") if f"{b}_{g}" in df.columns else F.lit(None)).cast(types.get(b, "string")).alias(b)
    if groups:
        rows = [F.struct(F.lit(k).alias("__i"), F.lit(g).alias(group_name), *[cell(b, g) for b in bases]) for k, g in enumerate(groups)]
    else:
        rows = [F.struct(F.lit(0).alias("__i"), F.lit(None).cast("string").alias(group_name), *[F.col(b) if b in plain else F.lit(None).cast("string").alias(b) for b in bases])]
    out = df.select(*ids, F.explode(F.array(*rows)).alias("__r")).select(*ids, "__r.*").drop("__i")
    return out.filter(F.coalesce(*[F.col(b).cast("string") for b in bases]).isNotNull()) if drop_na else out


def long_of(result, bases: list[str] | None = None, group_name: str | None = None, drop_na: bool = False) -> DataFrame:
    """:func:`to_long` of a logged result: bases and the group's name come from its grouped enrichments."""
    log = result.meta.get("reshape", [])
    if (bases is None or group_name is None) and not log:
        raise ValueError("no grouped enrichment in the log: name bases and group")
    bases = bases or list(dict.fromkeys(b for e in log for b in e["bases"]))
    groups = list(dict.fromkeys(e["group"] for e in log))
    if group_name is None and len(groups) > 1:
        raise ValueError(f"several groups ({', '.join(groups)}): name one")
    return to_long(result.df, bases, group_name or groups[0], drop_na)
