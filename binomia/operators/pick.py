"""Best candidate per group: five scores, tiers, ambiguity, and one query per fuzzy target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions.text import normalize_epithets, second_token

#: Score of a null status or rank: after both others.
_LAST = 9


def epithet_score(matched: Column, accepted: Column) -> Column:
    """0 where both names have the same epithet but for spelling."""
    one, two = second_token(normalize_epithets(matched)), second_token(normalize_epithets(accepted))
    return F.when(F.coalesce(one == two, F.lit(False)), 0).otherwise(1)


def scores(
    status: Column, rank: Column, nomenclatural: Column | None = None, matched: Column | None = None, accepted: Column | None = None
) -> dict[str, Column]:
    """0 is best: accepted status, species rank, valid name, epithet kept by the accepted name."""
    def of(c: Column, best: str) -> Column:
        return F.when(F.upper(c) == best, 0).when(c.isNull(), _LAST).otherwise(1)

    valid = F.lit(0) if nomenclatural is None else F.when(F.coalesce(nomenclatural == "Valid", F.lit(False)), 0).otherwise(1)
    kept = epithet_score(matched, accepted) if matched is not None and accepted is not None else F.lit(0)
    return {"status_score": of(status, "ACCEPTED"), "rank_score": of(rank, "SPECIES"), "valid_score": valid, "epithet_score": kept}


SCORES = ("status_score", "rank_score", "valid_score", "epithet_score")


def tier() -> Column:
    return F.struct(*SCORES)


def pick_best(df: DataFrame, group: list[str], taxon_id: str, accepted_id: str, payload: list[str]) -> DataFrame:
    """One row per group of scored candidates, with ``is_ambiguous`` and ``ambiguous_targets``.

    The least (scores, taxon id) wins; the pick is ambiguous if candidates of its
    tier accept different taxa. Aggregates combine map-side; no group is sorted.
    """
    rest = [c for c in payload if c != taxon_id]
    order = F.struct(*SCORES, taxon_id, *rest)
    tiers = df.groupBy(*group, *SCORES).agg(F.min(order).alias("b"), F.collect_set(accepted_id).alias("ids"))
    best = tiers.groupBy(*group).agg(F.min(F.struct("b", "ids")).alias("w"))
    ids = F.array_sort(F.col("w.ids"))
    many = F.size(ids) >= 2
    return best.select(*group, "w.b.*", many.alias("is_ambiguous"), F.when(many, F.array_join(ids, "|")).alias("ambiguous_targets"))


def dedup_fuzzy_targets(df: DataFrame, taxon_id: str = "taxon_id", distance: str = "fuzzy_dist", order: str = "row_idx") -> DataFrame:
    """Of the fuzzy matches of one target the closest stays (ties: lowest ``order``, which is unique).

    Distance 0 and null ids stay. The closest per target combines map-side and joins back,
    so a popular target is no task of its own.
    """
    place = F.struct(F.col(distance).isNull().alias("none"), F.col(distance).alias("d"), F.col(order).alias("o"))
    lead = df.filter(F.col(taxon_id).isNotNull()).groupBy(F.col(taxon_id).alias("__t")).agg(F.min(place).alias("__lead"))
    free = F.col(taxon_id).isNull() | F.col(distance).isNull() | (F.col(distance) == 0)
    out = df.join(lead, F.col(taxon_id) == F.col("__t"), "left")
    return out.filter(free | (place == F.col("__lead"))).select(df.columns)
