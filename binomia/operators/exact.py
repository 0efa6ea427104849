"""Exact cascade: all keys of a name meet the key index in one join, the first pass wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions.text import first_two, normalize_epithets, word_count
from binomia.operators.backbone import PAYLOAD
from binomia.sources.staging import staged

NAME_KEYS = ("cleaned", "agg_key", "genus_only", "hybrid_name")


def name_key() -> Column:
    """What decides a match of a cleaned name, as one string."""
    return F.concat_ws("\u0001", "cleaned", F.coalesce("agg_key", F.lit("")), F.col("genus_only").cast("string"), F.coalesce("hybrid_name", F.lit("")))


#: Kind, pass number and match type of the nine lookups of a cleaned name, in cascade order.
PASSES = (
    ("name", 0, "exact"), ("name", 1, "exact"), ("name", 2, "exact"), ("name", 3, "exact"), ("ci", 4, "exact_ci"),
    ("norm", 5, "exact_ci"), ("norm", 5, "exact_ci"), ("norm", 5, "exact_ci"), ("name", 6, "exact"),
)


def slots() -> Column:
    """The keys of :data:`PASSES` of a cleaned name; null where a lookup doesn't apply."""
    cleaned, hybrid, one = F.col("cleaned"), F.col("hybrid_name"), F.col("genus_only")
    long = word_count(cleaned) >= 3
    return F.array(
        F.col("agg_key"),
        F.when(one, cleaned),
        F.when(~one, hybrid),
        F.when(~one, cleaned),
        F.when(~one, F.lower(cleaned)),
        normalize_epithets(cleaned),
        normalize_epithets(hybrid),
        F.when(long, normalize_epithets(first_two(cleaned))),
        F.when(long, first_two(cleaned)),
    )


def pass_keys() -> Column:
    """Pass number, kind, key and match type of every lookup of a cleaned name, in cascade order."""
    kinds = F.array(*[F.struct(F.lit(n).alias("pass"), F.lit(kind).alias("kind"), F.lit(t).alias("match_type")) for kind, n, t in PASSES])
    keyed = F.zip_with(kinds, slots(), lambda p, k: F.struct(p["pass"].alias("pass"), p["kind"].alias("kind"), k.alias("key"), p["match_type"].alias("match_type")))
    return F.filter(keyed, lambda x: x["key"].isNotNull())


def lean(index: DataFrame) -> DataFrame:
    """The index without lists of taxa, which grow with a checklist's homonyms: the first and last of each are enough to tell whether there are several."""
    return index.select("kind", "key", "tier", "best", F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi"))


def decided(found: DataFrame, group: list[str], order: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Per group the hit (kind, key, tier, best, lo, hi of :func:`lean`) least in ``order`` and tier; hits equal in both pool their taxa.

    Hits combine map-side per tier, then tiers per group: no group's candidates are gathered.
    The pooled taxa stay in the index: ``refs`` are the keys of an ambiguous hit, from which
    :func:`with_targets` lists them.
    """
    keys = [*group, *order, "tier"]
    tiers = found.groupBy(*keys).agg(F.min(F.struct("best", *carry)).alias("__b"), F.collect_set(F.struct("kind", "key")).alias("__refs"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    lead = tiers.groupBy(*group).agg(F.min(F.struct(*order, "tier", "__b", "__refs", "__lo", "__hi")).alias("__first"))
    many = F.coalesce(F.col("__first.__lo") < F.col("__first.__hi"), F.lit(False))
    return lead.select(
        *group,
        *[F.col("__first")[c].alias(c) for c in order],
        *[F.col("__first")["__b"][c].alias(c) for c in carry],
        *[F.col("__first")["__b"]["best"][c].alias(c) for c in PAYLOAD],
        many.alias("is_ambiguous"),
        F.when(many, F.array_sort("__first.__refs")).alias("refs"),
    )


def with_targets(hits: DataFrame, index: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``ambiguous_targets`` in place of ``refs``: the taxa of an ambiguous hit, listed once for all hits of the same keys.

    ``within`` are further columns that both share. ``hits`` are used twice: stage them before.
    """
    sets = hits.filter("refs is not null").select(*within, "refs").distinct()
    taxa = sets.select(*within, "refs", F.explode("refs").alias("r")).select(*within, "refs", "r.*").join(index.select(*within, "kind", "key", "ids"), [*within, "kind", "key"])
    pooled = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    texts = taxa.groupBy(*within, "refs").agg(F.array_join(pooled, "|").alias("ambiguous_targets"))
    return hits.join(texts, [*within, "refs"], "left").drop("refs")


def lookup_exact(names: DataFrame, index: DataFrame) -> DataFrame:
    """:func:`match_exact` with ``refs`` instead of ``ambiguous_targets``.

    Each name sends at most nine keys into one equi-join; the index side is never broadcast
    by hint, so Spark chooses by measured size.
    """
    distinct = names.select(*NAME_KEYS).filter(F.col("cleaned").isNotNull()).distinct()
    looked = distinct.select(name_key().alias("nk"), F.explode(pass_keys()).alias("k")).select("nk", "k.*")
    return decided(looked.join(lean(index), ["kind", "key"]), ["nk"], ["pass", "match_type"]).drop("pass")


def match_exact(names: DataFrame, index: DataFrame) -> DataFrame:
    """Matches of distinct cleaned names: :data:`NAME_KEYS` -> payload, ``match_type``, ambiguity.

    ``names`` needs :data:`NAME_KEYS`; names without a match are left out.
    """
    return with_targets(staged(lookup_exact(names, index), "exact"), index)
