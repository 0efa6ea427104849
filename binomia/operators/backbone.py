"""Reference checklists: accepted names, match keys, and the key index that queries join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.functions.text import normalize_epithets
from binomia.operators.pick import SCORES, epithet_score, scores
from binomia.sources.staging import staged

#: Rounds of following synonyms; each round doubles the reach.
CHASE_ROUNDS = 10
#: Rows of a file of candidates at most: a checklist in one file is read by several tasks after that.
ROWS_PER_FILE = 100_000
#: Columns of every checklist; further ones are kept.
COLUMNS = ("taxon_id", "canonical_name", "taxon_rank", "taxonomic_status", "accepted_name_usage_id", "family", "genus", "specific_epithet", "authorship")
ACCEPTED = ("accepted_name", "accepted_family", "accepted_genus", "accepted_taxon_id", "accepted_authorship")
#: What a match carries.
PAYLOAD = ("taxon_id", "matched_name", "rank", "accepted_name", "accepted_id", "family", "genus", "epithet", "authorship", "accepted_authorship", "is_synonym")


def embed_accepted(bb: DataFrame) -> DataFrame:
    """Adds the accepted taxon of every row and ``is_synonym``.

    A status that contains SYNONYM makes a synonym. Its target is followed while it is a
    synonym itself, in rounds that take each target's current target; a missing target
    leaves the row its own. Only ids travel through the rounds; names join once at the end.
    Of several rows of one id the least (by name, status and target) stands for the taxon;
    rows without id are kept and accept themselves. Tables of ids pack so well that Spark
    would take one of millions for small enough to broadcast: they are sorted.
    """
    authorship = (F.col("authorship") if "authorship" in bb.columns else F.lit(None)).cast("string").alias("authorship")
    own = ["canonical_name", "taxonomic_status", "accepted_name_usage_id", "family", "genus"]
    taxa = bb.filter("taxon_id is not null").groupBy("taxon_id").agg(F.min(F.struct(*own, authorship)).alias("t")).select("taxon_id", "t.*")
    syn = F.coalesce(F.col("taxonomic_status").contains("SYNONYM"), F.lit(False))
    ids = taxa.select("taxon_id", F.when(syn, F.col("accepted_name_usage_id")).alias("want"), syn.alias("syn"))
    known = ids.select(F.col("taxon_id").alias("want"), F.lit(True).alias("there"))
    at = ids.join(known.hint("merge"), "want", "left").select("taxon_id", "syn", F.when(F.col("there"), F.col("want")).otherwise(F.col("taxon_id")).alias("acc"))
    for _ in range(CHASE_ROUNDS):
        hop = at.filter("syn").select(F.col("taxon_id").alias("acc"), F.col("acc").alias("next"))
        moved = at.join(hop.hint("merge"), "acc", "left")
        moves = F.col("syn") & F.col("next").isNotNull() & (F.col("acc") != F.col("taxon_id"))
        step = moved.select("taxon_id", "syn", F.when(moves, F.col("next")).otherwise(F.col("acc")).alias("acc"), (moves & (F.col("next") != F.col("acc"))).alias("moved"))
        step = staged(step, "chase")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    target = taxa.select(
        F.col("taxon_id").alias("accepted_taxon_id"),
        F.col("canonical_name").alias("accepted_name"),
        F.col("family").alias("accepted_family"),
        F.col("genus").alias("accepted_genus"),
        F.col("authorship").alias("accepted_authorship"),
    )
    link = at.select("taxon_id", F.col("acc").alias("accepted_taxon_id"))
    out = bb.join(link.hint("merge"), "taxon_id", "left").join(target.hint("merge"), "accepted_taxon_id", "left").withColumn("is_synonym", syn)
    self_ = {a: F.when(F.col("taxon_id").isNull(), F.col(c) if c in bb.columns else None).otherwise(F.col(a)) for a, c in zip(ACCEPTED, ("canonical_name", "family", "genus", "taxon_id", "authorship"), strict=True)}
    return out.withColumns(self_).select(*bb.columns, *ACCEPTED, "is_synonym")


def precompute_keys(bb: DataFrame) -> DataFrame:
    """Adds ``key_ci, key_normalized, key_species, fuzzy_block``."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    prefix = F.when(has("specific_epithet"), F.lower(F.substring("specific_epithet", 1, 2))).otherwise(F.lit(""))
    return bb.withColumns(
        {
            "key_ci": F.lower("canonical_name"),
            "key_normalized": normalize_epithets(F.col("canonical_name")),
            "key_species": F.when(has("genus") & has("specific_epithet"), F.concat_ws(" ", "genus", "specific_epithet")),
            "fuzzy_block": F.concat(F.lower("genus"), F.lit(":"), prefix),
        }
    )


def build_backbone(bb: DataFrame, arranged: bool = True) -> DataFrame:
    """A checklist with keys and accepted names, sorted by genus and name in ranges, which split a large genus.

    Not ``arranged`` it is left as it comes: ranges are found by going through all rows once
    more, which an index that is made of them at once doesn't need.
    """
    missing = [c for c in COLUMNS if c not in bb.columns]
    bb = bb.withColumns({c: F.lit(None).cast("string") for c in missing})
    out = precompute_keys(embed_accepted(bb))
    return out.repartitionByRange("genus", "canonical_name").sortWithinPartitions("genus", "canonical_name") if arranged else out


def candidates(built: DataFrame) -> DataFrame:
    """Backbone rows as scored match candidates."""
    c = built.select(
        "taxon_id",
        F.col("canonical_name").alias("matched_name"),
        F.lower("taxon_rank").alias("rank"),
        "accepted_name",
        F.col("accepted_taxon_id").alias("accepted_id"),
        F.col("accepted_family").alias("family"),
        F.col("accepted_genus").alias("genus"),
        F.col("specific_epithet").alias("epithet"),
        "authorship",
        "accepted_authorship",
        "is_synonym",
        F.col("genus").alias("own_genus"),
        "key_ci",
        "key_normalized",
        *scores(
            F.col("taxonomic_status"),
            F.col("taxon_rank"),
            F.col("nomenclaturalStatus") if "nomenclaturalStatus" in built.columns else None,
            F.col("canonical_name"),
            F.col("accepted_name"),
        ).values(),
    )
    return c.toDF(*c.columns[:-4], *SCORES)


def keyed(c: DataFrame) -> DataFrame:
    """Candidates under each of their keys: ``kind, key``, scores, ``best``, ``acc``."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(v).alias("key")) for k, v in (("name", "matched_name"), ("ci", "key_ci"), ("norm", "key_normalized"))])
    rows = c.select("*", F.explode(keys).alias("k")).select("k.*", *SCORES, F.struct(*PAYLOAD, "own_genus").alias("best"), F.col("accepted_id").alias("acc"))
    return rows.filter(F.col("key").isNotNull())


def index_rows(rows: DataFrame) -> DataFrame:
    """The best of the candidates of each key."""
    tiers = rows.groupBy("kind", "key", *SCORES).agg(F.min("best").alias("best"), F.array_sort(F.collect_set("acc")).alias("ids"))
    top = tiers.groupBy("kind", "key").agg(F.min(F.struct(F.struct(*SCORES).alias("tier"), "best", "ids")).alias("t"))
    return top.select("kind", "key", "t.tier", "t.best", "t.ids")


def key_index(built: DataFrame) -> DataFrame:
    """Best candidate per key: ``kind, key, tier, best, ids``, one row for each key.

    Kinds: ``name`` (as written), ``ci`` (lower case), ``norm`` (orthographic). ``ids`` are
    the taxa that candidates of the best tier accept. Scores depend on the checklist alone,
    so the pick is made here once and a query looks up one row per key.

    Taxa are gone through once, by name as written; epithets are compared once per pair of
    names. The other keys follow from a name: the best tier of a key is that of one of its
    names, so they pool rows of names, not taxa.
    """
    pair = ["matched_name", "accepted_name"]
    c = candidates(built).filter(F.col("matched_name").isNotNull()).drop("key_ci", "key_normalized", "epithet_score")
    c = staged(c, "candidates", ROWS_PER_FILE)
    pairs = c.select(*pair).distinct()
    pairs = staged(pairs.select(*pair, epithet_score(*map(F.col, pair)).alias("epithet_score")), "pairs")
    c = c.join(pairs, pair, "left").withColumn("epithet_score", F.coalesce("epithet_score", F.lit(1)))
    rows = c.select(F.lit("name").alias("kind"), F.col("matched_name").alias("key"), *SCORES, F.struct(*PAYLOAD, "own_genus").alias("best"), F.col("accepted_id").alias("acc"))
    named = staged(index_rows(rows), "named")
    other = F.array(F.struct(F.lit("ci").alias("kind"), F.lower("key").alias("key")), F.struct(F.lit("norm").alias("kind"), normalize_epithets(F.col("key")).alias("key")))
    more = named.select(F.explode(other).alias("k"), "tier", "best", "ids").select("k.*", "tier", "best", "ids")
    pooled = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    tiers = more.groupBy("kind", "key", "tier").agg(F.min("best").alias("best"), pooled.alias("ids"))
    top = tiers.groupBy("kind", "key").agg(F.min(F.struct("tier", "best", "ids")).alias("t"))
    return named.unionByName(top.select("kind", "key", "t.tier", "t.best", "t.ids"))
