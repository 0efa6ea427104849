"""New versions of a checklist as changes of the old one, and a key index kept up by them.

A delta names the taxa that were added, changed or dropped. What follows from it is small, too:
rows whose chain of synonyms runs through a changed taxon, and the keys of those rows before
and after. Only these are worked out again; everything else is taken over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.operators.backbone import ACCEPTED, COLUMNS, candidates, embed_accepted, index_rows, keyed, precompute_keys
from binomia.sources.staging import staged

OPS = ("insert", "update", "delete")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, by name, nulls apart from empty strings."""
    cells = [F.concat(F.lit(c), F.lit("="), F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n"))) for c in sorted(df.columns)]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def diff_versions(old: DataFrame, new: DataFrame, key: str = "taxon_id") -> DataFrame:
    """Rows ``op, <columns of new>``: what turns ``old`` into ``new``.

    Both have the same columns and one row per key; rows without key take no part (they can't
    be addressed). Rows of a ``delete`` hold the key only. One shuffle of both sides by key.
    """
    if set(old.columns) != set(new.columns):
        raise ValueError(f"different columns: {sorted(set(old.columns) ^ set(new.columns))}")
    was = old.filter(F.col(key).isNotNull()).select(F.col(key).alias("__was"), row_hash(old).alias("__old"))
    now = new.filter(F.col(key).isNotNull()).withColumn("__new", row_hash(new))
    both = now.join(was, F.col(key) == F.col("__was"), "full")
    op = F.when(F.col("__was").isNull(), "insert").when(F.col(key).isNull(), "delete").when(F.col("__old") != F.col("__new"), "update")
    both = both.withColumn("op", op).filter("op is not null")
    return both.select("op", *[F.coalesce(key, "__was").alias(key) if c == key else F.col(c) for c in new.columns])


def apply_delta(old: DataFrame, delta: DataFrame, key: str = "taxon_id") -> DataFrame:
    """``old`` with the changes of :func:`diff_versions`. Changes of the same key twice are an error of their maker; all are applied."""
    rest = old.join(delta.select(key), key, "left_anti")
    return rest.select(old.columns).unionByName(delta.filter("op <> 'delete'").select(old.columns))


def chain_upward(bb: DataFrame, ids: DataFrame, rounds: int = 1000) -> DataFrame:
    """``taxon_id`` of ``ids`` and of all rows that reach them by following synonyms."""
    up = bb.filter(F.col("taxonomic_status").contains("SYNONYM") & F.col("accepted_name_usage_id").isNotNull())
    return _closure(up.select(F.col("accepted_name_usage_id").alias("from"), F.col("taxon_id").alias("to")), ids, rounds)


def chain_downward(bb: DataFrame, ids: DataFrame, rounds: int = 1000) -> DataFrame:
    """``taxon_id`` of ``ids`` and of all rows that they reach by following synonyms."""
    down = bb.filter(F.col("taxonomic_status").contains("SYNONYM") & F.col("accepted_name_usage_id").isNotNull())
    return _closure(down.select(F.col("taxon_id").alias("from"), F.col("accepted_name_usage_id").alias("to")), ids, rounds)


def _closure(steps: DataFrame, ids: DataFrame, rounds: int) -> DataFrame:
    """Ids reachable over ``steps`` (from, to): each round follows the newest ids only."""
    seen = staged(ids.select("taxon_id").filter("taxon_id is not null").distinct(), "reach")
    edge = seen
    for _ in range(rounds):
        more = steps.join(edge, F.col("from") == F.col("taxon_id"), "left_semi").select(F.col("to").alias("taxon_id")).distinct()
        edge = staged(more.join(seen, "taxon_id", "left_anti"), "reach")
        if edge.isEmpty():
            return seen
        seen = staged(seen.union(edge), "reach")
    raise RuntimeError(f"synonyms chain over more than {rounds} rows")


def patch_built(built: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A built checklist (:func:`binomia.operators.backbone.build_backbone`) brought up to date, and the ids that were touched.

    Touched are changed taxa and rows whose chain of synonyms ran or runs through one. They
    get their accepted taxon from the part of the new checklist that their chains reach.
    """
    raw = [c for c in built.columns if c not in (*ACCEPTED, "is_synonym", "key_ci", "key_normalized", "key_species", "fuzzy_block")]
    delta = staged(delta, "delta")
    old = built.select(raw)
    full = delta.withColumns({c: F.lit(None).cast("string") for c in COLUMNS if c not in delta.columns})
    new = staged(apply_delta(old, full.select("op", *raw)), "checklist")
    changed = delta.select("taxon_id")
    touched = staged(chain_upward(old, changed).union(chain_upward(new, changed)).distinct(), "touched")
    reached = chain_downward(new, touched)
    part = new.join(reached, "taxon_id", "left_semi")
    again = precompute_keys(embed_accepted(part)).join(touched, "taxon_id", "left_semi").select(built.columns)
    kept = built.filter("taxon_id is null").unionByName(built.join(touched, "taxon_id", "left_anti").filter("taxon_id is not null").select(built.columns))
    return staged(kept.unionByName(again), "patched"), touched


def patch_index(index: DataFrame, built: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A key index and its built checklist brought up to date by a delta, equal to ones built afresh.

    Keys of touched rows, before and after, are picked again from all candidates that have
    them; the other keys stay as they are. The index is read once and not shuffled against
    itself: touched keys meet it in one join, whose small side Spark may broadcast.
    """
    new, touched = patch_built(built, delta)
    rows = lambda b: keyed(candidates(b.join(touched, "taxon_id", "left_semi").select(b.columns))).select("kind", "key")
    keys = staged(rows(built).union(rows(new)).distinct(), "touched_keys")
    again = index_rows(keyed(candidates(new)).join(keys, ["kind", "key"], "left_semi"))
    return index.join(keys, ["kind", "key"], "left_anti").unionByName(again), new
