"""Cleaning of name strings: qualifiers, hybrids, authorship, case; one projection."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions.text import fenced, first_token, squeeze, trim_ws, word_count

# Qualifiers by lower-case spelling without dots and blanks.
QUALIFIERS = {
    "cf": "cf.", "aff": "aff.", "agg": "agg.", "aggr": "agg.", "sl": "s.l.", "sstr": "s.str.", "sp": "sp.", "spp": "sp.",
    "species": "sp.", "sect": "sect.", "subsp": "subsp.", "var": "var.", "f": "f.", "auct": "auct.", "sensu": "sensu",
    "non": "non", "nec": "nec", "vel": "vel",
}
# Qualifiers and authors as they are written in names.
_TOKENS = ("cf", "aff", r"s\.l", r"s\.str", "sp", "spp", "species", "subsp", "var", "f", "auct", "sensu", "non", "nec", "vel", "agg", "aggr", "sect")
QUALIFIER = rf"\b({'|'.join(_TOKENS)})\.?(?=\s|$)"
LEADING = r"(?i)^(cf|aff)\b\.?\s+"
SENSU_STRICTO = r"(?i)\s*\b(sensu\s+stricto|s\.\s*str\.?)(?=\s|$)"
SENSU_LATO = r"(?i)\s*\b(sensu\s+lato|s\.\s*l\.?|coll\.\s*sp\.?)(?=\s|$)"
AUTHOR_PARENS = r"\([A-Z][a-zé.&\s]*\)"
AUTHOR_END = r"\s+[A-Z][a-zé.]*\.?(?:\s+(?:ex|in|&)\s+[A-Z][a-zé.]*\.?)*$"
AGGREGATES = ("agg.", "s.l.")
TIMES = "×"

CLEAN_COLUMNS = ("cleaned", "is_hybrid", "qualifier", "qualifier_position", "is_aggregate", "genus_only", "hybrid_name", "genus_abbrev")
FLAGS = ("is_hybrid", "is_aggregate", "genus_only", "genus_abbrev")


def canonical_qualifier(raw: Column) -> Column:
    key = F.lower(F.regexp_replace(raw, "[. ]", ""))
    known = F.create_map(*map(F.lit, chain.from_iterable(QUALIFIERS.items())))
    return F.coalesce(F.try_element_at(known, key), raw)


def hybrid_text(name: Column) -> Column:
    """Signs become standalone ``x`` tokens, blanks single."""
    return squeeze(F.replace(name, F.lit(TIMES), F.lit(" x ")))


def hybrid_type(spaced: Column) -> Column:
    """nothogenus, nothospecies, formula or null, from :func:`hybrid_text`."""
    marks = F.size(F.filter(F.split(spaced, " "), lambda t: F.lower(t) == "x"))
    return (
        F.when(spaced.rlike("^[xX] [A-Z]"), "nothogenus")
        .when(spaced.rlike(r"^[A-Z]\S* [xX] [a-z]") & (marks == 1), "nothospecies")
        .when(spaced.rlike(r"^[A-Z]\S*(?: \S+)+? [xX] [A-Z]"), "formula")
    )


def hybrid_stripped(spaced: Column, kind: Column) -> Column:
    return (
        F.when(kind == "nothogenus", F.regexp_replace(spaced, "^[xX] ", ""))
        .when(kind == "nothospecies", F.regexp_replace(spaced, r"^(\S+) [xX] ", "$1 "))
        .when(kind == "formula", F.regexp_extract(spaced, r"^([A-Z]\S*(?: \S+)+?) [xX] [A-Z]", 1))
    )


def hybrid_parents(df: DataFrame, column: str) -> DataFrame:
    """Adds ``hybrid_type, parent_1, parent_2``; an abbreviated genus of the second parent is spelled out."""
    spaced = hybrid_text(F.col(column))
    out = df.withColumn("__h", spaced).withColumn("hybrid_type", hybrid_type(F.col("__h")))
    formula = F.col("hybrid_type") == "formula"
    one = F.regexp_extract("__h", r"^([A-Z]\S*(?: \S+)+?) [xX] [A-Z]", 1)
    two = F.regexp_extract("__h", r"^[A-Z]\S*(?: \S+)+? [xX] ([A-Z].*)$", 1)
    two = F.when(two.rlike(r"^[A-Z]\.( |$)"), F.concat(first_token(one), F.substring(two, 3, 1 << 30))).otherwise(two)
    return out.withColumns({"parent_1": F.when(formula, one), "parent_2": F.when(formula, two)}).drop("__h")


def qualifier_match(name: Column) -> tuple[Column, Column]:
    """First qualifier as written and its 1-based place; a leading cf. is at 1."""
    lead = name.rlike(r"^[Cc][Ff]\.?(?=\s)")
    raw = F.regexp_extract(name, QUALIFIER, 0)
    found = F.when(lead, "cf.").when(raw != "", raw)
    place = F.when(lead, 1).when(raw != "", F.regexp_instr(name, F.lit(QUALIFIER)))
    return found, place


def strip_qualifiers(name: Column) -> Column:
    return F.regexp_replace(name, QUALIFIER, " ")


def clean_names(df: DataFrame, column: str = "input_name") -> DataFrame:
    """Adds :data:`CLEAN_COLUMNS` for the names in ``column``; null and blank names give nulls."""
    s, q, kind = F.col("__s"), F.col("qualifier"), F.col("__k")
    out = df.withColumn("__s", trim_ws(F.col(column)))
    out = out.withColumn("__no", F.coalesce(s == "", F.lit(True)))
    out = out.withColumn("__s", F.replace(F.replace(s, F.lit("Ã\u0097"), F.lit(TIMES)), F.lit("Ã—"), F.lit(TIMES)))
    lead = F.regexp_extract(s, LEADING, 1)
    out = out.withColumns({"qualifier": F.when(lead != "", canonical_qualifier(lead)), "qualifier_position": F.when(lead != "", "genus")})
    out = out.withColumn("__s", F.regexp_replace(s, LEADING, ""))
    out = fenced(out)
    marked = s.contains(TIMES) | s.rlike(r"(^|\s)[xX](\s|$)")
    out = out.withColumn("__h", F.when(marked & ~F.col("__no"), hybrid_text(s)))
    out = out.withColumn("__k", hybrid_type(F.col("__h")))
    out = out.withColumn("__s", F.coalesce(hybrid_stripped(F.col("__h"), kind), s))
    out = fenced(out)
    for pattern, canon in ((SENSU_STRICTO, "s.str."), (SENSU_LATO, "s.l.")):
        out = out.withColumn("__hit", F.when(q.isNull(), F.regexp_instr(s, F.lit(pattern))))
        hit, at = F.col("__hit") > 0, F.col("__hit")
        after = F.substring(s, at + F.length(F.regexp_extract(s, pattern, 0)), F.length(s))
        out = out.withColumns(
            {
                "__s": F.when(hit, F.concat(F.substring(s, F.lit(1), at - 1), after)).otherwise(s),
                "qualifier": F.when(hit, canon).otherwise(q),
                "qualifier_position": F.when(hit, "species").otherwise(F.col("qualifier_position")),
            }
        )
    out = fenced(out)
    raw = F.regexp_extract(s, QUALIFIER, 0)
    own = q.isNull() & (raw != "")
    out = out.withColumn("__raw", F.when(own, raw))
    out = out.withColumns(
        {
            "qualifier": F.coalesce(q, canonical_qualifier(F.col("__raw"))),
            "qualifier_position": F.when(F.col("__raw").isNotNull(), "species").otherwise(F.col("qualifier_position")),
        }
    )
    for pattern, to in ((QUALIFIER, " "), (AUTHOR_PARENS, " "), (AUTHOR_END, ""), (r"\([^)]*\)", " "), ("[0-9]+", " ")):
        out = out.withColumn("__s", F.regexp_replace(s, pattern, to))
    out = fenced(out.withColumn("__s", squeeze(s)))
    rest = F.regexp_replace(s, r"^\S+\s*", "")
    out = out.withColumn("__s", F.when(rest != "", F.concat(first_token(s), F.lit(" "), F.lower(rest))).otherwise(s))
    n, there = word_count(s), ~F.col("__no")
    notho = (kind == "nothospecies") & (n >= 2)
    yes = lambda c: there & F.coalesce(c, F.lit(False))
    out = out.withColumns(
        {
            "cleaned": F.when(there, s),
            "is_hybrid": yes(kind.isNotNull()),
            "qualifier": F.when(there, q),
            "qualifier_position": F.when(there, F.col("qualifier_position")),
            "is_aggregate": yes(q.isin(*AGGREGATES)),
            "genus_only": yes(q.isin("sp.", "sect.", "agg.") & (n == 1)),
            "hybrid_name": F.when(there & notho, F.concat(first_token(s), F.lit(f" {TIMES} "), F.regexp_replace(s, r"^\S+ ", ""))),
            "genus_abbrev": yes(kind.isNull() & (n >= 2) & first_token(s).rlike(r"^[A-Za-z]\.?$")),
        }
    )
    return fenced(out.drop("__s", "__no", "__h", "__k", "__hit", "__raw"))


def clean_rows(df: DataFrame, column: str = "input_name") -> DataFrame:
    """:func:`clean_names` for rows whose names repeat: each distinct name is cleaned once.

    The distinct names combine map-side and join back by name, so a frequent name costs a
    lookup per row. Null names have null columns and false flags, as there.
    """
    once = clean_names(df.select(column).filter(F.col(column).isNotNull()).distinct(), column)
    flags = {c: F.coalesce(c, F.lit(False)) for c in FLAGS}
    return df.join(once, column, "left").withColumns(flags)


def attach_agg_key(df: DataFrame, aggregates: str = "preserve") -> DataFrame:
    """``agg_key``: the aggregate taxon's name for aggregate concepts, null when these collapse to species."""
    key = F.when(F.col("is_aggregate"), F.concat("cleaned", F.lit(" aggr."))) if aggregates == "preserve" else F.lit(None).cast("string")
    return df.withColumn("agg_key", key)
