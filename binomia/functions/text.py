"""Text expressions for scientific names. All are plain Columns: no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that fold one to one, and those that become two.
FOLD_FROM = "àáâãåāçèéêëēìíîïīñòóôõøōùúûūýÿðđł"
FOLD_TO = "aaaaaaceeeeeiiiiinoooooouuuuyyddl"
DIGRAPHS = {"ä": "ae", "ö": "oe", "ü": "ue", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}

#: Marker of a species aggregate at the end of a name.
AGG_SUFFIX = r"(?i)[ -](aggr?\.?|s\.\s*l\.?|sensu\s+lato|coll\.?(\s*sp(ecies)?\.?)?)$"
#: Ranks that denote an aggregate.
AGG_RANK = r"^(SPECIES AGGREGATE|AGGR\.?|COLL\.?\s*SP(ECIES)?\.?)$"


def trim_ws(c: Column) -> Column:
    """Strips blanks, tabs and line ends (``trim`` strips blanks only)."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), r"\s+", " ")


def first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def second_token(c: Column) -> Column:
    """The second word; null for names of one word."""
    out = F.regexp_extract(c, r"^\S+\s+(\S+)", 1)
    return F.when(out != "", out)


def first_two(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\S+\s+\S+)", 1)


def word_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^ ]", "")) + 1


def strip_accents(c: Column) -> Column:
    """Accents and ligatures of lower-case text to ASCII."""
    for one, two in DIGRAPHS.items():
        c = F.replace(c, F.lit(one), F.lit(two))
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize_epithets(c: Column) -> Column:
    """Orthographic key: accents fold everywhere, spelling variants after the first word."""
    rest = F.regexp_replace(c, r"^\S+\s*", "")
    genus, rest = strip_accents(F.lower(first_token(c))), strip_accents(F.lower(rest))
    key = F.regexp_replace(rest, "ae|oe", "i")
    key = F.translate(F.regexp_replace(key, r"ii\b", "i"), "y", "i")
    for one, two in (("ph", "f"), ("rh", "r"), ("th", "t")):
        key = F.replace(key, F.lit(one), F.lit(two))
    return F.when(rest != "", F.concat(genus, F.lit(" "), key)).otherwise(genus)


def strip_agg_marker(c: Column) -> Column:
    return F.regexp_replace(c, AGG_SUFFIX, "")


def canon_agg_marker(c: Column) -> Column:
    """Any spelling of an aggregate marker becomes `` aggr.``."""
    return F.when(c.rlike(AGG_SUFFIX), F.concat(strip_agg_marker(c), F.lit(" aggr."))).otherwise(c)


def is_aggregate_name(c: Column) -> Column:
    return F.coalesce(c.rlike(AGG_SUFFIX), F.lit(False))


def normalize_aggregate_name(name: Column, rank: Column | None = None) -> Column:
    """Canonical marker; names whose rank is an aggregate get one."""
    out = canon_agg_marker(name)
    if rank is None:
        return out
    need = F.coalesce(F.upper(trim_ws(rank)).rlike(AGG_RANK), F.lit(False)) & ~out.rlike(AGG_SUFFIX) & (out != "")
    return F.when(need, F.concat(out, F.lit(" aggr."))).otherwise(out)


def fold_key(c: Column) -> Column:
    """Accent- and case-insensitive key of a place name."""
    return squeeze(strip_accents(F.lower(c)))


def fenced(df: DataFrame) -> DataFrame:
    """The same rows and columns behind a generator of one row each.

    Long chains of expressions that use one another would otherwise be copied into every
    filter and projection above them; the optimiser moves nothing through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
