"""Maps from a source's values to a shared vocabulary or unit, as Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws


def _low(c: Column) -> Column:
    return F.lower(trim_ws(c.cast("string")))


def by_word(c: Column, lookup: dict[str, str]) -> Column:
    """Value of the case- and space-insensitive entry, null without one."""
    pairs = {k.strip().lower(): v for k, v in lookup.items()}
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs.items()))), _low(c))


def by_pattern(c: Column, patterns: dict[str, str]) -> Column:
    """Value of the first pattern that occurs in the lower-cased text."""
    low, out = _low(c), F.lit(None).cast("string")
    for pattern, value in reversed(patterns.items()):
        out = F.when(low.rlike(pattern), F.lit(value)).otherwise(out)
    return F.when(low.isNotNull() & (low != ""), out)


def num(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def times(factor: float):
    return lambda c: num(c) * F.lit(factor)


def over(divisor: float):
    return lambda c: num(c) / F.lit(divisor)


def num_pos(c: Column) -> Column:
    """Negative values are sentinels."""
    return F.when(num(c) >= 0, num(c))


def cm_to_mm_pos(c: Column) -> Column:
    return num_pos(c) * F.lit(10.0)


def days_to_years(c: Column) -> Column:
    return num_pos(c) / F.lit(365.25)


# Vocabularies of the trait sources.
WOODINESS = {"woody": "woody", "herbaceous": "non-woody", "variable": "variable"}
WOODINESS_PLAIN = {"woody": "woody", "non-woody": "non-woody", "variable": "variable"}
PHOTOSYNTHESIS = {
    "c3": "c3", "c4": "c4", "cam": "cam", "c3-c4": "c3-c4", "c3 c4": "c3-c4", "c3; c4": "c3-c4",
    "c3-cam": "c3-cam", "c3 cam": "c3-cam", "c3; cam": "c3-cam",
}
GROWTH_FORM = {
    "tree|mallee|palmoid": "tree", "subshrub": "subshrub", "shrub": "shrub", "climber|liana|vine": "climber",
    "fern|lycophyte": "fern", "graminoid|grass|tussock|hummock": "graminoid", "geophyte": "geophyte",
    "epiphyte": "epiphyte", "succulent": "succulent", "herb|forb": "herb", "parasite|other": "other",
}
LIFE_FORM = {
    "phanerophyt": "phanerophyte", "chamaephyt": "chamaephyte", "hemikryptophyt|hemicrypto": "hemicryptophyte",
    "geophyt": "geophyte", "hydrophyt": "hydrophyte", "helophyt": "helophyte", "therophyt": "therophyte", "cryptophyt": "cryptophyte",
}
DISPERSAL = {
    "myrmecochor": "ant", "anemochor|meteorochor|boleochor|chamaechor": "wind", "zoochor|dysochor": "animal",
    "hydrochor|nautochor|ombrochor": "water", "barochor|blastochor|bythisochor": "gravity",
    "ballochor|ballistic|autochor|herpochor": "ballistic", "agochor|hemerochor|ethelochor|speirochor": "human",
    "unspecialized|undefined": "unspecialized",
}
POLLINATION = {
    "insekt|insect": "insect", "wind": "wind", "wasser|water": "water",
    "selbst|selfed|self|kleistogam|geitonogam": "self", "apogam": "apogamy",
}
COLOUR = {
    "white": "white", "cream": "cream", "creamy": "cream", "ivory": "cream", "yellow": "yellow", "gold": "yellow",
    "golden": "yellow", "orange": "orange", "red": "red", "scarlet": "red", "crimson": "red", "pink": "pink",
    "rose": "pink", "magenta": "pink", "purple": "purple", "violet": "purple", "lilac": "purple", "mauve": "purple",
    "muave": "purple", "blue": "blue", "green": "green", "greenish": "green", "brown": "brown", "browish": "brown",
    "bronze": "brown", "black": "black", "grey": "grey", "gray": "grey",
}
FRUIT = {
    "achene": "achene", "capsule": "capsule", "pyxid": "capsule", "pyxidium": "capsule", "caryopsis": "caryopsis",
    "legume": "legume", "pod": "legume", "lomentum": "legume", "silique": "silique", "siliqua": "silique",
    "drupe": "drupe", "berry": "berry", "follicle": "follicle", "cone": "cone", "samara": "samara", "nut": "nut",
    "schizocarp": "schizocarp", "utricle": "utricle", "pome": "pome",
}
DIET = {
    "invertivore": "invertivore", "omnivore": "omnivore", "omnivorous": "omnivore", "frugivore": "frugivore",
    "aquatic predator": "carnivore", "vertivore": "carnivore", "carnivorous": "carnivore", "granivore": "granivore",
    "nectarivore": "nectarivore", "herbivore terrestrial": "herbivore", "herbivore aquatic": "herbivore",
    "herbivorous": "herbivore", "scavenger": "scavenger",
}


def words(lookup: dict[str, str]):
    return lambda c: by_word(c, lookup)


def patterns(lookup: dict[str, str]):
    return lambda c: by_pattern(c, lookup)


def woodiness_mixed(c: Column) -> Column:
    """Records of several terms: mixed and semi-woody ones are variable."""
    low = _low(c)
    herb, wood, semi = low.contains("herbaceous"), low.contains("woody"), low.contains("semi_woody")
    return F.when((herb & wood) | semi, "variable").when(herb, "non-woody").when(wood, "woody")


def life_history(c: Column) -> Column:
    """Several classes in one record are variable."""
    low = _low(c)
    s = F.replace(F.replace(low, F.lit("short_lived_perennial"), F.lit("perennial")), F.lit("ephemeral"), F.lit("annual"))
    kinds = ("annual", "biennial", "perennial")
    n = sum((s.contains(k).cast("int") for k in kinds), F.lit(0))
    out = F.when((n > 1) | low.contains("variable"), "variable")
    for k in kinds:
        out = out.when(s.contains(k), k)
    return out


def flower_colour(c: Column) -> Column:
    """The first colour word of a compound value."""
    first = F.regexp_extract(_low(c), "^[^a-z]*([a-z]+)", 1)
    return by_word(first, COLOUR)
