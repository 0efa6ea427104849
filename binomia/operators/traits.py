"""Traits across sources: harmonised to one unit or vocabulary, side by side or reduced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.functions import crosswalk as x
from binomia.operators.enrich import enrich

Map = Callable[[Column], Column]


@dataclass(frozen=True)
class Source:
    table: str
    column: str
    map: Map = x.num


@dataclass(frozen=True)
class Trait:
    kind: str
    unit: str | None
    sources: dict[str, Source]


def _trait(kind: str, unit: str | None, **sources: tuple) -> Trait:
    return Trait(kind, unit, {k: Source(*v) for k, v in sources.items()})


_G = x.patterns(x.GROWTH_FORM)
_L = x.patterns(x.LIFE_FORM)
_D = x.patterns(x.DISPERSAL)
_P = x.patterns(x.POLLINATION)
_PH = x.words(x.PHOTOSYNTHESIS)

# Which table and column carries a trait, in order of priority.
TRAITS: dict[str, Trait] = {
    "plant_height": _trait("numeric", "m", gift=("gift", "gift_plant_height_max"), diaz=("diaz_traits", "plant_height_m"), austraits=("austraits", "plant_height_m"), bien=("bien", "plant_height_m"), brot=("brot", "height_m")),
    "seed_mass": _trait("numeric", "mg", diaz=("diaz_traits", "seed_mass_mg"), gift=("gift", "gift_seed_mass_mean", x.times(1000.0)), austraits=("austraits", "seed_dry_mass_mg"), bien=("bien", "seed_mass_mg"), brot=("brot", "seed_mass_mg"), ecoflora=("ecoflora", "seed_weight_mg_uk")),
    "sla": _trait("numeric", "mm2/mg", leda=("leda", "sla_mm2_mg"), gift=("gift", "gift_sla_mean", x.times(0.1)), bien=("bien", "sla_mm2_mg"), brot=("brot", "sla_mm2_mg")),
    "wood_density": _trait("numeric", "g/cm3", gwdd=("gwdd", "wood_density_g_cm3"), austraits=("austraits", "wood_density_g_cm3"), bien=("bien", "wood_density_g_cm3")),
    "leaf_area": _trait("numeric", "mm2", austraits=("austraits", "leaf_area_mm2"), bien=("bien", "leaf_area_mm2"), brot=("brot", "leaf_area_mm2")),
    "leaf_n": _trait("numeric", "mg/g", austraits=("austraits", "leaf_n_per_dry_mass"), bien=("bien", "leaf_n_per_dry_mass")),
    "leaf_p": _trait("numeric", "mg/g", austraits=("austraits", "leaf_p_per_dry_mass"), bien=("bien", "leaf_p_per_dry_mass")),
    "leaf_thickness": _trait("numeric", "mm", bien=("bien", "leaf_thickness_mm"), gift=("gift", "gift_leaf_thickness_mean", x.times(10.0))),
    "body_mass": _trait("numeric", "g", combine=("combine", "adult_mass_g"), amniote=("amniote", "adult_body_mass_g"), pantheria=("pantheria", "body_mass_g"), elton_traits=("elton_traits", "body_mass_g"), avonet=("avonet", "body_mass_g"), anage=("anage", "body_mass_g"), phylacine=("phylacine", "mass_g"), repttraits=("repttraits", "body_mass_g"), fishbase=("fishbase", "body_mass_g"), sealifebase=("sealifebase", "body_mass_g"), frugivoria=("frugivoria", "body_mass_g"), pottier=("pottier", "body_mass_g"), animaltraits=("animaltraits", "body_mass_kg", x.times(1000.0)), homerange=("homerange", "body_mass_kg", x.times(1000.0))),
    "longevity": _trait("numeric", "yr", anage=("anage", "max_longevity_yr"), amniote=("amniote", "maximum_longevity_y"), combine=("combine", "max_longevity_d", x.over(365.25)), pantheria=("pantheria", "longevity_mo", x.over(12.0)), repttraits=("repttraits", "longevity_yr"), chelonians=("chelonians", "max_lifespan_y"), amphibio=("amphibio", "longevity_yr")),
    "trophic_level": _trait("numeric", "trophic level (~1-5)", fishbase=("fishbase", "trophic_level"), beukhof=("beukhof", "trophic_level"), quimbayo=("quimbayo", "trophic_level"), pelagic=("pelagic", "trophic_level", x.num_pos), arctic_traits=("arctic_traits", "trophic_level"), sealifebase=("sealifebase", "trophic_level")),
    "clutch_litter_size": _trait("numeric", "offspring per clutch/litter", amniote=("amniote", "litter_clutch_size", x.num_pos), combine=("combine", "litter_size_n"), pantheria=("pantheria", "litter_size"), anage=("anage", "litter_size"), repttraits=("repttraits", "clutch_size"), amphibio=("amphibio", "litter_size")),
    "age_at_maturity": _trait("numeric", "yr", anage=("anage", "female_maturity_d", x.days_to_years), amniote=("amniote", "female_maturity_d", x.days_to_years), amphibio=("amphibio", "age_maturity_y")),
    "gestation_incubation": _trait("numeric", "days", anage=("anage", "gestation_incubation_d"), combine=("combine", "gestation_length_d"), pantheria=("pantheria", "gestation_d"), amniote=("amniote", "gestation_d", x.num_pos)),
    "body_length": _trait("numeric", "mm", combine=("combine", "adult_body_length_mm"), amniote=("amniote", "adult_svl_cm", x.cm_to_mm_pos), repttraits=("repttraits", "svl_mm"), amphibio=("amphibio", "body_size_mm"), fishbase=("fishbase", "body_length_cm", x.times(10.0)), sealifebase=("sealifebase", "body_length_cm", x.times(10.0))),
    "metabolic_rate": _trait("numeric", "W", anage=("anage", "metabolic_rate_w"), animaltraits=("animaltraits", "metabolic_rate_w")),
    "reproductive_frequency": _trait("numeric", "per year", amniote=("amniote", "clutches_per_y", x.num_pos), combine=("combine", "litters_per_year_n")),
    "flowering_start": _trait("numeric", "month (1-12)", baseflor=("baseflor", "flower_begin_month"), ecoflora=("ecoflora", "flower_begin_month_uk")),
    "flowering_end": _trait("numeric", "month (1-12)", baseflor=("baseflor", "flower_end_month"), ecoflora=("ecoflora", "flower_end_month_uk")),
    "ellenberg_light": _trait("numeric", "1-9 (classic)", floraweb=("floraweb", "ell_light_de"), ecoflora=("ecoflora", "ell_light_uk"), bet=("bet", "ind_light")),
    "ellenberg_temperature": _trait("numeric", "1-9 (classic)", floraweb=("floraweb", "ell_temperature_de"), bet=("bet", "ind_temperature")),
    "ellenberg_moisture": _trait("numeric", "1-12 (classic)", floraweb=("floraweb", "ell_moisture_de"), ecoflora=("ecoflora", "ell_moisture_uk"), bet=("bet", "ind_moisture")),
    "ellenberg_reaction": _trait("numeric", "1-9 (classic)", floraweb=("floraweb", "ell_reaction_de"), ecoflora=("ecoflora", "ell_reaction_uk"), bet=("bet", "ind_reaction_ph")),
    "ellenberg_nitrogen": _trait("numeric", "1-9 (classic)", floraweb=("floraweb", "ell_nitrogen_de"), ecoflora=("ecoflora", "ell_nitrogen_uk"), bet=("bet", "ind_nitrogen")),
    "ellenberg_salt": _trait("numeric", "0-9 (classic)", floraweb=("floraweb", "ell_salt_de"), ecoflora=("ecoflora", "ell_salt_uk")),
    **{f"eive_{k}": _trait("numeric", "0-10 (EIVE)", eive=("eive", k)) for k in ("light", "temperature", "moisture", "reaction", "nutrients")},
    "woodiness": _trait("categorical", None, zanne=("woodiness", "woodiness", x.words(x.WOODINESS)), gift=("gift", "gift_woodiness_1", x.words(x.WOODINESS_PLAIN)), austraits=("austraits", "woodiness", x.woodiness_mixed), bien=("bien", "woodiness", x.words(x.WOODINESS))),
    "photosynthetic_pathway": _trait("categorical", None, gift=("gift", "gift_photosynthetic_pathway", _PH), austraits=("austraits", "photosynthetic_pathway", _PH), ecoflora=("ecoflora", "photosynthetic_pathway_uk", _PH)),
    "growth_form": _trait("categorical", None, gift=("gift", "gift_growth_form_1", _G), austraits=("austraits", "plant_growth_form", _G), bien=("bien", "growth_form", _G), brot=("brot", "growth_form", _G)),
    "life_form": _trait("categorical", None, gift=("gift", "gift_life_form_1", _L), ecoflora=("ecoflora", "life_form_uk", _L), floraweb=("floraweb", "life_form_de", _L)),
    "dispersal_syndrome": _trait("categorical", None, gift=("gift", "gift_dispersal_syndrome_1", _D), austraits=("austraits", "dispersal_syndrome", _D), leda=("leda", "dispersal_type", _D), baseflor=("baseflor", "dispersal_mode", _D), brot=("brot", "disp_mode", _D)),
    "pollination_vector": _trait("categorical", None, baseflor=("baseflor", "pollination_vector", _P), ecoflora=("ecoflora", "pollination_vector_uk", _P)),
    "life_history": _trait("categorical", None, gift=("gift", "gift_lifecycle_1", x.life_history), austraits=("austraits", "life_history", x.life_history)),
    "flower_colour": _trait("categorical", None, gift=("gift", "gift_flower_colour", x.flower_colour), baseflor=("baseflor", "flower_colour", x.flower_colour), bien=("bien", "flower_color", x.flower_colour)),
    "fruit_type": _trait("categorical", None, gift=("gift", "gift_fruit_type_1", x.words(x.FRUIT)), baseflor=("baseflor", "fruit_type", x.words(x.FRUIT))),
    "diet_guild": _trait("categorical", None, avonet=("avonet", "trophic_niche", x.words(x.DIET)), repttraits=("repttraits", "diet", x.words(x.DIET))),
}
COMBINE = {"numeric": ("median", "mean", "first", "min", "max"), "categorical": ("first", "vote")}


def trait(name: str) -> Trait:
    if name not in TRAITS:
        near = get_close_matches(name, TRAITS, 3)
        raise ValueError(f"no trait {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return TRAITS[name]


def list_traits() -> list[dict]:
    return [{"trait": k, "kind": t.kind, "unit": t.unit, "sources": list(t.sources)} for k, t in TRAITS.items()]


def trait_info(name: str) -> list[dict]:
    """One row per source of a trait, in order of priority: table, column, and how values are harmonised."""
    spec = trait(name)
    rows = []
    for source, s in spec.sources.items():
        note = f"to {spec.unit}" if spec.kind == "numeric" else "to the shared vocabulary"
        rows.append({"trait": name, "kind": spec.kind, "unit": spec.unit, "source": source, "enrichment": s.table, "column": s.column, "note": note if s.map is not x.num else "as given"})
    return rows


def combiner(kind: str, combine: str | None) -> str:
    """The reducer: median for numbers and the first source for categories unless said otherwise."""
    combine = combine or ("median" if kind == "numeric" else "first")
    if combine not in COMBINE[kind]:
        raise ValueError(f"{combine!r} does not reduce {kind} traits; use {', '.join(COMBINE[kind])}")
    return combine


def reduce_sources(values: list[Column], names: list[str], kind: str, combine: str | None = None) -> tuple[Column, Column, Column]:
    """(value, source, number of sources) over per-source columns in order of priority; one row-wise expression."""
    how = combiner(kind, combine)
    pairs = F.filter(F.array(*[F.struct(v.alias("v"), F.lit(n).alias("s")) for v, n in zip(values, names, strict=True)]), lambda p: p["v"].isNotNull())
    n = F.size(pairs)
    if how == "first":
        return F.get(pairs, 0)["v"], F.get(pairs, 0)["s"], n
    vals = F.transform(pairs, lambda p: p["v"])
    source = F.when(n > 0, F.array_join(F.transform(pairs, lambda p: p["s"]), ","))
    if how == "vote":
        count = lambda v: F.size(F.filter(vals, lambda w: w == v))
        ranked = F.transform(vals, lambda v, i: F.struct((-count(v)).alias("c"), i.alias("i"), v.alias("v")))
        return F.array_min(ranked)["v"], source, n
    if how in ("min", "max"):
        return (F.array_min if how == "min" else F.array_max)(vals), source, n
    if how == "mean":
        return F.when(n > 0, F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / n), source, n
    up = F.array_sort(vals)
    low, high = F.get(up, F.floor((n - 1) / 2).cast("int")), F.get(up, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2), source, n


def add_trait(
    result: DataFrame, name: str, tables: dict[str, DataFrame], sources: list[str] | str = "all", mode: str = "wide",
    combine: str | None = None, priority: list[str] | None = None, provenance: bool = False,
) -> DataFrame:
    """A trait from all ``sources`` whose table is at hand: wide ``<trait>_<source>`` columns, or reduced.

    Reduced: ``<trait>, <trait>_source, <trait>_n``. ``priority`` reorders the sources.
    ``provenance`` adds ``.._inherited`` beside each value: true where it comes from the
    aggregate of a species, null without a value; of reduced ones, where any value used does.
    """
    spec = trait(name)
    chosen = list(spec.sources) if sources == "all" else [sources] if isinstance(sources, str) else list(sources)
    if unknown := [s for s in chosen if s not in spec.sources]:
        raise ValueError(f"{name} has no source {', '.join(unknown)}; there are {', '.join(spec.sources)}")
    order = [s for s in (priority or []) if s in chosen]
    order += [s for s in chosen if s not in order]
    order = [s for s in order if spec.sources[s].table in tables]
    raw = {s: f"__raw_{s}" for s in order}
    lent = {s: f"__lent_{s}" for s in order}
    for s in order:
        src = spec.sources[s]
        result = enrich(result, tables[src.table], {raw[s]: src.column}, inherited=lent[s] if provenance else None)
        if provenance and lent[s] not in result.columns:  # the table lacks the column
            result = result.withColumn(lent[s], F.lit(None).cast("boolean"))
    values = [spec.sources[s].map(F.col(raw[s])) for s in order]
    if mode == "wide":
        more = {f"{name}_{s}_inherited": F.when(v.isNotNull(), F.coalesce(lent[s], F.lit(False))) for s, v in zip(order, values, strict=True)} if provenance else {}
        return result.withColumns({f"{name}_{s}": v for s, v in zip(order, values, strict=True)} | more).drop(*raw.values(), *lent.values())
    if not order:
        kind = "double" if spec.kind == "numeric" else "string"
        return result.withColumns({name: F.lit(None).cast(kind), f"{name}_source": F.lit(None).cast("string"), f"{name}_n": F.lit(0)} | ({f"{name}_inherited": F.lit(None).cast("boolean")} if provenance else {}))
    value, source, n = reduce_sources(values, order, spec.kind, combine)
    used = [F.when(v.isNotNull(), F.coalesce(lent[s], F.lit(False))) for s, v in zip(order, values, strict=True)]
    from_group = F.coalesce(*used) if combiner(spec.kind, combine) == "first" else F.greatest(*used, F.lit(None).cast("boolean"))
    more = {f"{name}_inherited": from_group} if provenance else {}
    return result.withColumns({name: value, f"{name}_source": source, f"{name}_n": n} | more).drop(*raw.values(), *lent.values())
