"""Named enrichments: which table, joined by what, and how its columns are called."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from binomia.operators.enrich import enrich, enrich_grouped, select_columns


@dataclass(frozen=True)
class Door:
    """Columns come from the table's schema: all but keys, ``prefix`` put before those in ``only`` (or all)."""

    table: str
    by: str = "accepted_name"
    group: str | None = None
    prefix: str = ""
    only: tuple[str, ...] = ()

    def columns(self, table: DataFrame) -> dict[str, str]:
        keys = {"canonical_name", "accepted_name", "genus", "src_ord", self.group}
        return {self._name(c): c for c in table.columns if c not in keys}

    def _name(self, column: str) -> str:
        if not self.prefix or column.startswith(self.prefix) or (self.only and column not in self.only):
            return column
        return self.prefix + column


def _all(*names: str) -> dict[str, Door]:
    """Doors that put their table's name before every column."""
    return {n: Door(n, prefix=f"{n}_") for n in names}


# Doors and their naming of columns.
DOORS: dict[str, Door] = {
    **_all("amniote", "animaltraits", "arctic_traits", "austraits", "bee_ostwald", "bet", "beukhof", "bien", "bird_nest", "birdbase", "brot", "combine", "eive", "eupolltrait", "frugivoria", "globtherm", "gwdd", "homerange", "huang_amph", "madin", "nztd", "octocoral", "odonata", "parravicini", "pelagic", "phylacine", "pottier", "quimbayo", "rimet_phyto", "saproxylic", "sharkipedia", "sheld", "tetradensity", "zooplankton"),
    **{n: Door(n) for n in ("amphibio", "baseflor", "diaz_traits", "ecoflora", "floraweb", "groot", "leptraits", "repttraits")},
    "algae_traits": Door("algae_traits", prefix="algae_"),
    "alien_first_records": Door("alien_first_records", group="country_code"),
    "anage": Door("anage", prefix="anage_", only=("body_mass_g", "litter_size")),
    "arthropod_traits": Door("arthropod_traits", prefix="arthropod_"),
    "avonet": Door("avonet", prefix="avonet_", only=("body_mass_g",)),
    "blanchard": Door("blanchard", by="genus", prefix="blanchard_"),
    "chelonians": Door("chelonians", prefix="chelonian_"),
    "common_names": Door("common_names", group="lang"),
    "coral_traits": Door("coral_traits", prefix="coral_"),
    "disperse": Door("disperse", by="genus"),
    "elton_traits": Door("elton_traits", prefix="elton_", only=("body_mass_g",)),
    "fishbase": Door("fishbase", prefix="fb_"),
    "fishmorph": Door("fish_traits", prefix="fish_"),
    "fungal_traits": Door("fungal_traits", by="genus"),
    "fungalroot": Door("fungalroot", by="genus"),
    "funguild": Door("funguild", prefix="funguild_", only=("growth_form",)),
    "gift": Door("gift", prefix="gift_"),
    "glonaf": Door("glonaf", group="region_id"),
    "griis": Door("griis", group="country_code"),
    "iucn": Door("conservation_status"),
    "leda": Door("leda"),
    "pantheria": Door("pantheria", prefix="pantheria_", only=("body_mass_g",)),
    "pignatti": Door("pignatti"),
    "sealifebase": Door("sealifebase", prefix="sb_"),
    "spider_traits": Door("spider_traits", prefix="spider_"),
    "tree_of_sex": Door("tree_of_sex", prefix="tos_"),
    "useful_plants": Door("useful_plants", prefix="useful_"),
    "wcvp": Door("wcvp", group="tdwg_code"),
    "zanne": Door("woodiness"),
}


# Columns that a door attaches unless others are asked for.
DEFAULTS: dict[str, tuple[str, ...]] = {
    "gift": (
        "gift_woodiness_1", "gift_growth_form_1", "gift_lifecycle_1", "gift_life_form_1", "gift_climber_1", "gift_epiphyte_1",
        "gift_parasite_1", "gift_aquatic_1", "gift_plant_height_max", "gift_photosynthetic_pathway", "gift_seed_mass_mean",
        "gift_dispersal_syndrome_1", "gift_flowering_start", "gift_flowering_end", "gift_deciduousness_1", "gift_sla_mean",
    ),
}


def door_columns(name: str, tables: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """(column, ``numeric`` or ``character``) that door ``name`` can attach."""
    door = _door(name, tables)
    table = tables[door.table]
    kinds = dict(table.dtypes)
    return [(o, "character" if kinds[s] in ("string", "boolean") else "numeric") for o, s in door.columns(table).items()]


def _door(name: str, tables: Mapping[str, DataFrame]) -> Door:
    if name not in DOORS:
        raise ValueError(f"no door {name!r}")
    if DOORS[name].table not in tables:
        raise ValueError(f"table {DOORS[name].table!r} is not at hand")
    return DOORS[name]


def logged_door(result, name: str, tables: Mapping[str, DataFrame], cols: list[str] | str | None = None, groups: list[str] | str = "all", **about: str):
    """:func:`open_door` on a logged result (``about``: source, version, license)."""
    door = _door(name, tables)
    bases = tuple(select_columns(door.columns(tables[door.table]), cols, None, door.prefix)) if door.group else ()
    return result.step(name, lambda df: open_door(df, name, tables, cols, groups), group=door.group, bases=bases, **about)


def open_door(
    result: DataFrame, name: str, tables: Mapping[str, DataFrame], cols: list[str] | str | None = None, groups: list[str] | str = "all",
    types: dict[str, str] | None = None, default: list[str] | None = None,
) -> DataFrame:
    """Attach the columns of door ``name``; ``tables`` maps table names to attribute tables."""
    door = _door(name, tables)
    table = tables[door.table]
    there = door.columns(table)
    default = default or [c for c in DEFAULTS.get(name, ()) if c in there] or None
    columns = select_columns(there, cols, default, door.prefix)
    order = "src_ord" if "src_ord" in table.columns else None
    if door.group:
        renamed = table.select("*", *[table[s].alias(o) for o, s in columns.items() if o != s])
        return enrich_grouped(result, renamed, door.group, list(columns), groups, door.by, order)
    return enrich(result, table, columns, door.by, types, order)
