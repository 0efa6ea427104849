"""Inputs that the registered queries derive from the driver's tables.

The SELECTs run unchanged on Spark and DuckDB; ``{..}`` names a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A checklist with heavy homonymy: two-word part names, synonyms that chain over two hops.
BACKBONE = """
select p_partkey as k, 'p'||lpad(cast(p_partkey as string), 9, '0') as taxon_id,
  upper(substr(p_name, 1, 1))||substr(p_name, 2) as canonical_name,
  case when p_type = 'PROMO' then 'SUBSPECIES' else 'SPECIES' end as taxon_rank,
  case when p_partkey % 3 = 0 then 'ACCEPTED' else 'SYNONYM' end as taxonomic_status,
  case when p_partkey % 3 = 0 then null else 'p'||lpad(cast(p_partkey - 1 as string), 9, '0') end as accepted_name_usage_id,
  p_brand as family, upper(substr(p_name, 1, 1))||substr(split_part(p_name, ' ', 1), 2) as genus,
  split_part(p_name, ' ', 2) as specific_epithet, 'A. '||cast(p_size as string) as authorship,
  case when p_size % 2 = 0 then 'Valid' else 'Illegitimate' end as nomenclaturalStatus
from {part}"""

#: Names as people write them: one of twelve habits or slips per order.
NAMES = """
select l_orderkey * 10 + l_linenumber as row_idx, case cast(l_orderkey % 12 as int)
  when 0 then n when 1 then n||' L.' when 2 then replace(n, ' ', ' cf. ') when 3 then n||' agg.' when 4 then replace(n, ' ', ' x ')
  when 5 then upper(n) when 6 then substr(n, 1, length(n) - 1) when 7 then substr(n, 1, 3)||substr(n, 5, 1)||substr(n, 4, 1)||substr(n, 6)
  when 8 then substr(n, 1, 1)||'. '||e when 9 then 'Zyzzyx '||e when 10 then null else n||' (L.) Mill.' end as input_name
from (select l_orderkey, l_linenumber, upper(substr(p_name, 1, 1))||substr(p_name, 2) as n, split_part(p_name, ' ', 2) as e
  from {lineitem} join {part} on l_partkey = p_partkey) as t"""

#: A name in each event, dirty as in :data:`NAMES`; events of parts that don't exist have none.
EVENT_NAMES = """
select event_id as row_idx, ts, case cast(event_id % 6 as int) when 0 then n when 1 then n||' L.' when 2 then replace(n, ' ', ' cf. ') when 3 then upper(n)
  when 4 then 'Zyzzyx '||e else n||' (L.) Mill.' end as input_name
from (select event_id, ts, upper(substr(p_name, 1, 1))||substr(p_name, 2) as n, split_part(p_name, ' ', 2) as e
  from {events} left join {part} on p_partkey = event_id % 150 + 1) as t"""

#: Free text with accents: documents as a whole.
WHOLE_TEXTS = """select doc_id as row_idx, text as input_name from {documents}"""

#: Markers, signs and authors around part names, by part.
MARKED = """
select p_partkey as row_idx, case cast(p_partkey % 10 as int)
  when 0 then n||' aggr.' when 1 then n||' s. l.' when 2 then n||' coll. species' when 3 then n when 4 then n||'-agg.'
  when 5 then '× '||n when 6 then replace(n, ' ', ' × ') when 7 then n||' x '||substr(n, 1, 1)||'. '||lower(p_brand)
  when 8 then n||' X Zyzzyx minor' else 'cf. '||n||' sensu stricto' end as input_name,
  case when p_partkey % 7 = 3 then 'Species aggregate' else 'SPECIES' end as taxon_rank
from (select *, upper(substr(p_name, 1, 1))||substr(p_name, 2) as n from {part}) as t"""

#: Attributes keyed by name, with repeated keys in file order, rows of aggregates and rows without a name.
TRAIT_TABLE = """
select case when p_partkey % 4 = 0 then null when p_partkey % 5 = 0 then upper(substr(p_name, 1, 1))||substr(p_name, 2)||' agg.' else upper(substr(p_name, 1, 1))||substr(p_name, 2) end as canonical_name,
  p_partkey as src_ord, cast(p_size as double) as plant_height_m, cast(p_retailprice as double) as seed_mass_mg, p_type as growth_form
from {part}"""

#: Attributes by name and group.
GROUP_TABLE = """
select upper(substr(p_name, 1, 1))||substr(p_name, 2) as canonical_name, p_partkey as src_ord,
  case cast(p_partkey % 4 as int) when 0 then 'AT' when 1 then 'DE' when 2 then 'FR' else null end as country_code,
  p_brand as invasive_status from {part}"""

#: Ranges: codes are nations, level 1 is their region.
RANGES = """
select upper(substr(p_name, 1, 1))||substr(p_name, 2) as canonical_name, 'N'||cast(p_partkey % 25 as string) as tdwg_code,
  case when p_size >= 20 then null when p_partkey % 5 = 0 then 'native' when p_partkey % 5 = 1 then 'introduced' when p_partkey % 5 = 2 then 'extinct' end as native_status
from {part}"""
REGIONS = """
select 'N'||cast(n_nationkey as string) as code, n_name as name, 'L2-'||cast(n_regionkey as string) as level2_code, r_name as level2_name,
  'R'||cast(n_regionkey as string) as level1_code, r_name as level1_name from {nation} join {region} on n_regionkey = r_regionkey"""

#: Genera by checklist, with gaps that lower-ranked ones fill.
GENERA = """
select distinct upper(substr(p_name, 1, 1))||substr(split_part(p_name, ' ', 1), 2) as genus,
  case when p_size % 3 = 0 then 'Metazoa' when p_size % 3 = 1 then null else 'Riboviridae virae' end as kingdom, p_type as phylum,
  case when p_size % 2 = 0 then 'C'||cast(p_size % 4 as string) end as class, cast(null as string) as `order`, p_brand as family
from {part} where p_partkey % {m} = {r}"""

#: Families with their groups, by brand: some have nothing, some no group.
FAMILIES = """
select distinct p_brand as family, case when substr(p_brand, 8, 1) = '5' then null when length(p_brand) % 2 = 0 then 'plantae' else 'animalia' end as kingdom_group,
  case when substr(p_brand, 8, 1) = '5' or substr(p_brand, 7, 1) = '3' then null when substr(p_brand, 7, 1) in ('1', '2') then 'land_plant' else 'bird' end as taxon_group,
  case when substr(p_brand, 8, 1) in ('1', '2') then 'tree' end as life_form from {part}"""

#: The version before :data:`BACKBONE`: taxa that it lacks, taxa with another name or status, and taxa that go.
BACKBONE_BEFORE = """
select p_partkey as k, case when p_partkey % 17 = 4 then 'gone'||cast(p_partkey as string) else 'p'||lpad(cast(p_partkey as string), 9, '0') end as taxon_id,
  upper(substr(p_name, 1, 1))||substr(p_name, 2)||case when p_partkey % 13 = 5 then ' vetus' else '' end as canonical_name,
  case when p_type = 'PROMO' then 'SUBSPECIES' else 'SPECIES' end as taxon_rank,
  case when p_partkey % 3 = 0 or p_partkey % 19 = 7 then 'ACCEPTED' else 'SYNONYM' end as taxonomic_status,
  case when p_partkey % 3 = 0 then null else 'p'||lpad(cast(p_partkey - 1 as string), 9, '0') end as accepted_name_usage_id,
  p_brand as family, upper(substr(p_name, 1, 1))||substr(split_part(p_name, ' ', 1), 2) as genus,
  split_part(p_name, ' ', 2) as specific_epithet, 'A. '||cast(p_size as string) as authorship,
  case when p_size % 2 = 0 then 'Valid' else 'Illegitimate' end as nomenclaturalStatus
from {part}"""

#: A user's own tables: dirty names, values that agree per accepted taxon, columns that clash with a result's.
OWN_DATA = """
select distinct case cast(p_size % 3 as int) when 0 then upper(n) when 1 then n||' L.' else n end as species,
  7 as size, 'own' as family from (select *, upper(substr(p_name, 1, 1))||substr(p_name, 2) as n from {part}) as t"""
OWN_GROUPS = """
select n||' (L.) Mill.' as species, case cast(p_partkey % 3 as int) when 0 then 'AT' when 1 then 'DE' else null end as country,
  max(p_size) as top_size from (select *, upper(substr(p_name, 1, 1))||substr(p_name, 2) as n from {part}) as t group by 1, 2"""

#: A hierarchy: customers (genera) under nations (families) under regions (kingdoms).
TAXA = """
select 'k'||cast(r_regionkey as string) as taxon_id, cast(null as string) as parent_key, 'KINGDOM' as taxon_rank,
  case cast(r_regionkey as int) when 0 then 'Plantae' when 1 then 'Animalia' when 2 then 'Fungi' when 3 then 'Incertae' else 'Bacteria' end as canonical_name from {region}
union all select 'f'||cast(n_nationkey as string), 'k'||cast(n_regionkey as string), 'FAMILY', n_name from {nation}
union all select 'g'||cast(c_custkey as string), 'f'||cast(c_nationkey as string), 'GENUS', 'Genus'||cast(c_custkey % 300 as string) from {customer}"""


def table(spark: SparkSession, sf_dir: str, sql: str, **params: object) -> DataFrame:
    """A SELECT of this module over the tables in ``sf_dir``."""
    names = [t for t in ("part", "lineitem", "documents", "nation", "region", "customer", "orders", "supplier", "events") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}, **params)


def duck(sql: str, **params: object) -> str:
    """The same SELECT for DuckDB."""
    names = {t: t for t in ("part", "lineitem", "documents", "nation", "region", "customer", "orders", "supplier", "events")}
    return sql.replace("`", '"').format(**names, **params)
