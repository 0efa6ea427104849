"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

import re

from binomia.plans import inputs as i
from binomia.plans.inputs import duck

_Q = r"cf|aff|s\.l|s\.str|sp|spp|species|subsp|var|f|auct|sensu|non|nec|vel|agg|aggr|sect"


def norm(x: str) -> str:
    """Orthographic key of a SQL expression."""
    def fold(e: str) -> str:
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th")):
            e = f"replace({e}, '{a}', '{b}')"
        return f"translate({e}, 'àáâãåāçèéêëēìíîïīñòóôõøōùúûūýÿðđł', 'aaaaaaceeeeeiiiiinoooooouuuuyyddl')"

    rest = fold(f"lower(regexp_replace({x}, '^\\S+\\s*', ''))")
    key = f"translate(regexp_replace(regexp_replace({rest}, 'ae|oe', 'i', 'g'), 'ii\\b', 'i', 'g'), 'y', 'i')"
    key = f"replace(replace(replace({key}, 'ph', 'f'), 'rh', 'r'), 'th', 't')"
    head = fold(f"lower(split_part({x}, ' ', 1))")
    return f"(case when {rest} <> '' then {head}||' '||{key} else {head} end)"


_CANON = "case lower(replace(replace(raw, '.', ''), ' ', '')) when 'cf' then 'cf.' when 'aff' then 'aff.' when 'agg' then 'agg.' when 'aggr' then 'agg.' when 'sl' then 's.l.' when 'sstr' then 's.str.' when 'sp' then 'sp.' when 'spp' then 'sp.' when 'species' then 'sp.' when 'sect' then 'sect.' when 'subsp' then 'subsp.' when 'var' then 'var.' when 'f' then 'f.' else lower(raw) end"


def clean(source: str) -> str:
    """CTEs that clean ``source`` (row_idx, input_name, ..) into ``cleaned_rows``."""
    return rf"""
c0 as (select *, regexp_replace(input_name, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') s from ({source}) src),
c1 as (select * exclude (s), coalesce(s = '', true) nope, nullif(regexp_extract(s, '(?i)^(cf|aff)\b\.?\s+', 1), '') lead, regexp_replace(s, '(?i)^(cf|aff)\b\.?\s+', '') s from c0),
c2 as (select *, case when not nope and (contains(s, '×') or regexp_matches(s, '(^|\s)[xX](\s|$)')) then trim(regexp_replace(replace(s, '×', ' x '), '\s+', ' ', 'g')) end h from c1),
c3 as (select *, case when regexp_matches(h, '^[xX] [A-Z]') then 'nothogenus'
  when regexp_matches(h, '^[A-Z]\S* [xX] [a-z]') and len(list_filter(string_split(h, ' '), lambda t: lower(t) = 'x')) = 1 then 'nothospecies'
  when regexp_matches(h, '^[A-Z]\S*(?: \S+)+? [xX] [A-Z]') then 'formula' end kind from c2),
c4 as (select * exclude (s), case kind when 'nothogenus' then substr(h, 3) when 'nothospecies' then regexp_replace(h, '^(\S+) [xX] ', '\1 ')
  when 'formula' then regexp_extract(h, '^([A-Z]\S*(?: \S+)+?) [xX] [A-Z]', 1) else s end s from c3),
c5 as (select * exclude (s), case when lead is not null then lower(lead)||'.' when regexp_matches(s, '(?i)\b(sensu\s+stricto|s\.\s*str\.?)(\s|$)') then 's.str.' when regexp_matches(s, '(?i)\b(sensu\s+lato|s\.\s*l\.?|coll\.\s*sp\.?)(\s|$)') then 's.l.' end q0,
  case when lead is not null then s when regexp_matches(s, '(?i)\b(sensu\s+stricto|s\.\s*str\.?)(\s|$)') then regexp_replace(s, '(?i)\s*\b(sensu\s+stricto|s\.\s*str\.?)(\s|$)', '\2')
    else regexp_replace(s, '(?i)\s*\b(sensu\s+lato|s\.\s*l\.?|coll\.\s*sp\.?)(\s|$)', '\2') end s from c4),
c6 as (select *, nullif(regexp_extract(s, '\b((?:{_Q})\.?)(?:\s|$)', 1), '') raw from c5),
c7 as (select *, coalesce(q0, {_CANON}) q, case when lead is not null then 'genus' when coalesce(q0, raw) is not null then 'species' end qp,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\b(?:{_Q})\.?(\s|$)', ' \1', 'g'), '\([A-Z][a-zé.&\s]*\)', ' ', 'g'),
    '\s+[A-Z][a-zé.]*\.?(?:\s+(?:ex|in|&)\s+[A-Z][a-zé.]*\.?)*$', ''), '\([^)]*\)', ' ', 'g'), '[0-9]+', ' ', 'g') t from c6),
c8 as (select *, trim(regexp_replace(t, '\s+', ' ', 'g')) u from c7),
c9 as (select *, case when contains(u, ' ') then split_part(u, ' ', 1)||' '||lower(regexp_replace(u, '^\S+\s*', '')) else u end v from c8),
cleaned_rows as (select row_idx, input_name, case when not nope then v end cleaned, not nope and kind is not null is_hybrid,
  case when not nope then q end qualifier, case when not nope then qp end qualifier_position, not nope and coalesce(q in ('agg.', 's.l.'), false) is_aggregate,
  not nope and coalesce(q in ('sp.', 'sect.', 'agg.') and not contains(v, ' '), false) genus_only,
  case when not nope and kind = 'nothospecies' and contains(v, ' ') then split_part(v, ' ', 1)||' × '||regexp_replace(v, '^\S+ ', '') end hybrid_name,
  not nope and kind is null and regexp_matches(v, '^[A-Za-z]\.? \S') genus_abbrev from c9)"""


def backbone(where: str = "true") -> str:
    """CTEs ``bb`` and ``cand``: a checklist with accepted taxa and scores. Synonyms are followed row by row."""
    return f"""
bb as (select * from ({duck(i.BACKBONE)}) where {where}),
chase as (select taxon_id, taxon_id at_id, 0 depth from bb union all
  select c.taxon_id, b.accepted_name_usage_id, depth + 1 from chase c join bb b on b.taxon_id = c.at_id
  where b.taxonomic_status like '%SYNONYM%' and exists (select 1 from bb t where t.taxon_id = b.accepted_name_usage_id)),
ends as (select taxon_id, arg_max(at_id, depth) acc from chase group by taxon_id),
full_bb as (select b.*, e.acc accepted_taxon_id, a.canonical_name accepted_name, a.family accepted_family, a.genus accepted_genus, a.authorship accepted_authorship,
  b.taxonomic_status like '%SYNONYM%' is_synonym from bb b join ends e using (taxon_id) join bb a on a.taxon_id = e.acc),
cand as (select *, lower(canonical_name) key_ci, {norm('canonical_name')} key_normalized,
  case when taxonomic_status = 'ACCEPTED' then 0 else 1 end s1, case when taxon_rank = 'SPECIES' then 0 else 1 end s2,
  case when nomenclaturalStatus = 'Valid' then 0 else 1 end s3,
  case when split_part({norm('canonical_name')}, ' ', 2) = split_part({norm('accepted_name')}, ' ', 2) then 0 else 1 end s4 from full_bb)"""


def pick(source: str, group: str, extra: str = "") -> str:
    """Best candidate per group of ``source`` (group and candidate columns)."""
    more = f", {extra}" if extra else ""
    return f"""
select {group}{more}, taxon_id, canonical_name matched_name, accepted_name, accepted_taxon_id accepted_id, is_synonym, n >= 2 is_ambiguous, case when n >= 2 then ids end ambiguous_targets from (
  select *, row_number() over (partition by {group} order by s1, s2, s3, s4, taxon_id) rn,
    count(distinct accepted_taxon_id) filter (top) over (partition by {group}) n, null ids0 from (
    select *, (s1, s2, s3, s4) = first_value((s1, s2, s3, s4)) over (partition by {group} order by s1, s2, s3, s4) top from {source}) x) y
  join (select {group} g, string_agg(distinct accepted_taxon_id, '|' order by accepted_taxon_id) ids from (
    select *, (s1, s2, s3, s4) = first_value((s1, s2, s3, s4)) over (partition by {group} order by s1, s2, s3, s4) top from {source}) where top group by {group}) z on z.g = y.{group}
where rn = 1"""


def exact(names: str = "cleaned_rows", suffix: str = "") -> str:
    """CTEs from ``cleaned_rows`` and ``cand`` to ``exact_hits`` by distinct name key."""
    two = r"regexp_extract(cleaned, '^(\S+\s+\S+)', 1)"
    long = "len(string_split(cleaned, ' ')) >= 3"
    return f"""
keys{suffix} as (select distinct cleaned||'|'||genus_only||'|'||coalesce(hybrid_name, '')||'|'||is_aggregate nk, cleaned, genus_only, hybrid_name, is_aggregate from {names} where cleaned is not null),
look{suffix} as (
  select nk, 0 p, 'name' kind, cleaned||' aggr.' lk, 'exact' mt from keys{suffix} where is_aggregate
  union all select nk, 1, 'name', cleaned, 'exact' from keys{suffix} where genus_only
  union all select nk, 2, 'name', hybrid_name, 'exact' from keys{suffix} where not genus_only and hybrid_name is not null
  union all select nk, 3, 'name', cleaned, 'exact' from keys{suffix} where not genus_only
  union all select nk, 4, 'ci', lower(cleaned), 'exact_ci' from keys{suffix} where not genus_only
  union all select nk, 5, 'norm', {norm('cleaned')}, 'exact_ci' from keys{suffix}
  union all select nk, 5, 'norm', {norm('hybrid_name')}, 'exact_ci' from keys{suffix} where hybrid_name is not null
  union all select nk, 5, 'norm', {norm(two)}, 'exact_ci' from keys{suffix} where {long}
  union all select nk, 6, 'name', {two}, 'exact' from keys{suffix} where {long}),
raw_hits{suffix} as (select distinct nk, p, mt, c.* from look{suffix} join cand c on kind = 'name' and lk = canonical_name
  union select distinct nk, p, mt, c.* from look{suffix} join cand c on kind = 'ci' and lk = key_ci
  union select distinct nk, p, mt, c.* from look{suffix} join cand c on kind = 'norm' and lk = key_normalized),
first_hits{suffix} as (select * from raw_hits{suffix} qualify p = min(p) over (partition by nk)),
exact_hits{suffix} as ({pick(f'first_hits{suffix}', 'nk', 'mt')})"""


_NK = "cleaned||'|'||genus_only||'|'||coalesce(hybrid_name, '')||'|'||is_aggregate"
_N, _M = duck(i.NAMES), duck(i.MARKED)
_TT, _GT = duck(i.TRAIT_TABLE), duck(i.GROUP_TABLE)


def _genera(m: int, r: int) -> str:
    return duck(i.GENERA, m=m, r=r)


def _fuzzy(dist: str, block: str, where: str) -> str:
    """Pairs of open names and checklist names within a distance."""
    return f"""
with recursive {clean(_N)}, {backbone()}, {exact()},
open_names as (select distinct cleaned from cleaned_rows c left join exact_hits e on e.nk = {_NK} where e.nk is null and cleaned is not null and not genus_abbrev),
pairs as (select cleaned, name, {dist} d from open_names join (select distinct canonical_name name, genus from cand) on {block})
select cleaned, name, round(d, 6) fuzzy_dist from pairs where {where}"""


_GENUS, _PREFIX = "genus = split_part(cleaned, ' ', 1)", "lower(substr(name, 1, 2)) = lower(substr(cleaned, 1, 2))"
_LEV = "levenshtein(cleaned, name) / cast(greatest(length(cleaned), length(name)) as double)"
_DL = "damerau_levenshtein(cleaned, name) / cast(greatest(length(cleaned), length(name)) as double)"

_TRAITS = f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
a as (select canonical_name k, arg_min(plant_height_m, src_ord) v from ({_TT}) where canonical_name not like '% agg.' group by k),
ag as (select replace(canonical_name, ' agg.', '') k, arg_min(plant_height_m, src_ord) v from ({_TT}) where canonical_name like '% agg.' group by k),
b as (select upper(substr(p_name, 1, 1))||substr(p_name, 2) k, min(p_size * 2.0) v from part where p_partkey % 3 = 1 group by k),
c as (select upper(substr(p_name, 1, 1))||substr(p_name, 2) k, max(p_size + 0.0) v from part where p_partkey % 11 = 1 group by k),
t as (select accepted_name, cast(coalesce(a.v, ag.v) as double) diaz, cast(b.v as double) bien, cast(c.v as double) brot from n
  left join a on a.k = accepted_name left join ag on ag.k = accepted_name left join b on b.k = accepted_name left join c on c.k = accepted_name),
l as (select *, list_filter([diaz, bien, brot], lambda v: v is not null) vs,
  list_filter([case when diaz is not null then 'diaz' end, case when bien is not null then 'bien' end, case when brot is not null then 'brot' end], lambda v: v is not null) ss from t)
"""
_VOTE = f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
s as (select k, src, v from (
  select upper(substr(p_name, 1, 1))||substr(p_name, 2) k, 1 src, case min(p_size) % 3 when 0 then 'tree' when 1 then 'shrub' else null end v from part group by k
  union all select upper(substr(p_name, 1, 1))||substr(p_name, 2) k, 2, case max(p_size) % 2 when 0 then 'shrub' else 'herb' end from part group by k
  union all select upper(substr(p_name, 1, 1))||substr(p_name, 2) k, 3, case min(p_partkey) % 2 when 0 then 'herb' else 'tree' end from part group by k) where v is not null),
c as (select k, v, count(*) c, min(src) f from s group by all),
w as (select k, v from c qualify row_number() over (partition by k order by c desc, f) = 1)
select accepted_name, w.v growth_form, (select string_agg(['gift', 'austraits', 'bien'][src], ',' order by src) from s where s.k = accepted_name) growth_form_source,
  cast((select count(*) from s where s.k = accepted_name) as integer) growth_form_n from n left join w on w.k = accepted_name"""

_RESOLVED = f"""with recursive {clean(_N)}, {backbone()}, {exact()}"""
_REG = f"""
reg as (select g genus, kg kingdom_group, 'tg-'||kg taxon_group, 'lf-'||kg life_form from (select distinct upper(substr(p_name, 1, 1))||substr(split_part(p_name, ' ', 1), 2) g from part) join
  (select g h, case ascii(g) % 3 when 0 then 'plantae' when 1 then 'animalia' else 'fungi' end kg from (select distinct upper(substr(p_name, 1, 1))||substr(split_part(p_name, ' ', 1), 2) g from part)) on h = g
  union all select 'Zyzzyx', 'fungi', 'tg-fungi', 'lf-fungi')"""


def _chain() -> str:
    """Two checklists in order: exact, scope, abbreviations, fuzzy by genus, fuzzy by first letters."""
    edits = "damerau_levenshtein(cleaned, c.canonical_name)"
    dist = f"{edits} / cast(greatest(length(cleaned), length(c.canonical_name)) as double)"
    close = f"{edits} <= floor(0.2 * greatest(length(cleaned), length(c.canonical_name)) + 1e-9)"
    ctes = [clean(_N), _REG]
    ctes.append(f"""
names0 as (select nk, cleaned, min(row_idx) row_idx, any_value(genus_abbrev) ab from (select *, {_NK} nk from cleaned_rows where input_name is not null) group by nk, cleaned),
sp as (select distinct lower(split_part(cleaned, ' ', 1)) g from names0 where length(split_part(cleaned, ' ', 1)) > 1 and not contains(split_part(cleaned, ' ', 1), '.')),
known as (select distinct upper(substr(p_name, 1, 1))||substr(split_part(p_name, ' ', 1), 2) g from part),
outside as (select nk from names0 where split_part(cleaned, ' ', 1) in (select genus from reg) and split_part(cleaned, ' ', 1) not in (select g from known)),
open1 as (select * from names0)""")
    for b, where in (("1", "k % 2 = 0"), ("2", "k % 2 = 1")):
        own = lambda sql, b=b: re.sub(r"\b(bb|chase|ends|full_bb|cand)\b", rf"\g<1>{b}", sql)
        ctes += [own(backbone(where)), own(exact(suffix=b))]
        cand, left = f"cand{b}", f"left{b}"

        def fuzz(n: str, block: str, source: str, b: str = b, cand: str = cand) -> str:
            return f"""
pairs{n}{b} as (select cleaned, row_idx, c.*, {dist} d from (select cleaned, min(row_idx) row_idx from {source} group by cleaned) q join {cand} c on {block} where {close}),
near{n}{b} as ({pick(f'pairs{n}{b}', 'cleaned', 'd, row_idx')}),
fuzzy{n}{b} as (select * from near{n}{b} qualify d = 0 or row_number() over (partition by taxon_id order by d, row_idx) = 1)"""

        ctes.append(rf"""
hit{b} as (select o.nk, mt match_type, e.taxon_id, null d, is_ambiguous, ambiguous_targets from open{b} o join exact_hits{b} e on e.nk = o.nk),
{left} as (select * from open{b} where cleaned is not null and nk not in (select nk from hit{b}) and nk not in (select nk from outside)),
short0{b} as (select a.cleaned, c.*, lower(genus) in (select g from sp) listed from (select distinct cleaned from {left} where ab) a join {cand} c
  on lower(substr(genus, 1, 1)) = lower(substr(cleaned, 1, 1)) and lower(specific_epithet) = lower(regexp_extract(cleaned, '^\S+\s+(\S+)', 1))),
short{b} as (select * from short0{b} qualify listed or not bool_or(listed) over (partition by cleaned)),
abbr{b} as ({pick(f'short{b}', 'cleaned')}),
sure{b} as (select nk, a.* from {left} l join abbr{b} a on a.cleaned = l.cleaned and l.ab),
rest{b} as (select * from {left} where nk not in (select nk from sure{b} where not is_ambiguous)),
{fuzz('g', "c.genus = split_part(cleaned, ' ', 1)", f'rest{b}')},
more{b} as (select * from rest{b} where cleaned not in (select cleaned from fuzzyg{b})),
{fuzz('p', 'lower(substr(c.canonical_name, 1, 2)) = lower(substr(cleaned, 1, 2))', f'more{b}')},
done{b} as (select nk, match_type, taxon_id, d, is_ambiguous, ambiguous_targets from hit{b}
  union all select nk, 'abbrev', taxon_id, null, is_ambiguous, ambiguous_targets from sure{b} where not is_ambiguous
  union all select nk, 'fuzzy', f.taxon_id, d, is_ambiguous, ambiguous_targets from rest{b} r join fuzzyg{b} f on f.cleaned = r.cleaned
  union all select nk, 'fuzzy', f.taxon_id, d, is_ambiguous, ambiguous_targets from more{b} r join fuzzyp{b} f on f.cleaned = r.cleaned),
flag{b} as (select nk, ambiguous_targets from sure{b} where is_ambiguous and nk not in (select nk from done{b}))""")
        if b == "1":
            ctes.append("\nopen2 as (select * from names0 where nk not in (select nk from done1))")
    cols = "canonical_name, accepted_name, accepted_taxon_id, taxon_rank, accepted_family, accepted_genus, specific_epithet, authorship, accepted_authorship, is_synonym"
    ctes.append(f"""
done as (select d.*, 'wfo' backend, {cols} from done1 d join full_bb1 f using (taxon_id) union all select d.*, 'col', {cols} from done2 d join full_bb2 f using (taxon_id)),
out0 as (select c.row_idx, c.input_name, c.cleaned, c.is_hybrid, c.qualifier, c.qualifier_position, d.* exclude (nk, is_ambiguous, ambiguous_targets), {_NK} nk,
  case when d.nk is not null then d.is_ambiguous when f.nk is not null then true end is_ambiguous, coalesce(d.ambiguous_targets, case when d.nk is null then f.ambiguous_targets end) ambiguous_targets
  from cleaned_rows c left join done d on d.nk = {_NK} left join flag1 f on f.nk = {_NK}),
out1 as (select *, case when match_type is not null then match_type when input_name is null then null when nk in (select nk from outside) then 'out_of_scope' else 'none' end mt,
  case when match_type is not null then coalesce(nullif(accepted_genus, ''), split_part(canonical_name, ' ', 1)) else split_part(coalesce(nullif(cleaned, ''), trim(input_name)), ' ', 1) end g from out0)""")
    return f"""with recursive {', '.join(ctes)}
select row_idx, input_name, canonical_name matched_name, accepted_name, taxon_id, accepted_taxon_id accepted_id, lower(taxon_rank) "rank", accepted_family family, accepted_genus genus,
  specific_epithet epithet, authorship, accepted_authorship, is_synonym, is_hybrid, mt match_type, d fuzzy_dist, is_ambiguous, ambiguous_targets, backend, backend backbone_version,
  reg.kingdom_group, reg.taxon_group, reg.life_form, qualifier, qualifier_position from out1 left join reg on reg.genus = out1.g"""


def _inspect(bare: bool = False) -> str:
    """Labels of every name: register, spelling, ambiguity, range, group, case, synonymy; of ``bare`` names without any match."""
    start = f"with recursive {clean(_N)}, {backbone()}, {exact()}"
    hits = f"cleaned_rows c left join exact_hits e on e.nk = {_NK}"
    if bare:
        start, hits = "with recursive none0 as (select 1)", f"(select *, null::varchar mt, null::varchar accepted_name, null::boolean is_synonym, null::boolean is_ambiguous, null::varchar ambiguous_targets from ({_N})) c"
    flag = lambda when, name, tier, why: f"case when {when} then {{'n': '{name}', 't': {tier}, 'w': {why}}} end"
    q = "chr(39)"
    flags = ", ".join(
        (
            flag("unknown", "unknown", 3, f"'genus '||{q}||tok||{q}||' is not in the register'"),
            flag("spelling is not null", "near_duplicate", 2, f"'near-duplicate of more frequent '||{q}||spelling||{q}"),
            flag("is_ambiguous", "ambiguous", 2, "coalesce('ambiguous (targets: '||ambiguous_targets||')', 'ambiguous match')"),
            flag("away", "out_of_range", 2, f"'range outside the list'||{q}||'s main area ('||array_to_string(a, ', ')||')'"),
            flag("top is not null and not unknown", "outlier_group", 2, "kg||' outlier (list is mostly '||top||')'"),
            flag("mt = 'exact_ci'", "case", 1, "'case mismatch'"),
            flag("m and is_synonym", "synonym", 1, "'outdated synonym'"),
        )
    )
    return rf"""
{start}, {_REG},
r0 as (select row_idx, input_name, coalesce(mt, 'none') mt, accepted_name, is_synonym, is_ambiguous, ambiguous_targets, nullif(split_part(regexp_replace(input_name, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), ' ', 1), '') tok,
  lower(trim(regexp_replace(input_name, '\s+', ' ', 'g'))) key from {hits} where input_name is not null),
r1 as (select r0.*, reg.kingdom_group kg, mt = 'none' and tok is not null and reg.genus is null unknown, mt <> 'none' m from r0 left join reg on reg.genus = tok),
x as (select key k, input_name x, count(*) c from r1 where key <> '' group by all),
u as (select k, sum(c) n, arg_min(x, (-c, x)) spelling from x group by k having length(k) >= 5),
p as (select a.k, b.n, b.spelling, b.k k2, levenshtein(a.k, b.k) d from u a join u b on a.k <> b.k and b.n > a.n and abs(length(a.k) - length(b.k)) <= 2),
dup as (select k, spelling from p where d between 1 and 2 and d / least(length(k), length(k2)) <= 0.25 qualify row_number() over (partition by k order by n desc, k2) = 1),
kn as (select kg, count(*) n from r1 where not unknown and kg is not null and kg not in ('', 'unknown') group by kg),
kt as (select sum(n) al, arg_min(kg, (-n, kg)) top, max(n) most, count(*) k from kn),
odd as (select kg, top from kn, kt where al >= 4 and k > 1 and most / al >= 0.7 and n <= greatest(1, floor(al * 0.1)) and kg <> top),
cont as (select canonical_name an, list_sort(list_distinct(list(level1_code))) cs from ({duck(i.RANGES)}) join ({duck(i.REGIONS)}) on code = tdwg_code where native_status is not null group by 1),
pl as (select row_idx, cs from r1 join cont on an = accepted_name where m),
t as (select count(*) al, ceil(count(*) * 0.8) target from pl),
g1 as (select c, count(*) n from (select unnest(cs) c from pl) group by c order by n desc, c limit 1),
g2 as (select c, count(*) n from (select unnest(cs) c from pl where not list_contains(cs, (select c from g1))) group by c order by n desc, c limit 1),
area as (select case when al < 4 then [] when (select n from g1) >= target then [(select c from g1)] when (select n from g1) + coalesce((select n from g2), 0) >= target then [(select c from g1), (select c from g2)] else [] end a from t),
f as (select r1.*, dup.spelling, odd.top, cs, a, case when len(a) > 0 then m and len(cs) > 0 and not list_has_any(cs, a) else false end away from r1 left join dup on dup.k = r1.key left join odd on odd.kg = r1.kg left join cont on an = accepted_name, area),
l as (select *, list_filter([{flags}], lambda z: z is not null) fs from f)
select input_name, case when m then accepted_name else spelling end suggestion, array_to_string(list_transform(fs, lambda z: z.n), '|') anomalies,
  ['note', 'review', 'unresolved'][list_max(list_transform(fs, lambda z: z.t))] tier, list_max(list_transform(fs, lambda z: z.t)) tier_rank,
  array_to_string(list_transform(fs, lambda z: z.w), '; ') reason, cast(null as double) fuzzy_dist, {"null::varchar" if bare else "'wfo'"} backend from l where len(fs) > 0"""


_GEN_ALL = f"""a as (select 1 p, * from ({_genera(3, 0)}) union all select 2, * from ({_genera(3, 1)}) union all select 3, * from ({_genera(3, 2)})),
f0 as (select genus, (select min((p, kingdom)) from a b where b.genus = a.genus and kingdom <> '') k, (select min((p, family)) from a b where b.genus = a.genus and family <> '') fa from (select distinct genus from a) a),
f1 as (select genus, case when k[2] = 'Metazoa' then 'Animalia' when k[2] like '%virae' then 'Viruses' else k[2] end kingdom, fa[2] family from f0),
f2 as (select f1.*, case kingdom when 'Animalia' then 'animalia' when 'Viruses' then 'viruses' end kk, b.* exclude (family), case kingdom when 'Animalia' then 'animal' end tt from f1 left join ({duck(i.FAMILIES)}) b on b.family = f1.family),
lf as (select genus, kingdom, family, coalesce(kingdom_group, kk, 'unknown') kingdom_group, coalesce(taxon_group, tt, 'unknown') taxon_group, coalesce(life_form, replace(coalesce(taxon_group, tt, 'unknown'), '_', ' ')) life_form from f2)"""

_POINTS = """
with p as (select c_custkey point_id, (c_custkey * 37 % 3600) / 10.0 - 180 lon, (c_custkey * 53 % 1800) / 10.0 - 90 lat from customer),
f as (select n_nationkey i, 'N'||cast(n_nationkey as string) code, n_nationkey % 5 * 60 - 170.05 x, n_nationkey // 5 * 30 - 80.05 y from nation)
select point_id, (select code from f where lon > x and lon < x + 70 and lat > y and lat < y + 35 and abs(lon - x - 35) + abs(lat - y - 17.5) < 45 and not (lon > x + 20 and lon < x + 30 and lat > y + 10 and lat < y + 20)
  and lon - x + lat - y > 7.5 and lon - x + lat - y < 97.5 order by i limit 1) code from p"""

ORACLES: dict[str, str] = {
    "clean_names": f"with {clean(_N)} select * from cleaned_rows",
    "clean_marked": f"with {clean(f'select row_idx, input_name from ({_M})')} select * from cleaned_rows",
    "normalize_epithets": f"select row_idx, {norm('input_name')} as key from ({duck(i.WHOLE_TEXTS)})",
    "normalize_epithets_all": f"select source, row_idx, {norm('input_name')} as key from (select 'name' source, * from ({duck(i.NAMES)}) union all select 'text', * from ({duck(i.WHOLE_TEXTS)}))",
    "normalize_aggregate": rf"""
with m as (select *, '(?i)[ -](aggr?\.?|s\.\s*l\.?|sensu\s+lato|coll\.?(\s*sp(ecies)?\.?)?)$' p from ({_M})),
o as (select *, case when regexp_matches(input_name, p) then regexp_replace(input_name, '(?i)[ -](aggr?\.?|s\.\s*l\.?|sensu\s+lato|coll\.?(\s*sp(ecies)?\.?)?)$', '')||' aggr.' else input_name end x from m)
select row_idx, case when upper(taxon_rank) = 'SPECIES AGGREGATE' and not regexp_matches(x, '(?i)[ -](aggr?\.?|s\.\s*l\.?|sensu\s+lato|coll\.?(\s*sp(ecies)?\.?)?)$') then x||' aggr.' else x end name, regexp_matches(input_name, p) marked from o""",
    "hybrid_parents": rf"""
with h as (select row_idx, trim(regexp_replace(replace(input_name, '×', ' x '), '\s+', ' ', 'g')) h from ({_M})),
k as (select *, string_split(h, ' ') t, list_position(list_transform(string_split(h, ' '), lambda x: lower(x)), 'x') p from h),
j as (select *, case when p = 1 and regexp_matches(t[2], '^[A-Z]') then 'nothogenus' when p = 2 and regexp_matches(t[1], '^[A-Z]') and regexp_matches(t[3], '^[a-z]') then 'nothospecies'
  when p >= 3 and p < len(t) and regexp_matches(t[1], '^[A-Z]') and regexp_matches(t[p+1], '^[A-Z]') then 'formula' end kind from k)
select row_idx, kind hybrid_type, case when kind = 'formula' then array_to_string(t[1:p-1], ' ') end parent_1,
  case when kind = 'formula' then array_to_string(list_concat([case when regexp_matches(t[p+1], '^[A-Z]\.$') then t[1] else t[p+1] end], t[p+2:]), ' ') end parent_2 from j""",
    "precompute_keys": f"select taxon_id, lower(canonical_name) key_ci, {norm('canonical_name')} key_normalized, genus||' '||specific_epithet key_species, lower(genus)||':'||lower(substr(specific_epithet, 1, 2)) fuzzy_block from ({duck(i.BACKBONE)})",
    "embed_accepted": f"with recursive {backbone()} select taxon_id, accepted_taxon_id, accepted_name, accepted_family, accepted_genus, accepted_authorship, is_synonym from full_bb",
    "pick_best": f"with recursive {backbone()} {pick('cand', 'canonical_name')}".replace("canonical_name matched_name, ", ""),
    "exact_cascade": f"{_RESOLVED} select row_idx, mt match_type, taxon_id, matched_name, accepted_name, accepted_id, is_synonym, is_ambiguous, ambiguous_targets from cleaned_rows c join exact_hits e on e.nk = {_NK}",
    "fuzzy_levenshtein": _fuzzy(_LEV, _GENUS, "d <= 0.2"),
    "fuzzy_dl": _fuzzy(_DL, _GENUS, "d <= 0.2"),
    "fuzzy_dl_prefix": _fuzzy(_DL, _PREFIX, "d <= 0.2"),
    "fuzzy_edits": _fuzzy(_DL, _GENUS, "damerau_levenshtein(cleaned, name) <= 2"),
    "fuzzy_jaro_winkler": _fuzzy("case when cleaned = name then 0 else 1 - jaro_winkler_similarity(cleaned, name) end", _GENUS, "d <= 0.1"),
    "fuzzy_dedup": "select l_partkey row_idx, taxon_id, fuzzy_dist from (select *, row_number() over (partition by taxon_id order by fuzzy_dist, l_partkey) rn from (select l_partkey, 'p'||cast(l_partkey % 17 as string) taxon_id, cast(min(l_linenumber) - 1 as double) / 8 fuzzy_dist from lineitem group by l_partkey)) where fuzzy_dist = 0 or rn = 1",
    "abbreviated_genus": rf"""
{_RESOLVED}, a as (select distinct cleaned from cleaned_rows where genus_abbrev),
sp as (select distinct lower(split_part(cleaned, ' ', 1)) g from cleaned_rows where length(split_part(cleaned, ' ', 1)) > 1 and not contains(split_part(cleaned, ' ', 1), '.')),
h0 as (select a.cleaned, c.*, lower(genus) in (select g from sp) listed from a join cand c on lower(substr(genus, 1, 1)) = lower(substr(cleaned, 1, 1)) and lower(specific_epithet) = lower(regexp_extract(cleaned, '^\S+\s+(\S+)', 1))),
h as (select * from h0 qualify listed or not bool_or(listed) over (partition by cleaned)) {pick('h', 'cleaned')}""",
    "enrich_species": f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
t as (select canonical_name k, arg_min(growth_form, src_ord) g, arg_min(seed_mass_mg, src_ord) s from ({_TT}) where canonical_name not like '% agg.' group by k),
a as (select replace(canonical_name, ' agg.', '') k, arg_min(growth_form, src_ord) g, arg_min(seed_mass_mg, src_ord) s from ({_TT}) where canonical_name like '% agg.' group by k)
select accepted_name, case when t.k is not null then t.g else a.g end growth_form, round(case when t.k is not null then t.s else a.s end, 2) seed_mass_mg,
  case when t.k is not null then false when a.k is not null then true end inherited from n left join t on t.k = accepted_name left join a on a.k = accepted_name""",
    "enrich_genus": f"""
with n as (select distinct taxon_id, genus from ({duck(i.BACKBONE)})),
t as (select genus, arg_min(family, k) lead_family from ({duck(i.BACKBONE)}) where k % 5 = 1 group by genus) select taxon_id, genus, lead_family from n left join t using (genus)""",
    "enrich_grouped": f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
g as (select canonical_name k, country_code c, arg_min(invasive_status, src_ord) v from ({_GT}) where country_code is not null group by all)
select accepted_name, any_value(v) filter (c = 'AT') "invasive_status_AT", any_value(v) filter (c = 'DE') "invasive_status_DE", cast(null as varchar) "invasive_status_XX"
from n left join g on k = accepted_name group by accepted_name""",
    "unpivot_long": f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
g as (select canonical_name k, country_code c, arg_min(invasive_status, src_ord) v from ({_GT}) where country_code is not null group by all)
select accepted_name, t.c country_code, v invasive_status from n cross join (values ('AT'), ('DE'), ('FR')) t(c) join g on g.k = accepted_name and g.c = t.c where v is not null""",
    "info_door": f"with b as ({duck(i.BACKBONE)}) select l_orderkey * 10 + l_linenumber row_idx, case when l_orderkey % 2 = 0 then b.nomenclaturalStatus end wfo_status from lineitem left join b on b.k = l_partkey",
    "trait_wide": f"{_TRAITS} select accepted_name, diaz plant_height_diaz, bien plant_height_bien, brot plant_height_brot from t",
    "trait_median": f"{_TRAITS} select accepted_name, median(v) plant_height, any_value(nullif(array_to_string(ss, ','), '')) plant_height_source, cast(any_value(len(vs)) as integer) plant_height_n from (select *, unnest(case when len(vs) = 0 then [null] else vs end) v from l) group by accepted_name",
    "trait_mean": f"{_TRAITS} select accepted_name, round(list_sum(vs) / len(vs), 6) plant_height, nullif(array_to_string(ss, ','), '') plant_height_source, cast(len(vs) as integer) plant_height_n from l",
    "trait_first": f"{_TRAITS} select accepted_name, vs[1] plant_height, ss[1] plant_height_source, cast(len(vs) as integer) plant_height_n from l",
    "trait_vote": _VOTE,
    "range_sets": f"select canonical_name accepted_name, bool_or(tdwg_code in ('N1', 'N2', 'N3') and coalesce(native_status = 'native', false)) present, true has_data from ({duck(i.RANGES)}) group by 1",
    "region_filter": f"""
with r as (select canonical_name accepted_name, bool_or(tdwg_code in ('N1', 'N2', 'N3') and native_status is not null) present from ({duck(i.RANGES)}) group by 1),
c as (select l_orderkey row_idx, upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from lineitem join part on l_partkey = p_partkey),
j as (select *, coalesce(not present, false) away from c left join r using (accepted_name))
select row_idx, accepted_name from (select *, bool_and(away) over (partition by row_idx) al from j) where not away or al""",
    "region_tokens": f"select code from ({duck(i.REGIONS)}) where lower(level1_name) = 'europe' or lower(name) = 'nation_7' or code = 'N3' or lower(level2_code) = 'l2-1'",
    "range_continents": f"select canonical_name accepted_name, array_to_string(list_sort(list_distinct(list(level1_code))), ',') continents from ({duck(i.RANGES)}) join ({duck(i.REGIONS)}) on code = tdwg_code where native_status is not null group by 1",
    "points_in_polygons": _POINTS,
    "register_resolve": f"""
with a as (select 1 p, * from ({_genera(3, 0)}) union all select 2, * from ({_genera(3, 1)}) union all select 3, * from ({_genera(3, 2)})),
f as (select genus, (select min((p, kingdom)) from a b where b.genus = a.genus and kingdom <> '') k, (select min((p, phylum)) from a b where b.genus = a.genus and phylum <> '') ph,
  (select min((p, class)) from a b where b.genus = a.genus and class <> '') c, (select min((p, family)) from a b where b.genus = a.genus and family <> '') fa from (select distinct genus from a) a)
select genus, case when k[2] = 'Metazoa' then 'Animalia' when k[2] like '%virae' then 'Viruses' else k[2] end kingdom, ph[2] phylum, c[2] "class", fa[2] family from f""",
    "kingdom_majority": "with n as (select c_nationkey, c_mktsegment, count(*) c from customer group by all) select c_nationkey, c_mktsegment top_segment from n qualify row_number() over (partition by c_nationkey order by c desc, c_mktsegment) = 1",
    "kingdom_walk": f"""
with t as ({duck(i.TAXA)}), g as (select t.canonical_name genus, case k.canonical_name when 'Plantae' then 'plantae' when 'Animalia' then 'animalia' when 'Fungi' then 'fungi' when 'Bacteria' then 'bacteria' end kg
  from t join t f on f.taxon_id = t.parent_key join t k on k.taxon_id = f.parent_key where t.taxon_rank = 'GENUS'),
v as (select genus, kg, count(*) c from g where kg is not null group by all),
w as (select genus, kg from v qualify row_number() over (partition by genus order by c desc, kg) = 1)
select genus, coalesce(kg, 'unknown') kingdom_group from (select distinct genus from g) left join w using (genus)""",
    "coverage": f"select distinct genus, case k % 2 when 0 then 'wfo' else 'col' end backend from ({duck(i.BACKBONE)})",
    "near_duplicates": """
with x as (select case when c_custkey % 10 = 0 then n_name||'x' when c_custkey % 10 = 1 then substr(n_name, 1, 2)||substr(n_name, 4) else n_name end x from customer join nation on c_nationkey = n_nationkey),
k as (select lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) k, x, count(*) c from x group by all),
u as (select k, sum(c) n, arg_min(x, (-c, x)) spelling from k group by k),
p as (select a.k, b.n, b.spelling, b.k k2, levenshtein(a.k, b.k) d from u a join u b on a.k <> b.k and b.n > a.n and least(length(a.k), length(b.k)) >= 5)
select k as key, spelling suggestion from p where d <= 2 and d / least(length(k), length(k2)) <= 0.25 qualify row_number() over (partition by k order by n desc, k2) = 1""",
    "outlier_groups": "with n as (select case when c_custkey % 40 = 0 then 'fungi' when c_custkey % 30 = 1 then 'animalia' else 'plantae' end kingdom_group, count(*) c from customer group by 1) select kingdom_group, 'plantae' dominant from n where kingdom_group <> 'plantae' and c <= greatest(1, floor(0.1 * (select sum(c) from n)))",
    "match_tally": f"{_RESOLVED} select coalesce(mt, case when input_name is null then 'missing' else 'none' end) match_type, count(*) n from cleaned_rows c left join exact_hits e on e.nk = {_NK} group by 1",
    "window_tally": "select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n from events group by all",
    "session_tally": """
with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end s from events),
g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) g from o)
select user_id, min(ts) session_start, max(ts) + interval 30 minute session_end, count(*) n from g group by user_id, g""",
    "stream_resolve": f"{_RESOLVED} select row_idx, case when input_name is not null then coalesce(mt, 'none') end match_type, taxon_id from cleaned_rows c left join exact_hits e on e.nk = {_NK}",
    "stream_resolve_all": f"{_RESOLVED} select row_idx, case when input_name is not null then coalesce(mt, 'none') end match_type, taxon_id from cleaned_rows c left join exact_hits e on e.nk = {_NK}",
    "stream_window_tally": "select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n from events group by all",
    "qualifiers": rf"""
with m as ({_M}) select row_idx, case when regexp_matches(input_name, '^[Cc][Ff]\.?\s') then 'cf.' else nullif(regexp_extract(input_name, '\b((?:{_Q})\.?)(?:\s|$)', 1), '') end qualifier,
  case when regexp_matches(input_name, '^[Cc][Ff]\.?\s') then 1 when regexp_matches(input_name, '\b(?:{_Q})\.?(?:\s|$)') then length(regexp_extract(input_name, '^(.*?)\b(?:{_Q})\.?(?:\s|$)', 1)) + 1 end place,
  regexp_replace(input_name, '\b(?:{_Q})\.?(\s|$)', ' \1', 'g') stripped from m""",
    "extract_genera": f"select genus, arg_min(family, taxon_id) family from ({duck(i.BACKBONE)}) where taxon_rank = 'SPECIES' and taxonomic_status = 'ACCEPTED' group by genus",
    "genus_coverage": f"with b as ({duck(i.BACKBONE)}) select distinct genus, be backend from b join (values ('wfo', 2, 0), ('col', 7, 1)) v(be, m, r) on k % m = r where genus in (select genus from b where k % 3 = 1)",
    "family_kingdom": """
with g as (select c_name genus, cast(c_nationkey as varchar) family, case when c_custkey % 3 <> 0 then c_mktsegment end kingdom from customer),
v as (select family, kingdom, count(*) c from g where kingdom is not null group by all), w as (select family, kingdom k from v qualify row_number() over (partition by family order by c desc, kingdom) = 1)
select genus, family, coalesce(kingdom, k) kingdom from g left join w using (family)""",
    "profile_flags": f"select taxon_id, case when k % 3 = 1 then k % 2 = 0 end is_extinct from ({duck(i.BACKBONE)})",
    "scope_tally": "select coalesce(case when c_custkey % 5 <> 0 then c_mktsegment end, 'unknown') taxon_group, 'wfo' backend, count(*) n from customer where c_custkey % 4 = 2 group by 1",
    "taxon_tally": "select coalesce(case when c_custkey % 5 <> 0 then c_mktsegment end, 'unknown') taxon_group, count(*) n, count(*) filter (c_custkey % 4 in (1, 2)) n_unmatched from customer group by 1",
    "provenance": "select count(*) filter (c_custkey % 5 <> 0) n_matched, count(*) filter (c_custkey % 4 <> 1) n_total from customer",
    "coordinates": "select c_custkey point_id, cast(c_custkey % 400 - 200 as double) lon, cast(c_custkey % 190 - 95 as double) lat from customer where c_custkey % 400 - 200 between -180 and 180 and c_custkey % 190 - 95 between -90 and 90",
    "data_conflicts": "select p_name as key, count(*) n_rows, count(distinct p_size) n_distinct from part group by 1 having count(distinct p_size) > 1",
    "resolve_chain": _chain(),
    "inspect_report": _inspect(),
    "inspect_review": f"select * from ({_inspect()}) where tier_rank >= 2",
    "catalog": "select version, p_partkey, case when version = '9' then p_name else lower(p_type) end p_name from part, (values ('9'), ('10')) t(version)",
    "kingdom_patterns": "select c_custkey, case c_custkey % 5 when 1 then 'Bacteria' when 4 then null else 'Viruses' end kingdom from customer",
    "fuzzy_pick": f"""
with recursive {clean(_N)}, {backbone()}, {exact()},
open_names as (select cleaned, min(row_idx) row_idx from cleaned_rows c left join exact_hits e on e.nk = {_NK} where e.nk is null and cleaned is not null and not genus_abbrev group by cleaned),
pairs as (select cleaned, row_idx, c.*, damerau_levenshtein(cleaned, canonical_name) / cast(greatest(length(cleaned), length(canonical_name)) as double) d from open_names join cand c on genus = split_part(cleaned, ' ', 1)),
close as (select * from pairs where d <= 0.2), near as ({pick('close', 'cleaned', 'd, row_idx')})
select cleaned, taxon_id, matched_name, accepted_name, accepted_id, is_synonym, round(d, 6) fuzzy_dist, is_ambiguous, ambiguous_targets from near qualify d = 0 or row_number() over (partition by taxon_id order by d, row_idx) = 1""",
    "region_candidates": f"""
with recursive {clean(_N)}, {backbone()}, {exact()},
open_names as (select distinct cleaned from cleaned_rows c left join exact_hits e on e.nk = {_NK} where e.nk is null and cleaned is not null and not genus_abbrev),
pr as (select cleaned, name, round(d, 6) fuzzy_dist from (select cleaned, name, {_DL} d from open_names join (select distinct canonical_name name from cand) on {_PREFIX}) where d <= 0.2),
best as ({pick('cand', 'canonical_name')}),
rs as (select canonical_name an, bool_or(tdwg_code in ('N1', 'N2', 'N3') and coalesce(native_status = 'introduced', false)) present from ({duck(i.RANGES)}) group by 1),
j as (select pr.*, coalesce(not present, false) away from pr join best on matched_name = name left join rs on an = accepted_name)
select cleaned, name, fuzzy_dist from (select *, bool_and(away) over (partition by cleaned) al from j) where not away or al""",
    "range_introduced": f"select canonical_name accepted_name, bool_or(tdwg_code in ('N1', 'N6', 'N11') and coalesce(native_status = 'introduced', false)) present, true has_data from ({duck(i.RANGES)}) group by 1",
    "region_search": f"select code, name, level1_name from ({duck(i.REGIONS)}) where contains(lower(code||' '||name||' '||level2_code||' '||level2_name||' '||level1_code||' '||level1_name), 'asia')",
    "register_lookup": f"""
{_RESOLVED}, {_REG}, o as (select row_idx, case when mt is not null then coalesce(nullif(b.accepted_genus, ''), split_part(e.matched_name, ' ', 1)) else split_part(coalesce(nullif(cleaned, ''), trim(input_name)), ' ', 1) end g
  from cleaned_rows c left join exact_hits e on e.nk = {_NK} left join full_bb b on b.taxon_id = e.taxon_id)
select row_idx, kingdom_group, taxon_group, life_form from o left join reg on reg.genus = o.g""",
    "out_of_scope": f"""
{_RESOLVED}, {_REG} select distinct input_name from cleaned_rows c left join exact_hits e on e.nk = {_NK} where e.nk is null and input_name is not null
  and split_part(cleaned, ' ', 1) in (select genus from reg) and split_part(cleaned, ' ', 1) not in (select genus from bb)""",
    "life_form": f"with {_GEN_ALL} select genus, family, kingdom_group, taxon_group, life_form from lf",
    "register_build": f"""
with {_GEN_ALL},
g1 as (select *, coalesce(case kingdom when 'Animalia' then 'animalia' when 'Viruses' then 'viruses' end, kingdom_group) kg from lf),
g2 as (select *, coalesce(kingdom, case kg when 'plantae' then 'Plantae' when 'animalia' then 'Animalia' when 'viruses' then 'Viruses' end) kd from g1),
v as (select family, kd, count(*) c from g2 where kd is not null and family is not null group by all), w as (select family, kd k from v qualify row_number() over (partition by family order by c desc, kd) = 1)
select genus, coalesce(kd, k) kingdom, g2.family, case when kg = 'unknown' then coalesce(case coalesce(kd, k) when 'Plantae' then 'plantae' when 'Animalia' then 'animalia' when 'Viruses' then 'viruses' end, 'unknown') else kg end kingdom_group, taxon_group, life_form
from g2 left join w on w.family = g2.family""",
    "doors": f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
t as (select canonical_name k, arg_min(seed_mass_mg, src_ord) m, arg_min(growth_form, src_ord) g from ({_TT}) where canonical_name not like '% agg.' group by k),
a as (select replace(canonical_name, ' agg.', '') k, arg_min(seed_mass_mg, src_ord) m, arg_min(growth_form, src_ord) g from ({_TT}) where canonical_name like '% agg.' group by k),
h as (select genus, min(family) habit from ({duck(i.BACKBONE)}) group by genus),
c as (select canonical_name k, country_code c, arg_min(invasive_status, src_ord) v from ({_GT}) where country_code is not null group by all)
select accepted_name, split_part(accepted_name, ' ', 1) genus, round(case when t.k is not null then t.m else a.m end, 2) avonet_body_mass_g, case when t.k is not null then t.g else a.g end trophic_niche, habit,
  (select v from c where c.k = accepted_name and c = 'AT') "invasive_status_AT", (select v from c where c.k = accepted_name and c = 'FR') "invasive_status_FR"
from n left join t on t.k = accepted_name left join a on a.k = accepted_name left join h on h.genus = split_part(accepted_name, ' ', 1)""",
    "trait_min": f"{_TRAITS} select accepted_name, list_min(vs) plant_height, nullif(array_to_string(ss, ','), '') plant_height_source, cast(len(vs) as integer) plant_height_n from l",
    "trait_max": f"{_TRAITS} select accepted_name, list_max(vs) plant_height, nullif(array_to_string(list_filter([case when brot is not null then 'brot' end, case when bien is not null then 'bien' end, case when diaz is not null then 'diaz' end], lambda v: v is not null), ','), '') plant_height_source, cast(len(vs) as integer) plant_height_n from l",
    "trait_units": f"""
with n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
t as (select replace(canonical_name, ' agg.', '') k, min(seed_mass_mg) a, max(seed_mass_mg) b from ({_TT}) where canonical_name is not null group by 1)
select accepted_name, round(a, 3) diaz, round(b, 3) gift from n left join t on k = accepted_name""",
    "add_data": f"""
with recursive {clean(f"select row_idx, input_name from (select row_number() over () row_idx, species input_name from ({duck(i.OWN_DATA)}))")}, {backbone()}, {exact()},
own as (select species, size, family from ({duck(i.OWN_DATA)})),
d as (select distinct accepted_id, size, family from own join cleaned_rows c on c.input_name = species join exact_hits e on e.nk = {_NK}),
e as ({pick('cand', 'canonical_name')}),
tgt as (select e.accepted_id, min(e.accepted_name) accepted_name, min(b.accepted_family) family from e join full_bb b on b.taxon_id = e.taxon_id group by 1)
select tgt.*, d.size, d.family data_family from tgt left join d on d.accepted_id = tgt.accepted_id""",
    "add_data_grouped": f"""
with recursive {backbone()}, b as ({pick('cand', 'canonical_name')}),
n as (select distinct upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name from part),
o as (select upper(substr(p_name, 1, 1))||substr(p_name, 2) k, case p_partkey % 3 when 0 then 'AT' when 1 then 'DE' end c, max(p_size) v from part group by all),
g as (select b.accepted_name an, c, min(v) v from o join b on b.matched_name = o.k where c is not null group by all)
select accepted_name, (select v from g where an = accepted_name and c = 'AT') "top_size_AT", (select v from g where an = accepted_name and c = 'DE') "top_size_DE" from n""",
    "text_files": "select file, cast(n_nationkey as bigint) n_nationkey, n_name from nation, (values ('csv'), ('tsv')) t(file)",
    "delta_versions": f"""
with o as ({duck(i.BACKBONE_BEFORE)}), n as ({duck(i.BACKBONE)})
select case when o.taxon_id is null then 'insert' when n.taxon_id is null then 'delete' else 'update' end op, coalesce(n.taxon_id, o.taxon_id) taxon_id, n.canonical_name, n.taxonomic_status
from o full join n on o.taxon_id = n.taxon_id where o.taxon_id is null or n.taxon_id is null or (o.canonical_name, o.taxonomic_status) is distinct from (n.canonical_name, n.taxonomic_status)""",
    "delta_index": f"with recursive {backbone()} "
    + " union all ".join(f"select '{kind}' kind, {key} as key, * exclude ({key}) from ({pick('cand', key)})" for kind, key in (("ci", "key_ci"), ("norm", "key_normalized")))
    + f" union all select 'name', name, * exclude (name) from ({pick('(select *, canonical_name as name from cand)', 'name')})",
    "stream_fuzzy_dedup": "select l_partkey row_idx, taxon_id, fuzzy_dist from (select *, row_number() over (partition by taxon_id order by fuzzy_dist, l_partkey) rn from (select l_partkey, 'p'||cast(l_partkey % 17 as string) taxon_id, cast(min(l_linenumber) - 1 as double) / 8 fuzzy_dist from lineitem group by l_partkey)) where fuzzy_dist = 0 or rn = 1",
    "stream_match_rates": f"""
with recursive {clean(duck(i.EVENT_NAMES))}, {backbone()}, {exact()},
m as (select row_idx, mt is not null hit from cleaned_rows c left join exact_hits e on e.nk = {_NK})
select time_bucket(interval 1 hour, ts) window_start, count(*) n, count(*) filter (event_id % 7 <> 0 and event_id % 90 <= 60 and hit) n_matched,
  count(*) filter (event_id % 7 <> 0 and event_id % 90 <= 60 and hit) / count(*) rate from events join m on row_idx = event_id group by 1""",
    "inspect_names": _inspect(bare=True),
    "enrichment_ladder": """
select accepted_name, cast(most as double) newest, cast(least as double) pinned, cast(most + 1 as double) fetched, cast(least + 1 as double) built, cast(most + least as double) in_memory, cast(null as double) missing
from (select upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name, min(p_size) least, max(p_size) most from part group by 1)""",
    "spreadsheets": "select p_partkey, round(p_retailprice, 2) price, upper(substr(p_name, 1, 1))||substr(p_name, 2) as name, cast(case when p_size % 3 <> 0 then p_size end as bigint) size from part",
    "points_in_files": _POINTS,
    "region_union": f"""
with pts as ({_POINTS}), near as (select distinct code from pts where code is not null and (point_id * 37 % 3600 / 10.0 - 180) between 0 and 60),
codes as (select code from near union select code from ({duck(i.REGIONS)}) where lower(level1_name) = 'asia')
select canonical_name accepted_name, bool_or(tdwg_code in (select code from codes) and native_status is not null) present, true has_data from ({duck(i.RANGES)}) group by 1""",
    "trait_provenance": f"""{_TRAITS}, own as (select distinct canonical_name k from ({_TT}) where canonical_name is not null and canonical_name not like '% agg.'),
pr as (select accepted_name, diaz, bien, brot, case when diaz is not null then accepted_name not in (select k from own) end d, case when bien is not null then false end b, case when brot is not null then false end r from t)
select accepted_name, d plant_height_diaz_inherited, b plant_height_bien_inherited, case when d or b or r then true else coalesce(d, b, r) end inherited from pr""",
    "stream_chain": _chain(),
    "door_defaults": "select upper(substr(p_name, 1, 1))||substr(p_name, 2) accepted_name, min(p_type) gift_woodiness_1, cast(max(p_size) as double) gift_plant_height_max from part group by 1",
}
ORACLES["long_logged"] = ORACLES["unpivot_long"]
