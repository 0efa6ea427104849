"""Tallies of a resolution, and citations of what went into it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_tally(result: DataFrame) -> DataFrame:
    return result.groupBy(F.coalesce("match_type", F.lit("missing")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


def scope_tally(result: DataFrame, backend: str) -> DataFrame:
    """Names out of scope by taxon group."""
    return result.filter("match_type = 'out_of_scope'").groupBy(F.coalesce("taxon_group", F.lit("unknown")).alias("taxon_group"), F.lit(backend).alias("backend")).agg(F.count(F.lit(1)).alias("n"))


def taxon_tally(result: DataFrame) -> DataFrame:
    """Names and unmatched names per taxon group, largest first."""
    out = result.filter("input_name is not null").groupBy(F.coalesce("taxon_group", F.lit("unknown")).alias("taxon_group"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("match_type").isin("none", "out_of_scope")).alias("n_unmatched")).orderBy(F.desc("n"), "taxon_group")


def summary(result: DataFrame, meta: dict) -> str:
    """A few lines for people; reads two small aggregates: matches, and hits of all logged enrichments at once."""
    log = [dict(e) for e in meta.get("enrichments", [])]
    todo = [(k, [c for c in e.get("columns", []) if c in result.columns]) for k, e in enumerate(log) if "n_matched" not in e]
    if todo:
        hits = [F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()).alias(f"e{k}") if cols else F.lit(0).alias(f"e{k}") for k, cols in todo]
        counts = result.agg(F.count("matched_name" if "matched_name" in result.columns else F.lit(1)).alias("n"), *hits).first()
        for k, _ in todo:
            log[k] |= {"n_matched": counts[f"e{k}"], "n_total": counts["n"]}
    tally = {r[0]: r[1] for r in match_tally(result).collect()}
    total = sum(tally.values())
    lines = [f"{total} names against {', '.join(meta.get('backends', []))}"]
    lines += [f"  {k}: {tally[k]}" for k in sorted(tally, key=lambda k: (-tally[k], k))]
    lines += [f"  + {e['name']} {e.get('version') or ''}: {e['n_matched']} of {e['n_total']}" for e in log]
    return "\n".join(lines)


def clean_citation(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().rstrip(".") + "."


def format_citation(c: dict) -> str:
    """A reference as text from the fields of a sidecar."""
    authors = c.get("authors") or ""
    authors = "; ".join(authors) if isinstance(authors, list) else authors
    where = " ".join(str(c[k]) for k in ("journal", "volume") if c.get(k)) + (f": {c['pages']}" if c.get("pages") else "")
    parts = [f"{authors} ({c['year']})" if c.get("year") else authors, c.get("title"), where, f"https://doi.org/{c['doi']}" if c.get("doi") else None]
    return clean_citation(". ".join(p for p in parts if p))


def format_bibtex(c: dict) -> str:
    authors = c.get("authors") or ""
    fields = {"author": " and ".join(authors) if isinstance(authors, list) else authors} | {k: c.get(k) for k in ("title", "year", "journal", "volume", "pages", "doi")}
    body = ",\n".join(f"  {k} = {{{v}}}" for k, v in fields.items() if v)
    return f"@{c.get('type', 'misc')}{{{c.get('key', 'ref')},\n{body}\n}}"


def cite(meta: dict, sidecars: dict[str, dict], style: str = "text") -> list[str]:
    """References of all checklists and enrichments used, each once."""
    used = [*meta.get("backends", []), *(e["name"] for e in meta.get("enrichments", []))]
    make = {"text": format_citation, "bibtex": format_bibtex}[style]
    return list(dict.fromkeys(make(sidecars[n]["citation"]) for n in used if sidecars.get(n, {}).get("citation")))
