"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Exact and fuzzy resolution are timed warm (key index stored) as well as cold (index built
in the query). The driver's part names are few, so the same is timed on a generated
checklist of 400,000 names with 12,000 distinct dirty queries, and names per second are
given over distinct names there. JVM start-up is not timed. Each query's whole result is
written to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "clean_names", "embed_accepted", "exact_cascade", "fuzzy_dl", "fuzzy_jaro_winkler", "resolve_chain", "enrich_species",
    "enrich_grouped", "trait_median", "region_filter", "points_in_polygons", "near_duplicates", "inspect_report", "window_tally",
)
#: Names of the generated checklist, names of a genus, and distinct queries.
CHECKLIST, PER_GENUS, ASKED = 400_000, 20, 12_000
SYLLABLES = "ba be bi bo ca ce ci co da de di do fa fi ga go la le li lo ma me mi mo na ne ni no ra re ri ro".split()


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def word(number: Column, syllables: int) -> Column:
    """A made-up word; different numbers below 32 ** syllables give different words."""
    known = F.array(*map(F.lit, SYLLABLES))
    return F.concat(*[F.get(known, F.shiftright(number, 5 * k).bitwiseAND(31).cast("int")) for k in range(syllables)])


def checklist(spark: SparkSession) -> DataFrame:
    """Names in a scattered order; a third are synonyms of the name before."""
    k = F.col("id")
    rows = spark.range(CHECKLIST).select(k, F.initcap(word(F.floor(k / PER_GENUS) * 7919 % 1048573, 4)).alias("genus"), word(k * 48271 % 33554393, 5).alias("specific_epithet"))
    synonym = k % 3 == 2
    return rows.select(
        F.format_string("t%07d", k).alias("taxon_id"),
        F.concat_ws(" ", "genus", "specific_epithet").alias("canonical_name"),
        F.lit("SPECIES").alias("taxon_rank"),
        F.when(synonym, "SYNONYM").otherwise("ACCEPTED").alias("taxonomic_status"),
        F.when(synonym, F.format_string("t%07d", k - 1)).alias("accepted_name_usage_id"),
        F.lit("Familia").alias("family"),
        "genus",
        "specific_epithet",
        F.lit("L.").alias("authorship"),
    )


def asked(names: DataFrame) -> DataFrame:
    """Distinct queries: as written, with an author, in capitals, with a qualifier, and two kinds of misspelling."""
    n, habit = F.col("canonical_name"), F.substring("taxon_id", 2, 7).cast("int")
    rows = names.filter(habit % (CHECKLIST // ASKED) == 0).withColumn("h", F.floor(habit / (CHECKLIST // ASKED)) % 6)
    slip = F.concat(F.substring(n, 1, 12), F.lit("x"), F.substring(n, 13, 99))
    swap = F.concat(F.substring(n, 1, 10), F.substring(n, 12, 1), F.substring(n, 11, 1), F.substring(n, 13, 99))
    kinds = [n, F.concat(n, F.lit(" (L.) Mill.")), F.upper(n), F.concat(F.col("genus"), F.lit(" cf. "), F.col("specific_epithet")), slip, swap]
    return rows.select(habit.cast("long").alias("row_idx"), F.element_at(F.array(*kinds), (F.col("h") + 1).cast("int")).alias("input_name"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from binomia.operators.backbone import build_backbone, key_index
    from binomia.plans import queries as q
    from binomia.plans.resolve import Backend, Options, resolve
    from binomia.sources.buckets import load_index, save_index
    from binomia.sources.staging import staged, staging_path
    from binomia.streaming.stream import resolve_batch

    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        t = time.time()
        run(make())
        times[name] = round(time.time() - t, 3)

    run(spark.range(1000).groupBy(F.col("id") % 7).count())
    for name in HEADLINE:
        timed(name, lambda name=name: q.QUERIES[name](spark, SF_DIR))
    ix, rows = q.index(spark, SF_DIR), q.names(spark, SF_DIR)
    timed("exact_warm", lambda: resolve_batch(rows, ix))
    timed("resolve_warm", lambda: resolve(rows, [Backend("wfo", ix)], Options()).df)
    n, distinct = rows.count(), rows.select("input_name").distinct().count()

    names = staged(checklist(spark), "checklist")
    t = time.time()
    built = key_index(build_backbone(names))
    # laid out for lookups: bucketed by kind and key, so that only names are shuffled
    big = save_index(built, "big_index", int(CPUS), staging_path(spark, "big_index"))
    times["index_400k"] = round(time.time() - t, 3)
    timed("load_400k", lambda: load_index(spark, "big_index").limit(1))
    few = staged(asked(names), "asked")
    timed("exact_400k", lambda: resolve_batch(few, big))
    timed("resolve_400k", lambda: resolve(few, [Backend("wfo", big)], Options()).df)
    many = few.select("input_name").distinct().count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": SF_DIR.rstrip("/").rpartition("sf")[2], "names": n, "distinct_names": distinct,
                "names_per_s": {k: round(n / times[k]) for k in ("exact_warm", "resolve_warm", "exact_cascade", "resolve_chain")},
                "checklist_names": CHECKLIST, "distinct_queries": many,
                "distinct_names_per_s": {k: round(many / times[k]) for k in ("exact_400k", "resolve_400k")},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
