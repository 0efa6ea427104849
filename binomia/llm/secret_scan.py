"""Secret scans over an incremental ledger of blobs.

Each version of a text is a blob, addressed by its SHA-256. The ledger remembers which
(blob, rule version) pairs have been scanned and what was found, so a later run scans only
unseen pairs, and findings join back to every path that ever held the blob. All work is
DataFrame functions: pieces between matches give the positions that regexes don't, as
running sums over the matches of a (blob, rule), so the work is linear in the matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those with a short ``group`` are dropped.

    ``hint`` is a cheap regex without which a text can't match. Where a match is the group and
    can't begin inside a shorter one, the least length is in the pattern: fewer matches to drop.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str | None = None


#: Kinds in the order in which equal starts are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", "AKIA[A-Z0-9]{16,}", 20, 0, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 24, 0, "[0-9a-f]{24}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("forge", "gh[opsur]_[A-Za-z0-9]+", 40, 0, "gh[opsur]_"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, "eyJ"),
)
BASE = 3
RULE_VERSION = "1"


_SPANS, _MASKS = "array<struct<start:int,ord:int,stop:int>>", "array<struct<start:int,stop:int>>"


def _pieces(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<ord, gap, size, tested>> of one rule's matches: length before, of, and to be tested."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    parts = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(whole).alias("size"), lengths(tested).alias("tested"))
    found = F.transform(parts, lambda x: F.struct(F.lit(order).alias("ord"), x["gap"].alias("gap"), x["size"].alias("size"), x["tested"].alias("tested")))
    return F.when(text.rlike(rule.hint), F.filter(found, lambda x: x["size"].isNotNull())) if rule.hint else found


def scan(texts: DataFrame) -> DataFrame:
    """``blob, spans, masks`` of the blobs (blob, text) in which a rule finds something; a repeated blob counts once.

    ``masks`` are the spans with overlaps joined, in order.
    """
    hinted = texts.filter(F.col("text").rlike("|".join(r.hint for r in RULES))).dropDuplicates(["blob"])
    each = F.array(*[_pieces(F.col("text"), r, k) for k, r in enumerate(RULES)])
    found = hinted.select("blob", F.explode(each).alias("found")).select("blob", F.posexplode("found").alias("i", "x")).select("blob", "i", "x.*")
    ends = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*[F.lit(max(r.least, 1)) for r in RULES]), F.col("ord") + 1)
    found = found.withColumn("stop", ends.cast("int")).filter(F.col("tested") >= least)
    found = found.select("blob", (F.col("stop") - F.col("size")).alias("start"), "ord", "stop")
    by_blob = Window.partitionBy("blob").orderBy("start", "ord", "stop")
    before = F.max("stop").over(by_blob.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    found = found.withColumn("mask", F.sum("fresh").over(by_blob.rowsBetween(Window.unboundedPreceding, 0)))
    joined = found.groupBy("blob", "mask").agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.collect_list(F.struct("start", "ord", "stop")).alias("spans"))
    spans, masks = F.array_sort(F.flatten(F.collect_list("spans"))), F.array_sort(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("stop"))))
    return joined.groupBy("blob").agg(spans.cast(_SPANS).alias("spans"), masks.cast(_MASKS).alias("masks"))


def blobs(docs: DataFrame) -> DataFrame:
    """``path, blob`` of every row (doc_id, text); null texts are the empty blob."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"))


def update_ledger(docs: DataFrame, ledger: str, version: str = RULE_VERSION) -> None:
    """Scan the blobs of ``docs`` that ``ledger`` (a folder) hasn't seen under ``version``.

    Each call appends one folder of findings and then one of seen pairs; a call that fails
    in between is repeated harmlessly, for findings are read once per blob and version.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    # one path stands for a blob; only its text is read again
    first = text.groupBy("blob").agg(F.min("path").alias("path"))
    seen = read_ledger(spark, ledger, "seen", "blob string, version string").filter(F.col("version") == version)
    unseen = first.join(seen, "blob", "left_anti")
    rows = text.join(unseen.select(F.col("blob").alias("b"), F.col("path").alias("p")), F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
    scan(rows.select("blob", "text")).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", F.lit(version).alias("version")).write.mode("append").parquet(f"{ledger}/seen")


def read_ledger(spark, ledger: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{ledger}/{name}") if there else spark.createDataFrame([], schema)


def compact(spark, ledger: str, files: int = 1) -> None:
    """Rewrite ``ledger`` into ``files`` files a table, each row once.

    The new files join the old ones before these go, and rows may repeat in between: a run
    that fails half-way loses nothing. Not for use while another run appends.
    """
    for name, schema, key in (("findings", _FOUND, ["blob", "version"]), ("seen", "blob string, version string", ["blob", "version"])):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")] if fs.exists(path) else []
        if len(old) > files:
            read_ledger(spark, ledger, name, schema).dropDuplicates(key).repartition(files).write.mode("append").parquet(f"{ledger}/{name}")
            for f in old:
                fs.delete(f, False)


_FOUND = f"blob string, spans {_SPANS}, masks {_MASKS}, version string"


def findings(spark, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """``blob, spans, masks`` that ``ledger`` holds under ``version``, each blob once."""
    found = read_ledger(spark, ledger, "findings", _FOUND).filter(F.col("version") == version)
    return found.dropDuplicates(["blob"]).drop("version")


def secret_spans(docs: DataFrame, ledger: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, blob, spans array<struct<start,ord,stop>>``.

    Spans are sorted by start, then kind; stop is exclusive; both count code points. Null
    texts are empty. Without ``ledger`` a fresh one in the shared folder is used. Repeated
    rows, and different texts under one id, each get the findings of their own text. Texts
    of any length are scanned whole; other columns are ignored.
    """
    ledger = ledger or shared_dir(docs.sparkSession, "ledger")
    update_ledger(docs, ledger, version)
    found = findings(docs.sparkSession, ledger, version).select("blob", "spans")
    return blobs(docs).join(found, "blob", "left").select(F.col("path").alias("doc_id"), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def rendered(spans: Column) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"], s["stop"])), ",")


def redacted(text: Column, masks: Column, mask: str = "[secret]") -> Column:
    """``text`` with every stretch of ``masks`` (in order, apart) replaced by ``mask``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(masks, lambda m: m["stop"]))
    stops = F.concat(F.transform(masks, lambda m: m["start"]), F.array(F.length(text)))
    parts = F.arrays_zip(starts.alias("a"), stops.alias("b"))
    cut = lambda signs: F.transform(parts, lambda x: F.array_join(F.slice(signs, x["a"] + 1, x["b"] - x["a"]), ""))
    kept = F.transform(F.array(F.split(text, "")), cut)  # a text is split into its signs once
    return F.when(F.size(masks) > 0, F.array_join(F.get(kept, 0), mask)).otherwise(text)


def redacted_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` masked; ``n_chars``, where it exists, follows the text.

    Only rows that a rule's hint matches meet the ledger's findings; all others, null and
    empty texts included, pass through as they are. Columns and rows stay, repeated ones and
    those without id, too; overlapping secrets get one mask.
    """
    hint = F.coalesce(F.col("text").rlike("|".join(r.hint for r in RULES)), F.lit(False))
    ledger = ledger or shared_dir(docs.sparkSession, "ledger")
    update_ledger(docs.filter(hint).select("doc_id", "text"), ledger)
    found = findings(docs.sparkSession, ledger).select(F.col("blob").alias("__blob"), F.col("masks").alias("__masks"))
    rows = docs.filter(hint).withColumn("__blob", F.sha2(F.col("text").cast("binary"), 256)).join(found, "__blob", "left")
    masks = F.coalesce("__masks", F.array().cast(_MASKS))
    rows = rows.withColumn("text", redacted(F.col("text"), masks))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.size(masks) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return docs.filter(~hint).unionByName(rows.select(docs.columns))
