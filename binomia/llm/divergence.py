"""Source divergence audit: how far the vocabulary of each source is from the others of its language.

Terms are counted inside tasks per (lang, source, term) and dealt by a hash of lang and term
into shards, the partitions of Spark's shuffle. Each shard is one in-process DuckDB database, filled batch by batch, which may
spill to its own disk: vectorised SQL counts a shard's terms and, once Spark has summed the
totals of groups and languages, finds its part of every pair's sum and its first terms by
rank. Spark merges sums and ranks.

A pair's sum runs over all kept terms of a language, though most are missing in most sources:
with ``a0`` and ``b0`` for the shares of terms that don't occur in a group,

    sum f(a, b) = V f(a0, b0)
                + sum over terms in a of [f(a, b0) - f(a0, b0)]
                + sum over terms in b of [f(a0, b) - f(a0, b0)]
                + sum over terms in both of [f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)]

so shards only meet cells of the same term and hand on the number of a group's terms per
share, from which Spark makes the second and third part. A row per pair of sources and shard
leaves a task, never one per term and pair.

Everything is integer arithmetic. Shares of a group add up to 10^9 and one per kept term, so a
sum of f stays below 2^63 for up to 5 * 10^8 terms; partial sums are decimals of 38 digits.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sliced

#: Parts of a share.
UNIT = 1_000_000_000
#: Documents of a language that a term must occur in to be kept, and terms that are ranked in a group.
LEAST_DOCS, TOP = 3, 200
#: Distinct terms that a task counts before it hands them on.
HELD = 500_000
#: Memory of one shard's database.
MEMORY = "400MB"
#: First merge of ranked terms: so many parts of a group.
PARTS = 32

#: Keeps ASCII letters (lower-cased) and every non-ASCII byte; the rest separates terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if (97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, d long"


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split(b" ")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term)."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            found = [k.decode("utf-8", "replace") for k in n]
            many = len(found)
            t = pa.table([pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), pa.array(found, pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[k] for k in n], pa.int64())], ["lang", "source", "term", "n", "d"])
            yield from t.to_batches(max_chunksize=20_000)
        held.clear()

    for b in sliced(batches):
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = terms(text)
            n.update(found)
            del n[b""]
            d.update(set(found))
            size += len(n) - before
            if size >= HELD:
                yield from rows()
                size = 0
    yield from rows()


class Shard:
    """A DuckDB database in memory, of one thread, that spills to its own temporary folder."""

    def __init__(self, columns: str) -> None:
        self.folder = tempfile.TemporaryDirectory(prefix="shard-")
        self.db = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        self.db.execute(f"create table rows ({columns})")

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.db.close()
        self.folder.cleanup()

    def fill(self, batches: Iterator[pa.RecordBatch]) -> None:
        for b in batches:
            if b.num_rows:
                self.db.register("batch", pa.Table.from_batches([b]))
                self.db.execute("insert into rows select * from batch")
                self.db.unregister("batch")

    def read(self, sql: str) -> Iterator[pa.RecordBatch]:
        yield from self.db.sql(sql).to_arrow_reader(50_000)


def _kept_cells(least: int):
    """Counts of a shard's kept terms; ``fresh`` is 1 in one row of each term of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Shard("lang varchar, source varchar, term varchar, n bigint, d bigint") as shard:
            shard.fill(batches)
            shard.db.execute("create table cells as select lang, source, term, cast(sum(n) as bigint) n, cast(sum(d) as bigint) d from rows group by all")
            yield from shard.read(f"""
                select lang, source, term, n, cast(source = "first" as int) fresh from cells
                join (select lang, term, min(source) "first" from cells group by all having sum(d) >= {least}) using (lang, term)""")

    return run


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


def _share(n: str, total: str, kinds: str) -> str:
    return f"cast(1 + {UNIT}::hugeint * ({n} + 1) // ({total} + {kinds}) as bigint)"


def _partials(top: int):
    """A shard's parts of pair sums, its number of terms per group and share, and its first terms per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Shard("lang varchar, source varchar, term varchar, n bigint, total bigint, kinds bigint, lang_total bigint") as shard:
            shard.fill(batches)
            shard.db.execute(f"""create table cells as select lang, source, term, {_share('n', 'total', 'kinds')} p, {_share('0', 'total', 'kinds')} p0,
                {_share('sum(n) over (partition by lang, term)', 'lang_total', 'kinds')} q from rows""")
            yield from shard.read("select 'share' kind, lang, source, null::varchar item, p::decimal(38,0) value, count(*) m from cells group by lang, source, p")
            both = f"{_f('a.p', 'b.p')} - {_f('a.p', 'b.p0')} - {_f('a.p0', 'b.p')} + {_f('a.p0', 'b.p0')}"
            yield from shard.read(f"""select 'pair' kind, a.lang, a.source, b.source item, cast(sum({both}) as decimal(38,0)) value, 1::bigint m
                from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source""")
            yield from shard.read(f"""select 'term' kind, lang, source, term item, {_f('p', 'q')}::decimal(38,0) value, 1::bigint m
                from cells where p > q qualify row_number() over (partition by lang, source order by {_f('p', 'q')} desc, term) <= {top}""")

    return run


def _spark_f(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q) of two long columns."""
    return F.expr(f"((`{p}` - `{q}`) * (`{p}` - `{q}`)) div `{q}`")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``.

    Null ``text``, ``lang`` and ``source`` count as ''. A language keeps the V terms that occur
    in ``least_docs`` of its documents or more. With ``count`` a kept term's occurrences in a
    group or language and N their sum, its share is ``1 + floor(10^9 (count + 1) / (N + V))``,
    and ``f = floor((p - q)^2 / q)``. Part ``pair``: each other source of the language with
    the sum of f over all kept terms, q its share (0 if V is 0), all ranked. Part ``term``:
    kept terms of the group with p above q, the language's share, and f, the first ``top``.
    Ranks go by value descending, then item by bytes. Repeated rows are documents of their
    own, texts without terms make a group, too; other columns are ignored.
    """
    tables = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = docs.mapInArrow(_counted, _COUNTS).repartition("lang", "term")
    cells, p_cells = tables.put(counts.mapInArrow(_kept_cells(least_docs), "lang string, source string, term string, n long, fresh int"))

    known = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("fresh").alias("kinds"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).join(known, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups, p_groups = tables.put(groups.select("lang", "source", zero("total"), zero("kinds")))
    langs = groups.groupBy("lang").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("lang_total"))
    unseen = F.when(F.col("kinds") == 0, 1).otherwise(1 + F.expr(f"{UNIT} div (total + kinds)")).cast("long")
    groups, p_totals = tables.put(groups.drop("kinds").join(langs, "lang").withColumn("p0", unseen))

    sized = cells.drop("fresh").join(groups.drop("p0"), ["lang", "source"])
    parts = sized.select("lang", "source", "term", "n", "total", "kinds", "lang_total").repartition("lang", "term")
    parts = parts.mapInArrow(_partials(top), "kind string, lang string, source string, item string, value decimal(38,0), m long")
    parts, p_parts = tables.put(parts)
    tables.drop(p_cells, p_groups)

    wide = "decimal(38,0)"
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    own = groups.select("lang", "source", "kinds", F.col("p0").alias("a0"))
    pairs = own.join(other, "lang").filter("source <> item")
    none = pairs.select("lang", "source", "item", (F.col("kinds").cast(wide) * _spark_f("a0", "b0")).cast(wide).alias("value"))
    share = parts.filter("kind = 'share'").groupBy("lang", "source", F.col("value").cast("long").alias("p")).agg(F.sum("m").alias("m"))
    share = share.join(own.drop("kinds"), ["lang", "source"]).join(other, "lang").filter("source <> item")
    more = F.col("m").cast(wide)
    mine = share.select("lang", "source", "item", (more * (_spark_f("p", "b0") - _spark_f("a0", "b0"))).cast(wide).alias("value"))
    theirs = share.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (more * (_spark_f("b0", "p") - _spark_f("b0", "a0"))).cast(wide).alias("value"))
    both = parts.filter("kind = 'pair'").select("lang", "source", "item", "value")
    summed = none.union(mine).union(theirs).union(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    by_value = [F.col("value").desc(), F.col("item")]
    group = Window.partitionBy("lang", "source").orderBy(*by_value)
    summed = summed.withColumn("rank", F.row_number().over(group))
    first = parts.filter("kind = 'term'").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*by_value))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return summed.withColumn("part", F.lit("pair")).select(out).union(first.withColumn("part", F.lit("term")).select(out))
