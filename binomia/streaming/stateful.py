"""Answers that hold over the batches of a stream: state per target, and rates that are corrected later."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from binomia.sources.staging import staged

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Targets that a task remembers while it thins out a batch.
HELD = 100_000
_CHANGES = "taxon_id string, row_idx long, fuzzy_dist double, change int"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that state variables need; a query started inside keeps it."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _place(distance: float | None, row: int) -> tuple[bool, float, int]:
    """Order of the matches of a target: by distance, nulls last, then by row."""
    none = distance is None or distance != distance
    return none, 0.0 if none else distance, row


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the matches (taxon_id, row_idx, fuzzy_dist) of a partition only those that can be a target's closest.

    A popular target reaches its state as a row per task, or a few, not as all its rows.
    """
    best: dict[str, tuple] = {}

    def rows() -> pa.RecordBatch:
        cols = [list(best), [p[2] for p in best.values()], [None if p[0] else p[1] for p in best.values()]]
        kinds = (pa.string(), pa.int64(), pa.float64())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["taxon_id", "row_idx", "fuzzy_dist"])
        best.clear()
        return out

    for b in batches:
        for t, r, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            p = _place(d, r)
            if t not in best or p < best[t]:
                best[t] = p
            if len(best) >= HELD:
                yield rows()
    if best:
        yield rows()


class ClosestPerTarget(StatefulProcessor):
    """One value per target: its closest match so far. A closer one is emitted with the withdrawal of the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("closest", "row_idx long, fuzzy_dist double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        was = None if held is None else _place(held[1], held[0])
        now = was
        for part in rows:
            for r, d in zip(part["row_idx"].tolist(), part["fuzzy_dist"].tolist(), strict=True):
                p = _place(d, r)
                now = p if now is None or p < now else now
        if now != was:
            self.best.update((now[2], None if now[0] else now[1]))
            # matches at distance 0 or without one are nobody's rivals: they are passed on apart
            out = [(key[0], p[2], p[1], c) for p, c in ((was, -1), (now, 1)) if p is not None and not p[0] and p[1] != 0]
            yield pd.DataFrame(out, columns=["taxon_id", "row_idx", "fuzzy_dist", "change"])

    def close(self) -> None:
        pass


def closest_changes(matches: DataFrame) -> DataFrame:
    """Changes (taxon_id, row_idx, fuzzy_dist, change) of the matches of a stream that compete for a target.

    ``matches``: taxon_id, row_idx (unique), fuzzy_dist. ``change`` is 1 where a match becomes
    its target's closest and -1 where a later, closer one takes its place. Matches without a
    target don't compete; at distance 0 or without one they hold or yield the place but
    aren't changes (see :func:`free_matches`). Start the query inside :func:`rocksdb`.
    """
    rows = matches.select("taxon_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("fuzzy_dist").cast("double").alias("fuzzy_dist"))
    rows = rows.filter(F.col("taxon_id").isNotNull())
    thin = rows.mapInArrow(_thinned, "taxon_id string, row_idx long, fuzzy_dist double")
    return thin.groupBy("taxon_id").transformWithStateInPandas(ClosestPerTarget(), outputStructType=_CHANGES, outputMode="Append", timeMode="None")


def free_matches(matches: DataFrame) -> DataFrame:
    """Matches that stay whatever else comes: without target, without distance, or at distance 0."""
    d = F.col("fuzzy_dist")
    return matches.filter(F.col("taxon_id").isNull() | d.isNull() | (d == 0)).select("taxon_id", "row_idx", "fuzzy_dist")


def net_changes(changes: DataFrame) -> DataFrame:
    """Matches that hold after all changes so far: ``taxon_id, row_idx, fuzzy_dist``."""
    net = changes.groupBy("taxon_id", "row_idx").agg(F.sum("change").alias("c"), F.min("fuzzy_dist").alias("fuzzy_dist"))
    return net.filter("c > 0").select("taxon_id", "row_idx", "fuzzy_dist")


def answered_share(asked: DataFrame, answers: DataFrame, key: str, time: str, answered_at: str, within: str, late: str) -> DataFrame:
    """Counts ``ts, n, n_matched`` of questions and of answers that came ``within`` that time after them.

    ``asked``: a unique ``key`` and ``time``; ``answers``: ``key``, ``answered_at`` and a flag
    ``hit``, or an ``input_name`` that is looked up later (see :func:`monitor_rates`) and comes
    as a fourth column. Both are streams (or tables): each question is counted at once, its
    answer when it comes, whichever side is first. Watermarks of ``late`` on both sides bound
    the state.
    """
    what = "hit" if "hit" in answers.columns else "input_name"
    a, b = (x.withWatermark(t, late) if x.isStreaming else x for x, t in ((asked.select(key, time), time), (answers.select(F.col(key).alias("__key"), answered_at, what), answered_at)))
    near = (F.col(key) == F.col("__key")) & (F.col(answered_at) >= F.col(time)) & (F.col(answered_at) <= F.col(time) + F.expr(f"interval {within}"))
    count = lambda n, m: [F.col(time).alias("ts"), F.lit(n).alias("n"), m.cast("int").alias("n_matched")]
    if what == "hit":
        return a.select(*count(1, F.lit(0))).union(a.join(b, near).select(*count(0, F.coalesce("hit", F.lit(False)))))
    return a.select(*count(1, F.lit(0)), F.lit(None).cast("string").alias(what)).union(a.join(b, near).select(*count(0, F.lit(1)), what))


def rate_changes(rows: DataFrame, every: str = "1 hour", hits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Counts of a batch (ts, n, n_matched) per window: ``window_start, n, n_matched``.

    With ``hits`` (from distinct ``input_name`` to ``input_name, hit``) rows are counted per
    window and name first, each distinct name of the batch is looked up once, and only hits
    count as matched.
    """
    w, total = F.window("ts", every).alias("w"), [F.sum("n").alias("n"), F.sum("n_matched").alias("n_matched")]
    if hits is None:
        return rows.groupBy(w).agg(*total).select(F.col("w.start").alias("window_start"), "n", "n_matched")
    counts = staged(rows.groupBy(w, "input_name").agg(*total), "counts")  # a batch with state runs once
    known = hits(counts.select("input_name").filter(F.col("input_name").isNotNull()).distinct())
    counts = counts.join(known, "input_name", "left").withColumn("n_matched", F.when(F.col("hit"), F.col("n_matched")).otherwise(0))
    return counts.groupBy("w").agg(*total).select(F.col("w.start").alias("window_start"), "n", "n_matched")


def monitor_rates(rows: DataFrame, path: str, every: str = "1 hour", hits: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Write each batch's counts per window below ``path``, a folder per batch: late rows come as corrections.

    A batch that runs again overwrites its folder. :func:`rates` adds the counts up. ``hits``
    looks up the names of answers, batch by batch (:func:`rate_changes`).
    """
    return rows.writeStream.foreachBatch(lambda df, epoch: rate_changes(df, every, hits).write.mode("overwrite").parquet(f"{path}/batch={epoch}"))


def rates(changes: DataFrame) -> DataFrame:
    """``window_start, n, n_matched, rate, n_corrections`` from the counts of all batches so far."""
    out = changes.groupBy("window_start").agg(F.sum("n").alias("n"), F.sum("n_matched").alias("n_matched"), (F.count(F.lit(1)) - 1).alias("n_corrections"))
    return out.select("window_start", "n", "n_matched", (F.col("n_matched") / F.col("n")).alias("rate"), "n_corrections")
