"""Repeated passages by sparse suffix arrays.

Only suffixes that start at content-selected positions are kept: of each run of
``length - GRAM + 1`` consecutive word ``GRAM``-grams the one with the least hash
(leftmost of equals). Any two equal passages of ``length`` words keep suffixes at the same
offset. Each kept suffix stands for a stretch, all the passages that select it.

A suffix whose first ``GRAM`` words occur once is dropped. Suffixes with equal stretches
settle all their passages at once: they are counted, map-side first, and one of them goes
on. What is left are different stretches around equal words. They are sorted by the words
that follow (then those before), range-partitioned so that no group has to fit in a task, and
each is compared with its neighbours; the first and last rows of each partition are
compared again across the bounds. The common prefix with a neighbour extends the match to
the right, the words before extend it to the left, and all passages inside are repeated.
No other suffix shares more words to the right than a neighbour does, so passages that end
beyond that occur once.

Where the best partner to the right isn't the best to the left, the same rows are sorted by
the words before them and compared again. What two orders leave open (a passage whose
partner is best on neither side) is settled by the suffixes that start at the passages
themselves: those of the words concerned are sorted and compared with their neighbours, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, longs, mix, ngram_hashes, sliced, space_words, stored

#: Words by which kept suffixes are ordered.
GRAM = 16
#: Rows that a task sorts and compares with their neighbours: so many at most, and no fewer for the sake of more tasks.
SORTED, FEW = 200_000, 10_000
#: Texts that a task remembers so that copies send nothing.
SEEN = 200_000
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _words() -> Callable[[str | None], np.ndarray]:
    hashes = WordHashes()
    return lambda text: hashes.of(space_words(text or ""))


def selected(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` words the position of the suffix it selects; the gram hashes."""
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = min(GRAM, length)
    grams = ngram_hashes(words, k, seed=7)
    out, span = [], length - k + 1
    for at in range(0, len(grams) - span + 1, 1 << 16):  # in pieces: long texts stay small
        view = sliding_window_view(grams[at : at + (1 << 16) + span - 1], span)
        out.append(view.argmin(1) + np.arange(at, at + len(view)))
    return np.concatenate(out), grams


def _prefixes(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two pairs of prefix sums of a polynomial hash and factors that shift it to position 0."""
    out = []
    for salt, base in enumerate(_BASE):
        w = mix(words + np.uint64(salt * 0x632BE59BD9B4E019 + 1))
        one, n = np.array([1], np.uint64), len(w)
        power = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        out.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:-1], dtype=np.uint64)]), back))
    return out


def prints(words: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | None = None) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each stretch [start, stop) of words."""
    extra = np.zeros(1, np.uint64) if salt is None else mix(salt.astype(np.uint64) + np.uint64(1))
    return [mix(mix((sums[stop] - sums[start]) * back[start]) + extra) for sums, back in _prefixes(words)]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _words()
    for b in sliced(batches):
        ws = [words(t) for t in b.column(3).to_pylist()]
        place = [np.arange(len(w), dtype=np.uint64) for w in ws]
        prints = [np.array([mix(mix(w + np.uint64(s)) + p).sum(dtype=np.uint64) for w, p in zip(ws, place, strict=True)], np.uint64) for s in (3, 5)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(w) for w in ws], pa.int64()), longs(prints[0]), longs(prints[1])], ["doc_id", "i1", "i2", "n_words", "d1", "d2"])


def _suffixes(length: int):
    """Kept suffixes: prefix ``key``, stretch fingerprint (u1, u2), text, place, first and last passage (s0, s1)."""
    names = ["key", "u1", "u2", "i1", "i2", "p", "s0", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _words(), set()
        for b in sliced(batches):
            rows: list[list[np.ndarray]] = []
            for i1, i2, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (i1, i2) in seen:  # a copy of a text in this task adds nothing
                    continue
                w = words(t)
                if len(w) < length:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((i1, i2))
                pos, grams = selected(w, length)
                s0 = np.flatnonzero(np.diff(pos, prepend=-1))
                at = pos[s0]
                s1 = np.append(s0[1:], len(pos)) - 1
                u = prints(w, s0, s1 + length, (at - s0) * 4096 + (s1 - s0))
                rows.append([grams[at], *u, np.full(len(at), i1, np.int64), np.full(len(at), i2, np.int64), at, s0, s1])
            if rows:
                cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([*map(longs, cols[:3]), *(pa.array(c.astype(t)) for c, t in zip(cols[3:], kinds, strict=False))], names)

    return run


#: What is sorted: first words, words after and before (eight bytes each, the latter from the
#: place backwards), text, place, passages that may be repeated (s0..s1), and open ones among them (q0..q1).
_ROW = "key long, right binary, left binary, i1 long, i2 long, p int, s0 int, s1 int, q0 int, q1 int"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _rows(length: int, around: bool):
    """Stretches (``around``) or single passages of texts (i1, i2, text, runs), ready to be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k = _words(), min(GRAM, length)
        for b in sliced(batches, 50):
            for i1, i2, t, runs in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                w = words(t).astype(">u8")
                raw, back = w.tobytes(), w[::-1].tobytes()
                if around:
                    rows = [(r["key"], raw[8 * (r["p"] + k) : 8 * (r["s1"] + length)], back[8 * (len(w) - r["p"]) : 8 * (len(w) - r["s0"])], r["p"], r["s0"], r["s1"], r["s0"], r["s0"] - 1 if r["many"] else r["s1"]) for r in runs]
                else:
                    grams = ngram_hashes(w.astype(np.uint64), k, seed=7).view(np.int64)
                    starts = np.unique(np.concatenate([np.arange(r["s0"], r["s1"] + 1) for r in runs])).tolist()
                    rows = [(int(grams[s]), raw[8 * s : 8 * (s + length)], b"", s, s, s, s, s) for s in starts]
                for lo in range(0, len(rows), 1 << 14):
                    key, right, left, *places = zip(*rows[lo : lo + (1 << 14)], strict=True)
                    same = [pa.array([i] * len(key), pa.int64()) for i in (i1, i2)]
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(right, pa.binary()), pa.array(left, pa.binary()), *same, *(pa.array(x, pa.int32()) for x in places)], _NAMES)

    return run


def _common(column: pa.Array) -> np.ndarray:
    """Words that each row of ``column`` and the next have in common from the start."""
    cells = column.to_pylist()
    size = np.array([len(c) // 8 for c in cells])
    grid = np.zeros((len(cells), max(1, int(size.max()))), np.uint64)
    for k, c in enumerate(cells):
        grid[k, : size[k]] = np.frombuffer(c, np.uint64)
    same = np.cumprod(grid[1:] == grid[:-1], axis=1).sum(1)
    return np.minimum(same, np.minimum(size[1:], size[:-1]))


def _matches(t: pa.Table, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Words shared to the right and to the left by each sorted row and the next."""
    same = t.column("key").to_numpy()[1:] == t.column("key").to_numpy()[:-1]
    right, left = (_common(t.column(c).combine_chunks()) for c in ("right", "left"))
    return np.where(same, head + right, 0), np.where(same, left, 0)


_SCHEMA = f"{_ROW}, edge int, a0 int, a1 int, b0 int, b1 int"


def _found(t: pa.Table, edge: np.ndarray, right: np.ndarray, left: np.ndarray, length: int, side: str) -> pa.Table:
    """Rows with passages that are repeated (a0..a1, b0..b1), and fewer that may be or are open.

    ``right`` and ``left`` hold the shared words with the row before and after, two columns.
    Rows are sorted by the words on ``side``, so no row shares more there than a neighbour.
    Rows with an ``edge``: 1 is to be compared again, 2 is a neighbour of one.
    """
    p, s0, s1, q0, q1 = (t.column(c).to_numpy().astype(np.int64) for c in ("p", "s0", "s1", "q0", "q1"))
    again = edge == 1  # not all neighbours are known
    if side == "right":
        s1 = np.where(again, s1, np.minimum(s1, p + right.max(1) - length))
    else:
        s0 = np.where(again, s0, np.maximum(s0, p - left.max(1)))
    q0, q1, ranges = np.maximum(q0, s0), np.minimum(q1, s1), {}
    for k, name in enumerate("ab"):  # passages from p - left that end by p + right
        first, last = np.maximum(s0, p - left[:, k]), np.minimum(s1, p + right[:, k] - length)
        ranges[f"{name}0"], ranges[f"{name}1"] = first, np.maximum(last, first - 1)
    for name in "aba":  # open passages at either end of which are found are fewer
        first, last = ranges[f"{name}0"], ranges[f"{name}1"]
        there = (last >= first) & ~again
        q1 = np.where(there & (first <= q1) & (last >= q1), np.minimum(q1, first - 1), q1)
        q0 = np.where(there & (first <= q0) & (last >= q0), np.maximum(q0, last + 1), q0)
    new = {"s0": s0, "s1": s1, "q0": q0, "q1": np.maximum(q1, q0 - 1)}
    for name, x in new.items():
        t = t.set_column(t.column_names.index(name), name, pa.array(x, pa.int32()))
    for name, x in {"edge": edge, **ranges}.items():
        t = t.append_column(name, pa.array(x, pa.int32()))
    return t.filter(pa.array((edge > 0) | (s1 >= s0)))


def _compared(head: int, length: int, side: str):
    """Neighbours in one sorted partition, batch by batch; two rows at either end are edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, before = None, 0, (0, 0)  # rows whose next ones aren't known, how many rows came before them
        for b in _with_end(batches):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            if t is None or not len(t):
                continue
            right, left = _matches(t, head)
            keep = len(t) if b is None else len(t) - 2  # the last two may be edges
            if keep <= 0:
                held = t
                continue
            after = [np.append(x, 0)[:keep] for x in (right, left)]
            prior = [np.concatenate([[y], x])[:keep] for x, y in zip((right, left), before, strict=True)]
            edge = np.zeros(keep, np.int32)
            place = np.arange(seen, seen + keep)
            edge[place == 0], edge[place == 1] = 1, 2
            if b is None:
                edge[-2:-1][edge[-2:-1] == 0] = 2
                edge[-1] = 1
            yield from _found(t.slice(0, keep), edge, np.stack([prior[0], after[0]], 1), np.stack([prior[1], after[1]], 1), length, side).to_batches()
            before, seen, held = (int(right[keep - 1]), int(left[keep - 1])) if keep <= len(right) else (0, 0), seen + keep, t.slice(keep)

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _across(head: int, length: int, side: str):
    """Edges of all partitions, sorted: the outermost rows with their true neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        edge, t = t.column("edge").to_numpy(), t.select(_NAMES)
        right, left = _matches(t, head)
        both = [np.stack([np.concatenate([[0], x]), np.append(x, 0)], 1) for x in (right, left)]
        out = _found(t, np.where(edge == 1, 0, 2), *both, length, side)
        yield from out.filter(pa.array(out.column("edge").to_numpy() == 0)).to_batches()

    return run


def _neighbours(rows: DataFrame, side: str, head: int, length: int, tables: Scratch) -> DataFrame:
    """What comparing ``rows`` (:data:`_ROW`), sorted by the words on ``side``, with their neighbours shows.

    ``head``: words that rows with equal ``key`` share before ``right``. Stored.
    """
    rows, one = tables.put(rows)  # sampled for the bounds, then dealt
    order = ("key", "right", "left") if side == "right" else ("key", "left", "right")
    n, tasks = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // SORTED), min(tasks, -(-n // FEW)))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found, two = tables.put(dealt.mapInArrow(_compared(head, length, side), _SCHEMA))
    ends = found.filter("edge > 0").repartition(1).sortWithinPartitions(*order)  # four rows a partition
    out, _ = tables.put(found.filter("edge <> 1").unionByName(ends.mapInArrow(_across(head, length, side), _SCHEMA)).filter("s1 >= s0"))
    tables.drop(one, two)
    return out


def _union(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for runs in b.column(2).to_pylist():
                merged: list[dict[str, int]] = []
                for s0, s1 in sorted((r["s0"], r["s1"]) for r in runs):
                    if merged and s0 <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s1 + length)
                    else:
                        merged.append({"start": s0, "stop": s1 + length})
                spans.append(merged)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(spans, kind)], ["i1", "i2", "found"])

    return run


def repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_words, n_repeated, spans``.

    Words: A-Z lower-cased, split on white space. ``spans`` are the maximal runs [start,
    stop) of words covered by passages of ``length`` words that occur at another place of
    any text; ``n_repeated`` counts their words. All of a text of at least ``length`` words
    that occurs twice is repeated, so repeated rows are, too. Null and short texts have no
    spans. A row is its text: ids may be null or shared by different texts, and other
    columns are ignored. Texts and words are told apart by hashes (128 and 64 bits).
    """
    tables = Scratch(docs.sparkSession, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("i1"), F.xxhash64(F.lit(1), "text").alias("i2"), "text")
    texts = docs.select("i1", "i2", "text")
    none = F.array().cast("array<struct<start:long,stop:long>>")
    prof = stored(docs.mapInArrow(_profile, "doc_id long, i1 long, i2 long, n_words long, d1 long, d2 long"), "texts")
    copies = prof.filter(F.col("n_words") >= length).groupBy("n_words", "d1", "d2").agg(F.count(F.lit(1)).alias("copies"))
    copies = stored(copies.filter("copies > 1"), "copies")
    suffixes, p_suffixes = tables.put(texts.mapInArrow(_suffixes(length), "key long, u1 long, u2 long, i1 long, i2 long, p int, s0 int, s1 int"))
    twice = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    twice, p_twice = tables.put(twice)  # joins of their own with stored tables: hot keys can be split
    kept, p_kept = tables.put(suffixes.join(twice, "key"))
    tables.drop(p_suffixes, p_twice)
    stretch = kept.groupBy("key", "u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i1", "i2", "p", "s0", "s1")).alias("one"))
    stretch, p_stretch = tables.put(stretch)
    whole = kept.join(stretch.filter("n > 1").select("key", "u1", "u2"), ["key", "u1", "u2"]).select("i1", "i2", "s0", "s1")
    whole, p_whole = tables.put(whole.distinct())
    tables.drop(p_kept)
    mixed = stretch.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    mixed, p_mixed = tables.put(mixed)
    different = stretch.join(mixed, "key").select("key", (F.col("n") > 1).alias("many"), "one.*")

    def sorted_rows(runs: DataFrame, around: bool) -> DataFrame:
        listed = runs.groupBy("i1", "i2").agg(F.collect_list(F.struct(*[c for c in runs.columns if c not in ("i1", "i2")])).alias("runs"))
        near = texts.join(listed, ["i1", "i2"]).dropDuplicates(["i1", "i2"])
        return near.select("i1", "i2", "text", "runs").mapInArrow(_rows(length, around), _ROW)

    k, runs = min(GRAM, length), whole
    found = _neighbours(sorted_rows(different, True), "right", k, length, tables)
    tables.drop(p_stretch, p_mixed)
    for side in ("left", None):
        runs = reduce(DataFrame.union, [found.filter(f"{x}1 >= {x}0").select("i1", "i2", f"{x}0", f"{x}1") for x in "ab"], runs)
        unsettled = found.filter("q1 >= q0").groupBy("key").agg(F.min(F.expr("p - q1")).alias("o0"), F.max(F.expr("p - q0")).alias("o1"))
        unsettled, _ = tables.put(unsettled)  # offsets of open passages
        if unsettled.isEmpty():
            break
        rest = found.join(unsettled, "key")
        if side:
            found = _neighbours(rest.select(_NAMES), side, k, length, tables)
        else:
            single = rest.select("i1", "i2", F.expr("greatest(s0, p - o1)").alias("s0"), F.expr("least(s1, p - o0)").alias("s1")).filter("s1 >= s0")
            found = _neighbours(sorted_rows(single, False), "right", 0, length, tables)
            runs = reduce(DataFrame.union, [found.filter(f"{x}1 >= {x}0").select("i1", "i2", f"{x}0", f"{x}1") for x in "ab"], runs)
    runs = runs.groupBy("i1", "i2").agg(F.collect_set(F.struct("s0", "s1")).alias("runs"))
    found = runs.mapInArrow(_union(length), "i1 long, i2 long, found array<struct<start:long,stop:long>>")
    out = prof.join(copies, ["n_words", "d1", "d2"], "left").join(found, ["i1", "i2"], "left")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    spans = F.when(F.col("copies") > 1, all_of).otherwise(F.coalesce("found", none))
    out = out.select("doc_id", "n_words", spans.alias("spans"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", "n_words", total.alias("n_repeated"), "spans")
