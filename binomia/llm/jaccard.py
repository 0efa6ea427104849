"""N-gram Jaccard join by count vectors in an R-tree.

Every document is a set of word n-grams. A fixed hash deals n-grams into groups, about
as many as the set has members; the counts per group are the document's point, and the
sum of coordinate minima of two points bounds their overlap from above. Group counts are
powers of two, so a finer point folds into a coarser one. Packed R-trees over these points
discard pairs (and whole boxes) whose bound is too low; survivors are verified on the
full sets.

Trees are kept small and apart by exact blocking on finer groups of the same kind: of
two sets with Jaccard >= t, of which the smaller has n members, at most n(1-t)/t
members are not shared. Dealt into more groups than that, some group must be the same
in both. Documents meet only where a whole group agrees, so a passage or phrase that
very many documents share doesn't bring them together. Empty groups agree for no
reason; spare groups are added so that a shared non-empty group remains, and a set with
more empty groups than spares deals itself again under another seed (see
:func:`group_keys`). No cap, sample or list of frequent n-grams is involved.

Copies (equal sets) are one class from the start. Within a block, each class is first
verified against the block's smallest class; components of those links settle most blocks.
Members of blocks that still hold several components are dealt again, by n-grams that set
them apart: with the n-grams of all sets in one order, rarest first, two sets of sizes n and
m that share o >= t (n + m) / (1 + t) members have their first common n-gram where at least o
members are left in both. So each set sends its first few n-grams with their places, the
(n-gram, size, place) are counted, and only those meet that leave enough in both. Near copies
of a template with n-grams of their own that don't reach the threshold have none in common
there, and never meet.

In such a block that holds several components, R-trees over bounded sub-blocks find the
members that have a partner in another component by the bound (one row a member, never
the pairs); sub-blocks within one component don't meet. Those members meet again with
their full sets, overlaps are counted exactly inside the task, and only the edges of a
spanning forest leave it.

Sets hold 64-bit hashes of n-grams, and classes 128 bits of their sets. Of m distinct
n-grams in two sets some two collide with odds of about m^2 / 2^65 (10^-11 at 20,000
words), which moves a Jaccard value by one n-gram; of N different sets some two fall into
one class with odds of about N^2 / 2^129 (10^-18 at 10^10 documents).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, list_array, longs, mix, ngram_hashes, sliced, space_words, stored
from .components import components

#: Coordinates of a point: FINE times the greatest power of two within the set's size, between these.
DIMS, FINE = (32, 1 << 17), 2
#: Size classes grow by at least this factor (and by 1/t).
GROWTH = 1.5
#: Seeds tried before empty groups count as groups.
LEVELS = 4
#: Classes of one sub-block of a large block, and the n-grams that they hold at most.
SUB_BLOCK, SUB_GRAMS = 2048, 1 << 20
#: Sets that a task remembers so that copies send no keys.
SEEN = 200_000
#: Counters of n-grams by hash, from which the order of n-grams comes (any order is exact).
COUNTERS = 1 << 20
#: Counters that one row holds while they are summed up.
COUNTER_ROW = 1 << 12
#: An n-gram whose counter is above this, and above so many times the mean counter, isn't looked up in one window.
HOT, HOT_MEANS = 10_000, 8
#: Sizes up to this one, and places in such sets, are told apart; above, in steps of a hundredth and a 128th.
FINE_SIZES = 64


@lru_cache(maxsize=64)
def _bounds(num: int, den: int, top: int) -> np.ndarray:
    """Lower bounds of the size classes up to sizes beyond ``top``."""
    r = max(GROWTH, den / num)
    out = [1]
    while out[-1] <= top:
        out.append(int(math.floor(out[-1] * r)) + 1)
    out.append(int(math.floor(out[-1] * r)) + 1)
    return np.array(out, np.int64)


@lru_cache(maxsize=4096)
def _groups(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(groups, spares) for pairs whose smaller set has low <= size < high."""
    d = (high - 1) * (den - num) // num
    if d == 0:
        return 1, 0
    def short(x: int) -> float:
        empty = (d + 1 + x) * math.exp(-low / (d + 1 + x))
        return empty + 2 * math.sqrt(empty) - x

    x = next((x for x in range(1, d + 9) if short(x) <= 0), None) or min(range(1, d + 9), key=short)
    return d + 1 + x, x


def group_keys(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Blocking keys of one sorted set of distinct n-gram hashes.

    A set of size class k emits keys for class k and, if a set of class k-1 could match
    it, for class k-1: pairs meet under the class of the smaller set. Of two matching
    sets, consider the first level at which one has at most ``spares`` empty groups; both
    emit keys there, more than ``spares`` groups agree, so one that agrees isn't empty. On
    the last level empty groups emit keys, too: all sets of a size class that come so far
    meet there. A level is missed by at most one set in 20 (sizes 4 and 5 at 0.8, measured
    on random sets; most sizes by none in 400), so a few in a million come to the fourth.
    """
    n = len(grams)
    if n == 0:
        return np.empty(0, np.uint64)
    bounds = _bounds(num, den, 1 << max(10, n.bit_length()))
    k = int(np.searchsorted(bounds, n, side="right")) - 1
    ranges = [k]
    if k > 0 and -(-n * num // den) <= bounds[k] - 1:
        ranges.append(k - 1)
    out = []
    for c in ranges:
        g, spare = _groups(int(bounds[c]), int(bounds[c + 1]), num, den)
        for level in range(LEVELS):
            x = mix(grams + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1)))
            at = ((x >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sums = np.zeros(g, np.uint64)
            full, first = np.unique(at[order], return_index=True)
            sums[full] = np.add.reduceat(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))[order], first)
            salt = np.uint64((c * 0x9E3779B97F4A7C15 + level * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
            key = mix(mix(sums) + mix(np.arange(g, dtype=np.uint64) + salt))
            enough = g - len(full) <= spare
            out.append(key[full] if enough or level < LEVELS - 1 else key)
            if enough:
                break
    return np.concatenate(out)


def _dims(n: int) -> int:
    return min(max(FINE << max(0, n.bit_length() - 1), DIMS[0]), DIMS[1])


def point(grams: np.ndarray) -> bytes:
    """Group counts: half a byte each, or one or four bytes where a count needs them."""
    d = _dims(len(grams))
    counts = np.bincount((grams & np.uint64(d - 1)).astype(np.int64), minlength=d)
    if counts.max() < 16:
        return (counts[0::2] | counts[1::2] << 4).astype("u1").tobytes()
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def _coordinates(data: bytes, n: int) -> np.ndarray:
    d = _dims(n)
    if len(data) == d // 2:
        packed, out = np.frombuffer(data, "u1"), np.empty(d, "u1")
        out[0::2], out[1::2] = packed & 15, packed >> 4
        return out
    return np.frombuffer(data, "u1" if len(data) == d else "<u4")


def _fold(p: np.ndarray, d: int) -> np.ndarray:
    return p.reshape(-1, d).sum(0, dtype=np.int32) if len(p) > d else p.astype(np.int32)


def folded(points: list[np.ndarray], coarse: int = 1) -> np.ndarray:
    """Rows of one length: the shortest of all, by ``coarse``."""
    d = max(1, min(map(len, points)) // coarse)
    return np.stack([_fold(p, d) for p in points])


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed minima of two points."""
    d = min(len(a), len(b))
    return int(np.minimum(_fold(a, d), _fold(b, d)).sum())


def _sets(k: int) -> Callable[[str | None], np.ndarray]:
    hashes = WordHashes()
    return lambda text: np.unique(ngram_hashes(hashes.of(space_words(text or "")), k))


def _profiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _sets(k)
        for b in sliced(batches):
            xs = [grams(t) for t in b.column(1).to_pylist()]
            c1 = np.array([mix(x).sum(dtype=np.uint64) for x in xs], np.uint64)
            c2 = np.array([mix(x ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) for x in xs], np.uint64)
            n = pa.array([len(x) for x in xs], pa.int64())
            cv = pa.array([point(x) if len(x) else None for x in xs], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), n, longs(c1), longs(c2), cv], ["doc_id", "n", "c1", "c2", "cv"])

    return run


def _keys(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = _sets(k), set()
        for b in sliced(batches):
            sets, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = grams(t)
                digest = x.tobytes()
                digest = (len(x), int(mix(x).sum(dtype=np.uint64)), hash(digest))
                if i is None or not len(x) or digest in seen:  # a copy in the same task adds no key
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                keys.append(group_keys(x, num, den))
                sets.append(np.full(len(keys[-1]), digest[1], np.uint64))
            if sets:
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(keys)), longs(np.concatenate(sets))], ["key", "c1"])

    return run


def _gram_lists(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _sets(k)
        for b in sliced(batches):
            xs = [grams(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(xs, pa.int64())], ["id", "grams"])

    return run


def _bounded(num: int, den: int):
    """The rows (a, b, na, nb, ca, cb) whose bound lets them reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for na, nb, ca, cb in zip(*(t.column(c).to_pylist() for c in ("na", "nb", "ca", "cb")), strict=True):
                keep.append((num + den) * overlap_bound(_coordinates(ca, na), _coordinates(cb, nb)) >= num * (na + nb))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class CountTree:
    """A packed R-tree over count vectors; boxes keep coordinate maxima and the least size."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((points[:, 1 % points.shape[1]], points[:, 0], sizes))
        self.order = order
        self.tops, self.least = [points[order]], [sizes[order]]
        while len(self.least[-1]) > self.FAN:
            cut = np.arange(0, len(self.least[-1]), self.FAN)
            self.tops.append(np.maximum.reduceat(self.tops[-1], cut))
            self.least.append(np.minimum.reduceat(self.least[-1], cut))

    def search(self, q: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Indices of points whose bound lets them reach the threshold with ``q`` of size n."""
        at = np.arange(len(self.least[-1]))
        for depth in range(len(self.least) - 1, -1, -1):
            bound = np.minimum(self.tops[depth][at], q).sum(1)
            at = at[(num + den) * bound >= num * (self.least[depth][at] + n)]
            if depth and len(at):
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.least[depth - 1])]
        return self.order[at]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, i, j), which come sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        marks = [b.column(c).to_numpy() for c in ("key", "i", "j")]
        cut = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
        if held and any(held[0].column(c)[0] != b.column(c)[0] for c in ("key", "i", "j")):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in cut.tolist():
            yield pa.Table.from_batches([*held, b.slice(at, c - at)])
            held, at = [], c
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sub-blocks that meet; the same rows where a sub-block meets itself."""
    sub, i, j = t.column("sub").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left = np.flatnonzero(sub == i)
    return left, left if i == j else np.flatnonzero(sub == j)


def _partnered(num: int, den: int):
    """Members of sorted sub-block pairs (key, i, j) that the bound lets link to another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            root, n = t.column("root").to_numpy(), t.column("n").to_numpy()
            left, right = _sides(t)
            if not len(left) or not len(right):
                continue
            points = [_coordinates(p, k) for p, k in zip(t.column("cv").to_pylist(), n.tolist(), strict=True)]
            cv = folded(points, FINE)
            tree, fine, near = CountTree(cv[right], n[right]), folded(points).astype(np.uint16), np.zeros(len(t), bool)
            for x in left:
                hit = right[tree.search(cv[x], n[x], num, den)]
                hit = hit[root[hit] != root[x]]
                hit = hit[(num + den) * np.minimum(fine[hit], fine[x]).sum(1) >= num * (n[hit] + n[x])]
                near[hit] = True
                near[x] |= len(hit) > 0
            if near.any():
                yield from t.select(["key", "i", "j", "id", "root", "sub"]).filter(pa.array(near)).to_batches()

    return run


class Overlaps:
    """Exact overlaps of one set with all others, by the places of each n-gram."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.ends = np.cumsum([0, *map(len, sets)])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(flat, kind="stable")
        self.gram, self.of = flat, np.repeat(np.arange(len(sets)), np.diff(self.ends))[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat))])

    def __call__(self, x: int) -> np.ndarray:
        g = self.gram[self.ends[x] : self.ends[x + 1]]
        start, many = self.first[g], self.first[g + 1] - self.first[g]
        at = np.arange(many.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        return np.bincount(self.of[at], minlength=len(self.ends) - 1)


def _forest(num: int, den: int):
    """Links between components of sorted sub-block pairs (key, i, j), at most one a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            ids, root = t.column("id").to_numpy(), t.column("root").to_numpy().copy()
            left, right = _sides(t)
            if not len(left) or not len(right):
                continue
            sets = [np.asarray(g.values) for g in t.column("grams")]
            n, shared, edges = np.array([len(g) for g in sets]), Overlaps(sets), []
            for x in left:
                o = shared(x)[right]
                hit = right[((num + den) * o >= num * (n[right] + n[x])) & (root[right] != root[x])]
                for y in hit.tolist():
                    if root[y] != root[x]:
                        edges.append((ids[x], ids[y]))
                        root[root == root[y]] = root[x]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*edges, strict=True)], ["a", "b"])

    return run


def _gram_sets(ids: DataFrame, docs: DataFrame, k: int, tables: Scratch) -> tuple[DataFrame, list[str]]:
    """Stored (id, grams) of the documents in ``ids`` (id), which are stored first.

    A short list of ids is broadcast, for Spark sees the size of its files; a long one is joined.
    """
    ids, one = tables.put(ids.distinct())
    sets = docs.join(ids, docs.doc_id == ids.id, "left_semi").mapInArrow(_gram_lists(k), "id long, grams array<long>")
    sets, two = tables.put(sets.dropDuplicates(["id"]))
    return sets, [one, two]


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int, tables: Scratch) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose points and full sets reach the threshold, stored.

    What belongs to ``a`` joins last: those are few, and a frequent one is a skewed join that
    Spark splits.
    """
    points = nodes.select("id", "n", "cv").hint("merge")  # far larger in memory than in files
    near = pairs.join(points.toDF("b", "nb", "cb"), "b").join(points.toDF("a", "na", "ca"), "a")
    near, path = tables.put(near.mapInArrow(_bounded(num, den), "a long, b long"))
    sets, paths = _gram_sets(near.select(F.explode(F.array("a", "b")).alias("id")), docs, k, tables)
    sets = sets.hint("merge")
    few = sets.join(near.select(F.col("a").alias("id")).distinct(), "id", "left_semi").hint("merge")
    both = near.join(sets.toDF("b", "y"), "b").join(few.toDF("a", "x"), "a")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    links = both.withColumn("o", common).filter((num + den) * F.col("o") >= num * (F.size("x") + F.size("y")))
    links, new = tables.put(links.select("a", "b"))
    tables.drop(path, *paths)
    return links, new


def _sub_blocks(tagged: DataFrame, tables: Scratch) -> tuple[DataFrame, list[str]]:
    """Rows (key, id, root, sub, i, j) of blocks that hold several components, one a meeting.

    ``tagged``: key, id, n, root. Members of a component that fills sub-blocks have their
    own, which don't meet among themselves; the others share the first ones.
    """
    counts, one = tables.put(tagged.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("top")))
    split = counts.groupBy("key").agg(F.sum("c").alias("size"), F.max("top").alias("top"), F.count(F.lit(1)).alias("roots"))
    per = F.least(F.lit(SUB_BLOCK), F.greatest(F.lit(1), F.floor(F.lit(SUB_GRAMS) / F.col("top"))))
    split = split.filter("roots > 1").select("key", "size", per.alias("per"))
    full = counts.join(split, "key").filter("c > per").select("key", "root", "c", F.ceil(F.col("c") / F.col("per")).alias("own"))
    full, two = tables.put(full)
    held = full.groupBy("key").agg(F.sum("c").alias("held"), F.sum("own").alias("owned"))
    held = split.join(held, "key", "left").withColumn("mixed", F.ceil((F.col("size") - F.coalesce("held", F.lit(0))) / F.col("per")))
    held = held.select("key", "mixed", (F.col("mixed") + F.coalesce("owned", F.lit(0))).alias("subs"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tagged.join(held, "key").join(full.select("key", "root", "own", before.alias("before")), ["key", "root"], "left")
    pick = lambda n: F.pmod(F.xxhash64("id"), n)
    first = F.col("mixed") + F.col("before")
    rows = rows.withColumn("sub", F.when(F.col("own").isNull(), pick(F.col("mixed"))).otherwise(first + pick(F.col("own"))))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1), lambda x: F.col("own").isNull() | (x < first) | (x >= first + F.col("own")))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "id", "root", "sub")
    return rows, [one, two]


def _counter(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _gram_counts(k: int):
    """How many n-grams of the texts (doc_id, text) fall to each counter: rows (part, counts) of :data:`COUNTER_ROW` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = _sets(k), np.zeros(COUNTERS, np.int64)
        for b in sliced(batches):
            if b.num_rows:
                total += np.bincount(_counter(np.concatenate([grams(t) for t in b.column(1).to_pylist()])), minlength=COUNTERS)
        yield from _counter_rows({p: x for p, x in enumerate(total.reshape(-1, COUNTER_ROW)) if x.any()})

    return run


def _counter_rows(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts), each with as few bytes a counter as its largest needs."""
    if parts:
        data = [x.astype(np.min_scalar_type(x.max())).tobytes() for x in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(data, pa.binary())], ["part", "counts"])


def _counters_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // COUNTER_ROW}").astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts) added up by part."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[p] = total.get(p, 0) + _counters_of(data)
    yield from _counter_rows(total)


def first_grams(grams: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first n-grams of a set, rarest first, with the steps of size and place that they fall to and the set's size.

    A partner of size m >= t n needs t (n + m) / (1 + t) >= t n members, so none begins later.
    """
    n = len(grams)
    first = n + num * n // -den + 1  # n - ceil(t n) + 1
    rank = counts[_counter(grams)]
    some = np.argpartition(rank, first - 1)[:first] if first < n else np.arange(n)
    if first < n:  # ties in the order are decided by the n-gram itself
        some = np.flatnonzero(rank <= rank[some].max())
    some = some[np.lexsort((grams[some], rank[some]))][:first]
    place = np.arange(len(some))
    if n <= FINE_SIZES:
        return grams[some], np.full(len(some), n), place, n
    return grams[some], np.full(len(some), FINE_SIZES + int(math.log(n / FINE_SIZES) * 100)), place * 128 // n, n


def _first(held, hot: int, k: int, num: int, den: int):
    """The first n-grams of texts (doc_id, text); ``apart`` is 0 for those that few texts hold, and differs by text for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = _sets(k), held.value
        for b in sliced(batches, 100):
            found = [first_grams(grams(t), counts, num, den) for t in b.column(1).to_pylist()]
            many = [len(f[0]) for f in found]
            gram, sizes, places = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(3))
            n = np.repeat([f[3] for f in found], many).astype(np.int64)
            left = n - (np.concatenate([np.arange(m) for m in many]) if many else np.empty(0, np.int64))
            ids = np.repeat(b.column(0).to_numpy(), many)
            gram = gram.astype(np.uint64)
            apart = np.where(counts[_counter(gram)] > hot, ids | 1, 0)
            columns = [ids, gram.view(np.int64), sizes.astype(np.int64), places.astype(np.int64), n, left, apart]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "gram", "size", "place", "n", "left", "apart"])

    return run


def _apart(tagged: DataFrame, docs: DataFrame, k: int, num: int, den: int, tables: Scratch) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """Blocks (key, id, n, root) by first n-grams of the members of blocks with several components, their texts (doc_id, text), and tables to drop.

    ``tagged``: key, id, n, root. What is stored are texts, not sets, which take several times the bytes; most first
    n-grams are in one set only and go in the window that they are dealt to. Its groups are small, for n-grams with
    high counters pass it by themselves.
    """
    several = tagged.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    rest, one = tables.put(tagged.join(several, "key", "left_semi").select("id", "root").distinct())
    if rest.isEmpty():
        tables.drop(one)
        return None
    ids, two = tables.put(rest.select("id").distinct())  # a table of its own: Spark broadcasts it while its files are short
    texts, six = tables.put(docs.join(ids, docs.doc_id == ids.id, "left_semi"))
    counted = texts.mapInArrow(_gram_counts(k), "part long, counts binary").repartition("part").mapInArrow(_summed, "part long, counts binary").toArrow()  # COUNTERS numbers
    counts = np.zeros((COUNTERS // COUNTER_ROW, COUNTER_ROW), np.int64)
    for part, data in zip(*(c.to_pylist() for c in counted.columns), strict=True):
        counts[part] = _counters_of(data)
    held = docs.sparkSession.sparkContext.broadcast(counts.ravel())
    hot = max(HOT, HOT_MEANS * int(counts.sum()) // COUNTERS)
    by_gram = Window.partitionBy("gram", "apart")
    first = texts.mapInArrow(_first(held, hot, k, num, den), "id long, gram long, size long, place long, n long, left long, apart long")
    first = first.withColumns({"lo": F.min("id").over(by_gram), "hi": F.max("id").over(by_gram)}).filter("apart <> 0 or lo <> hi").drop("apart", "lo", "hi")
    first, three = tables.put(first)
    steps = ["gram", "size", "place"]
    cells = first.groupBy(*steps).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("left"))
    cells, four = tables.put(cells)
    a, b = cells.toDF("gram", *[f"a_{c}" for c in cells.columns[1:]]), cells.toDF("gram", *[f"b_{c}" for c in cells.columns[1:]])
    ordered = F.struct("a_size", "a_place") <= F.struct("b_size", "b_place")
    alone = (F.col("a_size") == F.col("b_size")) & (F.col("a_place") == F.col("b_place")) & (F.col("a_c") == 1)
    enough = (num + den) * F.least("a_left", "b_left") >= num * (F.col("a_least") + F.col("b_least"))
    near = (den * F.col("a_most") >= num * F.col("b_least")) & (den * F.col("b_most") >= num * F.col("a_least"))
    met = a.join(b, "gram").filter(ordered & ~alone & enough & near)
    met = met.withColumn("key", F.xxhash64("gram", "a_size", "a_place", "b_size", "b_place"))
    sides = F.array(F.struct(F.col("a_size").alias("size"), F.col("a_place").alias("place")), F.struct(F.col("b_size").alias("size"), F.col("b_place").alias("place")))
    met = met.select("key", "gram", F.explode(F.array_distinct(sides)).alias("s")).select("key", "gram", "s.size", "s.place")
    rows = first.join(met, steps).select("key", "id", "n").distinct()
    blocks, five = _merged_blocks(rows.join(rest, "id"), tables, "root")
    tables.drop(three, four)
    return blocks.select("key", "id", "n", "root"), texts, [one, two, five, six]


def _merged_blocks(met: DataFrame, tables: Scratch, column: str = "id") -> tuple[DataFrame, str]:
    """Rows of blocks (key, id, ...) that hold several values of ``column``, with ``lo`` and ``size``; blocks of the same members are one.

    Blocks are summed up and joined back, so that Spark can split the rows of a large one.
    """
    met, path = tables.put(met)
    marks = F.expr("bit_xor(xxhash64(id))").alias("marks")
    lo, size = F.min("id").alias("lo"), F.count(F.lit(1)).alias("size")
    blocks = met.groupBy("key").agg(lo, size, marks, F.min(column).alias("__a"), F.max(column).alias("__b")).filter("__a <> __b")
    blocks = blocks.select("key", "lo", "size", "marks")
    rows = met.join(blocks, "key").withColumn("key", F.xxhash64("marks", "size", "lo")).drop("marks")
    rows, new = tables.put(rows.distinct())
    tables.drop(path)
    return rows, new


def _meeting(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def jaccard_components(
    docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id, component_id``.

    Links join documents whose sets of ``words``-word shingles (words: lower-cased A-Z,
    split on white space; shorter texts are one shingle) have
    den * |A and B| >= num * |A or B|. ``class_id`` is the smallest id with an equal set,
    ``component_id`` the smallest id reachable by links. Null or empty texts have no
    shingles and link with nothing; a row without id takes the component of its equals
    and is null there if it has none; links to similar texts aren't followed through it.
    Repeated rows are returned as often as they come; rows that share an id count as one
    document, whose set is that of one of them. Other columns are ignored.
    """
    tables = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof, p_prof = tables.put(docs.mapInArrow(_profiles(words), "doc_id long, n long, c1 long, c2 long, cv binary"))
    slim = prof.select("doc_id", "n", "c1", "c2")
    classes = slim.filter("n > 0").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes, p_classes = tables.put(classes)
    reps = classes.filter("copies > 1").drop("copies")  # a join of its own: a hot class can be split
    slim = slim.join(reps, ["n", "c1", "c2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    slim = stored(slim, "classes")

    # blocks with at least two classes: a window, because summing keys up and joining them back
    # writes them three times. Copies in different tasks send the same rows, told apart from
    # other sets by half their fingerprint
    by_key = Window.partitionBy("key")
    keys = docs.mapInArrow(_keys(words, num, den), "key long, c1 long")
    met = keys.withColumns({"lo": F.min("c1").over(by_key), "hi": F.max("c1").over(by_key)}).filter("lo <> hi").groupBy("key", "c1").agg(F.count(F.lit(1)).alias("sent"))
    met = met.join(classes.filter("rep is not null").select("c1", "rep", "n"), "c1").select("key", F.col("rep").alias("id"), "n")
    met, p_met = _merged_blocks(met, tables)
    nodes = prof.filter("n > 0").join(met.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    nodes, p_nodes = tables.put(nodes.select(F.col("doc_id").alias("id"), "n", "cv").dropDuplicates(["id"]))
    tables.drop(p_prof, p_classes)

    # every class against the smallest of all its blocks, then against those of the blocks that this didn't settle
    star = met.groupBy(F.col("id").alias("b")).agg(F.min("lo").alias("a")).filter("a <> b").select("a", "b")
    links, p_links = _verified(star, nodes, docs, words, num, den, tables)
    roots = components(links)
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    star = met.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    more, p_more = _verified(star, nodes, docs, words, num, den, tables)
    roots = components(roots.select("id", "root").union(more))
    tables.drop(p_links, p_more)

    # what star links left apart within a block
    tagged = met.filter("size > 2").join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    apart = _apart(tagged, docs, words, num, den, tables)
    if apart is not None:
        blocks, texts, p_apart = apart
        rest, p_rest = _sub_blocks(blocks, tables)
        near = _meeting(rest.join(nodes.hint("merge"), "id")).mapInArrow(_partnered(num, den), "key long, i long, j long, id long, root long, sub long")
        near, p_near = tables.put(near)
        sets, p_sets = _gram_sets(near.select("id"), texts, words, tables)
        found, p_found = tables.put(_meeting(near.join(sets.hint("merge"), "id")).mapInArrow(_forest(num, den), "a long, b long"))
        roots = components(roots.select("id", "root").union(found))
        tables.drop(p_near, p_found, *p_sets, *p_rest, *p_apart)
    tables.drop(p_met, p_nodes)
    out = slim.join(roots, slim.rep == roots.id, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"))
