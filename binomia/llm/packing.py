"""Best-fit packing by large-item matching, planned on counts per length.

Tokenised documents become pieces of at most ``capacity`` tokens. The plan needs only how
many pieces have each length, at most ``capacity`` numbers, so one packing covers the
whole corpus: pieces above one third of the capacity pair at most twice per sequence by
greedy matching (the longest with the longest that fits), smaller ones go, longest first,
to the sequence with the least room that suffices. Sequences that are filled alike are
one entry of the plan with a multiplicity, so its size depends on the capacity alone.
Each piece finds its place from its rank among the pieces of its length: a count per
(partition, length) gives ranks without sorting pieces or gathering a length anywhere.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Blank runs (Unicode white space) from this length on are encoded apart.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def default_tokenizer() -> str:
    """Where the ranks of the public byte-level BPE vocabulary lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """Added tokens of that vocabulary, which the tokenizers library matches in plain text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(maxsize=2)
def encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> Callable[[str], np.ndarray]:
    """Token ids of a text, as unsigned 32-bit; one encoder per Python worker.

    The ranks file holds the vocabulary of ``byte_bpe_50k.json``. With its ``added`` tokens,
    ids are those that the tokenizers library gives with that file and
    ``add_special_tokens=False``; without, those under ``encode_special_tokens``.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ids = dict(added)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ids)
    literal = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None

    def apart(text: str) -> np.ndarray:
        """Long blank runs encoded by themselves: their pattern would overflow the encoder's stack."""
        out: list[int] = []
        for part in literal.split(text) if literal else [text]:
            if part in ids:
                out.append(ids[part])
                continue
            at = 0
            for run in _BLANKS.finditer(part):
                stop = run.end() - (run.end() < len(part))  # the last blank goes with what follows
                out += enc.encode_ordinary(part[at : run.start()])
                out += enc._encode_single_piece(part[run.start() : stop])
                at = stop
            out += enc.encode_ordinary(part[at:])
        return np.array(out, "<u4")

    def encode(text: str) -> np.ndarray:
        if _BLANKS.search(text):
            return apart(text)
        return enc.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)

    return encode


def _pieces(path: str, added: tuple[tuple[str, int], ...], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(path, added), TaskContext.get().partitionId()
        end, ranks = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for i, text in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist(), strict=True):
                    raw = ids_of(text or "").tobytes() + end
                    n = len(raw) // 4
                    start, k = 0, 0
                    size = n % capacity or capacity
                    while start < n:
                        rows.append((i, k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), int(ranks[size])))
                        ranks[size] += 1
                        start, k, size = start + size, k + 1, capacity
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                cols[1] = cols[1].cast(pa.int32())
                cols.append(pa.array(np.full(len(rows), part, np.int32)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "local", "part"])

    return run


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for all pieces, given how many there are of each length.

    Returns segments (length, first rank, last rank + 1, first sequence, offset, pieces per
    sequence) and the number of sequences: the piece of rank r in a segment goes to sequence
    first + (r - first rank) // per, at offset + ((r - first rank) % per) * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    gaps: list[int] = []  # rooms that some sequences have, ascending

    def put(room: int, filled: tuple[tuple[int, int], ...], many: int) -> None:
        if many:
            if not open_[room]:
                insort(gaps, room)
            open_[room].append((filled, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        big = large[-1]
        at = bisect_left(large, capacity - big + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            put(capacity - big, ((big, 1),), left.pop(big))
        elif mate == big:
            pairs, odd = divmod(left.pop(big), 2)
            put(capacity - 2 * big, ((big, 2),), pairs)
            if odd:  # one is left: it takes the next shorter mate, if any
                if at > 0:
                    other = large[at - 1]
                    left[other] -= 1
                    put(capacity - big - other, ((big, 1), (other, 1)), 1)
                    if not left[other]:
                        del left[other]
                        large.remove(other)
                else:
                    put(capacity - big, ((big, 1),), 1)
        else:
            many = min(left[big], left[mate])
            put(capacity - big - mate, ((big, 1), (mate, 1)), many)
            for n in (big, mate):
                left[n] -= many
                if not left[n]:
                    del left[n]
                    if n == mate:
                        large.remove(n)
        if big not in left:
            large.pop()
    for n in sorted((n for n in left), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                put(capacity, (), -(-todo // (capacity // n)))
                continue
            room = gaps[at]
            filled, many = open_[room].pop()
            if not open_[room]:
                gaps.pop(at)
            per = room // n
            full = min(many, todo // per)
            put(room - per * n, (*filled, (n, per)), full)
            many, todo = many - full, todo - full * per
            if many and todo and todo < per:
                put(room - todo * n, (*filled, (n, todo)), 1)
                many, todo = many - 1, 0
            put(room, filled, many)
    segments, used, rank = [], 0, defaultdict(int)
    for room in sorted(open_):
        for filled, many in open_[room]:
            offset = 0
            for n, per in filled:
                segments.append((n, rank[n], rank[n] + many * per, used, offset, per))
                rank[n] += many * per
                offset += n * per
            used += many if filled else 0
    return segments, used


def _places(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = held.value  # sorted by (length, first rank)
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            lo, hi = np.searchsorted(seg[:, 0], n), np.searchsorted(seg[:, 0], n, side="right")
            while (lo + 1 < hi).any():  # bisection of all rows at once, within their length
                mid = (lo + hi) // 2
                right = (lo + 1 < hi) & (seg[np.minimum(mid, len(seg) - 1), 1] <= rank)
                hi = np.where((lo + 1 < hi) & ~right, mid, hi)
                lo = np.where(right, mid, lo)
            s, r = seg[lo], rank - seg[lo, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[:, 3] + r // s[:, 5]), pa.array(s[:, 4] + r % s[:, 5] * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one per piece.

    Every row of ``docs`` (doc_id, text) is tokenised (null: empty) and ends with
    ``end_id``; rows of more than ``capacity`` tokens are cut, the first piece takes the
    rest. Sequences are gapless from offset 0. An empty table gives no rows; repeated rows
    are packed as often as they come, ties of length in no fixed order; other columns are
    ignored. Texts of any length and runs of any sign are encoded whole. ``tokenizer`` is a path
    that every executor can read; ``added`` maps literal texts to ids of their own, and is
    by default what the default vocabulary adds, or nothing with another ``tokenizer``.
    """
    spark = docs.sparkSession
    if added is None:
        added = {} if tokenizer else default_added()
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        _pieces(tokenizer or default_tokenizer(), tuple(added.items()), capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long, local long, part int",
    )
    cut = stored(cut, "pieces")  # fixed from here on: ranks depend on partitions
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = stored(by_part.withColumn("before", F.coalesce(before, F.lit(0))), "shifts")
    counts = {r[0]: r[1] for r in shift.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    segments, _ = plan(counts, capacity)
    held = spark.sparkContext.broadcast(np.array(sorted(segments), np.int64).reshape(-1, 6))
    ranked = cut.join(shift.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _places(held), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
