"""Benchmark decontamination: a broadcast hash set of test n-grams meets training windows.

The benchmark's (item, n-gram) pairs are counted first. Up to ``MAX_GRAMS`` of them are
broadcast and the texts are scanned without a shuffle. A larger benchmark is dealt by hash
into blocks of about that many; each block is collected, broadcast, scanned and released
before the next, so neither the driver nor a task ever holds more than one. The few texts
that a block hits are stored by their digest and meet their rows in the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, alnum_words, odd_powers, sliced

#: Pairs of item and n-gram (of n words) that one broadcast holds.
MAX_GRAMS = 200_000
#: log2 of the bits of the first filter.
FILTER_BITS = 22

#: Columns that texts carry along while they pass through the blocks.
_MARKS, _ITEMS, _TEXT = "__marked_words", "__found_items", "__text_digest"


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            items, grams = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = alnum_words(text or "")
                for i in range(max(1, len(w) - n + 1) if w else 0):
                    items.append(item)
                    grams.append(b" ".join(w[i : i + n]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(grams, pa.binary())], ["item", "gram"])

    return run


class GramSet:
    """Hash set of n-grams with their items; ``hits`` verifies every match on the words."""

    def __init__(self, rows: list[tuple[str | None, bytes]]) -> None:
        self.items: dict[bytes, set[str]] = defaultdict(set)
        for item, gram in rows:
            self.items[gram].update([] if item is None else [item])
        self.word = {w: xxhash.xxh3_64_intdigest(w) | 1 for g in self.items for w in g.split(b" ")}
        by_len = defaultdict(list)
        for g in self.items:
            by_len[g.count(b" ") + 1].append(g)
        self.keys, self.filters = {}, {}
        for k, gs in by_len.items():
            h = np.array([self._hash(self._ids(g.split(b" ")), k)[0] for g in gs], np.uint64)
            self.keys[k] = np.unique(h)
            self.filters[k] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[k][h >> np.uint64(64 - FILTER_BITS)] = True

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.word.get, words, repeat(0)), np.uint64, len(words))

    @staticmethod
    def _hash(ids: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(ids) - k + 1, np.uint64)
        for j, m in enumerate(odd_powers(k, k)):
            out += ids[j : len(ids) - k + 1 + j] * m
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Marks of the words inside occurrences (None without any), and the items that occur."""
        ids, found, marks = self._ids(words), set(), None
        for k, keys in self.keys.items():
            if len(words) < k:
                continue
            h = self._hash(ids, k)
            at = np.flatnonzero(self.filters[k][h >> np.uint64(64 - FILTER_BITS)])
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            for i in at.tolist():
                items = self.items.get(b" ".join(words[i : i + k]))
                if items is not None:
                    if marks is None:
                        marks = np.zeros(len(words), bool)
                    marks[i : i + k] = True
                    found |= items
        return marks, found


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = GramSet(held.value)
        for b in sliced(batches):
            marks_out, items_out = [], []
            for text in b.column("text").to_pylist():
                marks, found = grams.hits(alnum_words(text or ""))
                marks_out.append(None if marks is None else np.packbits(marks).tobytes())
                items_out.append(sorted(found))
            b = b.append_column(_MARKS, pa.array(marks_out, pa.binary()))
            yield b.append_column(_ITEMS, pa.array(items_out, pa.list_(pa.string())))

    return run


def _hit_texts(held):
    """Digest, marks and items of the texts that a block hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = GramSet(held.value)
        for b in sliced(batches):
            rows = []
            for text in b.column(0).to_pylist():
                marks, found = grams.hits(alnum_words(text or ""))
                if marks is not None:
                    rows.append((sha256(text.encode("utf-8")).hexdigest(), np.packbits(marks).tobytes(), sorted(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            kinds = (pa.string(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [_TEXT, _MARKS, _ITEMS])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = [np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in ms]).tobytes() for ms in b.column(_MARKS).to_pylist()]
        yield b.set_column(1, _MARKS, pa.array(marks, pa.binary()))


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _marked(docs: DataFrame, bench: DataFrame, n: int, max_grams: int) -> DataFrame:
    """``docs`` with packed marks of hit words and the items found."""
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession, "decontamination")
    item = bench.select(F.col("item_id").cast("string"), "text")
    grams, path = tables.put(item.mapInArrow(_grams(n), "item string, gram binary").distinct())
    blocks = max(1, -(-grams.count() // max_grams))

    def block(k: int):
        rows = grams.filter(F.pmod(F.xxhash64("item", "gram"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in rows])

    marks = f"{_MARKS} binary, {_ITEMS} array<string>"
    if blocks == 1:
        held = block(0)
        tables.drop(path)
        return docs.mapInArrow(_scan(held), StructType([*docs.schema.fields, *StructType.fromDDL(marks).fields]))
    found = []
    for k in range(blocks):
        held = block(k)
        hits = docs.select("text").mapInArrow(_hit_texts(held), f"{_TEXT} string, {marks}")
        found.append(tables.put(hits.dropDuplicates([_TEXT])))
        held.destroy()
    each = reduce(DataFrame.unionByName, [df for df, _ in found])
    each = each.groupBy(_TEXT).agg(F.collect_list(_MARKS).alias(_MARKS), F.array_distinct(F.flatten(F.collect_list(_ITEMS))).alias(_ITEMS))  # a row per block at most
    each, _ = tables.put(each.mapInArrow(_united, f"{_TEXT} string, {marks}"))
    tables.drop(path, *[p for _, p in found])
    rows = docs.withColumn(_TEXT, F.sha2(F.col("text").cast("binary"), 256)).join(each, _TEXT, "left")
    return rows.withColumn(_ITEMS, F.coalesce(_ITEMS, F.array().cast("array<string>"))).select(*docs.columns, _MARKS, _ITEMS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for b in sliced(batches):
        n_words, n_hit, spans = [], [], []
        for text, packed in zip(b.column("text").to_pylist(), b.column(_MARKS).to_pylist(), strict=True):
            n = len(alnum_words(text or ""))
            marks = np.zeros(n, np.int8) if packed is None else _unpacked(packed, n).astype(np.int8)
            edge = np.flatnonzero(np.diff(marks, prepend=0, append=0)).tolist()
            n_words.append(n), n_hit.append(int(marks.sum()))
            spans.append([{"start": s, "stop": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), b.column(_ITEMS), pa.array(spans, kind)],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )


def is_contaminated(n_hit: int, n_words: int) -> bool:
    """At least a twentieth of the words is hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        keep = []
        for text, packed in zip(b.column("text").to_pylist(), b.column(_MARKS).to_pylist(), strict=True):
            n = 0 if packed is None else len(alnum_words(text))
            keep.append(packed is None or not is_contaminated(int(_unpacked(packed, n).sum()), n))
        yield b.filter(pa.array(keep, pa.bool_())).drop_columns([_MARKS, _ITEMS])


def benchmark_hits(docs: DataFrame, bench: DataFrame, n: int = 13, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_words, n_hit, items, spans``.

    Words: A-Z lower-cased, runs of ASCII letters and digits and of non-ASCII characters.
    A window is ``n`` consecutive words of an item (item_id, text); an item of fewer words,
    but not none, is one window. ``n_hit`` counts words inside any occurrence of a window,
    ``spans`` are their maximal runs [start, stop) by word, ``items`` the ids (as strings)
    of items that occur. Null and empty texts have no words and no hits; items without id
    mark words, but aren't listed. Repeated rows are kept, other columns ignored.
    """
    out = _marked(docs.select(F.col("doc_id").cast("long"), "text"), bench, n, max_grams)
    return out.mapInArrow(_runs, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>")


def decontaminated(docs: DataFrame, bench: DataFrame, n: int = 13, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``docs`` (text and any other columns) without the rows that :func:`is_contaminated` names.

    Null and empty texts, rows without id and repeated rows stay; so does every row where the
    benchmark is empty.
    """
    return _marked(docs, bench, n, max_grams).mapInArrow(_clean, docs.schema)
