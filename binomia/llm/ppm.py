"""Scoring by prediction by partial matching: a byte-context trie learnt from the corpus.

A text is coded byte by byte: its words (A-Z lower-cased, split on white space), each closed
by a blank, then an end. The context of a byte is what precedes it in the text, from a blank
before the first word on, at most ``order`` bytes; contexts run over the ends of words.

The trie holds, per context, how often each symbol follows in the training texts. A symbol is
sought in the longest context that was ever seen; where it didn't follow, the model escapes to
the next shorter one, without the symbols that the longer one has (symbol exclusion). With
``q`` symbols and ``T`` occurrences left in a context, escaping costs ``q / 2T`` and a symbol
seen ``n`` times ``(2n - 1) / 2T`` (the D estimate); below the empty context all symbols not
seen at all are alike. For every context the probabilities of all symbols sum to one.

The unit of work is the gram, a context and the symbol after it:

* grams and words are counted inside tasks, then by Spark;
* grams meet by the last three bytes of their context (at most 256^3 grams of the default
  order share these), where all longer contexts of the trie are complete; the trie of shorter
  contexts (at most 256^3 cells) goes to every task. So each gram gets its probability;
* the most frequent grams and words (at most ``FREQUENT`` and ``FREQUENT_WORDS``, by a count of
  counts) are broadcast and summed inside texts; all other grams and words of a text are joined
  with what belongs to them, once per distinct text.

Frequent words are known by 64-bit hashes: of m distinct words some one is taken for a
frequent one with odds of about ``FREQUENT_WORDS * m / 2^64`` (10^-3 at 10^10 words).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, longs, odd_powers, sliced, space_words

#: Bytes of the longest context.
ORDER = 5
#: Bytes by whose contexts grams meet; shorter contexts are known to every task.
SHARED = 3
#: Grams and words at most that every task knows, and the greatest length of such words in bytes.
FREQUENT, FREQUENT_WORDS, WORD_BYTES = 1 << 21, 1 << 20, 64
#: Distinct words and grams that a task counts before it hands them on, and bytes that it counts at once.
HELD_WORDS, HELD_GRAMS, BLOCK = 600_000, 1_500_000, 1 << 21
#: Grams of one step of a task, and rows of one partition.
STEP, PART = 200_000, 500_000
#: Texts that a task remembers so that copies send no words.
SEEN = 100_000
#: Symbols: all bytes but the six white ones, the blank that closes a word, the end.
SYMBOLS = 252

_SIZE = np.uint64(56)
_BYTE = np.uint64(8)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that nothing is learnt from (a row without id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(True))


def coded(words: list[bytes]) -> bytes:
    """A text as the bytes that are coded, after the blank that all start from."""
    return b" ".join([b"", *words, b"\n"])


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each coded byte of the texts, and where those of each text start.

    A gram holds the context and the symbol in its low bytes and the context's length in its top byte.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(sizes) - sizes
    gram, wide = flat.astype(np.uint64), flat.astype(np.uint64)
    for j in range(1, order + 1):
        wide <<= _BYTE
        gram[j:] |= wide[:-j] if j < len(wide) else wide[:0]
    size = np.full(len(flat), order, np.uint64)
    for j in range(order):  # texts start anew
        at = first[sizes > j] + j
        size[at] = j
        gram[at] &= _mask(j + 1)
    gram |= size << _SIZE
    keep = np.ones(len(flat), bool)
    keep[first] = False
    return gram[keep], first - np.arange(len(texts))


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(n[order], first) if len(keys) else n[:0]


def _found(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``q`` in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


class Level:
    """Contexts of one length: cells (context and symbol), then per context its total, its symbols, and what these make up one level below."""

    def __init__(self, size: int, cells: np.ndarray, n: np.ndarray, below: Level | None) -> None:
        self.cells, self.n = cells, n
        self.contexts, first = np.unique(cells >> _BYTE, return_index=True)
        some = len(cells) > 0
        self.total = np.add.reduceat(n, first) if some else n
        self.symbols = np.diff(np.append(first, len(cells)))
        self.excluded = np.zeros(len(first), np.int64)
        if below is not None and some:
            self.excluded = np.add.reduceat(below.n[np.searchsorted(below.cells, cells & _mask(size))], first)


def _grown(out: list[Level], grams: np.ndarray, n: np.ndarray, top: int) -> list[Level]:
    size = grams >> _SIZE
    for k in range(len(out), top + 1):
        long = (size >= k) & (n > 0)
        out.append(Level(k, *_sums(grams[long] & _mask(k + 1), n[long]), out[-1] if out else None))
    return out


def low_levels(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of contexts shorter than :data:`SHARED` bytes, from trained grams cut to that."""
    return _grown([], grams, n, SHARED - 1)


def levels(grams: np.ndarray, n: np.ndarray, low: list[Level], top: int) -> list[Level]:
    """Levels up to contexts of ``top`` bytes, from ``low`` and all grams of the longer contexts."""
    return _grown(list(low), grams, n, top)


def log_probabilities(grams: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's symbol in its context."""
    size, out = (grams >> _SIZE).astype(np.int64), np.zeros(len(grams))
    todo, gone, seen = np.ones(len(grams), bool), np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(len(trie) - 1, -1, -1):
        level, rows = trie[k], np.flatnonzero(todo & (size >= k))
        at, there = _found(level.contexts, grams[rows] >> _BYTE & _mask(k))
        rows, at = rows[there], at[there]
        left, fresh = level.total[at] - gone[rows], level.symbols[at] - seen[rows]
        cell, hit = _found(level.cells, grams[rows] & _mask(k + 1))
        out[rows[hit]] += np.log10((2 * level.n[cell[hit]] - 1) / (2 * left[hit]))
        escaped = ~hit & (fresh > 0)
        out[rows[escaped]] += np.log10(fresh[escaped] / (2 * left[escaped]))
        todo[rows[hit]] = False
        gone[rows], seen[rows] = level.excluded[at], level.symbols[at]
    out[todo] -= np.log10(SYMBOLS - seen[todo])
    return out


class Places:
    """Places of 64-bit keys in a sorted array, by hash tables; each takes what the one before couldn't hold."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables, rest = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(rest):
            mult, shift = odd_powers(1, len(self.tables) + 1)[0], np.uint64(64 - max(10, (2 * len(rest)).bit_length()))
            at = self._slots(keys[rest], mult, shift)
            table = np.full(1 << 64 - int(shift), -1, np.int32)
            table[at] = rest
            self.tables.append((mult, shift, table))
            rest = rest[table[at] != rest]

    @staticmethod
    def _slots(keys: np.ndarray, mult: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(31)) * mult >> shift).astype(np.int64)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        """The place of each of ``q``, -1 where it isn't there."""
        out, todo = np.full(len(q), -1, np.int32), np.arange(len(q))
        for mult, shift, table in self.tables:
            at = table[self._slots(q[todo], mult, shift)]
            hit = (at >= 0) & (self.keys[at] == q[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
        return out


def _merged(held: tuple[np.ndarray, np.ndarray], gram: np.ndarray, learns: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted held grams and of more, which count only if they are learnt from."""
    gram = np.sort(gram)
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(gram))) * int(learns)
    return _sums(np.concatenate([held[0], gram[first]]), np.concatenate([held[1], n]))


_NONE = (np.empty(0, np.uint64), np.empty(0, np.int64))


def _counted(order: int):
    """Words and grams of texts (learns, text), with their number in those that are learnt from."""

    def rows(words: list[bytes] | None, grams: np.ndarray | None, n) -> Iterator[pa.RecordBatch]:
        size = len(n)
        words = pa.nulls(size, pa.binary()) if words is None else pa.array(words, pa.binary())
        grams = pa.nulls(size, pa.int64()) if grams is None else longs(grams)
        t = pa.table([words, grams, pa.array(n, pa.int64())], ["word", "gram", "n"])
        yield from t.to_batches(max_chunksize=50_000)

    def word_rows(words: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        known = sorted(words)  # neighbours share bytes: shuffled blocks get smaller
        return rows(known, None, [words[w] for w in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams, held, size = _NONE, {True: [], False: []}, 0
        for b in sliced(batches):
            for learns, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = space_words(text or "")
                words.update(found if learns else dict.fromkeys(found, 0))
                held[learns].append(coded(found))
                size += len(held[learns][-1])
                if len(words) >= HELD_WORDS:
                    yield from word_rows(words)
                    words.clear()
                if size >= BLOCK:
                    for learns, texts in held.items():
                        grams = _merged(grams, grams_of(texts, order)[0], learns)
                        texts.clear()
                    size = 0
                    if len(grams[0]) >= HELD_GRAMS:
                        yield from rows(None, *grams)
                        grams = _NONE
        for learns, texts in held.items():
            grams = _merged(grams, grams_of(texts, order)[0], learns)
        yield from rows(None, *grams)
        yield from word_rows(words)

    return run


def _steps(batches: Iterator[pa.RecordBatch], group: Callable[[pa.RecordBatch], np.ndarray], least: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups, each of ``least`` rows or more but for the last."""
    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        g, at = group(b), 0
        for start in np.flatnonzero(np.append(last is None or g[0] != last, g[1:] != g[:-1])).tolist():
            if size + start - at >= least:
                yield pa.Table.from_batches([*held, b.slice(at, start - at)])
                held, size, at = [], 0, start
        held.append(b.slice(at))
        size, last = size + b.num_rows - at, g[-1]
    if held:
        yield pa.Table.from_batches(held)


def _gram_scores(low, order: int):
    """log10 probabilities of grams (gram, n), which come sorted by their last bytes of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = low_levels(*low.value)
        for t in _steps(batches, lambda b: b.column(0).to_numpy().view(np.uint64) >> _BYTE & _mask(SHARED), STEP):
            gram, n = t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
            lp = log_probabilities(gram, levels(gram, n, first, order))
            yield pa.RecordBatch.from_arrays([longs(gram), pa.array(n), pa.array(lp)], ["gram", "n", "lp"])

    return run


_TEXT_COLUMNS = ["doc_id", "learns", "digest", "n_tokens", "known", "base", "lp", "words", "grams"]
_TEXT_SCHEMA = (
    "doc_id long, learns boolean, digest binary, n_tokens long, known long, base double, lp double, "
    "words array<struct<word: binary, m: bigint>>, grams array<bigint>"
)


def _texts(frequent, order: int):
    """Texts (doc_id, learns, text) with sums over what is frequent; the other words and grams of one of equal texts."""
    words_kind = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_keys, word_base, gram_keys, gram_lp = frequent.value
        hashes, seen, of_word, of_gram = WordHashes(), set(), Places(word_keys), Places(gram_keys)
        for b in sliced(batches, 100):
            texts, rows, fresh, other_words = [], [], [], []
            for text in b.column(2).to_pylist():
                text = text or ""
                digest = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                found = space_words(text)
                texts.append(coded(found))
                if len(seen) >= SEEN:
                    seen.clear()
                fresh.append(digest not in seen)
                seen.add(digest)
                words = Counter(found)
                m = np.fromiter(words.values(), np.int64, len(words))
                at = of_word(hashes.of(words))
                there = at >= 0
                rows.append((digest, len(found) + 1, int(m[there].sum()), float(word_base[at[there]] @ m[there])))
                other_words.append([{"word": w, "m": k} for w, k, t in zip(words, m.tolist(), there.tolist(), strict=True) if not t] if fresh[-1] else None)
            grams, first = grams_of(texts, order)
            at = of_gram(grams)
            there = at >= 0
            lp = np.add.reduceat(np.where(there, gram_lp[at], 0.0) if len(gram_lp) else np.zeros(len(at)), first) if len(first) else np.empty(0)
            other_grams = [np.sort(g[~t]).view(np.int64) if f else None for g, t, f in zip(np.split(grams, first[1:]), np.split(there, first[1:]), fresh, strict=True)] if len(first) else []
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)]
            arrays += [pa.array(lp), pa.array(other_words, words_kind), pa.array(other_grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], _TEXT_COLUMNS)

    return run


def _sorted_columns(df: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    """A bounded table on the driver, sorted by its 64-bit key."""
    t = df.select(key, *values).toArrow()
    keys = t.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return [keys[order], *(t.column(v).to_numpy()[order] for v in values)]


def _most_frequent(df: DataFrame, most: int) -> DataFrame:
    """Rows (n, ...) with the greatest n, at most ``most``: all down to a step of an eighth of a power of two."""
    step = F.floor(8 * F.log2("n"))
    steps = df.filter("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("step")).collect()  # a row per step
    total, least = 0, None
    for s in steps:
        total += s["c"]
        if total > most:
            break
        least = s["step"]
    return df.filter((F.col("n") > 0) & (step >= least)) if least is not None else df.filter("false")


def lm_scores(docs: DataFrame, learns: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, learns, n_tokens, n_known, train_tokens, base_score, score``.

    The model is learnt from the rows where ``learns`` is true (null counts as false).
    ``n_tokens`` counts words and the end, ``n_known`` those that occur in training texts,
    ``train_tokens`` all tokens of these. ``score`` is the log10 probability of the text by
    the trie of contexts up to ``order`` bytes (3 to 6), ``base_score`` that of its tokens by
    their frequency with one half added. Null and empty texts are one end. Without training
    texts all symbols are alike and ``base_score`` is null. Equal texts have equal scores,
    repeated rows are returned as often as they come, rows without id are scored, too; other
    columns are ignored. The tables that the result is read from stay in the shared folder.
    """
    if not SHARED <= order <= 6:
        raise ValueError(f"contexts of {SHARED} to 6 bytes")
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession, "ppm")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(text_col).alias("text"))
    counted = docs.select("learns", "text").mapInArrow(_counted(order), "word binary, gram long, n long")
    counted, p_counted = tables.put(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")))
    words, grams = counted.filter("word is not null").select("word", "n"), counted.filter("gram is not null").select("gram", "n")
    ends = docs.filter("learns").count()
    known = F.count(F.when(F.col("n") > 0, 1))
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), known).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    n_grams = grams.count()

    # the trie
    short = F.least(F.shiftrightunsigned("gram", 56), F.lit(SHARED - 1))
    bits = F.when(short == 0, F.lit((1 << 8) - 1)).when(short == 1, F.lit((1 << 16) - 1)).otherwise(F.lit((1 << 24) - 1))
    cut = F.col("gram").bitwiseAND(bits).bitwiseOR(F.shiftleft(short.cast("long"), 56)).alias("gram")
    low = _sorted_columns(grams.filter("n > 0").groupBy(cut).agg(F.sum("n").alias("n")), "gram", "n")  # at most 256^3 + 256^2 rows
    held = spark.sparkContext.broadcast(low)
    group = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    scored = grams.repartition(max(1, -(-n_grams // PART)), group).sortWithinPartitions(group)
    scored, p_scored = tables.put(scored.mapInArrow(_gram_scores(held, order), "gram long, n long, lp double"))

    # texts
    base = lambda n: F.log10((n + 0.5) / F.lit(tokens + 0.5 * (kinds + 1))) if tokens else F.lit(None).cast("double")
    words = words.withColumn("base", base(F.col("n")))
    top = _most_frequent(words.filter(F.octet_length("word") <= WORD_BYTES), FREQUENT_WORDS)
    top = _sorted_columns(_hashed(top), "key", "base")
    frequent = spark.sparkContext.broadcast((*top, *_sorted_columns(_most_frequent(scored, FREQUENT), "gram", "lp")))
    texts, p_texts = tables.put(docs.mapInArrow(_texts(frequent, order), _TEXT_SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    first, p_first = tables.put(texts.filter("words is not null").groupBy("digest").agg(F.min("row").alias("row")))
    rare = texts.filter("size(words) > 0 or size(grams) > 0").join(first.select("row"), "row", "left_semi")
    by_word = rare.select("row", F.inline("words")).join(words, "word").groupBy("row")
    by_word = by_word.agg(F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more_known"), F.sum(F.col("m") * F.col("base")).alias("more_base"))
    by_gram = rare.select("row", F.explode("grams").alias("gram")).join(scored.select("gram", "lp"), "gram").groupBy("row").agg(F.sum("lp").alias("more_lp"))
    summed, p_summed = tables.put(first.join(by_word, "row", "left").join(by_gram, "row", "left").drop("row"))
    tables.drop(p_counted, p_scored, p_first)
    out = texts.drop("words", "grams", "row").join(summed, "digest", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    end_base = F.lit(float(np.log10((ends + 0.5) / (tokens + 0.5 * (kinds + 1))))) if tokens else F.lit(None).cast("double")
    return out.select(
        "doc_id",
        "learns",
        "n_tokens",
        (plus("known", "more_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (plus("base", "more_base") + end_base).alias("base_score"),
        plus("lp", "more_lp").alias("score"),
    )


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, b.column(0).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([longs(keys), b.column(1)], ["key", "base"])


def _hashed(words: DataFrame) -> DataFrame:
    """Words under their 64-bit hashes, with what a token of theirs adds to the base score."""
    return words.select("word", "base").mapInArrow(_hash_words, "key long, base double")
