"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed on the executors. Trees are fitted on the driver to a bounded
sample of labelled rows (``MAX_SAMPLE``) and flattened into arrays, which every task
traverses for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Labelled rows to which trees are fitted, at most.
MAX_SAMPLE = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_len", "distinct_words", "distinct_pairs", "upper", "digit", "space", "punct", "symbol", "high",
    "newline", "bang", "pipe", "caps_words", "mixed_words", "line_words", "repeat_lines", "top_word", "entropy", "stop_marks", "longest_word",
)
_SYMBOL, _PUNCT = np.array([*b"#$%&*+<=>@^_`|~{}[]\\/"]), np.array([*b".,;:!?'\"()-"])


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; no text and empty texts are all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x]
    share = count[count > 0] / n
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    return [
        np.log1p(n), np.log1p(w), n / w, len(seen) / w, len(set(zip(words, words[1:], strict=False))) / w,
        count[65:91].sum() / n, count[48:58].sum() / n, count[32] / n, count[_PUNCT].sum() / n, count[_SYMBOL].sum() / n, count[128:].sum() / n,
        count[10] / n, count[33] / n, count[124] / n, sum(map(bytes.isupper, words)) / w, sum(map(bytes.isalpha, words)) / w,
        w / len(lines), 1 - len(set(lines)) / len(lines), max(seen.values()) / w, float(-(share * np.log2(share)).sum()),
        count[[33, 46, 63]].sum() / w, np.log1p(max(map(len, words))),
    ]


class Trees:
    """Boosted trees as flat arrays: node k has a feature, a cut, two children, and a value."""

    def __init__(self, feature, cut, left, right, value, roots, base, depth) -> None:
        self.feature, self.cut, self.left, self.right, self.value = feature, cut, left, right, value
        self.roots, self.base, self.depth = roots, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``; all rows take a step of a tree at once."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Histogram boosting for the logistic loss. Leaves loop to themselves, so all paths have ``depth`` steps."""
    n, m = x.shape if x.size else (0, len(FEATURES))
    mean = float(y.mean()) if n else 0.5
    base = float(np.log((mean * n + 1) / ((1 - mean) * n + 1)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(value)
        feature.append(0), cut.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    if n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(m) * bins
        total = np.full(n, base)
        for _ in range(trees if 0 < mean < 1 else 0):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            roots.append(node())
            todo = [(roots[-1], np.arange(n), depth)]
            while todo:
                k, rows, more = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = -rate * gs / (hs + l2)
                total[rows] += 0 if more and len(rows) >= 2 * least else value[k]
                if not more or len(rows) < 2 * least:
                    continue
                at = flat[rows].ravel()
                hist = [np.bincount(at, np.repeat(v[rows], m), m * bins).reshape(m, bins).cumsum(1)[:, :-1] for v in (g, h, np.ones(n))]
                gl, hl, cl = hist
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(cl < least) | (len(rows) - cl < least)] = 0
                j, c = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, c] <= 1e-9 or c >= len(edges[j]):
                    total[rows] += value[k]
                    continue
                feature[k], cut[k] = int(j), float(edges[j][c])
                left[k], right[k] = node(), node()
                goes = binned[rows, j] <= c
                todo += [(left[k], rows[goes], more - 1), (right[k], rows[~goes], more - 1)]
    return Trees(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(value), roots, base, depth)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        x = [[float(v) for v in statistics(t)] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no label is learnt from (a row without id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, **params) -> Trees:
    """Fit to at most ``max_sample`` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    ``labels``: doc_id, quality (0 or 1; other values are ignored). Without labels of both
    kinds every text gets the same score.
    """
    known = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("quality").cast("int").alias("label"), "text")
    seen = rows.mapInArrow(_measure, "doc_id long, label int, x array<double>")
    got = seen.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("r.*").toArrow()  # a row for each picked id
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of partitions
    return fit(x[order], y[order], **params)


def _score(held, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, column])

    return run


def score(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, others) with a score from 0 to 1 for every row in ``column``.

    Null and empty texts are scored as texts without words, repeated rows alike. An existing
    column of that name is replaced.
    """
    docs = docs.drop(column)
    order = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(order).schema.add(column, "double")
    return docs.select(order).mapInArrow(_score(held, column), schema)
