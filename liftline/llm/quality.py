"""Quality classifier: gradient-boosted histogram trees over document statistics.

The statistics are computed inside tasks, from the bytes and word hashes of the whole
texts. Trees are grown on binned statistics of a bounded sample of labelled rows and
flattened into arrays; scoring walks all rows of a batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm import text as T
from liftline.llm.shared import settle

# At most so many labelled rows are fitted on, those with the least hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 60, 4, 64, 0.15, 10, 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "space": [32], "line": [10], "stop": [46], "comma": [44], "bang": [33], "query": [63],
    "hash": [35], "cash": [36], "rate": [37], "and": [38], "star": [42], "pipe": [124],
    "brace": [60, 62, 91, 93, 123, 125], "slash": [47, 92], "join": [45, 95], "at": [64],
    "equal": [43, 61], "colon": [58, 59], "quote": [34, 39, 96], "round": [40, 41],
    "control": [*range(0, 9), *range(14, 32), 127],
}
_NAMES = [
    "bytes", "words", "lines", *_CLASSES, "entropy", "word_mean", "word_sd", "word_max",
    "distinct_words", "distinct_pairs", "same_as_last", "same_as_last_but_one", "line_words",
]
N_STATS = len(_NAMES)


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different hashes per text."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = np.sort((owner << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=len(first) - 1)


def statistics(piece: T.Slice) -> np.ndarray:
    """One row of ``N_STATS`` numbers per text; a text without words has mostly zeros."""
    n = piece.n
    length = np.diff(piece.offsets)
    owner = np.repeat(np.arange(n), length)
    counts = np.bincount(owner * 256 + piece.data, minlength=n * 256).reshape(n, 256).astype(float)
    size = np.maximum(length, 1)[:, None]
    share = counts / size
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0.0), axis=1)
    starts, ends, first = T.words(piece)
    h = T.span_hashes(piece.data, starts, ends)
    n_words = np.diff(first)
    most = np.maximum(n_words, 1)
    width = (ends - starts).astype(float)
    text = np.repeat(np.arange(n), n_words)
    total = np.bincount(text, width, n)
    square = np.bincount(text, width * width, n)
    mean = total / most
    widest = np.zeros(n)
    np.maximum.at(widest, text, width)

    def repeats(step: int) -> np.ndarray:
        if len(h) <= step:
            return np.zeros(n)
        same = (h[step:] == h[:-step]) & (text[step:] == text[:-step])
        return np.bincount(text[step:], same, n) / most

    pairs, begin = T.shingle_hashes(h, first, 2)
    lines = counts[:, 10] + 1
    columns = [
        np.log1p(length), np.log1p(n_words), np.log(lines),
        *[share[:, list(codes)].sum(axis=1) for codes in _CLASSES.values()],
        entropy, mean, np.sqrt(np.maximum(square / most - mean**2, 0)), np.log1p(widest),
        _distinct(h, first) / most, _distinct(pairs, begin) / np.maximum(np.diff(begin), 1),
        repeats(1), repeats(2), np.log1p(n_words / lines),
    ]
    return np.column_stack(columns).astype(np.float32)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(piece) for piece in T.slices(batch.column("text"))]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_STATS)
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` for every row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_statistics_of, "doc_id long, stats array<float>")


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node ``i`` sends values above ``cut[i]`` to ``child[i] + 1``."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # a leaf is its own child
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for every row of ``x``."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.child[node] != node
                above = x[rows, self.feature[node]] > self.cut[node]
                node = np.where(inner, self.child[node] + above, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees on logistic loss; without rows every score is 0.5."""
    none = np.zeros(0, np.int64)
    if len(y) == 0:
        return Forest(0.0, none, none, np.zeros(0), none, np.zeros(0))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, f], quantiles, method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    flat = binned + np.arange(x.shape[1]) * BINS
    score = np.full(len(y), base)
    feature, cut, child, value, roots = [], [], [], [], []

    def leaf(at: int, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> None:
        value[at] = -RATE * grad[rows].sum() / (hess[rows].sum() + RIDGE)
        score[rows] += value[at]

    def new() -> int:
        feature.append(0), cut.append(0.0), child.append(len(child)), value.append(0.0)
        return len(feature) - 1

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(new())
        level = [(roots[-1], np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            following = []
            for at, rows in level:
                if depth == DEPTH or len(rows) < 2 * LEAST_LEAF:
                    leaf(at, rows, grad, hess)
                    continue
                bins, size = flat[rows].ravel(), BINS * x.shape[1]
                width = x.shape[1]
                g = np.bincount(bins, np.repeat(grad[rows], width), size).reshape(width, BINS).cumsum(1)
                s = np.bincount(bins, np.repeat(hess[rows], width), size).reshape(width, BINS).cumsum(1)
                c = np.bincount(bins, minlength=size).reshape(width, BINS).cumsum(1)
                whole_g, whole_s = g[:, -1:], s[:, -1:]
                gain = g**2 / (s + RIDGE) + (whole_g - g) ** 2 / (whole_s - s + RIDGE) - whole_g**2 / (whole_s + RIDGE)
                gain[(c < LEAST_LEAF) | (len(rows) - c < LEAST_LEAF)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    leaf(at, rows, grad, hess)
                    continue
                feature[at], cut[at] = int(f), float(cuts[f][b])
                child[at] = new()
                new()
                above = binned[rows, f] > b
                following += [(child[at], rows[~above]), (child[at] + 1, rows[above])]
            level = following
    as_ints = [np.array(v, np.int64) for v in (roots, feature, child)]
    return Forest(base, as_ints[0], as_ints[1], np.array(cut), as_ints[2], np.array(value))


def train(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Fits on rows of ``stats`` with a label of ``labels`` (``doc_id``, ``label`` 0 or 1).

    At most ``fit_rows`` rows reach the driver, as numbers, those with the least hash of
    doc_id. Null doc_ids and labels teach nothing; a doc_id with several labels counts
    once for each different one.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label").distinct()
    sample = (
        stats.join(known, "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "stats", F.col("label").cast("double").alias("y"))
        .orderBy("h", "doc_id", "y")
        .limit(fit_rows)
        .toArrow()
    )
    flat = sample.column("stats").combine_chunks().flatten() if sample.num_rows else pa.array([], pa.float32())
    x = np.asarray(flat, np.float32).reshape(-1, N_STATS)
    return fit(x, sample.column("y").to_numpy())


def score_rows(stats: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, ``score`` for every row of ``stats``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten(), np.float32).reshape(-1, N_STATS)
            score = pa.array(forest.score(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(scored, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) of every row of ``docs`` (``doc_id``, ``text``).

    ``labels`` has ``doc_id`` and ``label``; only the text enters a score. A null text
    counts as empty, and empty texts are scored like others. Rows that repeat a doc_id
    are scored each by its own text. Without labels every score is 0.5.
    """
    stats = settle(document_statistics(docs), "statistics")
    return score_rows(stats, train(stats, labels, fit_rows))


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns as they are."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            good = [forest.score(statistics(piece)) >= least for piece in T.slices(column)]
            yield batch.filter(pa.array(np.concatenate([*good, np.zeros(0, bool)])))

    return docs.mapInArrow(passed, docs.schema)
