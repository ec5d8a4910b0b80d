"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a fixed row of statistics. Boosted trees of one depth are
fitted on a bounded labelled sample with quantile bins and flattened into
arrays, so a batch of documents is scored by a few numpy gathers per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import bytetext as bt
from reviewlake.llm.labels import SAMPLE_ROWS, held_out, training_rows
from reviewlake.llm.registry import query, table

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "line_words",
    "upper", "digit", "sentence_mark", "bracket", "symbol", "bar", "non_ascii", "control",
    "distinct_words", "repeated_words", "distinct_lines",
    "capital_words", "long_words", "single_words", "marked_words", "all_capital_words",
)
THRESHOLD = 0.5
_UPPER, _LOWER, _DIGIT, _MARK, _BRACKET, _SYMBOL, _BAR, _SPACE, _LINE, _HIGH, _CONTROL = range(11)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _SYMBOL)
    kinds[128:] = _HIGH
    kinds[:32] = _CONTROL
    kinds[127] = _CONTROL
    kinds[65:91], kinds[97:123], kinds[48:58] = _UPPER, _LOWER, _DIGIT
    for kind, members in ((_MARK, ".,;:?!'\""), (_BRACKET, "()[]{}<>"), (_BAR, "|"), (_SPACE, " \t\r"), (_LINE, "\n")):
        kinds[[ord(c) for c in members]] = kind
    return kinds


_CLASS = _byte_classes()


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each row."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=n)


def _piece_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    row_of = np.repeat(np.arange(n) * 16, size)
    kinds = np.bincount(row_of + _CLASS[data], minlength=16 * n).reshape(n, 16).astype(float)
    start, end, row = bt.spans(data, offsets, bt.WHITE)
    hashes, length = bt.span_hashes(data, start, end), end - start
    words = np.bincount(row, minlength=n).astype(float)
    line_start, line_end, line_row = bt.spans(data, offsets, bt.separators("\n"))
    lines = np.bincount(line_row, minlength=n).astype(float)
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == _UPPER)])
    lower = np.concatenate([[0], np.cumsum(_CLASS[data] == _LOWER)])
    capitals = (upper[end] - upper[start] > 1) & (lower[end] == lower[start])
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    last = _CLASS[data[end - 1]] if len(end) else np.zeros(0, int)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) / np.maximum(words, 1)

    bytes_ = np.maximum(size, 1).astype(float)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines),
        np.bincount(row, weights=length, minlength=n) / np.maximum(words, 1),
        words / np.maximum(lines, 1),
        *(kinds[:, k] / bytes_ for k in (_UPPER, _DIGIT, _MARK, _BRACKET, _SYMBOL, _BAR, _HIGH, _CONTROL)),
        _distinct(row, hashes, n) / np.maximum(words, 1),
        share(again),
        _distinct(line_row, bt.span_hashes(data, line_start, line_end), n) / np.maximum(lines, 1),
        share(_CLASS[data[start]] == _UPPER), share(length > 14), share(length == 1),
        share((last == _SYMBOL) | (last == _BAR)), share(capitals),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a null text counts as empty."""
    parts = [_piece_statistics(*piece) for piece in bt.pieces(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)


@dataclass(frozen=True)
class Forest:
    """Trees of one depth in arrays: node ``i`` has children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # trees × inner nodes
    threshold: np.ndarray  # trees × inner nodes; larger values go right
    leaf: np.ndarray  # trees × leaves
    start: float  # log odds before the first tree

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of ``x``."""
        margin = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, ridge: float = 2.0, least_rows: int = 20,
) -> Forest:
    """Second-order boosting of the logistic loss on binned features.

    All nodes of a level are split together from one histogram. Without rows,
    or with one label only, the forest is empty and gives the smoothed share of
    label 1. Equal gains go to the first feature and the lowest bin.
    """
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    # The first cut that is at least the value: value > cut[b] exactly if bin > b.
    slot = binned + np.arange(features) * bins
    usable = np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
    all_feature, all_threshold, all_leaf = [], [], []
    margin = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (features * bins) + slot).ravel()
            sums = [
                np.bincount(place, np.repeat(w, features), width * features * bins)
                .reshape(width, features, bins)
                .cumsum(axis=2)
                for w in (g, h, np.ones(len(y)))
            ]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least_rows) | (nt - nl < least_rows) | ~usable[None]] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            found = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // bins, best % bins
            feature[first : first + width] = np.where(found, f, 0)
            threshold[first : first + width] = [
                cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, found)
            ]
            at = node - first
            right = found[at] & (binned[np.arange(len(y)), f[at]] > b[at])
            node = 2 * node + 1 + right
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin = margin + leaf[at]
        all_feature.append(feature), all_threshold.append(threshold), all_leaf.append(leaf)
    return Forest(np.array(all_feature), np.array(all_threshold), np.array(all_leaf), start)


def train(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample`` labelled texts; only their statistics reach the driver."""

    def rows(batches):
        for batch in batches:
            stats = pa.array(list(statistics(batch.column("text"))), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), stats, batch.column("y")],
                ["doc_id", "digest", "x", "y"],
            )

    found = training_rows(docs, labels, "quality", keep, sample)
    found = found.select(F.col("doc_id").cast("string"), "digest", "text", "y")
    got = found.mapInArrow(rows, "doc_id string, digest long, x array<float>, y double").toPandas()
    got = got.sort_values(["doc_id", "digest"], kind="stable")
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(STATISTICS))
    return fit_forest(x, got["y"].to_numpy(np.float64))


def quality_score(text: Column, forest: Forest) -> Column:
    """Probability that a text is good; null and empty texts get a score as well.

    Depends on the whole text alone: equal texts have equal scores, other
    columns are not read, and an empty table gives no scores.
    """

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(forest.score(statistics(texts)), pa.float64())

    return scored(text)


def quality_filter(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, columns unchanged.

    Repeated rows stay or go together, null and empty texts by their score like
    any other; columns may have any names, and an empty table gives an empty one.
    """
    forest = train(docs, labels, F.lit(True) if keep is None else keep)
    return docs.where(quality_score(F.col("text"), forest) >= THRESHOLD)


@query()
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document; labels of crc32(doc_id) mod 3 = 1 are held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = held_out(F.col("doc_id"), 3, 1)
    forest = train(docs, labels, ~held)
    scored = docs.select("doc_id", held.alias("held_out"), quality_score(F.col("text"), forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
