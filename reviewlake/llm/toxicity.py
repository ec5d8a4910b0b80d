"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A document is a bag of sentences. Each sentence has a probability from the
words it holds, and the document is toxic unless none of its sentences is
(noisy-or). A leak, one probability for all documents, takes up labels that no
sentence explains, so long clean documents do not add up to toxic ones. The weights are fitted to document labels through that formula, so
the sentence scores point out where the offence lies.
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

THRESHOLD = 0.3
# The prior of the weights: a word has one if its share among toxic documents is as
# far from chance as this (chi-squared, one degree of freedom); however many those are.
LEAST_CHI2 = 30.0
_STOPS = bt.separators(".!?\n\r")
_RESULT = pa.struct(
    [("score", pa.float64()), ("sentence_score", pa.float64()), ("sentence_index", pa.int64()), ("sentence", pa.string())]
)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass(frozen=True)
class Bags:
    """Sentences that hold a known word, and how many sentences a document has."""

    sentence_row: np.ndarray  # document of each such sentence
    sentence_number: np.ndarray  # its 0-based place in the document
    entry_sentence: np.ndarray  # word entries: index into the sentences
    entry_word: np.ndarray  # word entries: index into the vocabulary
    sentences: np.ndarray  # per document, all sentences with a word


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray
    bias: float
    leak: float  # -log of the probability that a label is not set without a cause

    def sentence_logits(self, bags: Bags) -> np.ndarray:
        n = len(bags.sentence_row)
        return self.bias + np.bincount(bags.entry_sentence, self.weight[bags.entry_word], n)

    def unharmed(self, bags: Bags, logits: np.ndarray) -> np.ndarray:
        """-log of the probability that no sentence is toxic."""
        # A sentence without a known word is no cause, so length alone adds nothing.
        return self.leak + np.bincount(bags.sentence_row, _softplus(logits), len(bags.sentences))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = bt.lower_ascii(data)
    start, end, row = bt.spans(low, offsets, bt.NOT_WORD)
    return bt.span_hashes(low, start, end), start, row


def _sentence_of(data, offsets, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sentence of each word, sentence bounds)``; only sentences with a word count."""
    first, last, _ = bt.spans(data, offsets, _STOPS)
    index = np.searchsorted(first, start, "right") - 1
    used, index = np.unique(index, return_inverse=True)
    return index, first[used], last[used]


def _bags(data, offsets, words) -> tuple[Bags, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    hashes, start, row = _words(data, offsets)
    sentence, first, last = _sentence_of(data, offsets, start)
    owner = np.searchsorted(offsets, first, "right") - 1
    count = np.bincount(owner, minlength=n)
    place = np.arange(len(first)) - (np.cumsum(count) - count)[owner]
    at = np.searchsorted(words, hashes)
    at[at == len(words)] = 0
    hit = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
    # A word counts once per sentence.
    pairs = np.unique(np.stack([sentence[hit], at[hit]], axis=1), axis=0)
    used, entry = np.unique(pairs[:, 0], return_inverse=True)
    bags = Bags(owner[used], place[used], entry, pairs[:, 1], count)
    return bags, first[used], last[used]


def slopes(model: Model, bags: Bags, y: np.ndarray) -> np.ndarray:
    """Gradient of the mean log likelihood by the weights, the bias and the log of the leak."""
    n = len(y)
    logits = model.sentence_logits(bags)
    total = np.maximum(model.unharmed(bags, logits), 1e-9)
    # d(log likelihood)/d(total): -1 for clean documents.
    slope = np.where(y > 0, 1 / np.expm1(np.minimum(total, 50)), -1.0)
    at = slope[bags.sentence_row] / (1 + np.exp(-logits))
    by_word = np.bincount(bags.entry_word, at[bags.entry_sentence], len(model.words))
    return np.concatenate([by_word, [at.sum(), slope.sum() * model.leak]]) / n


def fit(bags: Bags, y: np.ndarray, words: np.ndarray, steps: int = 400, ridge: float = 1e-5) -> Model:
    """Maximum likelihood of the document labels under noisy-or, by Adam."""
    n, width = len(y), len(words)
    # The weights, the logit they are added to, the log of the leak.
    # Weights start well above zero: near zero, sentence scores have no slope.
    theta = np.full(width + 2, 4.0)
    theta[-2:] = -9.0, np.log(np.clip(y.mean() if n else 0.0, 0.01, 0.9) / 2)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1) if n else ():
        model = Model(words, theta[:-2], theta[-2], np.exp(theta[-1]))
        gradient = slopes(model, bags, y)
        gradient[:-2] -= ridge * theta[:-2]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        theta[-2] = np.clip(theta[-2], -14, -8)
    return Model(words, theta[:-2], float(theta[-2]), float(np.exp(theta[-1])))


def _vocabulary(sample: DataFrame) -> np.ndarray:
    """All words of the sample whose presence in a document tells of its label."""

    def counted(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            at = 0
            for data, offsets in bt.pieces(batch.column("text")):
                n = len(offsets) - 1
                hashes, _, row = _words(data, offsets)
                order = np.lexsort((hashes, row))
                h, r = hashes[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                found, place = np.unique(h[new], return_inverse=True)
                toxic = np.bincount(place, y[at : at + n][r[new]], len(found))
                docs = np.bincount(place, minlength=len(found))
                at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(toxic), pa.array(docs.astype(float))],
                    ["word", "toxic", "docs"],
                )

    counts = (
        sample.select("text", "y")
        .mapInArrow(counted, "word long, toxic double, docs double")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    )
    totals = sample.agg(F.count("*").alias("n"), F.sum("y").alias("positive")).first()
    n, positive = float(totals["n"]), float(totals["positive"] or 0)
    if positive in (0, n):
        return np.zeros(0, np.uint64)
    expected = F.col("docs") * positive / n
    spread = expected * (1 - positive / n) * (n - F.col("docs")) / n
    chi2 = F.when(spread > 0, (F.col("toxic") - expected) ** 2 / spread).otherwise(0.0)
    # At most the different words of the bounded sample.
    telling = counts.where(chi2 >= LEAST_CHI2).select("word").toPandas()
    words = telling["word"].to_numpy(np.int64).view(np.uint64)
    return np.sort(words)


def train(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample`` labelled texts.

    The driver gets the words that have a weight and, for each sampled text, the
    places of those words. With one label only, no word
    has a weight and all documents score about the share of label 1.
    """
    rows = training_rows(docs, labels, "toxic", keep, sample)
    words = _vocabulary(rows)

    def encoded(batches):
        for batch in batches:
            y, ids, digests, at = batch.column("y"), batch.column("doc_id"), batch.column("digest"), 0
            for data, offsets in bt.pieces(batch.column("text")):
                n = len(offsets) - 1
                bags, _, _ = _bags(data, offsets, words)
                row = bags.sentence_row[bags.entry_sentence]
                packed = (bags.sentence_number[bags.entry_sentence] << 32) | bags.entry_word
                lists = np.split(packed, np.cumsum(np.bincount(row, minlength=n))[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n),
                        digests.slice(at, n),
                        pa.array(lists, pa.list_(pa.int64())),
                        pa.array(bags.sentences.astype(np.int64)),
                        y.slice(at, n),
                    ],
                    ["doc_id", "digest", "entries", "sentences", "y"],
                )
                at += n

    got = (
        rows.select(F.col("doc_id").cast("string"), "digest", "text", "y")
        .mapInArrow(encoded, "doc_id string, digest long, entries array<long>, sentences long, y double")
        .toPandas()
        .sort_values(["doc_id", "digest"], kind="stable")
    )
    lengths = np.array([len(e) for e in got["entries"]], np.int64)
    packed = np.concatenate([np.zeros(0, np.int64), *got["entries"]]).astype(np.int64)
    row = np.repeat(np.arange(len(got)), lengths)
    key = np.stack([row, packed >> 32], axis=1).reshape(-1, 2)
    used, entry = np.unique(key, axis=0, return_inverse=True)
    bags = Bags(used[:, 0], used[:, 1], entry.ravel(), packed & 0xFFFFFFFF, got["sentences"].to_numpy(np.int64))
    return fit(bags, got["y"].to_numpy(np.float64), words)


def score_texts(texts: pa.Array, model: Model) -> pa.Array:
    """Score and worst sentence of each text; a text without words has the leak as its score."""
    out = {"score": [], "sentence_score": [], "sentence_index": [], "sentence": []}
    for data, offsets in bt.pieces(texts):
        n = len(offsets) - 1
        bags, first, last = _bags(data, offsets, model.words)
        logits = model.sentence_logits(bags)
        out["score"].extend(-np.expm1(-model.unharmed(bags, logits)))
        worst = np.full(n, -1)
        order = np.lexsort((-bags.sentence_number, logits, bags.sentence_row))
        worst[bags.sentence_row[order]] = order
        for w in worst:
            if w < 0 or logits[w] < model.bias:
                for name in ("sentence_score", "sentence_index", "sentence"):
                    out[name].append(None)
            else:
                out["sentence_score"].append(float(1 / (1 + np.exp(-logits[w]))))
                out["sentence_index"].append(int(bags.sentence_number[w]))
                out["sentence"].append(bytes(data[first[w] : last[w]]).decode("utf-8", "replace").strip())
    return pa.StructArray.from_arrays(
        [pa.array(out[f.name], f.type) for f in _RESULT], names=[f.name for f in _RESULT]
    )


def toxicity(text: Column, model: Model) -> Column:
    """``struct(score, sentence_score, sentence_index, sentence)`` of a text.

    The sentence is the likeliest offender, null where no sentence holds a
    word with a weight; of equal sentences the first. Null and empty texts
    have the leak as their score.
    """

    @F.arrow_udf("score double, sentence_score double, sentence_index long, sentence string")
    def scored(texts: pa.Array) -> pa.Array:
        return score_texts(texts, model)

    return scored(text)


def toxicity_filter(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """The documents with a score below ``THRESHOLD``, columns unchanged.

    Repeated rows stay or go together, null and empty texts have the leak as
    their score; columns may have any names, and an empty table gives an empty one.
    """
    model = train(docs, labels, F.lit(True) if keep is None else keep)
    return docs.where(toxicity(F.col("text"), model)["score"] < THRESHOLD)


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document; labels of crc32(doc_id) mod 4 = 2 are held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = held_out(F.col("doc_id"), 4, 2)
    model = train(docs, labels, ~held)
    return docs.select(
        "doc_id", held.alias("held_out"), toxicity(F.col("text"), model).alias("found")
    ).select(
        "doc_id",
        "held_out",
        "found.score",
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("found.sentence_index").alias("worst_sentence"),
        F.col("found.sentence_score").alias("worst_score"),
    )
