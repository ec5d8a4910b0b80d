"""Quality and toxicity: held-out accuracy, and what odd rows give."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import bytetext as bt
from reviewlake.llm import quality as q
from reviewlake.llm import toxicity as t
from reviewlake.llm.labels import held_out, training_rows

DOCS, LABELS = "doc_id long, text string, score string, y string", "doc_id long, quality int, toxic int"
WORDS = [a + b for a in "ka lo mi ne ru".split() for b in "ba de fi go tu sa".split()]


def table_rows(n=600, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(4, 9))) + ".\n"
        lines = [line() for _ in range(r.randint(3, 12))]
        toxic, bad = r.random() < 0.2, r.random() < 0.25
        if toxic:
            at = r.randrange(len(lines))
            lines[at] = f"you {r.choice(['zorb', 'glarx'])} " + lines[at]
        text = "".join(lines)
        if bad:
            text = text.replace(" ", "### ").upper()
        docs.append((i, text, None, "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "no id", None, None), (10_000, None, None, None), (10_001, "", None, None), (3, docs[3][1], None, None)]
    docs += [(10_002, "long words here. " * 40_000, None, None)]
    return docs, [*labels, (5, None, None), (None, 1, 1), (4, labels[4][1], labels[4][2])]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = table_rows()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), labels


def test_quality_on_held_out_rows(tables):
    docs, labels, known = tables
    held = held_out(F.col("doc_id"), 3, 1)
    forest = q.train(docs, labels, ~held)
    rows = docs.select("doc_id", held.alias("h"), q.quality_score(F.col("text"), forest).alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    truth = {k: v for k, v, _ in known if v is not None}
    tested = [(r["s"] >= 0.5) == truth[r["doc_id"]] for r in rows if r["h"] and r["doc_id"] in truth]
    assert len(tested) > 100 and np.mean(tested) > 0.97
    kept = q.quality_filter(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_toxicity_on_held_out_rows_and_the_sentence(tables):
    docs, labels, known = tables
    held = held_out(F.col("doc_id"), 4, 2)
    model = t.train(docs, labels, ~held)
    rows = docs.select("doc_id", "text", held.alias("h"), t.toxicity(F.col("text"), model).alias("f")).collect()
    truth = {k: v for k, _, v in known if v is not None}
    tested = [((r["f"]["score"] >= 0.3) == truth[r["doc_id"]]) for r in rows if r["h"] and r["doc_id"] in truth]
    assert len(tested) > 80 and np.mean(tested) > 0.97
    for r in rows:
        if truth.get(r["doc_id"]) and r["f"]["score"] >= 0.3:
            assert "zorb" in r["f"]["sentence"].lower() or "glarx" in r["f"]["sentence"].lower()
            lines = [x for x in r["text"].replace(".", "\n").split("\n") if x.strip("# ")]
            assert r["f"]["sentence"].strip("# ") in lines[r["f"]["sentence_index"]]
    clean = [r["f"]["score"] for r in rows if r["doc_id"] in (10_000, 10_001, 10_002, None)]
    assert len(clean) == 4 and all(0 <= s < 0.3 for s in clean)
    kept = t.toxicity_filter(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_without_labels_or_rows(spark, tables):
    docs, labels, _ = tables
    none = labels.where("false")
    assert q.quality_filter(docs.limit(3), none).count() == 3
    assert q.quality_filter(docs.where("false"), labels).count() == 0
    assert t.toxicity_filter(docs.where("false"), labels).count() == 0
    model = t.train(docs, none, F.lit(True))
    scores = docs.limit(3).select(t.toxicity(F.col("text"), model)["score"].alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scores)


def test_sample_is_bounded(tables):
    docs, labels, _ = tables
    assert training_rows(docs, labels, "quality", F.lit(True), sample=50).select("doc_id").distinct().count() == 50


def test_forest_traversal_equals_walking_each_tree():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = q.fit_forest(x, y, trees=20, depth=3, least_rows=5)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row, got in zip(x[:30], forest.score(x[:30])):
        margin = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12
    assert len(q.fit_forest(x, np.ones(300)).leaf) == 0


def test_words_of_many_texts_equal_those_of_each():
    texts = ["a bb  ccc", None, "", "é ü-x", "x", "tail", " lead"]
    for limit in (1, 8, 1000):
        seen, at = [], 0
        for data, offsets in bt.pieces(pa.array(texts), limit):
            start, end, row = bt.spans(data, offsets, bt.WHITE)
            hashes = bt.span_hashes(data, start, end)
            seen += [(int(r) + at, bytes(data[s:e]).decode(), int(h)) for s, e, r, h in zip(start, end, row, hashes)]
            at += len(offsets) - 1
        assert seen == [(i, w, bt.text_hash(w)) for i, x in enumerate(texts) for w in (x or "").split()]


def test_noisy_or_and_its_slopes_next_to_plain_loops():
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(6)]
    hashes = np.array([bt.text_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)
    words, weight = hashes[order], r.normal(1, 1, 6)
    by_word = {vocabulary[i]: weight[k] for k, i in enumerate(order)}
    texts = [
        ". ".join(" ".join(r.choice([*vocabulary, "plain", "else"], r.integers(1, 5))) for _ in range(r.integers(1, 5)))
        for _ in range(40)
    ] + ["", None, "plain only."]
    y = r.integers(0, 2, len(texts)).astype(float)

    def scores(weights, bias, log_leak):
        out = []
        for text in texts:
            clean = np.exp(-np.exp(log_leak))
            for sentence in (text or "").split("."):
                known = set(sentence.split()) & set(vocabulary)
                if known:
                    clean *= 1 - 1 / (1 + np.exp(-bias - sum(weights[w] for w in known)))
            out.append(1 - clean)
        return np.array(out)

    model = t.Model(words, weight, -1.5, float(np.exp(-2.0)))
    got = t.score_texts(pa.array(texts), model).field("score").to_numpy(zero_copy_only=False)
    assert np.allclose(got, scores(by_word, -1.5, -2.0))

    def likelihood(theta):
        p = scores({vocabulary[i]: theta[k] for k, i in enumerate(order)}, theta[-2], theta[-1])
        return np.mean(np.where(y > 0, np.log(p), np.log1p(-p)))

    ((data, offsets),) = bt.pieces(pa.array(texts))
    bags, _, _ = t._bags(data, offsets, words)
    theta, want = np.concatenate([weight, [-1.5, -2.0]]), []
    for i in range(len(theta)):
        step = np.eye(len(theta))[i] * 1e-6
        want.append((likelihood(theta + step) - likelihood(theta - step)) / 2e-6)
    assert np.allclose(t.slopes(model, bags, y), want, atol=1e-6)


def test_an_id_with_very_many_rows_stays_within_the_sample(spark):
    docs = spark.range(100_000).select(
        F.when(F.col("id") < 99_000, 7).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id") % 50_000).alias("text"),
    )
    labels = docs.select("doc_id", F.lit(1).alias("quality")).distinct()
    rows = training_rows(docs, labels, "quality", F.lit(True), sample=300).collect()
    assert len(rows) == 300 and len({(r["doc_id"], r["text"]) for r in rows}) == 300
