"""MinHash fingerprints and classes next to plain Python over all pairs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import minhash as m


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    n = m.SHINGLE
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def exact(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / max(len(a | b), 1)


def near_texts(seed, families=6, members=8, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = r.choices(vocabulary, k=words)
        for _ in range(members):
            text = list(base)
            for _ in range(r.randrange(3)):
                text[r.randrange(words)] = r.choice(vocabulary)
            out.append(" ".join(text))
    return out


def brute_classes(rows, least):
    """Lowest doc_id reachable over pairs at ``least``, by comparing all pairs."""
    texts = sorted({t or "" for _, t in rows})
    lowest = {t: min((i for i, u in rows if (u or "") == t and i is not None), default=None) for t in texts}
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and exact(a, b) >= least:
                root[top(b)] = top(a)
    best = {}
    for t in texts:
        known = [x for x in (best.get(top(t)), lowest[t]) if x is not None]
        best[top(t)] = min(known, default=None)
    return {t: best[top(t)] for t in texts}


ROWS = [(i, t) for i, t in enumerate(near_texts(5))]
ODD = [
    (100, None), (101, ""), (102, "Two words"), (103, "two WORDS"), (None, "nobody knows this one at all"),
    (104, ROWS[0][1]), (104, ROWS[0][1]), (105, " \n\t"), (-3, "é" * 7), (106, "long text of many words " * 9000),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_estimates_come_near_the_jaccard_index(seed):
    texts = near_texts(seed, words=200)
    signed = m.signatures(texts)
    left, right = texts[:-1], texts[1:]
    sets = list(m.shingle_sets(pa.array(texts)))
    told = [m.jaccard(a, b) for a, b in zip(sets, sets[1:])]
    assert told == [exact(a, b) for a, b in zip(left, right)]
    assert abs(m.likeness(signed[:-1], signed[1:]) - told).max() < 0.2
    assert (m.signatures([texts[0].upper()]) == signed[0]).all()


def test_pieces_and_batches_give_the_same_signature():
    texts = ["", None, "one two", "a b c d e f g " * 40_000, "x"]
    alone = [m.signatures([t])[0].tolist() for t in texts]
    assert m.signatures(texts).tolist() == alone
    assert alone[0] == alone[1] == [0xFFFF] * m.PERMUTATIONS


def test_rows_next_to_plain_python(spark):
    rows = ROWS + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr(
        "*", "1 AS t", "'x' AS fingerprint", "2 AS place"
    )
    got = m.near_duplicates(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    texts = [t or "" for _, t in ordered]
    classes = brute_classes(rows, m.JACCARD)
    prints, want = {}, []
    for i, (doc_id, _) in enumerate(ordered):
        following = texts[(i + 1) % len(texts)]
        n = len(texts[i])
        changed = texts[i][: n - n // 4] + following[: n // 4]
        near = [m.likeness(*[m.signatures([x]) for x in (texts[i], y)])[0] for y in (changed, following)]
        want.append((str(doc_id), n, hashlib.sha256(changed.encode()).hexdigest(), *near, classes[texts[i]]))
    told = [
        (str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["class_id"])
        for r in got
    ]
    assert sorted(told, key=str) == sorted(want, key=str)
    for r in got:
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 4 * m.PERMUTATIONS
        prints.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(prints[0]) == 1


def test_one_row_follows_itself_and_none_gives_none(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    (row,) = m.near_duplicates(docs).collect()
    assert row["near_next"] == 1.0 and row["class_id"] == 7
    assert m.near_duplicates(docs.where("false")).count() == 0


def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch):
    """One bucket holds all texts; they fall into many classes, none around the first centre."""
    r = random.Random(11)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = []
    for family in range(30):
        own = [f"f{family}x{i}" for i in range(40)]
        for _ in range(4):
            tail = list(own)
            tail[r.randrange(40)] = f"z{r.random()}"
            texts.append(f"{shared} {' '.join(tail)}")
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # A band of one row: all texts with the same smallest shared shingle meet.
    monkeypatch.setattr(m, "BAND_ROWS", 1)
    monkeypatch.setattr(m, "BANDS", m.PERMUTATIONS)
    monkeypatch.setattr(m, "PAIRS_PLACE", 16)
    monkeypatch.setattr(m, "SLOT", 4)
    want = brute_classes(rows, 0.8)
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(docs).collect()}
    assert got == {i: want[t] for i, t in rows}
    assert len(set(got.values())) > 20


def test_shared_numbers_of_all_pairs_are_counted():
    """Frequent numbers, rare ones, more of them than fit one matrix, and none."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, 40)) for _ in range(150)]
    sets = [np.concatenate([s, np.unique(r.integers(1000, 4000, 50))]).astype(np.uint64) for s in sets]
    sets += [sets[0], np.zeros(0, np.uint64), np.array([1 << 63, 5], np.uint64)]
    for some in (sets, [np.arange(5000, dtype=np.uint64)] * 2, sets[-2:], sets[-2:-1]):
        got = m.shared_counts(some)
        for i, a in enumerate(some):
            for j, b in enumerate(some):
                assert got[i, j] == (len(np.intersect1d(a, b)) if i < j else 0)


def test_links_join_classes_that_share_a_key_on_two_sides():
    sets = [np.arange(10, dtype=np.uint64)] * 5
    keys = [np.array(k, np.uint64) for k in ([1], [1, 2], [2], [3], [1])]
    classes, one = np.array([0, 10, 20, 30, 0]), np.zeros(5, int)
    assert m.joining(sets, keys, classes, one, 0.8) == [(0, 10), (0, 20)]
    assert m.joining(sets, keys, classes, np.array([0, 0, 1, 1, 0]), 0.8) == [(10, 20)]
    assert m.joining(sets, keys, np.zeros(5, int), one, 0.8) == []


@pytest.mark.parametrize("slot", [512, 10])
def test_near_copies_below_the_index_are_not_expanded_into_pairs(spark, monkeypatch, slot):
    """Nearly all pairs of copies share a band, and few reach Jaccard 0.8."""
    r = random.Random(23)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(120):
        text = list(base)
        for _ in range(3 if i % 3 else 1):
            text[r.randrange(80)] = f"z{i}x{r.random()}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(m, "SLOT", slot)
    monkeypatch.setattr(m, "PAIRS_PLACE", 16)
    asked, verified = [], m.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(m, "verified", counted)
    want = brute_classes(rows, m.JACCARD)
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(docs).collect()}
    assert got == {i: want[t] for i, t in rows}
    assert 40 < len(set(got.values())) < 118
    # A text is compared with the lowest of at most all its buckets; there are 7 140 pairs.
    assert sum(asked) < 1_000
