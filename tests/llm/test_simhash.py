"""SimHash groups next to brute force over all pairs of fingerprints."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import simhash as s


def brute(fingerprints):
    """Lowest member of each fingerprint's component, by comparing all pairs."""
    values = sorted(set(fingerprints))
    lowest = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= s.BITS_APART and lowest[b] < lowest[a]:
                    lowest[a], changed = lowest[b], True
    return lowest


def near_copies(n, seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(n // 12):
        centre = r.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(r.randrange(4)):
                value ^= 1 << r.randrange(64)
            out.append(value)
    return out


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("choice", [2, 3, 4])
@pytest.mark.parametrize("block", [2, 64])
def test_links_keep_all_components(spark, choice, block):
    values = near_copies(120)
    frame = spark.createDataFrame([(signed(v),) for v in set(values)], "f long")
    found = s.links(frame, block=block, choices=(choice,)).collect()
    lowest = {v: v for v in set(values)}
    changed = True
    while changed:
        changed = False
        for r in found:
            a, b = r["src"] % (1 << 64), r["dst"] % (1 << 64)
            assert (a ^ b).bit_count() <= 3 * 3 * 12
            low = min(lowest[a], lowest[b])
            if lowest[a] != low or lowest[b] != low:
                lowest[a] = lowest[b] = low
                changed = True
    assert lowest == brute(values)


def test_thresholds_follow_the_principle():
    for m in (2, 3, 4):
        cost, thresholds = s.allot([64 // m] * m, [10.0] * m, 1e6)
        assert sum(thresholds) == s.BITS_APART - m + 1 and min(thresholds) >= -1
    # A partition with one very frequent key is left out.
    _, thresholds = s.allot([16] * 4, [1e12, 1e3, 1e3, 1e3], 1e4)
    assert thresholds[0] == -1


def test_bits_are_dealt_out_once():
    import numpy as np

    groups = s.group_bits(np.eye(64), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert [len(g) for g in groups] == [22, 21, 21]


def test_fingerprint_by_hand():
    import xxhash

    assert s.fingerprint_of(None) == s.fingerprint_of("") == s.fingerprint_of(" \n\t") == 0
    assert s.fingerprint_of("One TWO") == xxhash.xxh64_intdigest("one two", 42)
    text = "a b c d e é F"
    words = "a b c d e é f".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert s.fingerprint_of(text) == want


ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "x"),
    (2, "The quick brown fox jumps over the LAZY dog", None),
    (2, "The quick brown fox jumps over the LAZY dog", None),
    (3, None, "y"),
    (4, "", "y"),
    (None, "nobody knows the number of this text at all", "z"),
    (None, "nobody knows the number of this text at all", "z"),
    (5, "a wholly different line of words about stones " * 4000, "x"),
]


def test_groups_with_nulls_ties_and_long_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in s.near_duplicates(docs).collect())
    assert got == [(0, None), (0, None), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, f string")
    kept = s.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5]
    empty = docs.where("false")
    assert s.deduplicate(empty).count() == 0 and s.near_duplicates(empty).count() == 0


def test_names_of_working_columns_may_be_there(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, ""), (None, "x y z u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["_kept", "_of", "_digest", "digest", "f", "component_id", "row", "i", "r"]
    more = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = s.deduplicate(more)
    assert got.columns == more.columns and got.where(" or ".join(f"{n} != {i}" for i, n in enumerate(names))).count() == 0
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, s.deduplicate(docs).collect()))
