"""The manifest next to a plain recursive Merkle tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import merkle as m

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def mark(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """``(root, proofs)``: of each leaf the (before, after) digests of each level."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, where in enumerate(at):
            run, slot = runs[where // 3], where % 3
            proofs[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] = where // 3
        nodes = [h(*run) for run in runs]
    return nodes[0], proofs


def plain(rows):
    def leaf(r):
        return h(*[mark(v) for v in r])

    def seen(r):
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))

    sources = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(sources[s], trees[s][1]):
            whole = path + top
            folded = seen(r)
            for before, after in whole:
                folded = h(before, folded, after)
            proof = h(*[x for pair in whole for x in pair])
            out.append((str(r[0]), leaf(r), trees[s][0], root, proof, folded, folded == root))
    return sorted(out)


def made(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("grp", "idx", "path", "leaf", "n")})
    found = m.verify(m.manifest(m.document_leaves(docs)), "seen")
    got = found.select("id", "leaf", "subroot", "root", m.proof(F.col("path")), "folded_root", "verified").collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


def table():
    rows = [(i, ["a", "b", "é", "z"][min(i % 7, 3)], "en", i * 3, f"text {i}\nsecond\n" * (i % 4)) for i in range(200)]
    rows += [(500, "one", None, None, None), (None, None, "x", 1, "\n"), (501, None, None, 2, "no line feed")]
    rows += [(502, "two", "de", 1, "\n\n"), (502, "two", "de", 1, "\n\n"), (502, "two", "de", 1, None), (-4, "", "", 0, "")]
    return rows + [(600, "long", "fr", 1, "very long\n" * 100_000)]


@pytest.mark.parametrize("steps", [1, 2, 7])
def test_manifest_next_to_a_plain_tree(spark, monkeypatch, steps):
    monkeypatch.setattr(m, "STEPS", steps)
    rows = table()
    got = made(spark, rows)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_around_full_runs(spark, monkeypatch, n):
    monkeypatch.setattr(m, "STEPS", 2)
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    assert made(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert made(spark, spark.createDataFrame([], COLUMNS).collect() or []) == []


def test_paths_of_leaves_are_not_moved(spark, monkeypatch, capsys):
    monkeypatch.setattr(m, "STEPS", 2)
    kept = []
    cut = m.cut_lineage
    monkeypatch.setattr(m, "cut_lineage", lambda df: kept.append((df.columns, df.count())) or cut(df))
    rows = [(i, "ab"[i % 2], "en", 1, str(i)) for i in range(300)]
    found = m.manifest(m.document_leaves(spark.createDataFrame(rows, COLUMNS)))
    assert all(n < 300 for columns, n in kept if {"path", "up"} & {*columns})
    found.explain("formatted")
    moved = [part for part in capsys.readouterr().out.split("\n\n") if "Exchange" in part.split("\n")[0]]
    # A block comes with its part of the path, ``up``.
    assert moved and not [part for part in moved if "path#" in part]
