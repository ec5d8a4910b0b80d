"""Hierarchical budgets next to a plain recursive version, and the prefix of each leaf."""

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import mixture as m


def share_out(budget, children):
    """{name: tokens} for [(name, capacity, weight)], by filling one full child at a time."""
    open_, given, left = list(children), {}, budget
    while True:
        weights = sum(w for _, _, w in open_)
        full = [(n, c, w) for n, c, w in open_ if w > 0 and c * weights <= left * w]
        if not full:
            break
        # The one with the least capacity per weight first.
        n, c, w = min(full, key=lambda x: (x[1] / x[2], x[0]))
        given[n] = c
        left -= c
        open_ = [x for x in open_ if x[0] != n]
    weights = sum(w for _, _, w in open_)
    rest = left
    for n, c, w in sorted(open_):
        given[n] = left * w // weights if weights else 0
        rest -= given[n]
    for n, c, w in sorted(open_):
        if w > 0 and rest > 0:
            given[n] += 1
            rest -= 1
    for n, c, w in sorted(open_):
        if w == 0:
            given[n] = min(rest, c)
            rest -= given[n]
    return given


@pytest.mark.parametrize("budget", [7, 1234, 4110])
def test_shares_next_to_filling_one_by_one(spark, budget):
    children = [("a", 100, 1), ("b", 1000, 2), ("c", 10, 3), ("d", 0, 2), ("e", 3000, 0), ("f", 0, 0)]
    nodes = spark.createDataFrame(
        [("p", n, c, w, budget) for n, c, w in children], "parent string, name string, capacity long, weight long, budget long"
    )
    got = {r["name"]: r["budget"] for r in m.share_out(nodes, ["parent"], "name").collect()}
    assert got == share_out(budget, children)
    assert sum(got.values()) == budget


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("d1", "en", "s1", 10), ("d1", "en", "s2", 1000), ("d1", "de", "s3", 1000), ("d2", "en", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, language string, source string, tokens long")
    even = lambda level: F.lit(1).cast("long")
    got = {r["source"]: r["budget"] for r in m.leaf_budgets(leaves, F.lit(800), 1, even).collect()}
    # s1 gives 10 of its 100; s2 takes the other 90, s3 and s4 nothing of them.
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}
    got = {r["source"]: r["budget"] for r in m.leaf_budgets(leaves, F.lit(10**9), 1, even).collect()}
    assert got == {"s1": 10, "s2": 1000, "s3": 1000, "s4": 1000}


ROWS = [(i, f"w{i} " * (1 + i % 7), "en" if i % 3 else None, f"src{i % 4}", i) for i in range(400)] + [
    (None, None, None, None, 1), (5, "", "en", "src1", 2), (7, "twice here", "de", "x", 0), (7, "twice here", "de", "x", 0),
    (9, "long " * 50_000, "fr", "src2", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, mix_epochs long"


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_each_leaf_has_whole_epochs_and_a_prefix(spark, monkeypatch, broadcast):
    monkeypatch.setattr(m, "BROADCAST_LEAVES", broadcast)
    monkeypatch.setattr(m, "SALTS", 3)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = m.mix(docs, share=0.9)
    assert out.columns == ["doc_id", "text", "lang", "source", "mix_domain", "mix_epochs", "mix_tokens"]
    leaf = [c.alias(k) for k, c in m.leaf_columns().items()]
    measured = docs.select(*leaf, m.tokens(F.col("text")).alias("tokens"), m._order(m.SEED).alias("order"))
    leaves = measured.groupBy(*m.LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0]
    plans = m.leaf_budgets(leaves, F.lit(total * 9 // 10)).collect()
    assert sum(p["budget"] for p in plans) == total * 9 // 10
    used = out.withColumn("order", m._order(m.SEED)).select(*leaf, "order", "mix_epochs").collect()
    rows = measured.collect()
    for p in plans:
        key = tuple(p[k] for k in m.LEVELS)
        got = sorted((r["order"], r["mix_epochs"]) for r in used if tuple(r[k] for k in m.LEVELS) == key)
        own = sorted((r["order"], r["tokens"]) for r in rows if tuple(r[k] for k in m.LEVELS) == key)
        if p["tokens"] == 0:
            assert got == []
            continue
        whole, rest = divmod(p["budget"], p["tokens"])
        want = []
        for order, _ in own:
            fits = sum(t for o, t in own if o <= order) <= rest
            if whole + fits:
                want.append((order, whole + fits))
        assert got == want


def test_empty_table(spark):
    assert m.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_of_working_columns_may_be_there(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).drop("mix_epochs")
    names = ["_whole", "_rest", "_cut_slice", "_before", "_last", "_order", "_slice", "domain", "tokens", "__mix_domain"]
    more = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got, want = m.mix(more), m.mix(docs)
    assert got.columns == more.columns + ["mix_domain", "mix_epochs", "mix_tokens"]
    assert got.where(" or ".join(f"{n} != {i}" for i, n in enumerate(names))).count() == 0
    assert sorted(map(str, got.drop(*names).collect())) == sorted(map(str, want.collect()))
