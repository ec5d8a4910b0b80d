import random

import pytest
from pyspark.sql import functions as F

from reviewlake import scale


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(scale, "SLICE_BITS", 2)


def test_id_index_is_the_rank_for_sparse_and_negative_ids(spark):
    rng = random.Random(1)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)} | set(range(-5, 200)))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["row_index"] for r in scale.id_index(df, "id").collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_hash_and_range_index(spark):
    df = spark.range(500).withColumn("name", F.concat(F.lit("n"), "id"))
    digest = F.md5(F.col("id").cast("string"))
    rows = scale.hash_index(df, digest, "id").withColumn("d", digest).collect()
    assert [r["row_index"] for r in sorted(rows, key=lambda r: r["d"])] == list(range(500))
    rows = scale.range_index(df, ["name"]).collect()
    assert [r["row_index"] for r in sorted(rows, key=lambda r: r["name"])] == list(range(500))


def test_ordered_items_number_every_key(spark):
    rows = [("hot", f"s{i:03}") for i in range(200)] + [("b", "y"), ("b", "x"), ("c", "z")]
    df = spark.createDataFrame(rows, "k string, item string").repartition(5)
    items = scale.ordered_items(df, ["k"], ["item"])
    got = {(r["k"], r["item"]): r["ord"] for r in items.collect()}
    own = {k: sorted(v for key, v in rows if key == k) for k in ("hot", "b", "c")}
    assert got == {(k, v): i for k, values in own.items() for i, v in enumerate(values)}
    joined = {r["k"]: r["text"] for r in scale.joined_items(items, ["k"], ",", "text").collect()}
    assert joined == {k: ",".join(values) for k, values in own.items()}
    assert scale.ordered_items(df.limit(0), ["k"], ["item"]).count() == 0


def test_neighbours_across_slices(spark, small_slices):
    rows = [(k, i, f"{k}{i}") for k in "ab" for i in range(0, 40, 2 if k == "a" else 1)]
    df = spark.createDataFrame(rows, "k string, at long, v string")
    got = {(r["k"], r["at"]): (r["b"], r["l"]) for r in scale.neighbours(df, ["k"], "at", "v", "b", "l").collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for i, (_, at, _) in enumerate(own):
            assert got[(k, at)] == (own[i - 1][2] if i else None, i == len(own) - 1)


def test_runs_go_on_across_slices(spark, small_slices):
    rng = random.Random(2)
    rows = [(k, i * (2 if k == "a" else 1), rng.choice("xxxy")) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, at long, v string")
    got = {(r["k"], r["at"]): r["start"] for r in scale.runs(df, ["k"], "at", "v", "start").collect()}
    last = {}
    for k, at, v in sorted(rows):
        start = last[k][1] if k in last and last[k][0] == v else at
        last[k] = (v, start)
        assert got[(k, at)] == start


def test_next_marked_across_slices(spark, small_slices):
    marks = [i for i in range(50) if i in (3, 4, 19, 40)]
    df = spark.range(50).withColumn("k", F.lit(1)).withColumn("m", F.col("id").isin(*marks))
    rows = scale.next_marked(df, ["k"], "id", F.col("m"), "n").collect()
    for r in rows:
        assert r["n"] == next((m for m in marks if m > r["id"]), None)


def test_config_rows_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        scale.config_rows(spark.range(11), "rows", limit=10)
    assert len(scale.config_rows(spark.range(10), "rows", limit=10)) == 10


@pytest.mark.parametrize("heavy", [0, 1, 3, 1000])
def test_lookup_and_members_equal_plain_joins(spark, monkeypatch, heavy):
    monkeypatch.setattr(scale, "HEAVY_KEYS", heavy)
    rng = random.Random(6)
    rows = [(rng.choice([*"aaaaaabbcdef", None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long")
    counts = df.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    table = counts.where("k NOT IN ('b', 'c')")
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    for how in ("left", "inner"):
        got = scale.lookup(df, table, ["k"], "n", "i", how)
        assert key(got) == key(df.join(table.drop("n"), "k", how).select("k", "i", "first"))
    ids, hot = table.select("k"), scale.heavy_keys(df, "k")
    assert key(scale.members(df, ids, "k", hot, "i")) == key(df.join(ids, "k", "left_semi"))
    assert key(scale.members(df, ids, "k", hot, "i", inside=False)) == key(df.join(ids, "k", "left_anti"))
