import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import snowball as sb

DDL = """doi string, title string, authors array<string>, abstract string, source string, url string,
year int, has_pdf boolean, pdf_url string, citations array<string>, references array<string>"""


def papers(spark, references=None, citations=None):
    references, citations = references or {}, citations or {}
    ids = sorted(set(references) | set(citations) | {x for v in [*references.values(), *citations.values()] for x in v})
    rows = [(i, f"t {i}", ["Ada", "Bob"], None, "j", "u", 2020, True, None, citations.get(i, []), references.get(i, [])) for i in ids]
    return spark.createDataFrame(rows, DDL)


def run(spark, table, seeds, excluded=(), direction="backward", depth=2, **kw):
    ids = lambda xs: sb.read_ids(spark.createDataFrame([(x,) for x in xs], "doi string"))
    edges = sb.citation_edges(table, direction)
    result = sb.snowball(table, edges, ids(seeds), ids(excluded), depth)
    return sb.snowball_table(table, result, **kw)


def links(df):
    return {r["doi"]: r["referencing_paper_ids"] for r in df.collect()}


def test_references_of_two_levels(spark):
    # A ladder: every rung refers to the next two.
    rungs = [f"10.55/rung{i}" for i in range(6)]
    table = papers(spark, {r: rungs[i + 1 : i + 3] for i, r in enumerate(rungs)})
    df = run(spark, table, rungs[:1])
    assert links(df) == {
        rungs[1]: rungs[0], rungs[2]: f"{rungs[0]};{rungs[1]}", rungs[3]: f"{rungs[1]};{rungs[2]}", rungs[4]: rungs[2],
    }
    rows = sorted(df.collect(), key=lambda r: r["cluster_id"])
    assert [r["doi"] for r in rows] == rungs[1:5]
    assert rows[0]["authors"] == "Ada;Bob" and rows[0]["url"] == f"https://doi.org/{rungs[1]}"
    assert all(r["include"] is None for r in rows)


def test_citations_stop_at_the_depth(spark):
    chain = [f"10.7/{c}" for c in "pqrst"]
    table = papers(spark, citations={a: [b] for a, b in itertools.pairwise(chain)})
    got = links(run(spark, table, chain[:1], direction="forward", depth=3))
    assert got == dict(zip(chain[1:4], chain[:3]))


def test_spellings_of_ids_are_one(spark):
    table = papers(spark, {"10.9/seed": ["10.9/SEED", "https://doi.org/10.9/Kept", "DOI:10.9/gone"], "10.9/gone": ["10.9/far"], "10.9/kept": []})
    df = run(spark, table, ["doi:10.9/Seed  "], ["https://doi.org/10.9/GONE"], depth=2)
    assert links(df) == {"10.9/kept": "10.9/seed"}


def test_no_links_keeps_the_columns(spark):
    df = run(spark, papers(spark, {"10/a": []}), ["10/a"])
    assert df.count() == 0
    assert df.columns == ["cluster_id", *sb.DETAIL_COLUMNS, "referencing_paper_ids", "include"]


def test_name_clash_and_missing_column(spark):
    table = papers(spark, {"10/a": []})
    with pytest.raises(ValueError, match="conflicts"):
        run(spark, table, ["10/a"], linked_ids_column="title")
    with pytest.raises(ValueError, match="was not found"):
        sb.read_ids(table, "DOI number")


def test_missing_inputs(spark):
    table = papers(spark, {"10/a": []})
    seeds = sb.read_ids(spark.createDataFrame([("10/A",), ("10/q",), ("",)], "doi string"))
    assert [r["doi"] for r in sb.missing_inputs(table, seeds).collect()] == ["10/q"]


def test_random_graph_equals_naive_walk(spark):
    rng = random.Random(4)
    names = [f"10/{i}" for i in range(40)]
    refs = {n: rng.sample(names, rng.randrange(4)) for n in names}
    seeds, banned, depth = {"10/0", "10/1"}, {"10/5", "10/6"}, 3
    visited, frontier, found, want = seeds | banned, set(seeds), set(), {}
    for _ in range(depth):
        rel = {(s, d) for s in frontier for d in refs[s]}
        for s, d in rel:
            if d not in banned and s not in banned:
                want.setdefault(d, set()).add(s)
        frontier = {d for _, d in rel} - visited
        visited |= frontier
        found |= frontier
    df = run(spark, papers(spark, refs), seeds, banned, depth=depth)
    assert links(df) == {d: ";".join(sorted(want.get(d, ()))) for d in found}


def test_a_paper_has_one_row_however_many_link_to_it(spark):
    count = 10_001
    edges = spark.range(count).select(F.concat(F.lit("10/s"), "id").alias("src"), F.lit("10/hub").alias("dst"))
    ids = edges.select(F.col("src").alias("doi")).union(spark.createDataFrame([("10/hub",)], "doi string"))
    result = sb.snowball(ids, edges, edges.select(F.col("src").alias("doi")))
    items = sb.linked_ids(result)
    assert items.agg(F.count("*"), F.min("ord"), F.max("ord"), F.count_distinct("item")).first()[:] == (count, 0, count - 1, count)
    plain = ids.selectExpr("doi", "'t' AS title", "'a' AS authors", "'s' AS source", "2000 AS year")
    assert [r["linking_papers"] for r in sb.snowball_records(plain, result).collect()] == [count]


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_few_ids_are_looked_up_without_a_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(sb, "FEW_IDS", few)
    shuffled = []
    plain = sb.members
    monkeypatch.setattr(sb, "members", lambda df, *rest, **more: shuffled.append(df) or plain(df, *rest, **more))
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "c"), ("c", "a"), ("x", "c"), ("d", "b")], "src string, dst string")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "doi string")
    result = sb.snowball(ids(*"abcdx"), edges, ids("a"), ids("x"), depth=3)
    assert bool(shuffled) == (few == 0)
    assert sorted(map(tuple, result.found.collect())) == [("b", 1), ("c", 2)]
    assert sorted(map(tuple, result.links.collect())) == [("a", "b"), ("b", "c"), ("c", "a")]
