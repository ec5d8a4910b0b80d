import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import resolve as rs

DDL = """record_id long, title string, authors string, source string, keywords string,
abstract string, doi string, url string, year int, filename string"""
FIELDS = (rs.Field("title", "words", 0.8), rs.Field("source", "equal", 0.2))


def row(i, title="T", authors="A", source="S", keywords="k", abstract="Ab", doi="10.1", url="u", year=2020, filename="f"):
    return (i, title, authors, source, keywords, abstract, doi, url, year, filename)


TWO = [
    row(0, "Title 1", "A1", "S1", "K1;K2", "Ab1", "10.1", "url1", 2020, "A"),
    row(1, "Title 2", "A2", "S2", "K2;K3", "Ab2", "10.2", "url2", 2021, "B"),
]


def clustered(spark, rows, clusters, confidence):
    df = spark.createDataFrame(rows, DDL)
    ids = F.create_map(*[F.lit(x) for p in clusters.items() for x in p])
    sure = F.create_map(*[F.lit(x) for p in confidence.items() for x in p])
    return df.withColumn("cluster_id", ids[F.col("record_id")].cast("long")).withColumn("confidence", sure[F.col("record_id")])


def test_golden_record_of_one_cluster(spark):
    gold = rs.golden_table(clustered(spark, TWO, {0: 0, 1: 0}, {0: 0.8, 1: 1.0})).collect()
    assert len(gold) == 1
    g = gold[0]
    assert g["source_database_indices"] == "(A,0); (B,1)"
    assert (g["title"], g["authors"], g["source"], g["year"]) == ("Title 2", "A2", "S2", 2021)
    assert g["keywords"] == "k1; k2; k3" and g["abstract"] == "Ab2" and g["include"] is None


def test_golden_record_of_two_clusters_and_ties(spark):
    assert rs.golden_records(clustered(spark, TWO, {0: 0, 1: 1}, {0: 1.0, 1: 1.0})).count() == 2
    g = rs.golden_records(clustered(spark, TWO, {0: 0, 1: 0}, {0: 1.0, 1: 1.0})).first()
    assert g["title"] == "Title 1" and g["doi"] == "10.1"


def test_golden_record_fallbacks(spark):
    rows = [
        row(0, abstract=" ", doi="N/A", url="https://doi.org/10.1"),
        row(1, abstract="two", doi="10.12345", url="N/A", keywords=None),
        row(2, abstract="one", doi=None, url="https://google.com", keywords="K; Z"),
        row(3, abstract="two", url=None),
    ]
    df = clustered(spark, rows, dict.fromkeys(range(4), 0), {0: 1.0, 1: 0.5, 2: 0.5, 3: 0.5})
    g = rs.golden_table(df).first()
    assert g["abstract"] == "two\none" and g["doi"] == "10.12345"
    assert g["url"] == "https://google.com" and g["keywords"] == "k; z"


def test_a_cluster_is_one_record_however_large(spark):
    count = 10_001
    df = spark.range(count).selectExpr(
        "id AS record_id", "'T' AS title", "'A' AS authors", "'S' AS source", "concat('k', id % 7, ';K0') AS keywords",
        "CAST(NULL AS STRING) AS abstract", "'d' AS doi", "'u' AS url", "2020 AS year", "'f' AS filename",
        "0L AS cluster_id", "1.0D AS confidence",
    )
    assert [(g["members"], g["title"]) for g in rs.golden_records(df).collect()] == [(count, "T")]
    items = rs.golden_lists(df).orderBy("kind", "ord").collect()
    assert [r["item"] for r in items if r["kind"] == "keywords"] == [f"k{i}" for i in range(7)]
    own = [r for r in items if r["kind"] == "provenance"]
    assert [(r["ord"], r["item"]) for r in own] == [(i, f"(f,{i})") for i in range(count)]


def test_items_of_lists_are_cut_by_the_callers_function(spark):
    df = clustered(spark, TWO, {0: 0, 1: 0}, {0: 1.0, 1: 0.5})
    items = rs.golden_lists(df, keyword_items=lambda v: F.array(F.upper(v)))
    assert {r["item"] for r in items.collect() if r["kind"] == "keywords"} == {"K1;K2", "K2;K3"}


@pytest.mark.parametrize("url, want", [("https://doi.org/10.1", 1), ("https://google.com", 2), ("N/A", 0), (None, 0), ("", 0)])
def test_url_relevance(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(rs.url_relevance("u").alias("r")).first()["r"] == want


def brute_components(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("shape", ["path", "random", "star", "none"])
def test_connected_components(spark, shape):
    rng = random.Random(5)
    order = rng.sample(range(60), 60)
    edges = {
        "path": list(zip(order, order[1:])),
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)],
        "star": [(7, i) for i in range(30)] + [(40, i) for i in range(31, 50)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in rs.connected_components(df).collect()}
    want = brute_components(60, edges)
    assert {i: got.get(i, i) for i in range(60)} == want


def near_copies(seed, families, copies):
    """Families of titles that differ in few words, with exact copies among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    titles = []
    for _ in range(families):
        base = rng.sample(words, 8)
        for _ in range(copies):
            title = list(base)
            for _ in range(rng.randrange(3)):
                title[rng.randrange(8)] = rng.choice(words)
            titles.append(" ".join(title))
    return titles


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("place", [4096, 3])
def test_resolution_equals_brute_force(spark, monkeypatch, place):
    monkeypatch.setattr(rs, "PAIRS_PLACE", place)
    titles = near_copies(11, 6, 9)
    rows = [row(i, t, source=f"s{i % 2}") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, DDL)
    matches = [
        (i, j)
        for i, j in itertools.combinations(range(len(titles)), 2)
        if jaccard(titles[i], titles[j]) >= 0.5
        and 0.8 * jaccard(titles[i], titles[j]) + 0.2 * (i % 2 == j % 2) >= 0.55
    ]
    want = brute_components(len(titles), matches)
    rows = rs.resolve(df, FIELDS, "title", 0.5, 0.55).collect()
    assert len(rows) == len(titles)
    roots = {root: n for n, root in enumerate(sorted(set(want.values())))}
    assert {r["record_id"]: r["cluster_id"] for r in rows} == {i: roots[c] for i, c in want.items()}
    assert all(0 < r["confidence"] <= 1 for r in rows)
    alone = [r["cluster_id"] for r in rows]
    assert all(r["confidence"] == 1.0 for r in rows if alone.count(r["cluster_id"]) == 1)


THREE = (rs.Field("title", "words", 0.8), rs.Field("source", "equal", 0.1), rs.Field("authors", "equal", 0.1))


def brute_score(a, b, fields):
    """Weighted mean over what both have, from plain rows."""
    total = weight = 0.0
    for f in fields:
        x, y = a[f.name], b[f.name]
        if not x or not y:
            continue
        if f.comparator == "words":
            s = jaccard(x, y)
        elif f.comparator == "equal":
            s = float(x == y)
        else:
            row = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                before, row[0] = row[0], i
                for j, d in enumerate(y, 1):
                    before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
            s = 1 - row[-1] / max(len(x), len(y))
        total, weight = total + f.weight * s, weight + f.weight
    return total / weight if weight else 0.0


MIXED = (rs.Field("title", "text", 0.5), rs.Field("authors", "words", 0.3), rs.Field("source", "equal", 0.2))


@pytest.mark.parametrize("least_driver", [0.5, 0.9])
@pytest.mark.parametrize("fields", [THREE, (rs.Field("title", "text", 0.4), rs.Field("authors", "text", 0.6)), MIXED])
def test_without_a_gate_the_score_alone_decides(spark, monkeypatch, fields, least_driver):
    monkeypatch.setattr(rs, "LEAST_DRIVER", least_driver)
    monkeypatch.setattr(rs, "PAIRS_PLACE", 2)
    rng = random.Random(4)
    names = ["title", "source", "authors"]
    # 9 of 16 words are Jaccard 0.5625, which is just enough with all else equal.
    rows = [(" ".join(f"w{i}" for i in range(9)), "s", "a"), (" ".join(f"w{i}" for i in range(16)), "s", "a")]
    rows += [(t, rng.choice("sr"), rng.choice(["a", "b", None])) for t in near_copies(7, 4, 6)]
    rows += [(None, "s", "a"), ("?!" if fields is THREE else None, "r", "b"), (None, None, "a"), (None, None, None)]
    rows = [dict(zip(names, r), record_id=i) for i, r in enumerate(rows)]
    plain = [r | {"title": None} if r["title"] == "?!" else r for r in rows]
    want = {}
    for a, b in itertools.combinations(plain, 2):
        score = brute_score(a, b, fields)
        if score >= 0.65 - 1e-12:
            want[a["record_id"], b["record_id"]] = score
    df = spark.createDataFrame(rows, "record_id long, title string, source string, authors string")
    table = rs.comparable(df, fields, "title")
    found = rs.similar_pairs(table, fields, "title", None, 0.65).collect()
    got = {(r["left_id"], r["right_id"]): r["score"] for r in found}
    assert len(got) == len(found) and got == pytest.approx(want)
    if fields is THREE:
        assert (0, 1) in got and any(jaccard(rows[i]["title"] or "", rows[j]["title"] or "") == 0 for i, j in got)
    joined = rs.connected_components(rs.match_links(table, fields, "title", None, 0.65))
    components = {r["id"]: r["component"] for r in joined.collect()}
    assert {i: components.get(i, i) for i in range(len(rows))} == brute_components(len(rows), list(want))


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.7, 0.8])
def test_misspelt_texts_are_found_at_every_threshold(spark, threshold):
    """Short and long texts with edits, next to brute force; one q of the grams each."""
    rng = random.Random(int(100 * threshold))
    words = ["a", "be", "graph", "deep networks", "rain in may and june", "x" * 12]
    texts = words + ["".join(rng.choice("abx ") if rng.random() < 0.2 else c for c in w) for w in words * 5]
    fields = (rs.Field("title", "text", 0.7), rs.Field("source", "equal", 0.3))
    rows = [{"record_id": i, "title": t, "source": rng.choice(["s", "r", None])} for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id long, title string, source string")
    table = rs.comparable(df, fields, "title")
    clean = [r | {"title": r["title"].strip() or None} for r in rows]
    want = {}
    for a, b in itertools.combinations(clean, 2):
        score = brute_score(a, b, fields)
        # The same sums in the same order, so scores at the threshold agree too.
        if score >= threshold:
            want[a["record_id"], b["record_id"]] = score
    found = rs.similar_pairs(table, fields, "title", None, threshold).collect()
    assert {(r["left_id"], r["right_id"]): r["score"] for r in found} == pytest.approx(want)


def test_drivers_cover_what_can_reach_the_threshold():
    fields = rs.DEFAULT_FIELDS
    for low, high, _, theta, _ in rs.drivers(list(range(1, 32)), fields, 0.7, [5, 1, 9, 50, 2]):
        assert low & high and 0 < theta <= 0.7
    for low in range(1, 32):
        rows = [r for r in rs.drivers([low], fields, 0.7, [5, 1, 9, 50, 2])]
        chosen, theta = [r[2] for r in rows], rows[0][3]
        # All chosen fields just below theta, all others equal: the score stays below the threshold.
        both = [k for k in range(5) if low >> k & 1]
        score = sum(f.weight * (theta if k in chosen else 1) for k, f in enumerate(fields) if k in both)
        assert score <= 0.7 * sum(fields[k].weight for k in both) + 1e-9


def test_links_of_near_copies_grow_with_their_number(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [row(i, f"{base} own{i}") for i in range(300)]
    table = rs.comparable(spark.createDataFrame(rows, DDL), FIELDS, "title")
    links = rs.match_links(table, FIELDS, "title", 0.6, 0.6)
    # All 44 850 pairs match.
    assert 299 <= links.count() < 900
    assert rs.connected_components(links).select("component").distinct().count() == 1


def test_pairs_equal_brute_force_on_long_texts(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    titles = []
    for _ in range(14):
        keep = rng.sample(base, rng.randrange(70, 120))
        titles.append(" ".join(keep))
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(titles)], DDL)
    table = rs.comparable(df, FIELDS, "title")
    got = {(r["left_id"], r["right_id"]) for r in rs.similar_pairs(table, FIELDS, "title", 0.6, 0.0).collect()}
    pairs = itertools.combinations(range(len(titles)), 2)
    assert got == {(i, j) for i, j in pairs if jaccard(titles[i], titles[j]) >= 0.6}


def test_same_doi_is_one_publication(spark):
    rows = [row(0, "aa bb", doi="https://doi.org/10.9/X"), row(1, "cc dd", doi="10.9/x"), row(2, "ee ff", doi="N/A"), row(3, "gg hh", doi="N/A")]
    got = {r["record_id"]: r["cluster_id"] for r in rs.resolve(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_null_fields_are_no_evidence(spark):
    rows = [(0, "same title here", None), (1, "same title here", "s"), (2, None, None), (3, "?!", None)]
    df = spark.createDataFrame(rows, "record_id long, title string, source string")
    table = rs.comparable(df, FIELDS, "title")
    pairs = rs.similar_pairs(table, FIELDS, "title", 0.5, 0.5).collect()
    assert [(p["left_id"], p["right_id"], p["score"]) for p in pairs] == [(0, 1, 1.0)]
    assert rs.identity_links(table, FIELDS).count() == 0


def test_label_candidates(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.52), (1, 2, 0.45)], "left_id long, right_id long, score double")
    got = [(r["left_id"], r["right_id"]) for r in rs.label_candidates(df, 2).collect()]
    assert got == [(0, 2), (1, 2)]


def test_model_learns_from_labelled_pairs(spark):
    titles = [("deep nets", "deep nets", 1), ("deep nets", "deep net", 1), ("soil", "graphs of", 0), ("rain in may", "rust", 0)] * 6
    df = spark.createDataFrame([(a, b, float(m)) for a, b, m in titles], "a string, b string, is_match double")
    fields = (rs.Field("title", "text"),)
    pairs = df.select(F.struct(F.col("a").alias("title")).alias("l"), F.struct(F.col("b").alias("title")).alias("r"), "is_match")
    names, model = rs.labelled_pairs_model(pairs, fields)
    scored = rs.model_scores(pairs, names, model, fields).collect()
    assert all((r["score"] > 0.5) == (r["is_match"] == 1) for r in scored)


def test_few_records_meet_by_chance(spark):
    """Records of one vocabulary meet on two words at a time, and no pair is missed."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(1500)]
    sets = [draw.sample(vocabulary, 40 + i % 30) for i in range(300)]
    for i in range(0, 60, 3):
        # A near copy: some words differ, so the pair is just above or below the threshold.
        sets[i + 1] = sets[i][: 36 - i % 7] + draw.sample(vocabulary, 4)
    rows = [(i, " ".join(dict.fromkeys(words))) for i, words in enumerate(sets)]
    df = spark.createDataFrame(rows, "record_id long, title string")
    fields = (rs.Field("title", "words", 1.0),)
    table = rs.comparable(df, fields, "title")
    counts = rs.field_index(table, fields, 0.5).groupBy("word").count()
    met = counts.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    single = table.select("id", F.explode("words").alias("word")).groupBy("word").count()
    alone = single.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < alone / 10
    bags = [set(title.split()) for _, title in rows]
    want = {
        (i, j) for i in range(300) for j in range(i + 1, 300) if len(bags[i] & bags[j]) / len(bags[i] | bags[j]) >= 0.5
    }
    for least in (None, 0.5):
        got = {(r[0], r[1]) for r in rs.similar_pairs(table, fields, "title", least, 0.5).collect()}
        assert got == want and len(want) > 5


def shared_words(seed, count, common=60, own=4000):
    """Records of frequent and rare words, some of them near copies of others."""
    draw = random.Random(seed)
    sets = []
    for i in range(count):
        words = draw.sample(range(common), 12) + draw.sample(range(common, own), 10 + i % 40)
        if i % 5 == 0 and i:
            words = [w for w in sets[draw.randrange(i)] if draw.random() < 0.93] + draw.sample(range(common, own), i % 3)
        sets.append(words)
    return [(i, " ".join(f"w{w}" for w in words), draw.choice("sr"), draw.choice("ab")) for i, words in enumerate(sets)]


def test_blocks_of_records_meet_without_keys(spark, monkeypatch):
    """All pairs are found wherever blocks and tiles end, and few others are written."""
    for name, value in (("BLOCK_ROWS", 64), ("TILE_ROWS", 16), ("MEETINGS_HELD", 256)):
        monkeypatch.setattr(rs, name, value)
    df = spark.createDataFrame(shared_words(7, 400), "record_id long, title string, source string, authors string")
    rows = [r.asDict() for r in df.collect()]
    for weights, threshold in (((0.8, 0.1, 0.1), 0.65), ((0.3, 0.4, 0.3), 0.6)):
        fields = tuple(rs.Field(n, c, w) for n, c, w in zip(("title", "source", "authors"), ("words", "equal", "equal"), weights))
        table = rs.comparable(df, fields, "title")
        want = {
            (a["record_id"], b["record_id"])
            for a, b in itertools.combinations(rows, 2)
            if brute_score(a, b, fields) >= threshold - 1e-12
        }
        near = {(r[0], r[1]) for r in rs.near_pairs(rs.sketched(table, fields, threshold), fields, threshold).collect()}
        assert want and want <= near
        if weights[0] == 0.8:
            assert len(near) <= 2 * len(want)
        got = {(r["left_id"], r["right_id"]) for r in rs.similar_pairs(table, fields, "title", None, threshold).collect()}
        assert got == want


def test_rows_of_one_id_are_one_set_of_words(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(0, words, "s", "a"), (0, words, "s", "a"), (1, words, "s", "b"), (1, words, "s", "b"), (2, words + " more", "r", "a")]
    df = spark.createDataFrame(rows, "record_id long, title string, source string, authors string")
    table = rs.comparable(df, THREE, "title")
    got = [(r["left_id"], r["right_id"]) for r in rs.similar_pairs(table, THREE, "title", None, 0.65).collect()]
    assert got == [(0, 1)] * 4


def test_words_are_kept_as_one_text(spark):
    df = spark.createDataFrame([(0, "b a, b", "s", None), (1, "?!", None, "x")], "record_id long, title string, source string, authors string")
    table = rs.comparable(df, THREE, "title")
    kept = {r["id"]: (r["v"]["title"], r["words"]) for r in table.collect()}
    assert kept == {0: (["a", "b"], ["a", "b"]), 1: (None, [])}
    plan = table._jdf.queryExecution().analyzed().toString()
    assert "split" in plan
