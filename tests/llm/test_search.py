"""Prefix forest and license scan next to brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import licenses as li
from reviewlake.llm import prefix_forest as p


def exact(vectors, nearest):
    rows = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            rows[i] = np.array(v, float)
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            others = [(-float(w @ v), i) for i, w in rows.items() if i != q and len(w) == len(v)]
            out[q] = [i for _, i in sorted(others)[:nearest]]
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16) * r.uniform(0.5, 2)]) for i in range(900)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] + [1.0] * 15), (2080, [None] + [1.0] * 15),
             (2100, [float("inf")] * 16), (None, rows[1][1]), (3000, [1.0, 2.0]), (3020, [2.0, 1.0]), (20, rows[20][1])]
    return rows


def test_recall_ties_and_odd_vectors(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in p.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, block_rows=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(vectors, 20)
    assert set(got) == set(want)
    by_id = dict(x for x in vectors if x[0] is not None)
    hits = total = 0
    for q, near in got.items():
        assert sorted(near) == list(range(1, min(20, len(want[q])) + 1))
        for v, score in near.values():
            assert abs(score - np.dot(by_id[q], by_id[v])) < 1e-9
        order = [(-s, v) for _, (v, s) in sorted(near.items())]
        assert order == sorted(order) and q not in {v for v, _ in near.values()}
        hits += len({v for v, _ in near.values()} & set(want[q]))
        total += len(want[q])
    assert hits / total >= 0.9
    # Copies of one vector: the smallest ids first.
    assert [v for v, _ in (got[40][k] for k in range(1, 21))] == want[40]


def test_empty_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int")
    assert p.nearest_neighbours(frame, F.col("vec_id") % 20 == 0).count() == 0


def base_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(li.WORD, low)
    starts, labels = [], set()
    for phrase, label in li.BASE:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return words, starts, labels


def rule_scan(words):
    """Kept labels and score, comparing every detection with every other."""
    line = " " + " ".join(words) + " "
    found = set()
    for rule in li.RULES:
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line, re.A):
            first = line[: m.start()].count(" ") - 1
            found.add((first, first + m[0].count(" "), rule.priority, rule.label, rule.confidence))
    kept = [
        d for d in found
        if not any(
            o[0] <= d[0] and o[1] >= d[1] and (o[2] > d[2] or (o[2] == d[2] and o[:2] != d[:2])) for o in found
        )
    ]
    return {d[3] for d in kept}, max((d[4] for d in kept), default=0.0)


def test_scan_next_to_brute_force(spark):
    r = random.Random(8)
    bits = ["MIT", "license", "License,", "apache", "2.0", "version", "GNU", "general public", "Lesser", "licensed under",
            "the", "terms of", "under", "CC BY-NC-SA 4.0", "bsd", "3-clause", "all rights reserved", "see", "stone", "é", "3"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(150)]
    texts += [None, "", " .-", "SPDX-License-Identifier: Apache-2.0", "mit license mit license", "MIT-License " * 3000]
    texts += ["Distributed under the terms of the GNU Lesser General Public License version 2.1", "Licensed under CC BY 4.0"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "MIT license", "y")], "doc_id long, text string, labels string")
    rows = {r["doc_id"]: r for r in li.scan(docs).collect()}
    assert len(rows) == len(texts) + 1 and rows[None]["base_labels"] == "mit"
    for i, text in enumerate(texts):
        words, starts, labels = base_scan(text)
        more, score = rule_scan(words)
        want = (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | more)), max(score, 0.9 if starts else 0.0),
        )
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == want, text
    assert li.scan(docs.where("false")).count() == 0


def assert_scans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in li.scan(docs).collect()}
    for i, text in enumerate(texts):
        words, starts, labels = base_scan(text)
        more, score = rule_scan(words)
        assert more, text
        want = (",".join(sorted(labels | more)), max(score, 0.9 if starts else 0.0))
        assert (rows[i]["labels"], rows[i]["score"]) == want, text


def test_notices_may_be_wrapped_or_hyphenated(spark):
    notices = ["in the public domain now", "All rights reserved", "released under the terms of the MIT license", "CC BY 4.0", "BSD 3 clause"]
    assert_scans(spark, [gap.join(n.split()) for n in notices for gap in (" ", "\n", "  ", "-", "\r\n * ")])


def strings_of(tree):
    """All strings a parsed pattern can match, digits as 4."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            part = [chr(arg)]
        elif kind == "IN":
            part = [chr(a) if str(o) == "LITERAL" else "4" for o, a in arg]
        elif kind == "BRANCH":
            part = [s for branch in arg[1] for s in strings_of(branch)]
        elif kind == "SUBPATTERN":
            part = strings_of(arg[3])
        else:
            assert kind == "MAX_REPEAT" and arg[:2] == (0, 1), kind
            part = ["", *strings_of(arg[2])]
        out = [a + b for a in out for b in part]
    return out


def test_keywords_and_hints_lie_in_all_that_a_pattern_matches():
    assert not any(" " in hint for hint in li.HINTS)
    for rule in li.RULES:
        for s in strings_of(re._parser.parse(rule.pattern)):
            assert all(k in s for k in rule.keywords), (rule, s)
            assert any(hint in s for hint in li.HINTS), (rule, s)


def test_every_wording_of_a_license_is_found_alone(spark):
    names = ["Attribution 4.0", "Attribution-ShareAlike 4.0", "Attribution-NoDerivatives", "Attribution-NonCommercial 4.0",
             "Attribution Non Commercial No Derivs", "Attribution-NonCommercial-Share Alike 3.0", "BY-ND", "BY 4.0"]
    texts = [f"{start} {name}" for name in names for start in ("Creative Commons", "Licensed under Creative Commons", "CC")]
    assert_scans(spark, [*texts, "MIT license, as found in the file LICENSE", "zlib license, which can be found"])


def test_there_are_hundreds_of_distinct_rules():
    assert len({(r.label, r.pattern) for r in li.RULES}) == len(li.RULES) > 200


LABELS = [
    ("Eclipse Public License 1.0", "epl-1.0"), ("Eclipse Public License", "epl"), ("CDDL 1.1", "cddl-1.1"), ("EUPL 1.1", "eupl-1.1"),
    ("Artistic License 1.0", "artistic-1.0"), ("Apache 2 web server", ""), ("Mozilla Public License", "mpl"),
    ("Licensed under Apache 2.0", "apache-2.0"), ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
    ("GPLv2 or later", "gpl-2.0-or-later"), ("GNU AGPL v3 only", "agpl-3.0-only"), ("LGPL-2.1", "lgpl-2.1"), ("GPL 2 with classpath exception", "gpl-2.0-with-classpath-exception"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("https://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc"), ("SPDX-License-Identifier: MIT", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without\n// modification, are permitted", "bsd"),
    ("Open Government Licence v3.0", "ogl-uk"), ("a plain sentence about rivers", ""),
]


def test_labels_of_names_versions_and_notices(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(LABELS)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in li.scan(docs).collect()}
    assert [(text, got[i]) for i, (text, _) in enumerate(LABELS)] == LABELS


def test_patterns_that_say_different_things():
    own = [p for _, _, p in li.NAMES] + [p for _, _, p in (*li.TEXTS, *li.GRANTED)] + [p for _, p in (*li.ADDRESSES, *li.RARE_NAMES)]
    assert len(set(own)) == len(own) > 200
