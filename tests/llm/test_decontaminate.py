"""Contaminations next to the edit distance of every item and every passage."""

import random
import re

import pytest

from reviewlake.llm import decontaminate as d

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()
ITEM_SCHEMA, DOC_SCHEMA = "item_id long, text string, lang string", "doc_id long, text string, item_id string"


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fewest_edits(item, text):
    """Least edits between the item and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for doc_id, text, *_ in docs:
        for item_id, item, *_ in items:
            w = words_of(item)
            edits = fewest_edits(w, words_of(text)) if w else None
            if w and edits <= len(w) // 5:
                out[doc_id, item_id] = min(edits, out.get((doc_id, item_id), edits))
    return out


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[at] = r.choice(WORDS)
        elif kind == 1:
            words.insert(at, r.choice(WORDS))
        else:
            del words[at]
    return words


@pytest.fixture(scope="module")
def tables():
    r = random.Random(11)
    # Few different words, so runs of the items occur by chance as well.
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n)), "x") for i, n in enumerate([1, 2, 3, 5, 8, 12, 20, 33, 60])]
    items += [(20, None, "x"), (21, " .,; ", "x"), (22, items[6][1], "x"), (22, items[6][1], "x")]
    docs = []
    for i in range(150):
        item = words_of(r.choice(items)[1]) or ["rho"]
        body = edited(r, item, r.randint(0, max(1, len(item) // 4)))
        around = [r.choice(WORDS) for _ in range(r.randrange(40))]
        cut = r.randrange(len(around) + 1)
        docs.append((i, ", ".join(around[:cut] + body + around[cut:]).title(), None))
    docs += [(200, None, None), (201, "", None), (None, items[7][1], None), (202, items[7][1], None), (202, items[7][1], None)]
    docs += [(203, "other words " * 30_000 + items[8][1] + " end" * 10_000, None)]
    return docs, items


def test_all_contaminations_are_found(spark, tables):
    docs, items = tables
    got = d.contaminations(spark.createDataFrame(docs, DOC_SCHEMA).repartition(3), spark.createDataFrame(items, ITEM_SCHEMA))
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got.collect()}
    short = [x for x in docs if x[0] != 203]
    want = brute(short, items)
    assert {k: v for k, v in found.items() if k[0] != 203} == want
    assert found[203, 8] == 0


def test_passages_are_placed(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "")], ITEM_SCHEMA)
    docs = spark.createDataFrame([(7, "zero ONE two-three x four five six seven eight nine ten. End", None)], DOC_SCHEMA)
    row = d.contaminations(docs, items).first()
    assert (row["edits"], row["first_word"], row["end_word"], row["similarity"]) == (1, 1, 12, 0.9)


def test_blocks_of_items_and_empty_tables(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)
    few = [x for x in docs if x[0] is None or x[0] < 40]
    frame, bench = spark.createDataFrame(few, DOC_SCHEMA), spark.createDataFrame(items, ITEM_SCHEMA)
    assert len(d.indexes(bench)) > 1
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.contaminations(frame, bench).collect()}
    assert found == brute(few, items)
    kept = d.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    dirty = {k[0] for k in found}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x[0] for x in few if x[0] not in dirty)
    none = bench.where("false")
    assert d.contaminations(frame, none).count() == 0 and d.decontaminate(frame, none).count() == len(few)
    assert d.contaminations(frame.where("false"), bench).count() == 0


def test_recall_at_the_limit_of_edits():
    import pyarrow as pa

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 60)))) for i in range(60)]
    index = d.build_index(items)
    texts = []
    for _, text in items * 5:
        words = text.split()
        around = [r.choice(vocabulary) for _ in range(60)]
        texts.append(" ".join(around + edited(r, words, len(words) // 5) + around))
    got = {(row, item) for row, item, *_ in d.search(pa.array(texts), index)}
    assert sum((i, i % 60) in got for i in range(300)) >= 297
