"""Vector codes next to plain rounds that compare every part with every entry."""

import math
import random

import numpy as np
import pytest

from reviewlake.llm import codes as c


def plain(rows):
    """``{vec_id: (code, error)}`` and codebooks of ``(vec_id, label, vector)``."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    length = len(kept[0][2])
    parts = [range(-(-length * p // 4), -(-length * (p + 1) // 4)) for p in range(4)]
    books = [[[v[k] for k in part] for _, _, v in kept[:256]] for part in parts]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p, part in enumerate(parts):
            members = {}
            for _, _, v in kept:
                x = [v[k] for k in part]
                members.setdefault(nearest(books[p], x)[1], []).append(x)
            for i, xs in members.items():
                books[p][i] = [sum(column) // len(xs) for column in zip(*xs)]
    out = []
    for i, label, v in kept:
        found = [nearest(books[p], [v[k] for k in part]) for p, part in enumerate(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def vectors(n, length, seed, repeat=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(length)] for _ in range(40)]
    out = []
    for i in range(n):
        v = [x + r.gauss(0, 0.2) for x in r.choice(centres)]
        out += [(i * 3 - 5, r.choice([0, 1, None]), v)] * repeat
    return out


@pytest.mark.parametrize("n,length,repeat", [(420, 8, 1), (3, 8, 2), (300, 12, 1), (60, 5, 1)])
def test_codes_next_to_plain_rounds(spark, n, length, repeat):
    rows = vectors(n, length, n, repeat)
    odd = [(900, 1, None), (901, 1, [float("nan")] * length), (902, 0, [float("inf")] + [0.0] * (length - 1)), (903, 0, [None] * length), (904, 0, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    frame = frame.selectExpr("*", "'x' AS code", "1 AS v", "2 AS key", "3 AS spread")
    got = c.compress(frame.repartition(3)).collect()
    want, books = plain(rows)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    told = sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got)
    assert told == sorted((i, code, error, totals[label]) for i, label, code, error in want)
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    import hashlib

    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(numbers.encode()).hexdigest()}


def test_empty_and_wrong_lengths(spark):
    frame = spark.createDataFrame([(1, 0, [0.5, 1.0]), (2, 0, [0.5])], "vec_id long, label int, embedding array<double>")
    assert c.compress(frame.where("false")).count() == 0
    with pytest.raises(Exception, match="another length"):
        c.compress(frame).collect()


def test_bounds_are_exact_and_save_work():
    r = np.random.default_rng(3)
    centres = r.integers(-900, 900, (64, 8))
    x = centres[r.integers(0, 64, 4000)] + r.integers(-40, 40, (4000, 8))
    # Entries drift, then settle; some go out and come back, so that net moves are short.
    books = [x[:64].copy()]
    for step in range(6):
        books.append(books[-1] + (r.integers(-30, 30, (64, 8)) if step < 2 else 0))
    books.append(books[0].copy())
    state, work = c.State.new(len(x), 2), []
    for now in range(1, len(books) + 1):
        history = np.stack(books[:now])
        state, best, worked = c.assign(x, history, state)
        whole = ((x[:, None, :] - history[-1][None]) ** 2).sum(2)
        assert (state.code == whole.argmin(1)).all() and (best == whole.min(1)).all()
        work.append(worked)
        for g in range(2):
            members = np.arange(64) // c.GROUP == g
            others = members[None, :] & (np.arange(64)[None, :] != state.code[:, None])
            then = np.stack([np.where(others[i], ((x[i] - books[state.stamp[i, g]]) ** 2).sum(1), 1 << 60) for i in range(200)])
            assert (state.bound[:200, g] <= np.sqrt(then.min(1).astype(float)) + 1e-3).all()
    assert work[0] >= 64 * len(x) and work[5] < work[0] / 2


def test_net_moves_are_never_more_than_the_sum_of_moves():
    r = np.random.default_rng(1)
    books = np.cumsum(r.integers(-9, 9, (6, 64, 4)), axis=0)
    net = c.net_moves(books)
    each = np.sqrt(((books[1:] - books[:-1]) ** 2).sum(2))
    for then in range(5):
        drift = np.maximum.reduceat(each[then:].sum(0), [0, c.GROUP])
        assert (net[then] <= drift + 1e-9).all() and net[-1].max() == 0
