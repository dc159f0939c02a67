import datetime

import numpy as np

from tickframe.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, np.array(e, float), g) for i, e, g in rows if g is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links = {i: set() for i, *_ in rows}
    for n, (i, x, g) in enumerate(ok):
        for j, y, h in ok[:n]:
            if g == h and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(links):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(12)
    rows = []
    for i in range(500):
        v = rng.standard_normal(64)
        if i > 100:
            base = np.array(rows[i % 9][1])
            v = base if i % 5 == 0 else base + rng.standard_normal(64) * rng.choice([0.1, 0.3, 0.38, 0.42])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 9 % 3) if i % 50 else 7))
    rows += [(600, None, 1), (601, [0.0] * 64, 1), (602, [float("nan")] * 64, 1), (603, [None] * 64, 1), (604, rows[1][1], None), (605, [], 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (608, [float("inf")] * 64, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x, y = (rng.standard_normal((400, 64)) for _ in range(2))
    y = 0.8 * x + 0.6 * y
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    codes, factor = E.coded(x, 8, 32)
    count = E.turns(64, 8, 32)
    estimate = (E.decoded(codes, factor, 64, count) * y).sum(1)
    error = estimate - (x * y).sum(1)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= E.estimate_bound(factor, 64, count)).all()


def test_codes_apart_more_than_the_bound_are_far(monkeypatch):
    rng = np.random.default_rng(4)
    for size in (2, 3, 64):
        x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 3000, size)))
        y = y - (x * y).sum(1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        y = 0.93 * x + (1 - 0.93**2) ** 0.5 * y
        a, b = (E.coded(v, 14, 63)[0] for v in (x, y))
        assert np.bitwise_count(a ^ b).sum(1).max() <= E.far(0.93, size * E.turns(size, 14, 63))


def test_empty_and_repeated(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted(map(tuple, E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_labels_of_other_types(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, [0.0, 1.0], "a")]
    want = {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}
    for kind, of in (("string", lambda x: x), ("double", lambda x: None if x is None else float(ord(x))), ("date", lambda x: None if x is None else datetime.date(2024, 1, ord(x) - 90))):
        frame = spark.createDataFrame([(i, e, of(g)) for i, e, g in rows], f"vec_id long, embedding array<double>, label {kind}")
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(frame).collect()} == want
