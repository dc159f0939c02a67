import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.llm import codes as C

SCHEMA = "vec_id long, embedding array<float>, label string, Code string, key long"


def brute(rows, parts, entries, rounds):
    """Lloyd by plain integers: {id: (code, error)} and the codebooks."""
    def whole(e):
        return e is not None and len(e) > 0 and len(e) % parts == 0 and all(x is not None and np.isfinite(x) for x in e)

    kept = sorted((i, [int(np.floor(256 * min(max(x, -C.BOUND), C.BOUND))) for x in e]) for i, e in rows if whole(e))
    size = len(kept[0][1])
    kept = [(i, v) for i, v in kept if len(v) == size]
    w = size // parts
    out = {i: ([], 0) for i, _ in kept}
    books = []
    for k in range(parts):
        xs = [(i, v[k * w : (k + 1) * w]) for i, v in kept]
        book = [x for _, x in xs[:entries]]

        def near(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

        for _ in range(rounds):
            held = {}
            for _, x in xs:
                held.setdefault(near(x)[1], []).append(x)
            book = [[sum(c) // len(c) for c in zip(*held[j])] if j in held else c for j, c in enumerate(book)]
        for i, x in xs:
            d, j = near(x)
            out[i] = (out[i][0] + [j], out[i][1] + d)
        books.append(book)
    return out, books


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_against_plain_integers(spark, rounds):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.01, 1])]) for i in rng.permutation(400).tolist()]
    rows += [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] + [0.0] * 7), (904, []), (905, [1.0] * 3), (906, [1.0] * 12), (907, [3e38, -3e38] * 4)]
    frame = spark.createDataFrame([(i, e, str(i % 3) if i % 7 else None, "x", 1) for i, e in rows], SCHEMA).repartition(5)
    got, books = C.compressed(frame, parts=4, entries=7, rounds=rounds)
    want, want_books = brute(rows, 4, 7, rounds)
    assert books.tolist() == want_books
    assert {r.vec_id: (list(r.code), r.error) for r in got.collect()} == want
    assert got.columns == ["vec_id", "label", "key", "code", "error"]
    sums = {}
    for i in want:
        label = str(i % 3) if i % 7 else None
        sums[label] = sums.get(label, 0) + want[i][1]
    assert {r.vec_id: r.label_error for r in C.with_label_error(got).collect()} == {i: sums[str(i % 3) if i % 7 else None] for i in want}


def test_only_changed_parts_are_moved(spark):
    rows = spark.createDataFrame([([1, 2], bytearray([0, 1]), bytearray([0, 0])), ([3, 5], bytearray([1, 1]), bytearray([1, 1]))], "ints array<int>, code binary, was binary")
    got = {r.slot: r.change for r in C.deltas(rows.coalesce(1), (2, 2, 1)).collect()}
    assert got == {4: -1, 5: -2, 6: 1, 7: 2}  # part 1: entry 0 loses one of 2, entry 1 has it


def test_large_numbers_and_ties():
    x = np.array([[1 << 24, -(1 << 24)] * 8, [0] * 16], np.int64)
    entries = np.array([[0] * 16, x[0].tolist(), [0] * 16], np.int64)
    assert C.nearest(x, entries).tolist() == [1, 0]


def test_joined_labels_restored_and_empty(spark, monkeypatch):
    frame = spark.createDataFrame([(1, [0.5, -0.25], "a", "x", 1), (1, [0.5, -0.25], "a", "x", 1), (None, [0.1, 0.0], None, "x", 1)], SCHEMA)
    got, books = C.compressed(frame, parts=2)
    monkeypatch.setattr(C, "FEW_LABELS", 0)
    assert sorted((r.label or "", r.error, r.label_error) for r in C.with_label_error(got).collect()) == [("", 0, 0), ("a", 0, 0), ("a", 0, 0)]
    near = {r.vec_id: r.embedding for r in C.restored(got, books).collect()}
    assert np.allclose(near[1], [0.5, -0.25], atol=1 / 256)
    none, books = C.compressed(frame.where(F.lit(False)))
    assert none.count() == 0 and none.columns == got.columns and books.shape[0] == 16
    assert C.with_label_error(none).count() == 0
