import zlib

import numpy as np
import pyarrow as pa

from tests.llm import cases
from tickframe.llm import quality


def made(spark, n=600):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        words = rng.choice(cases.WORDS, 30)
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words)))
        marks.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    rows = quality.predicted(docs, labels).collect()
    assert len(rows) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([(r.predicted == 1) == (r.doc_id % 3 > 0) for r in held]) > 0.98


def test_updates_against_plain_numbers():
    """The textbook's loop, one coordinate at a time."""
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6), float(rng.integers(2))) for _ in range(40)]
    leader = quality.Leader()
    got = leader.fit(rows, 3)
    share = np.clip(np.mean([y for *_, y in rows]), 0.01, 0.99)
    bias, z, n = np.log(share / (1 - share)), [0.0] * 50, [0.0] * 50

    def weight(i):
        if abs(z[i]) <= leader.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * leader.l1) / ((leader.beta + n[i] ** 0.5) / leader.alpha + leader.l2)

    turn = np.random.default_rng(1)
    for _ in range(3):
        for r in turn.permutation(len(rows)):
            at, x, y = rows[r]
            p = 1 / (1 + np.exp(-(bias + sum(weight(i) * v for i, v in zip(at, x)))))
            for i, v in zip(at, x):
                g = (p - y) * v
                step = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / leader.alpha
                z[i] += g - step * weight(i)
                n[i] += g * g
    assert np.allclose(got[:50], [weight(i) for i in range(50)], atol=1e-12) and not got[50:-1].any()
    assert np.isclose(got[-1], bias)


def test_repeated_rows_and_labels_teach_once(spark):
    docs, labels = made(spark, 60)
    once = quality.learn(docs, labels)
    many = quality.learn(docs.unionByName(docs).unionByName(docs.limit(20)), labels.unionByName(labels))
    assert np.allclose(once, many)


def test_scores_ignore_other_columns(spark):
    docs, labels = made(spark, 60)
    weights = quality.learn(docs, labels)
    a = quality.scored(docs, weights).collect()
    b = quality.scored(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'x' as lang"), weights).collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_odd_rows(spark):
    docs, labels = made(spark, 60)
    weights = quality.learn(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 5), (1, 1)], "doc_id long, quality int")))
    rows = quality.scored(cases.odd(spark), weights, "probability").collect()
    assert len(rows) == 9 and all(0 <= r.probability <= 1 for r in rows)
    assert quality.scored(cases.none(spark), weights).count() == 0
    clash = spark.createDataFrame([(1, "a cat", 5)], "doc_id long, text string, Score int")
    assert quality.scored(clash, weights).columns == ["doc_id", "text", "score"]
    nothing = quality.learn(cases.none(spark), labels.limit(0))
    assert not nothing.any()


def test_features_have_length_one():
    row, _, value = quality.features(pa.array(["a b c", None, "", "A A A"]))
    assert np.allclose(np.bincount(row, value**2, 4), [1, 0, 0, 1])
