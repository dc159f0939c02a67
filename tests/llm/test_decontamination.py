import random
import re

import numpy as np

from tests.llm import cases
from tickframe.llm import decontamination as D


def test_tiles_cover_moved_passages():
    a, b = np.arange(1, 13, dtype=np.uint64), np.arange(101, 130, dtype=np.uint64)
    text = np.concatenate([[7777], b, [8888], a, [9999]]).astype(np.uint64)
    found = D.tiles(text, np.concatenate([a, b]))
    assert sorted(found) == [(1, 12, 29), (31, 0, 12)]


def test_tiles_never_overlap():
    rnd = random.Random(6)
    for _ in range(40):
        text, item = (np.array([rnd.randrange(4) for _ in range(n)], np.uint64) for n in (60, 25))
        found = D.tiles(text, item, 3)
        for side in (0, 1):
            used = [i for t in found for i in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        assert all((text[a : a + n] == item[b : b + n]).all() and n >= 3 for a, b, n in found)
        free = [[i for i in range(m) if not any(t[s] <= i < t[s] + t[2] for t in found)] for s, m in ((0, 60), (1, 25))]
        runs = [{tuple(v[i : i + 3].tolist()) for i in f if i + 1 in f and i + 2 in f} for v, f in zip((text, item), free)]
        assert not runs[0] & runs[1]


def longest_first(text, item, k):
    """Greedy string tiling by comparing all places of both word lists."""
    free_a, free_b, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while a + n < len(text) and b + n < len(item) and free_a[a + n] and free_b[b + n] and text[a + n] == item[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < k:
            return out
        out.append((a, b, n))
        free_a[a : a + n] = [False] * n
        free_b[b : b + n] = [False] * n


def test_tiles_against_brute_force():
    rnd = random.Random(16)
    for _ in range(60):
        text, item = (np.array([rnd.randrange(1, rnd.choice([3, 5])) for _ in range(n)], np.uint64) for n in (45, 30))
        assert sorted(D.tiles(text, item, 3, rnd.choice([3, 6, 20]))) == sorted(longest_first(text.tolist(), item.tolist(), 3))


def test_both_ways_against_brute_force(spark):
    rnd = random.Random(18)
    pool = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rnd.choice(pool[: rnd.choice([4, 25])]) for _ in range(n))
    items = [(i, text(rnd.choice([3, 12, 30]))) for i in range(12)]
    docs = []
    for i in range(40):
        a, b = (rnd.choice(items)[1].split() for _ in range(2))
        docs.append((i, " ".join([text(10), " ".join(a[len(a) // 2 :]).upper(), text(rnd.choice([0, 6])), " ".join(a[: len(a) // 2]), "- ".join(b[:9])])))
    docs += docs[:3]
    want = []
    for d, t in docs:
        words = [re.sub(r"\W", "", w).lower() for w in t.split() if w != "-"]
        for i, x in items:
            own = x.split()
            laid = longest_first(words, own, 5)
            size = sum(n for *_, n in laid)
            if len(own) >= 5 and size / len(own) >= 0.5:
                want.append((d, i, len(laid), size, len(own)))
    assert len(want) > 30
    for way in (D._tiled, D._joined):
        rows = way(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, 0.5, "found").collect()
        assert sorted((r.doc_id, x.item_id, x.n_tiles, x.matched_words, x.item_words) for r in rows for x in r.found) == sorted(want)


def made(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("klmnop") + str(rnd.randrange(90))
    items = [" ".join(word() for _ in range(40)) for _ in range(6)] + ["too short"]
    docs = []
    for i in range(60):
        words = [word() for _ in range(100)]
        if i % 5 == 0:
            own = items[i % 6].split()
            own = own[20:] + own[:20] if i % 2 else own
            words[30:30] = [w.upper() + "," for w in own]
        if i % 5 == 1:
            words[3:3] = items[i % 6].split()[:12]
        docs.append((i, " ".join(words)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_planted_passages(spark):
    docs, items = made(spark)
    for way in (D._tiled, D._joined):
        rows = way(docs, items, D.K, D.COVERAGE, "found").collect()
        got = {(r.doc_id, x.item_id) for r in rows for x in r.found}
        assert len(rows) == 60 and got == {(i, i % 6) for i in range(0, 60, 5)}
    assert all(x.coverage == 1.0 for r in rows for x in r.found)


def test_odd_rows(spark):
    _, items = made(spark)
    items = items.unionByName(spark.createDataFrame([(None, cases.LONG), (8, None), (9, ""), (10, " ".join(cases.LONG.split()[:50]))], items.schema))
    want = {(4, 10), (5, 10)}
    for way in (D._tiled, D._joined):
        rows = way(cases.odd(spark), items, D.K, D.COVERAGE, "found").collect()
        assert len(rows) == 9 and {(r.doc_id, x.item_id) for r in rows for x in r.found} == want
        assert way(cases.none(spark), items, D.K, D.COVERAGE, "found").count() == 0
    clash = spark.createDataFrame([(1, cases.LONG, "x", 5, 6)], "doc_id long, text string, FOUND string, _key int, key int")
    assert D.tiled(clash, items).columns == ["doc_id", "text", "_key", "key", "found"]
    assert [len(r.found) for r in D._joined(clash.drop("FOUND"), items, D.K, D.COVERAGE, "found").collect()] == [1]
    assert D.tiled(cases.odd(spark), items.limit(0)).where("size(found) > 0").count() == 0
