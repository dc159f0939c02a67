import random
import re

import numpy as np
import pytest

from tests.llm import cases
from tickframe.llm import substrings as S


def brute(rows, w=50):
    """doc_id, words, removed and kept text of (doc_id, text) rows."""
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - w + 1):
            key = tuple(words[i : i + w])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - w + 1):
            if d is not None and first[tuple(words[i : i + w])] < d:
                gone |= set(range(i, i + w))
        out.append((d, len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def made(n=60):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(30))
    passages = [[word() for _ in range(m)] for m in (50, 49, 70, 120, 51)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.choice([3, 49, 80, 300]))]
        if i % 2:
            at = rnd.randrange(len(words))
            words[at:at] = passages[i % 5]
        if i % 11 == 0:
            words += ["loop"] * 130
        if i % 7 == 3 and rows:
            words = rows[i // 2][1].split()
        rows.append((i * 3 % n, " \n".join(words)))
    return rows + rows[1:40:3] * 2


@pytest.mark.parametrize("hot", [2, 2000])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", 40)
    rows = made()
    got = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)
    assert sum(r.n_removed for r in got) > 500


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeated_rows_around_one_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", 5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([f"a{d}x{i}" for i in range(40)] + passage + [f"b{d}x{i}" for i in range(40)])) for d in range(12)]
    rows += rows[3:8] + rows[5:6] * 3
    got = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_collide_modulo_powers_of_two(spark, size):
    turn = [bin(i).count("1") % 2 for i in range(size)]
    words = ["".join("ab"[x ^ flip] for x in turn) for flip in (0, 1)]
    rest = [f"w{i}" for i in range(49)]
    rows = [(d, " ".join([words[d], *rest])) for d in range(2)]
    got = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 0)]


def test_index_finds_intervals():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 3, n) for n in (60, 55, 80, 51, 50)]
    pieces.append(pieces[2][10:75])
    size = np.array([len(p) for p in pieces])
    index = S.Index(np.concatenate(pieces), size, np.arange(10, 16), 50)
    for own, found in zip(pieces, index.windows()):
        want = [min(10 + j for j, p in enumerate(pieces) if any((p[k : k + 50] == own[i : i + 50]).all() for k in range(len(p) - 49))) for i in range(len(own) - 49)]
        assert found.tolist() == want


def test_very_long_texts_and_clashing_columns(spark):
    words = [f"w{i * 7919 % 9973}x{i}" for i in range(120_000)]
    rows = [(2, " ".join(words), 1, 2), (1, " ".join(words[50_000:70_000]), 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long, n_removed long")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in S.deduplicated(docs).collect()}
    assert got == {1: (20_000, 0), 2: (120_000, 20_000)}


def test_odd_rows(spark):
    docs = cases.odd(spark)
    got = S.deduplicated(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert S.deduplicated(cases.none(spark)).count() == 0
