import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tests.llm import cases
from tickframe.llm import packing as P


def one_by_one(counts, size):
    """Best-two-fit, a bin at a time, by plain lists: the lengths in each bin."""
    left = Counter(counts)
    bins = []
    while +left:
        taken, gap = [], size
        while fits := [x for x in left if left[x] and x <= gap]:
            taken.append(max(fits))
            left[taken[-1]] -= 1
            gap -= taken[-1]
        low = min(taken)
        pairs = [(a + b, a, b) for a in left for b in left if a >= b and left[a] and left[b] and (a > b or left[a] > 1) and low < a + b <= gap + low]
        if len(taken) > 1 and pairs:
            _, a, b = max(pairs)
            taken.remove(low)
            left[low] += 1
            for x in (a, b):
                taken.append(x)
                left[x] -= 1
        bins.append(sorted(taken, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_gives_the_bins_of_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([10, 37, 64]))
    counts = {int(k): int(rng.choice([1, 2, 3, 40])) for k in rng.choice(np.arange(1, size + 1), rng.integers(1, min(20, size)), replace=False)}
    table = P.plan(counts, size)
    n, bins = sum(counts.values()), {}
    lengths = [k for k in sorted(counts) for _ in range(counts[k])]
    for number in range(n):
        first, alike, bin_, offset, length = table[np.searchsorted(table[:, 0], number, "right") - 1].tolist()
        assert length == lengths[number]
        k = number - first
        bins.setdefault(bin_ + k % alike, []).append((offset + k // alike * length, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    assert [sorted((x for _, x in bins[b]), reverse=True) for b in sorted(bins)] == one_by_one(counts, size)
    assert len(table) <= size * (1 + np.log(size)) * 10


def test_runs_are_bounded_however_many_pieces():
    rng = np.random.default_rng(1)
    most = {k: int(n) for k, n in enumerate(rng.integers(1, 10**9, 2048), 1)}
    assert len(P.plan(most)) < 200_000
    short = {k: int(1 + 10**9 * rng.random() / k) for k in range(1, 2049)}  # more short pieces than long ones
    table = P.plan(short)
    total = sum(k * n for k, n in short.items())
    assert len(table) < 200_000 and (table[:, 2] + table[:, 1]).max() <= -(-total // 2048) * 1.00001
    assert P.plan({}).shape == (0, 5)


def test_parted():
    runs = [(0, np.arange(3)), (1, np.arange(0)), (2, np.arange(5)), (2, np.arange(5, 9)), (3, np.arange(8))]
    got = [(r, k, x.tolist()) for r, k, x in P.parted(iter(runs), 4, 99)]
    assert got == [(0, 0, [0, 1, 2, 99]), (1, 0, [99]), (2, 0, [0, 1, 2, 3]), (2, 1, [4, 5, 6, 7]), (2, 2, [8, 99]), (3, 0, [0, 1, 2, 3]), (3, 1, [4, 5, 6, 7]), (3, 2, [99])]


def test_documents_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3000)
    monkeypatch.setattr(P, "IDS", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.packed(docs.select("doc_id", "text", F.lit(1).alias("Piece"), F.lit(2).alias("number")), 128).collect()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert got[0].asDict().keys() == {"doc_id", "number", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"}
    whole = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == 128 * r.piece == len(whole.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 128
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id] += r.ids
    assert whole == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.ids))
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= -(-sum(map(len, want.values())) // 128) + 2
    assert Counter(tuple(sorted((len(x) for _, x in b), reverse=True)) for b in bins.values()) == Counter(tuple(b) for b in one_by_one(Counter(r.length for r in got), 128))
    rows = P.sequences(spark.createDataFrame(got)).collect()
    assert {r.sequence_id: r.ids for r in rows} == {k: sum((x for _, x in sorted(b)), []) for k, b in bins.items()}
    assert all(r.length == len(r.ids) <= 128 for r in rows)


def test_odd_rows(spark):
    got = P.packed(cases.odd(spark)).collect()
    assert Counter(r.doc_id for r in got)[1] == 1 and [r.ids for r in got if r.doc_id == 1] == [[0]]
    assert sum(r.doc_id == 5 for r in got) == 2 * sum(r.doc_id == 4 for r in got) > 2
    assert sum(r.doc_id is None for r in got) == 1
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:])) and min(held)[0] == 0 and sum(n for _, n in held) <= 2048
    assert P.packed(cases.none(spark)).count() == 0
