import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tickframe.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 10 or got != list(range(n))


def brute(x, n, key):
    """The place of x by plain integers: six rounds on the two halves, again until it is below n."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def hashed(value, k):
        h = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
        for part in (key, k):
            h = xxhash.xxh64_intdigest(struct.pack("<i", part), h)
        return h - (h >> 63 << 64)

    while True:
        left, right = divmod(x, b)
        for k in range(6):
            if k % 2:
                right = (right + hashed(left, k) % b) % b
            else:
                left = (left + hashed(right, k) % a) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [2, 3, 50, 97, 1003])
def test_against_plain_integers(spark, n):
    docs = spark.range(n).selectExpr("id * 5 as doc_id").repartition(5)
    for r in sharding.shards(docs, 7, ["doc_id"], key=99).collect():
        place = brute(r.doc_id // 5, n, 99)
        assert (r.row_number, r.place, r.shard, r.slot) == (r.doc_id // 5, place, place % 7, place // 7)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(3, "b", 1, 2, 9, 0), (1, "a", 3, 4, 9, 0)], "doc_id long, Shard string, tie int, slot int, part int, row_number int")
    rows = sharding.shards(docs, 2, ["Shard", "doc_id"])
    assert rows.columns == ["doc_id", "tie", "part", "row_number", "place", "shard", "slot"]
    assert sorted((r.doc_id, r.tie, r.row_number) for r in rows.collect()) == [(1, 3, 0), (3, 1, 1)]


def test_shards_are_even_and_gapless(spark):
    docs = spark.range(1003).selectExpr("id * 3 as doc_id", "cast(id as string) as text")
    rows = sharding.shards(docs.repartition(7), 24, ["doc_id"]).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size))
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs.repartition(2), 24, ["doc_id"]).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    assert [r.row_number for r in sorted(rows, key=lambda r: r.doc_id)] == list(range(1003))


def test_odd_rows(spark):
    docs = cases.odd(spark).select("doc_id", "text", "_part")
    rows = sharding.shards(docs, 4, ["doc_id", "text"]).collect()
    assert len(rows) == docs.count() and Counter(r.shard for r in rows) == Counter({0: 3, 1: 2, 2: 2, 3: 2})
    assert sharding.shards(cases.none(spark), 4, ["doc_id"]).count() == 0
