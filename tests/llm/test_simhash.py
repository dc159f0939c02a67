import re

import numpy as np
import pyarrow as pa
import xxhash

from tests.llm import cases
from tickframe.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [r.text for r in cases.odd(spark).select("text").collect()] + ["a b", "A  b", "x y z", "x y z x y z"]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain(t) for t in texts]


def test_anchors_meet():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    near = []
    for z in (x, y):
        sets = [set() for _ in z]
        for side in (0, 1):
            index, anchor = simhash.anchors_within(z >> np.uint64(32 * side))
            for i, a in zip(index.tolist(), anchor.tolist()):
                sets[i].add((side, a))
        near.append(sets)
    assert all(a & b for a, b in zip(*near))


def brute(prints):
    ids = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)] + [1, 3, 7, 0]
    for base in prints[:8]:
        for _ in range(12):
            prints.append(base ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    parts = {r.node % 2**64: r.component % 2**64 for r in simhash.components(simhash.links(rows)).collect()}
    want = brute(prints)
    for i in range(len(prints)):
        for j in range(i):
            same = parts.get(prints[i], prints[i]) == parts.get(prints[j], prints[j])
            assert same == (want[i] == want[j])


def test_odd_rows(spark):
    rows = simhash.near_duplicates(cases.odd(spark)).collect()
    assert len(rows) == 9
    got = {(r.doc_id, r.component_id) for r in rows}
    assert {(1, 1), (2, 1), (6, 1), (4, 4), (5, 4)} <= got
    assert simhash.near_duplicates(cases.none(spark)).count() == 0
