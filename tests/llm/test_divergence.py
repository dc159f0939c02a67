import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tickframe.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = Counter(x.translate(LOWER) for x in TERM.findall(text or ""))
        key = (lang or "", source or "")
        groups.add(key)
        counts[key].update(found)
        held[key[0]].update(found.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        sources = sorted(s for x, s in groups if x == lang)
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def got(frame, least=3, top=4):
    return sorted(map(tuple, D.audited(frame, least, top).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # blocks of groups, and tasks that hand on early
        monkeypatch.setattr(D, "GROUPS", 3)
        monkeypatch.setattr(D, "CELLS", 64)
        monkeypatch.setattr(D, "CHUNK", 300)
        monkeypatch.setattr(D, "ROWS", 50)
    rng = np.random.default_rng(8)
    words = ["the", "The", "Cat", "naïve", "ÄB", "x1y", "日本 語", "don't", "a_b", "z" * 40, "q\x00r"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), ["en", "de", None, ""][min(3, rng.integers(0, 6))], [None, "a", "b", "c", "d\x00"][rng.integers(0, 5)]) for _ in range(150)]
    rows += [(None, "en", "empty"), ("rare words only", "la", "a"), ("12 34", "la", "b"), ("the " * 5000, "en", "a")]
    frame = spark.createDataFrame([(i % 60, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(6)
    assert got(frame) == brute(rows, 3, 4)


def test_odd_rows(spark):
    frame = cases.odd(spark)
    rows = [(r.text, r.lang, r.source) for r in frame.collect()]
    assert got(frame, 2, 50) == brute(rows, 2, 50)
    assert D.audited(cases.none(spark)).count() == 0


def test_shares_are_exact(spark):
    rows = [(5, 7), (1, 9 * 10**15 - 1), (9 * 10**15 - 3, 9 * 10**15 - 1), (3, 3), (4, 0)]
    frame = spark.createDataFrame(rows, "a long, b long")
    values = [r[0] for r in frame.select(D.share(frame.a, frame.b)).collect()]
    assert values == [1 + 10**9 * a // b if b else 1 for a, b in rows]


def test_terms():
    names, row = D.terms(pa.array(["Hello, wörld x", None, "", "HELLO-é", "ÀÉ"]))
    assert names.to_pylist() == ["hello", "wörld", "x", "hello", "é", "ÀÉ"] and row.tolist() == [0, 0, 0, 3, 3, 4]
