import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tickframe.llm import crf, language

STEMS = {"xx": ["ba", "bo", "bil", "bum"], "yy": ["ske", "ski", "sko", "skal"], "zz": ["taé", "tué", "tié", "toé"]}


def made(spark, n=240):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(STEMS[lang], 2)) for _ in range(25)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_code_switching(spark):
    docs = made(spark)
    model = language.learn(docs)
    rows = language.identified(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    mixed = "babo bilbum boba bumbil skeski skosko skalske skiske"
    _, probable = model.word_posteriors(pa.array([mixed]))
    assert [model.languages[k] for k in probable.argmax(1)] == ["xx"] * 4 + ["yy"] * 4


def test_odd_rows(spark):
    model = language.learn(made(spark))
    rows = language.identified(cases.odd(spark), model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und" and r.score == 0) for r in rows if not (r.text or "").strip())
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 7)} <= {"xx", "yy", "zz"}
    signs = language.identified(spark.createDataFrame([("12 34 !?",), ("— “”",)], "text string"), model).collect()
    assert [r.lang_pred for r in signs] == ["und", "und"]
    clash = spark.createDataFrame([(1, "babo bilbum", "x", 9.0)], "doc_id long, text string, LANG_pred string, score double")
    assert [tuple(r)[:3] for r in language.identified(clash, model).collect()] == [(1, "babo bilbum", "xx")]
    assert language.identified(cases.none(spark), model).count() == 0
    assert language.learn(cases.none(spark)) is None
    assert {r.lang_pred for r in language.identified(cases.odd(spark), None).collect()} == {"und"}


def test_field_against_all_paths():
    rng = np.random.default_rng(1)
    field = crf.Field(rng.standard_normal((3, 3)), rng.standard_normal(3))
    sizes = np.array([1, 4, 3])
    first = np.cumsum(sizes) - sizes
    emission = rng.standard_normal((8, 3))
    both, moves, log = field.marginals(emission, first, sizes)
    best = field.best(emission, first, sizes)
    total = 0.0
    for a, n in zip(first, sizes):
        paths = list(itertools.product(range(3), repeat=int(n)))
        score = np.array([field.start[p[0]] + sum(field.move[x, y] for x, y in zip(p, p[1:])) + sum(emission[a + t, s] for t, s in enumerate(p)) for p in paths])
        total += np.log(np.exp(score).sum())
        weight = np.exp(score) / np.exp(score).sum()
        for t in range(n):
            assert np.allclose(both[a + t], [sum(w for w, p in zip(weight, paths) if p[t] == s) for s in range(3)])
        assert tuple(best[a : a + n]) == paths[score.argmax()]
    assert np.isclose(log, total) and np.isclose(moves.sum(), 5)
    assert np.allclose(field.posteriors(emission, first, sizes), both, atol=1e-5)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_carry_the_state(monkeypatch, block):
    rng = np.random.default_rng(3)
    field = crf.Field(rng.standard_normal((3, 3)) * 2, rng.standard_normal(3))
    sizes = rng.integers(1, 14, 60)
    first = np.cumsum(sizes) - sizes
    emission = rng.standard_normal((sizes.sum(), 3))
    both, _, _ = field.marginals(emission, first, sizes)
    best = field.best(emission, first, sizes)
    monkeypatch.setattr(crf, "BLOCK", block)
    assert np.allclose(field.posteriors(emission, first, sizes), both, atol=1e-5)
    assert (field.best(emission, first, sizes) == best).all()
