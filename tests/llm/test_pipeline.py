import random

import pytest

import corpus_pipeline as P
from tests.llm import cases
from tickframe.llm import simhash


def shingles(text, k=5):
    words = "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("block", [6, 2048])
def test_representatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("mnop") + str(rnd.randrange(60))
    docs, base = [], [[word() for _ in range(300)] for _ in range(20)]
    for i in range(160):
        words = base[i % 20][:] if i >= 20 else base[i]
        for _ in range((i // 20) % 4 if i >= 20 else 0):
            words[rnd.randrange(300)] = word()
        docs.append((i, " ".join(words if i < 100 or i % 3 else words[:40] + [word() for _ in range(260)])))
    sets = [shingles(t) for _, t in docs]
    low = list(range(160))
    for i in range(160):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    got = simhash.representatives(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(low)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "one two three", 7, 8, 9, 1.5), (1, "One, two; three", 7, 8, 9, 2.5), (3, "other", 1, 2, 3, 4.5)], "doc_id long, text string, row_hash long, node long, `row` int, `a.b` double")
    rows = simhash.representatives(docs)
    assert rows.columns == docs.columns
    assert sorted(map(tuple, rows.collect())) == [(1, "One, two; three", 7, 8, 9, 2.5), (3, "other", 1, 2, 3, 4.5)]


def varied(rnd, base, times, word):
    words = base[:]
    for at in rnd.sample(range(len(base)), times):
        words[at] = word()
    return words


def jaccard(a, b):
    a, b = shingles(" ".join(a)), shingles(" ".join(b))
    return len(a & b) / len(a | b)


def kept(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id for r in simhash.representatives(rows).collect()}


def test_copies_within_a_large_templated_group(spark):
    """Texts of one template (similarity about 0.7) do not hide the near copies among them."""
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("mnop") + str(rnd.randrange(10**6))
    base = [word() for _ in range(200)]
    texts = [varied(rnd, base, 4, word) for _ in range(1000)]
    copies = [c for t in texts[:200] for c in [varied(rnd, t, 4, word)] if jaccard(c, t) >= 0.8]
    assert len(copies) > 150
    got = kept(spark, texts + copies)
    assert not got & set(range(1000, 1000 + len(copies)))
    assert len(got) > 300


def test_short_texts_are_told_apart(spark):
    texts = [[f"a{i}", f"b{i}"] for i in range(2000)]
    assert kept(spark, texts) == set(range(2000))


def test_similarity_is_exact_near_the_threshold(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(10**8))
    texts, low = [], set()
    for i in range(300):
        one = [word() for _ in range(180)]
        two = varied(rnd, one, 4 + i % 2, word)
        low |= {len(texts)} if jaccard(one, two) >= 0.8 else {len(texts), len(texts) + 1}
        texts += [one, two]
    assert 320 < len(low) < 580
    assert kept(spark, texts) == low


def test_fingerprints_within_two_bits_are_linked(spark):
    """Each text that near_duplicates puts behind another one goes, also where repeats alone make them alike."""
    texts = [[f"{x}{i}" for i in range(40)] + ["a", "b", "c"] * 2000 for x in "xyz"] + [["other", "words"], ["yet", "others"]]
    rows = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in simhash.near_duplicates(rows).collect()} == {0, 3, 4}
    assert max(jaccard(texts[i], texts[j]) for i, j in ((0, 1), (0, 2), (1, 2))) < 0.8
    assert {r.doc_id for r in P.near_duplicate_stage(spark, rows, "").collect()} == {0, 3, 4}


def folder(spark, tmp_path, docs):
    labels = [(i, 1) for i in range(40)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(cases.LONG.split()[:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = cases.odd(spark)
    where = folder(spark, tmp_path, docs)
    for n, (name, stage) in enumerate(P.STAGES):
        rows = stage(spark, docs, where)
        assert n == 4 or rows.columns == list(P.COLUMNS), name
        assert stage(spark, cases.none(spark), where).count() == 0
    rows = P.run(spark, where).collect()
    assert {r.doc_id for r in rows} == {1, 3, 7, None}  # the empty ones are one group, the long ones hold the item
    assert all(r.n_tokens == len(r.ids) for r in rows)
