import random
import time
from collections import Counter

from tests.llm import cases
from tickframe.llm import lines


def pairs_in_order(a, b):
    """aligned, checked: equal lines, each used once, in order on both sides."""
    pairs = sorted(lines.aligned(a, b))
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    return pairs


def test_alignment_is_a_common_subsequence():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randrange(25))] for _ in range(2))
        pairs = pairs_in_order(a, b)
        assert bool(pairs) == bool(set(a) & set(b))
        found = Counter(a[i] for i in lines.common(a, b))
        assert found == Counter(x for x in a if x) & Counter(x for x in b if x)
    a = list(range(50))
    b = a[:20] + [99, 98] + a[25:]
    assert [x for x, _ in pairs_in_order(a, b)] == a[:20] + a[25:]


def test_alignment_of_reversed_lines_is_not_quadratic():
    a = list(range(1, 20_001))
    assert len(lines.common(a, a[::-1])) == len(a)


def made():
    rnd = random.Random(11)
    line = lambda: " ".join(rnd.choice(cases.WORDS) + str(rnd.randrange(50)) for _ in range(6))
    common = line()
    base = [[line() for _ in range(10)] for _ in range(5)]
    docs = {}
    for i in range(40):
        own = base[i % 5][:] if i % 2 else [line() for _ in range(8)]
        if i % 9 == 5:
            own = own[5:] + own[:5]
        if i % 3 == 0:
            own[4:4] = [line(), "", "\r", " \t"]
        if i % 7 == 0:
            own = own[:5] + [common + " \r"] + own[5:]
        docs[i] = "\n".join(own)
    docs[40], docs[41] = common, common
    return docs


def brute(docs):
    """Where no line comes twice in a document: a line goes if a document of a smaller number has it."""
    seen, out = set(), {}
    for d in sorted(docs):
        rows = [(x, x.strip(" \t\r")) for x in docs[d].split("\n")]
        out[d] = "\n".join(x for x, y in rows if not y or y not in seen)
        seen |= {y for _, y in rows}
    return out


def test_against_brute_force(spark):
    docs = made()
    rows = lines.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == brute(docs)
    assert next(r for r in rows if r.doc_id == 41).text == ""


def test_blank_lines_of_crlf_texts_stay(spark):
    docs = [(1, "alpha one\r\n\r\nbeta two\r"), (2, "gamma\r\n\r\ndelta\r"), (3, "x\r\n\r\nalpha one\r\n\t\r\ny")]
    rows = lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {1: docs[0][1], 2: docs[1][1], 3: "x\r\n\r\n\t\r\ny"}


def test_recall_against_the_alignment_of_all_pairs(spark):
    rnd = random.Random(21)
    docs = []
    for i in range(120):
        pool = [f"line {rnd.randrange(90)}" for _ in range(rnd.randrange(1, 25))]
        if docs and i % 3 == 0:
            other = docs[rnd.randrange(len(docs))][1].split("\n")
            at = rnd.randrange(len(other))
            pool[len(pool) // 2 : len(pool) // 2] = other[at:] + other[:at]
        docs.append((i, "\n".join(pool)))
    rows = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    split = {d: t.split("\n") for d, t in docs}
    want = sum(len({x for e in split if e < d for x, _ in lines.aligned(split[d], split[e])}) for d in split)
    gone = sum(r.n_removed for r in rows.values())
    earlier = set()
    for d in split:  # nothing goes that no earlier document has
        assert Counter(split[d]) - Counter(rows[d].text.split("\n")) <= Counter(x for x in split[d] if x in earlier)
        earlier |= set(split[d])
    assert gone >= 0.9 * want > 0


def test_every_copy_that_an_earlier_document_has_goes(spark):
    docs = [(1, "x\na"), (2, "x\np\nx\nq\nx"), (3, "x\nr\nx\ns\nx\nt\nx")]
    rows = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[2].n_removed == 1 and sorted(rows[3].text.split("\n")) == ["r", "s", "t", "x"]
    rnd = random.Random(5)
    docs = [(i, "\n".join(f"l{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 30)))) for i in range(60)]
    rows = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    most = Counter()  # of each line the most copies that an earlier document has
    for d, t in docs:
        own = Counter(t.split("\n"))
        gone = own - Counter(rows[d].text.split("\n") if rows[d].n_removed < len(t.split("\n")) else [])
        assert all(gone[x] >= min(n, most[x]) and (not gone[x] or most[x]) for x, n in own.items())
        most |= own


def test_line_held_twice_or_in_another_order_by_the_first_document(spark):
    docs = [(1, "x\nP\ny\nP\nz"), (2, "u\nP\nv"), (3, "w\nP\nt"), (4, "a\nQ\nR"), (5, "R\nb\nQ")]
    rows = lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {1: docs[0][1], 2: "u\nv", 3: "w\nt", 4: docs[3][1], 5: "b"}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, 8, 9, 10), (2, "a\nc", 7, 8, 9, 10)], "doc_id long, text string, dropped int, N_lines int, _text_hash int, `d_id` int")
    rows = lines.deduplicated(docs)
    assert rows.columns == ["doc_id", "text", "dropped", "_text_hash", "d_id", "n_lines", "n_removed"]
    assert sorted(map(tuple, rows.collect())) == [(1, "a\nb", 7, 9, 10, 2, 0), (2, "c", 7, 9, 10, 2, 1)]


def test_long_texts_are_rebuilt_in_linear_time(spark):
    text = "\n".join(f"line {i}" for i in range(32_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("line 7\n", "other\n"))], "doc_id long, text string")
    began = time.time()
    assert [r.text for r in lines.deduplicated(docs).collect() if r.doc_id == 2] == ["other"]
    assert time.time() - began < 15


def test_line_of_many_documents_among_unlike_neighbours(spark):
    docs = [(i, f"above {i}\nthe shared passage\nbelow {i}") for i in range(80)]
    rows = lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {i: t if i == 0 else f"above {i}\nbelow {i}" for i, t in docs}


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = lines.deduplicated(docs).collect()
    assert len(rows) == 9 and rows[0].asDict().keys() == {*docs.columns, "n_lines", "n_removed"}
    got = sorted((str(r.doc_id), str(r.text)[:5], r.n_lines, r.n_removed) for r in rows)
    assert got.count(("5", "", 1, 1)) == 2 and ("1", "None", 0, 0) in got and ("None", "one t", 2, 0) in got
    assert lines.deduplicated(cases.none(spark)).count() == 0
