"""Rows that every operator has to take: nulls, empty and long texts, repeats, foreign columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat sat on the mat and saw a bird that sang by the old green door near a quiet lake".split()
LONG = " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] + str(i % 211) for i in range(6000))


def odd(spark):
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, None),
        (3, "one", "en", "a", 3),
        (4, LONG, "en", "a", len(LONG)),
        (5, LONG, "en", "a", len(LONG)),
        (5, LONG, "en", "a", len(LONG)),
        (None, "one two\nthree four", "en", "a", 0),
        (6, " \t\n ", "en", "a", 4),
        (7, "Ünï çode   naïve x 日本語", "de", "b", 4),
    ]
    extra = "row_number long, place long, n long, a long, fp long, key long, component string, shard string, _part string"
    return spark.createDataFrame([r + (1, 2, 3, 4, 5, 6, "c", "s", "p") for r in rows], f"{DOCS}, {extra}")


def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(n):
    return [f"w{i}" for i in range(n)]
