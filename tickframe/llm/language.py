"""Language identification by a linear-chain conditional random field.

Each word of a text gets a language: features are the word (lexicon), its
affixes of one to four bytes and its byte 3-grams, all hashed; transitions
are learned, and forward-backward gives each word's probabilities. A text's
language is the one with the largest mean probability over its words, which
is the score. For training, runs of words of differently labelled texts are
put in a row, so that the chains switch as code-switched text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import crf
from tickframe.llm import text as T
from tickframe.llm.shared import bare, fields_of

BITS = 18
#: Labelled rows to learn from, at most: chosen by the hash of doc_id and text, evenly over the languages; of texts of more bytes than LONGEST none.
SAMPLE, LONGEST = 2400, 1 << 16
#: Chains that teach: each is put together from one to three runs of neighbouring words of the sample, so that languages change within.
CHAINS = 4000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def word_features(w: T.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners (indices into at) of the features of words at, sorted by owner."""
    hashes = T.Prefix(T._BYTE[T.LOWER[w.data]]).hashes
    start, end = w.start[at], w.end[at]
    kinds, owners = [hashes(start, end)], [np.arange(len(at))]
    for n in range(1, 5):
        some = np.flatnonzero(end - start >= n)
        kinds += [hashes(start[some], start[some] + n) + np.uint64(2 * n), hashes(end[some] - n, end[some]) + np.uint64(2 * n + 1)]
        owners += [some, some]
    size = np.maximum(0, end - start - 2)
    inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    kinds.append(hashes(inside, inside + 3) + np.uint64(77))
    owners.append(np.repeat(np.arange(len(at)), size))
    bucket, owner = np.concatenate(kinds), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (T.mixed(bucket[order]) >> np.uint64(64 - BITS)).astype(np.int64), owner[order]


def letters(w: T.Words) -> np.ndarray:
    """Which words hold an ASCII letter or a byte beyond ASCII."""
    kind = np.zeros(256, bool)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    found = np.concatenate([[0], np.cumsum(kind[w.data])])
    return found[w.end] > found[w.start]


def _line_breaks(w: T.Words) -> np.ndarray:
    """Which words begin a line or a document."""
    ends = np.concatenate([[0], np.cumsum(w.data == 10)])[w.start]
    out = np.ones(len(w.start), bool)
    out[1:] = (ends[1:] != ends[:-1]) | (w.row[1:] != w.row[:-1])
    return out


class Model:
    def __init__(self, languages: list[str], field: crf.Field, weights: np.ndarray):
        self.languages, self.field, self.weights = languages, field, weights.astype(np.float32)

    def word_posteriors(self, texts: pa.Array) -> tuple[T.Words, np.ndarray]:
        """Words of the texts and the probabilities of the languages of each."""
        w = T.words(texts)
        if not len(w.start):
            return w, np.zeros((0, len(self.languages)), np.float32)
        _, some, which = np.unique(w.hashes(lower=True), return_index=True, return_inverse=True)
        bucket, owner = word_features(w, some)
        scores = np.add.reduceat(self.weights[bucket], np.searchsorted(owner, np.arange(len(some))))
        scores[~letters(w)[some]] = 0
        first, size = crf.chains(_line_breaks(w), len(w.start))
        return w, self.field.posteriors(scores[which], first, size)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        w, probable = self.word_posteriors(texts)
        n = len(texts)
        counted = letters(w)
        sums = np.stack([np.bincount(w.row[counted], probable[counted, k], n) for k in range(len(self.languages))], axis=1)
        words = np.bincount(w.row[counted], minlength=n)
        best = sums.argmax(1)
        score = np.where(words > 0, sums[np.arange(n), best] / np.maximum(words, 1), 0.0)
        names = []
        for i, text in enumerate(texts):
            plain = words[i] and (w.data[w.bounds[i] : w.bounds[i + 1]] < 128).all()
            known = bool(words[i]) and (plain or _LETTER.search(text.as_py()) is not None)
            names.append(self.languages[best[i]] if known else UNKNOWN)
            if not known:
                score[i] = 0.0
        return names, np.clip(score, 0, 1)


def _trained(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    languages = sorted(set(labels))
    w = T.words(pa.array(texts, pa.string()))
    state = np.array([languages.index(x) for x in labels])[w.row]
    good = np.flatnonzero(letters(w))
    rng = np.random.default_rng(seed)
    by = [good[state[good] == k] for k in range(len(languages))]
    by = [(k, x) for k, x in enumerate(by) if len(x)]
    tokens, states, sizes = [], [], []
    for _ in range(CHAINS):
        runs = rng.integers(1, 4)
        for _ in range(runs):
            k, pool = by[rng.integers(len(by))]
            n = int(rng.integers(2, 25))
            low = int(rng.integers(max(1, len(pool) - n)))
            part = pool[low : low + n]
            tokens.append(part)
            states.append(np.full(len(part), k))
        sizes.append(sum(len(t) for t in tokens[-runs:]))
    token, size = np.concatenate(tokens), np.array(sizes)
    bucket, owner = word_features(w, token)
    field, weights = crf.fit(bucket, owner, np.concatenate(states), np.cumsum(size) - size, size, len(languages), 1 << BITS, epochs=2, batch=64, rate=0.2)
    return Model(languages, field, weights)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from the text and lang of docs that are not held out; None if no row teaches anything.

    At most `sample` rows of at most LONGEST bytes teach, evenly over the
    languages, through CHAINS chains made of their words.
    """
    turn = F.xxhash64("doc_id", "text", F.lit(11))
    known = docs.select("doc_id", "text", "lang", turn.alias("turn")).where(F.col("lang").isNotNull() & ~held_out()).where(F.trim("text") != "").where(F.octet_length("text") <= LONGEST)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    each, share = sample / len(sizes), F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * each / n))).otherwise(share)
    # Few rows pass the share; repeated rows are one, and each language gives its bound at most.
    few = known.where(F.pmod("turn", F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "turn").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("turn", F.lit(1 << 30)), "turn"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= max(1, int(each))).select("doc_id", "text", "lang")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        m = _trained(rows["text"].tolist(), rows["lang"].tolist())
        at = np.flatnonzero(np.abs(m.weights).sum(1))
        return pd.DataFrame({"languages": [m.languages], "move": [m.field.move.ravel()], "start": [m.field.start], "at": [at], "w": [m.weights[at].ravel()]})

    # At most SAMPLE rows of at most LONGEST bytes: one task may hold them.
    fitted = chosen.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(train, "languages array<string>, move array<double>, start array<double>, at array<long>, w array<float>").collect()
    if not fitted:
        return None
    r = fitted[0]
    n = len(r.languages)
    weights = np.zeros((1 << BITS, n), np.float32)
    weights[np.array(r.at, np.int64)] = np.array(r.w, np.float32).reshape(-1, n)
    return Model(list(r.languages), crf.Field(np.array(r.move).reshape(n, n), np.array(r.start)), weights)


def identified(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of each whole text and its score.

    Defined cases: `und` and 0 for a null text, a text without a letter, and
    for all texts if there is no model; of languages with equal sums the first
    by name; repeated rows have the same result; a long line is one chain.
    Other columns stay as they are, but those named as an output (in any case
    of letters) give way to it.
    """
    docs = bare(docs, lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of a number for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches):
            texts = part.column("text")
            names, scores = shared.value.predict(texts) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, lang, score])

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{lang}` string, `{score}` double")
