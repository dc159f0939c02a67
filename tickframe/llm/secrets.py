"""Secret scans: base patterns, and a linear-chain conditional random field.

Tokens (runs of letters, digits, signs of keys, and bytes beyond ASCII) are
tagged as beginning a secret, inside one or outside. Features are a token's
shape (length, kinds of its characters, how often they change, what stands
before it), the words around it and the shape of the file (its share of
digits, whether it looks like code). The field is trained on the values that
the base patterns find in a bounded sample of the texts, and on altered copies
of their lines: the key word is masked by another word or left out, and the
value is drawn anew over other alphabets, or is a plain number, word, address
or mail name, which is no secret. So it learns shape and surroundings instead
of the patterns themselves. Viterbi then tags every text; its spans that meet
no base span are added under the kind `crf`.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import crf
from tickframe.llm import text as T
from tickframe.llm.shared import bare, fields_of, sampled

#: The base patterns, fixed values: pattern, group whose length counts, least length.
PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = [*PATTERNS, "crf"]
KEYS = ("passw", "secret", "token", "apikey", "api_key")
OUT, BEGIN, INSIDE = range(3)
BITS = 16
#: Texts to learn from, at most, chosen by the hash of doc_id and text; of texts of more bytes than LONGEST none.
SAMPLE, LONGEST = 6000, 1 << 16
#: Chains without a base span that teach, at most; taken at even distances.
OUTSIDE = 6000
#: Altered copies of each line with a base span; of one text so many base spans, its first ones, are altered, and of a
#: line so many characters on either side of the value go with it.
ALTERED, EACH, AROUND = 4, 8, 400
_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (_NUM + _UP, _NUM + _LOW + _UP, _NUM + _LOW + _UP + "+/", _NUM + _LOW + _UP + "_-", _NUM + "abcdef", _NUM + "ABCDEF")

#: Bytes of text that are tagged at once; the features take some 40 bytes for each.
CHUNK_BYTES = 1 << 20

_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b"+/_-"]] = False
_KIND = np.full(256, 3, np.int64)  # digit, capital, letter, sign, beyond ASCII
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 0, 1, 2, 4
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def base_spans(text: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, in code points, by start and kind."""
    out = []
    for kind in kinds:
        pattern, group, least = PATTERNS[kind]
        out += [(*m.span(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def base_all(texts: list[str], data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """base_spans of all texts; patterns run only where a plain search says they can match."""
    gaps = np.concatenate([[-1], np.flatnonzero(~_HEX[data]), [len(data)]])
    runs = gaps[:-1][np.diff(gaps) > PATTERNS["hex"][2]]
    hexes = set((np.searchsorted(bounds, runs + 1, "right") - 1).tolist())
    inside = np.searchsorted(bounds, runs + 1, "right") - 1
    ends = gaps[1:][np.diff(gaps) > PATTERNS["hex"][2]]
    for a, b in zip(inside.tolist(), (np.searchsorted(bounds, ends - 1, "right") - 1).tolist()):
        hexes |= set(range(a, b + 1))  # a run may pass several texts
    out = []
    for i, text in enumerate(texts):
        low = text.lower()
        kinds = [k for k, go in (("assign", any(x in low for x in KEYS)), ("access", "AKIA" in text), ("hex", i in hexes)) if go]
        out.append(base_spans(text, tuple(kinds)) if kinds else [])
    return out


def _shapes(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shape of each token as a number: exact, coarse, and the kinds of characters with the rough length alone."""
    size = w.end - w.start
    kind = _KIND[w.data]
    change = np.zeros(len(kind) + 1, np.int64)
    change[1:-1] = kind[1:] != kind[:-1]
    changes = np.concatenate([[0], np.cumsum(change)])
    parts = np.minimum(size, 40) // 4 + 16 * np.minimum(changes[w.end] - changes[np.minimum(w.start + 1, w.end)], 12)
    broad = np.minimum(size, 40) // 8 * 4 + np.minimum(changes[w.end] - changes[np.minimum(w.start + 1, w.end)], 7) // 2
    for k in range(5):
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        broad = broad * 2 + (sums[w.end] > sums[w.start])
        share = (sums[w.end] - sums[w.start]) * 4 // np.maximum(size, 1)
        parts = parts * 6 + share + ((sums[w.end] - sums[w.start]) > 0)
    before = np.where((w.start > 0) & (w.start > w.bounds[w.row]), w.data[np.maximum(w.start - 1, 0)], 0)
    quoted = np.select([(before == 34) | (before == 39), before == 61, before == 58], [1, 2, 3], 0)
    mixes = (np.minimum(size, 40) // 8 * 4 + np.minimum(changes[w.end] - changes[np.minimum(w.start + 1, w.end)], 12) // 4) * 2
    digits = np.concatenate([[0], np.cumsum(kind == 0)])
    return (parts * 4 + quoted).astype(np.uint64), (mixes + (digits[w.end] > digits[w.start])).astype(np.uint64), broad.astype(np.uint64)


def _context(w: T.Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shape of each token, and hashes for the feature templates."""
    shape, coarse, broad = _shapes(w)
    word = w.hashes(lower=True)
    n = len(word)

    def near(values: np.ndarray, step: int) -> np.ndarray:
        at = np.arange(n) + step
        fine = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(0, n - 1))
        fine &= w.row[at] == w.row[np.arange(n)] if n else fine
        return np.where(fine, values[at], np.uint64(0)) if n else values

    digits = np.concatenate([[0], np.cumsum(_KIND[w.data] == 0)])
    signs = np.concatenate([[0], np.cumsum(np.isin(w.data, np.frombuffer(b"={}();", np.uint8)))])
    length = np.maximum(np.diff(w.bounds), 1)
    file = np.minimum(np.diff(digits[w.bounds]) * 20 // length, 5) * 6 + np.minimum(np.diff(signs[w.bounds]) * 50 // length, 5)
    file = file.astype(np.uint64)[w.row]
    return shape, [shape, near(word, -1), near(word, -2), near(word, 1), near(shape, -1), near(shape, 1), shape * np.uint64(64) + file, near(word, -1) + shape * np.uint64(0x9E3779B97F4A7C15), coarse, near(word, -1) + coarse * np.uint64(0x9E3779B97F4A7C15), broad]


def _buckets(templates: list[np.ndarray]) -> np.ndarray:
    """One bucket a template for each token."""
    return np.stack([(T.mixed(v + np.uint64(0x51ED27 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int64) for i, v in enumerate(templates)], axis=1)


def _breaks(w: T.Words) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(w.data == 10)])[w.start]
    out = np.ones(len(w.start), bool)
    out[1:] = (ends[1:] != ends[:-1]) | (w.row[1:] != w.row[:-1])
    return out


def _places(text: str) -> np.ndarray | None:
    """Byte place of each code point of text and of its end; None if they are the same."""
    if text.isascii():
        return None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])


def _silver(w: T.Words, texts: list[str], spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of the tokens from the secrets' places (code points) in each text."""
    tags = np.zeros(len(w.start), np.int64)
    for i, own in enumerate(spans):
        place = _places(texts[i]) if own else None
        for a, b in own:
            if place is not None:
                a, b = place[a], place[b]
            x, y = np.searchsorted(w.end, w.bounds[i] + a, "right"), np.searchsorted(w.start, w.bounds[i] + b)
            tags[x:y] = INSIDE
            tags[x : x + 1] = BEGIN
    return tags


def _values(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Of base spans the places of the secrets themselves, without the key words."""
    out = []
    for a, _, kind in spans:
        pattern, group, _ = PATTERNS[kind]
        out.append(pattern.match(text, a).span(group))
    return out


def altered(text: str, span: tuple[int, int, str], value: tuple[int, int], rnd: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The line of a base span with another key word and another value, and where it then holds a secret."""
    low, high = text.rfind("\n", 0, value[0]) + 1, text.find("\n", value[1])
    high = len(text) if high < 0 else high
    before, after = text[low : value[0]][-AROUND:], text[value[1] : high][:AROUND]
    masked = "".join(rnd.choice(_LOW) for _ in range(rnd.randint(3, 10)))
    if span[2] == "assign":
        head = before[: len(before) - (value[0] - span[0])] if value[0] - span[0] <= len(before) else ""
        link = text[span[0] : value[0]]
        key = re.match("[A-Za-z_]+", link)
        link = link[key.end() :] if key else link
        before = head + (masked + link if rnd.random() < 0.7 else "")
    if rnd.random() < 0.6:
        size = rnd.randint(16, 48)
        alphabet = rnd.choice(ALPHABETS)
        new = "".join(rnd.choice(alphabet) for _ in range(size))
        return before + new + after, [(len(before), len(before) + size)]
    digits = "".join(rnd.choice(_NUM) for _ in range(rnd.randint(4, 20)))
    word = "".join(rnd.choice(_LOW) for _ in range(rnd.randint(4, 14)))
    new = rnd.choice([digits, word, word.upper(), word.capitalize(), f"{word}.{digits[:2]}@mail{digits[0]}.example.com", ".".join(str(rnd.randrange(256)) for _ in range(4)), f"{word}-{word[::-1]}", f"https://{word}.example/{word[:3]}/{digits[:4]}"])
    return before + new + after, []


class Tagger:
    def __init__(self, field: crf.Field, weights: np.ndarray):
        self.field, self.weights = field, weights

    def spans(self, w: T.Words) -> list[tuple[int, int, int]]:
        """(row, first byte, end byte) of the secrets that Viterbi tags.

        A chain can hold one only if some token favours a secret's state over
        the outside by more than the moves cost; others are all outside.
        """
        if not len(w.start):
            return []
        _, templates = _context(w)
        weights = self.weights.astype(np.float32)
        emission = np.zeros((len(w.start), 3), np.float32)
        buckets = _buckets(templates)
        for k in range(buckets.shape[1]):
            emission += weights[buckets[:, k]]
        first, size = crf.chains(_breaks(w), len(w.start))
        move, start = self.field.move, self.field.start
        gain = max(0.0, (move[:, 1:].max() - move[OUT, OUT]), start[BEGIN] - start[OUT], (move[1:, OUT] - move[OUT, OUT]).max())
        good = emission[:, 1:].max(1) - emission[:, OUT] + 2 * gain > 0
        some = np.add.reduceat(good, first) > 0
        first, size = first[some], size[some]
        if not len(first):
            return []
        begin = np.cumsum(size) - size
        token = np.repeat(first - begin, size) + np.arange(size.sum())
        tags = np.zeros(len(w.start), np.int8)
        tags[token] = self.field.best(emission[token].astype(np.float64), begin, size)
        heads = np.flatnonzero(tags == BEGIN)
        out = []
        for h in heads.tolist():
            last = h
            while last + 1 < len(tags) and tags[last + 1] == INSIDE and w.row[last + 1] == w.row[h]:
                last += 1
            out.append((int(w.row[h]), int(w.start[h]), int(w.end[last])))
        return out


def _lessons(texts: list[str]) -> Iterator[tuple[pa.Array, list[str], list[list[tuple[int, int]]], bool]]:
    """Parts of the texts with the places of their secrets, then altered lines; the last says which."""
    rnd = random.Random(20240501)
    lines: list[tuple[str, list[tuple[int, int]]]] = []
    for part in T.chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), size=CHUNK_BYTES):
        column, own = part.column("text"), part.column("text").to_pylist()
        data, bounds = T.buffers(column)
        spans = base_all(own, data, bounds)
        values = [_values(t, s) for t, s in zip(own, spans)]
        yield column, own, values, False
        for text, some, places in zip(own, spans, values):
            for span, value in zip(some[:EACH], places[:EACH]):
                lines += [altered(text, span, value, rnd) for _ in range(ALTERED)]
    for at in range(0, len(lines), 4000):
        own = [t for t, _ in lines[at : at + 4000]]
        yield pa.array(own, pa.string()), own, [v for _, v in lines[at : at + 4000]], True


def _trained(texts: list[str]) -> Tagger:
    """Tagger from all chains with a base span's value, altered copies of their lines and some of the other chains."""
    buckets, tags, sizes = [], [], []
    for column, own, places, made in _lessons(texts):
        w = T.words(column, _GAPS)
        if not len(w.start):
            continue
        tag = _silver(w, own, places)
        first, size, _ = crf.blocks(*crf.chains(_breaks(w), len(w.start)), crf.BLOCK)
        holds = np.add.reduceat(tag > 0, first) > 0
        rest = np.flatnonzero(~holds)
        if not made:
            rest = rest[:: max(1, len(rest) * len(texts) // (OUTSIDE * len(own)))]
        chosen = np.concatenate([np.flatnonzero(holds), rest])
        n = size[chosen]
        token = np.repeat(first[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
        _, templates = _context(w)
        buckets.append(_buckets([v[token] for v in templates]))
        tags.append(tag[token])
        sizes.append(n)
    if not sizes:
        return Tagger(crf.Field(np.zeros((3, 3)), np.array([0.0, -30.0, -30.0])), np.zeros((1 << BITS, 3)))
    bucket, size = np.concatenate(buckets), np.concatenate(sizes)
    owner = np.repeat(np.arange(len(bucket)), bucket.shape[1])
    never = ((OUT, INSIDE),)
    field, weights = crf.fit(bucket.ravel(), owner, np.concatenate(tags), np.cumsum(size) - size, size, 3, 1 << BITS, epochs=6, forbid=never)
    field.start[INSIDE] = -30.0
    return Tagger(field, weights)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """Tagger from at most `sample` rows of docs, of at most LONGEST bytes each; None if there is none.

    All base spans of these texts teach; altered lines (ALTERED copies each)
    come from the first EACH of a text, with AROUND characters on either side,
    and OUTSIDE chains without a span teach what is none.
    """
    chosen = sampled(docs.select("doc_id", "text").where(F.octet_length("text").between(1, LONGEST)), sample, "doc_id", "text")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        t = _trained(sorted(rows["text"]))
        at = np.flatnonzero(np.abs(t.weights).sum(1))
        return pd.DataFrame({"move": [t.field.move.ravel()], "start": [t.field.start], "at": [at], "w": [t.weights[at].ravel()]})

    # At most SAMPLE rows and, nearly always far under it, SAMPLE * LONGEST bytes: one task may hold them.
    fitted = chosen.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(train, "move array<double>, start array<double>, at array<long>, w array<double>").collect()
    if not fitted:
        return None
    r = fitted[0]
    weights = np.zeros((1 << BITS, 3))
    weights[np.array(r.at, np.int64)] = np.array(r.w).reshape(-1, 3)
    return Tagger(crf.Field(np.array(r.move).reshape(3, 3), np.array(r.start)), weights)


def found(texts: pa.Array, tagger: Tagger | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text in code points, by start and kind: the base spans and those the tagger adds."""
    w = T.words(texts, _GAPS)
    plain = [t or "" for t in texts.to_pylist()]
    out = base_all(plain, w.data, w.bounds)
    tagged = tagger.spans(w) if tagger else []
    if not tagged:
        return out
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
    for row, group in groupby(tagged, key=lambda x: x[0]):
        base = out[row]
        starts, ends = [s for s, *_ in base], list(accumulate((e for _, e, _ in base), max))
        new = []
        for _, a, b in group:
            low, high = (int(points[x] - points[w.bounds[row]]) for x in (a, b))
            before = bisect_left(starts, high)
            if not before or ends[before - 1] <= low:
                new.append((low, high, "crf"))
        out[row] = sorted([*base, *new], key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def scanned(docs: DataFrame, tagger: Tagger | None, name: str = "spans") -> DataFrame:
    """docs with the list of spans (kind, start, end; code points, end exclusive) of each whole text.

    Defined cases: null and empty texts have no span; without a tagger only
    base spans are given; repeated rows have the same spans; a span that both
    a base pattern and the field find is the base one; long lines are one
    chain each. Other columns stay as they are, but one named as the output
    (in any case of letters) gives way to it.
    """
    docs = bare(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # 2**BITS rows of three numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.chunks(batches, size=CHUNK_BYTES):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in own] for own in found(part.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], [*part.schema.names, name])

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{name}` array<struct<kind:string,start:int,end:int>>")
