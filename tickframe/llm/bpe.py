"""BPE encoding and decoding as streaming transducers.

Encoding. Text passes the tokenizer file's normaliser (canonical composition,
white space, lower case) and its splitting pattern; each piece's bytes, the
last one marked as the piece's end, pass a transducer that applies the merge
list. What follows a place can change the tokens before it only through a
chain of merges in which each one takes the left part of the one before as
its right part and has a later rank; the longest such chain, measured in
symbols, plus the longest token is a sufficient lookahead of the merge list.
Tokens that end at least that far before the last symbol read are stable: no
continuation changes them. A step of the transducer reads a window of each
open piece, emits its stable tokens (all, where the piece ends) and goes on
from the first symbol that no emitted token covers. All pieces of a block of
text pass it together, each in a lane of its own, so that a lane's memory is
bounded by the merge list, whatever a piece's length, and short pieces take
one step. Short pieces met before are known with their tokens. Long texts are read in blocks that end before white space.

Decoding. A state machine takes token ids block by block and gives text: either
token texts joined by spaces, as a tokenizer file without a decoder has it, or
the text behind the tokens, holding back bytes until a character is whole. Its
state is whether a text has begun, and up to three bytes.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickframe.llm import text as T
from tickframe.llm.shared import bare, fields_of

END = "</w>"
LATE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters of a long text that are read at once.
BLOCK = 1 << 19
#: Pieces of up to KEY bytes are kept with their tokens from block to block, LIMIT of them; all others are encoded in each block anew.
KEY, LIMIT = 15, 1 << 17
#: The parts of a tokenizer file that this encoder knows; files with others are refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False}
_SPACES = "\t-\r \x85\xa0  -     　"  # Unicode's White_Space
_GAP = re.compile("[ \t\n\r]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Of each code point: white space, letter, number or other."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    spaces = regex.compile(f"[{_SPACES}]")
    out[[c for c in range(0x3001) if spaces.match(chr(c))]] = SPACE
    return out


def plain(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Merges:
    """A merge list over token ids, with its sufficient lookahead."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.rank = {}
        length = {t: len(t.removesuffix(END)) for t in vocabulary}
        for at, (a, b) in enumerate(merges):
            self.rank.setdefault((vocabulary[a], vocabulary[b]), (at, vocabulary[a + b]))
        chain: dict[str, int] = {}
        longest = 0
        for a, b in reversed(merges):
            here = length[a] + chain.get(a, 0)
            chain[b] = max(chain.get(b, 0), here)
            longest = max(longest, here)
        self.lookahead = longest + max(length.values(), default=1)
        self._hashed()

    def _hashed(self) -> None:
        """The pairs as an open hash table of arrays, for many lookups at once."""
        self.mask = (1 << max(4, 2 + len(self.rank).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, LATE, np.int32)
        self.result = np.zeros(len(self.rank), np.int32)
        order = sorted(self.rank.items(), key=lambda x: x[1])
        for at, ((a, b), (_, made)) in enumerate(order):
            key = a << 32 | b
            slot = self._slot(key)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot], self.result[at] = key, at, made

    def _slot(self, key):
        return (key ^ (key >> 27)) * 0x2545F491 >> 5 & self.mask

    def found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, LATE if it has none."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], LATE).astype(np.int32)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def apply_all(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many runs of symbols (of the given sizes, 1 at least) and their counts."""
        runs = len(size)
        own = np.repeat(np.arange(runs), size)
        late = np.full(len(symbols), LATE, np.int32)
        near = np.flatnonzero(own[:-1] == own[1:]) if len(own) else own
        late[near] = self.found(symbols[near], symbols[near + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(own):
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(late, begin)
            count = np.diff(begin, append=len(own))
            if (least == LATE).any():
                rest = np.repeat(least == LATE, count)
                done.append((own[rest], symbols[rest]))
                own, symbols, late = own[~rest], symbols[~rest], late[~rest]
                count, least = count[least != LATE], least[least != LATE]
                if not len(own):
                    break
            at = np.flatnonzero(late == np.repeat(least, count))
            at = at[np.diff(own[at], prepend=-1) != 0]  # the leftmost of each run
            symbols[at] = self.result[late[at]]
            keep = np.ones(len(own), bool)
            keep[at + 1] = False
            own, symbols, late = own[keep], symbols[keep], late[keep]
            at -= np.arange(len(at))
            late[at] = LATE
            right = at[at + 1 < len(own)]
            right = right[own[right] == own[right + 1]]
            late[right] = self.found(symbols[right], symbols[right + 1])
            left = at[at > 0]
            left = left[own[left] == own[left - 1]] - 1
            late[left] = self.found(symbols[left], symbols[left + 1])
        if not done:
            return symbols, np.zeros(runs, np.int64)
        own = np.concatenate([d[0] for d in done])
        order = np.argsort(own, kind="stable")
        return np.concatenate([d[1] for d in done])[order], np.bincount(own, minlength=runs)

    def stable(self, symbols: np.ndarray, size: np.ndarray, ends: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step over many windows (symbols of the given sizes): their stable tokens, the
        counts of these and the symbols they cover. ends: the window is the piece's last one.
        length: the symbols of each token."""
        tokens, count = self.apply_all(symbols.copy(), size)
        if ends.all():
            return tokens, count, size
        row = np.repeat(np.arange(len(size)), count)
        to = np.cumsum(length[tokens])
        to -= (np.cumsum(size) - size)[row]
        keep = ends[row] | (to <= size[row] - self.lookahead)
        used = np.where(ends, size, 0)
        np.maximum.at(used, row[keep], to[keep])
        return tokens[keep], np.bincount(row[keep], minlength=len(size)), used


class Transducer:
    """Symbols of one piece in, stable tokens out, a block at a time; holds less than 4 lookaheads of symbols."""

    def __init__(self, merges: Merges, length: np.ndarray):
        self.merges, self.length, self.held = merges, length, np.zeros(0, np.int32)

    def _step(self, ends: bool) -> np.ndarray:
        tokens, _, used = self.merges.stable(self.held, np.array([len(self.held)]), np.array([ends]), self.length)
        self.held = self.held[int(used[0]) :]
        return tokens

    def push(self, symbols: np.ndarray) -> np.ndarray:
        out, look = [], self.merges.lookahead
        for a in range(0, len(symbols), 2 * look):
            self.held = np.concatenate([self.held, symbols[a : a + 2 * look]])
            if len(self.held) >= 2 * look:
                out.append(self._step(False))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def close(self) -> np.ndarray:
        return self._step(True) if len(self.held) else self.held


def lanes(merges: Merges, symbols: np.ndarray, size: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many pieces (runs of symbols of the given sizes) and their counts: all pass the transducer together."""
    window = 4 * merges.lookahead
    base, done = np.cumsum(size) - size, np.zeros(len(size), np.int64)
    lane = np.arange(len(size))
    owners, emitted = [], []
    while len(lane):
        width = np.minimum(size[lane] - done[lane], window)
        at = np.repeat(base[lane] + done[lane] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        tokens, count, used = merges.stable(symbols[at], width, done[lane] + width == size[lane], length)
        owners.append(np.repeat(lane, count))
        emitted.append(tokens)
        done[lane] += used
        lane = lane[done[lane] < size[lane]]
    if len(emitted) == 1:
        return emitted[0], np.bincount(owners[0], minlength=len(size))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(emitted)[order] if emitted else np.zeros(0, np.int32)), np.bincount(owner, minlength=len(size))


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """The texts, long ones cut before white space, in lists of about so many characters; with each its text's number.

    A run without any white space is not cut.
    """
    rows, parts, have = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            gap = _GAP.search(text, at + size) if len(text) - at > size else None
            to = gap.start() if gap else len(text)
            rows.append(row)
            parts.append(text[at:to])
            have += to - at
            at = to
            if have >= size:
                yield rows, parts
                rows, parts, have = [], [], 0
            if not gap:
                break
    if rows:
        yield rows, parts


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts in one buffer, their sizes and places."""
    size = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), size, np.cumsum(size) - size


def _words(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each piece: the bytes and size of one of up to KEY bytes, zeros for a longer one."""
    at = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(at) - 7, "<u8", at, strides=(1,))
    full = np.uint64(2**64 - 1)
    head, rest = np.minimum(size, 8).astype(np.uint64), np.maximum(size - 8, 0)
    out = np.zeros((2, len(size)), np.uint64)
    out[0] = eight[begin] & (full >> (np.uint64(64) - np.uint64(8) * head))
    out[1] = size.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero((rest > 0) & (size <= KEY))
    out[1, more] |= eight[begin[more] + 8] & (full >> (np.uint64(64) - np.uint64(8) * rest[more].astype(np.uint64)))
    out[:, size > KEY] = 0
    return out


class Known:
    """Tokens of pieces met before, up to LIMIT of them, by their words; an open hash table of arrays."""

    def __init__(self):
        self.words, self.slots = np.zeros((2, 0), np.uint64), np.full(4 * LIMIT, -1, np.int32)
        self.tokens, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _slot(self, words: np.ndarray) -> np.ndarray:
        mixed = (words[0] ^ (words[1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (mixed >> np.uint64(40)).astype(np.int64) & (len(self.slots) - 1)

    def found(self, words: np.ndarray) -> np.ndarray:
        """Index of each piece, -1 if it is not known."""
        out = np.full(words.shape[1], -1, np.int64)
        if not len(self.count):
            return out
        slot, open_ = self._slot(words), np.arange(len(out))
        own = words
        while len(open_):
            seen = self.slots[slot]
            hit = (seen >= 0) & (self.words[0, seen] == own[0]) & (self.words[1, seen] == own[1])
            out[open_[hit]] = seen[hit]
            on = np.flatnonzero(~hit & (seen >= 0))
            slot, open_, own = (slot[on] + 1) & (len(self.slots) - 1), open_[on], own[:, on]
        return out

    def add(self, words: np.ndarray, fit: np.ndarray, tokens: np.ndarray, count: np.ndarray) -> None:
        """Those of the pieces that fit, which are not known yet, while there is room."""
        keep = np.flatnonzero(fit)[: LIMIT - len(self.count)]
        if not len(keep):
            return
        kept = np.zeros(len(count), bool)
        kept[keep] = True
        at, have = np.arange(len(self.count), len(self.count) + len(keep)), words[:, keep]
        self.words = np.concatenate([self.words, have], axis=1)
        self.tokens, self.count = np.concatenate([self.tokens, tokens[np.repeat(kept, count)]]), np.concatenate([self.count, count[keep]])
        slot = self._slot(have)
        while len(at):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = at[free]
            left = self.slots[slot] != at
            slot, at = (slot[left] + 1) & (len(self.slots) - 1), at[left]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        known = {"normalizer": NORMALIZER, "decoder": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": SPLITTER}}
        for part, want in known.items():
            if spec.get(part) != want:
                raise ValueError(f"{path}: {part} {spec.get(part)} is not handled")
        if any(model.get(k) != v for k, v in MODEL.items()) or model.get("ignore_merges"):
            raise ValueError(f"{path}: model options are not handled")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(self.vocabulary, merges)
        letters = byte_letters()
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        self.symbols = np.array([len(self.token.get(i, "").removesuffix(END)) for i in range(max(self.token) + 1)])
        self.piece = regex.compile(SPLITTER[0]["pattern"]["Regex"].replace(r"\s", _SPACES))
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known = Known()
        self.inner = np.array([self.vocabulary[c] for c in letters], np.int32)
        self.last = np.array([self.vocabulary[c + END] for c in letters], np.int32)
        names = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        special = set(self.special.values())
        behind = [n.encode() if i in special else b"".join(byte.get(c, b"") for c in n.removesuffix(END)) + b" " * n.endswith(END) for i, n in enumerate(names)]
        self.shown = {True: _table([(" " + n).encode() for n in names]), False: _table(behind)}

    def piece_ids(self, piece: str) -> list[int]:
        data = np.frombuffer(piece.encode(), np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        return lanes(self.merges, symbols, np.array([len(symbols)]), self.symbols)[0].tolist()

    def text_ids(self, text: str) -> list[int]:
        """Ids of one text, which may hold the special tokens' own texts."""
        out: list[int] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece in self.piece.findall(plain(part)):
                    out += self.piece_ids(piece)
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the normalised texts, each with a line end; byte
        bounds of their pieces; and the index of each text's first piece."""
        whole = "\n".join([*texts, ""])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = kinds()[points]
        before = np.concatenate([[SPACE], kind[:-1]])
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        padded = np.concatenate([points, [10, 10]])
        mark = np.flatnonzero((points == ord("'")) & (before != OTHER))
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((mark[short], 2), (mark[long], 3)):
            for inside in range(1, size):
                start[at + inside] = False
            start[(at + size)[kind[at + size] != SPACE]] = True
        width = np.ones(len(points), np.uint8)
        for more in (0x80, 0x800, 0x10000):
            width += points >= more
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        first = np.flatnonzero(start)
        stop = np.flatnonzero(np.append(start[1:] | (kind[1:] == SPACE), True) & (kind != SPACE))
        lines = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return np.frombuffer(whole.encode(), np.uint8), place[first], place[stop + 1], np.searchsorted(first, lines)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        marked = {i: self.text_ids(t) for i, t in enumerate(texts) if self.marks.search(t)}
        data, begin, end, first = self.split(["" if i in marked else plain(t) for i, t in enumerate(texts)])
        words = _words(data, begin, end - begin)
        which = self.known.found(words)
        new = np.flatnonzero(which < 0)
        tokens, count = self.known.tokens, self.known.count
        if len(new):
            size = (end - begin)[new]
            stop = np.cumsum(size)
            data = data[np.repeat(begin[new] - stop + size, size) + np.arange(stop[-1])]
            begin = stop - size
            some, like = _different(data, begin, stop)
            size = size[some]
            bytes_at = np.repeat(begin[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            symbols = self.inner[data[bytes_at]]
            tail = np.cumsum(size) - 1
            symbols[tail] = self.last[data[bytes_at[tail]]]
            made, more = lanes(self.merges, symbols, size, self.symbols)
            which[new] = like + len(count)
            tokens, count = np.concatenate([tokens, made]), np.concatenate([count, more])
            self.known.add(words[:, new[some]], size <= KEY, made, more)
        at = np.cumsum(count) - count
        many = count[which]
        flat = tokens[np.repeat(at[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        total = np.concatenate([[0], np.cumsum(many)])[first]
        sizes = np.diff(total)
        if marked:
            parts = [np.array(marked[i], np.int32) if i in marked else flat[total[i] : total[i + 1]] for i in range(len(texts))]
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat.astype(np.int32), sizes


def _different(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different piece, and for each piece the number of its like; hashes group them, bytes decide."""
    _, some, which = np.unique(T.span_hashes(T._BYTE[data], begin, end), return_index=True, return_inverse=True)
    size, like = end - begin, some[which]
    same = size == size[like]
    at = np.flatnonzero(same)
    step = np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
    differs = data[np.repeat(begin[at], size[at]) + step] != data[np.repeat(begin[like[at]], size[at]) + step]
    if len(at):
        same[at[np.add.reduceat(differs, np.cumsum(size[at]) - size[at]) > 0]] = False
    odd = np.flatnonzero(~same)  # of one hash, but another piece: each stands for itself
    which[odd] = len(some) + np.arange(len(odd))
    return np.concatenate([some, odd]), which


class Decoder:
    """Ids of many texts in, their text out, a block at a time. spaced: token texts as they
    are, joined by spaces; else the text behind them, where the end of a word gives one space."""

    def __init__(self, codec: Codec, texts: int = 1, spaced: bool = True):
        self.table, self.spaced = codec.shown[spaced], spaced
        self.begun = np.zeros(texts, bool)
        self.utf8 = [] if spaced else [codecs.getincrementaldecoder("utf-8")("replace") for _ in range(texts)]

    def push(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next ids of each text, sizes of them: UTF-8 bytes of what they add, and their counts."""
        data, size, place = self.table
        width = size[ids]
        out = data[np.repeat(place[ids] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        bounds = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
        if self.spaced:
            keep, fresh = np.ones(len(out), bool), (sizes > 0) & ~self.begun
            keep[bounds[:-1][fresh]] = False  # no space before the first token
            self.begun |= sizes > 0
            return out[keep], np.diff(bounds) - fresh
        parts = [u.decode(out[a:b].tobytes()).encode() for u, a, b in zip(self.utf8, bounds, bounds[1:])]
        return np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)

    def close(self) -> list[str]:
        """What each text still holds."""
        return [u.decode(b"", True) for u in self.utf8] or [""] * len(self.begun)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids (array<int>) of each whole text and the text decoded from them.

    path is a tokenizer file that executors can read; with None it is the
    word-level file of the installed `public_tokenizers` package. A file with
    another normaliser, splitter, decoder or model options is refused by a
    ValueError. A null or empty text has no ids and decodes to an empty text;
    repeated rows have the same ids; of merges of one rank the leftmost goes
    first; a long text is read in blocks. Other columns stay, but those named
    as an output (in any case of letters) give way to it.
    """
    docs = bare(docs, ids, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        c = codec(where)
        for part in T.chunks(batches):
            n = part.num_rows
            sizes, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64)
            tokens, shown = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
            machine = Decoder(c, n)
            for rows, parts in blocks([t or "" for t in part.column("text").to_pylist()]):
                some, count = c.encode_all(parts)
                own = np.bincount(np.array(rows), count, n).astype(np.int64)
                out, width = machine.push(some, own)
                sizes, lengths = sizes + own, lengths + width
                tokens.append(some)
                shown.append(out)
            flat, data = np.concatenate(tokens), np.concatenate(shown)
            at, to = (pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32()) for x in (sizes, lengths))
            text = pa.StringArray.from_buffers(n, to.buffers()[1], pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(flat)), text], [*part.schema.names, ids, decoded])

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{ids}` array<int>, `{decoded}` string")
