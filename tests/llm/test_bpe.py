import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tickframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def codes(codec, texts, block=bpe.BLOCK):
    """Ids and decoded text of each text, as the operator makes them."""
    machine = bpe.Decoder(codec, len(texts))
    ids, shown = [[] for _ in texts], [b""] * len(texts)
    for rows, parts in bpe.blocks(texts, block):
        flat, count = codec.encode_all(parts)
        own = np.bincount(rows, count, len(texts)).astype(np.int64)
        data, width = machine.push(flat, own)
        for i, (a, b) in enumerate(zip(np.cumsum(own) - own, np.cumsum(width) - width)):
            ids[i] += flat[a : a + own[i]].tolist()
            shown[i] += data[b : b + width[i]].tobytes()
    return ids, [x.decode() for x in shown]


def differing(texts, block=bpe.BLOCK):
    codec, library = bpe.codec(PATH), Tokenizer.from_file(PATH)
    bad = []
    for text, ids, shown in zip(texts, *codes(codec, texts, block)):
        want = library.encode(text, add_special_tokens=False).ids
        if ids != want or shown != library.decode(want, skip_special_tokens=False):
            bad.append(text)
    return bad


def made():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aabeinrt") for _ in range(rnd.choice([1, 9, 400, 900, 3000]))) for _ in range(60)]
    texts += ["".join(rnd.choice(["'", "s", "re", "ll", "d", " ", "1", ".", "\n", "é", "日", "\x1c", "ΣΑΣ", "<|endoftext|>", "<|", "İ", "́"]) for _ in range(40)) for _ in range(300)]
    return texts


@pytest.mark.parametrize("block", [5, 64, bpe.BLOCK])
def test_as_the_library(block):
    assert differing(made(), block) == []


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_pieces_that_collide_modulo_powers_of_two(size):
    turn = [bin(i).count("1") % 2 for i in range(size)]
    pieces = ["".join("ab"[x ^ flip] for x in turn) for flip in (0, 1)]
    assert differing([" ".join(pieces), pieces[1]]) == []


def test_pieces_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(bpe.T, "span_hashes", lambda values, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    assert differing(["cat dog sun a 1 tree cat house", "the same words the same"]) == []


def greedy(codec, symbols):
    """The merge of lowest rank first, leftmost first, over the whole piece."""
    out = list(symbols)
    while True:
        ranks = [codec.merges.rank.get(p, (1 << 60, 0)) for p in zip(out, out[1:])]
        if not ranks or min(ranks)[0] == 1 << 60:
            return out
        at = ranks.index(min(ranks))
        out[at : at + 2] = [ranks[at][1]]


def test_stream_is_the_whole():
    codec, rnd = bpe.codec(PATH), random.Random(3)
    for _ in range(3):
        symbols = np.array([codec.inner[ord(rnd.choice("abeinrst"))] for _ in range(2500)], np.int32)
        run = bpe.Transducer(codec.merges, codec.symbols)
        out = []
        for a in range(0, len(symbols), 7):
            out += run.push(symbols[a : a + 7]).tolist()
            assert len(run.held) < 4 * codec.merges.lookahead
        out += run.close().tolist()
        assert out == greedy(codec, symbols.tolist())
        assert bpe.lanes(codec.merges, symbols, np.array([len(symbols)]), codec.symbols)[0].tolist() == out


def test_text_behind_the_tokens():
    codec = bpe.codec(PATH)
    text = "naïve 日本語 😀 cat's"
    for step in (1, 2, 50):
        machine, ids, out = bpe.Decoder(codec, 1, spaced=False), np.array(codec.text_ids(text)), b""
        for a in range(0, len(ids), step):
            data, _ = machine.push(ids[a : a + step], np.array([len(ids[a : a + step])]))
            out += data.tobytes()
        assert out.decode() + machine.close()[0] == "naïve 日本語 😀 cat 's "


def test_other_files_are_refused(tmp_path):
    for key, value in (("normalizer", {"type": "NFKC"}), ("decoder", {"type": "ByteLevel"}), ("pre_tokenizer", None)):
        spec = json.load(open(PATH, encoding="utf-8")) | {key: value}
        (tmp_path / "x.json").write_text(json.dumps(spec))
        with pytest.raises(ValueError):
            bpe.Codec(str(tmp_path / "x.json"))


def test_odd_rows(spark):
    rows = bpe.encoded(cases.odd(spark), PATH).collect()
    codec = bpe.codec(PATH)
    assert len(rows) == 9
    for r in rows:
        assert list(r.ids) == codec.text_ids(r.text or "")
        assert r.decoded == " ".join(codec.token[i] for i in r.ids)
    assert bpe.encoded(cases.none(spark), PATH).count() == 0
    assert np.array_equal(codec.encode_all([])[1], [])
    clash = spark.createDataFrame([(1, "a cat", 5, "x")], "doc_id long, text string, Ids int, decoded string")
    assert [tuple(r) for r in bpe.encoded(clash, PATH).select("text", "decoded").collect()] == [("a cat", "a</w> cat</w>")]


def test_known_pieces(monkeypatch):
    """Pieces met before have the same ids, also those that differ in a zero byte, are too long or find no room."""
    monkeypatch.setattr(bpe, "LIMIT", 64)
    codec, rnd = bpe.Codec(PATH), random.Random(3)
    signs = "abzéж漢\0'!-"
    words = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 24))) for _ in range(150)] + ["!", "!\0", "!\0\0", "a" * 15, "a" * 16, "x" * 7, "x" * 8, "x" * 9]
    first = None
    for _ in range(3):
        ids, sizes = codec.encode_all(words)
        assert np.split(ids, np.cumsum(sizes)[:-1])[3].tolist() == codec.text_ids(words[3])
        assert ids.tolist() == [i for w in words for i in codec.text_ids(w)]
        assert first is None or ids.tolist() == first
        first = ids.tolist()
    assert len(codec.known.count) == 64
    assert (codec.known.found(codec.known.words) >= 0).all()
