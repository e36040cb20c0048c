"""The streaming encoder and decoder against the library, their memory, and edge tables."""

import hashlib
import random
import struct
import tracemalloc
import unicodedata

import pytest

from biblens.llm import bpe
from biblens.llm.queries import op10_bpe, vocabulary_path

ALPHABET = "abcdehinorst \t\n\x1c\x85é ßÀΣσİ0123'’-<|>!漢字かな각́각😀"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture
def mine():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.Tokenizer.load(f.read())


def samples(n: int, size: int) -> list[str]:
    r = random.Random(2)
    out = []
    for k in range(n):
        some = ALPHABET if k % 2 else "".join(c for c in ALPHABET if not c.isspace())
        s = "".join(r.choice(some) for _ in range(r.randint(0, size)))
        out.append(s[:40] + "<|endoftext|>" + s[40:] if k % 7 == 0 else s)
    return out


def test_equals_the_library(lib, mine):
    long = ["a" * 5000, "the" * 900, "abcdefghijklmnopqrstuvwxyz" * 200, "é" * 3000, "!" * 2000 + "'" * 300 + "s", "<|endoftext|>x<|startoftext|>", "", "it's we'll I'D '' 'sx"]
    for s in samples(600, 80) + long:
        ids = lib.encode(s, add_special_tokens=False).ids
        assert mine.encode(s) == ids and mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("piece", [16, 33, 64])
def test_pieces_do_not_matter(lib, mine, monkeypatch, piece):
    """Words, special tokens, characters and compositions that go on from piece to piece."""
    monkeypatch.setattr(bpe, "PIECE", piece)
    for s in samples(500, 300):
        assert mine.encode(s) == lib.encode(s, add_special_tokens=False).ids


def test_cuts_before_steady_characters():
    for c in range(0x20, 0x3400):
        if bpe.is_steady(chr(c)):
            for left in "aeoʻ가ᄀあ̂":
                assert unicodedata.normalize("NFC", left + chr(c)) == unicodedata.normalize("NFC", left) + unicodedata.normalize("NFC", chr(c))


def test_every_word_goes_through_the_encoder(mine, monkeypatch):
    mine.known.clear()
    seen = []
    push = bpe.Encoder.push
    monkeypatch.setattr(bpe.Encoder, "push", lambda self, symbols: push(self, (seen.append(s) or s for s in symbols)))
    text = "some words, some of them twice: caffeine"
    mine.encode(text)
    distinct = {"some", "words", ",", "of", "them", "twice", ":", "caffeine"}
    assert len(seen) == sum(map(len, distinct))


def test_tokens_come_before_the_word_ends(lib, mine):
    """The encoder holds at most a lookahead, a longest token and EVERY symbols, and tells stable tokens early."""
    m = mine.merges
    r = random.Random(4)
    for word in ("a" * 4000, "".join(r.choice("etaoinshrdlu") for _ in range(4000)), "thethinking" * 400):
        enc = bpe.Encoder(m)
        early = enc.push(mine.inner[b] for b in word[:-1].encode())
        ids = early + enc.push([mine.last[ord(word[-1])]]) + enc.close()
        assert ids == lib.encode(word, add_special_tokens=False).ids
        assert len(early) > 0.9 * len(ids) and 0 < enc.most <= m.lookahead + m.longest + bpe.EVERY


def test_constant_memory(mine):
    """A word of many pieces needs no more memory than one of a few."""
    peaks = []
    for size in (1 << 18, 1 << 20):
        raw = memoryview(("thequickbrownfox" * (size // 16)).encode())
        mine.digests(raw[: 1 << 17])
        tracemalloc.start()
        assert mine.digests(raw)[0] > size // 8
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] < 16 * bpe.PIECE * 4


def test_decoder_state_machine():
    m = bpe.Decoder()
    raw = "aé漢😀\udcffz".encode("utf-8", "surrogatepass")
    assert "".join([m.feed(raw[i : i + 1]) for i in range(len(raw))] + [m.feed(b"", True)]) == raw.decode("utf-8", "replace")


def test_registered_query(spark, lib, tmp_path):
    texts = ["Plain text, twice.", "Plain text, twice.", None, "", "two  pieces\n" * 9000, "x" * 70_000, "漢字" * 30_000]
    rows = [(i, t, "ids") for i, t in enumerate(texts)] + [(1, "again", "ids"), (None, "no id", None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op10_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def want(i, t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted(map(tuple, out.collect()), key=str) == sorted((want(i, t) for i, t, _ in rows), key=str)
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path()).count() == 0
    packed = bpe.encode_documents(spark.createDataFrame([(1, "abc def")], "doc_id long, text string"), vocabulary_path(), with_ids=True).first()["ids"]
    assert list(memoryview(bytes(packed)).cast("I")) == lib.encode("abc def", add_special_tokens=False).ids
