"""Encoding and decoding with a given BPE vocabulary, as bounded-lookahead streaming transducers.

The encoder reads a word symbol by symbol. For each end of what it has read it keeps the last token of
the best tokenization up to there: the one token that ends there and forms a valid pair with the last
token where it begins (a pair is valid if the two tokens' symbols, merged alone, give the two tokens;
a sequence of tokens is a merge result exactly if all neighbours in it are valid). The tokenization of
a longer word goes through one of the ends from which a token may still reach beyond what was read.
Tokens on which the ways back from all of those agree are stable: they are emitted and forgotten. The
merge list's sufficient lookahead bounds what is not stable yet, so the encoder holds at most one
lookahead, one longest token and ``EVERY`` symbols, whatever a word's length. A transition from word
start to word end that was made once is remembered, in tables of bounded size.

A text is read in pieces of at most ``PIECE`` bytes, normalised piece by piece (cut only before
characters that do not combine with what is before them), and digests are fed as tokens become stable.

The decoder is a state machine over bytes: it holds the at most three bytes of a character that is
not complete yet and emits text as soon as it is.

The format: a JSON file of the ``tokenizers`` library with a BPE model, an end-of-word suffix, a
byte-level alphabet, NFC, white space and lower-case normalisers, a splitting pattern of contractions,
runs of letters, single numbers and runs of other characters, and no decoder, in which case tokens
are joined by single spaces.

Null and empty texts have no tokens and the digests of nothing. Equal texts, repeated rows included,
have equal results; an empty table gives no rows; further columns are not looked at. There are no ties:
the merge list orders everything.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblens.llm.common import as_bytes, pick, tidy

#: Words, and chunks of several, whose tokens are remembered; the table is emptied when it is full.
REMEMBERED = 400_000
#: Pairs of tokens whose validity is remembered.
PAIRS = 300_000
#: Bytes of a text that are decoded and normalised at a time.
PIECE = 1 << 16
#: States of the encoder that are remembered.
STATES = 200_000
#: Symbols after which the encoder looks for tokens that have become stable.
EVERY = 16

_loaded: dict[str, Tokenizer] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list over token ids, as a transducer's tables: a trie of tokens, valid pairs, and its sufficient lookahead."""

    def __init__(self, pairs: list[tuple[int, int, int]], lengths: dict[int, int], symbols: Iterable[int]):
        """pairs: (left, right, merged) by priority; lengths: symbols in each token; symbols: what words are made of."""
        self.rank = {(a, b): r for r, (a, b, _) in reversed([*enumerate(pairs)])}
        self.made = [m for _, _, m in pairs]
        self.parts = {m: (a, b) for a, b, m in reversed(pairs)}
        self.longest = max(lengths.values(), default=1)
        self.lookahead = self._lookahead(pairs, lengths)
        self.valid: dict[tuple[int | None, int], bool] = {}
        # the trie of all tokens: node * width + symbol -> node, and node -> the token that ends there
        symbols = [*symbols]
        self.width = max(symbols, default=0) + 1
        self.below: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.depth = [0]
        for t in [*symbols, *self.parts]:
            node = 0
            for k, x in enumerate(self.spell(t), 1):
                node = self.below.setdefault(node * self.width + x, len(self.below) + 1)
                if node == len(self.depth):
                    self.depth.append(k)
            self.ends[node] = t

    def spell(self, token: int) -> list[int]:
        """The symbols that a token is made of."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b = self.parts[t]
                todo += [b, a]
            else:
                out.append(t)
        return out

    @staticmethod
    def _lookahead(pairs: list[tuple[int, int, int]], lengths: dict[int, int]) -> int:
        """How far to the right of a token's end symbols can matter to it.

        Text right of a merge's pair can decide whether it happens: its right part, or what that was
        built from, may be taken by an earlier merge as that one's left part; then the earlier merge's
        own right part, and what can decide about it in turn, matter.
        """
        best: dict[int, int] = {}  # token -> farthest of the merges so far with it as left part
        inner: dict[int, int] = {}  # token -> farthest that can undo it while it is being built
        for a, b, m in pairs:
            far = max(best.get(b, 0), inner.get(b, 0))
            inner[m] = max(inner.get(m, 0), far)
            best[a] = max(best.get(a, 0), lengths[b] + far)
        return max([*best.values(), *inner.values(), 0])

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a few ids, the highest priority first, from the left."""
        rank, made, none = self.rank.get, self.made, len(self.made)
        ids = list(ids)
        while len(ids) > 1:
            found = [rank(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i : i + 2] = [made[best]]
        return ids

    def is_valid(self, a: int | None, b: int) -> bool:
        """Whether a and b stay two tokens when their symbols are merged: no merge on the way crosses their
        border. Without a: whether b's symbols give b, as the first token of a word must."""
        got = self.valid.get((a, b))
        if got is None:
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            got = self.valid[a, b] = self.merge(self.spell(b) if a is None else self.spell(a) + self.spell(b)) == ([b] if a is None else [a, b])
        return got


class Encoder:
    """The transducer over one word's symbols: ``push`` returns tokens that have become stable, ``close`` the rest.

    A state is what the next step depends on: the places in the trie of the tokens that may still go on,
    each with the last token before it, and the last token of all. Steps from a state are made once and
    remembered, in tables that are emptied between words when there are ``STATES`` of them.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.most = 0  # the most ends that were held at a time
        self.clear()
        self.start()

    def clear(self) -> None:
        # packed integers: the last token, then place in the trie and token before of each that is open; -1 for no token
        self.states: list[bytes] = [struct.pack("<i", -1)]
        self.number: dict[bytes, int] = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int, int]] = {}  # state * width + symbol -> state, last token, its length

    def start(self) -> None:
        if len(self.states) >= STATES or len(self.steps) >= 4 * STATES:
            self.clear()
        self.state = 0
        self.read = self.base = 0  # symbols read; the end up to which tokens were emitted
        self.last: list[tuple[int, int]] = []  # for each end after base: the last token, and its length

    def _step(self, state: int, symbol: int) -> tuple[int, int, int]:
        m, raw = self.m, self.states[state]
        before, *open_ = struct.unpack(f"<{len(raw) // 4}i", raw)
        still, found = [], None
        for node, left in zip([*open_[::2], 0], [*open_[1::2], before], strict=True):
            node = m.below.get(node * m.width + symbol)
            if node is not None:
                still += (node, left)
                if found is None and (token := m.ends.get(node)) is not None and m.is_valid(None if left < 0 else left, token):
                    found = (token, m.depth[node])
        new = struct.pack(f"<{len(still) + 1}i", found[0], *still)
        n = self.number.get(new)
        if n is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
        got = self.steps[state * m.width + symbol] = (n, *found)
        return got

    def push(self, symbols: Iterable[int]) -> list[int]:
        steps, width, out, last, state = self.steps, self.m.width, [], self.last, self.state
        for symbol in symbols:
            got = steps.get(state * width + symbol) or self._step(state, symbol)
            state = got[0]
            last.append(got)
            if len(last) % EVERY == 0:
                self.state, self.read = state, self.base + len(last)
                out += self._settle()
        self.state, self.read = state, self.base + len(last)
        return out

    def _way(self, end: int) -> list[int]:
        """Tokens of the way back from an end to the base, first to last."""
        out, at = [], end - self.base
        while at > 0:
            _, token, size = self.last[at - 1]
            out.append(token)
            at -= size
        return out[::-1]

    def _settle(self) -> list[int]:
        """Tokens before the last end through which the ways back from all live ends go."""
        self.most = max(self.most, len(self.last))
        depth = self.m.depth
        raw = self.states[self.state]
        live = {self.read - depth[node] for node in struct.unpack(f"<{len(raw) // 4}i", raw)[1::2]} | {self.read}
        while len(live) > 1 and min(live) > self.base:
            top = max(live)
            live.remove(top)
            live.add(top - self.last[top - self.base - 1][2])
        end = min(live)
        out = self._way(end)
        del self.last[: end - self.base]
        self.base = end
        return out

    def close(self) -> list[int]:
        """The tokens that are left; the encoder is ready for another word."""
        self.most = max(self.most, len(self.last))
        out = self._way(self.read)
        self.start()
        return out


class Decoder:
    """Bytes to text, one piece at a time; holds only an unfinished character."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, piece: bytes, last: bool = False) -> str:
        data = self.pending + piece
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                c = data[-back]
                if c >= 0xC0:  # a lead byte: is its character complete?
                    need = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                    if back < need:
                        cut = len(data) - back
                    break
                if c < 0x80:
                    break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")


#: Characters that combine with one before them though they are starters: second parts of compositions, Hangul vowels and finals.
_SECOND = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
for _c in map(chr, range(0xC0, 0x30000)):
    _d = unicodedata.decomposition(_c)
    if _d and _d[0] != "<" and " " in _d:
        _SECOND.add(chr(int(_d.split()[1], 16)))


def is_steady(c: str) -> bool:
    """Whether NFC never joins a character with what is before it."""
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _SECOND


class Tokenizer:
    """Encoder and decoder of one vocabulary file."""

    _ODD = regex.compile("[\x1c-\x1f]")
    _SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    #: Runs that may go on in the next piece, by kind.
    _RUNS = {"letters": regex.compile(r"\p{L}+", regex.V0), "others": regex.compile(r"[^\s\p{L}\p{N}]+", regex.V0)}
    #: Characters that decide whether a word is a contraction.
    _SHORT = 3

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in special.items()})
        self.special = special
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"], regex.V0)
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        size = {i: max(1, len(t.removesuffix(suffix))) for t, i in vocab.items()}
        pairs = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.merges = Merges(pairs, size, {*self.inner, *self.last})
        self.encoder = Encoder(self.merges)
        self.bytes_of = {i: t.encode() for i, t in self.tokens.items()}
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, text: str) -> Tokenizer:
        """The tokenizer of a file's content; a worker that runs several tasks builds it once."""
        if text not in _loaded:
            _loaded.clear()
            _loaded[text] = cls(json.loads(text))
        return _loaded[text]

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case of each character by itself. White space only divides words here."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _through(self, word: str) -> bytes:
        """A word's tokens, symbol by symbol through the encoder."""
        raw = word.encode("utf-8", "replace")
        ids = self.encoder.push(map(self.inner.__getitem__, raw[:-1])) + self.encoder.push((self.last[raw[-1]],)) + self.encoder.close()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, text: str, ids: bytes) -> None:
        if len(text) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids

    def _of_word(self, w: str) -> bytes:
        got = self.known.get(w)
        if got is None:
            got = self._through(w)
            self._remember(w, got)
        return got

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk without white space; remembered, as its words are, if it is not long."""
        parts = [self._of_word(w) for w in self.word.findall(chunk)]
        if len(parts) == 1:
            return parts[0]
        out = b"".join(parts)
        self._remember(chunk, out)
        return out

    def _stretches(self, text: str) -> Iterator[str | int]:
        """Normalised text between special tokens, and the ids of those."""
        if self.splitter is None or "<" not in text:
            yield self.normal(text)
            return
        for part in self.splitter.split(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield self.normal(part)

    def _pieces(self, raw: memoryview) -> Iterator[tuple[str, bool]]:
        """A text's UTF-8 bytes in pieces, and whether a word may go on from a piece into the next.

        Pieces end before white space or, where there is none in a piece, before any character that
        does not combine with the one before it and outside special tokens.
        """
        if len(raw) <= PIECE:
            yield str(raw, "utf-8", "replace"), False
            return
        decode, held = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
        hold = max(map(len, self.special), default=1)
        for at in range(0, len(raw), PIECE):
            held += decode(raw[at : at + PIECE], at + PIECE >= len(raw))
            cut = max(held.rfind(" "), held.rfind("\n"))
            open_ = cut <= 0
            if open_:
                cut = len(held) - hold
                while cut > 0 and not (is_steady(held[cut]) and "<" not in held[max(0, cut - hold) : cut]):
                    cut -= 1
            if cut > 0:
                yield held[:cut], open_
                held = held[cut:]
        yield held, False

    def _run(self, text: str, kind: str | None, more: bool) -> tuple[bytes, str, str | None]:
        """Ids of a piece whose words may go on: (ids, text not used yet, the kind of the word that is open).

        An open word's symbols have gone through the encoder, but for its last character.
        """
        out, at, size = [], 0, len(text)
        if kind:
            end = self._RUNS[kind].match(text).end()  # the character kept back is of that kind
            if end == size and more:
                out.append(self._ids(self.encoder.push(map(self.inner.__getitem__, text[:-1].encode("utf-8", "replace")))))
                return b"".join(out), text[-1], kind
            out.append(self._through(text[:end]))
            at = end
        for m in self.word.finditer(text, at):
            if more and m.start() > size - self._SHORT:
                return b"".join(out), text[m.start() :], None
            w = m[0]
            if more and m.end() == size and len(w) > 1 and not (w[0] == "'" and w[1].isalpha()):
                kind = "letters" if self._RUNS["letters"].match(w) else "others"
                out.append(self._ids(self.encoder.push(map(self.inner.__getitem__, w[:-1].encode("utf-8", "replace")))))
                return b"".join(out), w[-1], kind
            out.append(self._of_word(w))
        return b"".join(out), "", None

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str | bytes | memoryview) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, as they become stable, in parts of bounded size."""
        raw = memoryview(text.encode("utf-8", "replace") if isinstance(text, str) else text)
        known, learn = self.known.get, self._learn
        held, kind = "", None  # of a word that goes on from piece to piece
        for piece, open_ in self._pieces(raw):
            parts = [*self._stretches(piece)]
            for i, part in enumerate(parts):
                goes_on = open_ and i == len(parts) - 1
                if not (goes_on or held):
                    if isinstance(part, int):
                        yield part.to_bytes(4, "little")
                        continue
                    # Python's split also divides at the separators U+001C to U+001F, which are no white space here
                    chunks = part.split() if self._ODD.search(part) is None else self._SPACE.split(part)
                    yield b"".join([known(w) or learn(w) for w in chunks])
                elif isinstance(part, int):
                    out, held, kind = self._run(held, kind, False)
                    yield out + part.to_bytes(4, "little")
                else:
                    out, held, kind = self._run(held + part, kind, goes_on)
                    yield out
        if held:
            yield self._run(held, kind, False)[0]

    def encode(self, text: str) -> list[int]:
        raw = b"".join(self.packed(text))
        return list(memoryview(raw).cast("I"))

    def decode_bytes(self, packed: Iterable[bytes]) -> Iterator[bytes]:
        """What the tokens of each piece add to the decoded text, as bytes: one space between tokens."""
        table, first = self.bytes_of, True
        for piece in packed:
            if piece:
                out = b" ".join(map(table.__getitem__, memoryview(piece).cast("I")))
                yield out if first else b" " + out
                first = False

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, by way of the incremental decoder."""
        machine, out = Decoder(), []
        for piece in self.decode_bytes(i.to_bytes(4, "little") for i in ids):
            out.append(machine.feed(piece))
        out.append(machine.feed(b"", last=True))
        return "".join(out)

    def digests(self, raw: memoryview) -> tuple[int, str, str]:
        """Number of tokens, and digests of ids and of the decoded text, fed as tokens become stable."""
        ids, text, machine, size = hashlib.sha256(), hashlib.sha256(), Decoder(), 0

        def told() -> Iterator[bytes]:
            nonlocal size
            for part in self.packed(raw):
                ids.update(part)
                size += len(part)
                yield part

        for part in self.decode_bytes(told()):
            text.update(machine.feed(part).encode())
        text.update(machine.feed(b"", last=True).encode())
        return size // 4, ids.hexdigest(), text.hexdigest()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256 and decoded_sha256; with_ids adds the packed ids (as long as the text).

    Null counts as empty: no tokens, and the digests of nothing. One narrow pass; the vocabulary file
    is read on the driver and sent along, as its size (under 2 MB) does not depend on the data.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for b in batches:
            tokenizer = tokenizer or Tokenizer.load(spec.value)
            data, offsets = as_bytes(b.column(1))
            texts = [memoryview(data[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts, ids, decoded = zip(*map(tokenizer.digests, texts), strict=True) if texts else ((), (), ())
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([b"".join(tokenizer.packed(t)) for t in texts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        tokenizer = None
        _loaded.clear()  # a worker lives on for other stages, whose memory this would be

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    extra = ", ids binary" if with_ids else ""
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
