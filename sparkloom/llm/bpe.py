"""Byte-level BPE encoding and decoding by a walk over a prefix-sharing trie.

A text falls at single spaces into pieces that no pre-token crosses; distinct
pieces fall into words, and the distinct words of a run form one trie.
A depth-first walk gives every node the *last token* of the encoding of its
prefix: the longest vocabulary entry that ends there and that BPE would leave
beside the last token before it; entries that end at a node are the endings of
one state, which the walk takes along.  Words that share a prefix share all that
work, and a word's encoding is read off by stepping back from token to token.

Defined cases: null encodes as the empty text; empty texts give no ids; a text
of any length is encoded whole; the special token's string in a text becomes
its id; each row is encoded by itself, so repeated rows agree and ties need no
order; an empty table gives no rows.  The functions are columns: other columns,
of any name, stay as they are.  Decoding replaces bytes that are no UTF-8 like
the library does.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.runtime import ship

#: Texts are worked on in runs of about this many characters.
RUN_CHARS = 1_000_000
#: Pieces whose ids are kept between runs; past it the store starts anew.
KEPT_PIECES = 250_000
#: Ways between states that are kept, those of the trie of tokens included.
MOST_WAYS = 3_000_000

_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)] = b
            extra += 1
    return table


class Vocabulary:
    """Token bytes, merge results and the split of every merged token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        raw = lambda s: bytes(chars[c] for c in s)
        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = dict((i, t) for t, i in self.id_of.items()) | {i: s.encode() for s, i in self.special.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for rule in spec["model"]["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            left, right = self.id_of[raw(a)], self.id_of[raw(b)]
            whole = self.id_of[raw(a + b)]
            self.merged[left, right] = whole
            self.split[whole] = (left, right)
        self.rank = {whole: i for i, whole in enumerate(self.split)}
        self.size = [0] * (max(self.bytes_of) + 1)
        #: A trie of the tokens, from state << 8 | byte to a state; :meth:`step` adds the ways on from where it ends.
        self.goto: dict[int, int] = {}
        own, parents = [-1], [(0, 0)]
        for t, i in self.id_of.items():
            state, self.size[i] = 0, len(t)
            for b in t:
                key = state << 8 | b
                state = self.goto.get(key, 0)
                if not state:
                    state = self.goto[key] = len(own)
                    own.append(-1)
                    parents.append((key, parents[key >> 8][1] + 1))
            own[state] = i
        #: The state of the longest proper ending, the longest token that ends in a state, and the next shorter one of a token.
        self.fall, self.longest, self.shorter = [0] * len(own), own, [-1] * len(self.size)
        for state in sorted(range(1, len(own)), key=lambda x: parents[x][1]):
            key = parents[state][0]
            self.fall[state] = back = self._way(self.fall[key >> 8], key & 255) if key >> 8 else 0
            if own[state] < 0:
                own[state] = own[back]
            else:
                self.shorter[own[state]] = own[back]
        #: left << 20 | right: whether BPE on the bytes of both tokens gives just these two.
        self.known_pairs: dict[int, bool] = {}

    def _way(self, state: int, byte: int) -> int:
        while state and (state << 8 | byte) not in self.goto:
            state = self.fall[state]
        return self.goto.get(state << 8 | byte, 0)

    def step(self, key: int) -> int:
        """The state that a byte leads to where the trie has no way on."""
        state = self._way(key >> 8, key & 255)
        if len(self.goto) < MOST_WAYS:
            self.goto[key] = state
        return state

    def stays(self, left: int, right: int) -> bool:
        if len(self.known_pairs) > 2_000_000:
            self.known_pairs.clear()
        verdict = self.known_pairs[left << 20 | right] = self._undo(left, right)
        return verdict

    def _undo(self, left: int, right: int) -> bool:
        # Undo the later of both sides' merges again and again.  A merge across
        # the border that would have come before the last one undone refutes it;
        # of equal merges BPE does the leftmost first.
        limit = len(self.rank)
        while True:
            across = self.merged.get((left, right))
            if across is not None and self.rank[across] < limit:
                return False
            made_l, made_r = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_l < 0 and made_r < 0:
                return True
            if made_l > made_r:
                limit, left = made_l, self.split[left][1]
            else:
                limit, right = made_r + 1, self.split[right][0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """The BPE ids of each of the distinct ``words``.

    Sorted words are the trie in depth-first order: a word enters it below the
    prefix it shares with the word before, whose states are still on the path.
    """
    out: list[list[int]] = [[] for _ in words]
    deepest = max(map(len, words), default=0)
    last, start, states = [0] * (deepest + 1), [0] * (deepest + 1), [0] * (deepest + 1)  # the last token at a depth, where it begins, what ends there
    goto, step, longest, shorter, size = vocab.goto.get, vocab.step, vocab.longest, vocab.shorter, vocab.size
    pairs, stays = vocab.known_pairs.get, vocab.stays
    before = b""
    for number in sorted(range(len(words)), key=words.__getitem__):
        word = words[number]
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        state = states[shared]
        for depth in range(shared + 1, len(word) + 1):
            key = state << 8 | word[depth - 1]
            state = goto(key)
            if state is None:
                state = step(key)
            states[depth] = state
            token = longest[state]
            while at := depth - size[token]:
                fits = pairs(last[at] << 20 | token)
                if fits is None:
                    fits = stays(last[at], token)
                if fits:
                    break
                token = shorter[token]
            last[depth], start[depth] = token, at
        ids, at = out[number], len(word)
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        before = word
    return out


class PieceEncoder:
    """Encodes texts piece by piece; subclasses encode a list of short strings."""

    def __init__(self, special: tuple[str, ...]):
        self.special = special
        self.inner: dict[str, bytes] = {}
        self.outer: dict[str, bytes] = {}

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _odd(self, piece: str) -> bool:
        # A pre-token may cross the space before such a piece.
        return not piece or piece[0].isspace() or piece.startswith(self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") for t in texts]
        heads = {p[0] for p in split}
        pieces: set[str] = set()
        for p in split:
            pieces.update(p)
        if len(self.inner) + len(self.outer) > KEPT_PIECES:
            self.inner, self.outer = {}, {}
        new = [p for p in pieces - self.inner.keys() if not self._odd(p)]
        self.inner.update(zip(new, self.encode_strings([" " + p for p in new]), strict=True))
        new = list(heads - self.outer.keys())
        self.outer.update(zip(new, self.encode_strings(new), strict=True))
        out = []
        for text, p in zip(texts, split, strict=True):
            try:
                out.append(self.outer[p[0]] + b"".join([self.inner[x] for x in p[1:]]))
            except KeyError:
                out.append(self.encode_strings([text])[0])
        return out


class TrieEncoder(PieceEncoder):
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        super().__init__(tuple(self.vocab.special))
        self._words = regex.compile(_PRETOKENS)
        self._marks = re.compile("|".join(map(re.escape, self.vocab.special)) or r"(?!)")
        self._plain = re.compile(r"[\x00-ɏ]*")
        self._path, self._library = path, None
        self.known: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or self._plain.fullmatch(text):
            return self._words.findall(text)
        if self._library is None:  # its Unicode tables may differ from regex's
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        cut: list[list[str]] = []
        mixed: dict[int, list[str | int]] = {}  # strings that hold a special token
        words, plain, marked = self._words.findall, self._plain.fullmatch, self._marks.search
        for i, s in enumerate(strings):
            if s.isascii() and (s.isalpha() or s[:1] == " " and s[1:].isalpha()):
                cut.append([s])
                continue
            if marked(s) is None:
                cut.append(words(s) if s.isascii() or plain(s) else self.pretokens(s))
                continue
            parts: list[str | int] = []
            at = 0
            for m in self._marks.finditer(s):
                parts += self.pretokens(s[at : m.start()])
                parts.append(self.vocab.special[m[0]])
                at = m.end()
            mixed[i] = parts + self.pretokens(s[at:])
            cut.append([w for w in mixed[i] if isinstance(w, str)])
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        ids = encode_words([w.encode() for w in new], self.vocab)
        self.known.update((w, array("I", x).tobytes()) for w, x in zip(new, ids, strict=True))
        known = self.known
        out = [known[parts[0]] if len(parts) == 1 else b"".join([known[w] for w in parts]) for parts in cut]
        for i, parts in mixed.items():
            out[i] = b"".join([known[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in parts])
        return out


class LibraryEncoder(PieceEncoder):
    """The same pieces through the tokenizers library itself."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        super().__init__(tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values()))

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(strings, add_special_tokens=False) if strings else []
        return [array("I", e.ids).tobytes() for e in found]


def runs(texts: pa.Array | list[str], most: int = RUN_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters; null becomes empty."""
    run, n = [], 0
    for t in texts:
        t = (t.as_py() if isinstance(t, pa.Scalar) else t) or ""
        run.append(t)
        n += len(t) + 1
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def id_lists(encoded: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(encoded), "<i4")
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(text: Column, path: str) -> Column:
    """``array<int>`` of token ids."""
    ship()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = TrieEncoder(path)
        for batch in batches:
            for run in runs(batch):
                yield id_lists(encoder.encode(run))

    return ids(text)


def _texts(ids: pa.ListArray, table: list[bytes]) -> pa.Array:
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
    return pa.array((b"".join([table[i] for i in flat[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)), pa.string())


def token_table(path: str) -> list[bytes]:
    bytes_of = vocabulary(path).bytes_of
    return [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; special tokens are kept."""
    ship()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = token_table(path)
        for batch in batches:
            yield _texts(batch, table)

    return texts(ids)


def encode_and_decode(text: Column, path: str) -> Column:
    """Struct (ids, decoded) in one pass through Python: the text of the ids is made from the ids alone."""
    ship()

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, table = TrieEncoder(path), token_table(path)
        for batch in batches:
            for run in runs(batch):  # a run goes out before the next one is encoded
                ids = id_lists(encoder.encode(run))
                yield pa.StructArray.from_arrays([ids, _texts(ids, table)], names=["ids", "decoded"])

    return both(text)
