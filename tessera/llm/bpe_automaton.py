"""BPE by a tokenization automaton.

The merges are compiled, one after the other, into a deterministic automaton over tokens whose accepted sequences are
exactly the correct tokenizations.  It begins with one state, from which each base symbol leads back.  The gadget of a
merge (u, v) -> w, with rank r, does three things:

* each state with an arc u, after which v may follow, gets an arc w; so w's arc exists where u's did at rank r;
* w leads where v led at rank r, so w's state starts as a snapshot of v's;
* the state after u loses its arc v (and, if u = v, its arc w, since runs are merged from the left).

So each gadget makes one new version of u's state and one of v's arc, and both kinds of versions form trees: a token's
state (arc) continues the version that its right (left) part had when the token was made.  Deletion r holds between
all that continues its state version and all that continues its arc version.  Tokens with the same last version share a
state, so a vocabulary of 49,000 tokens has some 11,600 states and 13,800 kinds of arcs.  With the arcs in the order of
a walk over their tree a deletion is an interval of arcs, and each state's row of the transition table is its parent's
row less one interval; the table is one bit for each state and kind of arc (20 MB), complete when compilation ends.

A pre-split word is read once from left to right.  Each of its prefixes has one accepted path, which ends in one token.
A matcher of the arcs' labels (Aho-Corasick) gives the tokens that end at a symbol; that one is right whose arc the table
gives the state before it, which is that of the token that ends the shorter prefix.  Decoding emits the arcs' labels.

Words repeat, so each process keeps a bounded memo from word to encoded bytes, in two generations: when the younger
is full it becomes the older one, and words still in use come back from there.  Latin texts can be encoded many at a time
(``encode_all``): arrays split them, and each of their words is looked up once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, cached_property, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tessera.llm.common import claim

END = "\x00"
#: Words by the vocabulary's pattern.  Its contractions come before other marks; letters can come first, as no other
#: alternative starts with one.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Unicode white space: fixed values.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = re.compile("[^\x00-\u024f]")
MEMO_WORDS, MEMO_CHARS = 350_000, 40  # words in each of the memo's two generations; longest word kept
_LATIN, _TOGETHER = 0x250, 1 << 22  # the limit of _WIDE; characters that are encoded at a time
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@cache
def splitter(limit: int) -> re.Pattern:
    """The words of texts whose characters lie under limit; letters and numbers as Python's Unicode tables have them."""
    kinds = {"L": [], "N": []}
    for i in range(limit):
        own = kinds.get(unicodedata.category(chr(i))[0])
        if own is not None:
            if own and own[-1][1] == i - 1:
                own[-1][1] = i
            else:
                own.append([i, i])
    letters, numbers = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in kinds[k]) for k in "LN")
    return re.compile(f"[{letters}]+|{_CONTRACTIONS}|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")


@cache
def _kinds() -> np.ndarray:
    """The kind of each Latin character, as splitter(_LATIN) has them."""
    spaces = re.compile(f"[{_SPACES}]")
    kinds = {"L": _LETTER, "N": _NUMBER}
    return np.array([_SPACE if spaces.match(chr(i)) else kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(_LATIN)], np.uint8)


def _starts(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where splitter(_LATIN) begins a word; each word goes on to the next beginning or white space."""
    start = np.empty(len(chars), bool)
    start[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start |= kinds == _NUMBER
    start &= kinds != _SPACE
    marks = np.flatnonzero((chars == ord("'")) & start)
    after = np.concatenate([chars, np.zeros(3, chars.dtype)])
    for tail in _CONTRACTIONS.replace("'", "").split("|"):
        here = marks
        for k, c in enumerate(tail, 1):
            here = here[after[here + k] == ord(c)]
        start[here + 1] = False
        end = here + 1 + len(tail)
        end = end[end < len(chars)]
        start[end[kinds[end] == _LETTER]] = True
    return start


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level tokenizers define it."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Encoded bytes by word, in two generations; the older one is in ``older``."""

    def __init__(self, own: Automaton) -> None:
        super().__init__()
        self.own, self.older = own, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = array("I", self.own.word(word)).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Automaton:
    def __init__(self, path: str) -> None:
        self.file = path
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = END if suffix else ""
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        self.label = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t for t, i in self.special.items()}
        self.token = {inner(t): i for t, i in vocab.items() if t not in self.special}
        self.length = array("i", [0]) * (max(self.label) + 1)
        for t, i in self.token.items():
            self.length[i] = len(t.rstrip(END))
        merges = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self._compile([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
        self._match()
        self.symbols = dict(enumerate(byte_symbols()))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = _Memo(self)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """Gadget after gadget, then the transition table: ``state`` and ``arc`` by token, ``rows`` by state."""
        n = len(self.length)
        states, arcs = [-1], [-1]  # the version that each version continues
        state, arc = [0] * n, [0] * n  # each token's latest version
        results = {w for _, _, w in merges}
        self.made = set(self.token.values()) - results
        for u, v, w in merges:
            possible = u in self.made and v in self.made and not _meet(states, state[u], arcs, arc[v])
            if possible and w in self.made:
                raise ValueError(f"token {w} is made by two merges")
            states.append(state[u])
            arcs.append(arc[v])
            new = len(states) - 1
            if possible:
                self.made.add(w)
                state[w], arc[w] = state[v], new if u == v else arc[u]
            state[u] = arc[v] = new
        # arcs' versions in the order of a walk over their tree: what continues a version is an interval
        used = sorted({arc[t] for t in self.made})
        below: list[list[int]] = [[] for _ in arcs]
        for i in range(len(arcs) - 1, 0, -1):
            below[arcs[i]].append(i)
        kinds, column, upto, now, todo = set(used), {}, [0] * len(arcs), 0, [0]
        first = [0] * len(arcs)
        while todo:
            i = todo.pop()
            if i < 0:
                upto[~i] = now
                continue
            first[i] = now
            if i in kinds:
                column[i] = now
                now += 1
            todo.append(~i)
            todo += below[i]
        self.arc = array("i", [column.get(arc[t], 0) for t in range(n)])
        # states' rows, parents first: the parent's row less the interval of the deletion
        after: list[list[int]] = [[] for _ in states]
        for i in range(len(states) - 1, 0, -1):
            after[states[i]].append(i)
        wanted = {state[t] for t in self.made}
        rows: dict[int, bytes] = {}
        walk: list[tuple[int, np.ndarray]] = [(0, np.ones(now, bool))]
        while walk:
            i, row = walk.pop()
            if i:
                if upto[i] > first[i]:
                    row = row.copy()
                    row[first[i] : upto[i]] = False
            if i in wanted or not i:
                rows[i] = np.packbits(row, bitorder="little").tobytes()
            walk += [(k, row) for k in after[i]]
        self.rows = [rows.get(state[t], rows[0]) for t in range(n)]  # rows of tokens that share a state are one object
        self.start = rows[0]
        self.none = bytes(len(self.start))

    def _match(self) -> None:
        """Aho-Corasick over the arcs' labels: ``step`` by node and symbol, ``less`` leads to the longest shorter suffix.

        ``ending`` has, for each node, the tokens that end there, longest first: token, symbols, byte and bit in a row.
        """
        self.step: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int, int, int]] = {}
        for t, i in self.token.items():
            if i in self.made:
                node = 0
                for c in t:
                    if (below := self.step[node].get(c)) is None:
                        below = self.step[node][c] = len(self.step)
                        self.step.append({})
                    node = below
                own[node] = (i, len(t), self.arc[i] >> 3, 1 << (self.arc[i] & 7))
        self.less, self.ending = [0] * len(self.step), [()] * len(self.step)
        line = [0]
        for node in line:  # by length, so that shorter suffixes are ready
            for c, below in self.step[node].items():
                if node:
                    at = self.less[node]
                    while at and c not in self.step[at]:
                        at = self.less[at]
                    self.less[below] = self.step[at].get(c, 0)
                rest = self.ending[self.less[below]]
                self.ending[below] = (own[below], *rest) if below in own else rest
                line.append(below)

    @cached_property
    def library(self) -> Tokenizer:
        """Normalises texts that aren't Latin, and splits those with characters that Python's Unicode tables don't know.

        The library's tables are of other Unicode versions than Python's, older ones and newer ones.
        """
        return Tokenizer.from_file(self.file)

    def follows(self, token: int, t: int) -> bool:
        """Whether the state after ``token`` has an arc ``t``."""
        a = self.arc[t]
        return bool(self.rows[token][a >> 3] >> (a & 7) & 1)

    def word(self, word: str) -> list[int]:
        """The ids on the accepted path of a pre-split word."""
        return self.path(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols))

    def path(self, s: str) -> list[int]:
        """The same of a word's byte symbols."""
        at, step, less, ending, rows = len(s), self.step, self.less, self.ending, self.rows
        last, passed, node = [-1], [self.start], 0  # the token that ends each prefix, and the row after it
        for n, c in enumerate(s + self.end, 1):
            while (below := step[node].get(c)) is None and node:
                node = less[node]
            node = below or 0
            for token, size, byte, bit in ending[node]:
                if passed[n - size][byte] & bit:
                    last.append(token)
                    passed.append(rows[token])
                    break
            else:
                last.append(-1)
                passed.append(self.none)
        if last[-1] < 0:
            raise ValueError(f"no path for {s[:50]!r}")
        path, length = [last[-1]], self.length
        at -= length[last[-1]]
        while at:
            path.append(last[at])
            at -= length[last[at]]
        return path[::-1]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut and "<|" in text and self.cut.search(text):
            parts = self.cut.split(text)
            return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.encode(p) for p in parts)
        if _WIDE.search(text):
            text = self.library.normalizer.normalize_str(text)
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return b"".join([array("I", self.path(w)).tobytes() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])
        else:
            text = prepared(text)
        words = splitter(0x110000 if _WIDE.search(text) else _LATIN).findall(text)
        return b"".join(map(self.memo.__getitem__, words))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode() of each text, in order."""
        ready: list[str | bytes] = []  # Latin text to be split, or ids
        size = 0
        for text in texts:
            plain = text or ""
            if plain and not (self.cut and "<|" in plain and self.cut.search(plain)) and (plain.isascii() or not _WIDE.search(plain)):
                plain = prepared(plain)
                ready.append(plain if plain.isascii() or not _WIDE.search(plain) else self.encode(text))
            else:
                ready.append(self.encode(text))
            size += len(plain)
            if size >= _TOGETHER:
                yield from self._together(ready)
                ready, size = [], 0
        yield from self._together(ready)

    def _together(self, ready: list[str | bytes]) -> Iterator[bytes]:
        latin = [t for t in ready if isinstance(t, str)]
        joined = "\n".join(latin)
        chars = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        kinds = _kinds()[chars]
        start = _starts(chars, kinds)
        ends = np.cumsum([len(t) + 1 for t in latin], dtype=np.int64)
        ends = np.searchsorted(np.flatnonzero(start), ends)  # in words
        black = kinds != _SPACE
        chars = chars[black]
        at = np.append(np.flatnonzero(start[black]), len(chars)) * chars.itemsize
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(chars)]).dictionary_encode()
        # each word of the dictionary once, and its ids wherever it stands
        at = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1] // chars.itemsize
        every = bytes(words.dictionary.buffers()[2] or b"").decode("utf-16-le")
        ids = pa.array([self.memo[every[a:z]] for a, z in pairwise(at.tolist())], pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data, places = memoryview(ids.buffers()[2] or b""), iter(pairwise([0, *at[ends].tolist()]))
        for t in ready:
            if isinstance(t, bytes):
                yield t
            else:
                a, z = next(places)
                yield bytes(data[a:z])

    def decode(self, ids: bytes) -> str:
        label = self.label
        return " ".join([label[i] for i in memoryview(ids).cast("I")])


def _meet(states: list[int], s: int, arcs: list[int], a: int) -> bool:
    """Whether a deletion lies on both versions' ways to their roots (numbers fall on the way)."""
    while s != a:
        if s > a:
            s = states[s]
        else:
            a = arcs[a]
    return s > 0


def prepared(text: str) -> str:
    """NFC and lower case of Latin text.  White space only separates words, so it may stay as it is."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


@lru_cache(maxsize=2)
def _compiled(path: str) -> Automaton:
    return Automaton(path)


def automaton(path: str) -> Automaton:
    """One automaton per process and vocabulary."""
    own = _compiled(path)
    claim("bpe", own.memo.forget)
    return own


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
