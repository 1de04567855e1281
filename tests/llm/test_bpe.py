import json
import random
import struct
from array import array
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, bpe_automaton
from tessera.llm.bpe_automaton import Automaton, automaton, default_path

TEXTS = [
    "Hello, world's   best\n\tthing'll do it!!", "", None, " \n", "ÉCOLE été ΣΑΣ straße İ", "<|endoftext|>a <|startoftext|>", "a" * 3000, "#" * 2001, "日本語 テスト １２３ ½ x²",
    "aaaa bbbb abababab", "don't 're 's'd", "é́   x\x0by", "hahaha" * 200, "The the THE", "The the THE", "\U0001f600\U0001f3fd ok", "\x1c\x1d a\x1eb",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_and_texts_match_the_library(library):
    own = automaton(default_path())
    rng = random.Random(5)
    letters = "aabbeiou stnhé'’!!..ßΣςİ日本  \t\n12"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]:
        want = ids(library, text)
        got = own.encode(text)
        assert got == struct.pack(f"<{len(want)}I", *want), text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_digests(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    for r in bpe.digests(docs).collect():
        want = ids(library, TEXTS[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode(spark, library):
    docs = spark.createDataFrame([(1, "Some words here"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {1: ids(library, "Some words here"), 2: []}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == {1: "some</w> words</w> here</w>", 2: ""}


def test_empty(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_scalar_value_matches_the_library(library):
    own = automaton(default_path())
    scalars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}x {c}" for c in scalars[at : at + 128]) for at in range(0, len(scalars), 128)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == struct.pack(f"<{len(want.ids)}I", *want.ids), hex(ord(text[0]))


def greedy(word, merges):
    """Tokens of a word by applying the merges one after the other."""
    parts = list(word)
    for u, v in merges:
        out = []
        for p in parts:
            if out and out[-1] == u and p == v:
                out[-1] = u + v
            else:
                out.append(p)
        parts = out
    return parts


def test_automata_of_random_merges(tmp_path):
    """Compiled automata accept what the merges make, also where a merge can never happen or runs overlap."""
    rng = random.Random(11)
    for turn in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 12)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        spec = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [f"{u} {v}" for u, v in merges], "end_of_word_suffix": ""}, "added_tokens": []}
        path = tmp_path / f"{turn}.json"
        path.write_text(json.dumps(spec))
        own = Automaton(str(path))
        for _ in range(200):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [own.label[i] for i in own.word(word)] == greedy(word, merges), (word, merges)


def test_texts_encoded_together_equal_single_ones(library, monkeypatch):
    own = automaton(default_path())
    rng = random.Random(8)
    texts = [*TEXTS, *["".join(rng.choice("aelrstmvdx''''!<|²1 \n\x00\x85\xa0éßİſ日") for _ in range(rng.randint(0, 30))) for _ in range(3000)]]
    texts += ["".join(f"{chr(c)}'ll{chr(c)}'{chr(c)} {chr(c)}" for c in range(at, at + 16)) for at in range(0, 0x260, 16)]
    want = [ids(library, t) for t in texts]
    for together in (1, 700, 1 << 22):
        monkeypatch.setattr(bpe_automaton, "_TOGETHER", together)
        assert list(own.encode_all(texts)) == [struct.pack(f"<{len(x)}I", *x) for x in want]
    for none in ([], [None], ["", " "], ["日"]):
        assert list(own.encode_all(none)) == [own.encode(t) for t in none]


def test_words_of_texts_encoded_together_are_looked_up_once(monkeypatch):
    own, asked = automaton(default_path()), []
    memo = type("Memo", (dict,), {"__getitem__": lambda self, w: asked.append(w) or array("I", own.word(w)).tobytes()})()
    monkeypatch.setattr(own, "memo", memo)
    got = list(own.encode_all(["The tree, the house", "the tree été"] * 500))
    assert len(got) == 1000 and sorted(asked) == [",", "house", "the", "tree", "été"]
