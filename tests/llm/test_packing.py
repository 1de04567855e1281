import random
import struct
from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.bpe_automaton import default_path


def test_best_multiset_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 8)))
        room = rng.randint(0, 90)
        take = packing.best_multiset(counts, room)
        assert all(n <= counts[k] for k, n in take.items())
        kinds = list(counts)
        best = max(s for n in product(*[range(counts[k] + 1) for k in kinds]) if (s := sum(a * b for a, b in zip(n, kinds))) <= room)
        assert sum(k * n for k, n in take.items()) == best


def test_pieces_are_whole_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["tree", "house", "sky", "unbelievable", "é"]) for _ in range(rng.choice([0, 1, 5, 80, 700, 6000])))) for i in range(120)]
    rows += [(None, "lost id"), (7, None), (500, "x"), (500, "x")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, offset string")
    pieces = packing.pack(docs).collect()
    lib = Tokenizer.from_file(default_path())
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    covered, sequences = Counter(), defaultdict(list)
    for p in pieces:
        covered[p["doc_id"]] += p["length"]
        assert any(len(x) == p["doc_tokens"] and crc32(struct.pack(f"<{p['length']}I", *x[p["start"] : p["start"] + p["length"]])) == p["ids_crc32"] for x in ids[p["doc_id"]])
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert covered == {d: sum(map(len, x)) for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # a power of two needs no padding
    for d in set(ids) - {7, 500}:
        spans = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == d)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
