import hashlib
import random
import re
from collections import Counter

from tessera.llm import substring_dedup as op

W = op.BYTES.window


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + W] for b in texts for i in range(len(b) - W + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k int, did string")


def cases(seed=3, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(3000)) for _ in range(4)]
    rows = [(None, None), (1, ""), (2, "x" * 1500), (3, "ab" * 450), (4, base[0]), (4, base[0]), (5, base[0]), (None, base[1]), (6, "y" * 399), (7, "y" * 400)]
    for i in range(n):
        b = rng.choice(base)
        a = rng.randint(0, 2500)
        t = b[a : a + rng.randint(100, 900)]
        if rng.random() < 0.5:
            t += rng.choice(base)[: rng.randint(300, 420)]
        if rng.random() < 0.5:
            k = rng.randint(0, len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((100 + i, t))
    return rows


def test_against_brute_force(spark):
    rows = cases()
    assert sorted((tuple(r)[:5] for r in op.repeats(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_long_texts_cross_buffers(spark, monkeypatch):
    monkeypatch.setattr(op, "_BUFFER", 1 << 10)
    got = [list(op._segments([b"a" * 5000, b"b" * 10, b"c" * 700]))]
    seen = Counter()
    for buf, spans in got[0]:
        for a, b, doc, at in spans:
            seen[doc] += b - a - W + 1
            assert buf[a:b] == (b"a", b"b", b"c")[doc] * (b - a)
    assert seen == {0: 5000 - W + 1, 2: 700 - W + 1}


def test_ranges_cover_each_window_once():
    rng = random.Random(1)
    buf = bytes(rng.choice(b"abcd") for _ in range(5000))
    place, lo, hi = op.ranges(buf, [(0, 1200), (1200, 1500), (1500, 5000)])
    windows = [w for a, z in zip(lo, hi) for w in range(a, z + 1)]
    assert windows == [*range(0, 801), *range(1500, 4601)]
    assert all(a <= p and p + op.BYTES.digit <= a + W and z <= p for p, a, z in zip(place, lo, hi))


def test_left_text(spark):
    got = {r["doc_id"]: r for r in op.repeats(frame(spark, [(1, "é" * 100 + "x" * 500), (2, "a" + "x" * 500), (3, None)])).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["é" * 100, "a", ""]
    assert [got[i]["n_bytes"] for i in (1, 2, 3)] == [700, 501, 0]


def without_words(texts, n):
    """Brute force: texts without words that lie in a run of n words that also starts elsewhere."""
    words = [re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t) for t in texts]
    bare = [[w.strip(" \t\n\r\x0b\x0c") for w in ws] for ws in words]
    seen = Counter(tuple(ws[i : i + n]) for ws in bare for i in range(len(ws) - n + 1))
    out = []
    for t, ws, bs in zip(texts, words, bare):
        gone = {k for i in range(len(bs) - n + 1) if seen[tuple(bs[i : i + n])] > 1 for k in range(i, i + n)}
        head = t[: len(t) - len("".join(ws))]
        out.append(head + "".join(w for i, w in enumerate(ws) if i not in gone))
    return out


def test_strip(spark):
    rng = random.Random(9)
    n = op.WORDS.window
    pool = [rng.choice(["a", "bé", "ccc", "d.", "ee"]) for _ in range(4000)]
    texts = ["", " ", "x " * 49, "x " * 50, "y " * 51, "  z" * 130, "Solo text."]
    for _ in range(60):
        a, b = rng.randint(0, 3800), rng.randint(0, 3800)
        own = [f"w{rng.random()}" for _ in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(own + pool[a : a + rng.choice([30, 49, 50, 51, 90])] + own[::-1] + pool[b : b + rng.randint(0, 120)]))
    docs = spark.createDataFrame([(i, t, len(t), "x", "y") for i, t in enumerate(texts)] + [(None, None, None, "x", "y")], "doc_id long, text string, n_chars int, ranges string, row string")
    got = op.strip(docs)
    assert got.schema == docs.schema and got.count() == len(texts) + 1
    want = without_words(texts, n)
    assert any(w != t for w, t in zip(want, texts)) and any(w == t != "" for w, t in zip(want, texts))
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["text"] is None
        else:
            assert r["text"] == want[r["doc_id"]]
            assert r["n_chars"] == len(r["text"])


def test_strip_keeps_columns_named_like_its_own(spark):
    names = ["doc_id", "text", "row", "did", "th", "ranges", "lo", "hi", "a.b"]
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in ((1, f"one {shared} end"), (2, f"two {shared}"), (3, "alone"))]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = sorted(map(tuple, op.strip(docs).collect()))
    assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in rows]
    assert [r[1].split() for r in got] == [["one", "end"], ["two"], ["alone"]]


def test_strip_of_bytes(spark):
    rows = cases(4, 20)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, th string")
    want = {x[0]: x for x in brute(rows)}
    for r in op.strip(docs, op.BYTES).collect():
        if r["doc_id"] not in (None, 4) and not want[r["doc_id"]][2]:
            assert r["text"] == dict(rows)[r["doc_id"]]


def test_empty(spark):
    assert op.repeats(frame(spark, [])).count() == 0
    assert op.repeats(frame(spark, [(1, "short")])).collect()[0]["n_removed"] == 0
