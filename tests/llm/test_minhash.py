import random

from tessera.llm import minhash as op
from tessera.operators.components import components


def sets(rows, size):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(d, []).append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(rows, size, threshold=80):
    found = sets(rows, size)
    root = {d: d for d in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in found if d is not None]
    for d in ids:
        for e in ids:
            if e < d and any(s and 100 * len(s & t) >= threshold * len(s | t) for s in found[d] for t in found[e]):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return sorted(((d, len(s), top(d) if d is not None else None) for d, ss in found.items() for s in ss), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, id string")


def cases(seed=1, families=12, copies=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c d e f"), (7, "A b  c\nd e f"), (8, "É é x y z q"), (9, "é É x y z q"), (10, "two words"), (10, "two words")], 20
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 60, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 12))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def check(spark, rows, size):
    got = op.near_duplicates(frame(spark, rows), size).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_against_brute_force_two_words(spark):
    check(spark, cases(), 2)


def test_against_brute_force_five_words(spark):
    check(spark, cases(2), 5)


def test_blocks_give_the_same(spark, monkeypatch):
    for name, value in (("LARGE", 2), ("X_BLOCK", 2), ("Y_BLOCK", 2), ("BLOCK", 2)):
        monkeypatch.setattr(op, name, value)
    check(spark, cases(3, 5, 14), 2)


def test_keep_representatives(spark):
    docs = frame(spark, cases(4, 3, 4))
    got = op.keep_representatives(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in op.near_duplicates(docs).where("kept").collect()}


def test_columns_named_like_helpers_stay(spark):
    names = ["doc_id", "text", "row", "id", "kept", "class", "component_id", "__id", "a.b", "n", "minima"]
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in ((3, "a b c d e f g"), (5, "A b c d e f g"), (6, None), (None, "a b c d e f g"), (7, "z"), (7, "z"))]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = op.keep_representatives(docs)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_very_long_texts(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    near, far = list(base), list(base)
    for i in rng.sample(range(len(base)), 8_000):
        near[i] = "changed"
    for i in rng.sample(range(len(base)), 40_000):
        far[i] = "changed"
    check(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "short")], 2)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 300), (300, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert op.near_duplicates(frame(spark, [])).count() == 0
    assert [r["component_id"] for r in op.near_duplicates(frame(spark, [(3, None)])).collect()] == [3]
