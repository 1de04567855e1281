import random
import re
from collections import Counter

import corpus_pipeline as pipeline
from tessera.llm.common import load, written

from test_substring_dedup import without_words

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    raw = load(spark, SF, "documents")
    odd = spark.createDataFrame([(9001, "12 34", None, "x", 5), (9002, None, "en", "x", 0), (9003, "Same words here", "en", "x", 15), (9004, "Same  words here", "en", "x", 16)], raw.schema)
    docs, kept = raw.unionByName(odd), {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == raw.columns
            assert docs.count() <= before.count()
    ids = lambda n: {r["doc_id"] for r in kept[n].select("doc_id").collect()}
    every = {r["doc_id"]: r["text"] for r in raw.collect()}
    assert ids("language_id") == {*every, 9003, 9004}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    texts = {**every, 9003: "Same words here", 9004: "Same  words here"}
    groups = {}
    for d, t in texts.items():
        groups.setdefault(norm(t), []).append((-len(t), d))
    assert ids("exact_dedup") == {min(g)[1] for g in groups.values()}

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    left = sorted(ids("exact_dedup"))
    sets = {d: shingles(texts[d]) for d in left}
    root = {d: d for d in left}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(left):
        for b in left[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert ids("near_dedup") == {top(d) for d in left}
    left = sorted(ids("near_dedup"))
    want = without_words([texts[d] for d in left], 50)
    assert {r["doc_id"]: r["text"] for r in kept["substring_dedup"].collect()} == dict(zip(left, want, strict=True))
    pieces = Counter()
    for r in kept["packing"].collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == whole for (_, whole), n in pieces.items()) and {d for d, _ in pieces} == set(left)


def test_odd_rows_through_all_stages(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, "First text without a number"), (None, "Second text, also without one"), (None, "First text without a number"), (1, None), (2, ""), (3, "12 34"), (4, long), (5, long), (6, "A b c"), (6, "A b c"), (7, "A  b c"), (8, "own words")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, sha long, kept boolean, `a.b` string"
    docs = spark.createDataFrame([(d, t, "en", None, len(t or ""), "r", "i", 7, None, "x") for d, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = load(spark, str(tmp_path), "documents")
    for name, stage in pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"], r["sha"]) for r in now.collect()), key=str)
    assert left == sorted([(None, rows[0][1], 7), (None, rows[1][1], 7), (4, long, 7), (7, "A  b c", 7), (8, "own words", 7)], key=str)
    got = pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert set(total) == {None, 4, 7, 8} and all(total[r["doc_id"]] == r["doc_tokens"] for r in got if r["doc_id"] is not None)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
