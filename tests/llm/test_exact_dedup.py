import hashlib
import re

from tessera.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, h string, size int, norm string"
ROWS = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, None), (2, ""), (7, " \t\r\n"), (8, "é"), (4, "é"), (None, "zz"), (6, "z z"), (6, "z z"), (10, "x" * 50_000), (11, "x " * 50_000), (12, "a b")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        group = [(-len(t or ""), i is None, i or 0, i) for (i, t), m in zip(rows, norm) if m == n]
        keep = min(group, key=lambda g: g[:3])[3]
        out.append((d, keep, len(group), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)


def test_against_brute_force(spark):
    got = op.exact_dedup(frame(spark, ROWS)).select(*op.OUT).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_collisions_are_told_apart(spark, monkeypatch):
    real = op.F.unhex
    monkeypatch.setattr(op.F, "unhex", lambda c: op.F.substring(real(c), 1, 0))  # every hash is the same
    got = op.exact_dedup(frame(spark, ROWS)).select(*op.OUT).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_keep_one_keeps_columns_and_states_a_doc_once(spark):
    docs = frame(spark, ROWS)
    got = op.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([9, 7, 8, 4, 6, 11, 12], key=str)


def test_keep_one_merges_no_different_texts(spark):
    rows = [(None, "one"), (None, "two"), (None, "three"), (None, "t wo"), (20, "first"), (20, "second"), (30, "copy of"), (31, "copy  of"), (31, "alone"), (40, "s a"), (40, "sa")]
    got = op.keep_one(frame(spark, rows)).collect()
    want = [(None, "one"), (None, "t wo"), (None, "three"), (20, "first"), (20, "second"), (31, "alone"), (31, "copy  of"), (40, "s a")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    copies = [(1, "long  copy"), (2, "longcopy"), (2, "own text")]
    assert sorted((r["doc_id"], r["text"]) for r in op.keep_one(frame(spark, copies)).collect()) == [(1, "long  copy"), (2, "own text")]


def test_keep_one_keeps_columns_named_like_its_own(spark):
    names = ["doc_id", "text", "row", "id", "sha", "times", "kept_id", "kept_sha", "kept", "group_size", "__times", "a.b", "h", "norm"]
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in ((1, "same words"), (2, "samewords"), (2, "other"), (None, "third"), (None, "third"))]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = op.keep_one(docs)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_empty(spark):
    assert op.exact_dedup(frame(spark, [])).count() == 0
    assert op.keep_one(frame(spark, [])).count() == 0
