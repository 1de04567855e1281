import math
import random

from pyspark.sql import functions as F

from tessera.llm import topk as op


def brute(rows, k=5):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in vectors:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **more):
    src = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cell int, v string")
    vectors = src.select("vec_id", op.scaled(F.col("embedding")).alias("v"))
    return sorted(map(tuple, op.top_k(vectors, F.col("vec_id") % 50 == 0, **more).collect()))


def cases():
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) + (3 if i % 3 else 0) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(120)]  # ties
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1050, [float("inf")] * 6), (1100, [1.0, 2.0]), (1101, [2.0, 2.0]), (1150, []), (None, [1.0] * 6)]
    return rows


def test_against_brute_force(spark):
    assert found(spark, cases()) == brute(cases())


def test_small_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_ROWS", 3)
    assert found(spark, cases(), pivots=7, sample=50) == brute(cases())


def test_vectors_go_only_to_groups_that_need_them(spark, monkeypatch):
    rng = random.Random(4)
    centres = [[100.0 * math.cos(a), 100.0 * math.sin(a)] for a in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in centres[i % 6]]) for i in range(1800)]
    tables, plain = {}, op.written
    monkeypatch.setattr(op, "MOST_ROWS", 4)
    monkeypatch.setattr(op, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    assert found(spark, rows, pivots=12) == brute(rows)
    sizes = {r["cell"]: r["count"] for r in tables["topk-cells"].groupBy("cell").count().collect()}
    wanted = {r["cell"]: sorted(r["parts"]) for r in tables["topk-wanted"].collect()}
    groups = {p for parts in wanted.values() for p in parts}
    sent = sum(sizes[c] * len(parts) for c, parts in wanted.items())
    assert len(groups) >= 9 and sent < 0.5 * len(rows) * len(groups)


def test_large_components_and_few_candidates(spark):
    rows = [(0, [1e6, -3.5]), (1, [2e6, 1e7]), (2, [-1e6, 4.25]), (50, [1.0, 1e6])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []


def test_repeated_rows_of_a_query(spark):
    rows = [(50, [10.0, 0.0])] * 6 + [(i, [0.01 * i, 10.0]) for i in range(1, 11)]
    pairs = sorted((-s, j) for i, q in rows if i == 50 for j, v in rows if j != 50 for s in [sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v))])
    want = [(50, n + 1, j, -s) for n, (s, j) in enumerate(pairs[:5])]
    assert found(spark, rows) == want
    assert found(spark, rows, k=1) == want[:1]
