import random

import pytest

from tessera.operators import ranges as op
from tessera.streaming.classify import classify_stream

ROWS = [(1, 10, 20), (2, 20, 30), (3, 5, 12), (4, 40, 40), (5, 10, 20), (6, 0, 100), (7, -20, -5)]


def brute(keys, rows, strict=False):
    fits = (lambda k, lo, hi: lo < k < hi) if strict else (lambda k, lo, hi: lo <= k <= hi)
    return sorted(((p, k, min([r for r, lo, hi in rows if k is not None and fits(k, lo, hi)], default=0)) for p, k in keys), key=str)


def found(spark, keys, rows, **more):
    frame = spark.createDataFrame(keys, "pos long, key long")
    return sorted(map(tuple, op.classify(frame, op.ranges_frame(spark, rows), **more).collect()), key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("max_local", [1000, 3])
def test_classify(spark, strict, max_local):
    rng = random.Random(1)
    keys = [(i, k) for i, k in enumerate([*range(-25, 110), None, 10**12, -(10**12)])]
    assert found(spark, keys, ROWS, strict=strict, max_local=max_local) == brute(keys, ROWS, strict)
    rows = [(i, lo := rng.randint(0, 500), lo + rng.randint(0, 60)) for i in range(1, 60)]
    assert found(spark, keys, rows, strict=strict, max_local=max_local) == brute(keys, rows, strict)


def test_no_ranges_and_empty_ones(spark):
    assert found(spark, [(1, 5)], []) == [(1, 5, 0)]
    assert found(spark, [(1, 5)], [(1, 9, 2)]) == [(1, 5, 0)]
    assert op.count_with_dummy(op.ranges_frame(spark, ROWS)) == 8


def test_admission_depends_on_order():
    assert op.admit([(0, 10), (10, 20), (5, 7), (0, 10), (-5, 50), (8, 12), (20, 30)]) == [(1, 0, 10), (2, 10, 20), (3, 0, 10), (4, -5, 50)]
    assert op.admit([(5, 7), (0, 10)]) == [(1, 5, 7), (2, 0, 10)]


def test_admission_against_comparing_with_every_accepted_range():
    rng = random.Random(3)
    for top in (4, 8, 30, 200):
        for _ in range(300):
            pairs = [(rng.randint(-top, top), rng.randint(-top, top)) for _ in range(rng.randint(0, 30))]
            want: list[tuple[int, int, int]] = []
            for lo, hi in pairs:
                if not any(a < lo < b or a < hi < b for _, a, b in want):
                    want.append((len(want) + 1, lo, hi))
            assert op.admit(pairs) == want


def test_plan_is_a_broadcast_hash_join(spark):
    frame = op.classify(spark.range(1000).selectExpr("id AS pos", "id AS key"), op.ranges_frame(spark, ROWS))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_histogram_offsets_and_slots(spark):
    keys = spark.createDataFrame([(i * 3, i % 7) for i in range(200)], "pos long, key long")
    classified = op.classify(keys, op.ranges_frame(spark, [(1, 0, 2), (2, 3, 3), (3, 100, 200)]))
    counts = {r["range_id"]: r["cnt"] for r in op.histogram(classified, 3).collect()}
    assert sum(counts.values()) == 200 and counts[3] == 0
    at = 0
    for r in op.offsets(op.histogram(classified, 3)).orderBy("range_id").collect():
        assert (r["start_offset"], r["end_offset"]) == (at, at + r["cnt"])
        at += r["cnt"]
    slots = op.partition_sort(classified).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(200))
    order = [(r["range_id"], r["pos"]) for r in slots]
    assert order == sorted(order)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, i) for i in range(50)], "pos long, key long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, key long").parquet(str(tmp_path / "in"))
    query = classify_stream(stream, op.ranges_frame(spark, ROWS)).writeStream.format("memory").queryName("classified").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM classified").collect()), key=str) == brute([(i, i) for i in range(50)], ROWS)


def test_both_paths_give_the_same_rows(spark):
    keys = [(1, 5), (1, 5), (2, None), (3, -7), (4, 10**12), (5, 2**62), (5, 99), (6, -(2**62)), (7, 0)]
    rows = [(1, 0, 4), (2, 5, 5), (3, -8, -7), (4, -(2**61), 2**61), (5, 98, 100), (6, 9, 3), (7, 2**62 - 1, 2**62 + 1)]
    frame, given = spark.createDataFrame(keys, "pos bigint, key bigint"), op.ranges_frame(spark, rows)
    for strict in (False, True):
        got = [sorted(map(tuple, op.classify(frame, given, strict, most).collect()), key=str) for most in (100, 3)]
        assert got[0] == got[1] and len(got[0]) == len(keys)
    assert sorted(map(tuple, op.classify(frame, given, max_local=0).collect()), key=str) == sorted(
        ((p, k, next((r for r, lo, hi in rows if k is not None and lo <= k <= hi), 0)) for p, k in keys), key=str
    )
