import re

import numpy as np
import pytest

from tessera.operators import blocks as op
from tessera.sources import blockmatrix

N, M = 16, 4


def matrix(seed, top=9, symmetric=False):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, top, (N, N)) * (rng.random((N, N)) < 0.3)
    return np.triu(a) + np.triu(a, 1).T if symmetric else a


def coo(spark, a, names=("i", "j", "v")):
    return spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a))], ", ".join(f"{n} long" for n in names))


def dense(frame):
    out = np.zeros((N, N), np.int64)
    for r in frame.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_blocks_round_trip(spark):
    a = matrix(1)
    blocked = op.to_blocks(coo(spark, a), M)
    assert all(len(r["data"]) == M * M for r in blocked.collect())
    assert (dense(op.to_coo(blocked, M)) == a).all()
    assert {tuple(r) for r in op.nonzero_blocks(coo(spark, a), M).collect()} == {(i, j) for i in range(4) for j in range(4) if a[i * 4 : i * 4 + 4, j * 4 : j * 4 + 4].any()}


def test_products(spark):
    a, b = matrix(1), matrix(2)
    left, right = coo(spark, a, "ikx"), coo(spark, b, "kjy")
    assert (dense(op.multiply(left, right)) == a @ b).all()
    assert (dense(op.multiply(left, right, cap=20)) == np.minimum(a @ b, 20)).all()
    assert (dense(op.multiply_python(left, right, lambda x, y: x * y, lambda v, acc: v + acc)) == a @ b).all()
    want = {}
    for i, k in zip(*np.nonzero(a)):
        for j in np.flatnonzero(b[k]):
            want[i, j] = min(want.get((i, j), 10**9), a[i, k] + b[k, j])
    assert {(r["i"], r["j"]): r["v"] for r in op.multiply(left, right, "min_plus", None).collect()} == want
    assert (dense(op.multiply(left, coo(spark, np.eye(N, dtype=int), "kjy"))) == a).all()


@pytest.mark.parametrize("cap", [65535, 30])
def test_square_upper(spark, cap):
    s = matrix(3, symmetric=True)
    got = dense(op.square_upper(coo(spark, s, "ikx"), M, cap=cap))
    keep = np.arange(N)[:, None] // M <= np.arange(N)[None, :] // M
    assert (got == np.minimum(s @ s, cap) * keep).all()


def test_mirror(spark):
    s = matrix(4, symmetric=True)
    half = coo(spark, np.triu(s))
    assert (dense(op.mirror(half)) == s).all()
    upper = op.to_blocks(coo(spark, s), M).where("brow <= bcol")
    assert (dense(op.to_coo(op.mirror_blocks(upper, M), M)) == s).all()
    assert op.duplicates(upper).isEmpty() and op.duplicates(upper.union(upper)).count() == upper.count()


def test_index_diff_and_score(spark):
    a = matrix(5)
    blocked = op.to_blocks(coo(spark, a), M)
    ptr = {r["brow"]: r["ptr"] for r in op.csr_index(blocked, N // M).collect()}
    rows = [r["brow"] for r in blocked.collect()]
    assert ptr == {i: sum(r < i for r in rows) for i in range(N // M + 1)}
    b = a.copy()
    i, j = (int(x[0]) for x in np.nonzero(a))
    b[i, j] += 1
    assert op.equal(coo(spark, a), coo(spark, a)) and not op.equal(coo(spark, a), coo(spark, b))
    assert [tuple(r) for r in op.diff(coo(spark, a), coo(spark, b)).collect()] == [(i, j, a[i, j], a[i, j] + 1)]
    n = blocked.count()
    assert op.score(blocked, blocked).first()["score"] == 1.0
    assert op.score(blocked, op.to_blocks(coo(spark, b), M)).first()["score"] == pytest.approx((n - 1) / n)
    less = blocked.where(f"NOT (brow = {i // M} AND bcol = {j // M})")
    assert op.score(less, blocked).first()["score"] == pytest.approx(0.8)


@pytest.mark.parametrize("width,top", [(1, 255), (2, 65535), (4, 2**32 - 1)])
def test_file_round_trip(spark, tmp_path, width, top):
    blocks = op.random_blocks(spark, 24, 3, 17, top + 50, seed=7)
    path = str(tmp_path / "m")
    blockmatrix.write_blocks(blocks, path, 24, 3, width)
    assert blockmatrix.header(path) == (24, 3, 17)
    want = {(r["brow"], r["bcol"]): [min(v, top) for v in r["data"]] for r in blocks.collect()}
    got = blockmatrix.read_blocks(spark, path, width, records=5)
    assert {(r["brow"], r["bcol"]): r["data"] for r in got.collect()} == want and got.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="size"):
        blockmatrix.read_blocks(spark, path, {1: 2, 2: 4, 4: 1}[width]).count()


@pytest.mark.parametrize("records", [0, 5])
def test_folder_of_parts(spark, tmp_path, records, monkeypatch):
    monkeypatch.setattr(blockmatrix, "READ_BYTES", 60)
    blocks, path = op.random_blocks(spark, 24, 3, 17, 999, seed=7), str(tmp_path / "m")
    blockmatrix.write_blocks(blocks.repartition(3), path, 24, 3, 2, single=False)
    assert blockmatrix.header(path) == (24, 3, 17)
    want = {(r["brow"], r["bcol"]): r["data"] for r in blocks.collect()}
    assert {(r["brow"], r["bcol"]): r["data"] for r in blockmatrix.read_blocks(spark, path, 2, records).collect()} == want
    with pytest.raises(Exception, match="size"):
        blockmatrix.read_blocks(spark, path, 4).count()
    none = str(tmp_path / "none")
    blockmatrix.write_blocks(blocks.limit(0), none, 24, 3, 2, single=False)
    assert blockmatrix.header(none) == (24, 3, 0) and blockmatrix.read_blocks(spark, none, 2).count() == 0


def test_command_line_products(spark, tmp_path, capsys, monkeypatch):
    from tessera import __main__ as cli

    monkeypatch.setattr(spark, "stop", lambda: None)
    m, n = 3, 12
    left, right = op.random_blocks(spark, n, m, 9, 50, seed=1), op.random_blocks(spark, n, m, 9, 50, seed=2)
    a, b, s, out = (str(tmp_path / x) for x in "absc")
    blockmatrix.write_blocks(left, a, n, m, 2)
    blockmatrix.write_blocks(right, b, n, m, 2)
    blockmatrix.write_blocks(left.where("brow <= bcol"), s, n, m, 1)
    coo = lambda x, names: op.to_coo(x, m).toDF(*names)
    rows = lambda x: sorted(map(tuple, x.collect()))
    want = rows(op.multiply(coo(left, "ikx"), coo(right, "kjy")))
    for more in ([], ["--parts"]):
        cli.main(["multiply", a, b, out + "".join(more), *more])
        assert rows(op.to_coo(blockmatrix.read_blocks(spark, out + "".join(more), 4), m)) == want
    half = op.to_coo(op.mirror_blocks(left.where("brow <= bcol"), m), m).toDF("i", "k", "x")
    for semiring in ("plus_times", "max_plus"):
        cli.main(["square", s, out + semiring, "--semiring", semiring])
        assert rows(op.to_coo(blockmatrix.read_blocks(spark, out + semiring, 2), m)) == rows(op.square_upper(half, m, semiring))
    cli.main(["inspect", "blocks", a, "--most", "3"])
    lines = capsys.readouterr().out.splitlines()
    first = min(left.collect(), key=lambda r: (r["brow"], r["bcol"]))
    assert len(lines) == 3 and lines[0] == f"row {first['brow']}, col {first['bcol']}: {' '.join(map(str, first['data']))}"


def test_products_of_blocks(spark):
    import numpy as np

    rng, m, n = np.random.default_rng(2), 3, 4
    a, b = (rng.integers(0, 9, (n * m, n * m)) for _ in range(2))
    cut = lambda x: spark.createDataFrame([(i, j, x[i * m : i * m + m, j * m : j * m + m].ravel().tolist()) for i in range(n) for j in range(n)], op.BLOCKS)
    folds = {"plus_times": (np.multiply, np.sum), "min_plus": (np.add, np.min), "max_plus": (np.add, np.max), "max_min": (np.minimum, np.max), "min_max": (np.maximum, np.min)}
    for name, (inner, outer) in folds.items():
        want = outer(inner(a[:, :, None], b[None, :, :]), axis=1)
        for r in op.multiply_blocks(cut(a), cut(b), m, name, cap=150).collect():
            i, j = r["brow"] * m, r["bcol"] * m
            assert r["data"] == np.minimum(want[i : i + m, j : j + m], 150).ravel().tolist()
    upper = op.multiply_blocks(cut(a), cut(b), m, upper=True).collect()
    assert sorted((r["brow"], r["bcol"]) for r in upper) == [(i, j) for i in range(n) for j in range(i, n)]
    assert op.multiply_blocks(cut(a).limit(0), cut(b), m).count() == 0


def test_products_of_blocks_move_blocks_not_sums(spark, monkeypatch):
    rng, m, n = np.random.default_rng(3), 3, 7
    a, b = (rng.integers(-9, 9, (n * m, n * m)) for _ in range(2))
    for x in (a, b):
        for i, j in ((0, 0), (2, 5), (6, 1), *((4, k) for k in range(n))):
            x[i * m : i * m + m, j * m : j * m + m] = 0
    cut = lambda x: op.to_blocks(coo(spark, x), m)
    got = lambda x: {(r["brow"], r["bcol"]): r["data"] for r in x.collect()}
    places = [(i, j) for i in range(n) if i != 4 for j in range(n)]
    big = 1 << 27  # sums that doubles don't hold
    for side, depth in ((2 * m, 100), (2 * m, 2), (1, 1), (2048, 3)):
        monkeypatch.setattr(op, "SIDE", side, raising=False)
        monkeypatch.setattr(op, "DEPTH", depth, raising=False)
        for x, y in ((a, b), (a * big - (a != 0), b * big)):
            want = np.minimum(x @ y, 150)
            found = op.multiply_blocks(cut(x), cut(y), m, cap=150)
            assert got(found) == {(i, j): want[i * m : i * m + m, j * m : j * m + m].ravel().tolist() for i, j in places}
            upper = got(op.multiply_blocks(cut(x), cut(y), m, cap=150, upper=True))
            assert upper == {k: v for k, v in got(found).items() if k[0] <= k[1]}
        if depth > n:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert set(re.findall(r"hashpartitioning\((\w+)#[^)]*\), REPARTITION_BY_COL", plan)) == {"ti"}


def test_csr_index_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 3)
    rows = [(0, 1), (0, 2), (4, 1), (7, 7), (7, 8), (7, 9)]
    got = op.csr_index(spark.createDataFrame(rows, "brow int, bcol int"), 9)
    assert sorted(map(tuple, got.collect())) == [(i, sum(r < i for r, _ in rows)) for i in range(10)]
