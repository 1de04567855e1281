import random
import re

import pytest

from tessera.operators import graph, influence, truss
from tessera.operators.components import component_members, components
from tessera.sources import adjacency, text


def random_edges(seed, n=30, m=140):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def near(edges):
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set()).add(u)
    return out


def brute_truss(edges, k):
    left = set(edges)
    while True:
        adj = near(left)
        weak = {(u, v) for u, v in left if len(adj[u] & adj[v]) < k}
        if not weak:
            return left
        left -= weak


def brute_components(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {x: top(x) for x in root}


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_support_core_and_truss(spark, seed):
    edges = random_edges(seed)
    e, adj = frame(spark, edges), near(edges)
    assert {r["id"]: r["degree"] for r in graph.degree(e).collect()} == {v: len(x) for v, x in adj.items()}
    want = sorted((u, v, w) for u, v in edges for w in adj[u] & adj[v] if w > v)
    assert sorted(map(tuple, graph.triangles(e).collect())) == want
    assert {(r["u"], r["v"]): r["support"] for r in graph.support(e, graph.triangles(e)).collect()} == {(u, v): len(adj[u] & adj[v]) for u, v in edges}
    rank = {v: (len(x), v) for v, x in adj.items()}
    assert all(rank[r["u"]] < rank[r["v"]] for r in graph.orient(e).collect())
    left = set(edges)
    while weak := {x for x in left if min(len(near(left)[x[0]]), len(near(left)[x[1]])) < 9}:
        left -= weak
    assert set(map(tuple, graph.core(e, 9).collect())) == left
    previous = set(edges)
    for k in (0, 1, 2, 3):
        got = set(map(tuple, truss.truss(e, k).collect()))
        assert got == brute_truss(edges, k) and got <= previous
        previous = got
    assert [tuple(r) for r in truss.truss_sweep(e, 0, 6).orderBy("k").collect()] == [(k, int(bool(brute_truss(edges, k)))) for k in range(7)]


def test_small_graph(spark):
    e = graph.small_graph(spark)
    members = {tuple(r["members"]) for r in component_members(components(truss.truss(e, 2).toDF("a", "b"))).collect()}
    assert members == {(0, 1, 2, 3), (4, 5, 6, 7)}
    assert truss.truss(e, 3).isEmpty()
    e = graph.small_graph(spark, ((4, 9),))
    v = spark.createDataFrame([(i,) for i in range(12)], "id long")
    ids = lambda p: {r["id"] for r in influence.influencers(e, v, 2, p).collect()}
    assert ids(2) == {2, 3, 4, 5, 9} and ids(-1) == set() and ids(0) == set(range(12)) and ids(9) == set()
    reach = influence.influencer_reach(e, v, 2, 2).collect()
    assert {(r["id"], r["member"]) for r in reach} == {(i, m) for i in (2, 3, 4, 5, 9) for m in range(8)}
    lines = [r["value"] for r in text.influencer_lines(influence.influencers(e, v, 2, 2)).collect()]
    assert lines == ["5", "2 3 4 5 9"]
    lines = [r["value"] for r in text.influencer_lines(influence.influencers(e, v, 2, 2), influence.influencer_reach(e, v, 2, 2)).collect()]
    assert lines[:3] == ["5", "2", "0 1 2 3 4 5 6 7"] and len(lines) == 11


@pytest.mark.parametrize("seed", [3])
def test_components_and_influencers(spark, seed):
    edges = random_edges(seed, 60, 200)
    e, adj = frame(spark, edges), near(edges)
    labels = brute_components(brute_truss(edges, 1))
    assert {r["id"]: r["component"] for r in components(truss.truss(e, 1).toDF("a", "b")).collect()} == labels
    v = spark.createDataFrame([(i,) for i in range(62)], "id long")
    want = {i: len({labels[x] for x in {i} | adj.get(i, set()) if x in labels}) for i in range(62)}
    assert {r["id"]: r["n_components"] for r in influence.component_counts(e, v, 1).collect()} == want


def test_files(spark, tmp_path):
    edges = random_edges(5)
    adjacency.write_adjacency(frame(spark, edges), 32, str(tmp_path / "g"), str(tmp_path / "o"))
    e, v = adjacency.read_adjacency(spark, str(tmp_path / "g"), str(tmp_path / "o"), vertices=7)
    assert sorted(map(tuple, e.collect())) == edges and {r["id"] for r in v.collect()} == set(range(32))
    adj = near(edges)
    (tmp_path / "t").write_text(f"32 {len(edges)}\n" + "".join(f"{i} {len(adj.get(i, ()))} {' '.join(map(str, sorted(adj.get(i, ()))))}\n" for i in range(32)))
    e, v = adjacency.read_adjacency_text(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, e.collect())) == edges and {r["id"] for r in v.collect()} == set(range(32))
    (tmp_path / "r").write_text("0 10\n10 20\n5 7\n")
    (tmp_path / "k").write_text("3 10 15\n99\n")
    assert [tuple(r) for r in text.read_ranges(spark, str(tmp_path / "r")).collect()] == [(1, 0, 10), (2, 10, 20)]
    assert [r["key"] for r in text.read_keys(spark, str(tmp_path / "k"), 3).orderBy("pos").collect()] == [3, 10, 15]
    (tmp_path / "c.csv").write_text("processes,threads,seconds\n1,1,8\n2,2,4\n")
    row = text.read_timings(spark, str(tmp_path / "c.csv")).where("processes = 2").first()
    assert (row["speedup"], row["efficiency"]) == (2.0, 0.5) and row["serial_fraction"] == pytest.approx(1 / 3)
    assert [r["value"] for r in text.flag_lines(spark.createDataFrame([(2, 0), (1, 1)], "k int, found int")).collect()] == ["1 0"]
    values = lambda lines: [r["value"] for r in lines.collect()]
    assert values(text.graph_inspection(frame(spark, [(0, 1), (0, 2)]), spark.range(4))) == ["vertex 0, degree 2: 1 2", "vertex 1, degree 1: 0", "vertex 2, degree 1: 0", "vertex 3, degree 0: "]
    assert values(text.range_inspection(text.read_ranges(spark, str(tmp_path / "r")))) == ["1: 0, 10", "2: 10, 20"]
    assert values(text.key_inspection(spark.createDataFrame([(1, 15), (0, 3)], "pos long, key long"))) == ["0: 3 -- -1", "1: 15 -- -1"]
    assert values(text.count_inspection(spark.createDataFrame([(1, 4), (0, 2)], "range_id int, cnt long"))) == ["0:2", "1:4"]
    lines = text.component_lines(spark.createDataFrame([(4, 2, [4, 5]), (1, 2, [1, 2])], "component long, size long, members array<long>"))
    assert [r["value"] for r in lines.collect()] == ["2", "1 2", "4 5"]


@pytest.mark.parametrize("bundle,run", [(1, 1), (7, 3), (1024, 64)])
def test_reach_in_bundles(spark, monkeypatch, bundle, run):
    monkeypatch.setattr(influence, "BUNDLE", bundle)
    monkeypatch.setattr(influence, "RUN", run)
    edges = random_edges(5, 60, 90)
    v, adj = spark.createDataFrame([(i,) for i in range(62)], "id long"), near(edges)
    labels = brute_components(brute_truss(edges, 1))
    touch = {i: {labels[x] for x in {i} | adj.get(i, set()) if x in labels} for i in range(62)}
    for p in (1, 2, -1):
        want = sorted((i, m) for i, c in touch.items() if 0 <= p <= len(c) for m, of in labels.items() if of in c)
        assert sorted(map(tuple, influence.influencer_reach(frame(spark, edges), v, 1, p).collect())) == want


def test_reach_repeats_take_little_room(spark, tmp_path):
    edges = [(hub, hub + i) for hub in (0, 1000) for i in range(1, 601)]
    v = spark.createDataFrame([(i,) for e in edges for i in e], "id long").distinct()
    reach, out = influence.influencer_reach(frame(spark, edges), v, 0, 1), tmp_path / "reach"
    reach.write.parquet(str(out))
    back = spark.read.parquet(str(out))
    assert back.count() == back.distinct().count() == 2 * 601 * 601
    assert sum(f.stat().st_size for f in out.rglob("*.parquet")) < back.count() // 3


@pytest.mark.parametrize("slight,most", [(0.0, 0), (0.0, 99), (1.0, 0), (1.0, 99)])
def test_truss_in_either_order(spark, monkeypatch, slight, most):
    monkeypatch.setattr(truss, "SLIGHT", slight)
    monkeypatch.setattr(truss, "WEDGES", most)
    edges = random_edges(6, 40, 150)
    e, adj = frame(spark, edges), near(edges)
    above = [sum(x > v for x in adj[v]) for v in adj]
    assert graph.wedges_by_id(e) == sum(n * (n - 1) // 2 for n in above) and graph.wedges_by_id(e.where("u < 0")) == 0
    assert sorted(map(tuple, graph.triangles(e, by_id=True).collect())) == sorted((u, v, w) for u, v in edges for w in adj[u] & adj[v] if w > v)
    assert set(map(tuple, graph.core(e, 4).collect())) <= set(map(tuple, graph.core(e, 4, slight).collect())) <= set(edges)
    for k in (1, 2, 9):
        assert set(map(tuple, truss.truss(e, k).collect())) == brute_truss(edges, k)


@pytest.mark.parametrize("links", [random_edges(7, 300, 220), [(i, i + 1) for i in range(-40, 90)], [(i * 7 % 61, i * 11 % 61) for i in range(50)], [(5, 5)]])
def test_components_at_once(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long"), 1_000)
    assert found.dtypes == [("id", "bigint"), ("component", "bigint")]
    assert sorted(map(tuple, found.collect())) == sorted(brute_components([x for x in links if x[0] != x[1]]).items())


def test_reach_takes_few_tables(spark, monkeypatch):
    made, write = [], components.__globals__["written"]
    monkeypatch.setitem(components.__globals__, "written", lambda df, name, *a, **b: made.append(name) or write(df, name, *a, **b))
    edges = [(i, i + 1) for i in range(40)] + [(i, i + 2) for i in range(39)]
    v = spark.range(42)
    plan = influence.influencer_reach(frame(spark, edges), v, 1, 1)
    assert made == ["edges"]
    steps = re.findall(r"Generate|Repartition", plan._jdf.queryExecution().optimizedPlan().toString())
    assert steps[:5:2] == ["Generate"] * 3 and steps[1:5:2] == ["Repartition"] * 2  # each explode in a loop of its own
    assert sorted(map(tuple, plan.collect())) == [(i, m) for i in range(41) for m in range(41)]
    monkeypatch.setattr(influence, "AT_ONCE", 1)
    assert sorted(map(tuple, influence.influencer_reach(frame(spark, edges), v, 1, 1).collect())) == [(i, m) for i in range(41) for m in range(41)]
