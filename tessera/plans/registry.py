"""The queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import shared_dir, written
from tessera.operators import blocks, graph, influence, ranges, truss
from tessera.operators.components import component_members, components
from tessera.plans import workloads as w
from tessera.sources import adjacency, blockmatrix, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K, P = 3, 2  # triangles per edge and components per influencer in the graph queries
CAP = w.M * w.M
CORE = 8  # least degree in the core query
SWEEP = (1, 8)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- ranges

CLASSIFIED = f"""keys AS ({w.KEYS_SQL}), ranges AS ({w.RANGES_SQL}),
c AS (SELECT k.pos, any_value(k.key) AS key, cast(coalesce(min(r.range_id), 0) AS INTEGER) AS range_id FROM keys k LEFT JOIN ranges r ON k.key BETWEEN r.lo AND r.hi GROUP BY k.pos),
h AS (SELECT cast(i AS INTEGER) AS range_id, (SELECT count(*) FROM c WHERE c.range_id = i) AS cnt FROM range(0, {w.N_RANGES + 1}) t(i))"""


def _classified(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return ranges.classify(w.keys(spark, sf_dir), w.ranges(spark), strict)


@_query(f"WITH {CLASSIFIED} SELECT pos, key, range_id FROM c")
def range_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@_query(
    f"WITH keys AS ({w.KEYS_SQL}), ranges AS ({w.RANGES_SQL}) SELECT k.pos, any_value(k.key) AS key, cast(coalesce(min(r.range_id), 0) AS INTEGER) AS range_id "
    "FROM keys k LEFT JOIN ranges r ON r.lo < k.key AND k.key < r.hi GROUP BY k.pos"
)
def range_strict_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, strict=True)


@_query(f"WITH {CLASSIFIED} SELECT range_id, cnt FROM h")
def range_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.histogram(_classified(spark, sf_dir), w.N_RANGES)


@_query(
    f"WITH {CLASSIFIED} SELECT range_id, cnt, cast(sum(cnt) OVER (ORDER BY range_id) - cnt AS BIGINT) AS start_offset, cast(sum(cnt) OVER (ORDER BY range_id) AS BIGINT) AS end_offset FROM h"
)
def range_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.offsets(ranges.histogram(_classified(spark, sf_dir), w.N_RANGES))


@_query(f"WITH {CLASSIFIED} SELECT row_number() OVER (ORDER BY range_id, pos) - 1 AS slot, pos, key, range_id FROM c")
def range_partition_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.partition_sort(_classified(spark, sf_dir))


ADMIT = """WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS step, cast(n_regionkey * 7 AS BIGINT) AS lo, cast(n_regionkey * 7 + n_nationkey + 1 AS BIGINT) AS hi FROM nation),
loop(step, kept) AS (SELECT cast(0 AS BIGINT), cast([] AS STRUCT(lo BIGINT, hi BIGINT)[]) UNION ALL
  SELECT p.step, CASE WHEN len(list_filter(l.kept, lambda r: (r.lo < p.lo AND p.lo < r.hi) OR (r.lo < p.hi AND p.hi < r.hi))) = 0
    THEN list_append(l.kept, {'lo': p.lo, 'hi': p.hi}) ELSE l.kept END FROM loop l JOIN p ON p.step = l.step + 1),
f AS (SELECT kept FROM loop ORDER BY step DESC LIMIT 1)
SELECT cast(i AS INTEGER) AS range_id, kept[i].lo AS lo, kept[i].hi AS hi FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS i FROM f)"""


@_query(ADMIT)
def range_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and region keys as ends: order-dependent admission of a small list."""
    pairs = w.load(spark, sf_dir, "nation").orderBy("n_nationkey").select((F.col("n_regionkey") * 7).alias("lo"), (F.col("n_regionkey") * 7 + F.col("n_nationkey") + 1).alias("hi"))
    return ranges.ranges_frame(spark, ranges.admit((r["lo"], r["hi"]) for r in pairs.collect()))


# ---- block matrices


@_query(f"WITH a AS ({w.A_SQL}), b AS ({w.B_SQL}) SELECT i, j, cast(least(sum(x * y), {blocks.U32}) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY i, j")
def bm_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.multiply(w.matrix_a(spark, sf_dir), w.matrix_b(spark, sf_dir))


@_query(f"WITH a AS ({w.A_SQL}), b AS ({w.B_SQL}) SELECT i, j, cast(min(x + y) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY i, j")
def bm_semiring_minplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.multiply(w.matrix_a(spark, sf_dir), w.matrix_b(spark, sf_dir), "min_plus", cap=None)


SQUARE = f"s AS ({w.S_SQL}), q AS (SELECT a.i, b.i AS j, cast(least(sum(a.x * b.x), {blocks.U16}) AS BIGINT) AS v FROM s a JOIN s b ON a.k = b.k AND a.i // {w.M} <= b.i // {w.M} GROUP BY 1, 2)"


@_query(f"WITH {SQUARE} SELECT i, j, v FROM q WHERE v <> 0")
def bm_square_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.square_upper(written(w.symmetric(spark, sf_dir), "symmetric"), w.M)


DENSE = 32  # width of the blocks of well filled matrices
DENSE_SQL = f"d AS (SELECT l_suppkey AS i, l_partkey % {3 * DENSE} AS k, cast(sum(l_quantity) AS BIGINT) AS x FROM lineitem GROUP BY 1, 2)"


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quantities by supplier and a part's remainder, and the transposed matrix, in blocks of DENSE x DENSE."""
    lines = w.load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % (3 * DENSE)).alias("j")).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    lines = written(lines, "dense")
    return blocks.to_blocks(lines, DENSE), blocks.to_blocks(lines.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), DENSE)


@_query(f"WITH {DENSE_SQL} SELECT a.i, b.i AS j, cast(least(sum(a.x * b.x), {blocks.U32}) AS BIGINT) AS v FROM d a JOIN d b USING (k) GROUP BY 1, 2 HAVING sum(a.x * b.x) <> 0")
def bm_block_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_coo(blocks.multiply_blocks(*_dense(spark, sf_dir), DENSE), DENSE)


@_query(
    f"WITH {DENSE_SQL} SELECT a.i, b.i AS j, cast(least(sum(a.x * b.x), {blocks.U16}) AS BIGINT) AS v FROM d a JOIN d b USING (k) "
    f"WHERE a.i // {DENSE} <= b.i // {DENSE} GROUP BY 1, 2 HAVING sum(a.x * b.x) <> 0"
)
def bm_block_square_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_coo(blocks.multiply_blocks(*_dense(spark, sf_dir), DENSE, cap=blocks.U16, upper=True), DENSE)


def _coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.symmetric(spark, sf_dir).select("i", F.col("k").alias("j"), F.col("x").alias("v"))


@_query(
    f"WITH s AS ({w.S_SQL}), b AS (SELECT DISTINCT i // {w.M} AS br, k // {w.M} AS bc FROM s WHERE x <> 0) "
    f"SELECT cast(br AS INTEGER) AS brow, cast(bc AS INTEGER) AS bcol, cast(p AS INTEGER) AS p, coalesce(s.x, 0) AS v "
    f"FROM b CROSS JOIN range({CAP}) t(p) LEFT JOIN s ON s.i = br * {w.M} + p // {w.M} AND s.k = bc * {w.M} + p % {w.M}"
)
def bm_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_blocks(_coo(spark, sf_dir), w.M).select("brow", "bcol", F.posexplode("data").alias("p", "v"))


@_query(f"WITH s AS ({w.S_SQL}) SELECT i, k AS j, x AS v FROM s WHERE x <> 0")
def bm_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_coo(blocks.to_blocks(_coo(spark, sf_dir), w.M), w.M)


@_query(f"WITH h AS ({w.WEIGHTED_SQL}) SELECT u AS i, v AS j, w AS v FROM h UNION ALL SELECT v, u, w FROM h")
def bm_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.mirror(w.weighted(spark, sf_dir).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("v")))


@_query(f"WITH s AS ({w.S_SQL}) SELECT DISTINCT cast(i // {w.M} AS INTEGER) AS brow, cast(k // {w.M} AS INTEGER) AS bcol FROM s WHERE x <> 0")
def bm_nonzero_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nonzero_blocks(_coo(spark, sf_dir), w.M)


@_query(
    f"WITH s AS ({w.S_SQL}), b AS (SELECT DISTINCT i // {w.M} AS brow, k // {w.M} AS bcol FROM s WHERE x <> 0), n AS (SELECT max(p_partkey) // {w.M} + 1 AS n FROM part) "
    "SELECT cast(r AS INTEGER) AS brow, (SELECT count(*) FROM b WHERE b.brow < r) AS ptr FROM (SELECT unnest(range(0, n + 1)) AS r FROM n)"
)
def bm_csr_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = w.vertices(spark, sf_dir).agg(F.max("id")).first()[0]
    return blocks.csr_index(blocks.nonzero_blocks(_coo(spark, sf_dir), w.M), top // w.M + 1)


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A matrix, and one whose diagonal band differs: weights of neighbouring parts are one more."""
    coo = _coo(spark, sf_dir)
    return coo, coo.withColumn("v", F.col("v") + F.when(F.abs(F.col("i") - F.col("j")) < 100, 1).otherwise(0))


@_query(f"WITH s AS ({w.S_SQL}) SELECT i, k AS j, x AS left_v, x + 1 AS right_v FROM s WHERE abs(i - k) < 100")
def bm_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.diff(*_changed(spark, sf_dir))


@_query(
    f"WITH s AS ({w.S_SQL}), b AS (SELECT i // {w.M} AS br, k // {w.M} AS bc, max(abs(i - k) < 100) AS bad FROM s GROUP BY 1, 2) "
    "SELECT count(*) FILTER (NOT bad) / count(*) AS score FROM b"
)
def bm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _changed(spark, sf_dir)
    return blocks.score(blocks.to_blocks(a, w.M), blocks.to_blocks(b, w.M))


# ---- graphs

E = f"SELECT u, v FROM ({w.WEIGHTED_SQL})"
TRIANGLES = f"e AS ({E}), tr AS MATERIALIZED (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v)"
SIDES = "SELECT a AS u, b AS v FROM tr UNION ALL SELECT a, c FROM tr UNION ALL SELECT b, c FROM tr"
DEGREES = "d AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) GROUP BY id)"
#: Edges that survive in the k-truss: rounds of deletion, 60 being more than any of these graphs needs.
TRUSS = """RECURSIVE {tri},
tt AS MATERIALIZED (SELECT a AS p, b AS q, a AS x1, c AS y1, b AS x2, c AS y2 FROM tr UNION ALL SELECT a, c, a, b, b, c FROM tr UNION ALL SELECT b, c, a, b, a, c FROM tr),
loop(it, u, v) AS (SELECT 0, u, v FROM e UNION ALL
  SELECT it + 1, u, v FROM (SELECT l.it, l.u, l.v, count(*) AS s FROM loop l JOIN tt t ON t.p = l.u AND t.q = l.v
    JOIN loop l1 ON l1.u = t.x1 AND l1.v = t.y1 JOIN loop l2 ON l2.u = t.x2 AND l2.v = t.y2 GROUP BY 1, 2, 3)
  WHERE s >= {k} AND it < 60),
f AS MATERIALIZED (SELECT u, v FROM loop WHERE it = 60)"""


def _truss_sql(k: int = K) -> str:
    return TRUSS.format(tri=TRIANGLES, k=k)


LABELS = """s AS MATERIALIZED (SELECT u, v FROM f UNION ALL SELECT v, u FROM f),
reach(id, c) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, l.c FROM reach l JOIN s ON s.u = l.id WHERE l.c < s.v),
labels AS MATERIALIZED (SELECT id, min(c) AS component FROM reach GROUP BY id)"""
TOUCHED = """near AS (SELECT u AS id, v AS n FROM e UNION ALL SELECT v, u FROM e UNION ALL SELECT p_partkey, p_partkey FROM part),
touched AS MATERIALIZED (SELECT DISTINCT near.id, component FROM near JOIN labels ON labels.id = near.n),
counts AS (SELECT p_partkey AS id, (SELECT count(*) FROM touched t WHERE t.id = p_partkey) AS n_components FROM part)"""


@_query(f"WITH e AS ({E}), {DEGREES} SELECT p_partkey AS id, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON d.id = p_partkey")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(w.edges(spark, sf_dir), w.vertices(spark, sf_dir))


@_query(
    f"""WITH RECURSIVE e AS ({E}), loop(it, u, v) AS (SELECT 0, u, v FROM e UNION ALL
  SELECT l.it + 1, l.u, l.v FROM loop l JOIN (SELECT id FROM (SELECT u AS id FROM loop UNION ALL SELECT v FROM loop) GROUP BY id HAVING count(*) >= {CORE}) a ON a.id = l.u
    JOIN (SELECT id FROM (SELECT u AS id FROM loop UNION ALL SELECT v FROM loop) GROUP BY id HAVING count(*) >= {CORE}) b ON b.id = l.v WHERE it < 60)
SELECT u, v FROM loop WHERE it = 60"""
)
def graph_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.core(w.edges(spark, sf_dir), CORE)


@_query(
    f"""WITH e AS ({E}), {DEGREES} SELECT CASE WHEN (a.degree, e.u) < (b.degree, e.v) THEN e.u ELSE e.v END AS u, CASE WHEN (a.degree, e.u) < (b.degree, e.v) THEN e.v ELSE e.u END AS v
FROM e JOIN d a ON a.id = e.u JOIN d b ON b.id = e.v"""
)
def graph_oriented_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orient(written(w.edges(spark, sf_dir), "edges"))


@_query(f"WITH {TRIANGLES} SELECT a, b, c FROM tr")
def graph_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(written(w.edges(spark, sf_dir), "edges"))


@_query(f"WITH {TRIANGLES} SELECT count(*) AS n FROM tr")
def graph_triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(written(w.edges(spark, sf_dir), "edges")).agg(F.count("*").alias("n"))


@_query(f"WITH {TRIANGLES}, n AS (SELECT u, v, count(*) AS support FROM ({SIDES}) GROUP BY 1, 2) SELECT e.u, e.v, coalesce(support, 0) AS support FROM e LEFT JOIN n ON e.u = n.u AND e.v = n.v")
def graph_edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(w.edges(spark, sf_dir), "edges")
    return graph.support(edges, graph.triangles(edges))


def _truss(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return truss.truss(written(w.edges(spark, sf_dir), "edges"), k)


@_query(f"WITH {_truss_sql()} SELECT u, v FROM f")
def truss_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truss(spark, sf_dir)


def _found_sql(k: int) -> str:
    return f"SELECT {k} AS k, cast((SELECT count(*) FROM (WITH {_truss_sql(k)} SELECT u, v FROM f)) > 0 AS INTEGER) AS found"


@_query(" UNION ALL ".join(map(_found_sql, range(SWEEP[0], SWEEP[1] + 1))))
def truss_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truss.truss_sweep(written(w.edges(spark, sf_dir), "edges"), *SWEEP)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_truss(spark, sf_dir).toDF("a", "b"))


@_query(f"WITH {_truss_sql()}, {LABELS} SELECT id, component FROM labels")
def truss_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@_query(f"WITH {_truss_sql()}, {LABELS} SELECT component, count(*) AS size FROM labels GROUP BY component")
def truss_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size"))


@_query(f"WITH {_truss_sql()}, {LABELS} SELECT component, count(*) AS size, string_agg(id, ' ' ORDER BY id) AS members FROM labels GROUP BY component")
def truss_component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = component_members(_labels(spark, sf_dir))
    return found.select("component", "size", F.concat_ws(" ", F.col("members").cast("array<string>")).alias("members"))


@_query(f"WITH {_truss_sql()}, {LABELS}, {TOUCHED} SELECT id, n_components FROM counts WHERE n_components >= {P}")
def influencers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.influencers(written(w.edges(spark, sf_dir), "edges"), w.vertices(spark, sf_dir), K, P)


@_query(f"WITH {_truss_sql()}, {LABELS}, {TOUCHED} SELECT count(*) AS n FROM counts WHERE n_components >= {P}")
def influencer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influencers(spark, sf_dir).agg(F.count("*").alias("n"))


@_query(
    f"WITH {_truss_sql()}, {LABELS}, {TOUCHED} SELECT t.id, l.id AS member FROM touched t JOIN counts c ON c.id = t.id JOIN labels l ON l.component = t.component WHERE c.n_components >= {P}"
)
def influencer_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return influence.influencer_reach(written(w.edges(spark, sf_dir), "edges"), w.vertices(spark, sf_dir), K, P)


# ---- files: what is written to the shared folder and read back


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def _as_text(lines: DataFrame, name: str) -> str:
    path = _file(lines.sparkSession, name)
    text.write_lines(lines, path)
    return path


@_query(w.RANGES_SQL)
def source_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = w.ranges(spark).coalesce(1).orderBy("range_id").select(F.concat_ws(" ", "lo", "hi").alias("value"))
    return text.read_ranges(spark, _as_text(lines, "ranges"))


@_query(f"SELECT key, count(*) AS n FROM ({w.KEYS_SQL}) WHERE key IS NOT NULL GROUP BY key")
def source_key_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _as_text(w.keys(spark, sf_dir).select(F.col("key").cast("string").alias("value")), "keys")
    return text.read_keys(spark, path).groupBy("key").agg(F.count("*").alias("n"))


@_query(f"SELECT row_number() OVER (ORDER BY key) - 1 AS place, key FROM (SELECT key FROM ({w.KEYS_SQL}) ORDER BY key LIMIT 1000)")
def source_key_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the reader's: the first 1000 keys of a sorted file, in its order."""
    lines = w.keys(spark, sf_dir).where("key IS NOT NULL").orderBy("key").select(F.col("key").cast("string").alias("value"))
    first = text.read_keys(spark, _as_text(lines, "keys"), most=1000)
    return ranges.partition_sort(first.withColumn("range_id", F.lit(0))).select(F.col("slot").alias("place"), "key")


def _block_file(spark: SparkSession, sf_dir: str, width: int, half: bool = False) -> str:
    path = _file(spark, "blocks")
    coo = _coo(spark, sf_dir)
    stored = blocks.to_blocks(coo, w.M)
    stored = stored.where("brow <= bcol") if half else stored
    n = (w.vertices(spark, sf_dir).agg(F.max("id")).first()[0] // w.M + 1) * w.M
    blockmatrix.write_blocks(stored, path, n, w.M, width)
    return path


def _block_sql(top: int) -> str:
    return f"WITH s AS ({w.S_SQL}) SELECT i, k AS j, least(x, {top}) AS v FROM s WHERE x <> 0"


@_query(_block_sql(blocks.U32))
def source_blocks_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_coo(blockmatrix.read_blocks(spark, _block_file(spark, sf_dir, 4), 4, records=5000), w.M)


@_query(_block_sql(blocks.U16))
def source_blocks_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_coo(blockmatrix.read_blocks(spark, _block_file(spark, sf_dir, 2), 2), w.M)


@_query(_block_sql(255))
def source_blocks_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.to_coo(blockmatrix.read_blocks(spark, _block_file(spark, sf_dir, 1), 1), w.M)


@_query(_block_sql(blocks.U32))
def source_blocks_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the blocks are stored; the reader's caller mirrors them."""
    stored = blockmatrix.read_blocks(spark, _block_file(spark, sf_dir, 4, half=True), 4)
    return blocks.to_coo(blocks.mirror_blocks(stored, w.M), w.M)


@_query(
    f"WITH s AS ({w.S_SQL}) SELECT cast((SELECT max(p_partkey) // {w.M} + 1 FROM part) * {w.M} AS BIGINT) AS n, cast({w.M} AS BIGINT) AS m, "
    f"(SELECT count(*) FROM (SELECT DISTINCT i // {w.M}, k // {w.M} FROM s WHERE x <> 0)) AS k"
)
def source_block_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([blockmatrix.header(_block_file(spark, sf_dir, 1))], "n bigint, m bigint, k bigint")


@_query(E)
def source_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, offsets = _file(spark, "graph"), _file(spark, "offsets")
    top = w.vertices(spark, sf_dir).agg(F.max("id")).first()[0]
    adjacency.write_adjacency(written(w.edges(spark, sf_dir), "edges"), top + 1, path, offsets)
    return adjacency.read_adjacency(spark, path, offsets, vertices=500)[0]


@_query(E)
def source_adjacency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(w.edges(spark, sf_dir), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.concat_ws(" ", F.sort_array(F.collect_list("v")).cast("array<string>")).alias("near"), F.count("*").alias("n"))
    lines = near.select(F.col("u").alias("o"), F.concat_ws(" ", "u", "n", "near").alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("o"), F.lit("0 0").alias("value"))
    return adjacency.read_adjacency_text(spark, _as_text(head.unionByName(lines).orderBy("o").select("value"), "graph"))[0]


TIMINGS = ((1, 1, 64.0), (1, 2, 40.0), (2, 2, 16.0), (2, 4, 10.0), (4, 4, 8.0))


@_query(
    "WITH t(processes, threads, seconds) AS (VALUES " + ", ".join(f"({p}, {t}, cast({s} AS DOUBLE))" for p, t, s in TIMINGS) + "), x AS (SELECT *, 64.0::DOUBLE / seconds AS speedup, (processes * threads)::DOUBLE AS p FROM t) "
    "SELECT processes, threads, seconds, speedup, speedup / p AS efficiency, CASE WHEN p = 1 THEN NULL ELSE (1 / speedup - 1 / p) / (1 - 1 / p) END AS serial_fraction, p * seconds - 64.0 AS overhead FROM x"
)
def source_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "timings")
    spark.createDataFrame(TIMINGS, "processes int, threads int, seconds double").coalesce(1).write.csv(path, header=True)
    return text.read_timings(spark, path)


@_query(f"SELECT string_agg(found, ' ' ORDER BY k) AS value FROM ({' UNION ALL '.join(map(_found_sql, range(SWEEP[0], SWEEP[1] + 1)))})")
def sink_flag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(_as_text(text.flag_lines(truss_sweep(spark, sf_dir)), "flags"))


@_query(
    f"WITH {_truss_sql()}, {LABELS}, m AS (SELECT string_agg(id, ' ' ORDER BY id) AS value FROM labels GROUP BY component) SELECT cast(count(*) AS VARCHAR) AS value FROM m UNION ALL SELECT value FROM m"
)
def sink_component_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(_as_text(text.component_lines(component_members(_labels(spark, sf_dir))), "components"))


@_query(
    f"WITH {_truss_sql()}, {LABELS}, {TOUCHED}, i AS (SELECT id FROM counts WHERE n_components >= {P}) "
    "SELECT cast(count(*) AS VARCHAR) AS value FROM i UNION ALL SELECT string_agg(id, ' ' ORDER BY id) FROM i HAVING count(*) > 0"
)
def sink_influencer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(_as_text(text.influencer_lines(influencers(spark, sf_dir).select("id")), "influencers"))


@_query("SELECT * FROM (VALUES " + ", ".join(f"(cast({u} AS BIGINT), cast({v} AS BIGINT))" for u, v in sorted({(min(e), max(e)) for e in graph.SMALL_GRAPH})) + ") t(u, v)")
def graph_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.small_graph(spark)


@_query(f"SELECT {w.N_RANGES} + 1 AS n")
def range_count_with_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(ranges.count_with_dummy(w.ranges(spark)),)], "n int")


@_query(f"WITH {CLASSIFIED} SELECT pos, key, cast(0 AS INTEGER) AS range_id FROM c")
def range_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.reset(_classified(spark, sf_dir))
