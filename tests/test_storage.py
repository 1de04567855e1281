"""Tables on the way take few files, whatever the number of shuffle partitions; no row is lost."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_graph import brute_components, random_edges

import corpus_pipeline
from tessera.functions import storage
from tessera.llm import exact_dedup, minhash, substring_dedup
from tessera.operators import components

MOST = 2 * 4  # cores of the test session


@pytest.fixture
def many(spark):
    """Many shuffle partitions that adaptive execution leaves alone."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def files(df):
    return len(df.inputFiles())


def counted(monkeypatch, *modules):
    found = []

    def written(df, name, *args, **named):
        back = storage.written(df, name, *args, **named)
        found.append((name, files(back)))
        return back

    for m in modules:
        monkeypatch.setattr(m, "written", written)
    return found


def test_files_go_by_bytes(many, tmp_path, monkeypatch):
    many.range(20_000).selectExpr("id", "cast(id % 3000 as string) as k").write.parquet(str(tmp_path / "t"))
    df = many.read.parquet(str(tmp_path / "t")).groupBy("k").count()
    want = sorted(map(tuple, df.collect()))
    assert files(storage.written(df, "all")) == 64
    few = storage.written(df, "few", few=True)
    assert files(few) <= MOST and sorted(map(tuple, few.collect())) == want
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(storage, "_PART", size // 20)
    more = storage.written(df, "more", few=True)
    assert 20 <= files(more) <= 21 and sorted(map(tuple, more.collect())) == want


def test_components(many, tmp_path, monkeypatch):
    edges = random_edges(5, 3000, 2500)
    many.createDataFrame(edges, "a long, b long").write.parquet(str(tmp_path / "links"))
    found = counted(monkeypatch, components)
    got = components.components(many.read.parquet(str(tmp_path / "links")))
    assert {r["id"]: r["component"] for r in got.collect()} == brute_components(edges)
    assert len(found) > 4 and max(n for _, n in found) <= MOST


def test_stages(many, tmp_path, monkeypatch):
    docs = many.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = counted(monkeypatch, exact_dedup, minhash, substring_dedup, components)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(many, docs, "").write.parquet(str(tmp_path / name))
        assert len(list(Path(tmp_path, name).glob("*.parquet"))) <= MOST, name
        docs = many.read.parquet(str(tmp_path / name))
    bounded = [n for name, n in found if name not in ("similar", "links", "pairs")]  # pairs meet texts there
    assert len(bounded) > 30 and max(bounded) <= MOST, found


def test_workers_files(many, tmp_path, monkeypatch):
    rows = [(i, None if i % 7 == 0 else bytes([i % 256]) * 16, (i, -i)) for i in range(5000)]
    df = many.createDataFrame(rows, "k long, sub binary, one struct<a: long, b: int>").repartition(9)
    want = sorted(map(tuple, df.collect()))
    back = storage.written(df, "made", workers=True)
    folder = Path(back._tessera_path.removeprefix("file:"))
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == want
    assert files(back) == 9 == len(list(folder.iterdir()))  # no checksums and nothing of the tasks is left
    nothing = storage.written(df.where("k < 0"), "nothing", workers=True)
    assert nothing.schema == df.schema and nothing.count() == 0
    monkeypatch.setattr(storage, "_local", lambda system, target: None)  # any other file system: Spark writes
    assert sorted(map(tuple, storage.written(df, "made", workers=True).collect())) == want


def test_files_of_lost_attempts_do_not_count(many, monkeypatch):
    real = storage._filed

    def filed(folder, step):
        lost = many.range(5).toArrow().to_batches()
        assert len(list(real(folder, None)(iter(lost)))) == 1  # a file whose name the driver never gets
        return real(folder, step)

    monkeypatch.setattr(storage, "_filed", filed)
    back = storage.written(many.range(100).repartition(3), "again", workers=True)
    assert back.count() == 100 and files(back) == 3


def test_shuffles_go_with_their_table(many):
    def shuffled():
        found = many._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    back = storage.written(many.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts", workers=True)
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and back.count() == 10
    assert many.conf.get(storage._CLEANUP, None) is None


def test_result_of_op6(many, tmp_path):
    docs = many.read.parquet("/root/testdata/sf0.001/documents.parquet")
    substring_dedup.repeats(docs).write.parquet(str(tmp_path / "op6"))
    assert len(list((tmp_path / "op6").glob("*.parquet"))) <= MOST
    assert many.read.parquet(str(tmp_path / "op6")).count() == docs.count()


CHMODS = """
import sys
from pyspark.sql import SparkSession
from tessera.llm import substring_dedup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "4").getOrCreate()
text = "".join(map(chr, range(33, 127))) * 9
docs = spark.createDataFrame([(i, text[i:] + str(i) * i) for i in range(8)], "doc_id long, text string")
assert sum(r["n_removed"] for r in substring_dedup.repeats(docs).collect()) > 4000
"""


def test_op6_starts_no_process_for_a_file(tmp_path):
    bin_, shared = tmp_path / "bin", tmp_path / "shared"
    bin_.mkdir()
    (bin_ / "chmod").write_text(f'#!/bin/sh\necho "$*" >> {tmp_path}/log\nexec /bin/chmod "$@"\n')
    (bin_ / "chmod").chmod(0o755)
    root = str(Path(storage.__file__).parents[2])
    env = os.environ | {"PATH": f"{bin_}:{os.environ['PATH']}", "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    subprocess.run([sys.executable, "-c", CHMODS, str(shared)], env=env, check=True, timeout=300)
    log = tmp_path / "log"
    assert [x for x in (log.read_text().splitlines() if log.exists() else []) if "tessera-" in x] == []
