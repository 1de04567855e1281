import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTERED = sorted(entry.queries())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(REGISTERED)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "n_components"]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in frame.select(*columns).collect())


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    root = Path(entry.ROOT)
    for p in root.iterdir():
        if p.name in ("tests", "corpus_pipeline.py") or p.name.startswith("."):
            continue
        if p.name == "tessera":
            (tmp_path / "tessera").mkdir()
            for q in p.iterdir():
                if q.name not in ("llm", "__pycache__"):
                    os.symlink(q, tmp_path / "tessera" / q.name)
        else:
            os.symlink(p, tmp_path / p.name) if p.name != "__spark_entry__.py" else (tmp_path / p.name).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 25 and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env).returncode == 0
