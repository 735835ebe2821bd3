from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

ROOT = Path(__file__).resolve().parents[1]
SPARK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT"}


def duck(sf_dir, sql):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con.sql(sql)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.dtypes == [("n_name", "string"), ("revenue", "decimal(38,4)"), ("n", "bigint")]
    assert df.count() == 25


#: The queries whose tests are here; others bring their own.
OWN = ["revenue_by_nation"]


def test_registered_queries():
    assert set(OWN) <= driver.oracle_sql().keys() <= driver.queries().keys()
    assert all(map(callable, driver.queries().values()))


def test_removed_modules_are_left_out_and_broken_ones_are_not(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "broken_module.py").write_text("import not_installed_anywhere")
    assert driver._optional("no_such_module") is None
    assert driver._optional("brindle.no_such_package.queries") is None
    with pytest.raises(ModuleNotFoundError):
        driver._optional("broken_module")


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf_dir, name):
    df = driver.queries()[name](spark, sf_dir)
    oracle = duck(sf_dir, driver.oracle_sql()[name])
    assert oracle.columns == df.columns
    assert [str(t) for t in oracle.types] == [
        SPARK_TYPES.get(t, t.upper()) for _, t in df.dtypes
    ]
    rows = [tuple(r) for r in df.collect()]
    assert rows
    assert sorted(rows) == sorted(oracle.fetchall())


def test_bench_prints_one_json_line():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": ",".join(OWN)}
    run = subprocess.run(
        [sys.executable, "bench.py"],
        cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=True,
    )
    (line,) = run.stdout.splitlines()
    report = json.loads(line)
    assert report["sf"] == "0.001" and report["unit"] == "sec"
    assert list(report["queries"]) == OWN
    assert report["value"] == pytest.approx(sum(report["queries"].values()))
