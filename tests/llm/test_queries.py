from __future__ import annotations

import re

import __spark_entry__ as driver
import corpus_pipeline
from brindle.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert ORACLE_SQL.keys() <= QUERIES.keys() <= driver.queries().keys()
    assert driver.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in driver.oracle_sql()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix_array", "secrets", "packing"]
