from __future__ import annotations

import corpus_pipeline
from brindle.llm import quality
from brindle.llm.common import written
from brindle.sources.tables import read_table
from tests.llm.brute_force import slow_kept
from tests.llm.test_packing import check
from tests.llm.test_secrets import slow_base
from tests.llm.test_suffix_dedup import slow_spans

SF = "/root/testdata/sf0.01"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def kept(raw, spans):
    at, parts = 0, []
    for a, b in [*spans, (len(raw), len(raw))]:
        parts.append(raw[at:a].decode("utf-8", "ignore"))
        at = b
    return "".join(parts)


def mask(text):
    at, out = 0, ""
    for a, _, b in slow_base(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_every_stage_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, results[-1] if results else docs, SF))
        results.append(now)
    assert all(r.columns == docs.columns for r in results[:-1])
    good, single, cut, masked = map(rows, results[:-1])

    scored = quality.scored(docs, read_table(spark, SF, "labels")).collect()
    assert good.keys() == {r.doc_id for r in scored if r.predicted} and len(good) < len(scored)

    assert single.keys() == slow_kept({i: r.text for i, r in good.items()}) and len(single) < len(good)
    assert all(single[i] == good[i] for i in single)

    raw = {i: r.text.encode() for i, r in single.items()}
    want = {i: kept(t, s) for (i, t), s in zip(raw.items(), slow_spans(list(raw.values()), 200))}
    assert {i: r.text for i, r in cut.items()} == want and want != {i: r.text for i, r in single.items()}

    assert {i: r.text for i, r in masked.items()} == {i: mask(t) for i, t in want.items()}
    assert all(len(r.text) == r.n_chars for r in masked.values())
    check(results[-1].collect(), {i: r.text for i, r in masked.items()})


def test_run_gives_the_last_stage(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert df.count()


def test_odd_rows_pass_every_stage(spark):
    long = "A very long text of plain words. " * 20
    rows = [
        (1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", "en", "s", 0), (3, long, "en", "s", 9),
        (3, long, "en", "s", 9), (4, "token = abcdefghijklmnop " + long[:300], "en", "s", 9), (5, "x" * 9000, "en", "s", 9),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    for given in (docs, docs.limit(0), docs.withColumns({c: docs.n_chars for c in ("row", "spans", "__Secrets", "fp", "label")})):
        now = written(given)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, "/root/testdata/sf0.001"))
            assert now.columns == given.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
