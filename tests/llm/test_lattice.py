from __future__ import annotations

import os
import random
import uuid

import public_tokenizers
import pytest
import sentencepiece
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from brindle.llm import lattice
from brindle.llm.queries import op3_relational_lattice
from brindle.sources.tables import read_table

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = lattice.read_model(PATH)
ODD = [
    None, "", " ", "  a  b ", "a\nb\n\n c", "▁x", "x▁▁y", "é日​ \t", "<s>hi</s> <unk> <0x41>", "ﬁ Ａ é\x00",
    "x" * 5000, "ab" * 31, "ab" * 29, "characteristics MERCHANTABILITY " * 3, " " * 100, "=" * 300, "word " * 20_000, "日本語" * 30,
]


def test_ids_equal_sentencepiece(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choices("abcdehinorst  ▁\n.,é", k=rng.randint(1, 150))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "no id", 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, word int")
    done = lattice.encoded(df, PIECES).collect()
    got = {r.doc_id: r for r in done}
    assert len(done) == len(rows) and sum(r.doc_id == 3 for r in done) == 2
    for i, t, _ in rows:
        assert list(got[i].ids) == sp.encode(t or ""), (t or "")[:60]
        assert got[i].decodes
    assert lattice.encoded(df.limit(0), PIECES).count() == 0
    back = lattice.decoded(spark.createDataFrame(done), PIECES).collect()
    assert {r.doc_id: r.text for r in back} == {i: (t or "").replace("▁", " ") for i, t, _ in rows}
    broken = spark.createDataFrame([(1, [3 + 0xC3, 99_999]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in lattice.decoded(broken, PIECES).collect()) == [(1, "�"), (2, ""), (3, "")]


def slow_viterbi(word, scores):
    best = [(0.0, [])]
    low = min(scores.values()) - 10
    for j in range(1, len(word) + 1):
        options = []
        for i in range(j):
            p = word[i:j]
            if p in scores or j - i == 1:
                options.append((best[i][0] + scores.get(p, low), i, best[i][1] + [p]))
        score, _, path = max(options)
        best.append((score, path))
    return best[-1][1]


def test_unigram_fold_is_viterbi(spark):
    rng = random.Random(7)
    names = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40)} | {"a", "b", "▁"}
    pieces = [(f"<0x{b:02X}>", 3 + b, 0.0, f"{b:02X}") for b in range(256)]
    scores = {n: round(rng.uniform(-9, -1), 6) for n in sorted(names)}
    pieces += [(n, 300 + k, s, n.encode().hex().upper()) for k, (n, s) in enumerate(scores.items())]
    ids = {p: i for p, i, *_ in pieces}
    texts = ["".join(rng.choices("abcxé ", k=rng.randint(0, 70))) for _ in range(40)] + ["abc" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in lattice.encoded(df, pieces, "unigram").collect():
        want = []
        for w in _words(texts[r.doc_id]):
            for p in slow_viterbi(w, scores):
                want += [ids[p]] if p in ids else [3 + b for b in p.encode()]
        assert list(r.ids) == want


def _words(text):
    import re

    return re.findall("▁+[^▁\n]*|[^▁\n]+|\n", "▁" + text.replace(" ", "▁")) if text else []


def test_query_equals_sentencepiece(spark):
    sf = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    rows = op3_relational_lattice(spark, sf).select("doc_id", "n_ids", "ids", "decodes").collect()
    assert len(rows) == len(text)
    assert all(list(r.ids) == sp.encode(text[r.doc_id]) and r.n_ids == len(r.ids) and r.decodes for r in rows)


def test_words_are_not_shuffled_again(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = lattice.encoded(df, PIECES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_query_shuffles_less_than_its_input(spark, conf):
    sf = "/root/testdata/sf0.01"
    conf(shuffle__partitions=12)
    files = lambda: {f.toString(): f.length() for f in _shuffled(spark)}
    before = files()
    done = op3_relational_lattice(spark, sf)
    done.write.format("noop").mode("overwrite").save()
    written = sum(n for f, n in files().items() if f not in before)
    assert 0 < written < 1.5 * os.path.getsize(f"{sf}/documents.parquet")


def _shuffled(spark):
    all_ = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [all_.apply(k) for k in range(all_.length())]


def test_edges_are_not_kept_for_sorting_or_grouping(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = lattice.encoded(df, PIECES)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Sort [") == plan.count("Sort [cell") == 1


def test_documents_that_change_while_they_are_read_are_an_error(spark):
    drawn = F.udf(lambda n: uuid.uuid4().hex).asNondeterministic()
    df = spark.range(300).select(F.col("id").alias("doc_id"), drawn("id").alias("text"))
    with pytest.raises(PythonException, match="changed while"):
        lattice.encoded(df, PIECES).collect()


def test_words_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(lattice, "EDGES", 50)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [f"same words {k % 7} in every cell" + " é日" * (k % 3) for k in range(100)] + [None, "", "x" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(9).cache()
    for r in lattice.encoded(df, PIECES).collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id] or "") and r.decodes
