from __future__ import annotations

import zlib

import numpy as np

from brindle.llm import quality
from brindle.llm.queries import op1_compression_classifier
from brindle.sources.tables import read_table

DOCS = "doc_id bigint, text string, lang string, score double"
LABELS = "doc_id bigint, quality int"


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op1_compression_classifier(spark, sf).collect()
    assert len(rows) == read_table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}
    held = [(r, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert np.mean([r.predicted for r, y in held if y == 1]) > 0.985


def test_score_equals_brute_force(spark):
    docs = [(i, ("good words here " if i % 2 else "BAD!! $$$ ") * (1 + i % 7) + str(i), "en", 1.0) for i in range(80)]
    docs += [(500, None, "en", 0.0), (501, "", None, None), (None, "good words", "en", 0.0), (0, "BAD!!", "en", 0.0)]
    labels = [(i, i % 2) for i in range(80)] + [(3, 1), (5, 0), (None, 1), (7, None), (9, 4), (999, 0)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    known = quality.labelled_documents(d, lab)
    seen = {r.doc_id: r.label for r in known.collect()}
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 and i != 5]
    assert seen == {i: i % 2 for i in ids}
    model = quality.fit(known)
    bad, good = quality._compressor(model.bad), quality._compressor(model.good)
    for row, (_, text, _, _) in zip(quality.scored(d, lab).collect(), docs):
        raw = (text or "").encode()
        x = sum(len(bad.compress(raw[i : i + 1024])) - len(good.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
        z = np.dot(model.weights, [1, 100 * x / (len(raw) + 64), 1 / (1 + len(raw) / 100)])
        assert abs(row.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert quality.without_rejects(d, lab).columns == d.columns


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a text", "en", 0.0), (2, None, "en", 0.0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in quality.scored(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], LABELS)
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, one).collect())
    assert quality.scored(docs.limit(0), one).count() == 0


def test_dictionary_is_bounded():
    rows = [[str(i) * 500] * quality.PASSAGES for i in range(3000)]
    assert len(quality._dictionary(rows)) <= quality.DICTIONARY
    assert quality._dictionary([]) == b""
    assert quality._dictionary([["a", "b"] + ["b"] * 6, ["a", "b"] + ["b"] * 6]) == b"a\nb"


def test_passages_of_every_place_have_like_shares():
    rows = [[f"{place} of text {i} " * 20 for place in range(quality.PASSAGES)] for i in range(3000)]
    kept = [p[:1] for p in quality._dictionary(rows).decode().split("\n")]
    shares = [kept.count(str(place)) / len(kept) for place in range(quality.PASSAGES)]
    assert len(kept) > 1000 and all(0.08 < share < 0.17 for share in shares)
