from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from brindle.llm import suffix_dedup
from brindle.llm.queries import op7_suffix_array
from brindle.sources.tables import read_table


def slow_spans(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        flags = np.diff(np.concatenate(([0], np.frombuffer(bytes(hit), dtype=np.int8), [0])))
        out.append(list(zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist())))
    return out


def cut(text, spans):
    at, out = 0, b""
    for a, b in spans:
        out, at = out + text[at:a], b
    return out + text[at:]


@pytest.mark.parametrize("depth", [8, 20, 200])
def test_suffix_array_and_prefixes(depth):
    rng = random.Random(depth)
    for _ in range(20):
        data = bytes(rng.choices(b"ab\0", k=rng.randint(1, 400))) * rng.randint(1, 3)
        sa = suffix_dedup.suffix_array(np.frombuffer(data, dtype=np.uint8), depth)
        padded = data + b"\0" * depth
        assert sorted(sa.tolist()) == list(range(len(data)))
        keys = [padded[i : i + depth] for i in sa]
        assert keys == sorted(keys)
        starts = np.array(sorted({0, *(rng.randrange(len(data)) for _ in range(3))}))
        shared = suffix_dedup.common_prefixes(np.frombuffer(data, dtype=np.uint8), sa, starts, depth)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while n < depth and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert shared[b] == n


def texts_with_repeats(seed, length):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(60)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    shared = [make(length // 2) for _ in range(4)]
    texts = [make(30) + rng.choice(shared) + make(20) + rng.choice(shared)[: length + rng.randint(-3, 9)] for _ in range(40)]
    return texts + [texts[0], texts[0], "", "ab" * length, "x" * (3 * length), make(5), texts[1][5:], "y" * length]


@pytest.mark.parametrize(("length", "most"), [(16, 4096), (40, 2), (64, 3), (200, 1), (200, 4096)])
def test_spans_equal_brute_force(spark, length, most):
    texts = texts_with_repeats(length, length)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    df = spark.createDataFrame(df.collect(), df.schema)
    got = {r.id: [tuple(s) for s in r.spans] for r in suffix_dedup.repeated_spans(df, length, most=most).collect()}
    assert [got[i] for i in range(len(texts))] == slow_spans([t.encode() for t in texts], length)


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 300)
    texts = [t.encode() for t in texts_with_repeats(5, 64)]
    for t in texts:
        parts = list(suffix_dedup._pieces([len(t)], 64))
        starts = [a for _, fro, to in parts for a in range(fro, to - 63)]
        assert starts == list(range(max(len(t) - 63, 0)))


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (None, long, 1), (3, long, 2), (3, long, 2), (4, "é" * 150, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    got = sorted((repr(r.doc_id), r.row, [tuple(s) for s in r.spans]) for r in suffix_dedup.repeated_spans(df).collect())
    whole = [(0, 300)]
    assert got == sorted(
        [("1", 0, []), ("1", 0, []), ("2", 0, []), ("None", 1, whole), ("3", 2, whole), ("3", 2, whole), ("4", 3, whole)]
    )
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(df, 5)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents").collect()
    texts = [d.text.encode() for d in docs]
    want = []
    for d, t, spans in zip(docs, texts, slow_spans(texts, 200)):
        kept = hashlib.sha256(cut(t, spans)).hexdigest()
        want.append((d.doc_id, len(t), sum(b - a for a, b in spans), len(spans), kept))
    got = [tuple(r) for r in op7_suffix_array(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
