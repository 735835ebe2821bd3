from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import importance
from brindle.llm.queries import ORACLE_SQL, op12_position_crc
from tests.llm.sql import same_as_sql


def slow_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_features(text, orders):
    w = slow_words(text)
    return [" ".join(w[k : k + n]) for n in range(orders[0], orders[1] + 1) for k in range(len(w) - n + 1)]


def slow_resampled(docs, target, percent=10, least=20, orders=(1, 1), buckets=10_000, seed=2024):
    """docs: (id, text) rows. Rows of id, n_words, n_features, weight, score, rank."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in slow_features(x, orders)) for texts in ([x for _, x in docs], target))
    every_s, every_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * every_s / ((s[b] + 1) * every_t)))
    rows = []
    for key, x in docs:
        found = slow_features(x, orders)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append((key, len(slow_words(x)), len(found), weight, score))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    chosen = percent * len(able) // 100
    ranked = [(*r, k if k <= chosen else None) for k, r in enumerate(able, 1)]
    return sorted(ranked + [(*r, None) for r in rows if r[1] < least], key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_crc_of_any_spans():
    rng = random.Random(1)
    raw = rng.randbytes(20_000)
    sizes = [0, 1, 3, 4, 63, 64, 65, 127, 128, 129, 1000, 4096, 15_000]
    starts = [rng.randrange(len(raw)) for _ in range(400)]
    ends = [min(a + rng.choice(sizes), len(raw)) for a in starts]
    got = importance.crc32_of_spans(np.frombuffer(raw, dtype=np.uint8), np.array(starts), np.array(ends))
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]
    none = np.zeros(0, dtype=np.int64)
    assert importance.crc32_of_spans(np.frombuffer(raw, dtype=np.uint8), none, none).tolist() == []


ODD = [
    "", "a", "Ab", " ", "\x00\x7f", "one two", "two", "x" * 10_000 + " y", "\u00c9t\u00e9 \u00e9T\u00c9", "a\u3000b",
    "K2\u212a 3", "@[`{", "tail word", "word", "\U0001f600", "end.",
]


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2), (3, 4)])
def test_features_equal_brute_force(orders):
    texts = pa.array(ODD * 2)
    for column in (texts, texts.slice(3, 11), texts.slice(0, 0), pa.array(["", ""])):
        words = importance.words_of(column)
        for n, (crc, own) in enumerate(importance.features_of(words, orders), orders[0]):
            want = [(zlib.crc32(f.encode()), i) for i, x in enumerate(column.to_pylist()) for f in slow_features(x, (n, n))]
            assert list(zip(crc.tolist(), own.tolist())) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    same_as_sql(op12_position_crc(spark, sf), ORACLE_SQL["op12_position_crc"], sf)


@pytest.mark.parametrize("orders", [(1, 1), (1, 2)])
def test_odd_rows(spark, orders):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=n))
    rows = [(i, text(rng.choice([0, 5, 19, 20, 60]))) for i in range(200)]
    rows += [(None, None), (None, text(30)), (7, rows[7][1]), (7, rows[7][1]), (500, None)] + list(enumerate(ODD, 600))
    target = [text(40), None, "", "omega omega"]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id bigint, text string, rank int, __place string")
    more = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(df, more, percent=30, orders=orders)
    assert found(got) == slow_resampled(rows, target, percent=30, orders=orders)
    assert importance.resampled(df.limit(0), more).count() == 0
    assert found(importance.resampled(df, more.limit(0))) == slow_resampled(rows, [])


def test_drawn_rows_keep_their_columns(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["red", "green", "blue"], k=25)), f"s{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __row string")
    target = spark.createDataFrame([("red red red",)], "text string")
    want = {r[0] for r in slow_resampled([r[:2] for r in rows], ["red red red"]) if r[-1]}
    got = importance.drawn(df.coalesce(2), target)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {r for r in rows if r[0] in want}
