from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import near_copies
from brindle.llm.common import written
from brindle.sources.tables import read_table
from tests.llm.brute_force import slow_kept
from tests.llm.test_pipeline import SF


def test_stage_removes_near_copies_of_five_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(900)]
    texts, change = {}, lambda w, n: [rng.choice(words) if k in at else x for at in [set(rng.sample(range(len(w)), n))] for k, x in enumerate(w)]
    base = [rng.choices(words, k=300) for _ in range(6)]
    for k, w in enumerate(base):
        for n in (0, 1, 3, 5, 12, 30):
            texts[100 * k + n] = " ".join(change(w, n))
    # a header that many share, and a large group of near copies
    header = " ".join(rng.choices(words, k=60))
    texts |= {1000 + k: header + " " + " ".join(rng.choices(words, k=90)) for k in range(60)}
    texts |= {2000 + k: " ".join(change(base[0][::-1], 3)) for k in range(120)}
    texts |= {3000: "", 3001: None, 3002: "two words", 3003: "Two  words", 3004: "one two words"}
    df = written(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect()}
    assert got == slow_kept(texts)
    assert all({100 * k + n for n in (1, 3, 5)}.isdisjoint(got) and 100 * k + 30 in got for k in range(6))


def test_stage_equals_all_pairs_on_the_given_table(spark):
    docs = read_table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()}
    assert got == slow_kept(texts)


def test_keys_of_near_copies_meet():
    rng = random.Random(8)
    missed = 0
    for _ in range(400):
        common = [rng.getrandbits(64) for _ in range(400)]
        a, b = (near_copies.np.array(sorted(common + [rng.getrandbits(64) for _ in range(50)]), dtype="<u8") for _ in range(2))
        assert near_copies.jaccard(a, b) == 0.8
        missed += not any(x == y for x, y in zip(near_copies.band_keys(a), near_copies.band_keys(b)))
    assert missed <= 1


def test_bit_maps_tell_no_more_than_the_sets(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 5, 32, 33, 64, 65, 146, 700):
        for _ in range(6):
            a = {rng.getrandbits(64) - 2**63 for _ in range(n)}
            b = set(rng.sample(sorted(a), int(n * 0.85))) | {rng.getrandbits(64) - 2**63 for _ in range(rng.randint(0, n // 4))}
            rows.append((sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    of = near_copies._bit_map()
    got = df.select(of("a").alias("x"), of("b").alias("y"), F.size("a"), F.size("b")).select(
        near_copies._bits_apart(F.col("x"), F.col("y")), "*"
    )
    for row, (a, b) in zip(got.collect(), rows):
        apart = len(set(a) ^ set(b))
        assert 0.6 * apart <= row[0] <= apart and len(row.x) * 64 >= 2 * len(a)


def test_a_cloud_of_texts_below_the_threshold(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(500)]
    base = rng.choices(words, k=150)
    texts = {}
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6, 7])):
            w[at] = rng.choice(["one", "two", words[k % 7]])
        texts[k] = " ".join(w)
    df = written(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect()}
    assert got == slow_kept(texts) and 20 < len(got) < 280
