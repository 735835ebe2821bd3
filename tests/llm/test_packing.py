from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing
from brindle.llm.queries import op5_order_preserving_packing
from brindle.sources.tables import read_table

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, size=4096, most_padding=0.03):
    """rows of pieces; docs: {id: text}."""
    tok = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == docs.keys()
    for key, text in docs.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(pieces[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            part = np.array(ids[at : at + p.length], dtype="<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
        total += at
    assert padding <= most_padding * total
    return padding, total


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    check(op5_order_preserving_packing(spark, sf).collect(), docs, most_padding=0.01)


def test_encoder_equals_the_tokenizer():
    texts = [
        "", " ", "\n\n", "It's 42% — Ünḯ ΣΑΣ don't\tx y z", "a<|endoftext|>b <|startoftext|>", "é ́x",
        "<|endoftext|>", "x" * 5000, "a  b\r\nc\x1fd\x00e", "日本語のテキスト。次", "ʼn İ ﬁ", "no.end! (yes?) \"so.\" 3.5",
    ]
    tok = Tokenizer.from_file(PATH)
    marks = ["H\u0331o", "it's.'s,'S", "<|ENDOFTEXT|>", "<|endoftext|>.", "x<|endoftext|", "Don't!!!", "a1.b2?c3", "'", "K2\u212a."]
    texts += ["".join(random.Random(i).choices([*marks, " ", "\n", "Word", "é", "...", "ſ"], k=40)) for i in range(50)]
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    found = encoder.encode(pa.array(texts))
    assert [ids.tolist() for ids, _ in found] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids, _ in encoder.encode(pa.array(texts))] == [ids.tolist() for ids, _ in found]
    assert all((np.diff(stops, prepend=0) >= 0).all() for _, stops in found)
    assert encoder.encode(pa.array(["one two. three"]))[0][1].tolist() == [3]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    size = 2048
    at = np.array([0, *np.cumsum([rng.choice([1, 30, 256, 512, 700, size]) for _ in range(40)])])
    price = np.array([0] + [rng.choice([0, 16, 64]) for _ in at[1:]])
    ends, cost = packing.best_cuts(at, price, size)
    best = [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= size:
                free = n & (n - 1) == 0 and n >= packing.LEAST
                options.append(best[i] + (0 if free else size - n) + packing.SEQUENCE + price[j])
        best.append(min(options))
    assert cost == best[-1] and ends[-1] == len(at) - 1
    assert all(at[b] - at[a] <= size for a, b in zip([0, *ends], ends))


def test_odd_rows(spark):
    long = "word " * 40_000 + "." * 3
    docs = {1: None, 2: "", 3: " \n", 4: long, 5: "x" * 100_000, None: "a. b. c.", 6: "<|endoftext|>"}
    df = spark.createDataFrame([(k, v, 7) for k, v in docs.items()], "doc_id int, text string, length int")
    check(packing.packed(df.coalesce(1), PATH).collect(), docs)
    assert packing.packed(df.limit(0), PATH).count() == 0
    twice = packing.packed(df.where("doc_id = 2").union(df.where("doc_id = 2")).coalesce(1), PATH).collect()
    assert [(r.doc_id, r.length, r.offset) for r in twice] == [(2, 1, 0), (2, 1, 1)]


def test_tail():
    assert packing._tail(4096, 4096) == [4096] and packing._tail(4000, 4096) == [4000]
    assert packing._tail(700, 4096) == [512, 128, 32, 16, 8, 4]


def test_known_parts_are_looked_up_once_for_each_text(monkeypatch):
    calls = []
    look_up = packing.pc.index_in
    monkeypatch.setattr(packing.pc, "index_in", lambda *a, **k: calls.append(len(a[0])) or look_up(*a, **k))
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    tok = Tokenizer.from_file(PATH)
    for text in ("one two. three!", "two four? (five) …\u201d six\u2026", "", "...", "one"):
        assert encoder.encode(pa.array([text]))[0][0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(calls) == 5
    stops = encoder.encode(pa.array(["a. b\u2026 c\u201d d.\u201d e\xbb f!) g\u2019 h"]))[0][1]
    assert len(stops) == 4
