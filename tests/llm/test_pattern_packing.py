from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import pattern_packing as pp
from brindle.llm.queries import op11_pattern_packing
from brindle.sources.tables import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, size=1024):
    """rows of pieces; docs: (id, text) rows. The number of sequences, and the least that could hold the ids."""
    tok = Tokenizer.from_file(PATH)
    want = []
    for key, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return len(sequences), -(-sum(w[3] for w in want) // size)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    used, least = check(op11_pattern_packing(spark, sf).collect(), docs)
    assert used <= 1.005 * least


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "x \n y", "x  \n  y\n\n z", "don't I'll x'S 's", "a<|endoftext|>b", "a <|endoftext|> b",
    "a  <|endoftext|>  b", "<|endoftext|>", "end. Next, (one) \"two\"; 3.5 a1b2", "\u00e9t\u00e9. \u00fcber\u00df!", "a \u00a0b", "a  \u00a0b", "a \u3000 b",
    "\u65e5\u672c\u8a9e \u65e5\u672c", "a \u2028b", "tab\there \t there", "a\x1c b \x1fc", "\x00 \x00", "a \x85b", "\u00d7. \u00f7, a\u00d7.", "x" * 5000, " " * 5000,
    "\U0001f600 \U0001f600\U0001f600", "a .b ,c <d <|e", "z\r\n\r\n y", "1 22 333 a4 4a", "K\u212a \u017f",
]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    pieces = [*ODD[:27], " ", "  ", "\n", "\t", "word", "Word", "'s", "'", "<", ".", "\u00a0", "\u00e9", "1"]
    texts = ODD + ["".join(rng.choices(pieces, k=30)) for _ in range(400)]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = pp.Encoder(open(PATH, encoding="utf-8").read())
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == want
    column = pa.array(["zz", *texts]).slice(11, 90)
    assert [ids.tolist() for ids in encoder.encode(column)] == want[10:100]
    assert encoder.encode(pa.array([], pa.string())) == []


def made(kinds, size):
    found = np.zeros(size + 1, dtype=np.int64)
    for runs, repeat in kinds:
        assert repeat > 0 and sum(length * many for length, many in runs) <= size
        for length, many in runs:
            found[length] += many * repeat
    return found


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("times", [1, 50, 10**9])
def test_plan_holds_all_pieces_in_few_sequences(seed, times):
    rng = np.random.default_rng(seed)
    size = 256
    histogram = np.zeros(size + 1, dtype=np.int64)
    lengths = [
        rng.integers(1, size + 1, 400), rng.integers(1, 20, 400), rng.integers(140, 180, 300), np.full(500, 1), np.full(300, 100),
        np.array([size] * 9), rng.geometric(0.02, 500).clip(1, size), np.array([], dtype=np.int64),
    ][seed]
    np.add.at(histogram, lengths, times)
    kinds = pp.plan(histogram)
    assert (made(kinds, size) == histogram).all()
    used, total = sum(n for _, n in kinds), int((histogram * np.arange(size + 1)).sum())
    # pieces of over half the size need a sequence each
    least = max(-(-total // size), int(histogram[size // 2 + 1 :].sum()))
    if seed == 4:
        least = -(-300 * times // 2)
    assert used <= least * 1.02 + 1


def test_patterns_fill_a_sequence_and_are_all():
    rng = random.Random(2)
    size = 40
    histogram = np.array([0] + [rng.choice([0, 1, 3]) for _ in range(size)])
    have = [i for i in range(size + 1) if histogram[i]]
    want = {(0, 0, size)} if histogram[size] else set()
    want |= {(0, a, b) for a in have for b in have if a <= b and a + b == size}
    want |= {(a, b, c) for a in have for b in have for c in have if a <= b <= c and a + b + c == size}
    rows = [tuple(r) for r in pp.patterns(histogram).tolist()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_fit_is_that_of_least_squares():
    rng = np.random.default_rng(5)
    size = 24
    histogram = rng.integers(1, 50, size + 1)
    histogram[0] = 0
    rows = pp.patterns(histogram)
    x = pp.fitted(histogram, rows, steps=20_000)
    weight = np.sqrt(np.arange(size + 1) / size)
    table = np.zeros((size + 1, len(rows)))
    for k in range(3):
        np.add.at(table, (rows[:, k], np.arange(len(rows))), 1)
    table *= weight[:, None]
    slope = table.T @ (table @ x - histogram * weight)
    # the conditions of an optimum with x >= 0
    assert (x >= 0).all() and (slope > -0.05).all() and (np.abs(slope[x > 0.05]) < 0.05).all()


def test_odd_rows(spark):
    rng = random.Random(1)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "word " * 9000), (5, "x" * 30_000), (None, "a. b."), (None, None), (6, "<|endoftext|>")]
    docs += [(7, "same text")] * 5 + [(k, t) for k, t in enumerate(ODD, 100)]
    docs += [(k, " ".join(rng.choices(["alpha", "beta", "x"], k=rng.randrange(900)))) for k in range(200, 260)]
    df = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id int, text string, part int, length int")
    got = pp.packed(df, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(got.collect(), docs)
    check(pp.packed(df, PATH, size=7).collect(), docs, size=7)
    assert pp.packed(df.limit(0), PATH).count() == 0


def test_known_parts_are_kept_in_one_table(monkeypatch):
    monkeypatch.setattr(pp.pc, "index_in", lambda *_, **__: pytest.fail("all that is known is hashed again"))
    encoder = pp.Encoder(open(PATH, encoding="utf-8").read())
    tok = Tokenizer.from_file(PATH)
    for text in ("one two. three!", "two four? é 日本", "", "  ...", "one"):
        assert encoder.encode(pa.array([text]))[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_tasks_of_a_process_share_what_is_known(monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    plain = Tokenizer.from_file(PATH)
    texts = ["some words, and more words", "more words\n and others", "", "words again"]
    right = lambda some: [plain.encode(t, add_special_tokens=False).ids for t in some]
    pp._encoder.cache_clear()
    assert [x.tolist() for x in pp._encoder(content).encode(pa.array(texts))] == right(texts)
    # the next task has another copy of the file's content
    again = pp._encoder("".join(list(content)))
    known = len(again._known)
    assert known and [x.tolist() for x in again.encode(pa.array(texts[::-1]))] == right(texts[::-1])
    assert len(again._known) == known
    monkeypatch.setattr(pp, "_KNOWN", 2)
    assert [x.tolist() for x in again.encode(pa.array(texts))] == right(texts)
    pp._encoder.cache_clear()
