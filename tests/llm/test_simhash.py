from __future__ import annotations

import random
import re

import pytest
import xxhash

from brindle.llm import simhash
from brindle.llm.components import components
from brindle.llm.queries import op10_simhash
from brindle.sources.tables import read_table


def slow_fingerprint(text, size=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    n = max(len(words) - size + 1, 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=2):
    """rows: (id, fingerprint). Breadth-first search over all pairs."""
    fps = sorted({f for _, f in rows})
    near = {f: [g for g in fps if bin(f ^ g).count("1") <= radius] for f in fps}
    root = {}
    for f in fps:
        if f in root:
            continue
        todo, seen = [f], {f}
        while todo:
            for g in near[todo.pop()]:
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        ids = [i for i, g in rows if g in seen and i is not None]
        root |= dict.fromkeys(seen, min(ids, default=None))
    return sorted(((i, f"{f:016x}", root[f]) for i, f in rows), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    rng = random.Random(radius)
    tables = simhash.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        diff = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(diff & m == 0 for m in tables)


@pytest.mark.parametrize(("radius", "small"), [(1, 4), (2, 1), (2, 1000), (3, 4)])
def test_links_join_what_pairs_join(spark, radius, small):
    rng = random.Random(small)
    fps = {0}
    for _ in range(4):
        seed = rng.getrandbits(64)
        for _ in range(40):
            fps.add(seed)
            seed ^= sum(1 << i for i in rng.sample(range(64), rng.choice([1, 2, 2, 3, 4])))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = {simhash._signed(f): f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = simhash.links(df, radius, small)
    assert all(bin(signed[u] ^ signed[v]).count("1") <= radius for u, v in links.collect())
    rooted = dict(tuple(r) for r in components(links).collect())
    want = slow_components([(s, f) for s, f in signed.items()], radius)
    assert sorted((s, f"{f:016x}", rooted.get(s, s)) for s, f in signed.items()) == sorted(want)


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    rows += [(7, 7), (None, 3), (3, None), (None, None), (5, 4), (4, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(rows, "u int, v int")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


ODD = [
    (1, "one two three four"), (2, "ONE two\tthree\nfour"), (2, "ONE two\tthree\nfour"), (3, None),
    (4, ""), (5, " \t\r\n\x0b\x0c"), (6, "two words"), (7, "É é"), (8, "word " * 30_000),
    (None, "one two three four"), (None, "alone on its own here"), (9, "a\x00b c\x1fd e"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 9) for i, t in ODD], "doc_id bigint, text string, fp int")
    want = slow_components([(i, slow_fingerprint(t)) for i, t in ODD])
    assert found(simhash.near_duplicates(df)) == want
    kept = found(simhash.without_near_duplicates(df))
    assert len(kept) == len({(c, f if c is None else 0) for _, f, c in want}) and kept[0][2] == 9
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.without_near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in read_table(spark, sf, "documents").collect()]
    assert found(op10_simhash(spark, sf)) == slow_components(rows)
