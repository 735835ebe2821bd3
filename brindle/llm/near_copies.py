"""Near copies: texts whose sets of word shingles have a Jaccard likeness of 0.8 or more.

Shingles. Words are those of ``simhash``: A-Z lower-cased, runs of anything but space
and x09-x0D. A text is the set of the XXH64 hashes of its shingles of ``size`` words; one
with fewer words has one shingle, all its words, and one without words the empty set,
which is a copy of other empty sets only.

Candidates. SimHash fingerprints of the sets within ``RADIUS`` bits, found by the covering
masks of ``simhash``, join copies with small changes. At a likeness of 0.8 about ten
of the 64 bits differ, and covering that many would take 2047 tables. So there are MinHash
keys besides: ``BANDS`` keys of ``ROWS`` least hashes each. A pair at likeness s
shares none of them with a chance of (1 - s^ROWS)^BANDS: 6 in 100,000 at 0.8, less
above. That is the only loss. Equal sets are reduced to one before.

Verification. Every link is a pair whose sets themselves have been compared. First each
set is compared with the heads of its fingerprint and its buckets. A head is the member that
meets most others over all its buckets: of near copies the one least changed, so a group has
few heads and most of its members link to one of them at once.

What is left are sets that share a bucket with one of another group. They are joined
exactly, by prefixes: with the shingles of a set in the order of how many such sets hold
them, a pair at likeness t must share one of the first n - ceil(t n) + 1 of the n of either.
A shingle that no other set holds can be in no common part, so a set with many of its own has
no prefix left, and m of n and l of k shingles that others hold allow a likeness of
min(m, l) / (n + k - min(m, l)) at most. A shingle that many share, as of a header, comes last and
is never such a key. Within a key, members of its largest group are compared with those of
other groups only. In the join itself pairs are held against bit maps: every shingle turns
one of at least 2 n bits, so where d bits of two maps differ, the sets differ in d shingles or
more, and a likeness of t allows (n + k) (1 - t) / (1 + t). So texts that are all somewhat
alike, but less than t, make hardly any candidates, whatever their number.

The sets of candidates alone are shuffled, those of other texts never leave their task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, checkpointed, dealt, fresh, text_of
from brindle.llm.components import components
from brindle.llm.simhash import _LOWER, links, majority

SEED = 42
BANDS, ROWS = 32, 6
#: Bits in which the SimHash fingerprints of copies may differ.
RADIUS = 2
#: Shingles whose least hashes are taken at a time: BANDS * ROWS * 4 bytes each.
_BLOCK = 2048


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - size, 0)
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: last + 1].tolist(), ends[-(last + 1) :].tolist())
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in pairs], dtype="<u8"))


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """A factor and a summand for each of the orders of hashes."""
    rng = np.random.default_rng(SEED)
    factor, summand = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return factor | np.uint32(1), summand


def band_keys(found: np.ndarray) -> list[int]:
    """The keys of a set, as signed integers."""
    factor, summand = _orders()
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype="<u4")
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), _BLOCK):
        np.minimum(least, (short[None, k : k + _BLOCK] * factor + summand).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), SEED) for k in range(0, BANDS * ROWS, ROWS)]
    return np.array(keys, dtype="<u8").view("<i8").tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sets given as sorted arrays; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def _digested(size: int):
    """A UDF: digest, number of shingles, fingerprint and keys of each text."""

    @F.pandas_udf("u binary, n bigint, fp bigint, keys array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingles(text, size)
            fp = int(np.uint64(majority(found)).astype(np.int64))
            rows.append((xxhash.xxh3_128_digest(found.tobytes(), SEED), len(found), fp, band_keys(found)))
        return pd.DataFrame(rows, columns=["u", "n", "fp", "keys"])

    return of


def _set_of(size: int):
    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size).view("<i8") for t in texts], dtype=object)

    return of


def _bit_map():
    """A UDF: of a set the bits that an odd number of its shingles has, at least two for each shingle."""

    @F.pandas_udf("array<bigint>")
    def of(sets: pd.Series) -> pd.Series:
        out = []
        for found in sets:
            found = found.astype(np.int64).view(np.uint64)
            size = 1 << max(len(found) - 1 >> 5, 0).bit_length()
            words = np.zeros(size, dtype=np.uint64)
            bits = np.uint64(1) << (found & np.uint64(63))
            np.bitwise_xor.at(words, ((found >> np.uint64(6)) & np.uint64(size - 1)).astype(np.int64), bits)
            out.append(words.view(np.int64))
        return pd.Series(out, dtype=object)

    return of


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two maps differ, the larger one folded to the size of the other: never more than shingles."""
    least = F.least(F.size(a), F.size(b))

    def folded(x):
        halves = F.zip_with(F.slice(x, 1, least), F.slice(x, least + 1, least), lambda y, z: y.bitwiseXOR(z))
        return F.when(F.size(x) > least, halves).otherwise(x)

    counts = F.zip_with(folded(a), folded(b), lambda y, z: F.bit_count(y.bitwiseXOR(z)))
    return F.aggregate(counts, F.lit(0), lambda done, n: done + n)


def _likeness():
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")

    return of


def _verified(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Those of the pairs ``u``, ``v`` whose sets are as alike as ``likeness``."""
    both = pairs.join(sets.select("u", F.col("set").alias("a")), "u").join(
        sets.select(F.col("u").alias("v"), F.col("set").alias("b")), "v"
    )
    return both.where(_likeness()("a", "b") >= likeness).select("u", "v")


def _close_prints(least: DataFrame, radius: int) -> DataFrame:
    """Pairs ``u``, ``v`` of ``least`` (u, fp) that join all fingerprints within ``radius`` bits."""
    prints = checkpointed(least.groupBy("fp").agg(F.min("u").alias("head")))
    near = links(prints.select("fp"), radius).toDF("a", "b")
    equal = least.join(prints, "fp").where("u <> head").select("u", F.col("head").alias("v"))
    others = near.join(prints.toDF("a", "u"), "a").join(prints.toDF("b", "v"), "b").select("u", "v")
    return equal.unionByName(others)


def _prefix_pairs(left: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Pairs ``u``, ``v`` of ``left`` (u, n, root), a checkpoint, of different roots that may be as alike as ``likeness``: none is missed."""
    # rows of two numbers for each shingle: what else is known of a set is joined to its few keys
    numbered = left.withColumn("i", F.monotonically_increasing_id())
    mine = numbered.join(sets, "u")
    about = mine.select("i", "u", "n", "root", _bit_map()("set").alias("bits"))
    held = mine.select("i", F.explode("set").alias("x"))
    common = held.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("i")
    ranked = (
        held.join(dealt(common), "x")
        .withColumn("place", F.row_number().over(own.orderBy("df", "x")))
        .withColumn("m", F.count("*").over(own))
    )
    # own shingles come first: of the others the first m - ceil(t n) + 1 are left
    keys = checkpointed(
        ranked.join(numbered.select("i", "n", "root"), "i")
        .where(F.col("place") <= F.col("m") - F.ceil(F.col("n") * likeness - 1e-6) + 1)
        .select("x", "i", "m", "root")
    )
    roots = keys.groupBy("x", "root").agg(F.count("*").alias("many"))
    largest = roots.groupBy("x").agg(F.max_by("root", F.struct("many", "root")).alias("largest"), F.count("*").alias("roots"))
    mixed = dealt(largest.where("roots > 1").select("x", "largest"))
    every = checkpointed(keys.drop("root").join(mixed, "x").join(about, "i").drop("i"))
    others = every.where("root <> largest").select(
        "x", F.col("u").alias("v"), F.col("n").alias("k"), F.col("m").alias("l"), F.col("root").alias("other"),
        F.col("bits").alias("map"),
    )
    both, able = F.col("n") + F.col("k"), F.least("m", "l") * (1 + likeness)
    apart = _bits_apart(F.col("bits"), F.col("map")) * (1 + likeness)
    return (
        every.drop("largest")
        .join(others, "x")
        .where((F.col("root") != F.col("other")) & (able >= both * likeness - 1e-6) & (apart <= both * (1 - likeness) + 1e-6))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def near_copies(
    docs: DataFrame, size: int = 5, likeness: float = 0.8, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id`` and ``component_id`` of every row of ``docs``, which must be stable.

    ``id`` must tell rows apart and have an order. ``component_id`` is the least id of
    all rows that a chain of near copies joins. A null text is empty, and empty texts are copies
    of each other. No rows: no rows. Other columns are not looked at. Lowers the session's
    Arrow batch limits.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    rows = checkpointed(texts.select("id", _digested(size)("text").alias("d")).select("id", "d.*"))
    least = checkpointed(rows.groupBy("u").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = least.select("u", "n", F.posexplode("keys").alias("t", "key"))
    several = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    # most sets share no bucket: what is left is cut off here
    shared = checkpointed(keyed.join(several, ["t", "key"]))
    met = shared.groupBy("u").agg(F.sum("size").alias("met"))
    heads = (
        shared.join(met, "u")
        .groupBy("t", "key")
        .agg(F.max(F.struct("met", F.xxhash64("u").alias("order"), "u", "n")).alias("head"))
        .select("t", "key", F.col("head.u").alias("head"), F.col("head.n").alias("head_n"))
    )
    able = F.least("n", "head_n") >= likeness * F.greatest("n", "head_n") - 1e-6
    close = _close_prints(least.select("u", "fp"), RADIUS)
    first = checkpointed(
        shared.join(dealt(heads), ["t", "key"])
        .where((F.col("u") != F.col("head")) & able)
        .select("u", F.col("head").alias("v"))
        .unionByName(close)
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    needed = shared.select("u").unionByName(first.select("u")).unionByName(first.select(F.col("v").alias("u"))).distinct()
    sets = checkpointed(
        texts.join(least.join(needed, "u", "left_semi").select("u", F.col("least").alias("id")), "id").select(
            "u", _set_of(size)("text").alias("set")
        )
    )
    stars = checkpointed(_verified(first, sets, likeness))
    rooted = (
        shared.join(components(stars).withColumnRenamed("node", "u"), "u", "left")
        .select("t", "key", "u", "n", F.coalesce("root", "u").alias("root"))
    )
    mixed = rooted.groupBy("t", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    left = checkpointed(
        rooted.join(dealt(mixed.select("t", "key")), ["t", "key"], "left_semi").select("u", "n", "root").distinct()
    )
    rest = _prefix_pairs(left, sets, likeness)
    found = components(stars.unionByName(_verified(rest, sets, likeness)))
    groups = least.join(found.withColumnRenamed("node", "u"), "u", "left").select(
        "u", "least", F.coalesce("root", "u").alias("root")
    )
    ids = groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("u", "component_id")
    return rows.join(ids, "u").select(F.col("id").alias(id), "component_id")


def without_near_copies(
    docs: DataFrame, size: int = 5, likeness: float = 0.8, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The row of ``docs`` with the least id (null first) from each group, with all its columns.

    Of rows that share that id one stays. ``docs`` must be stable, such as files or
    a checkpoint: rows are told apart by their place.
    """
    row = fresh(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    groups = near_copies(
        placed.select(F.struct(F.col(id).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text).alias("text")),
        size, likeness, "id", "text",
    )
    kept = groups.select(F.col("component_id.row").alias(row)).distinct()
    return placed.join(kept, row, "left_semi").drop(row)
