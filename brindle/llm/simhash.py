"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints. A-Z are lower-cased, words are runs of anything but space and
x09-x0D, and every shingle of ``size`` words, repeats included, is hashed by
XXH64 with seed 42. A bit of the fingerprint is 1 if it is set in over half the
hashes. A text with fewer words has one shingle, all its words. A text with no
words, null or empty, has fingerprint zero, which links like any other.

Links. Fingerprints link at ``radius`` or fewer differing bits. Each bit
position i has a fixed vector a(i) of radius + 1 bits; the mask for a non-zero
vector v keeps the bits with <a(i), v> = 1 modulo 2. Any ``radius`` positions
span fewer dimensions than a(i) has, so some v is orthogonal to all of them: its
mask drops the differing bits, and the pair meets in that table for certain.

Groups. Texts are reduced to distinct fingerprints first. Buckets of up to
``SMALL`` fingerprints compare their members in pairs. In larger ones every
member meets the fingerprints it can reach by flipping half the radius of the
bits that the mask drops (for an odd radius, one end flips one more). Two members
of a bucket are within the radius exactly if they have such a midpoint in common,
so linking the members of a midpoint to the least of them joins what the pairs
would join, and the work grows with the number of members, not of pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, checkpointed, fresh, text_of
from brindle.llm.components import components

SEED = 42
SMALL = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at a time: 64 bytes each.
_BLOCK = 1 << 16


def fingerprint(text: str, size: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - size, 0)
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: last + 1].tolist(), ends[-(last + 1) :].tolist())
    return majority(np.array([hashed(joined[a:b], SEED) for a, b in pairs], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the 64-bit hashes, as an unsigned integer; none give 0."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[k : k + _BLOCK].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, size: int = 3, column: str = "fp", text: str = "text") -> DataFrame:
    """``docs`` and the fingerprint of each text as a signed 64-bit column."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts):
        return texts.map(lambda t: int(np.uint64(fingerprint(t, size)).astype(np.int64)))

    return docs.withColumn(column, of(text_of(text)))


def masks(radius: int = 2, bits: int = 64) -> list[int]:
    """The 2^(radius + 1) - 1 masks, as unsigned integers.

    a(i) runs through the non-zero vectors in turn: every mask then keeps
    4/7 of the bits at radius 2, which makes its buckets as small as can be.
    """
    vectors = 2 ** (radius + 1) - 1
    of = [1 + i % vectors for i in range(bits)]
    return [
        sum(1 << i for i in range(bits) if bin(of[i] & v).count("1") % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints ``fp``, enough to join all within reach.

    Every link returned is within ``radius``; every pair within ``radius`` is
    joined by a chain of them.
    """
    tables = masks(radius)
    keyed = fps.select(
        "fp", F.explode(F.array(*[
            F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for k, m in enumerate(tables)
        ])).alias("b")
    ).select("fp", "b.t", "b.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # most fingerprints share no bucket: what is left is cut off here
    shared = checkpointed(keyed.join(sizes, ["t", "key"]))
    few = shared.where(F.col("n") <= small)
    pairs = (
        few.select("t", "key", F.col("fp").alias("u"))
        .join(few.select("t", "key", F.col("fp").alias("v")), ["t", "key"])
        .where((F.col("v") < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
        .select("u", "v")
    )
    many = shared.where(F.col("n") > small)
    near, far = (_reach(many, tables, n) for n in (radius // 2, (radius + 1) // 2))
    # any two members of which one is near and one is far are within the radius
    least = near.groupBy("t", "mid").agg(F.min("fp").alias("v"))
    stars = far.join(least, ["t", "mid"]).where("v <> fp").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def _reach(members: DataFrame, tables: list[int], flips: int) -> DataFrame:
    """The fingerprints that a member reaches by up to ``flips`` of the bits its mask drops."""
    words = F.array(*[
        F.array(*[F.lit(_signed(f)) for f in _flips(~m & (2**64 - 1), flips)]) for m in tables
    ])
    mids = F.transform(words[F.col("t")], lambda f: F.col("fp").bitwiseXOR(f))
    return members.select("fp", "t", F.explode(mids).alias("mid"))


def _flips(free: int, most: int) -> list[int]:
    """All words of at most ``most`` of the bits of ``free``."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(bits, n)]


def near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    ``component_id`` is the least id of the component, null ids left out (null if
    all are). Repeated rows each keep their row. No rows: no rows. Other columns,
    whatever their names, are not looked at.
    """
    rows = checkpointed(
        with_fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), size).select("id", "fp")
    )
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(least.select("fp"), radius))
    rooted = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(roots, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The row of ``docs`` with the least id from each component, with all its columns.

    Of rows that share that id one stays. ``docs`` must be stable, such as files or
    a checkpoint: rows are told apart by their place.
    """
    row = fresh(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    groups = near_duplicates(
        placed.select(F.struct(F.col(id).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text).alias("text")),
        size, radius, "id", "text",
    )
    kept = groups.select(F.col("component_id.row").alias(row)).distinct()
    return placed.join(kept, row, "left_semi").drop(row)
