"""Importance resampling: documents drawn as a target corpus would have them.

Features are runs of ``orders`` consecutive words, hashed by CRC-32 into ``buckets``.
A bucket's gain is the logarithm of its share in the target over its share in the
source, a document's weight the mean gain of its features. Documents are drawn without
replacement by the Gumbel trick: the highest weights with noise from a hash of the id.

CRC-32 is linear but for a constant: the CRC of a feature is the XOR of what each of
its bytes adds, which depends on the byte and its distance from the end, and of a
constant of its length. Both come from tables, so all features of a batch are hashed by
one ``bitwise_xor.reduceat`` over their bytes. Features of over ``SPAN`` bytes are cut
into blocks from their end; what a block adds is moved on by powers of two of ``SPAN``
bytes, one for each binary digit of the number of blocks behind it.

How it is spread out. The text is read twice and never shuffled. The first pass counts
``buckets`` numbers per task, which are summed by bucket; the driver holds ``buckets``
sums, whatever the input. The second pass gives a few numbers per document. Ranks come
from a distributed sort of these: the place within a sorted partition and the number of
rows in the partitions before it, of which the driver holds one number per partition.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, checkpointed, fresh, slices, text_of

BUCKETS = 10_000
ORDERS = (1, 1)
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a feature that are hashed in one block.
SPAN = 64
#: Bytes of text that are taken at a time.
_TEXT = 2 << 20
_CRC = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters a-z, digits, and every byte of other characters than ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


@lru_cache(maxsize=1)
def _positions() -> np.ndarray:
    """[d, b]: what byte b adds to a CRC if d bytes follow it, for d < SPAN."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(_CRC), step >> 1)
    table = np.empty((SPAN, 256), dtype=np.uint32)
    table[0] = step
    for d in range(1, SPAN):
        table[d] = table[d - 1] >> 8 ^ step[table[d - 1] & 255]
    return table


def _moved(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (
        tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]
    )


def _past_blocks(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each state after as many blocks of SPAN zero bytes, by the binary digits of the number."""
    # the four bytes of a state act as the first four of the block
    tables = _positions()[SPAN - 1 : SPAN - 5 : -1]
    state, left = state.copy(), blocks
    while left.any():
        odd = np.flatnonzero(left & 1)
        state[odd] = _moved(state[odd], tables)
        tables = _moved(tables, tables)
        left = left >> 1
    return state


@lru_cache(maxsize=1)
def _short_constants() -> np.ndarray:
    """The register, all ones at first, after 0 to SPAN - 1 zero bytes."""
    out = np.empty(SPAN, dtype=np.uint32)
    out[0] = _ALL
    step = _positions()[0]
    for n in range(1, SPAN):
        out[n] = out[n - 1] >> np.uint32(8) ^ step[out[n - 1] & np.uint32(255)]
    return out


def length_constants(sizes: np.ndarray) -> np.ndarray:
    """What the CRC of a span has from its length alone."""
    state = _short_constants()[sizes % SPAN]
    return (_past_blocks(state, sizes // SPAN) if (sizes >= SPAN).any() else state) ^ _ALL


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for each span; spans may overlap and be empty."""
    sizes = ends - starts
    crc = length_constants(sizes)
    some = np.flatnonzero(sizes)
    if not len(some):
        return crc
    starts, ends, sizes = starts[some], ends[some], sizes[some]
    many = (sizes + SPAN - 1) // SPAN
    long = many.max() > 1
    if long:
        owner = np.repeat(np.arange(len(some)), many)
        last = np.cumsum(many)
        behind = last[owner] - 1 - np.arange(last[-1])
        ends = ends[owner] - behind * SPAN
        starts = np.maximum(starts[owner], ends - SPAN)
        sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(firsts[-1] + sizes[-1])
    byte = data[place + np.repeat(starts - firsts, sizes)]
    follow = np.repeat(firsts + sizes - 1, sizes) - place
    added = np.bitwise_xor.reduceat(_positions().ravel()[follow << 8 | byte], firsts)
    if long:
        added = np.bitwise_xor.reduceat(_past_blocks(added, behind), last - many)
    crc[some] ^= added
    return crc


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts one after another, lower-cased; start, end and text of each word in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[0] == offsets[-1]:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), none, none, none
    data = _LOWER[np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # a word ends where its text does
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = ~inside
    stops[cuts] = True
    stops = np.flatnonzero(stops)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def features_of(words: tuple[np.ndarray, ...], orders: tuple[int, int]):
    """For each order its features' CRC-32 and text, in the order of the texts. words: as of ``words_of``."""
    data, starts, ends, text = words
    if orders[1] > 1 and len(starts):
        # the words again with one space between them
        sizes = ends - starts + 1
        to = np.cumsum(sizes) - sizes
        place = np.arange(to[-1] + sizes[-1] - 1)
        data = np.append(data, np.uint8(32))[place + np.repeat(starts - to, sizes)[: len(place)]]
        data[to[1:] - 1] = 32
        starts, ends = to, to + sizes - 1
    for n in range(orders[0], orders[1] + 1):
        whole = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
        yield crc32_of_spans(data, starts[whole], ends[whole + n - 1]), text[whole]


def _groups(batch: pa.RecordBatch, column: int):
    texts = batch.column(column)
    for a, b in slices(pc.binary_length(texts).to_pylist(), _TEXT):
        yield a, b, texts.slice(a, b - a)


def bucket_counts(texts: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``bucket``, ``n``: the number of features in each bucket that has any.

    A null text has none, and no rows give no buckets. Lowers the session's Arrow batch limits.
    """
    bounded_batches(texts.sparkSession)

    def rows(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, part in _groups(batch, 0):
                for crc, _ in features_of(words_of(part), orders):
                    counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    counted = texts.select(text_of(text).alias("text")).mapInArrow(rows, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Of each bucket floor(1000 ln) of its share in the target over that in the source, one added to each count."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(
        target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))
    )
    s, t = [0] * buckets, [0] * buckets
    # at most ``buckets`` rows of three numbers
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    every_s, every_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [
        math.floor(1000 * math.log((float(y) + 1) * every_s / ((float(x) + 1) * every_t))) for x, y in zip(s, t)
    ]


def weighted(
    docs: DataFrame, gain: list[int], orders: tuple[int, int] = ORDERS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` of every row of ``docs``.

    ``weight`` is the mean gain, rounded down; 0 without features, as of a null or empty text.
    """
    bounded_batches(docs.sparkSession)
    table = np.array(gain, dtype=np.int64)

    def rows(batches):
        for batch in batches:
            numbers = np.zeros((3, batch.num_rows), dtype=np.int64)
            for a, b, part in _groups(batch, 1):
                own, words = numbers[:, a:b], words_of(part)
                own[0] = np.bincount(words[3], minlength=b - a)
                for crc, owner in features_of(words, orders):
                    bounds = np.searchsorted(owner, np.arange(b - a + 1))
                    sums = np.concatenate(([0], np.cumsum(table[crc % np.uint32(len(table))])))
                    own[1] += np.diff(bounds)
                    own[2] += np.diff(sums[bounds])
            n_words, n, total = numbers
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight)],
                names=[id, "n_words", "n_features", "weight"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), text_of(text).alias("__text")).mapInArrow(
        rows, f"`{id}` {kind}, n_words bigint, n_features bigint, weight bigint"
    )


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 times) standard Gumbel noise from a hash of the key; null as the empty key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    orders: tuple[int, int] = ORDERS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id: str = "doc_id",
    text: str = "text",
    key: str | None = None,
) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs``.

    Of the documents with ``least_words`` words those with the highest scores are drawn,
    ``percent`` of a hundred rounded down, equal scores by the smaller id (null last);
    ``rank`` is their order from 1, null if not drawn. Repeated rows each count. ``key``
    is the field of a struct ``id`` that noise and order go by, if not ``id`` itself.
    Without target texts all features weigh alike; no rows: no rows. Other columns are not
    looked at. The text is read twice: ``docs`` should be files or a checkpoint.
    """
    gain = gains(bucket_counts(docs, orders, buckets, text), bucket_counts(target, orders, buckets, text), buckets)
    scored = checkpointed(weighted(docs, gain, orders, id, text).withColumn("score", F.col("weight") + noise(F.col(key or id), seed)))
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last(key or id), "n_features", "n_words"]
    place = fresh(scored, "place")
    # a checkpoint keeps its partitions, so places in them stay
    sorted_ = checkpointed(scored.where(able).orderBy(*order)).withColumn(place, F.monotonically_increasing_id())
    part = F.shiftright(place, 33)
    before, offsets = 0, []
    # one row per partition
    for row in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((row.part, before))
        before += row.n
    chosen = percent * before // 100
    known = docs.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    rank = F.col("__before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = (
        sorted_.join(F.broadcast(known), part == F.col("__part"))
        .withColumn("rank", F.when(rank <= chosen, rank))
        .drop("__part", "__before", place)
    )
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``resampled`` draws, with all their columns, in no order.

    ``docs`` must be stable, such as files or a checkpoint: rows are told apart by their
    place. Of rows with one id and text it is left open which are drawn.
    """
    row = fresh(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    keyed = placed.select(F.struct(F.col(id).alias("id"), F.col(row).alias("row")).alias("key"), F.col(text).alias("text"))
    found = resampled(keyed, target.select(F.col(text).alias("text")), id="key", text="text", key="key.id", **options)
    return placed.join(found.where("rank is not null").select(F.col("key.row").alias(row)), row, "left_semi").drop(row)
