"""Removal of long byte strings that occur more than once.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same text or another, is marked; strings never cross texts, overlaps
count, and all occurrences go, the first included. A null text is the empty text.

How it is spread out. Comparing each shard's suffix array with every other
shard's grows with the square of their number, so shards are not made of
neighbouring documents but of strings that can be equal:

1. The *anchor* of a window of ``length`` bytes is its gram of least hash, 48 bytes
   for windows of 200, the leftmost if equal. Equal windows have equal anchors at equal
   offsets, so they meet under the anchor's hash. The windows of one anchor are one run of
   starts; the *piece* is the run's bytes. Rows hold two hashes, the document's row
   and the run, never text. A wide gram has more runs, but few unlike pieces share one.
2. Anchors that occur once are dropped: none of their windows is repeated.
3. Copies of a piece are counted before their text is fetched once (a *class*).
   A class alone under its anchor needs no text.
4. The classes of an anchor go to one shard, a few MB of text. The shard sorts the
   suffixes by Larsson-Sadakane refinement and finds common prefixes by Kasai's
   rule.
5. An anchor with more than ``MOST`` classes would outgrow a shard: its windows are
   dealt by their own 128-bit digest instead, and counted before being joined
   back. Then ranges go back from classes to documents.

Binary search across shards has nothing left to do, since equal strings never lie
in two shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, checkpointed, dealt, fresh, slices, text_of

LENGTH = 200
#: Classes of one anchor that are compared in one shard.
MOST = 4096
#: Bytes of one shard, but for the classes of one anchor.
SHARD = 2 << 20
#: Bytes that are searched for anchors at a time.
_BLOCK = 2 << 20
_PLACE = 23
_RANGES = "array<struct<start:int,end:int>>"


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes at each place as an integer; ``data`` has 8 bytes to spare."""
    return np.ndarray(len(data) - 8, dtype=f"{order}u8", buffer=data, strides=(1,)).astype("u8")


def _gram(length: int) -> int:
    return next(gram for least, gram in ((144, 48), (96, 32), (64, 16), (0, 8)) if length >= least)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8, 16, 32 or 48) from each place on; zeros follow the data."""
    n = len(data)
    narrower = hashes = _words(np.concatenate((data, np.zeros(gram + 8, dtype=np.uint8))), "<") * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(31)
    width = 8
    while width < gram:
        # twice as wide, or half as wide again
        more = hashes if 2 * width <= gram else narrower
        narrower = hashes
        hashes = hashes[: len(more) - width] * np.uint64(0xC2B2AE3D27D4EB4F) + more[width:]
        hashes ^= hashes >> np.uint64(29)
        width = min(2 * width, gram)
    hashes = hashes[:n] * np.uint64(0x165667B19E3779F9)
    return hashes ^ (hashes >> np.uint64(32))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """The runs of windows of equal anchor in texts that lie one after another in ``data``.

    Yields arrays: text, first window in ``data``, number of windows, anchor's hash.
    """
    gram = _gram(length)
    n = len(data)
    hashes = _gram_hashes(data, gram)
    # the upper bits order the grams, the lower ones are the place
    low = np.uint64((1 << _PLACE) - 1)
    least = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    counts = sizes - length + 1
    some = np.flatnonzero(counts > 0)
    if not len(some):
        return
    counts = counts[some]
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    windows = np.arange(counts.sum()) + np.repeat(starts[some] - firsts, counts)
    place = (least[windows] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    text = some[np.searchsorted(firsts, cut, side="right") - 1]
    runs = np.diff(np.concatenate((cut, [len(windows)])))
    yield text, windows[cut], runs, hashes[place[cut]]


def _pieces(lengths: list[int], length: int):
    """(text, from, to) of the texts that have windows; long ones in parts that share length - 1 bytes."""
    step = _BLOCK - length
    for i, n in enumerate(lengths):
        for a in range(0, n - length + 1, step):
            yield i, a, min(a + step + length - 1, n)


def _raw(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchor_rows(length: int):
    digest = xxhash.xxh3_64_intdigest

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), _raw(batch.column(1))
            parts = list(_pieces([len(t) for t in texts], length))
            for a, b in slices([to - fro for _, fro, to in parts], _BLOCK):
                part = parts[a:b]
                joined = b"".join(texts[i][fro:to] for i, fro, to in part)
                sizes = np.array([to - fro for _, fro, to in part])
                starts = np.cumsum(sizes) - sizes
                row = ids[[i for i, _, _ in part]]
                moved = np.array([fro for _, fro, _ in part]) - starts
                for text, first, runs, hashes in anchors(
                    np.frombuffer(joined, dtype=np.uint8), starts, sizes, length
                ):
                    ends = first + runs + length - 1
                    whole = np.fromiter(
                        (digest(joined[x:y]) for x, y in zip(first.tolist(), ends.tolist())), "u8", len(first)
                    )
                    yield pa.record_batch(
                        [
                            pa.array(hashes.view(np.int64)),
                            pa.array(whole.view(np.int64)),
                            pa.array(row[text]),
                            pa.array((first + moved[text]) << 16 | runs),
                        ],
                        names=["h", "s", "row", "at"],
                    )

    return rows


def _packed(batches):
    """Of (row, text): the text compressed, which halves what is shuffled to those that need it."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([pack(t) for t in _raw(batch.column(1))], pa.binary())
        yield pa.record_batch([batch.column(0), packed], names=["row", "packed"])


def _cut_rows(length: int):
    """Of (packed, need): the bytes of each class, or the digests of its windows."""

    def rows(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for packed, need in zip(batch.column("packed").to_pylist(), batch.column("need").to_pylist()):
                text = unpack(packed)
                for c in need:
                    first, n = c["at"] >> 16, c["at"] & 0xFFFF
                    piece = text[first : first + n + length - 1]
                    if c["spread"]:
                        for i in range(n):
                            out.append((c["h"], c["s"], c["m"], i, xxhash.xxh3_128_digest(piece[i : i + length])))
                    else:
                        out.append((c["h"], c["s"], c["m"], -1, piece))
            for a, b in slices([len(x[4]) for x in out], SHARD):
                h, s, m, i, piece = zip(*out[a:b])
                yield pa.record_batch(
                    [pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.int64()),
                     pa.array(i, pa.int32()), pa.array(piece, pa.binary())],
                    names=["h", "s", "m", "i", "piece"],
                )

    return rows


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` in the order of the ``depth`` bytes from there on.

    Larsson-Sadakane: places are grouped by their first 8 bytes; each round sorts the
    groups that have several members by the group of what follows, and doubles the
    bytes compared. What lies beyond the end counts as zeros.
    """
    n = len(data)
    key = _words(np.concatenate((data, np.zeros(8, dtype=np.uint8))), ">")
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 8
    while done < depth:
        step = min(done, depth - done)
        several = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(several):
            break
        at = sa[several]
        key = rank[at] << np.int64(32) | rank[np.minimum(at + step, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[several] = at
        new[several] = fresh_group = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh_group, several, 0))
        done += step
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place shares with the place before it in ``sa``, ``depth`` at most.

    Kasai: what place i shares, place i + 1 shares but for one byte. Places that agree
    in all ``depth`` bytes, or up to the end of the data, are not ordered by a byte
    that differs, so after such a place the next one is compared afresh. The pieces
    that begin at ``starts`` are walked side by side, each from nothing.
    """
    n = len(data)
    words = _words(np.concatenate((data, np.zeros(depth + 16, dtype=np.uint8))), "<")
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    shared = np.zeros(n, dtype=np.int64)
    ends = np.append(starts[1:], n)
    at, h = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    while len(at):
        other = before[at]
        h[other < 0] = 0
        lanes = np.flatnonzero((other >= 0) & (h < depth))
        while len(lanes):
            i, j = at[lanes] + h[lanes], other[lanes] + h[lanes]
            differ = words[i] ^ words[j]
            # bytes up to the lowest that differs
            lowest = differ & (~differ + np.uint64(1))
            more = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) >> 3)
            h[lanes] += np.minimum(more, n - np.maximum(i, j))
            lanes = lanes[(more == 8) & (np.maximum(i, j) + 8 < n) & (h[lanes] < depth)]
        shared[at] = np.minimum(h, depth)
        ordered = (h < depth) & (np.maximum(at, other) + h < n)
        at, h = at + 1, np.where(ordered, np.maximum(h - 1, 0), 0)
        live = at < ends
        at, h, ends = at[live], h[live], ends[live]
    return shared


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, whether each of its windows also starts elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sa = suffix_array(data, length)
    shared = common_prefixes(data, sa, starts, length)
    group = np.cumsum(shared[sa] < length)
    # a place too near the end of its piece starts no window
    window = np.ones(len(data), dtype=bool)
    for k in range(length - 1):
        window[starts + sizes - 1 - k] = False
    inside = window[sa]
    members = np.bincount(group[inside], minlength=group[-1] + 1)
    again = np.zeros(len(data), dtype=bool)
    again[sa] = inside & (members[group] > 1)
    return [again[a : a + n - length + 1] for a, n in zip(starts, sizes)]


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return [
        {"start": a, "end": b}
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
    ]


def _shard_rows(length: int):
    """Of (h, s, m, i, piece), sorted by h: the ranges of repeated windows of each class."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def searched(rows):
        found = [
            _runs(np.ones(len(flags), dtype=bool) if m > 1 else flags)
            for flags, (_, _, m, _) in zip(repeated([r[3] for r in rows], length), rows)
        ]
        kept = [(h, s, f) for (h, s, _, _), f in zip(rows, found) if f]
        if kept:
            h, s, f = zip(*kept)
            yield pa.record_batch(
                [pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(f, kind)], names=["h", "s", "ranges"]
            )

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "s", "m", "piece")]
            for row in zip(*columns):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield from searched(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from searched(held)

    return rows


def _merged(length: int):
    @F.pandas_udf(_RANGES)
    def of(lists):
        out = []
        for ranges in lists:
            spans = []
            for a, b in sorted((r["start"], r["end"] + length - 1) for r in ranges):
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], b)
                else:
                    spans.append({"start": a, "end": b})
            out.append(spans)
        return pd.Series(out)

    return of


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, text: str = "text", column: str = "spans", most: int = MOST
) -> DataFrame:
    """``docs`` and ``column``, the spans (start, end) of bytes of ``text`` to remove.

    Spans are sorted, do not touch, and count bytes from 0; an empty array if there
    are none. ``docs`` must be stable, such as files or a checkpoint: rows are told
    apart by their place. Other columns come back as they are; ``column`` must be new.
    ``length`` is from 16 to 60,000.
    """
    if not 16 <= length <= 60_000:
        raise ValueError("length must be from 16 to 60,000 bytes")
    bounded_batches(docs.sparkSession)
    row = fresh(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    texts = placed.select(F.col(row).alias("row"), text_of(text).alias("text"))
    runs = texts.where(F.octet_length("text") >= length).mapInArrow(
        _anchor_rows(length), "h bigint, s bigint, row bigint, at bigint"
    )
    twice = runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    kept = checkpointed(runs.join(dealt(twice), "h"))

    classes = kept.groupBy("h", "s").agg(F.count("*").alias("m"), F.min(F.struct("row", "at")).alias("first"))
    classes = checkpointed(classes.join(dealt(classes.groupBy("h").agg(F.count("*").alias("k"))), "h"))
    alone = classes.where("k = 1").select(
        "h", "s",
        F.expr(f"array(named_struct('start', 0, 'end', cast(first.at & {0xFFFF} as int)))").cast(_RANGES).alias("ranges"),
    )
    need = (
        classes.where("k > 1")
        .groupBy("first.row")
        .agg(F.collect_list(F.struct("h", "s", "m", "first.at", (F.col("k") > most).alias("spread"))).alias("need"))
    )
    cut = checkpointed(
        texts.where(F.octet_length("text") >= length)
        .mapInArrow(_packed, "row bigint, packed binary")
        .join(need, "row")
        .select("packed", "need")
        .mapInArrow(
            _cut_rows(length), "h bigint, s bigint, m bigint, i int, piece binary"
        )
    )
    shards = (
        cut.where("i < 0")
        .repartition("h")
        .sortWithinPartitions("h", "s")
        .mapInArrow(_shard_rows(length), f"h bigint, s bigint, ranges {_RANGES}")
    )
    spread = cut.where("i >= 0")
    again = spread.groupBy("piece").agg(F.sum("m").alias("n")).where("n > 1").select("piece")
    spread = (
        spread.join(again, "piece")
        .groupBy("h", "s")
        .agg(F.collect_list(F.struct(F.col("i").alias("start"), (F.col("i") + 1).alias("end"))).alias("ranges"))
    )
    found = alone.unionByName(shards).unionByName(spread.select("h", "s", F.col("ranges").cast(_RANGES).alias("ranges")))
    first = F.shiftright("at", 16).cast("int")
    spans = (
        kept.join(found, ["h", "s"])
        .select(
            "row",
            F.transform(
                "ranges", lambda r: F.struct((r.start + first).alias("start"), (r.end + first).alias("end"))
            ).alias("ranges"),
        )
        .groupBy(F.col("row").alias(row))
        .agg(_merged(length)(F.flatten(F.collect_list("ranges"))).alias(column))
    )
    return (
        placed.join(spans, row, "left")
        .drop(row)
        .withColumn(column, F.coalesce(F.col(column), F.array().cast(_RANGES)))
    )


def kept_bytes(text, spans):
    """The bytes of the text that no span covers, one after another."""
    raw = F.encode(text, "utf-8")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s.end))
    starts = F.concat(F.transform(spans, lambda s: s.start), F.array(F.octet_length(text)))
    gaps = F.arrays_zip(starts.alias("to"), ends.alias("from"))
    # joined once: growing the bytes gap by gap would copy them each time
    parts = F.transform(gaps, lambda g: F.hex(F.substring(raw, g["from"] + 1, g["to"] - g["from"])))
    return F.when(F.size(spans) > 0, F.unhex(F.array_join(parts, ""))).otherwise(raw)


def kept_text(text, spans):
    """The text between the spans. Characters that a span covers in part go too."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, covered in zip(texts, spans):
            if len(covered):
                raw, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
                for s in covered:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                text = "".join(p.decode("utf-8", "ignore") for p in [*parts, raw[at:]])
            out.append(text)
        return pd.Series(out)

    return of(text, spans)


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with the repeated strings removed from ``text``; every row stays.

    A text of which nothing is left is the empty text; so is a null text.
    """
    spans = fresh(docs, "spans")
    found = repeated_spans(docs, length, text, spans)
    return found.withColumn(text, kept_text(text_of(text), F.col(spans))).drop(spans)
