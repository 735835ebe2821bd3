"""Best-fit packing of documents into sequences by patterns of few lengths.

A document is the ids of its text and an end id. Documents of over ``size`` ids are cut
into pieces of ``size`` from their end, so that only the first piece may be shorter.
The pieces are packed so that as few sequences as possible hold them:

1. The lengths of all pieces are counted: ``size`` numbers, whatever the input.
2. Patterns are all sets of up to three lengths that fill a sequence exactly. How often
   each is repeated is fitted to the histogram by non-negative least squares, longer
   lengths weighing more, as they are harder to place. The active-set method
   (Lawson-Hanson, several columns entering at a time) keeps no more patterns than
   there are lengths, so rounding loses little.
3. Repeat counts are rounded, within the pieces there are; what is left is fitted again while
   whole patterns come out of it.
4. The rest is packed by best fit, longest first, on counts of pieces and of open bins, so
   that its cost does not depend on how many pieces there are either.

How it is spread out. Texts are encoded where they are read and never shuffled; pieces
are a few numbers each and are written once. A piece's number among those of its length
is its place in its own task plus the pieces of that length in earlier tasks, which a
window of sums per task gives. The plan maps numbers to sequences; its size is bounded by the
patterns and it is sent to all tasks. A length with a third of all pieces is a count like any other.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm.common import bounded_batches, checkpointed, slices, text_of

SIZE, END = 1024, 2
#: Steps of the fit, and the share of the repeat counts that is left to best fit.
STEPS, KEPT = 600, 0.2
#: Bytes of text that are encoded at a time, and different parts whose ids are remembered.
_TEXT = 4 << 20
_KNOWN = 1_000_000
#: Bytes that white space begins with, among those that may follow a space.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")] = True


class Encoder:
    """Token ids of many texts by a byte-level tokenizer.

    Its rule for words takes one space before a word into the word and leaves other white space
    apart, so a text can be cut before each space that something other than white space
    follows, and between a letter and a sign. Each different part is encoded once; up to
    ``_KNOWN`` are remembered. No cut is made before what may begin or belong to an added token,
    nor before a space and a character from U+0800 up or from U+0080 to U+00BF, which may be
    white space; letters and signs are ASCII ones.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._of = Tokenizer.from_str(tokenizer)
        added = [t.content.encode() for t in self._of.get_added_tokens_decoder().values()]
        self._can_follow = ~_WHITE
        self._can_follow[0x80:0xC3] = self._can_follow[0xE0:] = False
        self._can_follow[[b for t in added for a, b in zip(b" " + t, t) if a == 32]] = False
        plain = [chr(x) if x < 127 else " " for x in range(256)]
        self._letters = np.array([x.isalpha() for x in plain])
        self._signs = np.array([x > " " and not x.isalnum() for x in plain])
        self._signs[list(b"".join(added))] = False
        self._forget()

    def _forget(self):
        self._known: dict[str, int] = {}
        self._ids, self._counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each of the different ``parts`` is among those known, once it is."""
        if len(self._known) > _KNOWN:
            self._forget()
        texts = parts.to_pylist()
        # a table kept in a dictionary is not built again for each call
        place = np.fromiter(map(self._known.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [texts[k] for k in missing.tolist()]
            found = [e.ids for e in self._of.encode_batch_fast(new, add_special_tokens=False)]
            place[missing] = np.arange(len(self._known), len(self._known) + len(new))
            self._known.update(zip(new, place[missing].tolist()))
            counts = np.array([len(x) for x in found], dtype=np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
            self._ids, self._counts = np.concatenate([self._ids, ids]), np.concatenate([self._counts, counts])
        return place

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. texts: strings without nulls, under 2 GB in all."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return [np.zeros(0, dtype=np.uint32)] * len(texts)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[: len(data) - 1] = (data[:-1] == 32) & self._can_follow[data[1:]]
        cut[1 : len(data)] |= self._letters[data[:-1]] & self._signs[data[1:]]
        cut[offsets] = True
        bounds = np.flatnonzero(cut).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        codes = parts.dictionary_encode()
        place = self._places(codes.dictionary)[codes.indices.to_numpy()]
        many = self._counts[place]
        upto = np.concatenate(([0], np.cumsum(many)))
        first = np.cumsum(self._counts) - self._counts
        flat = self._ids[np.repeat(first[place] - upto[:-1], many) + np.arange(upto[-1])]
        at = upto[np.searchsorted(bounds, offsets)]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> Encoder:
    """The encoder of a worker process: what one task learns, the next ones of the process know."""
    return Encoder(tokenizer)


def patterns(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths, ascending, zeros first, that sum to the last index of ``histogram``.

    Only lengths that ``histogram`` has.
    """
    size = len(histogram) - 1
    have = np.flatnonzero(histogram[1:] > 0) + 1
    there = np.zeros(size + 1, dtype=bool)
    there[have] = True
    out = [np.array([[0, 0, size]])] if there[size] else []
    low = have[have * 2 <= size]
    low = low[there[size - low]]
    out.append(np.stack([np.zeros_like(low), low, size - low], axis=1))
    for a in have[have * 3 <= size].tolist():
        b = have[(have >= a) & (a + 2 * have <= size)]
        b = b[there[size - a - b]]
        out.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    return np.concatenate(out).astype(np.int64)


def fitted(histogram: np.ndarray, rows: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns ``rows`` that come nearest to the histogram.

    Least squares of the lengths that are left or missing, each weighted by the root of its length, by
    projected gradients with momentum, started anew where the momentum points uphill.
    """
    size = len(histogram) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    total = histogram.sum()
    want = histogram * weight / total
    flat = rows.ravel()

    def made(x):
        return np.bincount(flat, weights=np.repeat(x, 3), minlength=size + 1) * weight

    def slope(x):
        return ((made(x) - want) * weight)[rows].sum(axis=1)

    # the steepest curvature, by power iteration
    v = np.ones(len(rows))
    for _ in range(20):
        v = (made(v) * weight)[rows].sum(axis=1)
        v /= np.linalg.norm(v)
    rate = 0.98 / np.linalg.norm((made(v) * weight)[rows].sum(axis=1))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        down = slope(y)
        new = np.maximum(y - rate * down, 0)
        if (down * (new - x)).sum() > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x * total


def _best_fit(left: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for the lengths counted in ``left``, longest first, each into the fullest bin it fits.

    Bins alike are kept as one: (runs of (length, how many)), number of such bins.
    """
    size = len(left) - 1
    open_: dict[int, list] = {}
    spaces = np.zeros(size + 1, dtype=bool)

    def put(space, runs, n):
        open_.setdefault(space, []).append((runs, n))
        spaces[space] = True

    for length in (np.flatnonzero(left[1:]) + 1)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = length + int(fits[0])
                runs, bins = open_[space].pop()
                if not open_[space]:
                    spaces[space] = False
            else:
                space, runs, bins = size, [], -(-count // (size // length))
            many = space // length
            full = min(bins, count // many)
            if full:
                put(space - many * length, [*runs, (length, many)], full)
                count -= full * many
                bins -= full
            if bins and 0 < count < many:
                put(space - count * length, [*runs, (length, count)], 1)
                count = 0
                bins -= 1
            if bins and runs:
                put(space, runs, bins)
    return [bin_ for bins in open_.values() for bin_ in bins]


def plan(histogram: np.ndarray, kept: float = KEPT) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences that hold all pieces: (runs of (length, how many)), number of such sequences.

    histogram[l] is the number of pieces of length l, the last index the size.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = []
    size = len(left) - 1
    if left[size]:
        out.append(([(size, 1)], int(left[size])))
        left[size] = 0
    rows = patterns(left)
    if len(rows):
        # rounded so that the sums from the first pattern on are: what one loses its neighbour has
        upto = np.floor(np.cumsum(fitted(left, rows) * (1 - kept)) + 1e-6).astype(np.int64)
        repeats = np.diff(upto, prepend=0)
        for p in np.flatnonzero(repeats).tolist():
            lengths, many = np.unique(rows[p][rows[p] > 0], return_counts=True)
            repeat = min(int(repeats[p]), *(left[lengths] // many).tolist())
            if repeat:
                left[lengths] -= repeat * many
                out.append((list(zip(lengths.tolist(), many.tolist())), repeat))
    return out + _best_fit(left)


class _Slots:
    """Where the pieces of a plan lie: by length and number to sequence and offset."""

    def __init__(self, kinds: list[tuple[list[tuple[int, int]], int]], size: int):
        slots, taken, base = [], [0] * (size + 1), 0
        for runs, repeat in kinds:
            offset = 0
            for length, many in runs:
                slots.append((length, taken[length], base, offset, many))
                taken[length] += repeat * many
                offset += length * many
            base += repeat
        slots.sort()
        table = np.array(slots, dtype=np.int64).reshape(-1, 5)
        self.key = table[:, 0] << 48 | table[:, 1]
        self.first, self.base, self.offset, self.many = table[:, 1:].T

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted(self.key, length << 48 | number, side="right") - 1
        inside = number - self.first[slot]
        many = self.many[slot]
        return self.base[slot] + inside // many, self.offset[slot] + inside % many * length


def _pieces(docs: DataFrame, tokenizer: str, size: int, end: int, id: str, text: str) -> DataFrame:
    """Pieces as of ``packed``, without places, with ``part`` (task) and ``k`` (number in it of its length)."""
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    kind = docs.schema[id].dataType

    def rows(batches):
        encoder = _encoder(content)
        seen = np.zeros(size + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        names = [id, "piece", "start", "length", "ids_crc32", "part", "k"]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            owner, found = [], []
            for a, b in slices(pc.binary_length(texts).to_pylist(), _TEXT):
                for i, ids in enumerate(encoder.encode(texts.slice(a, b - a)), a):
                    raw = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                    total = len(raw) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = total - start if total - start <= size else total % size if start == 0 and total % size else size
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        owner.append(i)
                        found.append((piece, start, length, crc, part, int(seen[length])))
                        seen[length] += 1
                        start += length
                        piece += 1
            columns = list(zip(*found)) if found else [()] * 6
            types = [pa.int32()] + [pa.int64()] * 5
            yield pa.record_batch(
                [keys.take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=names
            )

    return docs.select(F.col(id), text_of(text).alias("__text")).mapInArrow(
        rows,
        f"`{id}` {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, k bigint",
    )


def packed(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    ``tokenizer`` is the path of a byte-level tokenizer file, read by the driver. A null or
    empty text is ``end`` only. Pieces: ``id``, ``piece`` from 0, ``start`` (ids of its document
    before it), ``length``, ``ids_crc32`` (of little-endian unsigned 32-bit ids),
    ``sequence_id`` and ``offset`` in the sequence, from 0 without gaps. Repeated rows and ids are
    packed as they come, null ids too; no rows: no pieces. Other columns are not looked at.
    ``size`` is from 1 to 16,384. Lowers the session's Arrow batch limits.
    """
    if not 1 <= size <= 16_384:
        raise ValueError("size must be from 1 to 16,384")
    bounded_batches(docs.sparkSession)
    pieces = checkpointed(_pieces(docs, tokenizer, size, end, id, text))
    counts = checkpointed(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(size + 1, dtype=np.int64)
    # at most ``size`` rows of two numbers
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    slots = _Slots(plan(histogram), size)

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).select(
        id, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("number")
    )

    def rows(batches):
        for batch in batches:
            sequence, offset = slots.places(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return numbered.mapInArrow(
        rows,
        f"`{id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
