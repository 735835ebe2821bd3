"""Packing of documents into training sequences, in order, by dynamic programming.

Each partition of the input is packed by itself as a stream, in the order in which
its documents lie, so nothing is shuffled and one row group of text is held at a
time. Per ``BLOCK`` tokens the cuts between sequences are chosen to cost least:

- a token of padding costs 1. A sequence is padded to ``size`` unless its length is
  a power of two, from ``LEAST`` up;
- a sequence costs ``SEQUENCE``;
- a cut between documents is free, one behind a sentence costs ``SENTENCE`` and one
  within a sentence ``WITHIN``.

The best cost up to a cut at token t is the least, over earlier cuts i at most
``size`` before it, of cost(i) + size - (t - t_i): the cuts that can still be best
form a queue of rising cost(i) + t_i, so each cut enters and leaves it once. Exact
powers of two are looked up besides. The last sequence of a block stays open and
begins the next block. The last of a partition is split into powers of two where
that costs less than its padding.

Tokens are those of ``tokenizers`` for the whole text, see ``Encoder``.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm.common import bounded_batches, slices, text_of

SIZE = 4096
END = 2
LEAST = 512
SEQUENCE, SENTENCE, WITHIN = 8, 16, 64
#: Tokens of one optimisation, and between two cuts where there is no sentence.
BLOCK, STEP = 64 * 4096, 128
#: Bytes of text that are tokenized at a time.
_TEXT = 4 << 20
_GROUP = 4096
_KNOWN = 400_000
_SENTENCE = r"[.!?…][\"'»”’)\]]*$"
#: A letter or digit and the signs, but for apostrophes, that end a part.
_SIGNS = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+)$"
#: Last bytes of what _SENTENCE and _SIGNS may match.
_MAY_END, _MAY_SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MAY_END[list(".!?…\"'»”’)]".encode())] = True
_MAY_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _last_bytes(parts: pa.Array) -> np.ndarray:
    """The last byte of each string, 0 for the empty one."""
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset : parts.offset + len(parts) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(len(parts), dtype=np.uint8)
    data = np.frombuffer(parts.buffers()[2], dtype=np.uint8)
    return np.where(np.diff(offsets) > 0, data[np.maximum(offsets[1:] - 1, 0)], 0)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each i the ``many[i]`` numbers from ``first[i]`` on, one after the other."""
    upto = np.cumsum(many)
    return np.repeat(first - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)


def _where(may: np.ndarray, parts: pa.Array, test) -> pa.Array:
    """``test`` of the parts that ``may`` marks, false for the others."""
    mask = pa.array(may)
    return pc.replace_with_mask(pa.array(np.zeros(len(parts), dtype=bool)), mask, test(parts.filter(mask)))


class Encoder:
    """Token ids of many texts, and where sentences end in them.

    White space ends every token, and so does a change from a letter or digit to a
    sign other than an apostrophe. So a text is taken apart at both, and each
    different part is encoded once; the ids of up to ``_KNOWN`` parts are remembered.
    ASCII capitals count as small letters, as the tokenizer has it. Parts that might
    hold a special token are left whole.
    """

    def __init__(self, tokenizer: str, mark: str = "<|endoftext|>"):
        self._of = Tokenizer.from_str(tokenizer)
        self._mark, self._mark_id = mark, self._of.token_to_id(mark)
        self._forget()

    def _forget(self):
        self._known = pa.array([], pa.string())
        self._ids, self._counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encoded(self, text: str):
        return self._of.encode(text, add_special_tokens=False)

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and counts of parts that are letters only: each is a word for the tokenizer."""
        ids, counts = [], []
        for k in range(0, len(words), _GROUP):
            group = words[k : k + _GROUP]
            found = self._encoded(" ".join(group))
            many = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(group))
            if len(many) == len(group) and many.all():
                ids.append(np.array(found.ids, dtype=np.uint32))
                counts.append(many)
            else:
                more = self._others(group)
                ids += more[0]
                counts += more[1]
        return ids, counts

    def _others(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and counts of any parts."""
        ids, counts = [], []
        for k in range(0, len(parts), _GROUP):
            group = parts[k : k + _GROUP]
            # the mark stands between parts as a token of its own
            found = np.array(self._encoded(self._mark.join(group)).ids, dtype=np.uint32)
            marks = np.flatnonzero(found == self._mark_id)
            if len(marks) == len(group) - 1:
                ids.append(np.delete(found, marks))
                counts.append(np.diff(np.concatenate(([-1], marks, [len(found)]))) - 1)
            else:
                # a part holds the mark itself
                single = [np.array(self._encoded(p).ids, dtype=np.uint32) for p in group]
                ids += single
                counts.append(np.array([len(x) for x in single]))
        return ids, counts

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each of the different ``parts`` is among those known, once it is."""
        if len(self._known) > _KNOWN:
            self._forget()
        # looked up once: each look-up hashes all that is known
        place = pc.fill_null(pc.index_in(parts, value_set=self._known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            letters = pc.match_substring_regex(new, r"^\pL+$")
            words, others = new.filter(letters), new.filter(pc.invert(letters))
            found = [self._words(words.to_pylist()), self._others(others.to_pylist())]
            order = np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable")
            place[missing[order]] = np.arange(len(self._known), len(self._known) + len(missing))
            self._known = pa.concat_arrays([self._known, words, others])
            self._ids = np.concatenate([self._ids, *found[0][0], *found[1][0]])
            self._counts = np.concatenate([self._counts, *found[0][1], *found[1][1]]).astype(np.int64)
        return place

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, without the last one, and the counts of ids at sentence ends."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        codes = lists.flatten().dictionary_encode()
        parts = codes.dictionary
        last = _last_bytes(parts)
        ends = _where(_MAY_END[last], parts, lambda x: pc.match_substring_regex(x, _SENTENCE)).to_numpy(zero_copy_only=False)
        special = pc.match_substring(parts, "<|")
        small = pc.if_else(pc.and_not(pc.string_is_ascii(parts), special), pc.ascii_lower(parts), parts)
        signed = pc.and_not(_where(_MAY_SIGN[last], small, lambda x: pc.match_substring_regex(x, _SIGNS)), special)
        some = small.filter(signed)
        stem = pc.replace_with_mask(small, signed, pc.replace_substring_regex(some, _SIGNS, r"\1"))
        none = pa.array([""]).take(pa.array(np.zeros(len(small), np.int64)))
        tail = pc.replace_with_mask(none, signed, pc.replace_substring_regex(some, r"(?s)^.*" + _SIGNS, r"\2"))
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        place = self._places(both.dictionary)[both.indices.to_numpy()].reshape(2, -1)
        # the ids of each different part, and then of all
        pieces = place.T.ravel()
        both = self._counts[pieces]
        ids = self._ids[_spread((np.cumsum(self._counts) - self._counts)[pieces], both)]
        size = both.reshape(-1, 2).sum(axis=1)
        code = codes.indices.to_numpy()
        many = size[code]
        upto = np.concatenate(([0], np.cumsum(many)))
        flat = ids[_spread((np.cumsum(size) - size)[code], many)]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            stops = upto[a + 1 : b + 1][ends[code[a:b]]] - upto[a]
            out.append((flat[upto[a] : upto[b]], stops))
        return out


@dataclass
class _Doc:
    """The part of a document that is not packed yet: ``ids`` from token ``start`` on."""

    id: object
    start: int
    total: int
    ids: np.ndarray
    stops: np.ndarray


def candidates(docs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Token counts at which a sequence may end, from 0 up, and what each cut costs.

    docs: the number of tokens of each document and the counts at its sentence ends.
    """
    ends = np.cumsum([n for n, _ in docs])
    inside = [stops + end - n for (n, stops), end in zip(docs, ends)]
    stops = np.unique(np.concatenate([[0], *inside, ends])).astype(np.int64)
    gaps = np.flatnonzero(np.diff(stops) > 2 * STEP)
    extra = [np.arange(stops[g] + STEP, stops[g + 1], STEP) for g in gaps]
    at = np.unique(np.concatenate([stops, *extra]))
    price = np.full(len(at), WITHIN)
    price[np.searchsorted(at, stops)] = SENTENCE
    price[np.searchsorted(at, ends)] = 0
    price[0] = 0
    return at, price


def best_cuts(at: np.ndarray, price: np.ndarray, size: int = SIZE) -> tuple[list[int], int]:
    """The cheapest sequence ends, as indices into ``at`` from after 0 to its last, and their cost.

    Neighbours in ``at`` are at most ``size`` apart.
    """
    n = len(at)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = min(LEAST, size)
    while power < size:
        k = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[np.minimum(k, n - 1)] == at - power)).tolist():
            exact[j].append(int(k[j]))
        power *= 2
    places, prices = at.tolist(), price.tolist()
    cost, rank, back = [0] * n, [0] * n, [0] * n
    rank[0] = places[0]
    queue = deque([0])
    for j in range(1, n):
        t = places[j]
        while places[queue[0]] < t - size:
            queue.popleft()
        i = queue[0]
        least = rank[i] + size - t
        for k in exact[j]:
            if cost[k] < least:
                i, least = k, cost[k]
        cost[j] = least = least + SEQUENCE + prices[j]
        back[j] = i
        rank[j] = least = least + t
        while queue and rank[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1], cost[-1]


def _tail(length: int, size: int) -> list[int]:
    """Lengths into which the last sequence of a partition is split."""
    powers = [1 << b for b in range(length.bit_length()) if length >> b & 1][::-1]
    splits = (len(powers) - 1) * (SEQUENCE + WITHIN)
    return powers if splits < size - length else [length]


class _Packer:
    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.docs: list[_Doc] = []
        self.tokens = 0

    def add(self, doc: _Doc):
        self.docs.append(doc)
        self.tokens += len(doc.ids)
        if self.tokens >= BLOCK:
            yield from self.pack(last=False)

    def pack(self, last: bool):
        if not self.docs:
            return
        at, price = candidates([(len(d.ids), d.stops) for d in self.docs])
        ends = at[best_cuts(at, price, self.size)[0]].tolist()
        open_end = ends.pop()
        lengths = np.diff([0, *ends]).tolist()
        if last:
            lengths += _tail(open_end - (ends[-1] if ends else 0), self.size)
        for length in lengths:
            yield from self.sequence(length)

    def sequence(self, length: int):
        offset = 0
        done = 0
        while offset < length:
            doc = self.docs[done]
            n = min(length - offset, len(doc.ids))
            ids = doc.ids[:n]
            yield doc.id, doc.start, n, zlib.crc32(ids.astype("<u4").tobytes()), doc.total, self.next, offset
            offset += n
            if n == len(doc.ids):
                done += 1
            else:
                stops = doc.stops[doc.stops > n] - n
                self.docs[done] = _Doc(doc.id, doc.start + n, doc.total, doc.ids[n:], stops)
        del self.docs[:done]
        self.tokens -= length
        self.next += 1


def packed(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    ``tokenizer`` is the path of a tokenizer file, read by the driver. A document is the
    ids of its text and then ``end``; a null or empty text has ``end`` only. Every id
    lies in one piece. Pieces: ``id``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32`` (of little-endian unsigned 32-bit ids), ``doc_tokens``,
    ``sequence_id`` (unique over partitions) and ``offset`` in the sequence, from 0
    without gaps. Repeated rows and ids are packed as they come; no rows: no pieces.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    kind = docs.schema[id].dataType

    def rows(batches):
        encoder = Encoder(content)
        packer = _Packer(size, TaskContext.get().partitionId() << 33)
        schema = None

        def table(pieces):
            columns = list(zip(*pieces)) if pieces else [()] * 7
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema)], names=names)

        names = [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            schema = [batch.schema.field(0).type] + [pa.int64()] * 6
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            pieces = []
            for a, b in slices(pc.binary_length(texts).to_pylist(), _TEXT):
                for key, (tokens, stops) in zip(ids[a:b], encoder.encode(texts.slice(a, b - a))):
                    tokens = np.append(tokens, np.uint32(end))
                    pieces += packer.add(_Doc(key, 0, len(tokens), tokens, stops))
            yield table(pieces)
        if schema:
            yield table(list(packer.pack(last=True)))

    return docs.select(F.col(id), text_of(text).alias("text")).mapInArrow(
        rows,
        f"`{id}` {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
