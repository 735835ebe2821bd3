"""Collocations: phrases of several words that occur together more than by their parts.

Texts, A-Z lower-cased, are cut into pieces at ``.,;:!?`` and x0A-x0D, and pieces into
words at spaces and tabs. f(phrase) counts the occurrences of its words one after another
within pieces, per language. Candidates are phrases of 2 to ``longest`` words with
f >= ``least``. The lowest-scoring cut of a candidate into a first part and a rest gives
its score, floor(2000000 a / (l + r)). Candidates inside a longer one that has at least
``share`` of a hundred of their occurrences are dropped.

Fingerprints. With prefix polynomials P(i) = sum of byte j * B^j for j < i, modulo 2^64,
the fingerprint of any run of words is (P(end) - P(start)) / B^start: one subtraction and
one product for each n-gram of a batch.

How it is spread out. A phrase is frequent only if all its parts are, so n-grams are
counted in levels: words, pairs of frequent words, longer runs of frequent pairs. Each
task counts its own fingerprints first, and the shuffle adds up their counts. What passes
from a level to the next is a bit table of at most ``TABLE`` bits, the one thing that is
sent to all tasks; a full table would let more pass and change no result. A last
reading cuts out the text of frequent fingerprints only: each task compares all
occurrences of a fingerprint byte by byte with the first, and the shuffle adds up counts
by language and text, with the least pointer (id and byte) to an occurrence. So phrases
that share a fingerprint come apart, and all counts used from there on are exact.
No group of occurrences is ever collected: a word, phrase or language with a third of all rows
is a number from each task. The text itself is never shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, checkpointed, slices, text_of

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
NO_LANGUAGE = "und"
#: Most bits of the table of frequent fingerprints: 16 MB.
TABLE = 1 << 27
#: Bytes of text that are taken at a time, and fingerprints that a task holds.
_TEXT = 2 << 20
_HELD = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0, B^1, ... and their inverses modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        out.append(np.cumprod(table, dtype=np.uint64))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble, so that any bits of a fingerprint serve as a place in a table."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts that lie one after another, joined by single spaces.

    data: the bytes. starts, ends: of each word in them. text: the text of each word.
    ahead: the words that follow it in its piece, ``longest`` - 1 at most.
    """

    def __init__(self, column: pa.Array, longest: int):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, dtype=np.uint8)
        data = _LOWER[data]
        offsets = offsets - offsets[0]
        breaks = _BREAK[data]
        outside = np.ones(len(data) + 1, dtype=bool)
        np.logical_or(breaks, _GAP[data], out=outside[:-1])
        cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins = ~outside
        begins[1:] &= outside[:-1]
        begins[cuts] = ~outside[cuts]
        starts = np.flatnonzero(begins)
        outside[cuts] = True
        stops = np.flatnonzero(outside)
        ends = stops[np.searchsorted(stops, starts, side="right")]
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        #: where each word lies in its own text
        self.at = starts - offsets[self.text]
        piece = np.cumsum(breaks)[starts] if len(starts) else starts
        linked = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.ahead = np.zeros(len(starts), dtype=np.int8)
        run = linked
        for n in range(1, longest):
            self.ahead[: len(run)][run] = n
            run = run[:-1] & linked[n:]
        sizes = ends - starts + 1
        to = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        place = np.arange(total) + np.repeat(starts - to, sizes)
        self.data = np.append(data, np.uint8(32))[place]
        if len(to):
            self.data[to + sizes - 1] = 32
        self.starts, self.ends = to, to + sizes - 1

    def fingerprints(self, n: int, first: np.ndarray) -> np.ndarray:
        """Of the ``n`` words from each of ``first`` on."""
        if not hasattr(self, "_prefix"):
            size = 1 << max(len(self.data), 1 << 16).bit_length()
            self._power, self._inverse = _powers(size)
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * self._power[: len(self.data)]
            self._prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        a, b = self.starts[first], self.ends[first + n - 1]
        return _mixed((self._prefix[b] - self._prefix[a]) * self._inverse[a])


def _in_table(table: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set; ``table`` is a power of two of bytes."""
    place = fingerprints >> np.uint64(64 - (len(table) * 8).bit_length() + 1)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _seed(language: str) -> np.uint64:
    """Mixed into a fingerprint, so that one table serves all languages."""
    raw = language.encode("utf-8", "surrogatepass")
    return _mixed(np.array([int.from_bytes(raw[:8].ljust(8, b"\0"), "little") ^ len(raw) << 56], dtype=np.uint64))[0]


def _levels(words: Words, own: np.ndarray, levels: tuple[int, ...], tables: dict, seed: np.uint64):
    """(n, first word, fingerprint) of the n-grams of one language whose parts the tables hold.

    own: whether each word is of the language. tables: by number of words.
    """
    some = np.flatnonzero(own)
    held = {}
    for k, table in tables.items():
        inside = np.zeros(len(own) + 1, dtype=bool)
        at = some[words.ahead[some] >= k - 1]
        inside[at] = _in_table(table, words.fingerprints(k, at) ^ seed)
        held[k] = inside
    for n in levels:
        at = some[words.ahead[some] >= n - 1]
        for k, inside in held.items():
            if k <= n:
                for i in range(n - k + 1):
                    at = at[inside[at + i]]
        yield n, at, words.fingerprints(n, at) ^ seed


def _by_language(batch: pa.RecordBatch, longest: int):
    """(language, words, whether each is of that language, first row) of parts of a batch (language, text, ...)."""
    languages, texts = batch.column(0), batch.column(1)
    for a, b in slices(pc.binary_length(texts).to_pylist(), _TEXT):
        words = Words(texts.slice(a, b - a), longest)
        codes = languages.slice(a, b - a).dictionary_encode()
        of = codes.indices.to_numpy()[words.text]
        for code, language in enumerate(codes.dictionary.to_pylist()):
            yield language, words, of == code, a


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


def _counted(docs: DataFrame, levels: tuple[int, ...], tables: dict, longest: int, least: int) -> DataFrame:
    """``lang``, ``fp``, ``words``, ``n`` of fingerprints that occur ``least`` times; docs: lang, text, ...

    With the level 1 also the number of words of each language, as ``words`` 0.
    """

    def rows(batches):
        held: dict = {}

        def told():
            for (language, words), parts in held.items():
                keys, counts = _summed(*map(np.concatenate, zip(*parts)))
                yield pa.record_batch(
                    [pa.array([language]).take(pa.array(np.zeros(len(keys), dtype=np.int32))),
                     pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), words, dtype=np.int32)), pa.array(counts)],
                    names=["lang", "fp", "words", "n"],
                )
            held.clear()

        for batch in batches:
            for language, words, own, _ in _by_language(batch, longest):
                for n, _, found in _levels(words, own, levels, tables, _seed(language)):
                    held.setdefault((language, n), []).append(np.unique(found, return_counts=True))
                    if n == 1:
                        every = np.zeros(1, dtype=np.uint64), np.array([len(found)])
                        held.setdefault((language, 0), []).append(every)
                if sum(len(k) for parts in held.values() for k, _ in parts) > 2 * _HELD:
                    for key, parts in held.items():
                        held[key] = [_summed(*map(np.concatenate, zip(*parts)))]
                    if sum(len(parts[0][0]) for parts in held.values()) > _HELD:
                        yield from told()
        yield from told()

    counts = docs.mapInArrow(rows, "lang string, fp bigint, words int, n bigint")
    return counts.groupBy("lang", "fp", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def _table(frequent: DataFrame, most: int = TABLE) -> np.ndarray:
    """A bit table of the fingerprints ``fp``: 16 to 32 bits for each, ``most`` bits at most."""
    wanted = max(frequent.count(), 1) * 16
    bits = min(max(wanted, 1 << 16).bit_length(), most.bit_length() - 1)
    place = F.shiftrightunsigned("fp", 64 - bits)
    parts = (
        frequent.select(F.shiftright(place, 6).alias("k"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int))").alias("b"))
        .groupBy("k")
        .agg(F.bit_or("b").alias("b"))
    )
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    # at most ``most`` / 64 rows of two numbers
    found = parts.toArrow()
    table[found["k"].to_numpy()] = found["b"].to_numpy()
    return table.view(np.uint8)


def _cut_out(words: Words, first: np.ndarray, n: int, found: np.ndarray):
    """The different runs of ``n`` words from ``first`` on: texts, counts, and the first word of one of each.

    found: their fingerprints. Runs of one fingerprint are compared byte by byte.
    """
    order = np.argsort(found, kind="stable")
    first, found = first[order], found[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    heads = np.flatnonzero(new)
    a, sizes = words.starts[first], words.ends[first + n - 1] - words.starts[first]
    group = np.cumsum(new) - 1
    same = sizes == sizes[heads][group]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()))
    mine = words.data[place + np.repeat(a - starts, sizes)]
    head = a[heads][group]
    # a head near the end may be shorter than what is compared with it: then the sizes differ
    theirs = words.data[np.minimum(place + np.repeat(head - starts, sizes), len(words.data) - 1)]
    same &= np.logical_and.reduceat(mine == theirs, starts)
    counts = np.bincount(group[same], minlength=len(heads))
    keep = np.repeat(new, sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes[heads]))).astype(np.int64)
    texts = pa.Array.from_buffers(
        pa.large_binary(), len(heads), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(mine[keep].tobytes())]
    )
    yield texts, counts, first[heads]
    others: dict[bytes, list] = {}
    for i in np.flatnonzero(~same).tolist():
        others.setdefault(mine[starts[i] : starts[i] + sizes[i]].tobytes(), [0, first[i]])[0] += 1
    if others:
        counts, heads = zip(*others.values())
        yield pa.array(list(others), pa.large_binary()), np.array(counts), np.array(heads)


def _frequent_texts(docs: DataFrame, tables: dict, longest: int, least: int, id_type: str) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n``, ``id``, ``at`` of the runs whose fingerprints the tables hold.

    at: bytes of its text before an occurrence. docs: lang, text, id.
    """

    def rows(batches):
        for batch in batches:
            for language, words, own, row in _by_language(batch, longest):
                some, seed = np.flatnonzero(own), _seed(language)
                for n, table in tables.items():
                    at = some[words.ahead[some] >= n - 1]
                    found = words.fingerprints(n, at) ^ seed
                    held = _in_table(table, found)
                    if not held.any():
                        continue
                    for texts, counts, heads in _cut_out(words, at[held], n, found[held]):
                        yield pa.record_batch(
                            [pa.array([language]).take(pa.array(np.zeros(len(texts), dtype=np.int32))),
                             texts.cast(pa.binary()).view(pa.string()), pa.array(np.full(len(texts), n, dtype=np.int32)),
                             pa.array(counts.astype(np.int64)), batch.column(2).take(pa.array(words.text[heads] + row)),
                             pa.array(words.at[heads])],
                            names=["lang", "phrase", "words", "n", "id", "at"],
                        )

    found = docs.mapInArrow(rows, f"lang string, phrase string, words int, n bigint, id {id_type}, at bigint")
    return (
        found.groupBy("lang", "phrase", "words")
        # kept in fixed places of the rows of a hash table, where a struct would be sorted for
        .agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by("at", "id").alias("at"))
        .where(F.col("n") >= least)
    )


def _counted_phrases(docs: DataFrame, longest: int, least: int, id_type: str) -> tuple[DataFrame, DataFrame]:
    """The phrases that occur ``least`` times, as of ``_frequent_texts``, and ``lang``, ``n`` of all words."""
    words = checkpointed(_counted(docs, (1,), {}, longest, least))
    tables = {1: _table(words.where("words = 1"))}
    pairs = checkpointed(_counted(docs, (2,), {1: tables[1]}, longest, least))
    tables[2] = _table(pairs)
    if longest > 2:
        longer = checkpointed(_counted(docs, tuple(range(3, longest + 1)), {2: tables[2]}, longest, least))
        tables |= {n: _table(longer.where(F.col("words") == n)) for n in range(3, longest + 1)}
    phrases = checkpointed(_frequent_texts(docs, tables, longest, least, id_type))
    return phrases, words.where("words = 0").select("lang", "n")


def _part(words: str, first, n):
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    share: int = SHARE,
    top: int = TOP,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of each language by score, then count, then bytes of the phrase.

    ``lang``, ``rank`` from 1, ``phrase`` (its words joined by a space), ``a`` its count, ``l``
    and ``r`` those of the parts at the lowest-scoring cut (of equal ones after the fewest words),
    ``n`` all words of the language, ``score``, and ``id`` and ``at``, the least id of a row that
    holds the phrase and the bytes before it there (null if all ids are). A null language is ``und``, as is a language of
    that name; a null text is empty. Repeated rows each count; no rows, or no frequent phrase: no
    rows. Other columns are not looked at. ``longest`` is 2 or more. The text is read four
    times: ``docs`` should be files or a checkpoint. Lowers the session's Arrow batch limits.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id].dataType.simpleString()
    given = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text_of(text).alias("text"), F.col(id).alias("id")
    )
    phrases, totals = _counted_phrases(given, longest, least, id_type)
    several = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))

    k = F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    cuts = several.select("lang", "phrase", "words", F.col("n").alias("a"), "w", k).select(
        "lang", "phrase", "a", "k",
        _part("w", F.lit(1), F.col("k")).alias("first"), _part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    known = phrases.select("lang", "phrase", "n")
    sided = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    # products beyond 64 bits: decimals are exact, and so is div
    score = F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (
        sided.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    )

    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " i -> array_join(slice(w, i, m), ' '))))"
    )
    longer = (
        several.where("words > 2")
        .select("lang", F.explode(inner).alias("phrase"), "n")
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    kept = (
        scored.join(longer, ["lang", "phrase"], "left")
        .where(f"longer is null or 100 * cast(longer as decimal(20,0)) < {share} * cast(a as decimal(20,0))")
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    pointed = best.join(phrases.select("lang", "phrase", "id", "at"), ["lang", "phrase"])
    return pointed.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("id").alias(id), "at"
    )
