"""SentencePiece encoding and decoding as joins over a lattice of pieces.

White space becomes U+2581, with one in front of the text. No piece goes on after a
word, so a text is a row of words, each a run of U+2581 and what follows up to the next
one; line ends stand alone where no longer piece holds one. Each different word of the
whole input is encoded once:

1. Cells of about ``CELL`` bytes of documents list their different words. These are
   shuffled by a hash of the word, and so each word meets all cells that have it.
2. The substrings of a word of up to the longest piece's length are exploded; an
   equi-join with the piece table keeps the edges of the word's lattice.
3. The edges of each word are folded, those of many words side by side.
4. The ids of a word go back to its cells, where the documents, as rows of numbers of
   words, are spelled with them.

For a unigram model the fold is Viterbi's: the best score up to each character, from
edges that end there; of equal ones the shorter last piece. For a BPE model the highest sum of scores is not what
SentencePiece does, so Viterbi would give wrong ids; the fold merges neighbours instead.
Its state is a bit per character border; each step takes the best edge, the leftmost of
equals, with exactly one border inside, and removes that border and the edges that
end on it. Characters without a piece become byte pieces.

Words of more than ``LONG`` characters of a BPE model are folded by a function with a
heap, since steps times edges would grow with the square of their length.

No text is shuffled: cells are made twice by the same reading, for their words and for
their documents, and named by a checksum of their words, so that two readings that
differ end in an error. What is shuffled is compressed, a row for a cell and a share of the words.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, fresh, text_of

SPACE = "▁"
LONG = 60
#: Bytes of text in a cell, but for its last batch, and edges that are folded at a time.
CELL, EDGES = 12 << 20, 1 << 18
#: Shares of the words for each partition they are shuffled to.
SHARES = 4


def read_model(path: str) -> list[tuple[str, int, float, str]]:
    """(piece, id, score, raw) of a model file: raw is the hex of the piece's bytes.

    Read by the driver; the number of pieces is fixed by the file. Control pieces and
    the unknown piece are left out; byte pieces are named as in the file.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            raw = piece[3:5] if model.is_byte(i) else piece.encode().hex().upper()
            out.append((piece, i, model.get_score(i), raw))
    return out


def _is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")


def _plain(pieces) -> list[tuple[str, int, float, str]]:
    return [p for p in pieces if not _is_byte(p[0])]


def _packed(*numbers: np.ndarray, data: bytes = b"") -> bytes:
    """Numbers below 2^32, each array as its low bytes, then the next, and data, compressed."""
    planes = [np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbers]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*planes, data]))


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _numbers(raw: bytes, n: int, start: int = 0) -> np.ndarray:
    """The ``n`` numbers whose planes begin at byte ``start``."""
    planes = np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=start).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, and where each begins, with the end."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2] if offsets[0] < offsets[-1] else None
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each i the ``many[i]`` numbers from ``first[i]`` on, one after the other."""
    upto = np.cumsum(many)
    return np.repeat(first - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)


def _words(texts: pa.Array, apart: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts, with spaces for U+2581, and which is the first of each text, with the end.

    ``apart``: line ends are words of their own. No text is null.
    """
    texts = pc.replace_substring(texts, SPACE, " ")
    some = pc.greater(pc.binary_length(texts), 0)
    data, offsets = _bytes_of(pc.if_else(some, pc.binary_join_element_wise(" ", texts, ""), ""))
    del texts
    cut = np.append(data == 32, True)
    cut[1:-1] &= data[:-1] != 32
    if apart:
        ends = data == 10
        cut[:-1] |= ends
        cut[1:] |= ends
        del ends
    cut[offsets] = True
    bounds = np.flatnonzero(cut).astype(np.int32)
    del cut
    return _strings(data, bounds).dictionary_encode(), np.searchsorted(bounds, offsets)


def _cells(apart: bool, shares: int | None):
    """For mapInArrow over (id, text, part): rows (share, cell, n, blob) of the different words of each cell.

    A share's words are numbered in the cell as they first occur. Without ``shares`` rows (cell, kind, keys, blob) instead:
    the documents as numbers of words. A cell is a part of a task's rows, in their order.
    """

    def shared(cell: int, dictionary: pa.Array) -> Iterator[pa.RecordBatch]:
        data, offsets = _bytes_of(dictionary)
        raw = data.tobytes()
        share = np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets, offsets[1:])], dtype=np.int64) % shares
        order = np.argsort(share, kind="stable")
        bounds = np.searchsorted(share[order], np.arange(shares + 1))
        size = np.diff(offsets)
        rows = []
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[k] : bounds[k + 1]]
            text = data[_spread(offsets[own], size[own])].tobytes()
            rows.append((k, cell, len(own), _packed(np.diff(own, prepend=0), size[own], data=text)))
        columns = list(zip(*rows)) if rows else [()] * 4
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["share", "cell", "n", "blob"])

    def rows(batches):
        held, size, n, part = [], 0, 0, 0

        def cell_of():
            keys, texts = (pa.concat_arrays(x) for x in zip(*held))
            held.clear()
            words, first = _words(texts, apart)
            del texts
            data, offsets = _bytes_of(words.dictionary)
            mark = zlib.crc32(offsets.tobytes(), zlib.crc32(data.tobytes())) >> 1
            cell = part << 43 | n << 31 | mark
            if shares:
                yield from shared(cell, words.dictionary)
            else:
                blob = _packed(np.array([len(words.dictionary)]), np.diff(first), words.indices.to_numpy())
                one = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                columns = [pa.array([cell], pa.int64()), pa.array([1], pa.int32()), one, pa.array([blob], pa.binary())]
                yield pa.record_batch(columns, names=["cell", "kind", "keys", "blob"])

        for batch in batches:
            if len(batch):
                part = batch.column(2)[0].as_py()
                held.append((batch.column(0), batch.column(1)))
                size += pc.sum(pc.binary_length(batch.column(1))).as_py()
            if size >= CELL:
                yield from cell_of()
                pa.default_memory_pool().release_unused()
                size, n = 0, n + 1
        if held:
            yield from cell_of()
        pa.default_memory_pool().release_unused()

    return rows


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, places) of each different word of a partition of shares; places: its cells, and then its numbers there."""
    texts, cells, numbers = [], [], []
    for batch in batches:
        for cell, n, blob in zip(*(batch.column(c).to_pylist() for c in ("cell", "n", "blob"))):
            raw = _unpacked(blob)
            size = _numbers(raw, n, 4 * n)
            texts.append(_strings(np.frombuffer(raw, np.uint8, offset=8 * n), np.append(0, np.cumsum(size))))
            cells.append(np.full(n, cell, dtype=np.int64))
            numbers.append(np.cumsum(_numbers(raw, n)))
    if not texts:
        return
    words = pa.concat_arrays(texts).dictionary_encode()
    code = words.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    at = np.append(0, np.cumsum(np.bincount(code, minlength=len(words.dictionary))))
    cells, numbers = np.concatenate(cells)[order], np.concatenate(numbers)[order].astype(np.int64)
    for a in range(0, len(at) - 1, 2000):
        b = min(a + 2000, len(at) - 1)
        places = [np.stack([cells[x:y], numbers[x:y]]).tobytes() for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist())]
        text = pc.replace_substring(words.dictionary[a:b], " ", SPACE)
        yield pa.record_batch([text, pa.array(places, pa.binary())], names=["word", "places"])


def _edges(words: DataFrame, pieces, most: int) -> DataFrame:
    """w, edge of the edges of each word, in a row; ``edge`` is start << 32 | size * (pieces + 1) + place in ``pieces`` + 1.

    Characters without a piece are edges of place -1. Behind the edges of a word comes its own
    row, of size 0, with word and places. Words of more than ``most`` characters have that row only.
    """
    spark = words.sparkSession
    longest = max((len(p) for p, *_ in pieces), default=1)
    # a join by numbers costs less; equal ones are compared
    table = spark.createDataFrame([(p, k) for k, (p, *_) in enumerate(pieces)], "known string, i int")
    table = F.broadcast(table.select(F.xxhash64("known").alias("hash"), "known", "i"))
    numbered = words.select(F.monotonically_increasing_id().alias("w"), "*", F.length("word").alias("n"))
    starts = numbered.select("*", F.explode(F.expr(f"if(n > {most}, array(n), sequence(0, n))")).alias("start"))
    sizes = F.expr(f"if(start = n, array(0), sequence(1, least({longest}, n - start)))")
    each = starts.select("*", F.explode(sizes).alias("size")).withColumn("piece", F.expr("substring(word, start + 1, size)"))
    found = each.withColumn("hash", F.xxhash64("piece")).join(table, "hash", "left")
    found = found.withColumn("i", F.expr("if(known = piece, i, null)")).where("i IS NOT NULL OR size <= 1")
    edge = F.expr(f"shiftleft(cast(start AS bigint), 32) + size * {len(pieces) + 1}L + coalesce(i, -1) + 1")
    own = [F.when(F.col("size") == 0, F.col(c)).alias(c) for c in ("word", "places")]
    return found.select("w", edge.alias("edge"), *own)


def _inside(m, start, end):
    one = np.uint64(1)
    return np.bitwise_count((m >> (start + one)) & ((one << (end - start - one)) - one))


def _ends(m, start, end):
    return (m >> start) & (m >> end) & np.uint64(1) == 1


def _merged(word: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Which edges are left when neighbours have been merged. rank: the place of the edge's score, -1 without a piece."""
    m = (np.uint64(1) << (chars + 1).astype(np.uint64)) - np.uint64(1)
    s, e = start.astype(np.uint64), end.astype(np.uint64)
    live = np.flatnonzero((end - start > 1) & (rank >= 0))
    live = live[np.argsort((word[live] << 36) | (rank[live] << 6) | start[live])]
    w, a, b = word[live], s[live], e[live]
    while len(w):
        best = np.flatnonzero(_inside(m[w], a, b) == 1)
        best = best[np.diff(w[best], prepend=-1) > 0]
        at = w[best]
        one = np.uint64(1)
        m[at] &= ~(((one << (b[best] - a[best] - one)) - one) << (a[best] + one))
        going = np.zeros(len(m), dtype=bool)
        going[at] = True
        now = m[w]
        keep = going[w] & _ends(now, a, b) & (_inside(now, a, b) > 0)
        w, a, b = w[keep], a[keep], b[keep]
    return _ends(m[word], s, e) & (_inside(m[word], s, e) == 0)


def _cheapest(word: np.ndarray, start: np.ndarray, end: np.ndarray, cost: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Which edges are on the best path of their word; of equal ones those with the shorter last piece."""
    base = np.cumsum(chars + 1) - chars - 1
    score = np.zeros(int((chars + 1).sum()))
    best = np.full(len(score), -1)
    order = np.lexsort((word, end))
    for a in (bounds := np.append(np.flatnonzero(np.diff(end[order], prepend=-1)), len(order)))[:-1]:
        own = order[a : bounds[np.searchsorted(bounds, a) + 1]]
        value = score[base[word[own]] + start[own]] - cost[own]
        own, value = (x[np.lexsort((-start[own], -value, word[own]))] for x in (own, value))
        first = np.diff(word[own], prepend=-1) > 0
        at = base[word[own[first]]] + end[own[first]]
        score[at], best[at] = value[first], own[first]
    kept = np.zeros(len(word), dtype=bool)
    now = base + chars
    while len(now):
        edge = best[now]
        kept[edge] = True
        now = (base[word[edge]] + start[edge])[start[edge] > 0]
    return kept


def _heap(pieces):
    """The ids of one word by the same merges."""
    known = {p: (i, s) for p, i, s, _ in _plain(pieces)}
    first = next((i for p, i, *_ in pieces if _is_byte(p)), 0)

    def fold(word: str) -> list[int]:
        part = list(word)
        after = [*range(1, len(part)), -1]
        before = list(range(-1, len(part) - 1))
        queue = []

        def offer(a: int):
            b = after[a]
            if b >= 0 and (hit := known.get(part[a] + part[b])):
                heapq.heappush(queue, (-hit[1], a, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a)
        while queue:
            _, a, both = heapq.heappop(queue)
            b = after[a]
            if not part[a] or b < 0 or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        ids = []
        for p in filter(None, part):
            ids += [known[p][0]] if p in known else [b + first for b in p.encode("utf-8", "surrogatepass")]
        return ids

    return fold


def _parts(edge: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, size and place of edges."""
    size, place = np.divmod(edge & 0xFFFFFFFF, pieces + 1)
    return edge >> 32, size, place - 1


def _folded(pieces, kind: str):
    """For mapInArrow over the rows of ``_edges``: rows (cell, blob) of the words' ids, to be read by ``_spelled``."""
    plain = _plain(pieces)
    first = next((i for p, i, *_ in pieces if _is_byte(p)), 0)
    ids = np.array([i for _, i, *_ in plain], dtype=np.int64)
    score = np.array([s for *_, s, _ in plain])
    rank = np.append(np.unique(-score, return_inverse=True)[1] if len(plain) else np.zeros(0, np.int64), -1)
    cost = np.append(-score, 10.0 - score.min() if len(plain) else 10.0)
    # what ids spell: the bytes of each, one after the other
    spells = [bytes.fromhex(raw) for _, _, _, raw in sorted(pieces, key=lambda p: p[1])]
    known = np.array(sorted(i for _, i, *_ in pieces), dtype=np.int64)
    spell = np.frombuffer(b"".join(spells), dtype=np.uint8)
    spell_size = np.array([len(x) for x in spells], dtype=np.int64)
    spell_at = np.cumsum(spell_size) - spell_size

    def fold(rows: pa.Table) -> pa.RecordBatch:
        w, start, size, i = rows["w"].to_numpy(), *_parts(rows["edge"].to_numpy(), len(plain))
        last = size == 0
        own = rows.filter(pa.array(last)).combine_chunks()
        words = own["word"].chunk(0)
        chars, own_w = start[last], w[last]
        w, start, size, i = w[~last], start[~last], size[~last], i[~last]
        word = (np.cumsum(last) - last)[~last]
        long = (chars > LONG) if kind == "bpe" else np.zeros(len(chars), dtype=bool)
        single = np.bincount(word[size == 1], minlength=len(chars))
        if (w != own_w[word]).any() or (single != np.where(long, 0, chars)).any():
            raise ValueError("the edges of a word are not in a row")
        end = start + size
        if kind == "bpe":
            kept = _merged(word, start, end, rank[i], np.where(long, 0, chars))
        else:
            kept = _cheapest(word, start, end, cost[i], chars)
        kept = np.flatnonzero(kept)
        kept = kept[np.lexsort((start[kept], word[kept]))]
        word, start, end, i = word[kept], start[kept], end[kept], i[kept]

        # characters without a piece become their bytes
        data, offsets = _bytes_of(words)
        char_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        char = np.cumsum(chars) - chars
        from_ = char_at[char[word] + start]
        many = np.where(i >= 0, 1, char_at[char[word] + end] - from_)
        flat = np.repeat(ids[i] if len(ids) else i, many)
        lone = np.repeat(i < 0, many)
        flat[lone] = data[_spread(from_[i < 0], many[i < 0])].astype(np.int64) + first
        count = np.bincount(word, weights=many, minlength=len(chars)).astype(np.int64)
        if long.any():
            parts = np.split(flat, np.cumsum(count)[:-1])
            for k in np.flatnonzero(long).tolist():
                parts[k] = np.array(heap(words[k].as_py()), dtype=np.int64)
                count[k] = len(parts[k])
            flat = np.concatenate(parts)

        # do the ids spell the word?
        place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        spelled = spell[_spread(spell_at[place], spell_size[place])]
        upto = np.append(0, np.cumsum(np.where(known[place] == flat, spell_size[place], 0)))
        at = np.append(0, np.cumsum(count))
        same = np.diff(upto[at]) == np.diff(offsets)
        if len(spelled) == len(data):
            wrong = np.append(0, np.cumsum(spelled != data))
            same &= np.diff(wrong[offsets]) == 0
        else:
            raw, right = spelled.tobytes(), data.tobytes()
            same &= np.array([raw[upto[at[k]] : upto[at[k + 1]]] == right[offsets[k] : offsets[k + 1]] for k in range(len(same))])

        data, offsets = _bytes_of(own["places"].chunk(0))
        data, size = data.view(np.int64), np.diff(offsets) // 16
        owner = np.repeat(np.arange(len(size)), size)
        cells, numbers = data[_spread(offsets[:-1] // 8, size)], data[_spread(offsets[:-1] // 8 + size, size)]
        order = np.lexsort((numbers, cells))
        cells, numbers, owner = cells[order], numbers[order], owner[order]
        bounds = np.append(np.flatnonzero(np.diff(cells, prepend=-1)), len(cells))
        found = []
        for a, b in zip(bounds, bounds[1:]):
            k = owner[a:b]
            blob = _packed(np.diff(numbers[a:b], prepend=0), 2 * count[k] + same[k], flat[_spread(at[k], count[k])])
            found.append((cells[a], len(k).to_bytes(4, "little") + blob))
        names = ["cell", "blob"]
        columns = list(zip(*found)) if found else [(), ()]
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=names)

    heap = _heap(pieces)

    def rows(batches):
        held, size, before = [], 0, -1
        for batch in batches:
            w = batch.column("w").to_numpy()
            if len(w) and ((np.diff(w) < 0).any() or w[0] < before):
                raise ValueError("the edges of a word are not in a row")
            before = w[-1] if len(w) else before
            held.append(batch)
            size += len(w)
            if size >= EDGES:
                # whole words only
                table = pa.Table.from_batches(held)
                ends = np.flatnonzero(_parts(table["edge"].to_numpy(), len(plain))[1] == 0)
                upto = int(ends[-1]) + 1 if len(ends) else 0
                if upto:
                    yield fold(table.slice(0, upto))
                held = table.slice(upto).combine_chunks().to_batches()
                size = sum(map(len, held)) if upto else 0
        if sum(map(len, held)):
            yield fold(pa.Table.from_batches(held))

    return rows


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, ids, decodes) from those of cells: the blobs of their words, and then that of their documents."""
    held, of = [], None
    for batch in batches:
        for k in range(len(batch)):
            cell, kind, blob = (batch.column(c)[k].as_py() for c in ("cell", "kind", "blob"))
            if cell != of:
                if held:
                    raise ValueError("the documents changed while they were read")
                of = cell
            if kind == 0:
                held.append(blob)
                continue
            numbers, marks, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for x in held:
                n, raw = int.from_bytes(x[:4], "little"), _unpacked(x[4:])
                numbers.append(np.cumsum(_numbers(raw, n), dtype=np.int64))
                marks.append(_numbers(raw, n, 4 * n).astype(np.int64))
                ids.append(_numbers(raw, int((marks[-1] >> 1).sum()), 8 * n).astype(np.int32))
            held = []
            number, mark, flat = np.concatenate(numbers), np.concatenate(marks), np.concatenate(ids)
            many = mark >> 1
            at = np.cumsum(many) - many
            order = np.argsort(number)

            keys = batch.column("keys")[k].values
            raw = _unpacked(blob)
            different, size = int(_numbers(raw[0:4], 1)[0]), _numbers(raw, len(keys), 4).astype(np.int64)
            if different != len(number) or (number[order] != np.arange(different)).any():
                raise ValueError("the documents changed while they were read")
            words = order[_numbers(raw, int(size.sum()), 4 + 4 * len(keys))]
            upto = np.append(0, np.cumsum(size))
            wrong = np.append(0, np.cumsum(mark[words] & 1 == 0))
            ends = np.append(0, np.cumsum(many[words]))[upto]
            values = pa.array(flat[_spread(at[words], many[words])], pa.int32())
            yield pa.record_batch(
                [keys, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), pa.array(np.diff(wrong[upto]) == 0)],
                names=["id", "ids", "decodes"],
            )
    if held:
        raise ValueError("the documents changed while they were read")


def encoded(docs: DataFrame, pieces, kind: str = "bpe", id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``ids`` and ``decodes`` for every row of ``docs``.

    ``kind`` is ``bpe`` or ``unigram``. ``decodes`` tells whether the ids spell the text again, U+2581 taken as a space. A
    null or empty text has no ids and decodes. Repeated rows each keep their row. ``docs``
    must be stable, such as files or a checkpoint: it is read twice, and rows are told apart by their place.
    Lowers the session's Arrow batch limits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_of(text)).cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // CELL)
    plain = _plain(pieces)
    apart = not any("\n" in p and len(p) > 1 for p, *_ in plain)
    # a task's own number differs in a union
    given = docs.select(F.col(id).alias("id"), text_of(text).alias("text"), F.spark_partition_id().alias("part"))
    listed = given.mapInArrow(_cells(apart, SHARES * parts), "share int, cell bigint, n int, blob binary")
    words = listed.repartition(parts, "share").mapInArrow(_gathered, "word string, places binary")
    edges = _edges(words, plain, LONG if kind == "bpe" else 2**31 - 1)
    folded = edges.mapInArrow(_folded(pieces, kind), "cell bigint, blob binary")
    keys = f"array<{docs.schema[id].dataType.simpleString()}>"
    texts = given.mapInArrow(_cells(apart, None), f"cell bigint, kind int, keys {keys}, blob binary")
    both = folded.select("cell", F.lit(0).alias("kind"), F.lit(None).cast(keys).alias("keys"), "blob").unionByName(texts)
    dealt = both.repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    kept = docs.schema[id].dataType.simpleString()
    done = dealt.mapInArrow(_spelled, f"id {kept}, ids array<int>, decodes boolean")
    return done.select(F.col("id").alias(id), "ids", "decodes")


def decoded(encodings: DataFrame, pieces, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id`` and ``text`` for every row: ids joined to the bytes they stand for, in order.

    Unknown ids stand for nothing; bytes that are no UTF-8 become U+FFFD. The one space in
    front is taken off. Null or no ids: the empty text. ``encodings`` must be stable.
    """
    spark = encodings.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, raw) for _, i, _, raw in pieces], "piece int, raw string"))
    row = fresh(encodings, "row")
    placed = encodings.withColumn(row, F.monotonically_increasing_id())
    each = placed.select(row, F.col(id).alias("id"), F.posexplode_outer(ids).alias("pos", "piece"))
    joined = each.join(table, "piece", "left").groupBy(row).agg(
        F.first("id").alias(id), F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("all")
    )
    raw = F.array_join(F.transform("all", lambda x: F.coalesce(x["raw"], F.lit(""))), "")
    spelled = F.replace(F.make_valid_utf8(F.unhex(raw).cast("string")), F.lit(SPACE), F.lit(" "))
    return joined.select(id, F.regexp_replace(spelled, "^ ", "").alias("text"))
