"""Quality scores from two compression dictionaries.

Text that resembles the good labelled texts compresses better with a dictionary of
them than with one of bad texts. Each block of ``BLOCK`` bytes is compressed on its
own with either dictionary; the difference of the sizes, per byte of text, becomes a
score by logistic regression on labelled texts that are in neither dictionary. A
short text offers few bytes to tell by, so the regression also sees how short it is.

The model is fitted on a bounded sample of the labelled rows, taken in the order of
a hash of the id: up to ``PASSAGE_ROWS`` texts of each class for the dictionaries,
``PASSAGES`` passages of ``PASSAGE`` characters of each, and up to ``CALIBRATE`` whole
texts for the regression. What reaches the driver is bounded by these parameters,
and the dictionaries by ``DICTIONARY`` bytes each. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, text_of

DICTIONARY = 512 << 10
PASSAGE_ROWS = 1024
PASSAGES = 8
PASSAGE = 512
CALIBRATE = 4000
BLOCK = 1024
LEVEL = 6
SEED = 42
#: Bytes added to each length, and the length at which a text counts as half short.
SPARE, SHORT = 64, 100


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text, and the weights of the regression."""

    bad: bytes
    good: bytes
    weights: tuple[float, float, float]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def size_difference(bad: bytes, good: bytes):
    """A UDF: bytes of the text compressed with ``bad`` less those with ``good``."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_bad, with_good = _compressor(bad).compress, _compressor(good).compress
        for texts in batches:
            out = []
            for text in texts:
                raw = text.encode("utf-8", "surrogatepass")
                blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
                out.append(sum(len(with_bad(b)) - len(with_good(b)) for b in blocks))
            yield pd.Series(out, dtype="int64")

    return of


def _inputs(difference: Column, text: Column) -> tuple[Column, Column]:
    size = F.octet_length(text)
    return 100 * difference / (size + SPARE), 1 / (1 + size / SHORT)


def _dictionary(rows: list[list[str]]) -> bytes:
    """Passages of the texts, each different one once, up to DICTIONARY bytes.

    Texts give a passage each in turn, and each text its own in the order of their hash, so
    beginnings, middles and ends have like shares however many texts there are.
    """
    order = lambda p: (xxhash.xxh64_intdigest(p, SEED), p)
    own = [sorted({p.encode("utf-8", "surrogatepass") for p in passages if p}, key=order) for passages in rows]
    parts, size = {}, 0
    for k in range(PASSAGES):
        for passages in own:
            if k < len(passages) and passages[k] not in parts:
                size += len(passages[k]) + 1
                if size > DICTIONARY:
                    return b"\n".join(parts)
                parts[passages[k]] = None
    return b"\n".join(parts)


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, slightly drawn to zero."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.01 * w
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.01 * np.eye(len(w)), slope)
    return w


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """A model from rows of ``labelled``: ``label`` 1 for good, 0 for bad.

    Rows with a null id or another label take no part. Without rows of a class its
    dictionary is empty; without rows to calibrate on, every score is a half.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).select(
        F.xxhash64(F.col(id).cast("string")).alias("order"), F.col(label).cast("int").alias("label"),
        text_of(text).alias("text"),
    )
    half = F.pmod("order", F.lit(2))
    dictionaries = []
    for value in (0, 1):
        # a text of up to PASSAGES * PASSAGE characters is cut up whole, a longer one at even distances
        step = F.greatest(F.lit(PASSAGE), F.floor((F.length("text") - PASSAGE) / (PASSAGES - 1))).cast("int")
        passages = F.transform(
            F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substring("text", 1 + i * step, F.lit(PASSAGE))
        )
        picked = rows.where((F.col("label") == value) & (half == 0)).select("order", passages.alias("p"))
        dictionaries.append(_dictionary([r.p for r in picked.orderBy("order", "p").limit(PASSAGE_ROWS).collect()]))
    picked = rows.where(half == 1).orderBy("order", "label", "text").limit(CALIBRATE)
    difference = size_difference(*dictionaries)(F.col("text"))
    seen = picked.select("label", *_inputs(difference, F.col("text"))).toDF("label", "x", "short").collect()
    if not seen:
        return Model(*dictionaries, (0.0, 0.0, 0.0))
    weights = _regression(np.array([[1, r.x, r.short] for r in seen]), np.array([r.label for r in seen]))
    return Model(*dictionaries, tuple(float(w) for w in weights))


def score(model: Model, text: Column) -> Column:
    """Probability, 0 to 1, that ``text`` would be labelled good; null as the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    x, short = _inputs(size_difference(model.bad, model.good)(text), text)
    a, b, c = model.weights
    return 1 / (1 + F.exp(-F.greatest(F.least(a + b * x + c * short, F.lit(700.0)), F.lit(-700.0))))


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of documents with one label that are not held out.

    A document with both labels is left out. Only the ids that a fit can use are
    joined to the texts: the first of each class and half in the order of the hash.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    parts = [
        ids.where((F.pmod(order, F.lit(2)) == 0) & (F.col("label") == value)).orderBy(order).limit(PASSAGE_ROWS)
        for value in (0, 1)
    ]
    parts.append(ids.where(F.pmod(order, F.lit(2)) == 1).orderBy(order).limit(CALIBRATE))
    # at most 2 * PASSAGE_ROWS + CALIBRATE rows of two numbers
    chosen = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    A null text is scored as the empty one; a null id is not held out. Repeated rows each have
    their score. Without labels every score is a half; no rows: no rows. Other columns are not
    looked at. Lowers the session's Arrow batch limits.
    """
    model = fit(labelled_documents(docs, labels))
    return docs.select(
        "doc_id", held_out().alias("held_out"), score(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_rejects(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; see ``scored``."""
    model = fit(labelled_documents(docs, labels))
    return docs.where(score(model, F.col("text")) >= threshold)
