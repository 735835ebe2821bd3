"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; ``run`` writes each result as Parquet to the folder of ``spark.checkpoint.dir``
and reads it again. Every stage but the last returns the columns of ``documents``;
``n_chars`` follows the text.

Every stage takes null ids and texts (as empty texts), empty and very long texts, repeated
rows, tables without rows (they give none) and further columns of any name, which are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import near_copies, packing, quality, secrets, suffix_dedup
from brindle.llm.common import fresh, written
from brindle.sources.tables import read_table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; all of them where there are no labels.

    Repeated rows stay or go together. Null texts are judged as empty ones.
    """
    return quality.without_rejects(docs, read_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at 0.8 or more, the document with the least id.

    A null id counts as the least; of rows with the same id one stays. Texts without words, nulls
    among them, are one group.
    """
    return near_copies.without_near_copies(docs, size=5, likeness=0.8)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes and more that occur twice, all occurrences.

    Every row stays; a null text, and one of which nothing is left, is empty afterwards.
    """
    return _counted(suffix_dedup.without_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked. Every row stays; a null text is empty afterwards."""
    spans = fresh(docs, "secrets")
    found = secrets.with_secrets(docs, column=spans)
    masked = secrets.masked(F.coalesce("text", F.lit("")), F.col(spans))
    return _counted(found.withColumn("text", masked)).drop(spans)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    An empty text is its end token. Rows with the same or no id are packed one by one.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("simhash", one_of_each_group),
    ("suffix_array", without_repeated_strings),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]

#: SQL can express none of the model, the suffix arrays and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the whole pipeline makes of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
