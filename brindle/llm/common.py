"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch limits to BATCH_ROWS rows and BATCH_BYTES bytes.

    A Python worker holds a few batches at a time, so this bounds its memory by
    the larger of BATCH_BYTES and one row.
    """
    for key, limit in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= limit):
            spark.conf.set(key, str(limit))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that ``spark.checkpoint.dir`` names.

    Where the setting is missing a local session gets a temporary folder. On a
    cluster that is an error: executors would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, whatever key it was grouped by.

    A join with grouped rows would use their partitioning, and adaptive execution can
    split a hot key of the other side only where both sides have a shuffle of their own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def then(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is evaluated once however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


#: Numbers that ``running`` folds at a time.
RUNNING = 128


def running(numbers: Column, fold=lambda a, b: a + b) -> Column:
    """For each of an array of numbers the fold, from 0 on, of those before it, as bigints.

    ``fold`` is associative, such as a sum or a maximum. An array grown by an aggregate is copied
    at each step, so blocks are folded first and then each by itself: the cost is linear but
    for the number of blocks.
    """
    zero = F.lit(0).cast("bigint")
    none = F.expr("cast(array() as array<bigint>)")

    def folds(values: Column, start: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(start.alias("at"), none.alias("all")),
            lambda done, v: F.struct(
                fold(done["at"], v).cast("bigint").alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all")
            ),
            lambda x: x["all"],
        )

    def of(values: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / RUNNING).cast("int")),
            lambda b: F.slice(values, b * RUNNING + 1, F.lit(RUNNING)),
        )

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda done, v: fold(done, v).cast("bigint")))
        both = F.arrays_zip(blocks.alias("b"), folds(sums, zero).alias("at"))
        return F.flatten(F.transform(both, lambda x: folds(x["b"], x["at"])))

    return then(then(F.transform(numbers, lambda v: v.cast("bigint")), of), joined)


def slices(lengths, most: int):
    """Cut rows into runs of at most ``most`` in total length, each of one row at least."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
