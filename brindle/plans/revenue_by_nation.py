"""Revenue by customer nation for the orders of one period.

The joins go fact to dimension (order, customer, nation) and totals are taken
before each dimension join, so only the first join sees line items. That join
is the one place where a hot key meets raw rows. Adaptive execution splits such
a partition; where a session has that turned off, line items are totalled per
order first. Totalling always would cost more than it saves while orders have
only a few lines each, scattered over the files.

Lines are priced without errors, and those with an amount out of range are
counted along. Only what the last join keeps decides whether that is an error,
so both plans give the same answer or the same error.

Nothing is hinted to broadcast: Catalyst broadcasts a side when its size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.money import beyond_money, discounted_units, from_units, unless_beyond
from brindle.operators.totals import total_by
from brindle.sources.tables import read_table

START = dt.date(1996, 1, 1)
END = dt.date(1997, 1, 1)

ORACLE_SQL = """
SELECT n_name,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))
                * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DECIMAL(38,4)) AS revenue,
       COUNT(*) AS n
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'
  AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
GROUP BY n_name
"""


def _splits_hot_partitions(spark: SparkSession) -> bool:
    return all(
        spark.conf.get(key).lower() == "true"
        for key in (
            "spark.sql.adaptive.enabled",
            "spark.sql.adaptive.skewJoin.enabled",
        )
    )


def _priced(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(
        key,
        discounted_units(F.col("l_extendedprice"), F.col("l_discount")).alias("revenue"),
        F.lit(1).cast("bigint").alias("n"),
        beyond_money(F.col("l_extendedprice"), F.col("l_discount")).alias("beyond"),
    )


def revenue_by_nation(
    lineitem: DataFrame,
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    start: dt.date = START,
    end: dt.date = END,
) -> DataFrame:
    """``n_name``, ``revenue`` and number of lines ``n``, ``start <= o_orderdate < end``.

    Price and discount may be of any numeric type. An amount out of the range of
    ``money`` on a line of the answer is an error under ANSI and else left out of
    the sum; on other lines it does not matter.
    """
    period = orders.filter(
        (F.col("o_orderdate") >= F.lit(start)) & (F.col("o_orderdate") < F.lit(end))
    )
    same_order = F.col("l_orderkey") == F.col("o_orderkey")
    if _splits_hot_partitions(lineitem.sparkSession):
        # priced after the join: two doubles to shuffle, and only lines of the period to convert
        lines = _priced(lineitem.join(period, same_order), "o_custkey")
    else:
        lines = total_by(_priced(lineitem, "l_orderkey"), "l_orderkey").join(
            period, same_order
        )
    by_customer = total_by(lines, "o_custkey")
    by_nation = total_by(
        by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")),
        "c_nationkey",
    )
    by_name = total_by(
        by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name"
    )
    revenue = unless_beyond(from_units(F.col("revenue")), F.col("beyond"))
    return by_name.select("n_name", revenue.alias("revenue"), "n")


def from_tables(spark: SparkSession, root: str) -> DataFrame:
    """The query over the parquet tables under ``root``."""
    return revenue_by_nation(
        *(read_table(spark, root, t) for t in ("lineitem", "orders", "customer", "nation"))
    )
