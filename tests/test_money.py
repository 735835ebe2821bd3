from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle.functions.money import beyond_money, discounted_units, from_units, money, unless_beyond

NEAR_TIES = [1.005, 2.675, 0.125, -0.125, 0.005, -0.005, 0.004999999999999999, 1e9 + 0.005]
EDGES = [None, 0.0, -0.0, 0.01, 99.99, 100.0, 100.01, -99.99, -100.0, -100.01]
LARGE = [1e10 - 0.01, 1e10, -1e10, 1e12 + 0.37, 9999999999999.99, -9999999999999.99]


def amounts():
    rng = random.Random(7)
    return (
        NEAR_TIES
        + EDGES
        + LARGE
        + [rng.uniform(-1e6, 1e6) for _ in range(200)]
        + [rng.randrange(-(10**8), 10**8) / 100 for _ in range(200)]
        + [rng.randrange(-(10**12), 10**12) / 1000 for _ in range(200)]
    )


def differing(spark, rows, kinds=("double", "double")):
    price, discount = F.col("price"), F.col("discount")
    return (
        spark.createDataFrame(rows, f"price {kinds[0]}, discount {kinds[1]}")
        .select(
            "price",
            "discount",
            from_units(discounted_units(price, discount)).alias("got"),
            (money(price) * (1 - money(discount))).cast("decimal(38,4)").alias("want"),
        )
        .filter(~F.col("got").eqNullSafe(F.col("want")))
        .collect()
    )


def pairs():
    rng = random.Random(8)
    values = amounts()
    special = NEAR_TIES + EDGES + LARGE
    return [(a, b) for a in special for b in special] + [
        (a, rng.choice(values)) for a in values for _ in range(20)
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_units_equal_the_decimal_product(spark, conf, ansi):
    conf(ansi__enabled=ansi)
    assert differing(spark, pairs()) == []


def test_amounts_out_of_range_are_null_without_ansi(spark, conf):
    conf(ansi__enabled="false")
    rows = [
        (float("nan"), 0.1),
        (1.0, float("nan")),
        (1.0, float("inf")),
        (1e14, 0.0),
        (1e300, 0.0),
    ]
    assert differing(spark, rows) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_units_fit_the_sum(spark, parts):
    rows = spark.range(0, 70_000, 1, parts).select(
        discounted_units(F.lit(9999999999999.99), F.lit(0.0)).alias("u")
    )
    total = rows.agg(from_units(F.sum("u")).alias("t")).first().t
    assert str(total) == "699999999999999300.0000"


def typed(kind):
    rng = random.Random(9)
    whole = [0, 1, -1, 99, 30_000_000, -30_000_000, 2**31 - 1, *[rng.randrange(10**9) for _ in range(200)]]
    if kind == "int":
        return whole
    if kind == "bigint":
        return [*whole, 10**12, 10**13 - 1]
    if kind == "float":
        return [*map(float, whole), 98765432.0, 0.05, 0.1, 1.005, 123456.78]
    places = Decimal("0.01") if kind == "decimal(15,2)" else Decimal("0.0001")
    return [(Decimal(x) / 97).quantize(places) for x in whole] + [Decimal("9999999999.99"), Decimal("0.05"), Decimal("1.01")]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("kind", ["int", "bigint", "float", "decimal(15,2)", "decimal(18,4)"])
def test_any_numeric_type(spark, conf, kind, ansi):
    conf(ansi__enabled=ansi)
    own = [None, *typed(kind)]
    assert differing(spark, [(x, 0.05) for x in own] + [(x, 0.075) for x in own], (kind, "double")) == []
    assert differing(spark, [(12.34, x) for x in own], ("double", kind)) == []
    assert differing(spark, [(x, y) for x in own[:9] for y in own[:9]], (kind, kind)) == []


def test_large_integers_are_null_without_ansi(spark, conf):
    conf(ansi__enabled="false")
    assert differing(spark, [(184467440737095517, 0.05), (2**63 - 1, 0.0), (-(2**63), 0.1)], ("bigint", "double")) == []


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_amounts_beyond_money_are_counted(spark, conf, ansi):
    conf(ansi__enabled=ansi)
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 0.1, 0), (1e14, 0.1, 1), (1.0, -1e14, 1), (1e300, 1e300, 1), (inf, 0.0, 1), (nan, 0.1, 0), (nan, 1e14, 1)]
    rows += [(None, 0.1, 0), (None, None, 0), (None, 1e14, 1), (1e13, 0.0, 1), (9999999999999.99, 0.0, 0)]
    df = spark.createDataFrame(rows, "price double, discount double, want int")
    got = df.select("want", beyond_money(F.col("price"), F.col("discount")).alias("got"), discounted_units(F.col("price"), F.col("discount")))
    assert all(r.got == r.want for r in got.collect())
    guarded = spark.createDataFrame([(Decimal(9), 0)], "a decimal(38,4), b bigint").select(unless_beyond(F.col("a"), F.col("b")))
    assert guarded.first()[0] == 9
