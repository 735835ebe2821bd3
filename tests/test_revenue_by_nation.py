from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brindle import read_table, revenue_by_nation
from brindle.plans.revenue_by_nation import END, START, from_tables
from tests import brute_force

TABLES = ("lineitem", "orders", "customer", "nation")
SCHEMAS = (
    brute_force.LINEITEM,
    brute_force.ORDERS,
    brute_force.CUSTOMER,
    brute_force.NATION,
)
IN_PERIOD = dt.datetime(1996, 6, 1)

# Whole-table totals measured for the specified query.
TOTALS = {
    "sf0.001": (25, Decimal("47001335.7571"), 920),
    "sf0.01": (25, Decimal("455931450.7757"), 9015),
}


def result(df):
    rows = df.collect()
    got = {r.n_name: (r.revenue, r.n) for r in rows}
    assert len(got) == len(rows), "a nation name appears twice"
    return got


def frames(spark, *tables):
    return [spark.createDataFrame(list(t), s) for t, s in zip(tables, SCHEMAS)]


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def check(spark, *tables):
    expected = brute_force.revenue_by_nation(*tables, START, END)
    assert result(revenue_by_nation(*frames(spark, *tables))) == expected
    return expected


def test_totals(spark, sf_dir):
    scale = sf_dir.rsplit("/", 1)[1]
    got = result(from_tables(spark, sf_dir))
    if scale not in TOTALS:
        assert got["NATION_0"] == (Decimal("173120255.6366"), 3344)
        return
    rows = (len(got), sum(v[0] for v in got.values()), sum(v[1] for v in got.values()))
    assert rows == TOTALS[scale]


def test_period_includes_start_and_excludes_end(spark):
    dates = [
        dt.datetime(1995, 12, 31, 23, 59, 59, 999999),
        dt.datetime(1996, 1, 1),
        dt.datetime(1996, 12, 31, 23, 59, 59, 999999),
        dt.datetime(1997, 1, 1),
        None,
    ]
    expected = check(
        spark,
        [(k, 10.0 * (k + 1), 0.0) for k in range(5)],
        [(k, 0, d) for k, d in enumerate(dates)],
        [(0, 0)],
        [(0, "A")],
    )
    assert expected == {"A": (Decimal("50"), 2)}


def test_other_period(spark, sf_dir):
    tables = [read_table(spark, sf_dir, t) for t in TABLES]
    whole = result(revenue_by_nation(*tables, dt.date(1995, 1, 1), dt.date(1997, 1, 1)))
    halves = [
        result(revenue_by_nation(*tables, dt.date(y, 1, 1), dt.date(y + 1, 1, 1)))
        for y in (1995, 1996)
    ]
    none = (Decimal(0), 0)
    assert whole == {
        name: tuple(sum(v) for v in zip(*(h.get(name, none) for h in halves)))
        for name in whole
    }


def test_nulls_and_orphans(spark):
    expected = check(
        spark,
        [(1, 10.0, 0.1), (1, None, 0.1), (2, None, 0.0), (None, 5.0, 0.0)]
        + [(k, 7.0, 0.0) for k in (3, 4, 5, 9)],
        [(k, k, IN_PERIOD) for k in (1, 2, 3, 4, 5)]
        + [(None, 1, IN_PERIOD), (3, None, IN_PERIOD)],
        # 3 has no nation, 4 one that is not listed; 5 is not a customer; 6 has no order
        [(1, 1), (2, 2), (None, 1), (3, None), (4, 9), (6, 1)],
        [(1, "A"), (2, "B"), (None, "C"), (3, "D")],
    )
    assert expected == {"A": (Decimal("9"), 2), "B": (None, 1)}


def test_repeated_parents_multiply_rows(spark):
    expected = check(
        spark,
        [(1, 10.0, 0.0), (1, 1.0, 0.0)],
        [(1, 1, IN_PERIOD), (1, 1, IN_PERIOD), (1, 2, IN_PERIOD)],
        [(1, 1), (1, 2), (2, 1)],
        [(1, "A"), (2, "A"), (2, "B")],
    )
    assert expected == {"A": (Decimal("55"), 10), "B": (Decimal("22"), 4)}


def test_no_rows(spark):
    assert check(spark, [], [], [], []) == {}


def test_long_sums_are_exact(spark):
    rows = [(1, 9999999999.99, 0.01)] * 3000
    expected = check(spark, rows, [(1, 1, IN_PERIOD)], [(1, 1)], [(1, "A")])
    assert expected["A"] == (Decimal("9899999999.9901") * 3000, 3000)


@pytest.mark.parametrize("split", ["true", "false"])
def test_either_plan_under_any_partitioning(spark, conf, split):
    conf(adaptive__skewJoin__enabled=split)
    root = "/root/testdata/sf0.01"
    expected = result(from_tables(spark, root))
    tables = [read_table(spark, root, t) for t in TABLES]
    for parts in (1, 16):
        moved = [t.repartition(parts) for t in tables]
        assert result(revenue_by_nation(*moved)) == expected


@pytest.mark.parametrize("date_type", ["date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("money_type", ["decimal(15,2)", "decimal(18,4)", "double"])
def test_column_types(spark, date_type, money_type):
    root = "/root/testdata/sf0.001"
    lineitem, orders, customer, nation = (read_table(spark, root, t) for t in TABLES)
    lineitem = lineitem.withColumns(
        {c: lineitem[c].cast(money_type) for c in ("l_extendedprice", "l_discount")}
    )
    orders = orders.withColumn("o_orderdate", orders.o_orderdate.cast(date_type))
    got = revenue_by_nation(lineitem, orders, customer, nation)
    assert result(got) == result(from_tables(spark, root))


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    ("money_type", "price", "want"),
    [
        ("int", 30_000_000, "28500000.0000"),
        ("bigint", 30_000_000, "28500000.0000"),
        ("float", 98765432.0, "93827160.4000"),
        ("decimal(18,4)", Decimal("98765432.0049"), "93827160.4000"),
    ],
)
def test_large_prices_of_any_type(spark, conf, ansi, money_type, price, want):
    conf(ansi__enabled=ansi)
    lines = spark.createDataFrame(
        [(1, price, 0.05)], f"l_orderkey long, l_extendedprice {money_type}, l_discount double"
    )
    rest = frames(spark, [], [(1, 1, IN_PERIOD)], [(1, 1)], [(1, "A")])[1:]
    assert result(revenue_by_nation(lines, *rest)) == {"A": (Decimal(want), 1)}


@pytest.mark.parametrize("split", ["true", "false"])
@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("case", ["outside the period", "no order", "no customer", "in the answer"])
def test_amounts_out_of_range(spark, conf, case, ansi, split):
    conf(ansi__enabled=ansi, adaptive__skewJoin__enabled=split)
    order = {
        "outside the period": [(2, 1, dt.datetime(1999, 1, 1))],
        "no order": [],
        "no customer": [(2, 9, IN_PERIOD)],
        "in the answer": [(2, 1, IN_PERIOD)],
    }[case]
    df = revenue_by_nation(
        *frames(
            spark,
            [(1, 10.0, 0.1), (2, 1e14, 0.0)],
            [(1, 1, IN_PERIOD), *order],
            [(1, 1)],
            [(1, "A")],
        )
    )
    if case == "in the answer" and ansi == "true":
        with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
            df.collect()
    else:
        assert result(df) == {"A": (Decimal(9), 2 if case == "in the answer" else 1)}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, conf, zone):
    root = "/root/testdata/sf0.001"
    expected = result(from_tables(spark, root))
    conf(session__timeZone=zone)
    assert result(from_tables(spark, root)) == expected


key = st.sampled_from([0, 1, 2, 0, 1, 2, None])
cents = st.one_of(st.none(), st.integers(0, 99_999).map(lambda c: c / 100))
percent = st.one_of(st.none(), st.integers(0, 10).map(lambda p: p / 100))
date = st.one_of(
    st.none(), st.datetimes(dt.datetime(1995, 12, 30), dt.datetime(1997, 1, 3))
)


@settings(
    max_examples=12,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    lineitem=st.lists(st.tuples(key, cents, percent), min_size=6, max_size=12),
    orders=st.lists(st.tuples(key, key, date), min_size=4, max_size=8),
    customer=st.lists(st.tuples(key, key), min_size=3, max_size=6),
    nation=st.lists(st.tuples(key, st.sampled_from("AB")), min_size=2, max_size=4),
    split=st.sampled_from(["true", "false"]),
)
def test_matches_brute_force(spark, conf, lineitem, orders, customer, nation, split):
    conf(adaptive__skewJoin__enabled=split)
    check(spark, lineitem, orders, customer, nation)


def hot_tables(spark, root, copies=30_000):
    """A third of all lines on one order; a third of all orders on one customer."""
    from pyspark.sql import functions as F

    ids = spark.range(0, copies * 3, 1, 8)
    third = F.col("id") % 3 == 0
    ids.select(
        F.when(third, F.lit(0)).otherwise(F.col("id")).alias("l_orderkey"),
        (F.col("id") % 5000 / 100 + 1).alias("l_extendedprice"),
        (F.col("id") % 11 / 100).alias("l_discount"),
    ).write.parquet(f"{root}/lineitem.parquet")
    ids.select(
        F.col("id").alias("o_orderkey"),
        F.when(third, F.lit(0)).otherwise(F.col("id") % 500).alias("o_custkey"),
        F.lit(IN_PERIOD).cast("timestamp_ntz").alias("o_orderdate"),
    ).write.parquet(f"{root}/orders.parquet")
    spark.range(500).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 4).cast("int").alias("c_nationkey")
    ).write.parquet(f"{root}/customer.parquet")
    spark.range(4).select(
        F.col("id").cast("int").alias("n_nationkey"),
        F.concat(F.lit("N"), F.col("id")).alias("n_name"),
    ).write.parquet(f"{root}/nation.parquet")


def hot_expected(copies=30_000):
    groups = {f"N{k}": [0, 0] for k in range(4)}
    for i in range(copies * 3):
        order = 0 if i % 3 == 0 else i
        customer = 0 if order % 3 == 0 else order % 500
        group = groups[f"N{customer % 4}"]
        group[0] += (i % 5000 + 100) * (100 - i % 11)
        group[1] += 1
    return {k: (Decimal(v).scaleb(-4), n) for k, (v, n) in groups.items()}


HOT = dict(
    autoBroadcastJoinThreshold="-1",
    adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
    adaptive__skewJoin__skewedPartitionFactor="2",
    adaptive__advisoryPartitionSizeInBytes="32k",
)


@pytest.mark.parametrize(
    ("hash_limit", "join"), [("0", "SortMergeJoin"), ("64m", "ShuffledHashJoin")]
)
def test_hot_order_is_split(spark, conf, capsys, tmp_path, hash_limit, join):
    hot_tables(spark, tmp_path)
    conf(**HOT, adaptive__maxShuffledHashJoinLocalMapThreshold=hash_limit)
    df = from_tables(spark, str(tmp_path))
    assert result(df) == hot_expected()
    assert f"{join}(skew=true)" in plan(df, capsys)


@pytest.mark.parametrize("off", ["adaptive__enabled", "adaptive__skewJoin__enabled"])
def test_hot_order_is_totalled_where_nothing_splits_it(spark, conf, capsys, tmp_path, off):
    hot_tables(spark, tmp_path)
    conf(**HOT, **{off: "false"})
    df = from_tables(spark, str(tmp_path))
    assert result(df) == hot_expected()
    assert re.search(
        r"Keys \[1\]: \[l_orderkey#\d+L?\]\nFunctions \[3\]: \[partial_sum",
        plan(df, capsys),
    )


def test_scans_are_pruned_and_filtered(spark, capsys):
    text = plan(from_tables(spark, "/root/testdata/sf0.01"), capsys)
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert schemas == [
        "l_orderkey:bigint,l_extendedprice:double,l_discount:double",
        "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz",
        "c_custkey:bigint,c_nationkey:int",
        "n_nationkey:int,n_name:string",
    ]
    pushed = re.findall(r"PushedFilters: \[(.*)\]", text)[1]
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in pushed
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in pushed
    for node in ("Cartesian", "NestedLoop", "Python", "Pandas"):
        assert node not in text


def test_large_sides_are_not_broadcast(spark, conf, capsys):
    conf(autoBroadcastJoinThreshold="10k")
    root = "/root/testdata/sf0.1"
    df = from_tables(spark, root)
    text = plan(df, capsys)
    tree = text.split("\n(1) ")[0]
    assert tree.count("SortMergeJoin") == 2
    assert tree.count("BroadcastHashJoin") == 1  # nation
    got = result(df)
    conf(autoBroadcastJoinThreshold="10m")
    assert got == result(from_tables(spark, root))


def test_lines_are_priced_after_the_join(spark, conf, capsys):
    """The widest shuffle carries the key and two doubles, nothing more."""
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(from_tables(spark, "/root/testdata/sf0.1"), capsys)
    shuffled = re.search(
        r"Exchange\nInput \[(\d)\]: \[(l_orderkey#.*)\]\nArguments: hashpartitioning\(l_orderkey",
        text,
    )
    assert re.sub(r"#\d+L?", "", shuffled[2]) == "l_orderkey, l_extendedprice, l_discount"
