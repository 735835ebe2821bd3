"""Row-by-row model of the query, for small inputs."""

from __future__ import annotations

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

LINEITEM = "l_orderkey long, l_extendedprice double, l_discount double"
ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
CUSTOMER = "c_custkey long, c_nationkey int"
NATION = "n_nationkey int, n_name string"


def money(x: float) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def revenue_by_nation(lineitem, orders, customer, nation, start, end):
    """``{n_name: (revenue, n)}`` by nested loops over tuples; None never joins."""
    groups = defaultdict(list)
    for l_orderkey, price, discount in lineitem:
        for o_orderkey, o_custkey, date in orders:
            if l_orderkey is None or l_orderkey != o_orderkey:
                continue
            if date is None or not start <= date.date() < end:
                continue
            for c_custkey, c_nationkey in customer:
                if o_custkey is None or o_custkey != c_custkey:
                    continue
                for n_nationkey, n_name in nation:
                    if c_nationkey is None or c_nationkey != n_nationkey:
                        continue
                    known = price is not None and discount is not None
                    groups[n_name].append(
                        money(price) * (1 - money(discount)) if known else None
                    )
    result = {}
    for name, values in groups.items():
        known = [v for v in values if v is not None]
        result[name] = (sum(known, Decimal(0)) if known else None, len(values))
    return result
