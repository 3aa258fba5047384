"""Running totals, positions, and sets of orders and payments, against one after the other in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import prefix
from tessera.plans import order_sets, procedures
from tessera.plans.engine import Engine
from tessera.sources import loaders


def test_running(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 1, 2]), r.choice([None, 5, r.randint(0, 9)]), i, r.choice([None, r.randint(-3, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, o int, i int, v int").repartition(5)
    got = prefix.running(df, ["k"], [("o", False), ("i", True)], {"total": F.col("v").cast("bigint"), "n": F.lit(1)})
    assert got.columns == ["k", "o", "i", "v", "total", "n"]
    want, sums = {}, {}
    for k, _, i, v in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2])):
        t, n = sums.get(k, (0, 0))
        want[i] = sums[k] = (t + (v or 0), n + 1)
    assert {x.i: (x.total, x.n) for x in got.collect()} == want
    assert prefix.running(df.where("false"), ["k"], [("o", True)], {"t": F.col("v")}).collect() == []


def test_positions_of_one_value(spark):
    """A value that all rows share is cut over ranges; positions are whole and windows see a range."""
    df = spark.range(5000).withColumn("same", F.lit(1))
    got = prefix.positions(df, [("same", True)])
    assert sorted(r.position for r in got.collect()) == list(range(1, 5001))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Exchange SinglePartition")[1:]
    assert all(x.splitlines()[1].lstrip(" +-:*()0123456789").startswith("HashAggregate(keys=[_range") for x in plan)  # totals, a row a range


@pytest.mark.parametrize("start", [0, 5, 10, 50, 100, 400])
def test_quantities(spark, start):
    r = random.Random(start)
    left, total, want = start, 0, []
    for _ in range(60):
        q = r.randint(1, 91)
        left = left - q + 91 if left - q < 10 else left - q
        total += q
        want.append((total, left))
    got = spark.createDataFrame(want, "t int, w int").select(order_sets.quantity_after(F.lit(start), F.col("t")).alias("g"), "w").collect()
    assert all(x.g == x.w for x in got)


@pytest.fixture
def shop(spark):
    e = Engine(spark)
    loaders.load(e, loaders.TPCC, {
        "warehouse": spark.createDataFrame([(1, 0.1, 0.0, "a"), (2, 0.2, 1.0, "b")], "w_id int, w_tax double, w_ytd double, w_name string"),
        "district": spark.createDataFrame([(d, w, 0.05, 0.0, 1 + d) for w in (1, 2) for d in (1, 2)], "d_id int, d_w_id int, d_tax double, d_ytd double, d_next_o_id int"),
        "customer": spark.createDataFrame([(c, d, w, "n", "BC" if c == 1 else "GC", 0.1, 10.0, "old") for c in (1, 2) for w in (1, 2) for d in (1, 2)], "c_id int, c_d_id int, c_w_id int, c_last string, c_credit string, c_discount double, c_balance double, c_data string"),
        "item": spark.createDataFrame([(i, i, "x", float(i), "y") for i in range(1, 6)], "i_id int, i_im_id int, i_name string, i_price double, i_data string"),
        "stock": spark.createDataFrame([(i, w, 20 * i, 0, 0) for i in range(1, 6) for w in (1, 2)], "s_i_id int, s_w_id int, s_quantity int, s_ytd int, s_order_cnt int"),
    })
    return e


def test_new_orders(spark, shop):
    r = random.Random(2)
    orders = [(s, r.randint(1, 2), r.randint(1, 2), r.randint(1, 2), 7) for s in range(40)] + [(40, 1, 9, 1, 7), (41, 1, 1, 1, 7), (42, 1, 1, 1, 7)]
    lines = [(s, n, r.choice([1, 1, 1, r.randint(1, 5)]), r.randint(1, 2), r.randint(1, 10)) for s, *_ in orders[:41] for n in range(r.randint(1, 6))] + [(41, 0, 99, 1, 3), (41, 1, 1, 1, 3)]
    got = procedures.call(
        shop, "new_orders", orders=spark.createDataFrame(orders, "seq int, o_w_id int, o_d_id int, o_c_id int, o_entry_d long"), lines=spark.createDataFrame(lines, "seq int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_quantity int")
    ).collect()
    stock = {(i, w): [20 * i, 0, 0] for i in range(1, 6) for w in (1, 2)}
    next_, totals, numbers = {(w, d): 1 + d for w in (1, 2) for d in (1, 2)}, {}, {}
    for s, w, d, _, _ in orders[:40]:
        numbers[s], next_[w, d] = next_[w, d], next_[w, d] + 1
        own = sorted((x for x in lines if x[0] == s), key=lambda x: (x[1], x[4]))
        totals[s] = sum(x[4] * float(x[2]) for x in own) * 0.9 * (1 + w / 10 + 0.05)
        for _, _, i, sw, q in own:
            left = stock[i, sw][0] - q
            stock[i, sw] = [left + 91 if left < 10 else left, stock[i, sw][1] + q, stock[i, sw][2] + 1]
    assert {x.seq: x.o_id for x in got} == numbers and all(abs(x.total - totals[x.seq]) < 1e-9 for x in got)
    assert {(x.s_i_id, x.s_w_id): [x.s_quantity, x.s_ytd, x.s_order_cnt] for x in shop.table("stock").collect()} == stock
    assert {(x.d_w_id, x.d_id): x.d_next_o_id for x in shop.table("district").collect()} == next_
    assert shop.table("orders").count() == shop.table("new_order").count() == 40 and shop.table("order_line").count() == sum(x[0] < 40 for x in lines)


def test_quantities_out_of_range(spark, shop):
    bad = spark.createDataFrame([(1, 1, 1, 1, 92)], "seq int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_quantity int")
    with pytest.raises(Exception, match="out of range"):
        order_sets.lines_after(bad, shop.table("stock")).collect()


def test_payments(spark, shop):
    paid = [(s, 1 + s % 2, 1, 1 + s % 3, float(s), 5) for s in range(200)]  # customer 3 is unknown
    procedures.call(shop, "payments", paid=spark.createDataFrame(paid, "seq int, w_id int, d_id int, c_id int, amount double, now long"))
    known = [p for p in paid if p[3] < 3]
    for r in shop.table("customer").collect():
        own = [p for p in known if (p[1], p[2], p[3]) == (r.c_w_id, r.c_d_id, r.c_id)]
        data = "old"
        for _, w, d, c, a, _ in own if r.c_credit == "BC" else ():
            data = f"{c} {d} {w} {a} {data}"[:499]
        assert r.c_balance == 10.0 + sum(p[4] for p in own) and r.c_data == data
    assert {r.w_id: r.w_ytd for r in shop.table("warehouse").collect()} == {w: w - 1 + sum(p[4] for p in known if p[1] == w) for w in (1, 2)}
    assert shop.table("history").count() == len(known)


def test_new_orders_move_lines_three_times(spark, shop, monkeypatch):
    """No order of lines is made and no row of theirs is in a checkpoint: the stock follows from sums."""
    from tessera.operators import prefix, relational

    seen, materialize = [], relational.materialize
    for module in (prefix, order_sets):
        monkeypatch.setattr(module, "materialize", lambda df: (seen.append(df.columns), materialize(df))[1])
    orders = spark.createDataFrame([(s, 1, 1, 1, 7) for s in range(9)], "seq int, o_w_id int, o_d_id int, o_c_id int, o_entry_d long")
    lines = spark.createDataFrame([(s, n, 1, 1, 9) for s in range(9) for n in range(3)], "seq int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_quantity int")
    got = procedures.call(shop, "new_orders", orders=orders, lines=lines)
    assert sorted((r.seq, r.o_id) for r in got.collect()) == [(s, s + 2) for s in range(9)]
    assert not any({"ol_number", "ol_quantity"} & set(c) for c in seen)
    left = 20
    for _ in range(27):
        left = left - 9 + 91 if left - 9 < 10 else left - 9
    assert [tuple(r) for r in shop.table("stock").where("s_i_id = 1 and s_w_id = 1").select("s_quantity", "s_ytd", "s_order_cnt").collect()] == [(left, 243, 27)]


@pytest.mark.parametrize("quantity", [0, 92, None])
def test_new_orders_out_of_range(spark, shop, quantity):
    """A wrong quantity ends the whole set, but not where its order is left out."""
    orders = spark.createDataFrame([(1, 1, 1, 1, 7), (2, 1, 1, 1, 7)], "seq int, o_w_id int, o_d_id int, o_c_id int, o_entry_d long")
    make = lambda *rows: spark.createDataFrame(rows, "seq int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_quantity int")
    with pytest.raises(Exception, match="out of range"):
        procedures.call(shop, "new_orders", orders=orders, lines=make((1, 1, 1, 1, 3), (2, 1, 1, 1, quantity)))
    assert shop.table("orders").count() == shop.table("order_line").count() == 0 and shop.table("stock").where("s_ytd > 0").count() == 0
    got = procedures.call(shop, "new_orders", orders=orders, lines=make((1, 1, 1, 1, 3), (2, 1, 99, 1, 3), (2, 2, 1, 1, quantity)))
    assert [r.seq for r in got.collect()] == [1] and shop.table("stock").where("s_i_id = 1 and s_w_id = 1").first().s_ytd == 3
