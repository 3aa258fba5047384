"""Loaders of the workloads' tables: schema first, then rows in bulk, all made by Spark from a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.engine import Engine
from tessera.sources import generators as g

# The workloads' schemas.
MICRO = {"item": "i_id int, i_im_id int, i_name varchar(24), i_price double, i_data varchar(50)"}
YCSB = {"ycsb": ", ".join(["ycsb_id varchar(33)", *(f"ycsb_{i} varchar(33)" for i in range(1, 10))])}
TPCC = {
    "warehouse": "w_id int, w_name varchar(25), w_tax double, w_ytd double",
    "district": "d_id int, d_w_id int, d_tax double, d_ytd double, d_next_o_id int",
    "customer": "c_id int, c_d_id int, c_w_id int, c_last varchar(25), c_credit varchar(2), c_discount double, c_balance double, c_data varchar(500)",
    "history": "h_c_id int, h_c_d_id int, h_c_w_id int, h_d_id int, h_w_id int, h_date long, h_amount double, h_data varchar(24)",
    "new_order": "no_o_id int, no_d_id int, no_w_id int",
    "orders": "o_id int, o_d_id int, o_w_id int, o_c_id int, o_entry_d long, o_carrier_id int, o_ol_cnt int, o_all_local int",
    "order_line": "ol_o_id int, ol_d_id int, ol_w_id int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_delivery_d long, ol_quantity int, ol_amount double, ol_dist_info varchar(24)",
    "item": MICRO["item"],
    "stock": "s_i_id int, s_w_id int, s_quantity int, s_ytd int, s_order_cnt int",
}
TPCE = {
    "customer_account": "ca_id long, ca_b_id long, ca_c_id long, ca_name varchar(50), ca_bal double",
    "customer": "c_id long, c_l_name varchar(25), c_f_name varchar(20), c_tier int",
    "broker": "b_id long, b_name varchar(49)",
    "security": "s_symb varchar(15), s_name varchar(70)",
    "last_trade": "lt_s_symb varchar(15), lt_price double",
    "trade_type": "tt_id varchar(3), tt_name varchar(12)",
    "trade": "t_id long, t_dts long, t_st_id varchar(4), t_tt_id varchar(3), t_is_cash int, t_s_symb varchar(15), t_qty int, t_bid_price double, t_ca_id long, t_exec_name varchar(49), t_trade_price double, t_chrg double, t_comm double, t_tax double, t_lifo int",
    "trade_history": "th_t_id long, th_dts long, th_st_id varchar(4)",
}


def create(engine: Engine, schemas: dict[str, str], tables: Sequence[str] | None = None) -> None:
    for name in tables or schemas:
        engine.execute(f"create table {name} ({schemas[name]})")


def load(engine: Engine, schemas: dict[str, str], rows: dict[str, DataFrame]) -> dict[str, int]:
    """Creates all tables and fills those that rows are given for; the number of rows of each."""
    create(engine, schemas)
    return {name: engine.insert(name, df) for name, df in rows.items()}


def _ids(engine: Engine, n: int, **columns: Column) -> DataFrame:
    return engine.spark.range(1, n + 1).select(*(c.alias(name) for name, c in columns.items()))


def micro(engine: Engine, items: int = 100_000, seed: int = 1) -> dict[str, int]:
    """Items with random names, prices of two decimals and data."""
    i = F.col("id").cast("int")
    return load(engine, MICRO, {"item": _ids(engine, items, i_id=i, i_im_id=g.whole(1, 10_000, seed).cast("int"), i_name=g.text(14, 24, seed + 100), i_price=g.fixed(1, 100, 2, seed + 200), i_data=g.text(26, 50, seed + 300))})


def ycsb(engine: Engine, rows: int = 100_000, first: int = 1) -> dict[str, int]:
    """Rows of ten fields; the id is a number of 33 digits, each field the id too."""
    name = F.lpad((F.col("id") + first - 1).cast("string"), 33, "0")
    return load(engine, YCSB, {"ycsb": _ids(engine, rows, ycsb_id=name, **{f"ycsb_{i}": name for i in range(1, 10)})})


def tpcc(engine: Engine, warehouses: int = 1, items: int = 100_000, customers: int = 3000, seed: int = 1) -> dict[str, int]:
    """Warehouses of ten districts, each with its customers, and a stock of all items in each warehouse."""
    i, ten = F.col("id").cast("int"), lambda n: ((F.col("id") - 1) % n + 1).cast("int")
    up = lambda n: (F.floor((F.col("id") - 1) / n) + 1).cast("int")
    tax = lambda s: g.fixed(0, 0.2, 4, s)
    number = (F.col("id") - 1) % customers
    last = g.last_name(F.when(number < 1000, number).otherwise(g.skewed(255, 0, 999, 7, seed + 20)))
    return load(engine, TPCC, {
        "warehouse": _ids(engine, warehouses, w_id=i, w_name=g.text(6, 10, seed + 30), w_tax=tax(seed + 1), w_ytd=F.lit(300000.0)),
        "district": _ids(engine, 10 * warehouses, d_id=ten(10), d_w_id=up(10), d_tax=tax(seed + 2), d_ytd=F.lit(30000.0), d_next_o_id=F.lit(customers + 1)),
        "customer": _ids(engine, 10 * warehouses * customers, c_id=ten(customers), c_d_id=((F.floor((F.col("id") - 1) / customers) % 10) + 1).cast("int"), c_w_id=up(10 * customers), c_last=last, c_credit=g.weighted(["GC", "BC"], [9, 1], seed + 4), c_discount=g.fixed(0, 0.5, 4, seed + 5), c_balance=F.lit(-10.0), c_data=g.text(300, 500, seed + 400)),
        "item": _ids(engine, items, i_id=i, i_im_id=g.whole(1, 10_000, seed + 6).cast("int"), i_name=g.text(14, 24, seed + 1000), i_price=g.fixed(1, 100, 2, seed + 7), i_data=g.text(26, 50, seed + 1100)),
        "stock": _ids(engine, items * warehouses, s_i_id=ten(items), s_w_id=up(items), s_quantity=g.whole(10, 100, seed + 8).cast("int"), s_ytd=F.lit(0), s_order_cnt=F.lit(0)),
    })
