"""Many new orders, and many payments, as one change of each table.

Orders of a district are numbered by counts before them.  A stock's quantity goes
down by each line's and up by ``REORDER`` where it falls below ``LEAST``.  From the
first time it does, it stays within REORDER numbers from LEAST on and so is known from
the sum of what was ordered alone, modulo REORDER; until then it is the plain difference.
Running sums over ranges of (stock, order, line) therefore give the stock after every
line, also of an item that is in most lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import running
from tessera.operators.relational import materialize
from tessera.plans.catalog import Folder
from tessera.plans.engine import Engine
from tessera.plans.procedures import procedure, upsert
from tessera.sources.files import scratch

LEAST, REORDER = 10, 91
#: Notes of a customer's latest payments that a text of 499 letters can hold: each has ten or more.
NOTES = 50


def quantity_after(quantity: Column, ordered: Column) -> Column:
    """Stock after lines of ``ordered`` in all, each of 1 to REORDER."""
    left = quantity - ordered
    return F.when(left >= LEAST, left).otherwise(F.pmod(left - LEAST, F.lit(REORDER)) + LEAST)


def lines_after(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines (seq, ol_number, ol_i_id, ol_supply_w_id, ol_quantity, ...) with the stock's quantity after each, in the order of seq, line and quantity.

    Lines of an unknown stock are left out; a quantity beyond 1 to REORDER raises.
    """
    wrong = ~F.col("ol_quantity").between(1, REORDER) | F.col("ol_quantity").isNull()
    checked = lines.withColumn("ol_quantity", F.when(wrong, F.raise_error(F.lit("a quantity is out of range"))).otherwise(F.col("ol_quantity")))
    summed = running(checked, ["ol_i_id", "ol_supply_w_id"], [("seq", True), ("ol_number", True), ("ol_quantity", True)], {"ordered": F.col("ol_quantity").cast("bigint"), "lines_before": F.lit(1).cast("bigint")})
    met = summed.join(stock.select("s_i_id", "s_w_id", "s_quantity", "s_ytd", "s_order_cnt"), (F.col("s_i_id") == F.col("ol_i_id")) & (F.col("s_w_id") == F.col("ol_supply_w_id")))
    return met.select(*lines.columns, quantity_after(F.col("s_quantity"), F.col("ordered")).alias("s_quantity"), (F.col("s_ytd") + F.col("ordered")).alias("s_ytd"), (F.col("s_order_cnt") + F.col("lines_before")).alias("s_order_cnt"))


def _kept(engine: Engine, df: DataFrame) -> tuple[DataFrame, Folder]:
    """A copy in files of columns, a fraction of a checkpoint's size, and the folder that has them."""
    path = f"{scratch(engine.spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return engine.spark.read.schema(df.schema).parquet(path), Folder(engine.spark, path)


def _inserted(engine: Engine, table: str, rows: DataFrame) -> DataFrame:
    """Inserts rows and gives them as they are stored."""
    before = set(engine.catalog.manifest(table)["files"])
    engine.insert(table, rows)
    return engine.spark.read.schema(engine.catalog.schema(table)).parquet(*(f for f in engine.catalog.manifest(table)["files"] if f not in before))


@procedure
def new_orders(engine: Engine, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """All ``orders`` (seq, o_w_id, o_d_id, o_c_id, o_entry_d) with their ``lines`` (seq, ol_number, ol_i_id, ol_supply_w_id, ol_quantity) at once, in the order of seq.

    Orders that name an unknown item, stock, district or customer are left out whole, and
    so are those without lines.  Gives seq, o_id and total of those that were made.
    A stock at the end hangs on the sum of what was ordered alone, so lines are put in no order: they
    move once to their items, once to be counted by order and once to the orders that were made.
    """
    e, t, c = engine, engine.table, F.col
    goods = t("stock").select("s_i_id", "s_w_id").join(t("item").select("i_id", "i_price"), c("s_i_id") == c("i_id"))
    own = [c(n) for n in ("seq", "ol_number", "ol_i_id", "ol_supply_w_id", "ol_quantity")]
    known, folder = _kept(e, lines.join(goods, (c("ol_i_id") == c("s_i_id")) & (c("ol_supply_w_id") == c("s_w_id")), "left").select(*own, "i_price"))
    try:
        wrong = ~c("ol_quantity").between(1, REORDER) | c("ol_quantity").isNull()
        whole = known.groupBy("seq").agg(F.min(c("i_price").isNotNull()).alias("known"), F.max(wrong).alias("wrong"), F.count(F.lit(1)).alias("o_ol_cnt"), F.min("ol_supply_w_id").alias("least"), F.max("ol_supply_w_id").alias("most"), F.sum(c("ol_quantity") * c("i_price")).alias("amount")).where("known")
        home = t("district").select("d_id", "d_w_id", "d_tax", "d_next_o_id").join(t("warehouse").select("w_id", "w_tax"), c("w_id") == c("d_w_id"))
        who = t("customer").select("c_id", "c_d_id", "c_w_id", "c_discount")
        made = orders.join(whole, "seq").join(home, (c("d_w_id") == c("o_w_id")) & (c("d_id") == c("o_d_id"))).join(who, (c("c_id") == c("o_c_id")) & (c("c_d_id") == c("o_d_id")) & (c("c_w_id") == c("o_w_id")))
        count = F.when(c("wrong"), F.raise_error(F.lit("a quantity is out of range"))).otherwise(c("o_ol_cnt")).cast("int").alias("o_ol_cnt")
        local = ((c("least") == c("o_w_id")) & (c("most") == c("o_w_id"))).cast("int").alias("o_all_local")
        total = (c("amount") * (1 - c("c_discount")) * (1 + c("w_tax") + c("d_tax"))).alias("total")
        made = made.select("seq", "o_w_id", "o_d_id", "o_c_id", "o_entry_d", count, local, "d_next_o_id", total)
        made = running(made, ["o_w_id", "o_d_id"], [("seq", True)], {"_nth": F.lit(1).cast("bigint")}).withColumn("o_id", (c("d_next_o_id") + c("_nth") - 1).cast("int"))
        made, _ = _kept(e, made.drop("d_next_o_id", "_nth"))
        e.insert("orders", made.select("o_id", "o_c_id", "o_d_id", "o_w_id", "o_entry_d", F.lit(0).alias("o_carrier_id"), "o_ol_cnt", "o_all_local"))
        e.insert("new_order", made.select(c("o_id").alias("no_o_id"), c("o_d_id").alias("no_d_id"), c("o_w_id").alias("no_w_id")))
        sold = known.join(made.select("seq", "o_id", "o_d_id", "o_w_id"), "seq")
        sold = _inserted(e, "order_line", sold.select(c("o_id").alias("ol_o_id"), c("o_d_id").alias("ol_d_id"), c("o_w_id").alias("ol_w_id"), "ol_number", "ol_i_id", "ol_supply_w_id", F.lit(-1).cast("bigint").alias("ol_delivery_d"), "ol_quantity", (c("ol_quantity") * c("i_price")).alias("ol_amount"), F.lit("").alias("ol_dist_info")))
    finally:
        folder.remove()
    ordered = sold.groupBy(c("ol_i_id").alias("s_i_id"), c("ol_supply_w_id").alias("s_w_id")).agg(F.sum("ol_quantity").alias("_ordered"), F.count(F.lit(1)).alias("_lines")).join(t("stock"), ["s_i_id", "s_w_id"])
    last, folder = _kept(e, ordered.select("s_i_id", "s_w_id", quantity_after(c("s_quantity"), c("_ordered")).cast("int").alias("s_quantity"), (c("s_ytd") + c("_ordered")).cast("int").alias("s_ytd"), (c("s_order_cnt") + c("_lines")).cast("int").alias("s_order_cnt")))
    try:
        upsert(e, "stock", ["s_i_id", "s_w_id"], last)
    finally:
        folder.remove()
    upsert(e, "district", ["d_w_id", "d_id"], made.groupBy(c("o_w_id").alias("d_w_id"), c("o_d_id").alias("d_id")).agg((F.max("o_id") + 1).alias("d_next_o_id")))
    return made.select("seq", "o_id", "total")


@procedure
def payments(engine: Engine, paid: DataFrame) -> DataFrame:
    """All payments (seq, w_id, d_id, c_id, amount, now) at once; those of unknown customers are left out.

    A customer of bad credit gets a note of each, the latest first, before the data there were, 499 letters of it.
    Gives c_w_id, c_d_id, c_id and c_balance of the customers that paid.
    """
    e, t = engine, engine.table
    who = t("customer").select("c_w_id", "c_d_id", "c_id", "c_credit", "c_balance", "c_data")
    made = materialize(paid.join(who, (F.col("w_id") == F.col("c_w_id")) & (F.col("d_id") == F.col("c_d_id")) & paid["c_id"].eqNullSafe(who["c_id"])).drop(who["c_id"]))
    own = ["c_w_id", "c_d_id", "c_id"]
    balance = made.groupBy(*own).agg((F.first("c_balance") + F.sum("amount")).alias("c_balance"))
    # a state of a few notes a task is merged, whatever number of payments a customer makes
    note = F.concat_ws(" ", F.col("c_id"), F.col("d_id"), F.col("w_id"), F.col("amount").cast("string"), F.lit(""))
    bad = made.where("c_credit = 'BC'").withColumn("_note", note)
    latest = bad.withColumn("_rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.col("seq").desc()))).where(F.col("_rank") <= NOTES)
    notes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_note"))), lambda x: x["_note"]), "")
    data = latest.groupBy(*own).agg(F.substring(F.concat(notes, F.first("c_data")), 1, 499).alias("c_data"))
    changes = materialize(balance.join(data, own, "left").join(who.select(*own, F.col("c_data").alias("_data")), own).select(*own, "c_balance", F.coalesce("c_data", "_data").alias("c_data")))
    year = lambda table, key, column, old: t(table).join(made.groupBy(*key.values()).agg(F.sum("amount").alias("_sum")), [F.col(a) == F.col(b) for a, b in key.items()]).select(*key, (F.col(old) + F.col("_sum")).alias(column))
    districts, warehouses = (materialize(year(*a)) for a in (("district", {"d_w_id": "c_w_id", "d_id": "c_d_id"}, "d_ytd", "d_ytd"), ("warehouse", {"w_id": "c_w_id"}, "w_ytd", "w_ytd")))
    upsert(e, "customer", own, changes)
    upsert(e, "district", ["d_w_id", "d_id"], districts)
    upsert(e, "warehouse", ["w_id"], warehouses)
    c = F.col
    e.insert("history", made.select(c("c_id").alias("h_c_id"), c("d_id").alias("h_c_d_id"), c("w_id").alias("h_c_w_id"), c("d_id").alias("h_d_id"), c("w_id").alias("h_w_id"), c("now").alias("h_date"), c("amount").alias("h_amount"), F.lit("").alias("h_data")))
    return changes.select(*own, "c_balance")
