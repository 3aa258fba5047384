"""Stored procedures: named bundles of statements, and the workloads made of them.

A procedure takes an engine and parameters and returns a DataFrame.  Point
reads and writes of the workloads take many keys at once: a table of keys joined
with the data, since one job a key would be all overhead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import BadSemantics
from tessera.operators.knn import knn
from tessera.plans.engine import Engine
from tessera.sources.generators import plain_decimal

Procedure = Callable[..., DataFrame]
REGISTRY: dict[str, Procedure] = {}


def procedure(f: Procedure) -> Procedure:
    REGISTRY[f.__name__] = f
    return f


def call(engine: Engine, name: str, **parameters: object) -> DataFrame:
    """Runs a procedure as one transaction: if it fails, none of its changes stay.  Within one, it is part of that."""
    if name not in REGISTRY:
        raise BadSemantics(f"no procedure {name}")
    if engine.catalog.txn:
        return REGISTRY[name](engine, **parameters)
    with engine.transaction():
        return REGISTRY[name](engine, **parameters)


def quoted(value: int | float | str) -> str:
    """A parameter as a constant of the dialect: a text can't end its quotes."""
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else plain_decimal(value)


def keys(engine: Engine, values: Sequence[object], name: str) -> DataFrame:
    kind = "string" if values and isinstance(values[0], str) else "bigint"
    return engine.spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


@procedure
def point_reads(engine: Engine, table: str, key: str, values: Sequence[object], columns: Sequence[str]) -> DataFrame:
    """The rows of some keys."""
    return engine.table(table).join(keys(engine, values, key), key, "left_semi").select(*dict.fromkeys([key, *columns]))


@procedure
def nearest(engine: Engine, table: str, query: Sequence[float], k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row, rc and id_0 .. id_<k-1>: the result code and the set of the nearest ids."""
    found = [r[id_column] for r in knn(engine.table(table), query, k, "euclidean", id_column, vector).orderBy("rank").collect()]
    if not found:
        raise BadSemantics(f"{table} is empty")
    return engine.spark.createDataFrame([(len(found), *found)], ", ".join(["rc int", *(f"id_{i} bigint" for i in range(len(found)))]))


# ---- orders: new orders and payments


def restocked(quantity: Column, ordered: Column) -> Column:
    """Stock after an order: below ten, ninety-one come in."""
    left = quantity - ordered
    return F.when(left < 10, left + 91).otherwise(left)


@procedure
def order_lines(engine: Engine, lines: DataFrame, items: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines (item, supplier warehouse, quantity) with amount and the stock they leave."""
    priced = lines.join(items.select("i_id", "i_price"), lines["ol_i_id"] == F.col("i_id"))
    return priced.join(stock.select("s_i_id", "s_w_id", "s_quantity"), (F.col("s_i_id") == F.col("ol_i_id")) & (F.col("s_w_id") == F.col("ol_supply_w_id"))).select(*lines.columns, (F.col("ol_quantity") * F.col("i_price")).alias("ol_amount"), restocked(F.col("s_quantity"), F.col("ol_quantity")).alias("s_quantity_after"))


@procedure
def order_total(engine: Engine, lines: DataFrame, discount: float, w_tax: float, d_tax: float, truncated: bool = False) -> DataFrame:
    """total: the amounts, less discount, plus taxes; ``truncated`` cuts the running sum to whole numbers after each line."""
    if truncated:
        amounts = F.transform(F.sort_array(F.collect_list(F.struct("ol_number", "ol_amount"))), lambda x: x["ol_amount"])
        total = F.aggregate(amounts, F.lit(0), lambda t, x: (t + x).cast("int"))
    else:
        total = F.sum("ol_amount")
    return lines.agg((total * (1 - discount) * (1 + w_tax + d_tax)).alias("total"))


@procedure
def new_order(engine: Engine, w_id: int, d_id: int, c_id: int, lines: Sequence[tuple[int, int, int]], now: int) -> DataFrame:
    """One order of (item, supplier warehouse, quantity) lines: reads, number, order, lines, stock; its total."""
    e, item = engine, engine.table
    tax = e.sql(f"select w_tax, d_tax, d_next_o_id from warehouse, district where w_id = {w_id} and d_w_id = {w_id} and d_id = {d_id}").first()
    who = e.sql(f"select c_discount, c_last, c_credit from customer where c_w_id = {w_id} and c_d_id = {d_id} and c_id = {c_id}").first()
    if tax is None or who is None:
        raise BadSemantics("no such district or customer")
    asked = e.spark.createDataFrame([(i + 1, *x) for i, x in enumerate(lines)], "ol_number int, ol_i_id int, ol_supply_w_id int, ol_quantity int")
    made = order_lines(e, asked, item("item"), item("stock")).cache()
    if made.count() != len(lines):
        made.unpersist()
        raise BadSemantics("an item is unknown")
    o_id = tax.d_next_o_id
    e.execute(f"update district set d_next_o_id = add(d_next_o_id, 1) where d_w_id = {w_id} and d_id = {d_id}")
    local = int(all(supply == w_id for _, supply, _ in lines))
    e.execute(f"insert into orders (o_id, o_c_id, o_d_id, o_w_id, o_entry_d, o_carrier_id, o_ol_cnt, o_all_local) values ({o_id}, {c_id}, {d_id}, {w_id}, {now}, 0, {len(lines)}, {local})")
    e.execute(f"insert into new_order (no_o_id, no_d_id, no_w_id) values ({o_id}, {d_id}, {w_id})")
    rows = made.select(F.lit(o_id).alias("ol_o_id"), F.lit(d_id).alias("ol_d_id"), F.lit(w_id).alias("ol_w_id"), "ol_number", "ol_i_id", "ol_supply_w_id", F.lit(-1).cast("bigint").alias("ol_delivery_d"), "ol_quantity", "ol_amount", F.lit("").alias("ol_dist_info"))
    e.insert("order_line", rows)
    # lines of one item follow each other; all stocks change at once
    after = made.groupBy("ol_i_id", "ol_supply_w_id").agg(F.sort_array(F.collect_list(F.struct("ol_number", "ol_quantity"))).alias("ls")).join(item("stock"), (F.col("s_i_id") == F.col("ol_i_id")) & (F.col("s_w_id") == F.col("ol_supply_w_id")))
    left = F.aggregate("ls", F.col("s_quantity"), lambda q, x: restocked(q, x["ol_quantity"]).cast("int"))
    ordered = F.aggregate("ls", F.lit(0), lambda n, x: n + x["ol_quantity"])
    upsert(e, "stock", ["s_i_id", "s_w_id"], after.select("s_i_id", "s_w_id", left.alias("s_quantity"), (F.col("s_ytd") + ordered).alias("s_ytd"), (F.col("s_order_cnt") + F.size("ls")).alias("s_order_cnt")))
    return order_total(e, made, who.c_discount, tax.w_tax, tax.d_tax)


@procedure
def payment(engine: Engine, w_id: int, d_id: int, c_id: int, amount: float, now: int) -> DataFrame:
    """Adds an amount to a warehouse's and district's year and the customer's balance, and a history row."""
    e, here = engine, f"c_w_id = {w_id} and c_d_id = {d_id} and c_id = {c_id}"
    who = e.sql(f"select c_credit, c_data, c_balance from customer where {here}").first()
    if who is None:
        raise BadSemantics("no such customer")
    e.execute(f"update warehouse set w_ytd = add(w_ytd, {quoted(amount)}) where w_id = {w_id}")
    e.execute(f"update district set d_ytd = add(d_ytd, {quoted(amount)}) where d_w_id = {w_id} and d_id = {d_id}")
    e.execute(f"update customer set c_balance = add(c_balance, {quoted(amount)}) where {here}")
    if who.c_credit == "BC":
        note = f"{c_id} {d_id} {w_id} {quoted(amount)} {who.c_data}"[:499]
        e.execute(f"update customer set c_data = {quoted(note)} where {here}")
    e.execute(f"insert into history (h_c_id, h_c_d_id, h_c_w_id, h_d_id, h_w_id, h_date, h_amount, h_data) values ({c_id}, {d_id}, {w_id}, {d_id}, {w_id}, {now}, {quoted(amount)}, '')")
    return e.sql(f"select c_id, c_balance from customer where {here}")


# ---- trades


@procedure
def trade_order(engine: Engine, ca_id: int, t_id: int, symbol: str, quantity: int, kind: str, now: int) -> DataFrame:
    """Account, customer, broker, security, last price and trade type in one chain of joins; a trade and its history."""
    e = engine
    chain = e.sql(
        "select ca_id, ca_name, c_f_name, c_l_name, c_tier, b_name, s_name, lt_price, tt_name from customer_account, customer, broker, security, last_trade, trade_type "
        f"where ca_c_id = c_id and ca_b_id = b_id and ca_id = {ca_id} and s_symb = lt_s_symb and s_symb = {quoted(symbol)} and tt_id = {quoted(kind)}"
    )
    found = chain.first()
    if found is None:
        raise BadSemantics("no such account, security or type")
    who = f"{found.c_f_name} {found.c_l_name}"
    e.execute(
        "insert into trade (t_id, t_dts, t_st_id, t_tt_id, t_is_cash, t_s_symb, t_qty, t_bid_price, t_ca_id, t_exec_name, t_trade_price, t_chrg, t_comm, t_tax, t_lifo) "
        f"values ({t_id}, {now}, 'PNDG', {quoted(kind)}, 1, {quoted(symbol)}, {quantity}, {quoted(found.lt_price)}, {ca_id}, {quoted(who)}, {quoted(found.lt_price)}, 0.0, 0.0, 0.0, 1)"
    )
    e.execute(f"insert into trade_history (th_t_id, th_dts, th_st_id) values ({t_id}, {now}, 'PNDG')")
    return chain


@procedure
def trade_result(engine: Engine, t_id: int, now: int) -> DataFrame:
    """Completes a trade: history and the account's balance."""
    e = engine
    trade = e.sql(f"select t_ca_id, t_trade_price, t_qty from trade where t_id = {t_id}").first()
    if trade is None:
        raise BadSemantics("no such trade")
    e.execute(f"insert into trade_history (th_t_id, th_dts, th_st_id) values ({t_id}, {now}, 'CMPT')")
    e.execute(f"update customer_account set ca_bal = add(ca_bal, {quoted(float(trade.t_trade_price))}) where ca_id = {trade.t_ca_id}")
    return e.sql(f"select ca_id, ca_bal from customer_account where ca_id = {trade.t_ca_id}")


# ---- key-value and micro workloads


@procedure
def micro(engine: Engine, reads: Sequence[int], prices: dict[int, float] | None = None) -> DataFrame:
    """Reads items; sets new prices by one update joined with the table of keys."""
    found = point_reads(engine, "item", "i_id", list(reads), ["i_name", "i_price"])
    if prices:
        new = engine.spark.createDataFrame(list(prices.items()), "i_id bigint, new_price double")
        upsert(engine, "item", "i_id", new.withColumnRenamed("new_price", "i_price"))
    return found


@procedure
def ycsb(engine: Engine, reads: Sequence[str], writes: dict[str, str] | None = None, inserts: DataFrame | None = None) -> DataFrame:
    """Reads rows by key, then writes ycsb_1 and inserts whole rows."""
    found = point_reads(engine, "ycsb", "ycsb_id", list(reads), ["ycsb_1"])
    if writes:
        upsert(engine, "ycsb", "ycsb_id", engine.spark.createDataFrame(list(writes.items()), "ycsb_id string, ycsb_1 string"))
    if inserts is not None:
        engine.insert("ycsb", inserts)
    return found


def upsert(engine: Engine, table: str, key: str | Sequence[str], changes: DataFrame) -> int:
    """Sets the columns of ``changes`` in the rows that have its keys: one new version."""
    keys_ = [key] if isinstance(key, str) else list(key)
    m = engine.catalog.manifest(table)
    old = engine.catalog.read(table)
    columns = [c for c in changes.columns if c not in keys_]
    new = changes.select(*keys_, *(F.col(c).alias(f"_new_{c}") for c in columns)).withColumn("_hit", F.lit(1))
    met = old.withColumn("_file", F.input_file_name()).join(new, keys_, "left_semi").groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file
    names = {r._file.rsplit("/", 1)[1] for r in met}
    files = [f for f in m["files"] if f.rsplit("/", 1)[1] in names]
    if not files:
        return 0
    joined = engine.spark.read.schema(old.schema).parquet(*files).join(new, keys_, "left")
    rows = joined.select(*(F.when(F.col("_hit") == 1, F.col(f"_new_{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in columns else F.col(f.name) for f in old.schema))
    written = engine.catalog.write(table, rows)
    engine.catalog.commit(table, old.schema, [f for f in m["files"] if f not in set(files)] + written, m["version"])
    engine.statistics.changed(table, sum(r.n for r in met))
    return sum(r.n for r in met)


@procedure
def check_ids(engine: Engine, table: str, column: str, first: int, last: int) -> DataFrame:
    """unique, complete: whether the ids of a range are there once each."""
    rows = engine.table(table).where(F.col(column).between(first, last)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("d"))
    return rows.select((F.col("n") == F.col("d")).alias("unique"), (F.col("d") == last - first + 1).alias("complete"))


@procedure
def recall_after_inserts(engine: Engine, base: str, log: DataFrame, query_seq: int, query: Sequence[float], found: Sequence[int], k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """recall of found ids against the exact neighbours among the rows a query could see."""
    from tessera.operators.knn import visible

    truth = knn(visible(engine.table(base).select(id_column, vector), log.select("seq", id_column, vector), query_seq), query, k, "euclidean", id_column, vector)
    hit = truth.join(keys(engine, list(found), id_column), id_column, "left_semi").count()
    return engine.spark.createDataFrame([(hit / max(1, truth.count()),)], "recall double")
