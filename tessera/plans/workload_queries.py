"""Queries for workloads, indexes, transactions, statistics and generators, each with its SQL; see ``catalogue``."""

from __future__ import annotations

import json
import operator
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import client
from tessera.errors import BadSemantics, BadSyntax, Conflict, DialectError
from tessera.functions import vectors
from tessera.operators import aggregates, history, ivf, knn, layouts, relational, sketches, statistics
from tessera.operators.predicates import Constant, Name, Predicate, Term
from tessera.plans import catalogue, order_sets, procedures
from tessera.plans.catalogue import _DOT, _L2, _Q, K, _parts, _ranked, engine, query, text_of, vector_of
from tessera.plans.engine import Engine
from tessera.sources import files, generators, loaders

# ---- orders and payments, with the driver's tables as warehouses, districts, customers, items and stock


def shop(spark: SparkSession, folder: str) -> Engine:
    e, t = Engine(spark), lambda name: files.table(spark, folder, name)
    c = F.col
    customer = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    loaders.load(e, loaders.TPCC, {
        "warehouse": t("region").select((c("r_regionkey") + 1).alias("w_id"), c("r_name").alias("w_name"), ((c("r_regionkey") + 1) / 100).alias("w_tax"), F.lit(0.0).alias("w_ytd")),
        "district": t("nation").select((c("n_nationkey") + 1).alias("d_id"), (c("n_regionkey") + 1).alias("d_w_id"), F.lit(0.05).alias("d_tax"), F.lit(0.0).alias("d_ytd"), F.lit(1).alias("d_next_o_id")),
        "customer": customer.select(c("c_custkey").alias("c_id"), (c("c_nationkey") + 1).alias("c_d_id"), (c("n_regionkey") + 1).alias("c_w_id"), c("c_name").alias("c_last"), F.when(c("c_mktsegment") == "BUILDING", "BC").otherwise("GC").alias("c_credit"), F.lit(0.1).alias("c_discount"), c("c_acctbal").alias("c_balance"), c("c_mktsegment").alias("c_data")),
        "item": t("part").select(c("p_partkey").alias("i_id"), c("p_size").alias("i_im_id"), F.left("p_name", F.lit(24)).alias("i_name"), c("p_retailprice").alias("i_price"), F.left("p_type", F.lit(50)).alias("i_data")),
        "stock": t("part").select(c("p_partkey").alias("s_i_id"), F.lit(1).alias("s_w_id"), c("p_size").alias("s_quantity"), F.lit(0).alias("s_ytd"), F.lit(0).alias("s_order_cnt")),
    })
    return e


LINES = [(3, 1, 5), (7, 1, 10), (3, 1, 2)]
_HOME = "h as (select c_custkey c, c_nationkey + 1 d, n_regionkey + 1 w from customer join nation on c_nationkey = n_nationkey where c_custkey = (select min(c_custkey) from customer where c_mktsegment = 'BUILDING'))"


def _home(e: Engine) -> dict[str, int]:
    r = e.table("customer").where("c_credit = 'BC'").orderBy("c_id").first()
    return {"w_id": r.c_w_id, "d_id": r.c_d_id, "c_id": r.c_id}


def _ordered(spark: SparkSession, folder: str) -> tuple[Engine, DataFrame]:
    e = shop(spark, folder)
    return e, procedures.call(e, "new_order", **_home(e), lines=LINES, now=0)


# ---- all of orders and lineitem as new orders and payments

_PLACES = "h as (select c_custkey c, c_nationkey + 1 d, n_regionkey + 1 w from customer join nation on c_nationkey = n_nationkey), o as (select o_orderkey seq, c, d, w from orders join h on o_custkey = c)"
# a line after another: the stock of one supplier for each part
_FOLD = f"""
with recursive {_PLACES},
l as (select l_partkey i, seq, l_linenumber n, cast(l_quantity as int) q, row_number() over (partition by l_partkey order by seq, l_linenumber, l_quantity) k from lineitem join o on seq = l_orderkey),
f as (select i, seq, n, k, case when p_size - q < 10 then p_size - q + 91 else p_size - q end s, q y from l join part on p_partkey = i where k = 1
  union all select l.i, l.seq, l.n, l.k, case when f.s - l.q < 10 then f.s - l.q + 91 else f.s - l.q end, f.y + l.q from f join l on l.i = f.i and l.k = f.k + 1)
"""


def _all_ordered(spark: SparkSession, folder: str) -> Engine:
    """The shop after all orders, in the order of their keys, each line at its part's one stock."""
    e, t, c = shop(spark, folder), lambda name: files.table(spark, folder, name), F.col
    home = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    orders = t("orders").join(home, c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("seq"), (c("n_regionkey") + 1).alias("o_w_id"), (c("n_nationkey") + 1).alias("o_d_id"), c("c_custkey").cast("int").alias("o_c_id"), F.lit(0).cast("bigint").alias("o_entry_d"))
    lines = t("lineitem").select(c("l_orderkey").alias("seq"), c("l_linenumber").alias("ol_number"), c("l_partkey").cast("int").alias("ol_i_id"), F.lit(1).alias("ol_supply_w_id"), c("l_quantity").cast("int").alias("ol_quantity"))
    procedures.call(e, "new_orders", orders=orders, lines=lines)
    return e


@query(f"{_FOLD} select p_partkey s_i_id, coalesce(max_by(s, k), p_size) s_quantity, coalesce(max(y), 0) s_ytd, count(k) s_order_cnt from part left join f on i = p_partkey group by p_partkey, p_size")
def neworders_stock(spark: SparkSession, folder: str) -> DataFrame:
    return _all_ordered(spark, folder).sql("select s_i_id, s_quantity, s_ytd, s_order_cnt from stock")


@query(f"with {_PLACES}, n as (select *, row_number() over (partition by w, d order by seq) o_id from o where seq in (select l_orderkey from lineitem)) select n.o_id, w o_w_id, d o_d_id, c o_c_id, count(*) o_ol_cnt from n join lineitem on l_orderkey = seq group by all")
def neworders_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _all_ordered(spark, folder).sql("select o_id, o_w_id, o_d_id, o_c_id, o_ol_cnt from orders")


@query(f"with {_PLACES} select n_nationkey + 1 d_id, 1 + count(seq) d_next_o_id from nation left join (select * from o where seq in (select l_orderkey from lineitem)) on d = n_nationkey + 1 group by 1")
def neworders_districts(spark: SparkSession, folder: str) -> DataFrame:
    return _all_ordered(spark, folder).sql("select d_id, d_next_o_id from district")


@query(f"{_FOLD} select seq, n ol_number, s s_quantity from f")
def neworders_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The stock after every line, all lines at once."""
    e, t, c = shop(spark, folder), lambda name: files.table(spark, folder, name), F.col
    lines = t("lineitem").join(t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")), c("l_orderkey") == c("o_orderkey"), "left_semi")
    lines = lines.select(c("l_orderkey").alias("seq"), c("l_linenumber").alias("ol_number"), c("l_partkey").cast("int").alias("ol_i_id"), F.lit(1).alias("ol_supply_w_id"), c("l_quantity").cast("int").alias("ol_quantity"))
    return order_sets.lines_after(lines, e.table("stock")).select("seq", "ol_number", "s_quantity")


@query(f"with {_PLACES}, p as (select c, sum(o_totalprice) s, count(*) n from o join orders on o_orderkey = seq group by c) select c_custkey c_id, round(c_acctbal + s, 2) c_balance, c_mktsegment = 'BUILDING' noted from customer join p on c = c_custkey")
def payments_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's price as a payment; customers of bad credit have notes of them."""
    e, t, c = shop(spark, folder), lambda name: files.table(spark, folder, name), F.col
    home = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    paid = t("orders").join(home, c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("seq"), (c("n_regionkey") + 1).alias("w_id"), (c("n_nationkey") + 1).alias("d_id"), c("c_custkey").cast("int").alias("c_id"), c("o_totalprice").alias("amount"), F.lit(0).cast("bigint").alias("now"))
    procedures.call(e, "payments", paid=paid)
    rows = e.table("customer").join(t("orders").select(c("o_custkey").cast("int").alias("c_id")).distinct(), "c_id", "left_semi")
    noted = F.col("c_data").rlike("^[0-9]+ [0-9]+ [0-9]+ [0-9.E]+ ")
    return rows.select("c_id", F.round("c_balance", 2).alias("c_balance"), noted.alias("noted"))


# ---- one order or payment


@query("select n_nationkey + 1 d_id, (n_regionkey + 1) / 100 w_tax, cast(0.05 as double) d_tax, 1 d_next_o_id from nation")
def neworder_reads(spark: SparkSession, folder: str) -> DataFrame:
    return shop(spark, folder).sql("select d_id, w_tax, d_tax, d_next_o_id from warehouse, district where w_id = d_w_id")


def _kinds(e: Engine, *parts: tuple[str, str, str, str, str]) -> DataFrame:
    """kind, a, b, c of rows of several tables."""
    out = None
    for kind, table, *columns in parts:
        one = e.table(table).select(F.lit(kind).alias("kind"), *(F.col(c).cast("bigint").alias(n) for c, n in zip(columns, "abc")))
        out = one if out is None else out.union(one)
    return out


@query(f"""with {_HOME} select 'district' kind, n_nationkey + 1 a, n_regionkey + 1 b, 1 + cast(n_nationkey + 1 = d as int) c from nation, h
union all select 'order', 1, c, 3 from h union all select 'new', 1, d, w from h union all select 'line', * from (values (1, 3, 5), (2, 7, 10), (3, 3, 2))""")
def neworder_writes(spark: SparkSession, folder: str) -> DataFrame:
    e, _ = _ordered(spark, folder)
    return _kinds(e, ("district", "district", "d_id", "d_w_id", "d_next_o_id"), ("order", "orders", "o_id", "o_c_id", "o_ol_cnt"), ("new", "new_order", "no_o_id", "no_d_id", "no_w_id"), ("line", "order_line", "ol_number", "ol_i_id", "ol_quantity"))


@query("""with s as (select p_partkey i, p_size q, case when p_size - 5 < 10 then p_size + 86 else p_size - 5 end once, case when p_size - 10 < 10 then p_size + 81 else p_size - 10 end ten from part)
select i s_i_id, case i when 3 then case when once - 2 < 10 then once + 89 else once - 2 end when 7 then ten else q end s_quantity, case i when 3 then 7 when 7 then 10 else 0 end s_ytd, case i when 3 then 2 when 7 then 1 else 0 end s_order_cnt from s""")
def neworder_stock(spark: SparkSession, folder: str) -> DataFrame:
    e, _ = _ordered(spark, folder)
    return e.table("stock").select("s_i_id", "s_quantity", "s_ytd", "s_order_cnt")


@query(f"with {_HOME} select round((select sum(p_retailprice * case p_partkey when 3 then 7 else 10 end) from part where p_partkey in (3, 7)) * 0.9 * (1 + w / 100 + 0.05), 4) total from h")
def neworder_total(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered(spark, folder)[1].select(F.round("total", 4).alias("total"))


@query("select 'district' kind, n_nationkey + 1 a, n_regionkey + 1 b, 1 c from nation")
def neworder_rollback(spark: SparkSession, folder: str) -> DataFrame:
    """Two orders in one transaction, the second with an unknown item: neither leaves a trace."""
    e = shop(spark, folder)
    home = _home(e)
    try:
        with e.transaction():
            procedures.call(e, "new_order", **home, lines=LINES, now=0)
            procedures.call(e, "new_order", **home, lines=[(1 << 30, 1, 1)], now=0)
    except BadSemantics:
        pass
    return _kinds(e, ("district", "district", "d_id", "d_w_id", "d_next_o_id"), ("order", "orders", "o_id", "o_c_id", "o_ol_cnt"), ("new", "new_order", "no_o_id", "no_d_id", "no_w_id"), ("line", "order_line", "ol_number", "ol_i_id", "ol_quantity"))


@query(f"""with {_HOME} select 'customer' kind, c_custkey id, round(case when c_custkey = c then c_acctbal + 12.5 else c_acctbal end, 2) amount, case when c_custkey = c then c || ' ' || d || ' ' || w || ' 12.5 ' || c_mktsegment else c_mktsegment end note from customer, h
union all select 'warehouse', r_regionkey + 1, case when r_regionkey + 1 = w then 12.5 else 0 end, '' from region, h
union all select 'district', n_nationkey + 1, case when n_nationkey + 1 = d then 12.5 else 0 end, '' from nation, h union all select 'history', c, 12.5, '' from h""")
def payment(spark: SparkSession, folder: str) -> DataFrame:
    e = shop(spark, folder)
    procedures.call(e, "payment", **_home(e), amount=12.5, now=0)
    rows = lambda kind, table, i, v, note: e.table(table).select(F.lit(kind).alias("kind"), F.col(i).cast("bigint").alias("id"), F.round(v, 2).alias("amount"), note.alias("note"))
    none = F.lit("")
    return rows("customer", "customer", "c_id", "c_balance", F.col("c_data")).union(rows("warehouse", "warehouse", "w_id", "w_ytd", none)).union(rows("district", "district", "d_id", "d_ytd", none)).union(rows("history", "history", "h_c_id", "h_amount", none))


# ---- micro and key-value workloads


@query("select p_partkey i_id, case p_partkey when 1 then 9.99 when 2 then 1.25 else p_retailprice end i_price from part")
def micro_readwrite(spark: SparkSession, folder: str) -> DataFrame:
    e = shop(spark, folder)
    procedures.call(e, "micro", reads=[1, 2], prices={1: 9.99, 2: 1.25})
    return e.table("item").select("i_id", "i_price")


@query("select lpad(cast(s_suppkey as varchar), 33, '0') ycsb_id, case s_suppkey when 1 then 'it''s' else s_name end ycsb_1 from supplier union all select lpad('7000000000', 33, '0'), 'new'")
def ycsb_readwrite(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark)
    key, name = F.lpad(F.col("s_suppkey").cast("string"), 33, "0"), F.col("s_name")
    fields = [f"ycsb_{i}" for i in range(1, 10)]
    loaders.load(e, loaders.YCSB, {"ycsb": files.table(spark, folder, "supplier").select(key.alias("ycsb_id"), *(name.alias(f) for f in fields))})
    more = spark.range(1).select(F.lit("7000000000".zfill(33)).alias("ycsb_id"), *(F.lit("new").alias(f) for f in fields))
    procedures.call(e, "ycsb", reads=["1".zfill(33)], writes={"1".zfill(33): "it's"}, inserts=more)
    return e.table("ycsb").select("ycsb_id", "ycsb_1")


# ---- trades


def _market(spark: SparkSession, folder: str) -> Engine:
    e, t, c = Engine(spark), lambda name: files.table(spark, folder, name), F.col
    symbol = c("p_partkey").cast("string")
    loaders.load(e, loaders.TPCE, {
        "customer_account": t("customer").select(c("c_custkey").alias("ca_id"), (c("c_nationkey") + 1).alias("ca_b_id"), c("c_custkey").alias("ca_c_id"), c("c_name").alias("ca_name"), c("c_acctbal").alias("ca_bal")),
        "customer": t("customer").select(c("c_custkey").alias("c_id"), c("c_name").alias("c_l_name"), c("c_mktsegment").alias("c_f_name"), F.lit(1).alias("c_tier")),
        "broker": t("nation").select((c("n_nationkey") + 1).alias("b_id"), c("n_name").alias("b_name")),
        "security": t("part").select(symbol.alias("s_symb"), F.left("p_name", F.lit(70)).alias("s_name")),
        "last_trade": t("part").select(symbol.alias("lt_s_symb"), c("p_retailprice").alias("lt_price")),
        "trade_type": spark.createDataFrame([("TMB", "Market-Buy"), ("TMS", "Market-Sell")], "tt_id string, tt_name string"),
    })
    return e


@query("""select c_custkey ca_id, c_mktsegment || ' ' || c_name t_exec_name, n_name b_name, p_name s_name, p_retailprice t_bid_price, 10 t_qty, 'Market-Buy' tt_name, 'PNDG' th_st_id
from customer join nation on c_nationkey = n_nationkey, part where c_custkey = 7 and p_partkey = 5""")
def trade_order(spark: SparkSession, folder: str) -> DataFrame:
    e = _market(spark, folder)
    chain = procedures.call(e, "trade_order", ca_id=7, t_id=1, symbol="5", quantity=10, kind="TMB", now=0)
    made = e.sql("select t_ca_id, t_exec_name, t_bid_price, t_qty, th_st_id from trade, trade_history where t_id = th_t_id")
    return chain.join(made, chain["ca_id"] == made["t_ca_id"]).select("ca_id", "t_exec_name", "b_name", "s_name", "t_bid_price", "t_qty", "tt_name", "th_st_id")


@query("select c_custkey ca_id, round(c_acctbal + case when c_custkey = 7 then (select p_retailprice from part where p_partkey = 5) else 0 end, 2) ca_bal, case when c_custkey = 7 then 2 else 0 end n_history from customer")
def trade_result(spark: SparkSession, folder: str) -> DataFrame:
    e = _market(spark, folder)
    procedures.call(e, "trade_order", ca_id=7, t_id=1, symbol="5", quantity=10, kind="TMB", now=0)
    procedures.call(e, "trade_result", t_id=1, now=1)
    entries = e.sql("select t_ca_id, count(th_t_id) from trade, trade_history where t_id = th_t_id group by t_ca_id")
    return e.table("customer_account").join(entries, F.col("ca_id") == F.col("t_ca_id"), "left").select("ca_id", F.round("ca_bal", 2).alias("ca_bal"), F.coalesce("countofth_t_id", F.lit(0)).alias("n_history"))


@query("select * from (values ('customer', 100), ('district', 10), ('item', 200), ('stock', 200), ('warehouse', 1)) t(tblname, n)")
def loader_tpcc(spark: SparkSession, folder: str) -> DataFrame:
    made = loaders.tpcc(Engine(spark), warehouses=1, items=200, customers=10)
    return spark.createDataFrame(list(made.items()), "tblname string, n bigint")


@query("select i i_id, true fine from range(1, 501) t(i)")
def loader_micro(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark)
    loaders.micro(e, 500)
    fine = F.col("i_price").between(1, 100) & (F.round("i_price", 2) == F.col("i_price")) & F.char_length("i_name").between(14, 24) & F.char_length("i_data").between(26, 50)
    return e.table("item").select("i_id", fine.alias("fine"))


@query("select lpad(cast(i as varchar), 33, '0') ycsb_id, lpad(cast(i as varchar), 33, '0') ycsb_9 from range(1, 501) t(i)")
def loader_ycsb(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark)
    loaders.ycsb(e, 500)
    return e.table("ycsb").select("ycsb_id", "ycsb_9")


# ---- vectors: procedures and measured recall


@query(f"select cast(count(*) as int) rc, string_agg(cast(vec_id as varchar), ',' order by vec_id) ids from ({_ranked(_L2)})")
def knn_procedure(spark: SparkSession, folder: str) -> DataFrame:
    found = procedures.call(engine(spark, folder, "embeddings"), "nearest", table="embeddings", query=vector_of(spark, folder))
    return found.select("rc", F.array_join(F.sort_array(F.array(*(c for c in found.columns if c != "rc"))), ",").alias("ids"))


_SEEN = "vec_id % 5 <> 4 or vec_id <= (select max(vec_id) from embeddings) // 2"


@query(f"with a as (select vec_id from ({_ranked(_L2, 'vec_id % 5 <> 4')})), b as (select vec_id from ({_ranked(_L2, _SEEN)})) select round((select count(*) from a where vec_id in (select vec_id from b)) / {K}.0, 6) recall")
def recall_after_inserts(spark: SparkSession, folder: str) -> DataFrame:
    """What a search that has seen no insert finds of what one at half of the log would."""
    df, q = files.table(spark, folder, "embeddings").select("vec_id", "embedding"), vector_of(spark, folder)
    e = Engine(spark)
    e.register("base", df.where("vec_id % 5 <> 4"))
    half = df.agg(F.max("vec_id")).first()[0] // 2
    found = [r.vec_id for r in knn.knn(e.table("base"), q, K).collect()]
    return procedures.call(e, "recall_after_inserts", base="base", log=df.where("vec_id % 5 = 4").withColumn("seq", F.col("vec_id")), query_seq=half, query=q, found=found).select(F.round("recall", 6).alias("recall"))


_ROUGH = "list_sum(list_transform(list_zip(e.embedding[1:32], q.embedding[1:32]), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"
_FULL = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"


@query(f"""with d as (select q.vec_id a, e.vec_id b, {_ROUGH} r, {_FULL} f from embeddings q, embeddings e where q.vec_id % 50 = 0),
n as (select a, b, row_number() over (partition by a order by r, b) nr, row_number() over (partition by a order by f, b) nf from d)
select round(avg(share), 9) recall from (select a, sum(cast(nr <= {K} and nf <= {K} as int)) / {K}.0 share from n group by a)""")
def recall_of_halves(spark: SparkSession, folder: str) -> DataFrame:
    """What neighbours by the first half of the components have of the true ones, over all queries."""
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    half = df.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    asked = F.col("vec_id") % 50 == 0
    return knn.recall(knn.knn_batch(half, half.where(asked), K), knn.knn_batch(df, df.where(asked), K)).select(F.round("recall", 9).alias("recall"))


def _reached(spark: SparkSession, folder: str, found: float) -> DataFrame:
    n = files.table(spark, folder, "embeddings").where("vec_id % 50 = 0").count()
    return spark.createDataFrame([(n, found >= 0.9)], "queries bigint, reached boolean")


_REACHED = "select count(*) queries, true reached from embeddings where vec_id % 50 = 0"


def _celled(spark: SparkSession, folder: str) -> Engine:
    e = engine(spark, folder, "embeddings")
    e.execute("create index by_cell on embeddings (embedding) using ivf")
    return e


_AS_OF = f"""
with p as (select q.vec_id query_id, e.vec_id id, {_L2.format(a='e.embedding', b='q.embedding')} d from embeddings q, embeddings e where q.vec_id % 50 = 0),
truth as (select *, row_number() over (partition by query_id order by d, id) r from p where id % 5 <> 4 or id <= query_id),
found as (select *, row_number() over (partition by query_id order by d, id) r from p where id % 5 <> 4)
"""


def _history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, a fifth of them inserted at places of their own, and the questions: each at its own place."""
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return df.withColumn("seq", F.when(F.col("vec_id") % 5 == 4, F.col("vec_id")).otherwise(-1)), df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("vec_id").alias("seq"))


@query(f"{_AS_OF} select query_id, id, cast(r as int) \"rank\" from truth where r <= {K}")
def knn_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return history.knn_as_of(*_history(spark, folder), K).select("query_id", "id", "rank")


@query(f"{_AS_OF} select t.query_id, round(count(f.id) / {K}, 6) recall from (select * from truth where r <= {K}) t left join (select * from found where r <= {K}) f using (query_id, id) group by t.query_id")
def recall_of_history(spark: SparkSession, folder: str) -> DataFrame:
    """What a search that never saw the inserts found, against the truth at each question's place."""
    rows, asked = _history(spark, folder)
    found = history.knn_as_of(rows.where("seq = -1"), asked, K)
    return history.recall_as_of(found, rows, asked, K).select("query_id", F.round("recall", 6).alias("recall"))


@query(_REACHED)
def ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    """All queries against the cells that an index made by a statement probes, with brute force beside it."""
    made = _celled(spark, folder).built["by_cell"]
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = df.where("vec_id % 50 = 0")
    probe, _ = ivf.probe_for(spark, made.index, df, asked, K)  # the index measured itself with fewer queries
    found = knn.recall(ivf.search_batch(spark, made.index, asked, K, probe), knn.knn_batch(df, asked, K)).first()[0]
    return _reached(spark, folder, found)


@query(_REACHED)
def knn_ivf_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A prepared statement for each query vector, of 20 neighbours, that reads an index's nearest cells only, with brute force beside it."""
    e = _celled(spark, folder)
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = df.where("vec_id % 50 = 0")
    found = e.sql_each(f"select vec_id from embeddings order by embedding <EUC> ? limit {K}", asked, "embedding")
    if e.used != ["by_cell"]:
        raise BadSemantics("the index was not read")
    return _reached(spark, folder, knn.recall(found, knn.knn_batch(df, asked, K)).first()[0])


def _browsed(spark: SparkSession, folder: str, tables: str, columns: str, where: str, **options: object) -> DataFrame:
    """The nearest rows through the cells of an index, exact; rings says whether they were read ring by ring."""
    e = engine(spark, folder, *tables.split(), **options)
    e.execute("create index by_cell on embeddings (embedding) using ivf")
    df = e.sql(f"select {columns} from {', '.join(tables.split())} {where} order by embedding <EUC> {text_of(vector_of(spark, folder))} limit {K}")
    return df.withColumn("rings", F.lit(e.used == ["by_cell"] and 0 < e.cells_read[0] <= e.cells_read[1]))


@query(f"select vec_id, true rings from ({_ranked(_L2, 'label = 2')})")
def knn_filtered_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _browsed(spark, folder, "embeddings", "vec_id", "where label = 2")


@query(f"with {_Q}, d as (select vec_id, r_name, {_L2.format(a='embedding', b='v')} d from embeddings join region on label = r_regionkey, q) select vec_id, r_name, true rings from d order by d, vec_id limit {K}")
def knn_join_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _browsed(spark, folder, "embeddings region", "vec_id, r_name", "where label = r_regionkey")


@query(f"select vec_id, true rings from ({_ranked(_L2)})")
def knn_exact_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _browsed(spark, folder, "embeddings", "vec_id", "", exact=True)


_PRUNED = "select count(*) queries, true reached, true pruned from embeddings where vec_id % 50 = 0"


def _pruned(found: DataFrame) -> DataFrame:
    """Whether recall reached 0.9 with fewer than half of all pairs compared."""
    return found.agg(F.count_distinct("query_id").alias("queries"), (F.min("recall") >= 0.9).alias("reached"), (F.max("share") < 0.5).alias("pruned"))


@query(_PRUNED)
def lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _pruned(catalogue.lsh_candidates(spark, folder))


@query(_PRUNED)
def band_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _pruned(catalogue.band_candidates(spark, folder))


@query(f"with {_Q}, d as (select vec_id, list_sum(list_transform(list_zip(embedding, v), lambda x: abs(x[1]::double - x[2]::double))) d from embeddings, q) select vec_id from d order by d, vec_id limit {K}")
def knn_registered(spark: SparkSession, folder: str) -> DataFrame:
    """A distance that is registered, not built in."""
    if "man" not in vectors.SHORT:
        vectors.register_distance("manhattan", "man", vectors.manhattan)
    return engine(spark, folder, "embeddings").sql(f"select vec_id from embeddings order by embedding <MAN> {text_of(vector_of(spark, folder))} limit {K}")


@query(f"select a.vec_id, round({_DOT.format(a='a.embedding', b='b.embedding')}, 6) dot from embeddings a, (select embedding from embeddings where vec_id = 0) b")
def vector_dot(spark: SparkSession, folder: str) -> DataFrame:
    return files.table(spark, folder, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), vectors.literal(vector_of(spark, folder))), 6).alias("dot"))


# ---- aggregates of the user's, joins by strategy, closures

if "spread" not in relational.AGGREGATES:
    relational.register_aggregate("spread", "spreadof", lambda c: F.max(c) - F.min(c), numeric=True)


@query("select l_returnflag, max(l_quantity) - min(l_quantity) spreadofl_quantity from lineitem group by 1")
def agg_registered(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder, "lineitem").sql("select l_returnflag, spread(l_quantity) from lineitem group by l_returnflag")


for _name, _prefix, _made in (("variance", "varianceof", aggregates.Variance()), ("extent", "extentof", aggregates.Extent())):
    if _name not in relational.AGGREGATES:
        relational.register_mergeable(_name, _prefix, _made)


@query("select round(var_pop(l_extendedprice), 2) varianceofl_extendedprice, max(l_quantity) - min(l_quantity) extentofl_quantity, count(l_orderkey) countofl_orderkey from lineitem")
def agg_merged_one_group(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates of states over one group of all lines: a task sees one state of each other task at the most."""
    df = engine(spark, folder, "lineitem").sql("select variance(l_extendedprice), extent(l_quantity), count(l_orderkey) from lineitem")
    return df.withColumn("varianceofl_extendedprice", F.round("varianceofl_extendedprice", 2))


@query("select l_returnflag, l_linestatus, round(var_pop(l_extendedprice), 2) varianceofl_extendedprice, avg(l_quantity) avgofl_quantity from lineitem group by all")
def agg_merged_groups(spark: SparkSession, folder: str) -> DataFrame:
    df = engine(spark, folder, "lineitem").sql("select l_returnflag, l_linestatus, variance(l_extendedprice), avg(l_quantity) from lineitem group by l_returnflag, l_linestatus")
    return df.withColumn("varianceofl_extendedprice", F.round("varianceofl_extendedprice", 2))


@query("select l_returnflag, round(sum(l_discount * l_discount), 4) squaresofl_discount from lineitem group by 1")
def agg_user_function(spark: SparkSession, folder: str) -> DataFrame:
    """An aggregate written in pandas and registered by a client, with what makes one of the results of two parts of a group."""
    e = engine(spark, folder, "lineitem")

    @F.pandas_udf("double")
    def squares(v: pd.Series) -> float:
        return float((v * v).sum())

    client.register_function(e, "squares", squares, "squaresof", operator.add)
    return e.sql("select l_returnflag, squares(l_discount) from lineitem group by l_returnflag").withColumn("squaresofl_discount", F.round("squaresofl_discount", 4))


@query("select r_name, n_name from region, nation where r_regionkey < n_regionkey")
def join_nested_loop(spark: SparkSession, folder: str) -> DataFrame:
    r, n = files.table(spark, folder, "region"), files.table(spark, folder, "nation")
    return relational.theta_join(r, n, Predicate((Term(Name("r_regionkey"), "<", Name("n_regionkey")),)), "nested_loop").select("r_name", "n_name")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_custkey >= 5 and o_custkey < 50")
def join_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Comparisons with constants reach the columns that are equal to the one they name."""
    p = Predicate((Term(Name("o_custkey"), "=", Name("c_custkey")), Term(Name("c_custkey"), "=", Name("k")), Term(Name("o_custkey"), ">=", Constant(5)), Term(Constant(50), ">", Name("k"))))
    own = p.closed().on(["c_custkey", "c_name"])  # neither comparison names this column
    c = relational.select(files.table(spark, folder, "customer"), own)
    return relational.equi_join(files.table(spark, folder, "orders"), c, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


# ---- indexes


def _used(e: Engine, text: str, *names: str) -> DataFrame:
    df = e.sql(text)
    if e.used != list(names):
        raise BadSemantics(f"read {e.used}, not {list(names)}")
    return df


@query("select o_orderkey, o_totalprice from orders where o_custkey = 37")
def index_hash_sql(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "orders")
    e.execute("create index by_customer on orders (o_custkey) using hash")
    return _used(e, "select o_orderkey, o_totalprice from orders where o_custkey = 37", "by_customer")


@query("select o_orderkey, o_orderdate from orders where o_custkey = 7 and o_orderkey > 3 and o_orderstatus = 'F'")
def index_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Of three indexes the one with the most keys the predicate bounds is read."""
    e = engine(spark, folder, "orders")
    e.execute("create index by_size on orders (o_custkey, o_orderkey)")
    e.execute("create index by_status on orders (o_orderstatus) using hash")
    e.execute("create index by_price on orders (o_totalprice)")
    return _used(e, "select o_orderkey, o_orderdate from orders where o_custkey = 7 and o_orderkey > 3 and o_orderstatus = 'F'", "by_size")


@query("select p_partkey, p_size + 100 p_size from part where p_size between 5 and 9 union all select p_partkey, p_size + 100 from (values (-1, 7)) t(p_partkey, p_size)")
def index_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """An index follows an insert, an update, and changes that a transaction makes."""
    e = _parts(spark, folder)
    e.execute("create index by_size on parts (p_size)")
    e.execute("insert into parts (p_partkey, p_name, p_size, p_retailprice) values (-1, 'new', 7, 1.5)")
    text = "select p_partkey, p_size from parts where p_size >= {} and p_size <= {}"
    _used(e, text.format(5, 9), "by_size")
    e.execute("update parts set p_size = add(p_size, 100) where p_size >= 5 and p_size <= 9")
    _used(e, text.format(105, 109), "by_size")
    with e.transaction():
        e.execute("insert into parts (p_partkey, p_name, p_size, p_retailprice) values (-2, 'newer', 107, 1.5)")
        e.execute("delete from parts where p_partkey = -2")
        _used(e, text.format(105, 109))
    return _used(e, text.format(105, 109), "by_size")


@query("select count(*) queries, true index_read, true recall_reached from embeddings where vec_id % 50 = 0")
def cells_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the rows deleted and put in again: the cells are read still, and reach the recall at no more probes than when built, over all queries."""
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    e = Engine(spark, tie="vec_id")
    e.execute(f"create table kept (vec_id long, embedding vector({len(df.where('embedding is not null').first().embedding)}))")
    e.insert("kept", df)
    e.execute("create index by_cell on kept (embedding) using ivf")
    probe, bound = e.built["by_cell"].probe, df.agg(F.percentile_approx("vec_id", 0.2, 10_000)).first()[0]
    with e.transaction():
        e.execute(f"delete from kept where vec_id <= {bound}")
        e.insert("kept", df.where(F.col("vec_id") <= bound))
    made, asked = e.built["by_cell"], df.where("vec_id % 50 = 0")
    near = _used(e, f"select vec_id from kept order by embedding <EUC> {text_of(vector_of(spark, folder))} limit {K}", "by_cell")
    found = knn.recall(ivf.search_batch(spark, made.index, asked, K, made.probe), knn.knn_batch(df, asked, K)).first()[0]
    whole = near.count() == K and made.index.rows(spark).count() == df.count()
    return asked.agg(F.count(F.lit(1)).alias("queries")).withColumns({"index_read": F.lit(whole), "recall_reached": F.lit(found >= 0.9 and made.probe <= probe)})


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def index_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables in buckets of their join keys: neither is shuffled."""
    names = []
    for table, key in (("orders", "o_custkey"), ("customer", "c_custkey")):
        names.append(f"{table}_{uuid.uuid4().hex}")
        layouts.hashed_table(files.table(spark, folder, table), [key], names[-1], 8, f"{files.scratch(spark)}/{names[-1]}")
    return layouts.index_join(spark, *names, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("select o_orderkey, c_name, c_acctbal from orders join customer on o_custkey = c_custkey where c_acctbal < 0")
def index_join_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """A join whose other side says which buckets of a hash index are read; the index's side is not shuffled."""
    e = engine(spark, folder, "orders", "customer")
    e.execute("create index by_customer on orders (o_custkey) using hash")
    return _used(e, "select o_orderkey, c_name, c_acctbal from orders, customer where o_custkey = c_custkey and c_acctbal < 0", "by_customer")


@query("""select o_orderpriority, count(distinct o_orderkey) dstcountofo_orderkey, count(l_linenumber) countofl_linenumber
from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 25 group by o_orderpriority""")
def index_join_both(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of a join lie in the buckets of hash indexes: neither is shuffled for it."""
    e = engine(spark, folder, "orders", "lineitem")
    e.execute("create index of_orders on orders (o_orderkey) using hash")
    e.execute("create index of_lines on lineitem (l_orderkey) using hash")
    text = "select o_orderpriority, count_distinct(o_orderkey), count(l_linenumber) from orders, lineitem where o_orderkey = l_orderkey and l_quantity > 25 group by o_orderpriority"
    return _used(e, text, "of_orders", "of_lines")


@query("select p_partkey, p_size from part where p_size between 5 and 9 and p_retailprice < 1200 union all select -1, 7")
def reopened_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A second session reads, and grows, the view and the index that the first one made."""
    first = _parts(spark, folder)
    first.execute("create index by_size on parts (p_size)")
    first.execute("create view cheap as select p_partkey, p_size, p_retailprice from parts where p_retailprice < 1200")
    second = Engine(spark, first.catalog.root)
    second.execute("insert into parts (p_partkey, p_name, p_size, p_retailprice) values (-1, 'new', 7, 1.5)")
    sizes = _used(second, "select p_partkey from parts where p_size >= 5 and p_size <= 9", "by_size")
    return second.table("cheap").join(sizes, "p_partkey", "left_semi").select("p_partkey", "p_size")


@query("select * from (values ('by_key', 0.01), ('by_price', 0.1), ('by_both', 0.001), ('by_status', 0.01)) t(idxname, expected)")
def index_costs(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the rows that a lookup by each index is expected to read."""
    e = engine(spark, folder, "orders")
    for name, columns, kind in (("by_key", "o_custkey", "btree"), ("by_price", "o_totalprice", "btree"), ("by_both", "o_custkey, o_totalprice", "btree"), ("by_status", "o_orderstatus", "hash")):
        e.execute(f"create index {name} on orders ({columns}) using {kind}")
    p = Predicate((Term(Name("o_custkey"), "=", Constant(7)), Term(Name("o_totalprice"), ">", Constant(1000)), Term(Name("o_orderstatus"), "=", Constant("F"))))
    return spark.createDataFrame([(n, round(x.expected(p), 6)) for n, x in e.built.items()], "idxname string, expected double")


@query("select cast(count(*) as varchar) n_rows, true has_plan from orders where o_totalprice > 100000")
def explain_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What EXPLAIN says: a plan with the pushed filter, and the number of rows of the query, which it runs."""
    df = engine(spark, folder, "orders").sql("explain select o_orderkey from orders where o_totalprice > 100000")
    return df.select(F.regexp_extract("query_plan", r"rows: (\d+)", 1).alias("n_rows"), F.col("query_plan").contains("PushedFilters: [IsNotNull(o_totalprice)").alias("has_plan"))


# ---- transactions, sessions, clients


@query("select p_partkey, case when p_size >= 40 then p_size + 1 else p_size end p_size from part where p_size >= 10")
def transaction_commit(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    with e.transaction():
        e.execute("delete from parts where p_size < 10")
        e.execute("update parts set p_size = add(p_size, 1) where p_size >= 40")
    return e.table("parts").select("p_partkey", "p_size")


@query("select p_partkey, p_size from part")
def transaction_rollback(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    with client.connect(e, autocommit=False) as connection:
        connection.cursor().execute("delete from parts where p_size < ?", (10,))
        connection.rollback()
    e.catalog.recover()
    return e.table("parts").select("p_partkey", "p_size")


@query("select * from (values ('read committed', 'writes'), ('repeatable read', 'writes'), ('serializable', 'conflict')) t(isolation, outcome)")
def isolation_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Writing a table after reading another that meanwhile changed."""
    out = []
    for level in ("read committed", "repeatable read", "serializable"):
        e = Engine(spark)
        for t in ("one", "two"):
            e.execute(f"create table {t} (a int)")
        other = Engine(spark, e.catalog.root)
        try:
            with e.transaction(level):
                e.table("one").count()
                other.execute("insert into one (a) values (1)")
                e.execute("insert into two (a) values (2)")
            out.append((level, "writes"))
        except Conflict:
            out.append((level, "conflict"))
    return spark.createDataFrame(out, "isolation string, outcome string")


@query("select n_nationkey, n_name from nation")
def client_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a client fetches, the first one by one."""
    cursor = client.connect(engine(spark, folder, "nation")).cursor().execute("select n_nationkey, n_name from nation")
    got = [cursor.fetchone(), *cursor.fetchmany(3), *cursor]
    return spark.createDataFrame(got, "n_nationkey int, n_name string")


@query("select 0 line, 'r_name' said union all select cast(row_number() over (order by r_name) as int), r_name from region union all select count(*) + 1, 'error' from region")
def console_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What the console shows for a query over two lines and for a wrong statement."""
    from tessera import console

    out: list[str] = []
    console.run(engine(spark, folder, "region"), ["select r_name from region", "order by r_name;", "select nothing from region;", "exit"], out.append)
    return spark.createDataFrame([(i, x.split(":")[0]) for i, x in enumerate(out)], "line int, said string")


@query("select p_partkey, p_size from part")
def recovery(spark: SparkSession, folder: str) -> DataFrame:
    """A writer that was lost between its manifests and the end of its transaction has changed nothing."""
    e = _parts(spark, folder)
    e.catalog.begin()
    e.execute("delete from parts where p_size < 10")
    lost = e.catalog.txn.pending["parts"]
    e.catalog.folder("parts").commit(f"v{lost['base'] + 1:09d}.json", json.dumps({"schema": lost["schema"], "files": lost["files"], "transaction": "lost"}))
    after = Engine(spark, e.catalog.root)
    after.catalog.recover()
    return after.table("parts").select("p_partkey", "p_size")


@query("select * from (values ('index', 'by_size'), ('view', 'cheap')) t(kind, name)")
def drop_view_and_index(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    for v in ("cheap", "gone"):
        e.execute(f"create view {v} as select p_partkey, p_retailprice from parts where p_retailprice < 1000")
    e.execute("create index by_size on parts (p_size)")
    e.execute("create index by_key on parts (p_partkey) using hash")
    e.execute("drop view gone")
    e.execute("drop index by_key")
    names = e.sql("select idxname from idxcat").select(F.lit("index").alias("kind"), F.col("idxname").alias("name"))
    return names.union(e.sql("select viewname from viewcat").select(F.lit("view"), "viewname"))


#: Statements and what is wrong with them.
WRONG = [
    ("select x from nation", "semantics"), ("select n_name from nowhere", "semantics"), ("select n_name from nation where n_name = 3", "semantics"), ("select n_name, count(n_nationkey) from nation", "semantics"),
    ("select sum(n_name) from nation", "semantics"), ("select n_name from nation order by n_name <EUC> [1] limit 2", "semantics"), ("select n_name from", "syntax"), ("select n_name from nation limit x", "syntax"),
    ("insert into nation (n_name) values ('x')", "semantics"), ("create table a_name_that_is_longer_than_thirty_letters (a int)", "semantics"), ("update nation set n_name = 'x' where", "syntax"),
]


@query("select * from (values " + ", ".join(f"({i}, '{kind}')" for i, (_, kind) in enumerate(WRONG)) + ") t(number, error)")
def verifier_errors(spark: SparkSession, folder: str) -> DataFrame:
    e, out = engine(spark, folder, "nation"), []
    for i, (text, _) in enumerate(WRONG):
        try:
            (e.sql if text.startswith("select") else e.execute)(text)
            out.append((i, "none"))
        except DialectError as why:
            out.append((i, "syntax" if isinstance(why, BadSyntax) else "semantics"))
    return spark.createDataFrame(out, "number int, error string")


@query("select 2 refused, count(*) n from part")
def read_only_session(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    reader, refused = Engine(spark, e.catalog.root, read_only=True), 0
    for change in (lambda: reader.execute("delete from parts"), lambda: reader.insert("parts", e.table("parts"))):
        try:
            change()
        except BadSemantics:
            refused += 1
    return reader.table("parts").agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


# ---- statistics


@query("""with c as (select cast(p_size as double) v, count(*) f from part group by 1), j as (select v, abs(lead(f) over (order by v) - f) j from c), b as (select v from j where j is not null order by j desc, v limit 4),
g as (select c.*, (select count(*) from b where b.v < c.v) k from c) select min(v) low, max(v) high, cast(sum(f) as double) frequency, cast(count(*) as double) n_distinct from g group by k""")
def histogram_maxdiff(spark: SparkSession, folder: str) -> DataFrame:
    """Five buckets: their borders are the four largest jumps in frequency."""
    found = statistics.max_diff(files.table(spark, folder, "part"), "p_size", 5, by="frequency")
    return spark.createDataFrame([(b.range.low, b.range.high, b.frequency, b.distinct) for b in found], "low double, high double, frequency double, n_distinct double")


@query("select true close, round(avg(cast(l_quantity > 10 and l_quantity <= 30 as int)), 6) measured from lineitem")
def selectivity_close(spark: SparkSession, folder: str) -> DataFrame:
    df = files.table(spark, folder, "lineitem")
    p = Predicate((Term(Name("l_quantity"), ">", Constant(10)), Term(Name("l_quantity"), "<=", Constant(30))))
    estimate = statistics.predicate_selectivity({"l_quantity": statistics.max_diff(df, "l_quantity")}, p)
    measured = F.avg(p.column().cast("int"))
    return df.agg((F.abs(measured - estimate) < 0.05).alias("close"), F.round(measured, 6).alias("measured"))


@query("select true close, count(*) measured from orders join lineitem on o_orderkey = l_orderkey")
def join_rows_close(spark: SparkSession, folder: str) -> DataFrame:
    o, i = files.table(spark, folder, "orders"), files.table(spark, folder, "lineitem")
    estimate = statistics.join_rows(statistics.max_diff(o, "o_orderkey"), statistics.max_diff(i, "l_orderkey"))
    joined = relational.equi_join(i, o, [("l_orderkey", "o_orderkey")])
    n = F.count(F.lit(1))
    return joined.agg((F.abs(n - estimate) < 0.25 * n).alias("close"), n.alias("measured"))


@query("with t as (select count(*) n, count(distinct l_suppkey) s, count(distinct l_quantity) q from lineitem) select round(s * q * (1 - power(1 - 1.0::double / (s * q), n)), 3) group_rows from t")
def group_rows_estimate(spark: SparkSession, folder: str) -> DataFrame:
    stats = {r.column_name: r for r in statistics.table_stats(files.table(spark, folder, "lineitem"), ["l_suppkey", "l_quantity"]).collect()}
    n = statistics.group_rows([float(r.n_distinct) for r in stats.values()], float(stats["l_suppkey"].n_rows))
    return spark.createDataFrame([(round(n, 3),)], "group_rows double")


@query("select step, n + more n_rows from (select count(*) n from part), (values ('first', 0), ('after 50', 0), ('after 110', 110)) t(step, more)")
def statistics_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics are as they were until over a hundred rows have changed."""
    e = _parts(spark, folder)
    rows = lambda n: spark.range(n).select((-F.col("id") - 1).alias("p_partkey"), F.lit("x").alias("p_name"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    counted = lambda: next(r.n_rows for r in e.statistics.stats("parts"))
    out = [("first", counted())]
    e.insert("parts", rows(50))
    out.append(("after 50", counted()))
    e.insert("parts", rows(60))
    out.append(("after 110", counted()))
    return spark.createDataFrame(out, "step string, n_rows bigint")


@query("select c column_name, cast((select count(*) from part where p_size < 10) as double) frequency from (values ('p_size'), ('p_retailprice')) t(c)")
def histogram_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Histograms of columns whose numbers of rows differ get the least of them."""
    df = files.table(spark, folder, "part")
    made = statistics.synced({"p_size": statistics.max_diff(df.where("p_size < 10"), "p_size"), "p_retailprice": statistics.max_diff(df, "p_retailprice")})
    return spark.createDataFrame([(c, round(sum(b.frequency for b in h), 6)) for c, h in made.items()], "column_name string, frequency double")


#: Columns of lineitem that have histograms, with a range of each and how its rows are told in SQL.
_RANGES = [("l_orderkey", ">", 500), ("l_partkey", "<=", 40), ("l_quantity", "<=", 30), ("l_extendedprice", ">", 40_000), ("l_discount", "=", 0.05), ("l_linenumber", "=", 2)]


@query(" union all ".join(f"select '{c}' column_name, count(*) n_rows, cast(min({c}) as double) + 0.0 least, cast(max({c}) as double) + 0.0 greatest, true rank_error_under_1_percent, true estimate_within_2_percent from lineitem" for c, _, _ in _RANGES))
def histogram_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Histograms of all columns from one pass, with the error of their borders' ranks and of estimates measured on all rows."""
    df = files.table(spark, folder, "lineitem")
    made = sketches.one_pass(df, [c for c, _, _ in _RANGES])
    borders = {c: sorted({b.range.high for b in h}) for c, h in made.items()}
    wanted = {c: Term(Name(c), op, Constant(v)) for c, op, v in _RANGES}
    true = df.agg(F.count(F.lit(1)).alias("n"), *(F.array(*(F.count_if(F.col(c) <= e) for e in borders[c])).alias(c) for c in made), *(F.count_if(t.column()).alias(f"met_{c}") for c, t in wanted.items())).first()
    out = []
    for c, h in made.items():
        guessed = [sum(b.frequency for b in h if b.range.high <= e) for e in borders[c]]
        worst = max((abs(g - t) for g, t in zip(guessed, true[c])), default=0)
        met = statistics.selectivity(h, Predicate((wanted[c],)).range_of(c))
        out.append((c, true.n, min(b.range.low for b in h), borders[c][-1], worst <= 0.01 * true.n, abs(met * true.n - true[f"met_{c}"]) <= 0.02 * true.n))
    return spark.createDataFrame(out, "column_name string, n_rows long, least double, greatest double, rank_error_under_1_percent boolean, estimate_within_2_percent boolean")


# ---- generators


def _made(spark: SparkSession, n: int, **columns) -> DataFrame:
    return spark.range(n).select("id", *(c.alias(name) for name, c in columns.items()))


@query("select cast(1 as bigint) least, cast(6 as bigint) most, true even, cast(0 as bigint) excluded, true two_decimals, true weighed")
def gen_numbers(spark: SparkSession, folder: str) -> DataFrame:
    df = _made(spark, 60_000, die=generators.whole(1, 6, 3), but=generators.whole_but(1, 6, 3, 4), money=generators.fixed(1, 100, 2, 5), word=generators.weighted(["a", "b"], [3, 1], 6))
    share = lambda c, low, high: F.avg(c.cast("int")).between(low, high)
    even = share(F.col("die") == 1, 0.155, 0.178) & share(F.col("die") == 6, 0.155, 0.178)
    return df.agg(F.min("die").alias("least"), F.max("die").alias("most"), even.alias("even"), F.count_if(F.col("but") == 3).alias("excluded"), F.every((F.round("money", 2) == F.col("money")) & F.col("money").between(1, 100)).alias("two_decimals"), share(F.col("word") == "a", 0.73, 0.77).alias("weighed"))


@query("select true lengths, true letters, true digits, true zips")
def gen_strings(spark: SparkSession, folder: str) -> DataFrame:
    df = _made(spark, 5000, t=generators.text(5, 12, 7), d=generators.digits(8, 9), z=generators.zip_code(11))
    lengths = (F.min(F.char_length("t")) == 5) & (F.max(F.char_length("t")) == 12)
    return df.agg(lengths.alias("lengths"), F.every(F.rlike("t", F.lit("^[A-Za-z0-9]*$"))).alias("letters"), F.every(F.rlike("d", F.lit("^[0-9]{8}$"))).alias("digits"), F.every(F.rlike("z", F.lit("^[0-9]{4}11111$"))).alias("zips"))


@query("select i number, l[i // 100 % 10 + 1] || l[i // 10 % 10 + 1] || l[i % 10 + 1] \"name\" from range(1000) t(i), (select ['BAR', 'OUGHT', 'ABLE', 'PRI', 'PRES', 'ESE', 'ANTI', 'CALLY', 'ATION', 'EING'] l)")
def gen_last_names(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("number"), generators.last_name(F.col("id")).alias("name"))


@query("select true in_bounds, true uneven")
def gen_skewed(spark: SparkSession, folder: str) -> DataFrame:
    df = _made(spark, 50_000, x=generators.skewed(255, 0, 999, 7, 13)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return df.agg(F.every(F.col("x").between(0, 999)).alias("in_bounds"), (F.max("n") > 3 * F.avg("n")).alias("uneven"))


@query("select true first, true mirrored, true in_bounds")
def gen_zipfian(spark: SparkSession, folder: str) -> DataFrame:
    """The first rank has its share by the distribution, within a twentieth; ``latest`` is the mirror."""
    want = 1 / sum(i**-0.99 for i in range(1, 1001))
    close = lambda c: F.avg(c.cast("int")).between(0.95 * want, 1.05 * want)
    a, b = generators.zipfian(spark, 100_000, 1000), generators.zipfian(spark, 100_000, 1000, latest=True)
    both = a.agg(close(F.col("key") == 1).alias("first"), F.every(F.col("key").between(1, 1000)).alias("in_bounds"))
    return both.crossJoin(b.agg(close(F.col("key") == 1000).alias("mirrored"))).select("first", "mirrored", "in_bounds")


@query("select i id, 1 n from range(2000) t(i)")
def gen_permutation(spark: SparkSession, folder: str) -> DataFrame:
    return generators.permutation(spark, 2000, 17).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select true share, true in_bounds")
def gen_hot_cold(spark: SparkSession, folder: str) -> DataFrame:
    df = _made(spark, 50_000, key=generators.hot_or_cold(10_000, 10, 0.1, 19))
    return df.agg(F.avg((F.col("key") <= 10).cast("int")).between(0.09, 0.11).alias("share"), F.every(F.col("key").between(1, 10_000)).alias("in_bounds"))


@query(r"select o_orderkey, regexp_replace(regexp_replace(cast(cast(o_totalprice as decimal(18, 2)) as varchar), '(\.\d*?)0+$', '\1'), '\.$', '.0') price from orders")
def gen_plain_decimals(spark: SparkSession, folder: str) -> DataFrame:
    return files.table(spark, folder, "orders").select("o_orderkey", generators.plain(F.col("o_totalprice")).alias("price"))
