"""A query for each operator over the driver's tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import types
from tessera.functions import arithmetic, vectors
from tessera.operators import buckets, inequality, ivf, knn, layouts, prefix, relational, statistics
from tessera.operators.predicates import Constant, Name, Predicate, Term
from tessera.plans import procedures
from tessera.plans.engine import Engine
from tessera.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def take(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return take


def _all() -> None:
    from tessera.plans import workload_queries  # noqa: F401  registers its own


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def engine(spark: SparkSession, folder: str, *tables: str, **options: object) -> Engine:
    e = Engine(spark, tie="vec_id", **options)
    for t in tables:
        e.register(t, files.table(spark, folder, t))
    return e


def dialect(name: str, tables: str, text: str, sql: str | None = None, rounded: dict[str, int] | None = None, **options: object) -> None:
    """A query of the dialect; the oracle runs the same text unless it needs another."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = engine(spark, folder, *tables.split(), **options).sql(text)
        return df.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    run.__name__ = name
    query(sql or text)(run)


# ---- scans, projections, filters

dialect("scan_project", "nation", "select n_name, n_regionkey from nation")
dialect("project_reference_order", "nation", "select n_regionkey, n_name, n_name from nation", "select n_name, n_regionkey from nation", reference_order=True)
dialect("filter_eq_string", "orders", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    dialect(f"filter_{_name}", "lineitem", f"select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity {_op} 25")
dialect("filter_conjunction", "lineitem", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 20 and l_returnflag = 'R'")
dialect("filter_field_field", "events", "select event_id from events where user_id < event_id")
dialect("filter_const_first", "lineitem", "select l_orderkey, l_linenumber from lineitem where 25 < l_quantity")
dialect("range_merge", "lineitem", "select l_orderkey, l_linenumber from lineitem where l_quantity > 5 and l_quantity > 10 and l_quantity <= 30")
dialect("filter_contradiction", "lineitem", "select l_orderkey, l_linenumber from lineitem where l_quantity > 30 and l_quantity < 10")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 10 and l_quantity <= 30 and l_returnflag = 'N'")
def range_extraction(spark: SparkSession, folder: str) -> DataFrame:
    p = Predicate((Term(Name("l_quantity"), ">", Constant(5)), Term(Constant(10), "<", Name("l_quantity")), Term(Name("l_quantity"), "<=", Constant(30)), Term(Name("l_returnflag"), "=", Constant("N"))))
    merged = [p.range_of(c).column(c) for c in ("l_quantity", "l_returnflag")]
    return files.table(spark, folder, "lineitem").where(merged[0] & merged[1]).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, c_custkey from orders, customer where o_custkey = c_custkey and c_acctbal > 5000 and o_totalprice > 100000")
def predicate_split(spark: SparkSession, folder: str) -> DataFrame:
    o, c = (files.table(spark, folder, t) for t in ("orders", "customer"))
    p = Predicate((Term(Name("o_custkey"), "=", Name("c_custkey")), Term(Name("c_acctbal"), ">", Constant(5000)), Term(Name("o_totalprice"), ">", Constant(100000))))
    left, right = relational.select(o, p.on(o.columns)), relational.select(c, p.on(c.columns))
    return relational.theta_join(left, right, p.between(o.columns, c.columns)).select("o_orderkey", "c_custkey")


@query("select l_orderkey, l_linenumber, l_extendedprice * 2 doubled, l_extendedprice + l_quantity added, l_extendedprice - l_tax less, l_extendedprice / l_quantity each, l_linenumber * 3 thrice, l_linenumber // 2 half from lineitem")
def arith_update_expr(spark: SparkSession, folder: str) -> DataFrame:
    c, d, i = F.col, "double", "int"
    make = lambda op, a, ka, b, kb: arithmetic.apply(op, a, ka, b, kb)[0]
    return files.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", make("mul", c("l_extendedprice"), d, F.lit(2), i).alias("doubled"), make("add", c("l_extendedprice"), d, c("l_quantity"), d).alias("added"),
        make("sub", c("l_extendedprice"), d, c("l_tax"), d).alias("less"), make("div", c("l_extendedprice"), d, c("l_quantity"), d).alias("each"),
        make("mul", c("l_linenumber"), i, F.lit(3), i).alias("thrice"), make("div", c("l_linenumber"), i, F.lit(2), i).alias("half"),
    )


@query("select r_regionkey, r_name || '_x' named from region")
def string_add(spark: SparkSession, folder: str) -> DataFrame:
    return files.table(spark, folder, "region").select("r_regionkey", arithmetic.apply("add", F.col("r_name"), "varchar", F.lit("_x"), "varchar")[0].alias("named"))


@query("select p_partkey, cast(trunc(p_retailprice) as int) price_int, cast(p_size as bigint) size_long, cast(p_size as double) size_double from part")
def written_casts(spark: SparkSession, folder: str) -> DataFrame:
    make = lambda c, kind, source: types.written(F.col(c), types.field(c, kind), source)
    return files.table(spark, folder, "part").select("p_partkey", make("p_retailprice", "int", "double").alias("price_int"), make("p_size", "long", "int").alias("size_long"), make("p_size", "double", "int").alias("size_double"))


# ---- joins

dialect("cross_product", "region supplier", "select r_name, s_name from region, supplier")
dialect("join_equi", "customer nation", "select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey")

@query("select o_orderkey, l_orderkey, l_linenumber from orders join lineitem on l_extendedprice >= o_totalprice and l_extendedprice < o_totalprice + 0.5")
def join_band(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose price is that of any order, or up to half a unit more."""
    o = files.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") + 0.5).alias("most"))
    lines = files.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return inequality.inequality_join(o, lines, [("o_totalprice", "<=", "l_extendedprice"), ("most", ">", "l_extendedprice")]).select("o_orderkey", "l_orderkey", "l_linenumber")


@query("select s_suppkey, count(*) n, cast(sum(p_size) as bigint) sizes from supplier join part on p_retailprice < s_acctbal group by s_suppkey")
def join_inequality(spark: SparkSession, folder: str) -> DataFrame:
    """The parts that each supplier's balance pays for."""
    paid = inequality.inequality_totals(files.table(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), files.table(spark, folder, "part").select("p_size", "p_retailprice"), ("s_acctbal", ">", "p_retailprice"), {"sizes": "p_size"})
    return paid.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.sum("sizes").alias("sizes"))


@query("select o_orderkey, l_orderkey, l_linenumber from orders join lineitem on o_totalprice < l_extendedprice and o_orderdate > l_shipdate where o_totalprice > 90000 and l_quantity >= 50")
def join_two_inequalities(spark: SparkSession, folder: str) -> DataFrame:
    """Comparisons of different columns: the first is joined on, the second filters."""
    o = files.table(spark, folder, "orders").where("o_totalprice > 90000").select("o_orderkey", "o_totalprice", "o_orderdate")
    lines = files.table(spark, folder, "lineitem").where("l_quantity >= 50").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return inequality.inequality_join(o, lines, [("o_totalprice", "<", "l_extendedprice"), ("o_orderdate", ">", "l_shipdate")]).select("o_orderkey", "l_orderkey", "l_linenumber")


dialect("join_theta", "region nation", "select r_name, n_name from region, nation where r_regionkey < n_regionkey")
dialect("join_three_way", "customer orders nation", "select o_orderkey, c_name, n_name from orders, nation, customer where o_custkey = c_custkey and c_nationkey = n_nationkey and o_totalprice > 100000")
dialect("join_composite", "orders lineitem supplier", "select l_orderkey, l_linenumber, s_name from lineitem, orders, supplier where l_orderkey = o_orderkey and l_suppkey = s_suppkey and o_custkey > s_suppkey")

_HINTED = "select o_orderpriority, count(*) countofl_orderkey, round(sum(l_quantity), 2) sumofl_quantity from orders join lineitem on o_orderkey = l_orderkey group by o_orderpriority"


def _hinted(strategy: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        o, i = files.table(spark, folder, "orders"), files.table(spark, folder, "lineitem")
        # the smaller side, the orders, is the one built or broadcast; broadcast is asked for, which is its point here
        joined = relational.equi_join(i, o, [("l_orderkey", "o_orderkey")], strategy)
        return relational.group_by(joined, ["o_orderpriority"], [("count", "l_orderkey"), ("sum", "l_quantity")]).withColumn("sumofl_quantity", F.round("sumofl_quantity", 2))

    run.__name__ = f"join_{strategy}_hint"
    query(_HINTED)(run)


for _name in ("merge", "hash", "broadcast"):
    _hinted(_name)

# ---- aggregates

_AGG = {
    "count": ("count(l_orderkey)", "countofl_orderkey", "count(*)", None), "count_distinct": ("count(distinct l_suppkey)", "dstcountofl_suppkey", "count(distinct l_suppkey)", None),
    "sum": ("sum(l_quantity)", "sumofl_quantity", "round(sum(l_quantity), 2)", 2), "avg": ("avg(l_discount)", "avgofl_discount", "round(avg(l_discount), 6)", 6),
    "min": ("min(l_extendedprice)", "minofl_extendedprice", "min(l_extendedprice)", None), "max": ("max(l_extendedprice)", "maxofl_extendedprice", "max(l_extendedprice)", None),
}
for _name, (_text, _out, _sql, _digits) in _AGG.items():
    dialect(f"agg_{_name}", "lineitem", f"select l_returnflag, {_text} from lineitem group by l_returnflag", f"select l_returnflag, {_sql} {_out} from lineitem group by l_returnflag", {_out: _digits} if _digits else None)
dialect("agg_multi_group", "lineitem", "select l_returnflag, l_linestatus, count(l_orderkey), sum(l_quantity) from lineitem group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, count(*) countofl_orderkey, round(sum(l_quantity), 2) sumofl_quantity from lineitem group by all", {"sumofl_quantity": 2})
dialect("agg_global", "orders", "select count(o_orderkey), max(o_totalprice), min(o_totalprice) from orders", "select count(*) countofo_orderkey, max(o_totalprice) maxofo_totalprice, min(o_totalprice) minofo_totalprice from orders")
dialect("agg_global_empty", "orders", "select count(o_orderkey) from orders where o_totalprice < 0", "select count(*) countofo_orderkey from orders where o_totalprice < 0")
dialect("agg_global_empty_strict", "orders", "select count(o_orderkey) from orders where o_totalprice < 0", "select count(*) countofo_orderkey from orders where o_totalprice < 0 having count(*) > 0", strict_empty=True)
dialect("group_distinct", "orders", "select o_orderstatus, o_orderpriority from orders group by o_orderstatus, o_orderpriority", "select distinct o_orderstatus, o_orderpriority from orders")

# ---- order and limits

@query("select l_orderkey, l_linenumber, row_number() over (order by l_shipdate desc, l_extendedprice, l_orderkey, l_linenumber) p from lineitem")
def sort_positions(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with their place in one order of the whole table."""
    lines = files.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return prefix.positions(lines, [("l_shipdate", False), ("l_extendedprice", True), ("l_orderkey", True), ("l_linenumber", True)], "p").select("l_orderkey", "l_linenumber", "p")


dialect("sort_multi", "orders", "select o_orderpriority, o_orderkey from orders order by o_orderpriority desc, o_orderkey asc limit 50")
dialect("sort_hidden_column", "orders", "select o_orderkey from orders order by o_totalprice, o_orderkey limit 25")
dialect("sort_by_agg", "orders", "select o_custkey, count(o_orderkey) from orders group by o_custkey order by count(o_orderkey) desc, o_custkey limit 5", "select o_custkey, count(*) countofo_orderkey from orders group by o_custkey order by 2 desc, 1 limit 5")
dialect("limit_zero", "orders", "select o_orderkey from orders limit 0")
dialect("topk", "orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'")
def materialized(spark: SparkSession, folder: str) -> DataFrame:
    return relational.materialize(files.table(spark, folder, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"))


# ---- vectors

_Q = "q as (select embedding v from embeddings where vec_id = 0)"
_L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2]::double))"
_COS = f"({_DOT} / (sqrt({_DOT.format(a='{a}', b='{a}')}) * sqrt({_DOT.format(a='{b}', b='{b}')})))"


def _ranked(distance: str, where: str = "true", source: str = "embeddings") -> str:
    d = distance.format(a="embedding", b="v")
    return f"with {_Q}, d as (select vec_id, {d} d from {source}, q where {where}) select vec_id, cast(row_number() over (order by d, vec_id) as int) \"rank\" from d order by d, vec_id limit {K}"


def vector_of(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    return files.table(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


def text_of(vector: list[float]) -> str:
    return "[" + ", ".join(map(repr, vector)) + "]"


def _with_rank(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "rank")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "embeddings")
    return e.sql(f"select vec_id from embeddings order by embedding <EUC> {text_of(vector_of(spark, folder))} limit {K}")


@query(f"select vec_id from ({_ranked(_L2)})")
def knn_sql(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)


def _knn(name: str, distance: str, sql: str, where: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = files.table(spark, folder, "embeddings")
        return _with_rank(knn.knn(df.where(where) if where else df, vector_of(spark, folder), K, distance))

    run.__name__ = name
    query(sql)(run)


_knn("knn_l2", "euclidean", _ranked(_L2))
_knn("knn_cosine", "cosine", _ranked(f"1 - {_COS}"))
_knn("knn_cosine_ref", "cosine_similarity", _ranked(_COS))
_knn("knn_filtered", "euclidean", _ranked(_L2, "label = 2"), "label = 2")


@query(f"select vec_id from ({_ranked(f'round({_COS}, 12)')})")
def knn_cosine_sql_ref(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "embeddings", similarity=True)
    return e.sql(f"select vec_id from embeddings order by embedding <COS> {text_of(vector_of(spark, folder))} limit {K}")


@query(f"with {_Q}, d as (select vec_id, r_name, {_L2.format(a='embedding', b='v')} d from embeddings join region on label = r_regionkey, q) select vec_id, r_name from d order by d, vec_id limit {K}")
def knn_join(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "embeddings", "region")
    return e.sql(f"select vec_id, r_name from embeddings, region where label = r_regionkey order by embedding <EUC> {text_of(vector_of(spark, folder))} limit {K}")


_BATCH = f"with d as (select q.vec_id query_id, e.vec_id id, {_L2.format(a='e.embedding', b='q.embedding')} d from embeddings q, embeddings e where q.vec_id % 50 = 0), r as (select *, cast(row_number() over (partition by query_id order by d, id) as int) \"rank\" from d) select query_id, id, \"rank\" from r where \"rank\" <= {K}"


@query(_BATCH)
def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    df = files.table(spark, folder, "embeddings")
    return knn.knn_batch(df, df.where("vec_id % 50 = 0"), K).select("query_id", "id", "rank")


@query(_ranked(_L2))
def knn_heap(spark: SparkSession, folder: str) -> DataFrame:
    return _with_rank(knn.knn_heap(files.table(spark, folder, "embeddings"), vector_of(spark, folder), K))


def _vector_sums(spark: SparkSession, folder: str, made: Callable[[Column, Column], Column]) -> DataFrame:
    v = F.transform(made(F.col("embedding"), vectors.literal(vector_of(spark, folder))), lambda x: x.cast("double"))
    return files.table(spark, folder, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x), 6).alias("norm2"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


def _vector_oracle(each: str) -> str:
    return f"with {_Q}, w as (select vec_id, list_transform(list_zip(embedding, v), lambda x: {each}) w from embeddings, q) select vec_id, round(list_sum(list_transform(w, lambda x: x * x)), 6) norm2, round(w[1], 6) \"first\" from w"


@query(_vector_oracle("x[1]::double + x[2]::double"))
def vector_add(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_sums(spark, folder, lambda a, b: vectors.add(a.cast("array<double>"), b))


@query(_vector_oracle("x[1]::double - x[2]::double"))
def vector_sub(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_sums(spark, folder, lambda a, b: vectors.sub(a.cast("array<double>"), b))


@query(_vector_oracle("x[1]::double / 4"))
def vector_div_int(spark: SparkSession, folder: str) -> DataFrame:
    return _vector_sums(spark, folder, lambda a, b: vectors.div(a, F.lit(4)))


@query("select count(*) n from embeddings a, embeddings b where a.embedding = b.embedding and b.vec_id = 0")
def vector_equality(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "embeddings")
    return e.sql(f"select count(vec_id) from embeddings where embedding = {text_of(vector_of(spark, folder))}").withColumnRenamed("countofvec_id", "n")


@query("select vec_id, cast(64 as int) dim, true rounded, true near from embeddings")
def query_perturbation(spark: SparkSession, folder: str) -> DataFrame:
    """Noise of two decimals whose mean and deviation over a vector are those of a standard normal, within five errors."""
    df = files.table(spark, folder, "embeddings").withColumn("noisy", vectors.perturbed(F.col("embedding"), 64, 5))
    noise = F.zip_with("noisy", "embedding", lambda x, y: x - y.cast("double"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x) / 64
    rounded = F.forall(noise, lambda x: F.abs(x - F.round(x, 2)) < 1e-5)
    near = (F.abs(mean(noise)) < 5 / 8) & F.sqrt(mean(F.transform(noise, lambda x: x * x))).between(0.55, 1.45)
    return df.select("vec_id", F.size("noisy").alias("dim"), rounded.alias("rounded"), near.alias("near"))


# ---- approximate search


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, ivf.Ivf]:
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return df, ivf.build(df, cells=max(1, min(4096, round(4 * df.count() ** 0.5))))


@query(_ranked(_L2))
def ivf_full_probe(spark: SparkSession, folder: str) -> DataFrame:
    _, index = _index(spark, folder)
    return _with_rank(ivf.search(spark, index, vector_of(spark, folder), K, len(index.centroids)))


@query()
def ivf_probe(spark: SparkSession, folder: str) -> DataFrame:
    """All queries at the fewest probed cells that reach a recall of 0.9 against brute force."""
    df, index = _index(spark, folder)
    asked = df.where("vec_id % 50 = 0")
    probe, found = ivf.probe_for(spark, index, df, asked, K, 0.9)
    return ivf.search_batch(spark, index, asked, K, probe).select("query_id", "id", "rank", F.lit(probe).alias("probe"), F.lit(found).alias("recall"))


def _bucket_sql(tables: int, directions: int, bands: int) -> str:
    """The same family, probes and comparisons; a neighbour is met from ``need`` probes on."""
    number = "((({x} * {x}) % 2147483647) * {x} + 7919) % 2147483647"
    return f"""
with w as (select i // 64 // {directions} t, i // 64 % {directions} c, list(case when i % 64 // {64 // bands} = i // 64 // {directions} % {bands} then x / 1073741823.5 - 1 else 0.0 end order by i) w
  from (select i, {number.format(x="y")} x from (select i, {number.format(x="z")} y from (select i, (i * 2654435761 + 12345) % 2147483647 z from range({tables * directions * 64}) r(i)))) group by all),
e as (select vec_id, embedding::double[] v from embeddings),
s as (select vec_id, t, c, list_inner_product(v, w) s from e, w where vec_id % 50 = 0),
p as (select vec_id query_id, t, c, row_number() over (partition by vec_id, t order by s desc, c) p from s),
codes as (select vec_id id, t, arg_max(c, list_inner_product(v, w)) c from e, w group by all),
need as (select query_id, id, min(p) need from codes join p using (t, c) group by all),
d as (select n.*, list_distance(a.v, b.v) d from need n join e a on a.vec_id = id join e b on b.vec_id = query_id),
truth as (select *, row_number() over (partition by query_id order by d, id) r from d),
u as (select *, row_number() over (order by need) i, count(*) over () total from truth where r <= {K}),
probes as (select need probes from u where i >= 0.9 * total order by i limit 1),
f as (select query_id, id, row_number() over (partition by query_id order by d, id) r, count(*) over (partition by query_id) compared from d, probes where need <= probes)
select query_id, id, cast(r as int) "rank", cast(compared as bigint) compared, cast(probes as int) probes,
  round((select avg(case when need <= probes then 1 else 0 end) from u), 9) recall,
  round((select count(*) from d where need <= probes) / ((select count(*) from e) * (select count(*) from e where vec_id % 50 = 0)), 9) share
from f, probes where r <= {K}
"""


def _bucket_search(spark: SparkSession, folder: str, tables: int, bands: int) -> DataFrame:
    """All rows whose id is divisible by 50 against all rows, with the fewest probes that reach a recall of 0.9 against brute force, measured.

    compared is the number of rows compared with each query, share that of all pairs.
    """
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = df.where("vec_id % 50 = 0")
    index = buckets.build(df, buckets.Family(64, tables, 256, bands))
    probes, found = buckets.probes_for(spark, index, asked, knn.knn_batch(df, asked, K))
    near = relational.materialize(buckets.search_batch(spark, index, asked, K, probes))  # k rows a query
    compared = near.where("rank = 1").agg(F.sum("compared")).first()[0] or 0
    share = compared / max(1, df.count() * asked.count())
    return near.select("query_id", "id", "rank", "compared", F.lit(probes).alias("probes"), F.lit(round(found, 9)).alias("recall"), F.lit(round(share, 9)).alias("share"))


@query(_bucket_sql(12, 256, 1))
def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _bucket_search(spark, folder, 12, 1)


@query(_bucket_sql(32, 256, 4))
def band_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _bucket_search(spark, folder, 32, 4)


def _stored(spark: SparkSession, folder: str) -> Engine:
    e = Engine(spark, tie="vec_id")
    e.execute("create table vecs (vec_id long, embedding vector(64))")
    e.insert("vecs", files.table(spark, folder, "embeddings").where("vec_id % 5 <> 4").select("vec_id", "embedding"))
    return e


@query(f"select vec_id from ({_ranked(_L2)})")
def knn_after_insert(spark: SparkSession, folder: str) -> DataFrame:
    e, df = _stored(spark, folder), files.table(spark, folder, "embeddings")
    e.insert("vecs", df.where("vec_id % 5 = 4").select("vec_id", "embedding"))
    return e.sql(f"select vec_id from vecs order by embedding <EUC> {text_of(vector_of(spark, folder))} limit {K}")


@query(_ranked(_L2, "vec_id % 5 <> 4 or vec_id <= (select max(vec_id) from embeddings) // 2"))
def knn_insert_replay(spark: SparkSession, folder: str) -> DataFrame:
    df = files.table(spark, folder, "embeddings").select("vec_id", "embedding")
    log = df.where("vec_id % 5 = 4").withColumn("seq", F.col("vec_id"))
    half = df.agg(F.max("vec_id")).first()[0] // 2  # the first half of the log has been seen
    return _with_rank(knn.knn(knn.visible(df.where("vec_id % 5 <> 4"), log, half), vector_of(spark, folder), K))


# ---- views, changes, catalog


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def view_query(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "orders")
    e.execute("create view finished as select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
    return e.sql("select o_orderkey, o_totalprice from finished where o_totalprice > 100000")


@query("select c_name, o_orderkey from customer, orders where o_custkey = c_custkey and o_orderstatus = 'F'")
def view_join(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "orders", "customer")
    e.execute("create view finished as select o_orderkey, o_custkey from orders where o_orderstatus = 'F'")
    return e.sql("select c_name, o_orderkey from customer, finished where o_custkey = c_custkey")


def _parts(spark: SparkSession, folder: str) -> Engine:
    e = Engine(spark)
    e.execute("create table parts (p_partkey long, p_name varchar(100), p_size int, p_retailprice double)")
    e.insert("parts", files.table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"))
    return e


_PARTS = "select p_partkey, p_name, p_size, p_retailprice from part"


@query("select p_partkey, case when p_size < 10 then p_name || '!' else p_name end p_name, case when p_size < 10 then p_size + 100 else p_size end p_size, case when p_size < 10 then p_retailprice * 2 else p_retailprice end p_retailprice from part")
def update_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    e.execute("update parts set p_retailprice = mul(p_retailprice, 2), p_size = add(p_size, 100), p_name = add(p_name, '!') where p_size < 10")
    return e.table("parts")


@query(f"{_PARTS} where not p_size >= 40")
def delete_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    e.execute("delete from parts where p_size >= 40")
    return e.table("parts")


@query(f"{_PARTS} union all select -1, 'it''s new', 3, 9.5")
def insert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    e.execute("insert into parts (p_partkey, p_size, p_name, p_retailprice) values (-1, 3.7, 'it''s new', 9.5)")
    return e.table("parts")


@query("select (select count(*) from part where p_size < 10) updated, (select count(*) from part where p_size >= 40) deleted, cast(1 as bigint) inserted")
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = _parts(spark, folder)
    updated = e.execute("update parts set p_retailprice = 0.0 where p_size < 10")
    deleted = e.execute("delete from parts where p_size >= 40")
    inserted = e.execute("insert into parts (p_partkey, p_size, p_name, p_retailprice) values (-1, 3, 'new', 9.5)")
    return spark.createDataFrame([(updated, deleted, inserted)], "updated bigint, deleted bigint, inserted bigint")


@query("select * from (values ('parts', 'p_name', 'varchar', 100), ('parts', 'p_partkey', 'long', 0), ('parts', 'p_retailprice', 'double', 0), ('parts', 'p_size', 'int', 0)) t(tblname, fldname, type, typearg)")
def catalog_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark)
    e.execute("create table parts (p_partkey long, p_name varchar(100), p_size int, p_retailprice double)")
    return e.sql("select tblname, fldname, type, typearg from fldcat where tblname = 'parts'")


@query("select * from (values ('by_size', 'orders', 'btree', 'o_custkey'), ('by_size', 'orders', 'btree', 'o_orderkey'), ('by_status', 'orders', 'hash', 'o_orderstatus')) t(idxname, tblname, idxtype, keyname)")
def catalog_indexes(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "orders")
    e.execute("create index by_size on orders (o_custkey, o_orderkey)")
    e.execute("create index by_status on orders (o_orderstatus) using hash")
    return e.catalog.tables()["idxcat"].join(e.catalog.tables()["idxkeycat"], "idxname").select("idxname", "tblname", "idxtype", "keyname")


@query("select * from (values ('table', 'others'), ('view', 'kept'), ('index', 'by_a')) t(kind, name)")
def drop_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """What the catalog has after a table is dropped: only what does not hang on it."""
    e = _parts(spark, folder)
    e.execute("create view cheap as select p_partkey, p_retailprice from parts where p_retailprice < 1000")
    e.execute("create view cheapest as select p_partkey from cheap")
    e.execute("create index by_key on parts (p_partkey) using btree")
    e.execute("create table others (a int)")
    e.execute("create view kept as select a from others")
    e.execute("create index by_a on others (a)")
    e.execute("drop table parts")
    left = [e.sql(f"select {name} from {cat}").select(F.lit(kind).alias("kind"), F.col(name).alias("name")) for kind, cat, name in (("table", "tblcat", "tblname"), ("view", "viewcat", "viewname"), ("index", "idxcat", "idxname"))]
    return left[0].union(left[1]).union(left[2])


@query("select o_orderkey, o_custkey from orders where o_custkey >= 100 and o_custkey < 200")
def index_range_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A range read from a sorted index, which the planner chooses."""
    e = engine(spark, folder, "orders")
    e.execute("create index by_customer on orders (o_custkey)")
    df = e.sql("select o_orderkey, o_custkey from orders where o_custkey >= 100 and o_custkey < 200")
    if e.used != ["by_customer"]:
        raise ValueError("the index was not read")
    return df


@query("select o_custkey, o_orderkey, 'by_size' chosen from orders where o_custkey = 7 and o_orderkey > 3 and o_orderstatus = 'F'")
def index_selection(spark: SparkSession, folder: str) -> DataFrame:
    indexes = {"by_size": ("btree", ("o_custkey", "o_orderkey")), "by_status": ("hash", ("o_orderstatus",)), "by_price": ("btree", ("o_totalprice",))}
    p = Predicate((Term(Name("o_custkey"), "=", Constant(7)), Term(Name("o_orderkey"), ">", Constant(3)), Term(Name("o_orderstatus"), "=", Constant("F"))))
    return relational.select(files.table(spark, folder, "orders"), p).select("o_custkey", "o_orderkey", F.lit(layouts.best(indexes, p)).alias("chosen"))


@query()
def explain_text(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder, "orders").sql("explain select o_orderkey from orders where o_totalprice > 100000")


# ---- statistics and checks


@query("select 'o_orderkey' column_name, count(*) n_rows, count(distinct o_orderkey) n_distinct, cast(min(o_orderkey) as varchar) least, cast(max(o_orderkey) as varchar) greatest from orders union all select 'o_orderstatus', count(*), count(distinct o_orderstatus), min(o_orderstatus), max(o_orderstatus) from orders")
def stats_table(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.table_stats(files.table(spark, folder, "orders"), ["o_orderkey", "o_orderstatus"])


@query("select cast(p_size as double) low, cast(p_size as double) high, cast(count(*) as double) frequency from part group by p_size")
def histogram_values(spark: SparkSession, folder: str) -> DataFrame:
    """With a bucket for each value, MaxDiff gives the exact frequencies."""
    found = statistics.max_diff(files.table(spark, folder, "part"), "p_size", 10_000, by="frequency")
    return spark.createDataFrame([(b.range.low, b.range.high, b.frequency) for b in found], "low double, high double, frequency double")


@query("select cast(count(*) as double) frequency, cast(count(distinct o_totalprice) as double) n_distinct, min(o_totalprice) low, max(o_totalprice) high from orders")
def histogram_totals(spark: SparkSession, folder: str) -> DataFrame:
    made = statistics.equal_depth(files.table(spark, folder, "orders"), "o_totalprice")
    return made.agg(F.sum("frequency").cast("double").alias("frequency"), F.sum("n_distinct").cast("double").alias("n_distinct"), F.min("low").alias("low"), F.max("high").alias("high"))


@query()
def selectivity_estimate(spark: SparkSession, folder: str) -> DataFrame:
    df = files.table(spark, folder, "lineitem")
    made = statistics.max_diff(df, "l_quantity")
    p = Predicate((Term(Name("l_quantity"), ">", Constant(10)), Term(Name("l_quantity"), "<=", Constant(30))))
    true = df.agg(F.avg(p.column().cast("int"))).first()[0]
    return spark.createDataFrame([(statistics.predicate_selectivity({"l_quantity": made}, p), true)], "estimate double, measured double")


@query()
def cardinality_estimates(spark: SparkSession, folder: str) -> DataFrame:
    o, i = files.table(spark, folder, "orders"), files.table(spark, folder, "lineitem")
    join = statistics.join_rows(statistics.max_diff(o, "o_orderkey"), statistics.max_diff(i, "l_orderkey"))
    groups = statistics.group_rows([3.0, 2.0], float(i.count()))
    return spark.createDataFrame([(join, groups)], "join_rows double, group_rows double")


@query("select count(*) = count(distinct o_orderkey) \"unique\", count(distinct o_orderkey) = max(o_orderkey) - min(o_orderkey) + 1 complete from orders")
def uniqueness_check(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "orders")
    low, high = e.table("orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return procedures.call(e, "check_ids", table="orders", column="o_orderkey", first=low, last=high)


@query("select r.i doc_id from (select unnest(range((select min(doc_id) from documents), (select max(doc_id) from documents) + 1)) i) r where i not in (select doc_id from labels)")
def existence_check(spark: SparkSession, folder: str) -> DataFrame:
    low, high = files.table(spark, folder, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    return files.missing_ids(files.table(spark, folder, "labels"), "doc_id", low, high)


@query("select l_orderkey, count(*) n from lineitem group by 1 having count(*) > 1")
def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    return files.repeated_ids(files.table(spark, folder, "lineitem"), "l_orderkey")


# ---- procedures

dialect("point_read", "customer", "select c_custkey, c_name, c_acctbal from customer where c_custkey = 42")


@query("select c_custkey, c_name from customer where c_custkey in (3, 1, 4, 15, 92)")
def multi_point_read(spark: SparkSession, folder: str) -> DataFrame:
    return procedures.call(engine(spark, folder, "customer"), "point_reads", table="customer", key="c_custkey", values=[3, 1, 4, 15, 92], columns=["c_name"])


@query("select c_nationkey, round(sum(o_totalprice), 2) paid, count(*) n from customer join orders on c_custkey = o_custkey group by c_nationkey")
def payment_totals(spark: SparkSession, folder: str) -> DataFrame:
    c, o = files.table(spark, folder, "customer"), files.table(spark, folder, "orders")
    joined = relational.equi_join(o, c, [("o_custkey", "c_custkey")])
    return joined.groupBy("c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("paid"), F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, round(l_quantity * p_retailprice, 4) ol_amount, case when p_size - cast(l_quantity as int) < 10 then p_size - cast(l_quantity as int) + 91 else p_size - cast(l_quantity as int) end s_quantity_after from lineitem join part on l_partkey = p_partkey")
def neworder_lines(spark: SparkSession, folder: str) -> DataFrame:
    p = files.table(spark, folder, "part")
    lines = files.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ol_i_id"), F.lit(1).alias("ol_supply_w_id"), F.col("l_quantity").cast("int").alias("ol_quantity"))
    items, stock = p.select(F.col("p_partkey").alias("i_id"), F.col("p_retailprice").alias("i_price")), p.select(F.col("p_partkey").alias("s_i_id"), F.lit(1).alias("s_w_id"), F.col("p_size").alias("s_quantity"))
    return procedures.call(Engine(spark), "order_lines", lines=lines, items=items, stock=stock).select("l_orderkey", "l_linenumber", F.round("ol_amount", 4).alias("ol_amount"), "s_quantity_after")


dialect("trade_order_lookup", "orders customer nation region", "select o_orderkey, c_name, n_name, r_name from orders, customer, nation, region where o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = r_regionkey and o_orderkey = 7")


# ---- sources, sinks and streams


@query("select vec_id, 64 dim, embedding[1] \"first\", round(list_sum(list_transform(embedding, lambda x: x::double)), 6) total from embeddings")
def text_vector_source(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{files.scratch(spark)}/lines-{id(spark)}-{folder.rsplit('/', 1)[-1]}"
    vecs = files.table(spark, folder, "embeddings")
    # line numbers are ids, so the lines are written in order of the ids
    lines = vecs.orderBy("vec_id").select(F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ").alias("value"))
    lines.write.mode("overwrite").text(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return files.text_vectors(spark, path).select("vec_id", F.size("embedding").alias("dim"), F.get("embedding", F.lit(0)).alias("first"), F.round(total, 6).alias("total"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def piped_source(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{files.scratch(spark)}/nation-{id(spark)}-{folder.rsplit('/', 1)[-1]}"
    files.table(spark, folder, "nation").write.mode("overwrite").csv(path, sep="|")
    return files.piped(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("select cast(1000 as bigint) n, cast(48 as int) dim, true in_bounds")
def random_vector_source(spark: SparkSession, folder: str) -> DataFrame:
    v = files.random_vectors(spark, 1000, 48)
    return v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), F.every((F.array_min("embedding") >= 0) & (F.array_max("embedding") < 9999)).alias("in_bounds"))


@query("select epoch_ms(ts) // 86400000 slot, count(*) n, round(avg(value), 4) mean, min(value) least, max(value) greatest, round(quantile_cont(value, 0.5), 6) median from events group by 1")
def report_timeline(spark: SparkSession, folder: str) -> DataFrame:
    calls = files.table(spark, folder, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ended_ms"), F.col("value").alias("latency_ms"), F.lit(True).alias("committed"))
    return files.timeline(calls, 86_400_000).select("slot", "n", F.round("mean", 4).alias("mean"), "least", "greatest", F.round("median", 6).alias("median"))


@query("select vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) total from embeddings")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors as a stream into a stored table."""
    from tessera.streaming import ingest

    e = Engine(spark)
    e.execute("create table arrived (vec_id long, label int, embedding vector(64), batch long)")
    schema = files.table(spark, folder, "embeddings").schema
    # a stream reads folders: the table's file is the one of its name there
    at, _, name = f"{folder}/embeddings.parquet".rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{at}/{name[:-len('.parquet')]}*")
    ingest.append(source.select("vec_id", "label", "embedding"), e, "arrived", f"{e.catalog.root}-stream").awaitTermination()
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return e.table("arrived").select("vec_id", "label", F.round(total, 6).alias("total"))


