import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.errors import DialectError
from tessera.operators import ivf, knn, layouts, lsh, relational, statistics
from tessera.operators.predicates import Constant, Name, Predicate, Term
from tessera.plans import procedures
from tessera.plans.engine import Engine
from tessera.sources import files, generators


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 10)).astype("float32")
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5).cache()


def truth(x, q, k):
    d = np.sqrt(((x.astype(float) - q) ** 2).sum(1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]]


def test_knn_is_argsort(base):
    x, df = base
    q = x[7].astype(float) + 0.1
    want = truth(x, q, 9)
    for f in (knn.knn, knn.knn_heap):
        assert [r.vec_id for r in f(df, q.tolist(), 9).orderBy("rank").collect()] == want
    got = knn.knn_batch(df, df.where("vec_id < 70"), 5, block=32)
    for i in (0, 33, 69):
        assert [r.id for r in got.where(f"query_id = {i}").orderBy("rank").collect()] == truth(x, x[i].astype(float), 5)


def test_ivf(spark, base):
    x, df = base
    index = ivf.build(df, cells=6)
    assert index.rows(spark).count() == 300
    q = x[3].astype(float)
    assert [r.vec_id for r in ivf.search(spark, index, q.tolist(), 8, 6).orderBy("rank").collect()] == truth(x, q, 8)
    exact = knn.knn_batch(df, df.where("vec_id < 40"), 8)
    found = [knn.recall(ivf.search_batch(spark, index, df.where("vec_id < 40"), 8, p), exact).first()[0] for p in (1, 3, 6)]
    assert found == sorted(found) and found[-1] == 1.0
    probe, r = ivf.probe_for(spark, index, df, df.where("vec_id % 50 = 0"), 8)
    assert r >= 0.9
    ivf.append(spark.createDataFrame([(999, [0.0] * 10)], df.schema), index)
    assert index.rows(spark).count() == 301


def test_lsh_finds_itself(base):
    x, df = base
    assert lsh.search(df, x[5].astype(float).tolist(), 1).first().vec_id == 5
    assert lsh.band_candidates(df, x[5].astype(float).tolist()).where("vec_id = 5").count() == 1


def test_empty_batch(spark, base):
    _, df = base
    assert knn.knn_batch(df, df.where("false")).count() == 0
    assert knn.knn_batch(df.where("false"), df.where("vec_id < 2")).count() == 0


def test_distance_checks(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "e array<float>")
    with pytest.raises(Exception, match="dimensions"):
        df.select(vectors.euclidean(F.col("e"), vectors.literal([1.0]))).collect()


@pytest.mark.parametrize("strategy", ["merge", "hash", "broadcast", None])
def test_joins_agree(spark, strategy):
    a = spark.createDataFrame([(i % 4, i) for i in range(20)], "k int, x int")
    b = spark.createDataFrame([(i % 3, i) for i in range(9)], "j int, y int")
    rows = relational.equi_join(a, b, [("k", "j")], strategy).collect()
    assert len(rows) == sum(5 * 3 for k in range(4) if k < 3)


def test_where_splits_all(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    p = Predicate((Term(Name("v"), ">", Constant(2)),))
    assert relational.select(df, p).count() + df.where(~p.column()).count() == 50


def test_materialize(spark):
    assert relational.materialize(spark.range(5)).count() == 5


def test_statistics(spark):
    random.seed(1)
    values = [random.choice([1, 1, 1, 2, 5, 9, 40]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    made = statistics.max_diff(df, "v", 4)
    assert sum(b.frequency for b in made) == 500 and len(made) <= 4
    assert statistics.selectivity(made, None) == 0
    exact = statistics.max_diff(df, "v", 100)
    p = Predicate((Term(Name("v"), "<=", Constant(2)),))
    assert abs(statistics.predicate_selectivity({"v": exact}, p) - sum(v <= 2 for v in values) / 500) < 1e-9
    assert statistics.join_rows(exact, exact) == pytest.approx(sum(values.count(v) ** 2 for v in set(values)))
    assert statistics.group_rows([3, 2], 1000) == pytest.approx(6)
    depth = statistics.equal_depth(df, "v", 5).agg(F.sum("frequency")).first()[0]
    assert depth == 500
    assert statistics.max_diff(df.where("false"), "v") == []


def test_layouts(spark, tmp_path):
    df = spark.range(1000).withColumn("k", (F.col("id") * 37) % 1000)
    layouts.sorted_files(df, ["k"], str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).where("k between 10 and 19").count() == 10


def test_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1 2 3\n4.5 5 6\n")
    got = {r.vec_id: list(r.embedding) for r in files.text_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {0: [1, 2, 3], 1: [4.5, 5, 6]}
    assert files.random_vectors(spark, 10, 4).count() == 10
    calls = spark.createDataFrame([(100, 5.0, True), (900, 7.0, True), (1500, 1.0, False)], "ended_ms long, latency_ms double, committed boolean")
    assert [(r.slot, r.n, r.median) for r in files.timeline(calls).collect()] == [(0, 2, 6.0)]
    files.report(calls, str(tmp_path / "r"))
    assert list((tmp_path / "r").glob("*.csv"))


def test_generators(spark):
    df = spark.range(2000)
    r = df.select(generators.whole(3, 5, 1).alias("a"), generators.whole_but(1, 3, 2, 2).alias("b"), generators.fixed(0.5, 1.5, 2, 3).alias("c"), generators.text(3, 6, 4).alias("d"), generators.skewed(255, 1, 1000, 7, 5).alias("e"), generators.hot_or_cold(100, 10, 0.5, 6).alias("f"), generators.weighted(["x", "y"], [1, 3], 7).alias("g"), generators.zip_code(8).alias("z"))
    s = r.agg(F.min("a"), F.max("a"), F.sum((F.col("b") == 2).cast("int")), F.min("c"), F.max("c"), F.min(F.length("d")), F.max(F.length("d")), F.min("e"), F.max("e"), F.avg((F.col("f") <= 10).cast("int")), F.avg((F.col("g") == "y").cast("int")), F.max(F.length("z"))).first()
    assert (s[0], s[1], s[2]) == (3, 5, 0) and s[3] >= 0.5 and s[4] <= 1.5 and (s[5], s[6]) == (3, 6) and s[7] >= 1 and s[8] <= 1000
    assert abs(s[9] - 0.5) < 0.1 and abs(s[10] - 0.75) < 0.1 and s[11] == 9
    assert spark.range(1).select(generators.last_name(F.lit(371))).first()[0] == "PRICALLYOUGHT"
    z = generators.zipfian(spark, 3000, 1000)
    assert z.agg(F.min("key"), F.max("key")).first()[1] <= 1000 and z.where("key = 1").count() > 200
    assert sorted(r.id for r in generators.permutation(spark, 20, 1).collect()) == list(range(20))


def test_new_order_and_payment(spark):
    e = Engine(spark)
    make = {
        "warehouse": "w_id int, w_tax double, w_ytd double", "district": "d_id int, d_w_id int, d_tax double, d_ytd double, d_next_o_id int",
        "customer": "c_id int, c_d_id int, c_w_id int, c_discount double, c_last varchar(16), c_credit varchar(2), c_balance double, c_data varchar(500)",
        "history": "h_c_id int, h_c_d_id int, h_c_w_id int, h_d_id int, h_w_id int, h_date long, h_amount double, h_data varchar(24)",
        "new_order": "no_o_id int, no_d_id int, no_w_id int", "orders": "o_id int, o_d_id int, o_w_id int, o_c_id int, o_entry_d long, o_carrier_id int, o_ol_cnt int, o_all_local int",
        "order_line": "ol_o_id int, ol_d_id int, ol_w_id int, ol_number int, ol_i_id int, ol_supply_w_id int, ol_delivery_d long, ol_quantity int, ol_amount double, ol_dist_info varchar(24)",
        "item": "i_id int, i_price double", "stock": "s_i_id int, s_w_id int, s_quantity int, s_ytd int, s_order_cnt int",
    }
    for t, columns in make.items():
        e.execute(f"create table {t} ({columns})")
    e.execute("insert into warehouse (w_id, w_tax, w_ytd) values (1, 0.1, 0)")
    e.execute("insert into district (d_id, d_w_id, d_tax, d_ytd, d_next_o_id) values (1, 1, 0.05, 0, 7)")
    e.execute("insert into customer (c_id, c_d_id, c_w_id, c_discount, c_last, c_credit, c_balance, c_data) values (5, 1, 1, 0.2, 'BAR', 'BC', 1, 'old')")
    e.execute("insert into item (i_id, i_price) values (3, 2.5)")
    e.execute("insert into stock (s_i_id, s_w_id, s_quantity, s_ytd, s_order_cnt) values (3, 1, 12, 0, 0)")
    total = procedures.call(e, "new_order", w_id=1, d_id=1, c_id=5, lines=[(3, 1, 4)], now=9).first().total
    assert total == pytest.approx(10 * 0.8 * 1.15)
    assert e.table("stock").first().s_quantity == 99 and e.table("district").first().d_next_o_id == 8
    assert procedures.call(e, "payment", w_id=1, d_id=1, c_id=5, amount=2.5, now=9).first().c_balance == 3.5
    assert e.table("customer").first().c_data.endswith("old") and e.table("history").count() == 1
    found = procedures.call(e, "check_ids", table="item", column="i_id", first=3, last=3).first()
    assert found.unique and found.complete


def test_trades(spark):
    e = Engine(spark)
    make = {
        "customer_account": ("ca_id long, ca_b_id long, ca_c_id long, ca_name varchar(50), ca_bal double", "(1, 2, 3, 'acc', 10)"), "customer": ("c_id long, c_f_name varchar(20), c_l_name varchar(25), c_tier int", "(3, 'A', 'B', 1)"),
        "broker": ("b_id long, b_name varchar(49)", "(2, 'bro')"), "security": ("s_symb varchar(15), s_name varchar(70)", "('X', 'sec')"), "last_trade": ("lt_s_symb varchar(15), lt_price double", "('X', 4.5)"), "trade_type": ("tt_id varchar(3), tt_name varchar(12)", "('TMB', 'buy')"),
    }
    for t, (columns, row) in make.items():
        e.execute(f"create table {t} ({columns})")
        e.execute(f"insert into {t} ({', '.join(c.split()[0] for c in columns.split(', '))}) values {row}")
    e.execute("create table trade (t_id long, t_dts long, t_st_id varchar(4), t_tt_id varchar(3), t_is_cash int, t_s_symb varchar(15), t_qty int, t_bid_price double, t_ca_id long, t_exec_name varchar(49), t_trade_price double, t_chrg double, t_comm double, t_tax double, t_lifo int)")
    e.execute("create table trade_history (th_t_id long, th_dts long, th_st_id varchar(4))")
    assert procedures.call(e, "trade_order", ca_id=1, t_id=8, symbol="X", quantity=2, kind="TMB", now=5).count() == 1
    assert procedures.call(e, "trade_result", t_id=8, now=6).first().ca_bal == 14.5
    assert e.table("trade_history").count() == 2


def test_micro_ycsb_and_recall(spark, base):
    x, df = base
    e = Engine(spark)
    e.execute("create table item (i_id int, i_name varchar(24), i_price double)")
    e.insert("item", spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(9)], "i_id int, i_name string, i_price double"))
    assert procedures.call(e, "micro", reads=[1, 2], prices={2: 7.5}).count() == 2
    assert e.sql("select i_price from item where i_id = 2").first().i_price == 7.5 and e.table("item").count() == 9
    e.execute("create table ycsb (ycsb_id varchar(33), ycsb_1 varchar(33))")
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "ycsb_id string, ycsb_1 string")
    assert procedures.call(e, "ycsb", reads=["a"], inserts=new).count() == 0
    assert [r.ycsb_1 for r in procedures.call(e, "ycsb", reads=["a"], writes={"a": "9"}).collect()] == ["1"]
    assert e.sql("select ycsb_1 from ycsb where ycsb_id = 'a'").first().ycsb_1 == "9"
    e.register("vecs", df.where("vec_id < 200"))
    log = df.where("vec_id >= 200").withColumn("seq", F.col("vec_id"))
    want = [i for i in truth(x[:251], x[0].astype(float), 20)]
    assert procedures.call(e, "recall_after_inserts", base="vecs", log=log, query_seq=250, query=x[0].tolist(), found=want).first().recall == 1.0
    assert procedures.call(e, "nearest", table="vecs", query=x[4].tolist(), k=3).first().id_0 == 4


def test_stream(spark, tmp_path):
    from tessera.streaming import ingest

    e = Engine(spark)
    e.execute("create table arrived (vec_id long, embedding vector(2), batch long)")
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.append(stream, e, "arrived", str(tmp_path / "ck")).awaitTermination()
    assert e.table("arrived").count() == 2


def test_stream_keeps_index(spark, tmp_path):
    """A batch that failed between index and table comes again; the index has it once."""
    from tessera.streaming import ingest

    e = Engine(spark)
    e.execute("create table arrived (vec_id long, embedding vector(2), batch long)")
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id bigint, embedding array<float>")
    index = ivf.build(rows.where("vec_id < 4"), cells=2)
    ivf.append_batch(rows.where("vec_id >= 4"), index, 0)
    rows.where("vec_id >= 4").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.append(stream, e, "arrived", str(tmp_path / "ck"), index).awaitTermination()
    assert e.table("arrived").count() == 4
    assert sorted(r.vec_id for r in index.rows(spark).collect()) == list(range(8))


def test_broadcast_by_rows_in_memory(spark, tmp_path):
    """A side of many rows in a small file is not broadcast, though that was asked for; a small one is."""
    many, few = spark.range(1_000_000).selectExpr("id k", "'the same text in all rows' t"), spark.range(1000).selectExpr("id j")
    many.write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert relational.known_bytes(many) < relational.BROADCAST_BYTES
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda a, b, pair: relational.equi_join(a, b, [pair], "broadcast")._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plan(few, many, ("j", "k"))
        assert "BroadcastHashJoin" in plan(many, few, ("k", "j"))
        # a few rows of long texts that the file holds once
        long = spark.range(2000).selectExpr("id k", "repeat('x', 50000) t")
        long.write.parquet(f"{tmp_path}/long")
        assert "BroadcastHashJoin" not in plan(few, spark.read.parquet(f"{tmp_path}/long"), ("j", "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert relational.equi_join(few, many, [("j", "k")], "broadcast").count() == 1000


def test_lines_of_uneven_files(spark, tmp_path):
    """Lines are numbered by their files' names, though Spark reads large pieces first, and long files in several."""
    n = [3, 40, 1, 2500, 7]
    for i, lines in enumerate(n):
        at = sum(n[:i])
        (tmp_path / f"part-{i:05}.txt").write_text("".join(f"{at + j} {i}\n" for j in range(lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "5k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = files.text_vectors(spark, str(tmp_path), 10).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted((r.vec_id, r.embedding[0]) for r in got) == [(10 + i, float(i)) for i in range(sum(n))]


def test_prepared_statement_reads_what_each_alone_does(spark):
    """One plan for all query vectors gives what a statement for each gives, also where the nearest cells hold fewer than the limit."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.2, (n, 6)) for c, n in ((0, 150), (9, 40), (-9, 4), (20, 3))])
    e = Engine(spark, tie="vec_id")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    e.register("t", df)
    text = "select vec_id from t order by embedding <EUC> {} limit 12"
    asked = df.where("vec_id % 13 = 0 or vec_id > 185").select("vec_id", F.col("embedding").alias("q"))
    exact = e.sql_each(text.format("?"), asked, "q")
    assert not e.used
    e.execute("create index c on t (embedding) using ivf")
    e.built["c"].probe = 1
    made = e.sql_each(text.format("?"), asked, "q")
    assert e.used == ["c"] and "Union" not in made._jdf.queryExecution().toString()
    got = {}
    for row in made.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.id)
    want = {a.vec_id: [n.vec_id for n in e.sql(text.format(list(a.q))).collect()] for a in asked.collect()}
    assert got == want and all(len(v) == 12 for v in got.values())
    assert {(w.query_id, w.id) for w in exact.collect()} == {(i, int(n)) for i in want for n in truth(x, x[i], 12)}
    for bad in ("select vec_id from t order by embedding <COS> ? limit 3", "select vec_id from t where vec_id > ? limit 3", text.format("[1.0]")):
        with pytest.raises(DialectError):
            e.sql_each(bad, asked, "q")


def test_nearest_in_portions():
    """Rows in portions, with copies, ties and values that expanded squares can't tell apart, as by all exact distances."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 1, (300, 5)), np.repeat(r.normal(0, 1, (4, 5)), 30, 0), 1e8 + r.normal(0, 1e-3, (60, 5)), [[np.inf] * 5, [np.nan] * 5, [1e200] * 5]])
    ids = r.permutation(len(x))
    for q in (x[::7][:60], x[300:302], np.zeros((0, 5))):
        for k, cut in ((9, 40), (9, 1000), (500, 33)):
            near = knn.Nearest(q, k)
            for at in range(0, len(x), cut):
                near.add(ids[at : at + cut], x[at : at + cut])
            d = knn.pair_distances(x, q, "euclidean")
            want = [ids[knn.smallest(d[:, j], ids, k)].tolist() for j in range(len(q))]
            assert [near.ids[near.query == j].tolist() for j in range(len(q))] == want
