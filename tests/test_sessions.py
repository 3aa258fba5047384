"""Transactions, recovery, indexes in plans, clients and the console."""

import pytest

from tessera import client, console
from tessera.errors import BadSemantics, Conflict
from tessera.operators.predicates import Constant, Name, Predicate, Term
from tessera.plans import procedures
from tessera.plans.catalog import Folder
from tessera.plans.engine import Engine
from tessera.sources import loaders


@pytest.fixture
def engine(spark):
    e = Engine(spark, tie="i")
    for t in ("a", "b"):
        e.execute(f"create table {t} (i int, s varchar(20))")
        e.insert(t, spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"))
    return e


def said(e, table):
    return sorted(map(tuple, e.table(table).collect()))


def test_transaction_is_all_or_nothing(spark, engine):
    other = Engine(spark, engine.catalog.root)
    with engine.transaction():
        engine.execute("delete from a where i = 1")
        engine.execute("update b set s = 'z' where i = 2")
        engine.execute("insert into a (i, s) values (3, 'it''s')")
        assert said(engine, "a") == [(2, "y"), (3, "it's")] and said(other, "a") == [(1, "x"), (2, "y")]
    assert said(other, "a") == [(2, "y"), (3, "it's")] and said(other, "b") == [(1, "x"), (2, "z")]
    with pytest.raises(ZeroDivisionError), engine.transaction():
        engine.execute("delete from a")
        1 / 0
    assert len(said(engine, "a")) == 2
    assert engine.catalog.recover() == []


def test_second_writer_conflicts(spark, engine):
    other = Engine(spark, engine.catalog.root)
    with pytest.raises(Conflict), engine.transaction("read committed"):
        engine.execute("delete from b where i = 1")
        engine.execute("delete from a where i = 1")
        other.execute("delete from a where i = 2")
    assert said(engine, "a") == [(1, "x")] and len(said(engine, "b")) == 2


def test_lost_writer_leaves_nothing(spark, engine):
    """Manifests without the file that ends their transaction do not count, and recovery removes them."""
    e = Engine(spark, engine.catalog.root)
    e.catalog.begin()
    e.execute("delete from a where i = 1")
    pending = e.catalog.txn.pending["a"]
    import json

    e.catalog.folder("a").commit(f"v{pending['base'] + 1:09d}.json", json.dumps({"schema": pending["schema"], "files": pending["files"], "transaction": "lost"}))
    fresh = Engine(spark, engine.catalog.root)
    assert said(fresh, "a") == [(1, "x"), (2, "y")]
    gone = fresh.catalog.recover()
    assert len(gone) == 2 and said(fresh, "a") == [(1, "x"), (2, "y")]
    fresh.execute("delete from a where i = 2")
    assert said(fresh, "a") == [(1, "x")]


def test_procedures_roll_back(spark):
    e = Engine(spark)
    loaders.tpcc(e, items=20, customers=3)
    before = {t: sorted(map(tuple, e.table(t).collect())) for t in ("district", "stock", "orders")}
    with pytest.raises(BadSemantics):
        procedures.call(e, "new_order", w_id=1, d_id=1, c_id=1, lines=[(1, 1, 5), (999, 1, 1)], now=0)
    assert before == {t: sorted(map(tuple, e.table(t).collect())) for t in before}
    total = procedures.call(e, "new_order", w_id=1, d_id=1, c_id=1, lines=[(1, 1, 5), (2, 1, 1)], now=0).first().total
    assert total > 0 and e.table("order_line").count() == 2 and e.table("stock").where("s_ytd > 0").count() == 2


def test_quoting():
    assert procedures.quoted("a'b") == "'a''b'" and procedures.quoted(1e20) == "100000000000000000000" and procedures.quoted(-0.5) == "-0.5"


@pytest.mark.parametrize("kind", ["btree", "hash"])
def test_indexes_never_change_results(spark, kind):
    e, plain = Engine(spark), Engine(spark)
    df = spark.createDataFrame([(i % 7, i, str(i % 3)) for i in range(200)], "k int, v int, s string")
    for x in (e, plain):
        x.execute("create table t (k int, v int, s varchar(9))")
        x.insert("t", df)
    e.execute(f"create index ix on t (k) using {kind}")
    for where in ("k = 3", "k = 3 and v > 50", "k = 9", "v = 3", "k > 2 and k < 5", "3 = k and s = '1'"):
        text = f"select k, v, s from t where {where}"
        assert sorted(e.sql(text).collect()) == sorted(plain.sql(text).collect())
        assert e.used == (["ix"] if "k" in where and (kind == "btree" or "k = " in where or "= k" in where) else [])
    e.execute("drop index ix")
    e.sql("select v from t where k = 3").collect()
    assert e.used == []


def test_cells(spark):
    e = Engine(spark, tie="i")
    e.execute("create table v (i long, e vector(2))")
    e.execute("create index cells on v (e) using ivf")
    assert e.sql("select i from v order by e <EUC> [0, 0] limit 3").count() == 0
    e.insert("v", spark.createDataFrame([(i, [float(i % 20), float(i // 20)]) for i in range(400)], "i bigint, e array<float>"))
    near = e.sql("select i from v order by e <EUC> [0, 0] limit 3")
    assert [r.i for r in near.collect()] == [0, 1, 20] and e.used == ["cells"]
    assert e.built["cells"].recall >= 0.9 and e.built["cells"].probe < len(e.built["cells"].index.centroids)
    e.execute("delete from v where i = 0")
    assert [r.i for r in e.sql("select i from v order by e <EUC> [0, 0] limit 1").collect()] == [1] and e.used == ["cells"]


def test_cells_with_filters_joins_and_exactly(spark):
    """Rings of cells give what brute force gives, and read few cells where rows are in clusters."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.repeat(rng.uniform(-50, 50, (20, 4)), 30, 0) + rng.standard_normal((600, 4)) / 10
    x[40] = x[41]  # a tie
    rows = [(i, i % 7, [float(f) for f in v.astype("float32")]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i bigint, g int, e array<float>")
    names = spark.createDataFrame([(3, "three"), (5, "five"), (5, "cinq")], "k int, name string")
    e, plain, sure = Engine(spark, tie="i"), Engine(spark, tie="i"), Engine(spark, tie="i", exact=True)
    for s in (e, plain, sure):
        s.register("v", df)
        s.register("names", names)
    for s in (e, sure):
        s.execute("create index cells on v (e) using ivf")
    for q in (x[40], x[599], np.zeros(4)):
        near = f"order by e <EUC> {[float(f) for f in q]} limit 9"
        for where in ("where g = 3", "where g > 100", "where i < 5", "where i = 41"):
            text = f"select i from v {where} {near}"
            assert e.sql(text).collect() == plain.sql(text).collect() and e.used == ["cells"]
        text = f"select i, name from v, names where g = k and i > 9 {near}"
        assert sorted(e.sql(text).collect()) == sorted(plain.sql(text).collect()) and e.used == ["cells"]
        text = f"select i from v {near}"
        assert sure.sql(text).collect() == plain.sql(text).collect()
        if q[0]:
            assert sure.cells_read[0] < sure.cells_read[1] / 4


def test_closure():
    p = Predicate((Term(Name("a"), "=", Name("b")), Term(Name("b"), "=", Name("c")), Term(Constant(5), ">", Name("a"))))
    assert {t for t in p.closed().terms if t not in p.terms} == {Term(Name("b"), "<", Constant(5)), Term(Name("c"), "<", Constant(5))}


def test_client(engine):
    with client.connect(engine, autocommit=False) as c:
        cur = c.cursor().execute("select i, s from a where s = ?", ("x",))
        assert [d[:2] for d in cur.description] == [("i", "int"), ("s", "varchar")]
        assert cur.fetchone() == (1, "x") and cur.fetchone() is None
        cur.before_first()
        assert cur.fetchmany(5) == [(1, "x")]
        assert cur.execute("update a set s = ? where i = ?", ("?'", 2)).rowcount == 1
        c.rollback()
        assert cur.execute("select s from a where i = 2").fetchall() == [("y",)]
    with pytest.raises(BadSemantics):
        c.cursor()
    with pytest.raises(BadSemantics):
        client.connect(engine).cursor().execute("select i from a where i = ?")


def test_console(engine):
    out = []
    wrong = console.run(engine, ["select i", "from a where i = 1;", "select nothing from a;", "delete from a where i = 2", "", "exit", "select i from a"], out.append)
    assert wrong == 1 and out[:2] == ["i", "1"] and out[2].startswith("error") and out[3] == "1 rows" and len(out) == 4


def test_folder_commits_once(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "f"))
    f.commit("x", "1")
    with pytest.raises(Conflict):
        f.commit("x", "2")
    assert f.read("x") == "1"
