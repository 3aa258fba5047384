"""Views and indexes that outlive a session, and joins by hash indexes."""

import pytest

from tessera.errors import BadSemantics, Conflict
from tessera.operators import layouts
from tessera.plans.catalog import Folder
from tessera.plans.engine import Engine


@pytest.fixture
def engine(spark):
    e = Engine(spark, tie="i")
    e.execute("create table t (i int, k int, s varchar(9))")
    e.insert("t", spark.createDataFrame([(i, i % 50, str(i % 3)) for i in range(500)], "i int, k int, s string"))
    e.execute("create table u (j int, n int)")
    e.insert("u", spark.createDataFrame([(j, j * 10) for j in range(60)], "j int, n int"))
    return e


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def shuffled(spark):
    """Without broadcasts, so that a side without buckets must be shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_views_outlive_the_session(spark, engine):
    engine.execute("create view few as select i, s from t where i < 5")
    engine.execute("create view fewer as select i from few where s = '1'")
    other = Engine(spark, engine.catalog.root)
    assert rows(other.table("fewer")) == [(1,), (4,)]
    assert rows(other.sql("select viewname, viewdef from viewcat")) == [("few", "select i, s from t where i < 5"), ("fewer", "select i from few where s = '1'")]
    for wrong in ("create view few as select i from t", "create table few (a int)"):
        with pytest.raises(BadSemantics):
            other.execute(wrong)
    other.execute("drop view fewer")
    with pytest.raises(BadSemantics):
        engine.table("fewer")
    engine.execute("drop table t")
    assert not other.catalog.views and not engine.catalog.views


@pytest.mark.parametrize("kind", ["btree", "hash"])
def test_indexes_outlive_the_session(spark, engine, kind):
    engine.execute(f"create index ix on t (k) using {kind}")
    other, text = Engine(spark, engine.catalog.root), "select i from t where k = 7"
    want = [(i,) for i in range(7, 500, 50)]
    assert rows(other.sql(text)) == want and other.used == ["ix"]
    # an insert of one session grows the index for both
    other.execute("insert into t (i, k, s) values (1000, 7, 'x')")
    for e in (other, engine):
        assert rows(e.sql(text)) == [*want, (1000,)] and e.used == ["ix"]
    engine.execute("insert into t (i, k, s) values (1001, 7, 'x')")
    assert rows(other.sql(text)) == [*want, (1000,), (1001,)] and other.used == ["ix"]
    # so do deletes, updates and transactions
    engine.execute("delete from t where i > 999")
    assert rows(other.sql(text)) == want and other.used == ["ix"]
    other.execute("update t set k = 7 where i = 8")
    for e in (other, engine):
        assert rows(e.sql(text)) == sorted([*want, (8,)]) and e.used == ["ix"] and len(rows(e.sql("select i from t where k = 8"))) == 9
    with engine.transaction():
        engine.execute("delete from t where k = 7")
        assert rows(engine.sql(text)) == [] and engine.used == []
    assert rows(other.sql(text)) == [] and other.used == ["ix"]
    with pytest.raises(ZeroDivisionError), engine.transaction():
        engine.execute("delete from t")
        1 / 0
    other.refresh_index("ix")
    want = [(i,) for i in range(9, 500, 50)]
    text = "select i from t where k = 9"
    assert rows(engine.sql(text)) == want and engine.used == ["ix"]
    engine.execute("drop index ix")
    assert rows(other.sql(text)) == want and other.used == [] and not other.catalog.indexes
    assert Folder(spark, engine.catalog.root).names("_indexes") == []


def test_cells_outlive_the_session(spark):
    e = Engine(spark, tie="i")
    e.execute("create table v (i long, e vector(2))")
    e.insert("v", spark.createDataFrame([(i, [float(i % 20), float(i // 20)]) for i in range(400)], "i bigint, e array<float>"))
    e.execute("create index cells on v (e) using ivf")
    other = Engine(spark, e.catalog.root, tie="i")
    text = "select i from v order by e <EUC> [0, 0] limit 3"
    assert [r.i for r in other.sql(text).collect()] == [0, 1, 20] and other.used == ["cells"]
    assert (other.built["cells"].index.centroids == e.built["cells"].index.centroids).all()
    other.execute("insert into v (i, e) values (1000, [0, 0])")
    assert [r.i for r in e.sql(text).collect()] == [0, 1000, 1] and e.used == ["cells"]
    filtered = "select i from v where i > 20 order by e <EUC> [0, 0] limit 2"
    assert [r.i for r in e.sql(filtered).collect()] == [1000, 21] and e.used == ["cells"]


def test_lost_and_rival_writers_of_an_index(spark, engine):
    """Rows without a state are not read; the second of two states is a conflict; recovery removes what no state names."""
    engine.execute("create index ix on t (k) using btree")
    index = engine.catalog.indexes["ix"]
    engine.built["ix"].append(spark.createDataFrame([(-1, 7, "lost")], "i int, k int, s string"))  # and the session is lost
    other = Engine(spark, engine.catalog.root)
    assert (-1,) not in rows(other.sql("select i from t where k = 7")) and other.used == ["ix"]
    other.refresh_index("ix")
    with pytest.raises(Conflict):
        engine.catalog.publish("ix", index, engine.built["ix"].state())
    assert len(other.catalog.recover()) == 1  # the first build's folder
    assert len(rows(other.sql("select i from t where k = 7"))) == 10 and other.used == ["ix"]


def test_an_old_reader_sees_no_later_rows(spark, engine):
    engine.execute("create index ix on t (k) using hash")
    reader = Engine(spark, engine.catalog.root)
    with reader.transaction("repeatable read"):
        before = rows(reader.sql("select i from t where k = 7"))
        engine.execute("insert into t (i, k, s) values (1000, 7, 'x')")
        assert rows(reader.sql("select i from t where k = 7")) == before
    assert len(rows(reader.sql("select i from t where k = 7"))) == len(before) + 1


def test_indexes_of_external_tables_are_the_sessions_own(spark, engine):
    engine.register("x", spark.range(10).toDF("a"))
    engine.execute("create index ix on x (a) using hash")
    assert rows(engine.sql("select a from x where a = 3")) == [(3,)] and engine.used == ["ix"]
    assert not Engine(spark, engine.catalog.root).catalog.indexes


def test_join_by_index_shuffles_the_other_side_only(spark, engine, shuffled):
    text = "select i, n from t, u where k = j"
    want = rows(engine.sql(text))
    assert exchanges(engine.sql(text)) == 2 and engine.used == []
    engine.execute("create index ix on t (k) using hash")
    df = engine.sql(text)
    assert engine.used == ["ix"] and rows(df) == want and exchanges(df) == 1
    engine.execute("create index ux on u (j) using hash")
    df = engine.sql(text)
    assert sorted(engine.used) == ["ix", "ux"] and rows(df) == want and exchanges(df) == 0
    # another session, after an insert by the first
    engine.execute("insert into t (i, k, s) values (1000, 7, 'x')")
    other = Engine(spark, engine.catalog.root)
    df = other.sql(text)
    assert rows(df) == sorted([*want, (1000, 70)]) and exchanges(df) == 0


def test_join_by_index_reads_the_buckets_it_needs(spark, engine):
    text = "select i, n from t, u where k = j and n < 30"
    want = rows(engine.sql(text))
    engine.execute("create index ix on t (k) using hash")
    assert rows(engine.sql(text)) == want and engine.used == ["ix"] and engine.buckets_read["ix"][0] <= 3
    assert rows(engine.sql("select i, n from t, u where k = j and n < 0")) == [] and engine.buckets_read["ix"][0] == 0
    # by both columns of an index, with a null among the keys
    engine.execute("create table w (a int, b varchar(9))")
    engine.insert("w", spark.createDataFrame([(1, "1"), (1, "0"), (None, "1"), (99, "2")], "a int, b string"))
    text = "select i, a, b from t, w where a = k and b = s"
    want = rows(engine.sql(text))
    engine.execute("create index both on t (s, k) using hash")
    assert rows(engine.sql(text)) == want and engine.used == ["both"] and len(want) > 0
    # keys of another type have another hash
    engine.execute("create table l (a long)")
    engine.insert("l", spark.createDataFrame([(7,)], "a bigint"))
    assert len(rows(engine.sql("select i from t, l where a = k"))) == 10 and engine.used == []


def test_hot_buckets_are_left_to_adaptive_execution(spark, engine, shuffled, monkeypatch):
    monkeypatch.setattr(layouts, "BUCKET_ROWS", 20)
    engine.insert("t", spark.createDataFrame([(2000 + i, 7, "x") for i in range(300)], "i int, k int, s string"))
    text = "select i, n from t, u where k = j"
    want = rows(engine.sql(text))
    engine.execute("create index ix on t (k) using hash")
    df = engine.sql(text)
    assert engine.used == ["ix"] and rows(df) == want and exchanges(df) == 2


def test_an_index_catches_up_with_lost_sessions_and_is_built_anew(spark, engine, monkeypatch):
    engine.execute("create index ix on t (k) using hash")
    lost = Engine(spark, engine.catalog.root)
    monkeypatch.setattr(lost, "follow", lambda table: None)  # lost after its commits
    lost.execute("delete from t where i < 250")
    lost.execute("insert into t (i, k, s) values (1000, 7, 'x')")
    want = [(i,) for i in (*range(257, 500, 50), 1000)]
    text = "select i from t where k = 7"
    assert rows(engine.sql(text)) == want and engine.used == []
    engine.follow("t")
    assert rows(engine.sql(text)) == want and engine.used == ["ix"] and engine.built["ix"].dead
    monkeypatch.setattr("tessera.plans.engine.MOST_DEAD", 0)
    engine.execute("delete from t where i = 1000")
    assert rows(engine.sql(text)) == want[:-1] and engine.used == ["ix"] and not engine.built["ix"].dead


@pytest.mark.parametrize("kind", ["btree", "hash", "ivf"])
def test_an_index_of_no_rows(spark, kind):
    e = Engine(spark, tie="i")
    e.execute("create table v (i long, e vector(2))")
    e.execute(f"create index ix on v ({'e' if kind == 'ivf' else 'i'}) using {kind}")
    ask = "select i from v order by e <EUC> [0, 0] limit 3" if kind == "ivf" else "select i from v where i = 3"
    assert e.sql(ask).collect() == []
    e.insert("v", spark.createDataFrame([(3, [1.0, 2.0])], "i bigint, e array<float>"))
    assert rows(e.sql(ask)) == [(3,)] and e.used == ["ix"]
    e.execute("delete from v where i = 3")
    assert rows(e.sql(ask)) == []
