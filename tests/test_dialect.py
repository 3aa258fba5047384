import pytest

from tessera.errors import BadSemantics, BadSyntax
from tessera.operators.predicates import Constant, Name, Predicate, Range, Term
from tessera.plans.engine import Engine
from tessera.plans.parser import Aggregate, Near, Select, parse


def test_parse_select():
    q = parse("SELECT a, count(b), COUNT(distinct c) FROM t, s WHERE a = 3 and 'x''y' < d GROUP BY a ORDER BY a desc, count(b) LIMIT 5")
    assert isinstance(q, Select) and q.columns == ("a", Aggregate("count", "b"), Aggregate("count_distinct", "c"))
    assert q.tables == ("t", "s") and q.group == ("a",) and q.limit == 5
    assert q.where.terms[1] == Term(Constant("x'y"), "<", Name("d"))
    assert [s.ascending for s in q.order] == [False, True]


def test_parse_near():
    q = parse("select i from v order by e <EUC> [1, -2.5, 1.0E-4] limit 2")
    assert q.order[0].by == Near("e", "euclidean", (1.0, -2.5, 1e-4))


@pytest.mark.parametrize("text", ["select", "select a from", "select a from t where", "select a from t limit 5 5", "select a from t order by e <EUC> [1] desc limit 2", "select sum(distinct a) from t", "select a from t where a ! 3", "insert into t (a) values", "update t set a = b +", "drop a", "select a from t where a = 'x"])
def test_bad_syntax(text):
    with pytest.raises(BadSyntax):
        parse(text)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, tie="id")
    e.register("t", spark.createDataFrame([(1, 1.5, "a"), (2, 2.5, "b"), (3, 2.5, "b")], "id int, d double, s string"))
    e.register("u", spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "k int, v int"))
    e.register("v", spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "id int, e array<float>"))
    return e


@pytest.mark.parametrize("text", [
    "select x from t", "select id from nowhere", "select id from t where s = 3", "select id from t where x = 3", "select id, count(s) from t", "select sum(s) from t", "select id from v order by e", "select id from t order by s <EUC> [1] limit 1",
    "select id from v where e < [1, 2]", "select s from t order by count(id)", "select id from t, v",
])
def test_bad_semantics(engine, text):
    with pytest.raises(BadSemantics):
        engine.sql(text)


def test_joins_and_groups(engine):
    assert sorted(map(tuple, engine.sql("select id, v from t, u where id = k").collect())) == [(1, 10), (2, 20), (2, 21)]
    assert engine.sql("select id, v from t, u where id < k").count() == 2
    assert engine.sql("select id, v from t, u").count() == 9
    assert sorted(map(tuple, engine.sql("select s, count(id), avg(d) from t group by s").collect())) == [("a", 1, 1.5), ("b", 2, 2.5)]
    assert engine.sql("select count(id) from t where id > 9").collect() == [(0,)]
    assert Engine(engine.spark, strict_empty=True).catalog is not None


def test_strict_flags(spark, engine):
    e = Engine(spark, strict_empty=True, reference_order=True)
    e.register("t", engine.table("t"))
    assert e.sql("select count(id) from t where id > 9").collect() == []
    assert e.sql("select s, id, s from t").columns == ["id", "s"]


def test_near_ties_and_zero(engine):
    assert [r.id for r in engine.sql("select id from v order by e <EUC> [1, 0] limit 3").collect()] == [2, 3, 4]
    assert [r.id for r in engine.sql("select id from v order by e <COS> [1, 0] limit 4").collect()] == [2, 3, 1, 4]
    assert [r.id for r in engine.sql("select id from v where e = [1, 0]").collect()] == [2, 3]


def test_explain(engine):
    plan = engine.sql("explain select id from t where id > 1").first().query_plan
    assert "rows: 2" in plan and "Filter" in plan


def test_changes(spark):
    e = Engine(spark)
    e.execute("create table t (a int, b varchar(3), c double, w vector(2))")
    assert e.execute("insert into t (a, c, w, b) values (3.7, 1, [1, 2], 'x')") == 1
    e.execute("insert into t (a, c, w, b) values (99999999999, 2, [3, 4], 'y')")
    assert sorted(r.a for r in e.table("t").collect()) == [3, 2147483647]
    assert e.execute("update t set a = add(a, 1), c = mul(c, a), b = add(b, 'z') where a > 5") == 1
    rows = {r.b: r for r in e.table("t").collect()}
    assert rows["yz"].a == -2147483648 and rows["yz"].c == 2.0 * 2147483647
    assert e.execute("update t set w = div(w, 2) where b = 'x'") == 1
    assert [list(r.w) for r in e.sql("select w from t where b = 'x'").collect()] == [[0.5, 1.0]]
    assert e.execute("delete from t where b = 'nothing'") == 0
    assert e.execute("delete from t where a = 3") == 1
    assert e.table("t").count() == 1 and e.catalog.read("t", 2).count() == 2
    with pytest.raises(Exception, match="over 3 characters"):
        e.execute("insert into t (a, c, w, b) values (1, 1, [1, 2], 'long')")
    with pytest.raises(Exception, match="dimension"):
        e.execute("insert into t (a, c, w, b) values (1, 1, [1, 2, 3], 'x')")
    for bad in ("insert into t (a) values (1)", "update t set q = 1", "update t set a = 'x'", "create table t (a int)", "drop table q", "create index i on t (q)", "create index i on t (a) using ivf"):
        with pytest.raises(BadSemantics):
            e.execute(bad)


def test_division(spark):
    e = Engine(spark)
    e.execute("create table n (a int, l long, d double)")
    e.insert("n", spark.createDataFrame([(-7, -(1 << 63), 1.0)], "a int, l long, d double"))
    e.execute("update n set a = div(a, 2), l = div(l, -1), d = div(d, 0)")
    assert e.table("n").first() == (-3, -(1 << 63), float("inf"))
    e.execute("update n set l = add(l, -1)")
    assert e.table("n").first().l == (1 << 63) - 1
    with pytest.raises(Exception, match="division by zero"):
        e.execute("update n set a = div(a, 0)")


def test_views_and_cascade(spark):
    e = Engine(spark)
    e.execute("create table t (a int)")
    e.execute("insert into t (a) values (1)")
    e.execute("create view v as select a from t where a > 0 order by a limit 3")
    e.execute("create view w as select a from v")
    e.execute("create index i on t (a) using hash")
    assert e.sql("select a from w where a = 1").count() == 1
    assert [r.tblname for r in e.sql("select tblname from tblcat").collect()] == ["t"]
    e.execute("drop table t")
    assert not e.catalog.views and not e.catalog.indexes
    with pytest.raises(BadSemantics):
        Engine(spark, read_only=True).execute("create table t (a int)")


def test_conflict(spark):
    from tessera.errors import Conflict

    e = Engine(spark)
    e.execute("create table t (a int)")
    with pytest.raises(Conflict):
        e.catalog.commit("t", e.catalog.schema("t"), [], -1)


def test_ranges():
    p = Predicate((Term(Name("a"), ">", Constant(3)), Term(Constant(9), ">=", Name("a")), Term(Name("a"), "=", Name("b")), Term(Name("b"), "=", Name("c"))))
    assert p.range_of("a") == Range(3, 9, True, False)
    assert Predicate((Term(Name("a"), ">", Constant(3)), Term(Name("a"), "<", Constant(2)))).range_of("a") is None
    assert p.equated("a") == {"b", "c"}
    assert Range(1, 5).overlaps(Range(5, 6)) and not Range(1, 5, high_open=True).overlaps(Range(5, 6))
    assert Range("a", "c").contains("b") and Range(1, 2).union(Range(5, 6)) == Range(1, 6)
