"""The engine on small tables: values, sources, results, statistics, the command line."""

import math

import pyarrow as pa
import pytest

from tesseral.__main__ import main
from tesseral.engine import Engine
from tesseral.errors import QueryError
from tesseral.functions.registry import register_functions, register_vectorized
from tesseral.operators import fixed
from tesseral.operators.results import SharedResult, to_arrow, to_floats
from tesseral.sources.files import write_arrow
from tesseral.plans.stats import ColumnStats, classify_filter, column_stats
from tesseral.streaming.incremental import csv_stream, run_available


@pytest.fixture(scope="module")
def engine(spark, samples):
    return Engine(spark, str(samples / "test.csv"))


@pytest.mark.parametrize("query,expected", [
    ("price * quantity", [31.5, 80, 30.5, 150]),
    ("price * quantity WHERE price > 10", [31.5, 80, 30.5, 150]),
    ("price WHERE price > 15", [20, 15.25, 30]),
    ("price * 0.9 WHERE price > 20", [27]),
    ("price * quantity * 1.08", [34.02, 86.4, 32.94, 162]),
    ("discount(price, 0.9)", [9.45, 18, 13.725, 27]),
    ("price + 1", [11.5, 21, 16.25, 31]),
    ("price + quantity * 2", [16.5, 28, 19.25, 40]),
    ("(price + quantity) * 2", [27, 48, 34.5, 70]),
    ("price WHERE price > 10 AND quantity < 5", [10.5, 20, 15.25]),
    ("price WHERE price > 10 OR quantity < 5", [10.5, 20, 15.25, 30]),
    ("price > 15", [0, 1, 1, 1]),
    ("(price > 15) + 1", [1, 2, 2, 2]),
    ("price WHERE quantity - 3", [20, 15.25, 30]),
    ("price / (quantity - 3)", [math.inf, 20, -15.25, 15]),
    ("sqrtf(quantity * quantity)", [3, 4, 2, 5]),
    ("-price WHERE (quantity < 3)", [-15.25]),
])
def test_expression_queries(engine, query, expected):
    assert to_floats(engine.query(query)) == pytest.approx(expected, rel=1e-6)


@pytest.mark.parametrize("sql,expected", [
    ("SELECT SUM(price) FROM test GROUP BY quantity ORDER BY quantity ASC", [15.25, 10.5, 20, 30]),
    ("SELECT price FROM test ORDER BY price DESC LIMIT 2", [30, 20]),
    ("SELECT price FROM test ORDER BY price DESC LIMIT 5", [30, 20, 15.25, 10.5]),
    ("SELECT price FROM test ORDER BY price DESC OFFSET 1 LIMIT 2", [20, 15.25]),
    ("SELECT price FROM test ORDER BY price DESC LIMIT 2 OFFSET 1", [20, 15.25]),
    ("SELECT price FROM test OFFSET 9", []),
    ("SELECT price FROM test ORDER BY price LIMIT 1", [10.5]),
    ("SELECT SUM(price) FROM test GROUP BY quantity HAVING SUM(price) > 15 ORDER BY quantity ASC", [15.25, 20, 30]),
    ("SELECT SUM(price) FROM test GROUP BY quantity HAVING COUNT(price) > 1", []),
    ("SELECT DISTINCT quantity FROM test ORDER BY quantity DESC", [5, 4, 3, 2]),
    ("SELECT SUM(price) FROM test", [75.75]),
    ("SELECT AVG(price) FROM test", [18.9375]),
    ("SELECT COUNT(price) FROM test", [4]),
    ("SELECT MAX(price) - MIN(price) FROM test WHERE quantity > 2", [19.5]),
    ("select SUM(quantity) OVER () from test limit 1", [14]),
])
def test_statements(engine, sql, expected):
    got = [r[0] for r in engine.query_sql(sql).collect()]
    assert got == pytest.approx(expected)


def test_unordered_group_sum(engine):
    assert sorted(r[0] for r in engine.query_sql("SELECT SUM(price) FROM test GROUP BY quantity LIMIT 9").collect()) == [10.5, 15.25, 20, 30]


def test_several_items_and_names(engine):
    df = engine.query_sql("SELECT test.price, quantity AS q, price > 15 FROM test ORDER BY q")
    assert df.columns == ["price", "q", "price > 15"]
    assert df.first() == (15.25, 2, 1.0)


def test_join_over_registered_tables(engine, spark):
    engine.register_table("sales", spark.createDataFrame([(1, 10.0, 2), (2, 20.0, 3), (2, 5.0, 3)], "id int, price double, quantity int"))
    engine.register_table("items", spark.createDataFrame([(1, 7), (2, 9), (3, 8)], "id int, rank int"))
    df = engine.query_sql("SELECT SUM(price) AS s, quantity FROM sales JOIN items ON sales.id = items.id WHERE rank > 7 GROUP BY quantity ORDER BY quantity DESC LIMIT 5")
    assert [tuple(r) for r in df.collect()] == [(25.0, 3)]
    assert engine.query_sql("SELECT sales.id, items.id AS other FROM sales JOIN items ON sales.id < items.id").count() == 4


def test_mask_keeps_places(engine):
    assert [r[0] for r in engine.query("price WHERE price > 15", mask=True).collect()] == [None, 20, 15.25, 30]


@pytest.mark.parametrize("query,message", [
    ("foo + 1", "Unknown column: foo"),
    ("price WHERE foo > 1", "Failed to parse WHERE clause: Unknown column: foo"),
    ("", "Empty query expression"),
])
def test_bad_expressions(engine, query, message):
    with pytest.raises(QueryError, match=message):
        engine.query(query)


@pytest.mark.parametrize("sql,message", [
    ("SELECT foo FROM test", "SELECT clause: Unknown column: foo"),
    ("SELECT price FROM test WHERE foo > 1", "WHERE clause: Unknown column: foo"),
    ("SELECT SUM(price) FROM test GROUP BY foo", "GROUP BY: Unknown column: foo"),
    ("SELECT price FROM test ORDER BY foo", "ORDER BY: Unknown column: foo"),
    ("SELECT SUM(price) FROM test HAVING SUM(foo) > 1", "HAVING: Unknown column: foo"),
    ("SELECT price FROM nowhere", "Unknown table: nowhere"),
    ("SELECT price", "Failed to parse SQL: .*line 1 column"),
])
def test_bad_statements(engine, sql, message):
    with pytest.raises(QueryError, match=message):
        engine.query_sql(sql)


def test_engine_works_after_an_error(engine):
    with pytest.raises(QueryError):
        engine.query("price +")
    assert engine.query("price").count() == 4


def test_typed_csv(spark, samples):
    e = Engine(spark, str(samples / "extended.csv"), ["float32", "int32", "float32"])
    assert [f.dataType.simpleString() for f in e.df.schema] == ["float", "int", "float"]
    assert to_floats(e.query("price * discount")) == pytest.approx([1.05, 4, 0.7625, 4.5], rel=1e-5)


def test_csv_faults(spark, samples, tmp_path):
    with pytest.raises(QueryError, match="Schema size does not match column count"):
        Engine(spark, str(samples / "test.csv"), ["float32"] * 3)
    with pytest.raises(QueryError, match="Unable to open file"):
        Engine(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(QueryError, match="Empty CSV file"):
        Engine(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "bad.csv").write_text("price,quantity\n1.5,x\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        Engine(spark, str(tmp_path / "bad.csv")).query("quantity").collect()
    with pytest.raises(QueryError, match="Unsupported file format"):
        Engine(spark, "x.avro")


def test_other_formats(spark, samples, tmp_path):
    e = Engine(spark, str(samples / "test.json"))
    assert sorted(to_floats(e.query("price * quantity"))) == pytest.approx([30.5, 31.5, 80, 150])
    table = e.df.orderBy("price").toArrow()
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), table.schema) as f:
        f.write_table(table, max_chunksize=2)
    e.df.write.parquet(str(tmp_path / "t.PARQUET"))
    e.df.write.orc(str(tmp_path / "t.orc"))
    for name in ("t.arrow", "t.PARQUET", "t.orc"):
        other = Engine(spark, str(tmp_path / name))
        assert sorted(to_floats(other.query("price * quantity"))) == pytest.approx([30.5, 31.5, 80, 150]), name
    assert Engine(spark, str(tmp_path / "t.arrow")).df.rdd.getNumPartitions() == 2


def test_json_columns_by_name_and_in_file_order(spark, tmp_path):
    (tmp_path / "t.json").write_text('\n{"price": 1.5, "quantity": 2, "name": "b"}\n{"quantity": 3, "name": "a", "price": 2.5}\n{"price": 9}\nnot json\n')
    e = Engine(spark, str(tmp_path / "t.json"), ["float64", "int32", "string"])
    assert sorted(map(tuple, e.df.collect())) == [(1.5, 2, "b"), (2.5, 3, "a")]
    assert [f.dataType.simpleString() for f in e.df.schema] == ["double", "int", "string"]
    assert sorted(map(tuple, Engine(spark, str(tmp_path / "t.json"), "name string, price double").df.collect())) == [("a", 2.5), ("b", 1.5)]
    assert Engine(spark, str(tmp_path / "t.json")).df.columns == ["price", "quantity"]
    (tmp_path / "u.jsonl").write_text('{"x": 1, "a": "s"}\n{"x": 2, "a": "t"}\n')
    assert sorted(map(tuple, Engine(spark, str(tmp_path / "u.jsonl")).df.collect())) == [(1, "s"), (2, "t")]
    assert sorted(map(tuple, Engine(spark, str(tmp_path / "u.jsonl"), ["int64", "string"]).df.collect())) == [(1, "s"), (2, "t")]
    with pytest.raises(QueryError, match="Schema size does not match column count"):
        Engine(spark, str(tmp_path / "u.jsonl"), ["int64"])
    with pytest.raises(QueryError, match="No line of .* has the columns price, quantity"):
        Engine(spark, str(tmp_path / "u.jsonl"), "price double, quantity int")
    (tmp_path / "e.json").write_text("")
    assert Engine(spark, str(tmp_path / "e.json")).df.count() == 0
    with pytest.raises(QueryError, match="Unable to open file"):
        Engine(spark, str(tmp_path / "none.json"))


def test_csv_headers(spark, tmp_path):
    (tmp_path / "my-file.csv").write_text('"price", quantity\n1.5, 2\n"2.5",3\n')
    e = Engine(spark, str(tmp_path / "my-file.csv"))
    assert sorted(to_floats(e.query("price * quantity"))) == [3, 7.5]
    assert e.query_sql("SELECT SUM(my_file.price) FROM my_file").first()[0] == 4
    (tmp_path / "my.data.csv").write_text('"a,b",x\n1,2\n')
    e = Engine(spark, str(tmp_path / "my.data.csv"))
    assert e.df.columns == ["a,b", "x"] and e.query_sql("SELECT my.data.x FROM my.data").first()[0] == 2
    (tmp_path / "8.csv").write_text("name,n\n padded ,2\n")
    assert [tuple(r) for r in Engine(spark, str(tmp_path / "8.csv"), ["string", "int32"]).query_sql("SELECT name, n FROM _8").collect()] == [(" padded ", 2)]


def test_two_engines_keep_their_tables_apart(spark, tmp_path):
    for name, price in (("a", 1), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "test.csv").write_text(f"price,quantity\n{price},1\n")
    a, b = (Engine(spark, str(tmp_path / n / "test.csv")) for n in "ab")
    for e, price in ((a, 1), (b, 2)):
        assert e.query("price").first()[0] == e.query_sql("SELECT price FROM test").first()[0] == e.sql("SELECT price FROM test").first()[0] == price
    spark.createDataFrame([(7,)], "price int").createOrReplaceTempView("test")
    assert a.sql("SELECT price FROM test").first()[0] == 1
    assert spark.table("test").first()[0] == 7
    spark.catalog.dropTempView("test")


def test_self_join_and_pairs(engine, spark):
    df = engine.query_sql("SELECT a.price AS x, b.price AS y FROM test AS a JOIN test AS b ON a.quantity + 1 = b.quantity")
    assert sorted(map(tuple, df.collect())) == [(10.5, 20.0), (15.25, 10.5), (20.0, 30.0)]
    with pytest.raises(QueryError, match="JOIN condition: Unknown column: b.foo"):
        engine.query_sql("SELECT a.price FROM test AS a JOIN test AS b ON a.price = b.foo")
    own = Engine(spark)
    own.register_table("big", spark.range(10_000_000))
    own.register_table("small", spark.range(3))
    with pytest.warns(UserWarning, match="all pairs"):
        own.query_sql("SELECT big.id FROM big AS big JOIN big AS other ON big.id < other.id")
    assert own.query_sql("SELECT small.id FROM big JOIN small ON big.id < small.id").count() == 3


def test_aggregates_over_all_rows(engine):
    assert to_floats(engine.query("price / SUM(price) OVER () WHERE quantity > 3")) == pytest.approx([0.4, 0.6])
    assert engine.query("price - MAX(price) OVER () WHERE price > 15", mask=True).collect()[0][0] is None
    df = engine.query_sql("SELECT price, COUNT(*) OVER () AS n, MIN(price) OVER () AS lo FROM test WHERE price > 12 ORDER BY price")
    assert [tuple(r) for r in df.collect()] == [(15.25, 3, 15.25), (20, 3, 15.25), (30, 3, 15.25)]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, engine.query_sql("SELECT quantity, SUM(price), SUM(SUM(price)) OVER () AS t FROM test GROUP BY quantity").collect()))[0] == (2, 15.25, 75.75)


def test_sign_of_a_zero_divisor(spark):
    e = Engine(spark)
    e.register_table("t", spark.createDataFrame([(1.0, 0.0), (1.0, -0.0), (-2.0, -0.0), (0.0, -0.0)], "a double, b double"))
    assert to_floats(e.query("a / b"))[:3] == [math.inf, -math.inf, math.inf]
    assert math.isnan(to_floats(e.query("a / b"))[3])


def test_arrow_files_are_written_and_pruned(spark, engine, tmp_path):
    write_arrow(engine.df.withColumnRenamed("quantity", "n").repartition(2), str(tmp_path / "t.arrow"))
    e = Engine(spark, str(tmp_path / "t.arrow"))
    assert e.df.columns == ["price", "n"] and sorted(to_floats(e.query("price WHERE n > 3"))) == [20, 30]
    assert sorted(r[0] for r in e.query_sql("SELECT n FROM t").collect()) == [2, 3, 4, 5]
    for q in (e.query("n + 1"), e.query_sql("SELECT n FROM t")):
        assert "price" not in q._jdf.queryExecution().executedPlan().toString()
    write_arrow(engine.df.where("price < 0"), str(tmp_path / "none.arrow"))
    assert Engine(spark, str(tmp_path / "none.arrow")).df.collect() == []
    with pytest.raises(Exception, match="(?s)boom|ZeroDivision|DIVIDE"):
        write_arrow(spark.range(4).selectExpr("id", "raise_error('boom') AS x"), str(tmp_path / "bad.arrow"))
    assert not list((tmp_path).glob("bad.arrow/*"))


def test_partitioned_and_chunked(spark, samples):
    e = Engine(spark, str(samples / "test.csv"))
    assert sorted(to_floats(e.query_partitioned("price * quantity", 3))) == pytest.approx([30.5, 31.5, 80, 150])
    for size in (1, 2, 1000):
        assert to_floats(Engine.query_csv_chunked(spark, str(samples / "test.csv"), "price WHERE price > 15", size)) == [20, 15.25, 30]


def test_stream_reads_new_files_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.csv").write_text("price,quantity\n1,2\n3,4\n")
    for name, rows in (("b", "5,6\n"), ("c", "0,9\n")):
        stream = csv_stream(spark, str(folder), "price * quantity WHERE price > 0", str(folder / "a.csv"))
        run_available(stream, out, state)
        (folder / f"{name}.csv").write_text(f"price,quantity\n{rows}")
    run_available(csv_stream(spark, str(folder), "price * quantity WHERE price > 0", str(folder / "a.csv")), out, state)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [2, 12, 30]


def test_results(engine):
    array = engine.query_arrow("price WHERE quantity > 3")
    assert array.type == pa.float32() and array.to_pylist() == [20, 30]
    assert to_arrow(engine.query("price WHERE price > 99")).to_pylist() == []
    with engine.query_arrow("price", shared_memory=True) as shared:
        assert SharedResult.read(shared.name).column("result").to_pylist() == [10.5, 20, 15.25, 30]
        name = shared.name
    with pytest.raises(FileNotFoundError):
        SharedResult.read(name)


def test_fixed_operators(engine):
    assert [tuple(r) for r in fixed.filter_gt(engine.df, 25).collect()] == [(30.0, 5.0)]
    assert fixed.project_columns(engine.df, price=False, quantity=True).columns == ["quantity"]
    assert [r[0] for r in fixed.revenue(engine.df, 25).collect()] == [150]
    assert [tuple(r) for r in fixed.revenue_and_adjusted(engine.df, 25).collect()] == [(150, 20)]
    assert fixed.peek(engine.df).count() == 4


def test_statistics(engine, spark):
    assert engine.stats()["quantity"] == ColumnStats(2, 5, 0)
    assert engine.query_optimized("price", "quantity >= 2").count() == 4
    assert "LocalTableScan" in engine.query_optimized("price", "quantity > 7")._jdf.queryExecution().executedPlan().toString()
    assert engine.query_optimized("price", "quantity > 3").count() == 2
    with pytest.raises(QueryError):
        engine.query_optimized("price", "foo > 1")
    nulls = column_stats(spark.createDataFrame([(None,), (1.0,), (float("nan"),)], "x double"))
    assert nulls["x"].nulls == 1 and nulls["x"].nans == 1


@pytest.mark.parametrize("cond,verdict", [
    ("x > 0", True), ("x > 1", None), ("x >= 1", True), ("x < 1", False), ("x <= 5", True), ("x = 9", False), ("x != 9", True), ("3 > x", None),
    ("0 < x AND x < 9", True), ("x > 0 AND x > 7", False), ("x > 0 OR x < 0", None), ("n > 0", None), ("n > 9", False), ("e > 1", False), ("y > 1", None),
])
def test_settled_conditions(cond, verdict):
    stats = {"x": ColumnStats(1, 5, 0), "n": ColumnStats(1, 5, 2), "e": ColumnStats(None, None, 3)}
    assert classify_filter(cond, stats) is verdict


def test_user_functions(engine, spark, tmp_path):
    (tmp_path / "f.sql").write_text("-- two\nCREATE OR REPLACE TEMPORARY FUNCTION twice(x DOUBLE) RETURNS DOUBLE RETURN 2 * x;\nCREATE OR REPLACE TEMPORARY FUNCTION less(x DOUBLE) RETURNS DOUBLE RETURN x - 1;\n")
    register_functions(spark, str(tmp_path / "f.sql"))
    assert to_floats(engine.query("twice(less(price))")) == [19, 38, 28.5, 58]
    assert engine.query_sql("SELECT SUM(twice(price)) FROM test").first()[0] == 151.5
    (tmp_path / "g.sql").write_text("DROP TABLE x")
    with pytest.raises(ValueError):
        register_functions(spark, str(tmp_path / "g.sql"))
    register_vectorized(spark, "half", lambda s: s / 2)
    assert to_floats(engine.query("half(price)")) == [5.25, 10, 7.625, 15]


def test_plans(engine, spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    own = Engine(spark)
    own.register_table("lineitem", df)
    plan = lambda q: q._jdf.queryExecution().executedPlan().toString()
    one = plan(own.query("l_extendedprice * 0.9 WHERE l_extendedprice > 20000"))
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice" in one and "ReadSchema: struct<l_extendedprice:double>" in one
    assert "TakeOrderedAndProject" in plan(own.query_sql("SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice DESC LIMIT 5"))
    assert "discount" not in plan(own.query("discount(l_extendedprice, 0.9)"))


def test_command_line(spark, samples, capsys, monkeypatch):
    assert main(["price * 2 WHERE price > 25", str(samples / "test.csv")]) == 0
    assert "60.0" in capsys.readouterr().out
    assert main(["SELECT MAX(price) FROM test", str(samples / "test.csv")]) == 0
    assert main(["foo", str(samples / "test.csv")]) == 1
    assert main([]) == 2
    assert main(["SELECT SUM(a.price) AS s FROM test AS a JOIN more AS b ON a.price = b.price", str(samples / "test.csv"), "--table", f"more={samples / 'extended.csv'}"]) == 0
    assert "75.75" in capsys.readouterr().out
    for extra in (["--partitions", "3"], ["--rows-per-chunk", "2"], ["--schema", "float32,int32"]):
        assert main(["SUM(price) OVER ()", str(samples / "test.csv"), *extra]) == 0
        assert "75.75" in capsys.readouterr().out
