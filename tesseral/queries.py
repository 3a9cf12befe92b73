"""The registered queries over the engine's own operators, and their SQL."""

from __future__ import annotations

import atexit
import contextlib
import io
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .__main__ import main
from .engine import Engine
from .errors import QueryError
from .operators import fixed
from .operators.results import SharedResult
from .plans.stats import classify_filter, stats_frame
from .plans.tokens import tokenize
from .sources.files import open_table, read_json, write_arrow
from .streaming.incremental import csv_stream, run_available

KEYS = ["l_orderkey", "l_linenumber"]
Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine over Parquet tables of a folder; the first is the one that expression queries read."""
    out = Engine(spark)
    for name in tables:
        out.register_table(name, f"{sf_dir}/{name}.parquet")
    return out


def sql(text: str, *tables: str) -> Query:
    """A statement of the dialect."""
    return lambda spark, sf_dir: engine(spark, sf_dir, *(tables or ("lineitem",))).query_sql(text)


def keyed(expr: str, mask: bool = False) -> Query:
    """The engine's expression query with the keys beside its result."""
    return lambda spark, sf_dir: engine(spark, sf_dir, "lineitem").query(expr, mask, KEYS)


def summed(text: str) -> Query:
    """The engine's expression query in its own form, as an exact digest of all its rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(engine(spark, sf_dir, "lineitem").query(text))

    return run


def digest(df: DataFrame) -> DataFrame:
    return df.agg(F.count("result").alias("n"), F.sum(F.col("result").cast("decimal(28,6)")).cast("double").alias("total"), F.min("result").alias("lo"), F.max("result").alias("hi"))


_scratch: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tesseral-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="tesseral-"))
        atexit.register(shutil.rmtree, _scratch[0], ignore_errors=True)
    return f"file://{tempfile.mkdtemp(dir=_scratch[0])}"


PRICED = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]


def round_trip(kind: str) -> Query:
    """The price and quantity columns written as a format and read by the engine's own reader of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PRICED)
        path = f"{scratch(spark)}/t.{kind}"
        if kind == "csv":
            rows.repartition(4).write.csv(path, header=True)
            return open_table(spark, path, ["int64", "int32", "float64", "float64"])
        if kind == "json":
            rows.write.json(path)
            return read_json(spark, path, ["int64", "int32", "float64", "float64"])
        if kind == "arrow":
            write_arrow(rows, path)
            return open_table(spark, path)
        getattr(rows.write, kind)(path)
        return open_table(spark, path)

    return run


def csv_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression over CSV files that are read one after the other by a file stream."""
    folder = scratch(spark)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PRICED).repartition(3).write.csv(f"{folder}/in", header=True)
    kinds = ["int64", "int32", "float64", "float64"]
    run_available(csv_stream(spark, f"{folder}/in", "l_extendedprice * l_quantity WHERE l_quantity > 10", f"{folder}/in", kinds), f"{folder}/out", f"{folder}/state")
    return digest(spark.read.parquet(f"{folder}/out"))


def csv_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PRICED).repartition(3).write.csv(f"{folder}/t.csv", header=True)
    return digest(Engine.query_csv_chunked(spark, f"{folder}/t.csv", "l_extendedprice * l_quantity WHERE l_quantity > 10", 1000, ["int64", "int32", "float64", "float64"]))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(engine(spark, sf_dir, "lineitem").query_partitioned("l_extendedprice * l_quantity WHERE l_discount < 0.05", 8))


def fixed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = fixed.filter_gt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 50000, "l_extendedprice", "l_quantity")
    return fixed.project_columns(met, l_extendedprice=True, l_quantity=True)


def fixed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.revenue_and_adjusted(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 50000, 10.0, "l_extendedprice", "l_quantity", tuple(KEYS))


def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_frame(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_extendedprice"]).select(F.col("lo_l_extendedprice").alias("lo"), F.col("hi_l_extendedprice").alias("hi"), F.col("nulls_l_extendedprice").alias("nulls"))


def settled_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass two conditions that statistics settle and one that they don't."""
    own = engine(spark, sf_dir, "lineitem")
    parts = [("all", "l_quantity >= 0"), ("none", "l_quantity > 1000"), ("some", "l_quantity > 25")]
    each = [own.query_optimized("l_quantity", cond).agg(F.lit(name).alias("kind"), F.lit(str(classify_filter(cond, own.stats()))).alias("verdict"), F.count(F.lit(1)).alias("n")) for name, cond in parts]
    return reduce(DataFrame.unionByName, each)


def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark SQL beyond the dialect, over the engine's own tables."""
    return engine(spark, sf_dir, "nation", "region").sql("WITH r AS (SELECT r_regionkey, upper(r_name) AS name FROM region) SELECT name, count(*) AS n FROM nation JOIN r ON n_regionkey = r_regionkey GROUP BY name")


def token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, t.kind, t.text, t.line, t.column) for k, t in enumerate(tokenize(TOKENS))], "k int, kind string, token string, line int, col int")


TOKENS = "select price,\n sum(quantity) >= 1.5"

#: Statements and expressions that are refused, and what the error says.
REFUSED = [
    ("price & 5", "Unknown character '&' at line 1 column 7"),
    ("price + * 2", "Unexpected token (Operator: *)"),
    ("(price + 5", "Expected ')'"),
    ("sqrt(price", "Expected ')' after arguments"),
    ("1 2", "Unexpected tokens remaining: 2"),
    ("", "Empty query expression"),
    ("foo + 1", "Unknown column: foo"),
    ("price +", "Failed to parse expression: "),
    ("price WHERE price >", "Failed to parse WHERE clause: "),
    ("price WHERE foo > 1", "Failed to parse WHERE clause: Unknown column: foo"),
    ("SELECT price", "Expected keyword 'FROM' at line 1 column 13"),
    ("SELECT price FROM", "Expected table name after FROM at line 1 column 18"),
    ("SELECT price FROM test JOIN ON price", "Expected table name after JOIN at line 1 column 29"),
    ("SELECT price FROM test LIMIT x", "Expected numeric value after LIMIT at line 1 column 30"),
    ("SELECT price FROM test OFFSET x", "Expected numeric value after OFFSET"),
    ("SELECT price FROM test EXTRA", "Unexpected token in query near: EXTRA"),
    ("SELECT SUM price FROM test", "Invalid syntax for SUM aggregation"),
    ("SELECT price + FROM test", "Failed to parse SQL: "),
    ("SELECT foo FROM test", "SELECT clause: Unknown column: foo"),
    ("SELECT price FROM test JOIN more ON test.price = more.foo", "JOIN condition: Unknown column: more.foo"),
    ("SELECT price FROM test WHERE foo > 1", "WHERE clause: Unknown column: foo"),
    ("SELECT SUM(price) FROM test GROUP BY foo", "GROUP BY: Unknown column: foo"),
    ("SELECT price FROM test ORDER BY foo", "ORDER BY: Unknown column: foo"),
    ("SELECT price FROM test GROUP BY price", "Only aggregation queries supported with GROUP BY"),
    ("SELECT price FROM nowhere", "Unknown table: nowhere"),
    ("open missing.csv", "Unable to open file"),
    ("open table.avro", "Unsupported file format: table.avro"),
]


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of REFUSED raises, cut to the length of what it is to say."""
    own = Engine(spark)
    for name in ("test", "more"):
        own.register_table(name, spark.createDataFrame([(1.0, 2)], "price double, quantity int"))
    rows = []
    for text, says in REFUSED:
        try:
            (Engine(spark, text.removeprefix("open ")) if text.startswith("open ") else own.query_sql(text) if text.startswith("SELECT") else own.query(text))
            got = "nothing"
        except QueryError as e:
            got = says if says in str(e) else str(e)
        rows.append((text, got))
    return spark.createDataFrame(rows, "query string, error string")


def _edge(spark: SparkSession, values: list[float | None]) -> DataFrame:
    """A digest of single-precision results that have left Spark: their number and the sum of their whole parts."""
    return spark.createDataFrame(pa.table({"x": pa.array(values, pa.float32())})).agg(F.count("x").alias("n"), F.sum(F.floor(F.col("x").cast("double"))).alias("total"))


_EDGE_QUERY = "l_extendedprice * 0.5 WHERE l_quantity > 49"


def export_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(spark, engine(spark, sf_dir, "lineitem").query_floats(_EDGE_QUERY))


def export_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = engine(spark, sf_dir, "lineitem").query_arrow(_EDGE_QUERY)
    if array.type != pa.float32() or array.null_count:
        raise TypeError(f"{array.type} with {array.null_count} nulls")
    return _edge(spark, array.to_pylist())


def export_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    with engine(spark, sf_dir, "lineitem").query_arrow(_EDGE_QUERY, shared_memory=True) as shared:
        return _edge(spark, SharedResult.read(shared.name).column("result").to_pylist())


def command(*args: str, source: str = "lineitem.parquet") -> Query:
    """The command line, which writes what it would print."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        path = f"{sf_dir}/{source}"
        if source.endswith(".csv"):
            spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*PRICED).write.csv(path := f"{folder}/{source}", header=True)
        if main([args[0], path, *args[1:], "--output", f"{folder}/out"]):
            raise RuntimeError(f"refused: {args}")
        return digest(spark.read.parquet(f"{folder}/out"))

    return run


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints of a statement, read back from its lines."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        main(["SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey", f"{sf_dir}/region.parquet"])
    cells = [[x.strip() for x in line.strip("|").split("|")] for line in out.getvalue().splitlines() if line.startswith("|")]
    return spark.createDataFrame([(int(a), b) for a, b in cells[1:]], "r_regionkey int, r_name string")


def peeked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.peek(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).agg(F.count(F.lit(1)).alias("n"))


_DIGEST = "count(result) AS n, CAST(sum(CAST(result AS DECIMAL(28,6))) AS DOUBLE) AS total, min(result) AS lo, max(result) AS hi"
_PRODUCT = f"SELECT {_DIGEST} FROM (SELECT l_extendedprice * l_quantity AS result FROM lineitem WHERE l_quantity > 10)"
_EDGE = "SELECT count(*) AS n, CAST(sum(floor(CAST(CAST(l_extendedprice * 0.5 AS FLOAT) AS DOUBLE))) AS BIGINT) AS total FROM lineitem WHERE l_quantity > 49"
_PRICED = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem"


def _same(text: str, *tables: str) -> tuple[Query, str]:
    """A statement that means the same in both engines."""
    return sql(text, *tables), text


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The tokens of TOKENS and their places.
_TOKENS = [
    (0, "Keyword", "SELECT", 1, 1), (1, "Identifier", "price", 1, 8), (2, "Punctuation", ",", 1, 13), (3, "Keyword", "SUM", 2, 2), (4, "Punctuation", "(", 2, 5),
    (5, "Identifier", "quantity", 2, 6), (6, "Punctuation", ")", 2, 14), (7, "Operator", ">=", 2, 16), (8, "Number", "1.5", 2, 19), (9, "End", "", 2, 22),
]

_ALL: dict[str, tuple[Query, str]] = {
    "expr_project": (keyed("l_extendedprice * l_quantity"), "SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS result FROM lineitem"),
    "expr_filter": (keyed("l_extendedprice * 0.9 WHERE l_extendedprice > 20000"), "SELECT l_orderkey, l_linenumber, l_extendedprice * 0.9 AS result FROM lineitem WHERE l_extendedprice > 20000"),
    "expr_own_form": (summed("l_extendedprice * l_quantity WHERE l_quantity > 10"), _PRODUCT),
    "expr_arith4": (keyed("(l_extendedprice - l_discount) / l_quantity + l_tax"), "SELECT l_orderkey, l_linenumber, (l_extendedprice - l_discount) / l_quantity + l_tax AS result FROM lineitem"),
    "expr_precedence": _same("SELECT l_orderkey, l_linenumber, l_extendedprice + l_quantity * 2 AS a, (l_extendedprice + l_quantity) * 2 AS b FROM lineitem"),
    "expr_cmp_as_float": (keyed("l_quantity >= 25"), "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity >= 25 AS INT) AS DOUBLE) AS result FROM lineitem"),
    "expr_cmp_chain": (keyed("(10 < l_quantity < 1) + 1"), "SELECT l_orderkey, l_linenumber, CAST(CAST(10 < l_quantity AS INT) < 1 AS INT) + 1 AS result FROM lineitem"),
    "expr_cmp_equal": (keyed("l_tax == 0.02"), "SELECT l_orderkey, l_linenumber, CAST(CAST(l_tax = 0.02 AS INT) AS DOUBLE) AS result FROM lineitem"),
    "expr_cmp_assign": (keyed("l_quantity WHERE l_linenumber = 3"), "SELECT l_orderkey, l_linenumber, l_quantity AS result FROM lineitem WHERE l_linenumber = 3"),
    "expr_number_as_condition": (keyed("l_quantity WHERE l_discount"), "SELECT l_orderkey, l_linenumber, l_quantity AS result FROM lineitem WHERE l_discount <> 0"),
    "expr_ieee_division": (keyed("l_quantity / l_discount"), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) ELSE l_quantity / l_discount END AS result FROM lineitem"),
    "expr_function": (keyed("sqrtf(l_extendedprice) + floor(l_quantity)"), "SELECT l_orderkey, l_linenumber, sqrt(l_extendedprice) + floor(l_quantity) AS result FROM lineitem"),
    "expr_int_division": (keyed("l_linenumber / 2"), "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS result FROM lineitem"),
    "filter_and": _same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05"),
    "filter_or_prec": _same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 OR l_discount < 0.02 AND l_tax != 0"),
    "filter_le": _same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 5 AND l_tax = 0.02"),
    "filter_mask": (keyed("l_extendedprice WHERE l_extendedprice > 20000", mask=True), "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 20000 THEN l_extendedprice END AS result FROM lineitem"),
    "kernel_filter": (fixed_filter, "SELECT l_extendedprice, l_quantity FROM lineitem WHERE l_extendedprice > 50000"),
    "kernel_multi": (fixed_revenue, "SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS revenue, l_extendedprice - 10.0 AS adjusted FROM lineitem WHERE l_extendedprice > 50000"),
    "group_sum": (sql("SELECT l_quantity, SUM(l_orderkey) AS s FROM lineitem GROUP BY l_quantity"), "SELECT l_quantity, CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY l_quantity"),
    "group_all": _same("SELECT l_returnflag, SUM(l_quantity) AS s, AVG(l_quantity) AS a, COUNT(l_extendedprice) AS n, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag"),
    "group_expr_key": (sql("SELECT floor(l_quantity / 10) AS k, SUM(l_quantity) AS s FROM lineitem GROUP BY floor(l_quantity / 10)"), "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS k, SUM(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "group_multi_key": _same("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS s FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus"),
    "group_having": _same("SELECT l_suppkey, SUM(l_quantity) AS s FROM lineitem GROUP BY l_suppkey HAVING COUNT(l_quantity) > 600"),
    "group_having_expr": _same("SELECT l_suppkey, SUM(l_quantity) / COUNT(*) AS s FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) / COUNT(*) > 25 AND MAX(l_tax) > 0"),
    "group_order_limit": _same("SELECT l_partkey, SUM(l_quantity) AS s FROM lineitem GROUP BY l_partkey ORDER BY l_partkey DESC LIMIT 5"),
    "global_agg": _same("SELECT SUM(l_quantity) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(l_quantity) AS n, AVG(l_quantity) AS a FROM lineitem"),
    "distinct": _same("SELECT DISTINCT l_quantity FROM lineitem"),
    "distinct_order": _same("SELECT DISTINCT l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 3"),
    "order_limit": _same("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5"),
    "order_expr": _same("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice * l_quantity, l_orderkey, l_linenumber LIMIT 7"),
    "order_limit_offset": (sql("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber OFFSET 2 LIMIT 5"), "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5 OFFSET 2"),
    "join_equi": _same("SELECT o_orderpriority, SUM(l_quantity) AS s FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey GROUP BY o_orderpriority", "lineitem", "orders"),
    "join_chain": _same("SELECT r_name, COUNT(c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "customer", "nation", "region"),
    "join_theta": _same("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey AND n_nationkey > 3", "nation", "region"),
    "join_self": (sql("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation"), "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "window_all": (sql("SELECT p_partkey, SUM(p_size) OVER () AS s FROM part", "part"), "SELECT p_partkey, CAST(SUM(p_size) OVER () AS BIGINT) AS s FROM part"),
    "window_part": (sql("SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand) AS s, AVG(p_size) OVER (PARTITION BY p_brand) AS a, MAX(p_retailprice) OVER (PARTITION BY p_brand) AS m, MIN(p_retailprice) OVER (PARTITION BY p_brand) AS lo FROM part", "part"), "SELECT p_partkey, CAST(SUM(p_size) OVER w AS BIGINT) AS s, AVG(p_size) OVER w AS a, MAX(p_retailprice) OVER w AS m, MIN(p_retailprice) OVER w AS lo FROM part WINDOW w AS (PARTITION BY p_brand)"),
    "window_running": (sql("SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS s FROM part", "part"), "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS s FROM part"),
    "window_whole_expr": (keyed("l_quantity / MAX(l_quantity) OVER () WHERE l_discount > 0.05"), "SELECT l_orderkey, l_linenumber, l_quantity / (max(l_quantity) OVER ()) AS result FROM lineitem WHERE l_discount > 0.05"),
    "window_peers": (sql("SELECT p_partkey, COUNT(p_size) OVER (PARTITION BY p_type ORDER BY p_size) AS n FROM part", "part"), "SELECT p_partkey, COUNT(p_size) OVER (PARTITION BY p_type ORDER BY p_size) AS n FROM part"),
    "stats": (column_statistics, "SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) - COUNT(l_extendedprice) AS nulls FROM lineitem"),
    "stats_filter": (settled_filters, "SELECT 'all' AS kind, 'True' AS verdict, COUNT(*) AS n FROM lineitem UNION ALL SELECT 'none', 'False', 0 UNION ALL SELECT 'some', 'None', COUNT(*) FROM lineitem WHERE l_quantity > 25"),
    "udf_discount": (keyed("discount(l_extendedprice, 0.9)"), "SELECT l_orderkey, l_linenumber, l_extendedprice * 0.9 AS result FROM lineitem"),
    "udf_in_agg": (sql("SELECT l_returnflag, MAX(discount(l_extendedprice, l_quantity)) AS m FROM lineitem GROUP BY l_returnflag"), "SELECT l_returnflag, MAX(l_extendedprice * l_quantity) AS m FROM lineitem GROUP BY l_returnflag"),
    "partitioned_project": (partitioned, f"SELECT {_DIGEST} FROM (SELECT l_extendedprice * l_quantity AS result FROM lineitem WHERE l_discount < 0.05)"),
    "csv_chunked": (csv_chunked, _PRODUCT),
    "csv_streamed": (csv_streamed, _PRODUCT),
    "source_arrow": (round_trip("arrow"), _PRICED),
    "source_csv": (round_trip("csv"), _PRICED),
    "source_json": (round_trip("json"), _PRICED),
    "source_orc": (round_trip("orc"), _PRICED),
    "source_parquet": (round_trip("parquet"), _PRICED),
    "export_floats": (export_floats, _EDGE),
    "export_arrow": (export_arrow, _EDGE),
    "export_shared": (export_shared, _EDGE),
    "sql_text": (sql_text, "SELECT upper(r_name) AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "tokens": (token_list, "SELECT * FROM (VALUES " + ", ".join(map(str, _TOKENS)) + ") t(k, kind, token, line, col)"),
    "errors": (refused, "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(q)}, {_quoted(e)})" for q, e in REFUSED) + ") t(query, error)"),
    "peek": (peeked, "SELECT least(count(*), 4) AS n FROM lineitem"),
    "cli_printed": (printed, "SELECT r_regionkey, r_name FROM region"),
    "cli_expression": (command("l_extendedprice * l_quantity WHERE l_quantity > 10"), _PRODUCT),
    "cli_partitioned": (command("l_extendedprice * l_quantity WHERE l_quantity > 10", "--partitions", "5"), _PRODUCT),
    "cli_chunked": (command("l_extendedprice * l_quantity WHERE l_quantity > 10", "--rows-per-chunk", "1000", "--schema", "int64,int32,float64,float64", source="t.csv"), _PRODUCT),
}


QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: text for name, (_, text) in _ALL.items()}
