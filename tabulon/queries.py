"""The catalogue of registered queries: each builds its result with the engine's own operators, beside the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.dataset import DataSet
from tabulon.operators.tracking import ORIGINAL, STATE
from tabulon.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str, keyed: bool = True) -> Table:
    found = Table.from_df(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)
    return found.set_primary_key(KEYS[name], validate=False) if keyed and name in KEYS else found


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return register


def placed(frame: DataFrame) -> DataFrame:
    """Sorted rows with their place in that order: partitions of a sort follow one another, so their sizes shift the numbers."""
    numbered = frame.withColumn("__at", F.monotonically_increasing_id())
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row a partition
    return numbered.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn("place", F.col("__before") + at + 1).drop("__p", "__at", "__before")


def scalar(spark: SparkSession, value: object, kind: str) -> DataFrame:
    return spark.createDataFrame([(value,)], f"value {kind}")


# -- scans and filters ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_projection(spark, d):
    return table(spark, d, "orders").frame().select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND (l_returnflag = 'R' OR l_returnflag = 'A')")
def filter_expr_and_or(spark, d):
    return table(spark, d, "lineitem").select("l_quantity >= 10 AND (l_returnflag = 'R' OR l_returnflag = 'A')").frame().select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def filter_expr_not(spark, d):
    return table(spark, d, "orders").select("NOT (o_orderstatus = 'F')").frame().select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20")
def filter_criteria_range(spark, d):
    return table(spark, d, "part").find_rows({"p_size": {"$gte": 10, "$lt": 20}}).frame().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def filter_gt(spark, d):
    return table(spark, d, "part").find_rows({"p_size": {"$gt": 25}}).frame().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 25")
def filter_gte(spark, d):
    return table(spark, d, "part").find_rows({"p_size": {"$gte": 25}}).frame().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 5")
def filter_lt(spark, d):
    return table(spark, d, "part").find_rows({"p_size": {"$lt": 5}}).frame().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size <= 5")
def filter_lte(spark, d):
    return table(spark, d, "part").find_rows({"p_size": {"$lte": 5}}).frame().select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def filter_ne(spark, d):
    return table(spark, d, "orders").find_rows({"o_orderstatus": {"$ne": "F"}}).frame().select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, d):
    return table(spark, d, "customer").find_rows({"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}).frame().select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '1')")
def filter_contains(spark, d):
    return table(spark, d, "part").find_rows({"p_name": {"$contains": "1"}}).frame().select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[27]$')")
def filter_regex(spark, d):
    return table(spark, d, "customer").find_rows({"c_name": re.compile("[27]$")}).frame().select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'C') AND suffix(c_name, '3')")
def filter_startswith_endswith(spark, d):
    return table(spark, d, "customer").create_view().where("c_name", "startsWith", "C").where("c_name", "endsWith", "3").frame().select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def view_where_chain(spark, d):
    return table(spark, d, "orders").create_view().where("o_orderstatus", "=", "O").where("o_totalprice", ">", 1000).order_by("o_totalprice", "desc").skip(20).take(10).frame().select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) + 5 FROM orders)")
def find_by_pk(spark, d):
    orders = table(spark, d, "orders")
    return orders.at_key(int(orders.compute("MIN(o_orderkey)")) + 5).frame()


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn = 1")
def find_composite(spark, d):
    found = table(spark, d, "conversations")
    return found.at_key([found.compute("MIN(conv_id)"), 1]).frame().select("conv_id", "turn", "role")


# -- computed columns ----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def computed_arith(spark, d):
    return table(spark, d, "lineitem").add_column("net", "number", expression="l_extendedprice * (1 - l_discount)").frame().select("l_orderkey", "l_linenumber", "net")


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS BIGINT) AS len FROM customer")
def computed_string_funcs(spark, d):
    t = table(spark, d, "customer").add_column("up", "string", expression="UPPER(c_name)").add_column("low", "string", expression="LOWER(c_mktsegment)").add_column("len", "integer", expression="LEN(c_name)")
    return t.frame().select("c_custkey", "up", "low", "len")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'HIGH' ELSE 'LOW' END AS band, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS st FROM orders")
def computed_iif_coalesce_isnull(spark, d):
    t = table(spark, d, "orders").add_column("band", "string", expression="IIF(o_totalprice > 100000, 'HIGH', 'LOW')")
    t = t.add_column("st", "string", expression="ISNULL(COALESCE(IIF(o_orderstatus = 'F', NULL, o_orderstatus), NULL), 'none')")
    return t.frame().select("o_orderkey", "band", "st")


@query("SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal + 0.5)::DOUBLE AS r FROM customer")
def computed_abs_round(spark, d):
    return table(spark, d, "customer").add_column("a", "number", expression="ABS(c_acctbal)").add_column("r", "number", expression="ROUND(c_acctbal)").frame().select("c_custkey", "a", "r")


@query("SELECT c_custkey, c_name || '-' || c_mktsegment AS label FROM customer")
def computed_concat(spark, d):
    return table(spark, d, "customer").add_column("label", "string", expression="c_name + '-' + c_mktsegment").frame().select("c_custkey", "label")


@query("SELECT p_partkey, p_retailprice / p_size AS per, (p_size % 7)::DOUBLE AS m FROM part WHERE p_size <> 0")
def computed_div_mod(spark, d):
    return table(spark, d, "part").add_column("per", "number", expression="p_retailprice / p_size").add_column("m", "number", expression="p_size % 7").select("p_size <> 0").frame().select("p_partkey", "per", "m")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").add_column("k", "integer", expression="props.k").frame().select("event_id", "k")


@query("SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size * 2 > 50")
def computed_function(spark, d):
    return table(spark, d, "part").add_column("twice", "any", expression=lambda row: row.p_size * 2).select("twice > 50").frame().select("p_partkey", "twice")


# -- aggregates ----------------------------------------------------------------------------------------------------------


@query("SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag = 'R'")
def compute_sum_filtered(spark, d):
    return scalar(spark, table(spark, d, "lineitem").compute("SUM(l_extendedprice)", "l_returnflag = 'R'"), "double").select(F.round("value", 2).alias("value"))


@query("SELECT count(*) AS value FROM lineitem")
def compute_count_star(spark, d):
    return scalar(spark, table(spark, d, "lineitem").compute("count(*)"), "bigint")


@query("SELECT count(l_tax) AS value FROM lineitem WHERE l_quantity > 30")
def compute_count_col(spark, d):
    return scalar(spark, table(spark, d, "lineitem").compute("COUNT(l_tax)", {"l_quantity": {"$gt": 30}}), "bigint")


@query("SELECT round(avg(o_totalprice), 4) AS value FROM orders")
def compute_avg(spark, d):
    return scalar(spark, table(spark, d, "orders").compute("AVG(o_totalprice)"), "double").select(F.round("value", 4).alias("value"))


@query("SELECT min(o_orderdate) AS value FROM orders")
def compute_min(spark, d):
    return scalar(spark, table(spark, d, "orders").compute("MIN(o_orderdate)"), "timestamp_ntz")


@query("SELECT max(p_name) AS value FROM part")
def compute_max(spark, d):
    return scalar(spark, table(spark, d, "part").compute("MAX(p_name)"), "string")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def groupby_single(spark, d):
    out = table(spark, d, "orders").group_by("o_orderstatus", {"n": {"fn": "COUNT"}, "total": {"fn": "SUM", "column": "o_totalprice"}})
    return out.withColumn("total", F.round("total", 2))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2""")
def groupby_multi(spark, d):
    out = table(spark, d, "lineitem").group_by(["l_returnflag", "l_linestatus"], {
        "sum_qty": {"fn": "SUM", "column": "l_quantity"}, "avg_price": {"fn": "AVG", "column": "l_extendedprice"}, "avg_disc": {"fn": "AVG", "column": "l_discount"},
        "n": {"fn": "COUNT"}, "first_ship": {"fn": "MIN", "column": "l_shipdate"}, "last_ship": {"fn": "MAX", "column": "l_shipdate"},
    })
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_price": F.round("avg_price", 4), "avg_disc": F.round("avg_disc", 6)})


@query("SELECT o_orderstatus, year(o_orderdate)::INT AS key1, count(*) AS n FROM orders GROUP BY 1, 2")
def groupby_fn_key(spark, d):
    return table(spark, d, "orders").group_by(["o_orderstatus", lambda row: F.year(row.o_orderdate)], {"n": "COUNT"})


@query("SELECT count(*) AS n, max(p_size) AS top FROM part HAVING count(*) > 0")
def groupby_global(spark, d):
    return table(spark, d, "part").group_by([], {"n": "COUNT", "top": {"fn": "MAX", "column": "p_size"}})


# -- joins, distinct, union, sort ----------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner_on(spark, d):
    r = table(spark, d, "region").frame().withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, d, "nation").join(Table.from_df(r, "region"), on="n_regionkey").frame()


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_left_right_keys(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), left_key="o_custkey", right_key="c_custkey").frame().select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def join_left_miss(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select("o_totalprice > 400000"), left_key="c_custkey", right_key="o_custkey", how="left").frame().select("c_custkey", "o_orderkey")


@query("SELECT c.c_custkey, coalesce(x.c_name, c.c_name) AS c_name, x.extra FROM customer c LEFT JOIN (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal AS extra FROM customer WHERE c_nationkey < 10) x USING (c_custkey)")
def join_collision_right_wins(spark, d):
    right = Table.from_df(table(spark, d, "customer").select("c_nationkey < 10").frame().selectExpr("c_custkey", "upper(c_name) AS c_name", "c_acctbal AS extra"), "x")
    return table(spark, d, "customer").join(right, on="c_custkey", how="left").frame().select("c_custkey", "c_name", "extra")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND CAST(s_suppkey % 5 AS BIGINT) = CAST(c_custkey % 5 AS BIGINT)")
def join_fn_composite(spark, d):
    out = table(spark, d, "supplier").join(table(spark, d, "customer"), left_key=lambda r: [r.s_nationkey, r.s_suppkey % 5], right_key=lambda r: [r.c_nationkey, r.c_custkey % 5])
    return out.frame().select("s_suppkey", "c_custkey")


@query("SELECT s_suppkey, n_name FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) a JOIN (SELECT n_name, nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(spark, d):
    a = Table.from_df(table(spark, d, "supplier").frame().selectExpr("s_suppkey", "nullif(s_nationkey, 3) AS k"), "a")
    b = Table.from_df(table(spark, d, "nation").frame().selectExpr("n_name", "nullif(n_nationkey, 3) AS k"), "b")
    return a.join(b, on="k").frame().select("s_suppkey", "n_name")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_select(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), left_key="n_regionkey", right_key="r_regionkey", select=lambda left, right: {"nation": left.n_name, "region": right.r_name}).frame()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
def distinct_first_wins(spark, d):
    return table(spark, d, "orders").distinct("o_custkey").frame().select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def union_all_by_name(spark, d):
    a = Table.from_df(table(spark, d, "nation").frame().selectExpr("n_name AS name", "n_nationkey AS id"), "a")
    b = Table.from_df(table(spark, d, "region").frame().selectExpr("r_regionkey AS ID", "r_name AS Name"), "b")
    return a.union(b).frame()


@query("SELECT n_name AS name, NULL::INT AS extra FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def union_extra_right_cols(spark, d):
    a = Table.from_df(table(spark, d, "nation").frame().selectExpr("n_name AS name"), "a")
    b = Table.from_df(table(spark, d, "region").frame().selectExpr("r_name AS name", "r_regionkey AS extra"), "b")
    return a.union(b).frame()


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier")
def union_distinct(spark, d):
    a = Table.from_df(table(spark, d, "customer").frame().selectExpr("c_nationkey AS k"), "a")
    return a.union(Table.from_df(table(spark, d, "supplier").frame().selectExpr("s_nationkey AS k"), "b")).distinct("k").frame()


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50")
def sort_multi_topk(spark, d):
    t = table(spark, d, "orders").sort_multiple({"column": "o_orderstatus"}, {"column": "o_totalprice", "order": "desc"})
    return t.frame().limit(50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k, row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS place FROM customer")
def sort_nulls_last(spark, d):
    t = Table.from_df(table(spark, d, "customer").frame().selectExpr("c_custkey", "nullif(c_nationkey, 3) AS k"), "t", "c_custkey")
    return placed(t.sort("k", "desc").frame())


# -- relations and constraints -------------------------------------------------------------------------------------------


def company(spark: SparkSession, d: str) -> DataSet:
    out = DataSet("company")
    for name in ("region", "nation", "customer", "orders"):
        out.add_table(table(spark, d, name))
    out.add_relation("region_nation", "region", "nation", "r_regionkey", "n_regionkey")
    out.add_relation("nation_customer", "nation", "customer", "n_nationkey", "c_nationkey")
    out.add_relation("customer_orders", "customer", "orders", "c_custkey", "o_custkey")
    return out


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def relation_children(spark, d):
    return company(spark, d).get_child_rows({"r_regionkey": 1}, "region_nation").frame().select("n_nationkey", "n_name")


@query("SELECT c_custkey, n_name AS parent_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def relation_parent(spark, d):
    return company(spark, d).with_parents("nation_customer").select("c_custkey", "parent_n_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_orphans(spark, d):
    data = company(spark, d)
    data.replace_table(data.table("customer").delete({"c_mktsegment": "BUILDING"}))
    return data.orphans("customer_orders").select("o_orderkey")


@query("""SELECT 'nation' AS t, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL
    SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL
    SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def fk_cascade_delete(spark, d):
    data = company(spark, d)
    for name in ("region_nation", "nation_customer", "customer_orders"):
        data.add_foreign_key_constraint(name, delete_rule="cascade")
    data.delete("region", {"r_regionkey": 2})
    out = None
    for name in ("nation", "customer", "orders"):
        one = data.table(name).rows_by_state("DELETED").df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT c_custkey, nullif(c_nationkey, 7) AS c_nationkey, CASE WHEN c_nationkey = 7 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state FROM customer")
def fk_set_null(spark, d):
    data = company(spark, d)
    data.add_foreign_key_constraint("nation_customer", delete_rule="setnull")
    data.delete("nation", {"n_nationkey": 7})
    return data.table("customer").df.select("c_custkey", "c_nationkey", F.col(STATE).alias("state"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates(spark, d):
    return table(spark, d, "lineitem").set_primary_key(["l_orderkey", "l_linenumber"], validate=False).violations()


@query("SELECT c_nationkey, count(*) AS n_rows FROM customer GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    return table(spark, d, "customer").violations("c_nationkey")


@query("SELECT l_orderkey, l_linenumber, 'few' AS check_name FROM lineitem WHERE NOT (l_quantity < 45 OR l_discount > 0.05)")
def check_violations(spark, d):
    return table(spark, d, "lineitem").add_check_constraint("l_quantity < 45 OR l_discount > 0.05", "few", validate=False).check_violations().select("l_orderkey", "l_linenumber", "check_name")


# -- changes -------------------------------------------------------------------------------------------------------------


def changed_customers(spark: SparkSession, d: str) -> Table:
    t = table(spark, d, "customer").update("c_acctbal < 0", {"c_acctbal": 0, "c_mktsegment": lambda r: F.lower(r.c_mktsegment)}, validate=False)
    t = t.delete("c_nationkey = 5")
    return t.add_rows([{"c_custkey": 10_000_000 + i, "c_name": f"new {i}", "c_nationkey": i, "c_acctbal": float(i), "c_mktsegment": "NEW"} for i in range(3)], validate=False)


NEW_CUSTOMERS = "SELECT 10000000 + i AS c_custkey, 'new ' || i AS c_name, i::INT AS c_nationkey, i::DOUBLE AS c_acctbal, 'NEW' AS c_mktsegment FROM range(3) r(i)"
KEPT = "CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment"


@query(f"""SELECT c_custkey, {KEPT}, CASE WHEN c_nationkey = 5 THEN 'DELETED' WHEN c_acctbal < 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state FROM customer
    UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'ADDED' FROM ({NEW_CUSTOMERS})""")
def tracking_changes(spark, d):
    return changed_customers(spark, d).df.select("c_custkey", "c_acctbal", "c_mktsegment", F.col(STATE).alias("state"))


@query(f"SELECT c_custkey, {KEPT} FROM customer WHERE c_nationkey <> 5 UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM ({NEW_CUSTOMERS})")
def tracking_accept(spark, d):
    return changed_customers(spark, d).accept_changes().frame().select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT * FROM customer")
def tracking_reject(spark, d):
    return changed_customers(spark, d).reject_changes().frame()


@query("""SELECT CASE WHEN c_nationkey = 5 THEN 'DELETED' WHEN c_acctbal < 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state, count(*) AS n FROM customer GROUP BY 1
    UNION ALL SELECT 'ADDED', 3""")
def changes_summary(spark, d):
    found = changed_customers(spark, d).get_changes_summary()
    return spark.createDataFrame([(s, found[f"{s.lower()}Count"]) for s in ("ADDED", "MODIFIED", "DELETED", "UNCHANGED")], "state string, n bigint")


@query("SELECT c_custkey, c_acctbal AS before, 'c_acctbal,c_mktsegment' AS changed FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 5")
def changeset_changed_columns(spark, d):
    return changed_customers(spark, d).get_change_set().modified.select(F.col("key.c_custkey").alias("c_custkey"), F.col("original.c_acctbal").alias("before"), F.concat_ws(",", "changed_columns").alias("changed"))


@query("SELECT c_custkey, 'update' AS command FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 5 UNION ALL SELECT c_custkey, 'delete' FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 10000000 + i, 'insert' FROM range(3) r(i)")
def get_commands(spark, d):
    found = changed_customers(spark, d).get_commands()
    return found["inserts"].select("key.c_custkey", F.lit("insert").alias("command")).union(found["updates"].select("key.c_custkey", F.lit("update"))).union(found["deletes"].select("key.c_custkey", F.lit("delete")))


@query("SELECT o_orderkey, o_totalprice + 1 AS now, o_totalprice AS before FROM orders WHERE o_orderstatus = 'P'")
def edit_versions(spark, d):
    t = table(spark, d, "orders").begin_edit({"o_orderstatus": "P"}, {"o_totalprice": lambda r: r.o_totalprice + 1}).end_edit(validate=False)
    return t.get_changes("MODIFIED").df.select("o_orderkey", F.col("o_totalprice").alias("now"), F.col(f"{ORIGINAL}.o_totalprice").alias("before"))


# -- merge, upsert, apply ------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey,
    CASE WHEN t.p_partkey IS NULL THEN s.p_size WHEN t.p_brand = 'Brand#11' THEN 99 WHEN s.p_partkey IS NULL THEN t.p_size ELSE s.p_size END AS p_size,
    CASE WHEN t.p_partkey IS NULL THEN 'ADDED' WHEN t.p_brand = 'Brand#11' AND t.p_size <> 99 THEN 'MODIFIED' WHEN s.p_partkey IS NOT NULL AND t.p_brand <> 'Brand#11' AND s.p_size <> t.p_size THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state
    FROM part t FULL JOIN (SELECT p_partkey + (CASE WHEN p_size > 40 THEN 100000000 ELSE 0 END) AS p_partkey, p_size + (CASE WHEN p_size < 20 THEN 1 ELSE 0 END) AS p_size FROM part) s USING (p_partkey)""")
def merge_preserve(spark, d):
    """The whole part table: rows changed here and there, changed there alone, the same, and new ones."""
    target = table(spark, d, "part").update("p_brand = 'Brand#11'", {"p_size": 99}, validate=False)
    rows = spark.read.parquet(f"{d}/part.parquet")
    source = Table.from_df(rows.withColumn("p_partkey", F.expr("p_partkey + CASE WHEN p_size > 40 THEN 100000000 ELSE 0 END")).withColumn("p_size", F.expr("p_size + CASE WHEN p_size < 20 THEN 1 ELSE 0 END")), "part", "p_partkey")
    return target.merge(source, preserve_changes=True)[0].df.select("p_partkey", "p_size", F.col(STATE).alias("state"))


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'x' || c_custkey END AS role FROM customer")
def merge_add_column(spark, d):
    source = Table.from_df(spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").withColumn("role", F.expr("'x' || c_custkey")), "customer", "c_custkey")
    return table(spark, d, "customer").merge(source, missing_schema_action="add")[0].frame().select("c_custkey", "c_name", "role")


@query("""SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'last' ELSE r_name END AS r_name, CASE WHEN r_regionkey = 1 THEN 'first' END AS note FROM region
    UNION ALL SELECT 77, 'added', NULL""")
def merge_rows_upsert(spark, d):
    rows = [{"r_regionkey": 1, "r_name": "earlier", "note": "first"}, {"r_regionkey": 1, "r_name": "last"}, {"r_regionkey": 77, "r_name": "added"}]
    return table(spark, d, "region").merge_rows(rows)[0].frame()


@query(f"SELECT c_custkey, {KEPT} FROM customer WHERE c_nationkey <> 5 UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM ({NEW_CUSTOMERS})")
def apply_changeset(spark, d):
    changes = changed_customers(spark, d).get_change_set()
    return table(spark, d, "customer").apply_change_set(changes)[0].live().frame().select("c_custkey", "c_acctbal", "c_mktsegment")


# -- schemas and serialisation -------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def schema_infer_roundtrip(spark, d):
    return Table.from_objects(spark, [r.asDict() for r in table(spark, d, "nation").rows()], table_name="nation").frame()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def serialize_roundtrip(spark, d):
    return Table.deserialize(spark, table(spark, d, "nation").serialize()).frame()


@query("SELECT r_regionkey AS regionKey, r_name AS regionName FROM region")
def load_renamed(spark, d):
    found = table(spark, d, "region").frame()
    return Table.empty(spark, "regions").load_rows(found, rename_columns={"r_regionkey": "region_key", "r_name": "region_name"}, column_name_transform="camelCase").frame()


@query("SELECT 'extra' AS difference, 'n_regionkey' AS name UNION ALL SELECT 'missing', 'n_area' UNION ALL SELECT 'type', 'n_nationkey'")
def schema_compare(spark, d):
    other = Table.from_df(table(spark, d, "nation").frame().selectExpr("CAST(n_nationkey AS STRING) AS n_nationkey", "n_name", "1.5D AS n_area"), "nation")
    found = table(spark, d, "nation", keyed=False).compare_schema(other)
    rows = [("missing", n) for n in found["missingColumns"]] + [("extra", n) for n in found["extraColumns"]] + [("type", x["columnName"]) for x in found["typeMismatches"]]
    return spark.createDataFrame(rows, "difference string, name string")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, NULL::DOUBLE AS n_area FROM nation")
def schema_update(spark, d):
    other = Table.from_df(table(spark, d, "nation").frame().selectExpr("CAST(n_nationkey AS STRING) AS n_nationkey", "n_name", "1.5D AS n_area"), "nation")
    return table(spark, d, "nation", keyed=False).update_schema(other, remove_extra=True).frame()


@query("SELECT n_nationkey, n_name, 'x' AS mark FROM nation")
def add_column_default(spark, d):
    return table(spark, d, "nation").add_column("mark", "string", default="x").remove_column("n_regionkey").frame()


@query("SELECT min(p_name) AS value FROM part WHERE p_size > 10")
def compute_min_text(spark, d):
    return scalar(spark, table(spark, d, "part").compute("MIN(p_name)", "p_size > 10"), "string")


@query("SELECT * FROM part WHERE p_size > 40 AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_partkey LIMIT 1")
def find_one(spark, d):
    parts = table(spark, d, "part")
    found = parts.find_one({"p_size": {"$gt": 40}, "p_brand": parts.compute("MIN(p_brand)")})
    return spark.createDataFrame([found] if found else [], parts.frame().schema)


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY abs(p_size - 25), p_partkey) AS place FROM part")
def sort_by_function(spark, d):
    return placed(table(spark, d, "part").sort_by(lambda r: F.abs(r.p_size - 25)).frame().select("p_partkey", "p_size"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderpriority, o_orderkey DESC LIMIT 40 OFFSET 10")
def view_string_filter_sort(spark, d):
    view = table(spark, d, "orders").create_view(filter="o_orderstatus = 'F' AND o_totalprice > 1000", sort="o_orderpriority ASC, o_orderkey DESC")
    return view.skip(10).take(40).frame().select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 5")
def original_versions(spark, d):
    changed = changed_customers(spark, d).where("rowState = 'MODIFIED'")
    return changed.add_column("before", "number", expression="originalValues.c_acctbal").frame().select("c_custkey", F.col("before").alias("c_acctbal"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 5 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 5 UNION ALL SELECT 10000000 + i FROM range(3) r(i)")
def changed_rows(spark, d):
    return changed_customers(spark, d).get_changes().frame().select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def remove_rows(spark, d):
    return table(spark, d, "customer").remove("c_acctbal < 0").frame().select("c_custkey", "c_acctbal")


@query("SELECT * FROM nation WHERE 1 = 0")
def clear_rows(spark, d):
    return table(spark, d, "nation").clear().frame()


@query("SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 1007 ELSE c_nationkey END AS c_nationkey FROM customer")
def fk_cascade_update(spark, d):
    data = company(spark, d)
    data.add_foreign_key_constraint("nation_customer", update_rule="cascade")
    return data.update_key("nation", {"n_nationkey": 7}, {"n_nationkey": 1007}).table("customer").frame().select("c_custkey", "c_nationkey")


@query("SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, 'b' UNION ALL SELECT 3, 'c' UNION ALL SELECT 4, 'd'")
def query_result_shapes(spark, d):
    fields = [{"name": "id", "dataTypeID": 23}, {"name": "name", "dataTypeID": 1043}]
    shapes = [
        {"rows": [{"id": 1, "name": "a"}], "fields": fields}, [[{"id": 2, "name": "b"}], [{"name": "id", "columnType": 3}, {"name": "name", "columnType": 253}]],
        {"recordset": [{"id": 3, "name": "c"}], "recordsets": [[{"id": 3, "name": "c"}]]}, {"data": {"items": [{"id": 4, "name": "d"}]}},
    ]
    found = [Table.from_query_result(spark, s) for s in shapes]
    out = found[0]
    for more in found[1:]:
        out = out.union(more, primary_key=[])
    return out.frame().select(F.col("id").cast("int").alias("id"), "name")


@query("SELECT n_regionkey, n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10")
def preview_rows(spark, d):
    rows = table(spark, d, "nation").get_preview(10)
    return spark.createDataFrame([(r["n_regionkey"], r["n_nationkey"]) for r in rows], "n_regionkey int, n_nationkey int")


@query("SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT max(r_name) FROM region)")
def data_set_merge(spark, d):
    target, source = DataSet("s"), company(spark, d)
    target.merge(source, missing_schema_action="add")
    region = target.table("region")
    return target.get_child_rows(region.where({"r_name": region.compute("MAX(r_name)")}), "region_nation").frame().select("n_name")
