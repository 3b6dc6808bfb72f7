"""Registered queries for policies, outcomes, versions, exports and errors, over whole tables, beside the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import functions as F

from tabulon import errors, types
from tabulon.dataset import DataSet
from tabulon.operators import tracking
from tabulon.operators.tracking import ORIGINAL, STATE
from tabulon.queries import changed_customers, company, query, table
from tabulon.sources import loader
from tabulon.table import Table


def raised(*actions: tuple[str, Callable]) -> list[tuple[str, str]]:
    """The name of the error that each action ends with."""
    out = []
    for name, action in actions:
        try:
            action()
            out.append((name, "none"))
        except errors.TableError as error:
            out.append((name, type(error).__name__))
    return out


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- loading -------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey::BIGINT + 100, n_name FROM nation")
def load_append(spark, d):
    rows = [{"id": r.n_nationkey, "name": r.n_name} for r in table(spark, d, "nation").rows()]
    t = Table.from_rows(spark, rows, table_name="t", primary_key="id")
    return t.load_rows([{"id": r["id"] + 100, "name": r["name"]} for r in rows]).frame()


@query("SELECT o_orderkey, o_custkey, upper(o_orderstatus) AS o_orderstatus, 'orders' AS origin FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey, NULL, 'orders' FROM orders")
def load_append_frame(spark, d):
    orders = table(spark, d, "orders").frame()
    first = orders.selectExpr("o_orderkey", "o_custkey", "upper(o_orderstatus) AS o_orderstatus")
    t = Table.from_df(first, "t", "o_orderkey").add_column("origin", "string", default="orders")
    return t.load_rows(orders.selectExpr("CAST(o_orderkey + 10000000 AS STRING) AS o_orderkey", "o_custkey")).frame()


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal::VARCHAR AS balance FROM customer")
def load_replaces_rows(spark, d):
    t = Table.from_df(table(spark, d, "customer").frame().selectExpr("c_custkey AS id", "'old' AS name"), "t").add_column("balance", "string")
    return t.load_rows(table(spark, d, "customer").frame().selectExpr("c_custkey AS ID", "c_name AS Name", "CAST(c_acctbal AS STRING) AS balance", "c_nationkey"), append=False, ignore_extra_columns=True).frame()


@query("SELECT c_custkey, c_name FROM customer")
def load_include_exclude(spark, d):
    t = Table.empty(spark, "t").load_rows(table(spark, d, "customer").frame(), include_columns=["c_custkey", "c_name", "c_acctbal"], exclude_columns=["C_ACCTBAL"])
    return t.frame()


@query("SELECT * FROM (VALUES ('extra column', 'SchemaMismatchError'), ('strict type', 'TypeMismatchError'), ('nothing to infer', 'SchemaMismatchError'), ('ignored extra', 'none')) v(name, error)")
def load_policies(spark, d):
    t = Table.from_objects(spark, [{"id": 1}], table_name="t")
    more = [{"id": 2, "extra": 1}]
    return rows_of(spark, raised(
        ("extra column", lambda: t.load_rows(more, throw_on_extra_columns=True)), ("strict type", lambda: t.load_rows([{"id": "x"}], strict=True)),
        ("nothing to infer", lambda: Table.from_objects(spark, [])), ("ignored extra", lambda: t.load_rows(more, ignore_extra_columns=True)),
    ), "name string, error string")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def load_array_rows(spark, d):
    rows = [[r.n_nationkey, r.n_name] for r in table(spark, d, "nation").rows()]
    return Table.from_query_result(spark, {"rows": rows, "columns": [{"name": "id"}, {"name": "name"}]}).frame()


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def load_wrapped_records(spark, d):
    rows = table(spark, d, "nation").frame().selectExpr("n_nationkey AS id", "n_name AS name").collect()
    return Table.from_objects(spark, [SimpleNamespace(**r.asDict()) if r.id % 2 else r for r in rows]).frame()


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::DOUBLE AS area FROM nation")
def load_column_overrides(spark, d):
    rows = [{"id": r.n_nationkey, "name": r.n_name, "area": r.n_regionkey} for r in table(spark, d, "nation").rows()]
    return Table.from_objects(spark, rows, columns={"id": "string", "area": {"type": "number"}}).frame()


@query("SELECT n_nationkey::BIGINT AS \"nationKey\", n_name AS label FROM nation")
def load_normalized_rows(spark, d):
    found = loader.normalize_rows([{"nation_key": r.n_nationkey, "n_name": r.n_name} for r in table(spark, d, "nation").rows()], rename_columns={"n_name": "label"}, column_name_transform="camelCase")
    return rows_of(spark, [(r["nationKey"], r["label"]) for r in found], "nationKey bigint, label string")


@query("SELECT 'nation' AS t, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation UNION ALL SELECT 'region', count(*), sum(r_regionkey) FROM region UNION ALL SELECT 'children', count(*), sum(n_nationkey) FROM nation WHERE n_regionkey = 3")
def data_set_from_recordsets(spark, d):
    sets = [[r.asDict() for r in table(spark, d, n).rows()] for n in ("nation", "region")]
    data = DataSet.from_recordsets(spark, sets, table_names=["nation", "region"], relations=[{"name": "r", "parentTable": "region", "childTable": "nation", "parentColumn": "r_regionkey", "childColumn": "n_regionkey"}])
    one = lambda name, t, key: t.frame().agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))
    out = one("nation", data.table("nation"), "n_nationkey").union(one("region", data.table("region"), "r_regionkey"))
    return out.union(one("children", data.get_child_rows({"r_regionkey": 3}, "r"), "n_nationkey"))


# -- filters and expressions ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'P')")
def filter_function(spark, d):
    return table(spark, d, "orders").select(lambda r: (r.o_totalprice > 100000) & r["o_orderstatus"].isin("F", "P")).frame().select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR ends_with(c_name, '7'))")
def filter_python_predicate(spark, d):
    """A function that no Column can express runs row by row in Python."""
    return table(spark, d, "customer").find_rows(lambda r: r.c_acctbal > 0 and (r["C_MKTSEGMENT"] == "BUILDING" or r.c_name.endswith("7"))).frame().select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS NULL OR c_nationkey = 4")
def filter_in_with_null(spark, d):
    t = Table.from_df(table(spark, d, "customer").frame().selectExpr("c_custkey", "nullif(c_nationkey, 3) AS k"), "t")
    return t.find_rows({"k": {"$in": [4, None]}}).frame().select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND contains(c_name, '12') AND c_nationkey IN (1, 2, 3)")
def view_operators(spark, d):
    v = table(spark, d, "customer").create_view().where("c_mktsegment", "!=", "BUILDING").where("c_name", "contains", "12").where("c_nationkey", "in", [1, 2, 3])
    return v.frame().select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 40 AND contains(p_name, 'r')")
def view_criteria(spark, d):
    return table(spark, d, "part").create_view({"p_size": {"$gte": 40}, "p_name": {"$contains": "r"}}).frame().select("p_partkey")


@query("SELECT c_custkey, -c_acctbal AS minus, +c_acctbal AS plus, round(c_acctbal, 1) AS r1 FROM customer WHERE c_nationkey <> 3")
def computed_unary_round(spark, d):
    t = table(spark, d, "customer").add_column("minus", "number", expression="-c_acctbal").add_column("plus", "number", expression="+c_acctbal").add_column("r1", "number", expression="ROUND(c_acctbal, 1)")
    return t.select("c_nationkey != 3").frame().select("c_custkey", "minus", "plus", "r1")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'FURNITURE' AND c_mktsegment < 'MACHINERY'")
def filter_text_order(spark, d):
    return table(spark, d, "customer").select("c_mktsegment >= 'FURNITURE' AND c_mktsegment < 'MACHINERY'").frame().select("c_custkey")


@query("""SELECT * FROM (VALUES ('unknown column', 'ColumnNotFoundError'), ('syntax', 'SchemaMismatchError'), ('join type', 'SchemaMismatchError'), ('aggregate', 'SchemaMismatchError'),
    ('view operator', 'SchemaMismatchError'), ('computed set', 'ReadOnlyColumnError'), ('deleted row', 'InvalidRowStateError'), ('missing column', 'ColumnNotFoundError'), ('repeated key', 'DuplicatePrimaryKeyError')) v(name, error)""")
def errors_by_name(spark, d):
    t = table(spark, d, "nation")
    computed = t.add_column("twice", "integer", expression="n_nationkey * 2")
    return rows_of(spark, raised(
        ("unknown column", lambda: t.select("nothing = 1")), ("syntax", lambda: t.select("n_nationkey = = 1")), ("join type", lambda: t.join(t, on="n_nationkey", how="full")),
        ("aggregate", lambda: t.compute("MEDIAN(n_nationkey)")), ("view operator", lambda: t.create_view().where("n_nationkey", "~", 1).frame()),
        ("computed set", lambda: computed.update("n_nationkey = 1", {"twice": 1})), ("deleted row", lambda: t.delete("n_nationkey = 1").update("n_nationkey = 1", {"n_name": "x"})),
        ("missing column", lambda: t.column("nothing")), ("repeated key", lambda: t.add_row({"n_nationkey": 1, "n_name": "again"})),
    ), "name string, error string")


@query("SELECT NULL::DOUBLE AS compute_sum, 0::DOUBLE AS group_sum, count(*) AS n FROM customer")
def sum_of_nulls(spark, d):
    t = Table.from_df(table(spark, d, "customer").frame().selectExpr("1 AS g", "CAST(NULL AS DOUBLE) AS x"), "t")
    grouped = t.group_by("g", {"group_sum": {"fn": "SUM", "column": "x"}, "n": "COUNT"})
    return grouped.select(F.lit(t.compute("SUM(x)")).cast("double").alias("compute_sum"), F.col("group_sum").cast("double").alias("group_sum"), "n")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k, row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, c_custkey) AS place FROM customer QUALIFY place <= 200")
def view_order_nulls_first(spark, d):
    t = Table.from_df(table(spark, d, "customer").frame().selectExpr("c_custkey", "nullif(c_nationkey, 3) AS k"), "t", "c_custkey")
    return t.create_view().order_by("k", "desc").take(200).frame().withColumn("place", F.expr("row_number() OVER (ORDER BY k DESC NULLS FIRST, c_custkey)"))


# -- versions, states, exports -------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_acctbal AS before, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS now, CASE WHEN c_nationkey = 5 THEN 'DELETED' WHEN c_acctbal < 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state
    FROM customer""")
def row_versions(spark, d):
    t = changed_customers(spark, d).where("rowState != 'ADDED'")
    t = t.add_column("before", "number", expression="originalValues.c_acctbal").add_column("now", "number", expression="currentValues.c_acctbal").add_column("state", "string", expression="rowState")
    return t.frame().select("c_custkey", "before", "now", "state")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'DELETED' ELSE 'UNCHANGED' END AS state FROM customer UNION ALL SELECT 10000000 + i, 'UNCHANGED' FROM range(3) r(i)")
def cleared_changes(spark, d):
    return changed_customers(spark, d).clear_changes().df.select("c_custkey", F.col(STATE).alias("state"))


@query("SELECT s AS state, s <> 'UNCHANGED' AND s <> 'DETACHED' AS changed, s = 'UNCHANGED' AS unchanged, s = 'DETACHED' AS detached FROM (VALUES ('ADDED'), ('MODIFIED'), ('DELETED'), ('UNCHANGED'), ('DETACHED')) v(s)")
def state_predicates(spark, d):
    return rows_of(spark, [(s, tracking.is_changed(s), tracking.is_unchanged(s), tracking.is_detached(s)) for s in ("ADDED", "MODIFIED", "DELETED", "UNCHANGED", "DETACHED")], "state string, changed boolean, unchanged boolean, detached boolean")


@query("SELECT 'customer' AS t, count(*) AS n, TRUE AS changed FROM customer WHERE c_acctbal < 0")
def data_set_change_set(spark, d):
    data = company(spark, d)
    data.replace_table(data.table("customer").update("c_acctbal < 0", {"c_acctbal": 0}, validate=False))
    return rows_of(spark, [(n, c.count(), data.has_changes()) for n, c in data.get_change_set().items()], "t string, n bigint, changed boolean")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 2")
def to_objects_mapped(spark, d):
    found = table(spark, d, "nation").delete("n_regionkey = 2").to_objects(column_name_mapping={"n_nationkey": "id", "n_name": "name"})
    return rows_of(spark, [(r["id"], r["name"]) for r in found], "id int, name string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def exports_to_json(spark, d):
    t = table(spark, d, "nation")
    first = t.create_view({"n_regionkey": 1}).to_objects()
    second = json.loads(json.dumps(t.to_json(), default=str))["rows"]
    return rows_of(spark, [(r["n_nationkey"], r["n_name"]) for r in first] + [(r["n_nationkey"] + 100, r["n_name"]) for r in second], "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 4")
def data_set_round_trip(spark, d):
    data = company(spark, d)
    for name in ("customer", "orders"):
        data.remove_table(name)
    data.replace_table(data.table("nation").delete("n_regionkey = 4"))
    return DataSet.deserialize(spark, data.serialize()).table("nation").live().frame()


@query("SELECT column_name AS name, column_name = 'c_custkey' AS is_key, CASE data_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE 'string' END AS kind FROM information_schema.columns WHERE table_name = 'customer'")
def schema_export_import(spark, d):
    again = Table.import_schema(spark, json.loads(table(spark, d, "customer").serialize_schema()))
    return rows_of(spark, [(c.name, c.name in again.get_primary_key(), {"bigint": "integer"}.get(c.tag, c.tag)) for c in again.schema.columns], "name string, is_key boolean, kind string")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0")
def cloned_table(spark, d):
    t = table(spark, d, "customer")
    copy = t.clone().remove("c_acctbal >= 0")
    return copy.frame().select("c_custkey", "c_name", "c_acctbal")


# -- constraints and rules -----------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('restrict delete', 'ConstraintViolationError'), ('restrict update', 'ConstraintViolationError'), ('orphan insert', 'ConstraintViolationError'), ('orphan update', 'ConstraintViolationError'),
    ('not enforced', 'none'), ('check', 'ConstraintViolationError'), ('unique', 'ConstraintViolationError'), ('merge check', 'ConstraintViolationError'), ('merge unique', 'ConstraintViolationError'), ('merge null key', 'ConstraintViolationError')) v(name, error)""")
def constraint_errors(spark, d):
    def data(enforce: bool = True) -> DataSet:
        out = company(spark, d)
        out.add_foreign_key_constraint("nation_customer")
        out.enforce_constraints = enforce
        return out

    t = table(spark, d, "nation")
    checked, unique = t.add_check_constraint("n_regionkey < 9", "few"), t.add_unique_constraint("n_name")
    bad = Table.from_df(t.frame().selectExpr("n_nationkey + 100 AS n_nationkey", "n_name", "9 AS n_regionkey"), "nation", "n_nationkey")
    nulls = Table.from_df(t.frame().selectExpr("CAST(NULL AS INT) AS n_nationkey", "n_name", "n_regionkey"), "nation")
    return rows_of(spark, raised(
        ("restrict delete", lambda: data().delete("nation", "n_nationkey = 1")), ("restrict update", lambda: data().update_key("nation", "n_nationkey = 1", {"n_nationkey": 99})),
        ("orphan insert", lambda: data().add_rows("customer", [{"c_custkey": -1, "c_nationkey": 99}])), ("orphan update", lambda: data().update("customer", "c_custkey = 1", {"c_nationkey": 99})),
        ("not enforced", lambda: data(False).update("customer", "c_custkey = 1", {"c_nationkey": 99})), ("check", lambda: checked.update("n_nationkey = 1", {"n_regionkey": 9})),
        ("unique", lambda: unique.update("n_nationkey < 3", {"n_name": "one"})), ("merge check", lambda: checked.merge(bad)), ("merge unique", lambda: unique.merge(bad)), ("merge null key", lambda: t.merge(nulls)),
    ), "name string, error string")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_checked(spark, d):
    data = company(spark, d)
    data.add_foreign_key_constraint("customer_orders")
    return data.update("orders", "o_orderstatus = 'F'", {"o_orderstatus": "done"}).table("orders").df.select("o_orderkey", F.col(STATE).alias("state"), "o_orderstatus")


# -- merge outcomes ------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal, arg_max(o_orderstatus, o_orderkey) AS c_mktsegment FROM (SELECT * REPLACE (o_custkey * 2 AS o_custkey) FROM orders) GROUP BY 1)
    SELECT c_custkey, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(s.c_mktsegment, c.c_mktsegment) AS c_mktsegment, c_name,
        CASE WHEN c.c_name IS NULL THEN 'ADDED' WHEN s.c_acctbal IS NOT NULL THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state
    FROM customer c FULL JOIN s USING (c_custkey)""")
def merge_duplicate_keys(spark, d):
    """Orders repeat their customers; the last one of each counts."""
    orders = table(spark, d, "orders").ordered().frame().selectExpr("o_custkey * 2 AS c_custkey", "o_totalprice AS c_acctbal", "o_orderstatus AS c_mktsegment")
    merged, _ = table(spark, d, "customer").merge(Table.from_df(orders, "customer"))
    return merged.df.select("c_custkey", "c_acctbal", "c_mktsegment", "c_name", F.col(STATE).alias("state"))


@query("""SELECT 'superseded' AS outcome, count(*) - count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'inserted', count(DISTINCT o_custkey) FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'updated', count(DISTINCT o_custkey) FROM orders WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer)""")
def merge_outcomes(spark, d):
    orders = table(spark, d, "orders").frame().selectExpr("o_custkey * 2 AS c_custkey", "o_totalprice AS c_acctbal")
    found = table(spark, d, "customer").merge(Table.from_df(orders, "customer"))[1]
    none = rows_of(spark, [(outcome, 0) for outcome in ("superseded", "inserted", "updated")], found.schema)  # listed without any row too
    return found.union(none).groupBy("outcome").agg(F.sum("n").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END::DOUBLE AS c_acctbal, 'X' AS c_mktsegment, 'MODIFIED' AS state FROM customer""")
def merge_preserve_repeated(spark, d):
    """With local changes kept, of rows that repeat a key the first one acts on a column."""
    target = table(spark, d, "customer").update("c_acctbal < 0", {"c_acctbal": 0}, validate=False)
    rows = table(spark, d, "customer").frame().selectExpr("c_custkey", "inline(array(struct(1.0D AS c_acctbal, 'X' AS c_mktsegment), struct(2.0D AS c_acctbal, 'Y' AS c_mktsegment)))")
    merged, _ = target.merge(Table.from_df(rows, "customer"), preserve_changes=True)
    return merged.df.select("c_custkey", "c_acctbal", "c_mktsegment", F.col(STATE).alias("state"))


@query("""SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'UNCHANGED' AS state FROM orders UNION ALL SELECT o_orderkey + 10000000, o_totalprice, 'UNCHANGED' FROM orders WHERE o_orderstatus = 'F'""")
def merge_rows_frame(spark, d):
    orders = table(spark, d, "orders").frame()
    rows = orders.selectExpr("o_orderkey", "o_totalprice + 1 AS o_totalprice", "2 AS n").union(orders.selectExpr("o_orderkey", "-1.0D", "1"))
    rows = rows.union(orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey + 10000000", "o_totalprice", "1"))
    return table(spark, d, "orders").merge_rows(rows, order_by="n")[0].df.select("o_orderkey", "o_totalprice", F.col(STATE).alias("state"))


# -- change sets ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey + CASE WHEN c_nationkey < 5 THEN 50000000 ELSE 0 END AS c_custkey, c_name FROM customer")
def apply_key_change(spark, d):
    t = table(spark, d, "customer")
    changes = t.update("c_nationkey < 5", {"c_custkey": lambda r: r.c_custkey + 50_000_000}).get_change_set()
    return t.apply_change_set(changes, strict=True)[0].live().frame().select("c_custkey", "c_name")


@query("""SELECT 'preserve' AS policy, 'skipped' AS outcome, count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_nationkey < 5 UNION ALL SELECT 'preserve', 'modified', count(*) FROM customer WHERE c_acctbal < 0 AND c_nationkey >= 5
    UNION ALL SELECT 'overwrite', 'modified', count(*) FROM customer WHERE c_acctbal < 0""")
def apply_conflicts(spark, d):
    t = table(spark, d, "customer")
    changes = t.update("c_acctbal < 0", {"c_acctbal": 0}, validate=False).get_change_set()
    local = t.update("c_nationkey < 5", {"c_mktsegment": "mine"}, validate=False)
    found = [local.apply_change_set(changes, conflict_policy=p)[1].select(F.lit(p).alias("policy"), "outcome", "n") for p in ("preserve", "overwrite")]
    return found[0].union(found[1])


@query("""SELECT 'ignore' AS action, 'skipped' AS outcome, count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_nationkey >= 5 UNION ALL SELECT 'ignore', 'modified', count(*) FROM customer WHERE c_acctbal < 0 AND c_nationkey < 5
    UNION ALL SELECT 'add', 'modified', count(*) FROM customer WHERE c_acctbal < 0""")
def apply_missing_rows(spark, d):
    t = table(spark, d, "customer")
    changes = t.update("c_acctbal < 0", {"c_acctbal": 0}, validate=False).get_change_set()
    few = t.remove("c_nationkey >= 5")
    found = [few.apply_change_set(changes, missing_row_action=a)[1].select(F.lit(a).alias("action"), "outcome", "n") for a in ("ignore", "add")]
    return found[0].union(found[1])


@query("SELECT c_custkey, coalesce(o_totalprice, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_orderkey AS c_custkey, o_totalprice FROM orders) USING (c_custkey) UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def apply_added_existing(spark, d):
    """Added rows whose key exists already change that row."""
    orders = table(spark, d, "orders").frame().selectExpr("o_orderkey AS c_custkey", "o_totalprice AS c_acctbal")
    empty = Table.from_df(orders.limit(0), "customer", "c_custkey")
    changes = empty.add_rows(orders, validate=False).get_change_set()
    return table(spark, d, "customer").apply_change_set(changes)[0].frame().select("c_custkey", "c_acctbal")


@query("""SELECT * FROM (VALUES ('conflict', 'SchemaMismatchError'), ('missing row', 'SchemaMismatchError'), ('strict column', 'SchemaMismatchError'), ('strict table', 'SchemaMismatchError'), ('strict key', 'SchemaMismatchError'),
    ('lenient column', 'none'), ('no key', 'SchemaMismatchError'), ('policy', 'SchemaMismatchError'), ('merge default', 'SchemaMismatchError'), ('merge rows twice', 'DuplicatePrimaryKeyError'), ('missing table', 'SchemaMismatchError')) v(name, error)""")
def change_set_errors(spark, d):
    t = table(spark, d, "nation")
    local = t.update("n_nationkey = 1", {"n_name": "mine"})
    changes = t.update("n_nationkey = 1", {"n_name": "theirs"}).get_change_set()
    plain = changes.to_object()
    odd = {"tableName": "nation", "modified": [{"state": "MODIFIED", "key": {"n_nationkey": 1}, "values": {"n_nationkey": 1, "other": 2}}]}
    wider = Table.from_df(t.frame().withColumn("area", F.lit(1.5)), "nation", "n_nationkey")
    return rows_of(spark, raised(
        ("conflict", lambda: local.apply_change_set(changes, conflict_policy="error")), ("missing row", lambda: t.remove("n_nationkey = 1").apply_change_set(changes, missing_row_action="error")),
        ("strict column", lambda: t.apply_change_set(odd, strict=True)), ("strict table", lambda: t.apply_change_set(plain | {"tableName": "x"}, strict=True)),
        ("strict key", lambda: t.apply_change_set(plain | {"primaryKey": ["n_name"]}, strict=True)), ("lenient column", lambda: t.apply_change_set(odd)),
        ("no key", lambda: t.clear_primary_key().apply_change_set(changes)), ("policy", lambda: t.apply_change_set(changes, conflict_policy="ask")), ("merge default", lambda: t.merge(wider)),
        ("merge rows twice", lambda: t.merge_rows(t.frame().union(t.frame()))), ("missing table", lambda: DataSet("s").apply_change_set({"nation": changes}, missing_table_action="error")),
    ), "name string, error string")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_acctbal AS before FROM customer")
def data_set_apply_change_set(spark, d):
    data, other = company(spark, d), company(spark, d)
    data.replace_table(data.table("customer").update("c_acctbal < 0", {"c_acctbal": 0}, validate=False))
    other.apply_change_set(data.get_change_set())
    return other.table("customer").df.select("c_custkey", "c_acctbal", F.col(f"{ORIGINAL}.c_acctbal").alias("before"))


# -- names, types, counts, views, events ---------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('pg', '23', 'integer'), ('pg', '1114', 'date'), ('mysql', '253', 'string'), ('mysql', '246', 'number'), ('mssql', 'bit', 'boolean'), ('mssql', 'money', 'number'),
    ('sqlite', 'VARCHAR(20)', 'string'), ('sqlite', 'DATETIME', 'date'), ('oracle', 'NUMBER(10,2)', 'number'), ('oracle', 'TIMESTAMP(6)', 'date'), ('', 'timestamptz', 'date'), ('', 'odd', 'any')) v(provider, kind, tag)""")
def provider_types(spark, d):
    asked = [("pg", 23), ("pg", 1114), ("mysql", 253), ("mysql", 246), ("mssql", "bit"), ("mssql", "money"), ("sqlite", "VARCHAR(20)"), ("sqlite", "DATETIME"), ("oracle", "NUMBER(10,2)"), ("oracle", "TIMESTAMP(6)"), ("", "timestamptz"), ("", "odd")]
    return rows_of(spark, [(p, str(k), types.from_database(k, p)) for p, k in asked], "provider string, kind string, tag string")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, 'integer' AS id_tag, 25 AS name_length FROM nation")
def load_field_metadata(spark, d):
    fields = [{"name": "id", "dataTypeID": 23}, {"name": "name", "dataTypeID": 1043, "length": 25}]
    t = Table.from_query_result(spark, {"rows": [{"id": str(r.n_nationkey), "name": r.n_name} for r in table(spark, d, "nation").rows()], "fields": fields})
    return t.frame().withColumn("id_tag", F.lit(t.column("id").tag)).withColumn("name_length", F.lit(t.column("name").max_length))


@query("SELECT n_nationkey, upper(n_name) AS label FROM nation")
def load_name_functions(spark, d):
    rows = [{"N_NATIONKEY": r.n_nationkey, "n label": r.n_name.upper()} for r in table(spark, d, "nation").rows()]
    return Table.from_objects(spark, rows, rename_columns=lambda n: n.lower().replace("n ", "")).frame().select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "label")


@query("SELECT n_nationkey, n_name, 'fresh' AS mark FROM nation UNION ALL SELECT 100, 'made', 'fresh' UNION ALL SELECT 101, 'made', 'own'")
def new_rows_with_defaults(spark, d):
    t = table(spark, d, "nation").remove_column("n_regionkey").add_column("mark", "string", default=lambda: "fresh")
    return t.add_rows([t.new_row(n_nationkey=100, n_name="made"), {"n_nationkey": 101, "n_name": "made", "mark": "own"}]).frame()


@query("SELECT count(*) AS pairs, count(*) FILTER (n_regionkey = r_regionkey) AS valid FROM nation, region")
def relation_is_valid(spark, d):
    data = company(spark, d)
    regions, nations = data.table("region").rows(), data.table("nation").rows()
    found = [data.is_valid("region_nation", r, n) for r in regions for n in nations]
    return rows_of(spark, [(len(found), sum(found))], "pairs bigint, valid bigint")


@query("SELECT * FROM (VALUES ('c_custkey', TRUE, FALSE), ('C_NAME', TRUE, FALSE), ('twice', TRUE, TRUE), ('nothing', FALSE, FALSE)) v(name, there, computed)")
def column_lookups(spark, d):
    t = table(spark, d, "customer").add_column("twice", "number", expression="c_acctbal * 2")
    return rows_of(spark, [(n, t.column_exists(n), t.column_exists(n) and t.column(n).computed) for n in ("c_custkey", "C_NAME", "twice", "nothing")], "name string, there boolean, computed boolean")


@query("""SELECT (SELECT count(*) FROM customer) + 3 AS all_rows, (SELECT count(*) FROM customer WHERE c_nationkey = 5) AS deleted, (SELECT count(*) FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 5) AS modified, 3::BIGINT AS added, TRUE AS changed""")
def change_set_members(spark, d):
    t = changed_customers(spark, d)
    c = t.get_change_set()
    return rows_of(spark, [(t.count(), c.deleted.count(), c.modified.count(), c.added.count(), c.has_changes() and t.has_changes() and not c.is_empty())], "all_rows bigint, deleted bigint, modified bigint, added bigint, changed boolean")


@query("SELECT 'first' AS place, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL SELECT 'third', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 2) UNION ALL SELECT 'count', count(*) FROM orders")
def view_rows(spark, d):
    v = table(spark, d, "orders").create_view().order_by("o_totalprice", "desc")
    return rows_of(spark, [("first", v.first_row().o_orderkey), ("third", v.row(2).o_orderkey), ("count", v.count())], "place string, o_orderkey bigint")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def iterated_rows(spark, d):
    return rows_of(spark, [(r.n_nationkey, r.n_name, i) for i, r in enumerate(table(spark, d, "nation"))], "n_nationkey int, n_name string, place bigint")


@query("SELECT 'Table' AS type, 'nation' AS name, 25::BIGINT AS n_rows, 3::BIGINT AS shown, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS modified")
def debug_views(spark, d):
    v = table(spark, d, "nation").update("n_regionkey = 1", {"n_name": "x"}).to_debug_view(3)
    return rows_of(spark, [(v["type"], v["tableName"], v["rowCount"], len(v["preview"]), v["changes"]["modifiedCount"])], "type string, name string, n_rows bigint, shown bigint, modified bigint")


@query("SELECT c_custkey, c_name, upper(c_name) AS \"C_NAME_\" FROM customer WHERE c_nationkey = 3")
def case_sensitive_names(spark, d):
    rows = table(spark, d, "customer").frame().selectExpr("c_custkey", "c_name", "upper(c_name) AS C_NAME_", "c_nationkey AS K", "c_nationkey + 1 AS k_")
    t = Table.from_df(rows, "t", "c_custkey", case_sensitive=True)
    kept = t if not t.column_exists("k") and t.column_exists("K") else t.where("1 = 0")
    return kept.select("K = 3").frame().select("c_custkey", "c_name", "C_NAME_")


@query("SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer")
def data_set_clone(spark, d):
    data = company(spark, d)
    copy = data.clone()
    copy.replace_table(copy.table("region").clear())
    for name in ("orders", "region"):
        data.remove_table(name)
    kept = [(n, copy.table(n).count()) for n in data.tables if copy.has_table(n) and not data.has_table("orders")]
    return rows_of(spark, kept, "t string, n bigint")


@query("SELECT unnest(['rowsAdding', 'rowsAdded', 'rowsChanging', 'columnChanging', 'columnChanged', 'rowsChanged', 'rowsDeleting', 'rowsDeleted', 'rowsRemoving', 'rowsRemoved', 'tableClearing', 'tableCleared']) AS event, unnest(range(12)) AS place")
def events_in_order(spark, d):
    seen: list[str] = []
    t = table(spark, d, "nation")
    for name in ("rowsAdding", "rowsAdded", "rowsChanging", "rowsChanged", "columnChanging", "columnChanged", "rowsDeleting", "rowsDeleted", "rowsRemoving", "rowsRemoved", "tableClearing", "tableCleared"):
        t = t.on(name, lambda _, n=name: seen.append(n))
    t.add_row({"n_nationkey": 99, "n_name": "x", "n_regionkey": 1}).update("n_nationkey = 99", {"n_name": "y"}).delete("n_nationkey = 98").remove("n_nationkey = 97").clear()
    return rows_of(spark, list(zip(seen, range(len(seen)), strict=True)), "event string, place bigint")


@query("SELECT c_custkey + CASE WHEN c_nationkey = 7 THEN 0 ELSE 0 END AS c_custkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END AS c_nationkey, CASE WHEN c_nationkey = 7 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS state FROM customer")
def fk_null_on_update(spark, d):
    data = company(spark, d)
    data.add_foreign_key_constraint("nation_customer", update_rule="setnull")
    return data.update("nation", {"n_nationkey": 7}, {"n_nationkey": 1007}).table("customer").df.select("c_custkey", "c_nationkey", F.col(STATE).alias("state"))


@query("SELECT * FROM (VALUES ('loading', 'none'), ('loaded', 'ConstraintViolationError'), ('set', 'ConstraintViolationError')) v(name, error)")
def load_brackets(spark, d):
    t = table(spark, d, "nation").add_unique_constraint("n_name").begin_load_data()
    broken = t.update("n_nationkey < 3", {"n_name": "one"})
    data = company(spark, d).begin_load_data()
    data.add_foreign_key_constraint("nation_customer")
    data.update("customer", "c_custkey = 1", {"c_nationkey": 99})
    return rows_of(spark, raised(("loading", lambda: t.update("n_nationkey < 3", {"n_name": "one"})), ("loaded", broken.end_load_data), ("set", data.end_load_data)), "name string, error string")


@query("SELECT c_custkey, 'ROW' AS kind, c_acctbal AS original, 0::DOUBLE AS current FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_acctbal < 0)")
def row_access(spark, d):
    t = table(spark, d, "customer")
    key = t.where("c_acctbal < 0").compute("MIN(c_custkey)")
    found = t.update("c_acctbal < 0", {"c_acctbal": 0}, validate=False)
    seen = found.row_debug_view(key)
    return rows_of(spark, [(key, "ROW" if seen["type"] == "Row" and seen["rowState"] == "MODIFIED" else "", float(found.get(key, "c_acctbal", "original")), float(seen["values"]["c_acctbal"]))], "c_custkey bigint, kind string, original double, current double")
