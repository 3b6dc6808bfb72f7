"""Schemas, relational operators, views, constraints, states, changes, merges, data sets and loading."""

from __future__ import annotations

import datetime as dt

import pytest
from tabulon import DataSet, Table, column, queries_rules
from tabulon.errors import ColumnNotFoundError, ConstraintViolationError, DuplicatePrimaryKeyError, InvalidRowStateError, ReadOnlyColumnError, SchemaMismatchError, TypeMismatchError
from tabulon.operators.tracking import STATE
from tabulon.sources import results


def users(spark, rows=((1, "Ann"), (2, "bob"), (3, None))):
    return Table.from_objects(spark, [{"id": i, "name": n, "email": f"{i}@x"} for i, n in rows], table_name="Users", primary_key="id")


def values(table, *names):
    return [tuple(r[n] for n in names) for r in table.live().ordered().frame().collect()]


def states(table):
    return {r["id"]: r[STATE] for r in table.track().df.collect()}


def outcomes(frame):
    return {r["outcome"]: r["n"] for r in frame.collect()}


# -- states --------------------------------------------------------------------------------------------------------------


def test_row_state_machine(spark):
    t = users(spark)
    assert not t.has_changes()
    t = t.add_row({"id": 4, "name": "new"}).update("id = 1", {"name": "Anna"}).delete("id = 2")
    assert states(t) == {1: "MODIFIED", 2: "DELETED", 3: "UNCHANGED", 4: "ADDED"}
    assert t.has_changes() and t.getChangesSummary()["modifiedCount"] == 1
    assert states(t.accept_changes()) == dict.fromkeys((1, 3, 4), "UNCHANGED")
    back = t.reject_changes()
    assert values(back, "id", "name") == [(1, "Ann"), (2, "bob"), (3, None)] and not back.has_changes()


def test_equal_update_changes_nothing(spark):
    assert states(users(spark).update("id = 1", {"name": "Ann"}))[1] == "UNCHANGED"


def test_added_then_deleted_then_rejected_is_gone(spark):
    t = users(spark).add_row({"id": 9, "name": "x"}).delete("id = 9").reject_changes()
    assert 9 not in states(t)


def test_deleted_rows(spark):
    t = users(spark).delete("id = 1")
    assert t.find(1) is None and t.count() == 3 and t.compute("COUNT(*)") == 2
    with pytest.raises(InvalidRowStateError):
        t.update("id = 1", {"name": "x"})
    assert t.add_row({"id": 1, "name": "again"}).find(1)["name"] == "again"


def test_edit_versions(spark):
    t = users(spark).begin_edit("id = 1", {"name": "draft"})
    assert values(t.where("proposedValues.name = 'draft'"), "id") == [(1,)]
    assert states(t.cancel_edit().end_edit())[1] == "UNCHANGED"
    t = t.end_edit()
    assert t.find(1)["name"] == "draft" and values(t.where("originalValues.name = 'Ann'"), "id") == [(1,)]
    assert values(t.where("rowState = 'MODIFIED'"), "id") == [(1,)]


# -- columns and constraints ---------------------------------------------------------------------------------------------


def test_defaults_and_computed(spark):
    t = users(spark).add_column("age", "number", default=10).add_column("shout", "string", expression="UPPER(name)").add_column("n", "any", expression=lambda r: r.age * 2)
    assert values(t, "age", "shout", "n")[0] == (10.0, "ANN", 20.0)
    t = t.add_row({"id": 7, "name": "z"})
    assert t.find(7)["age"] == 10.0
    with pytest.raises(ReadOnlyColumnError):
        t.update("id = 1", {"shout": "x"})


def test_names_fold_case(spark):
    t = users(spark)
    assert t.column_exists("NAME") and t.update("ID = 1", {"NAME": "x"}).find(1)["name"] == "x"
    with pytest.raises(SchemaMismatchError):
        t.add_column("Name", "string")
    s = Table.empty(spark, "s", [column("name", "string"), column("Name", "string")], case_sensitive=True)
    assert s.columns == ["name", "Name"]
    with pytest.raises(SchemaMismatchError):
        s.set_case_sensitive(False)


def test_constraints(spark):
    t = users(spark)
    with pytest.raises(DuplicatePrimaryKeyError):
        t.add_row({"id": 1, "name": "x"})
    with pytest.raises(ConstraintViolationError):
        t.add_row({"name": "no key"})
    u = t.add_unique_constraint(["name", "email"]).add_check_constraint("id < 100", "small")
    with pytest.raises(ConstraintViolationError):
        u.add_row({"id": 4, "name": "Ann", "email": "1@x"})
    assert u.add_row({"id": 4, "name": None, "email": "3@x"}).count() == 4
    with pytest.raises(ConstraintViolationError, match="small"):
        u.update("id = 2", {"id": 200})
    e = Table.empty(spark, "e", [column("id", "integer"), column("code", "string", unique=True, max_length=3)], "id")
    with pytest.raises(TypeMismatchError):
        e.add_row({"id": 1, "code": "long"})
    with pytest.raises(ConstraintViolationError):
        e.add_rows([{"id": 1, "code": "a"}, {"id": 2, "code": "a"}])
    with pytest.raises(TypeMismatchError):
        e.add_row({"id": "x"})
    with pytest.raises(ColumnNotFoundError):
        e.add_row({"nope": 1})


def test_composite_key(spark):
    t = Table.from_objects(spark, [{"a": 1, "b": 1, "v": "x"}, {"a": 1, "b": 2, "v": "y"}], primary_key=["a", "b"])
    assert t.find([1, 2])["v"] == "y" and t.find({"B": 1, "A": 1})["v"] == "x" and t.find([1, None]) is None


def test_schema_compare_update_and_json(spark):
    a = users(spark)
    b = Table.empty(spark, "Users", [column("id", "integer"), column("name", "integer"), column("role", "string")])
    found = a.compareSchema(b)
    assert found["missingColumns"] == ["role"] and found["extraColumns"] == ["email"] and found["typeMismatches"][0]["columnName"] == "name"
    assert a.update_schema(b, remove_extra=True).columns == ["id", "name", "role"]
    again = Table.deserialize_schema(spark, a.serialize_schema())
    assert again.columns == a.columns and again.get_primary_key() == ["id"]


# -- relational ----------------------------------------------------------------------------------------------------------


def test_joins(spark):
    a = Table.from_df(spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k long, v string"), "a")
    b = Table.from_df(spark.createDataFrame([(1, "B"), (None, "N")], "K long, v string"), "b")
    assert sorted(a.join(b, on="k").frame().collect(), key=str) == [(1, "B"), (None, "N")]
    assert sorted(a.join(b, on="k", how="left").frame().collect(), key=str) == [(1, "B"), (3, "c"), (None, "N")]
    with pytest.raises(SchemaMismatchError):
        a.join(b, on="k", how="full")
    c = Table.from_df(spark.createDataFrame([("1",)], "k string"), "c")
    with pytest.raises(SchemaMismatchError):
        a.join(c, on="k")


def test_group_distinct_union(spark):
    t = Table.from_df(spark.createDataFrame([(1, "x", None), (2, None, None), (3, "x", 5.0), (4, None, 1.0)], "id long, g string, v double"), "t", "id")
    found = {r["g"]: (r["n"], r["s"]) for r in t.group_by("g", {"n": "COUNT", "s": {"fn": "sum", "column": "v"}}).collect()}
    assert found == {"x": (2, 5.0), None: (2, 1.0)}
    assert t.compute("SUM(v)", "id < 3") is None and t.compute("sum(v)") == 6.0 and t.compute("MIN(g)") == "x"
    assert [r["id"] for r in t.distinct("g").ordered().frame().collect()] == [1, 2]
    assert t.where("id > 9").group_by([], {"n": "COUNT"}).collect() == []
    with pytest.raises(SchemaMismatchError):
        t.compute("FOO(v)")
    with pytest.raises(DuplicatePrimaryKeyError):
        t.union(t)
    assert t.union(t, primary_key=[]).count() == 8
    with pytest.raises(SchemaMismatchError):
        t.union(Table.from_df(spark.createDataFrame([(1,)], "id long"), "o"))


def test_sorts(spark):
    t = Table.from_df(spark.createDataFrame([(1, "b"), (2, "B"), (3, None), (4, "a")], "id long, s string"), "t", "id")
    ids = lambda x: [r["id"] for r in x.frame().collect()]
    assert ids(t.sort("s")) == [4, 1, 2, 3] and ids(t.sort("s", "DESC")) == [2, 1, 4, 3]
    assert ids(t.sort_multiple({"column": "s"})) == [2, 4, 1, 3]
    assert ids(t.create_view(sort="s desc")) == [3, 2, 1, 4]
    assert ids(t.create_view().order_by("id", "desc").skip(1).take(2)) == [3, 2]
    assert t.create_view().take(0).count() == 0 and t.create_view().order_by("id").row(1)["id"] == 2
    assert ids(t.create_view("id > 1").where("s", "in", ["a", "B"]).set_sort("id")) == [2, 4]


def test_empty_results_keep_their_schema(spark):
    t = users(spark).where("id > 99")
    assert t.distinct("name").columns == ["id", "name", "email"] and t.join(t, on="id").count() == 0 and t.union(t).count() == 0


# -- changes and merges --------------------------------------------------------------------------------------------------


def test_change_set_round_trip(spark):
    base = users(spark)
    t = base.update("id = 1", {"id": 10, "name": "ten"}).delete("id = 2").add_row({"id": 4, "name": "four"})
    changes = t.get_change_set()
    plain = changes.to_object()
    assert plain["count"] == 3 and plain["modified"][0]["changedColumns"] == ["id", "name"] and plain["modified"][0]["originalKey"] == {"id": 1} and plain["deleted"][0]["key"] == {"id": 2}
    for form in (changes, plain):
        out, found = base.apply_change_set(form)
        assert sorted(values(out, "id", "name")) == [(3, None), (4, "four"), (10, "ten")]
        assert outcomes(found) == {"added": 1, "modified": 1, "deleted": 1}
    local = base.update("id = 1", {"name": "mine"})
    assert sorted(values(local.apply_change_set(changes, conflict_policy="preserve")[0], "id", "name"))[0] == (1, "mine")
    with pytest.raises(SchemaMismatchError):
        local.apply_change_set(changes, conflict_policy="error")
    with pytest.raises(SchemaMismatchError):
        base.where("id = 3").apply_change_set(changes, missing_row_action="error")
    assert len(t.get_change_set(include_columns=["name"]).df.select("values.*").columns) == 1


def test_merge(spark):
    target = users(spark).update("id = 2", {"name": "local"})
    source = Table.from_objects(spark, [{"id": 1, "name": "ONE", "email": "1@x", "role": "r"}, {"id": 2, "name": "TWO", "email": "new", "role": None}, {"id": 5, "name": "five", "email": "5", "role": "z"}], table_name="Users", primary_key="id")
    out, found = target.merge(source, preserve_changes=True, missing_schema_action="add")
    assert values(out, "id", "name", "email", "role") == [(1, "ONE", "1@x", "r"), (2, "local", "new", None), (3, None, "3@x", None), (5, "five", "5", "z")]
    assert outcomes(found) == {"updated": 2, "inserted": 1} and states(out)[5] == "ADDED"
    assert "role" not in target.merge(source, missing_schema_action="ignore")[0].columns
    with pytest.raises(SchemaMismatchError):
        target.merge(source)
    again, found = out.merge(source)
    assert outcomes(again.merge(source)[1]) == {"skipped": 3}


def test_merge_rows(spark):
    out, found = users(spark).merge_rows([{"id": 1, "name": "a"}, {"id": 1, "email": "e"}, {"id": 8, "name": "h", "extra": 1}])
    assert values(out, "id", "name", "email", "extra") == [(1, "a", "e", None), (2, "bob", "2@x", None), (3, None, "3@x", None), (8, "h", None, 1)]
    assert outcomes(found) == {"updated": 1, "inserted": 1} and not out.has_changes()
    assert states(users(spark).merge_rows([{"id": 1, "name": "a"}, {"id": 2, "name": "bob"}], mark_modified=True)[0]) == {1: "MODIFIED", 2: "UNCHANGED", 3: "UNCHANGED"}
    assert users(spark).merge_rows([{"id": 8}], add_missing=False)[0].count() == 3


def test_serialisation(spark):
    t = Table.from_objects(spark, [{"id": 1, "at": dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC), "x": 1.5}, {"id": 2, "at": None, "x": 2}], primary_key="id")
    t = t.update("id = 1", {"x": 9}).delete("id = 2")
    again = Table.deserialize(spark, t.serialize())
    assert again.track().df.drop("__rid").collect() == t.df.orderBy("__rid").drop("__rid").collect()
    assert values(again.reject_changes(), "x") == [(1.5,), (2.0,)]
    rows = t.to_objects(include_deleted=True, include_row_state=True, column_name_mapping={"x": "X"}, date_mode="iso-string")
    assert rows[0]["X"] == 9.0 and rows[0]["at"] == "2024-01-02T03:04:05.000Z" and rows[1]["rowState"] == "DELETED"
    assert "Table" in repr(t) and "│ 1" in t.to_debug_string()


def test_events(spark):
    seen = []
    t = users(spark).on("rowsAdded", lambda df: seen.append(df.count()))
    t.add_row({"id": 4, "name": "x"})
    t.off("rowsAdded", t.schema.handlers["rowsAdded"][0]).add_row({"id": 5, "name": "y"})
    assert seen == [1]


# -- data sets -----------------------------------------------------------------------------------------------------------


def family(spark, rule):
    d = DataSet("d")
    d.add_table(Table.from_objects(spark, [{"id": 1}, {"id": 2}], table_name="P", primary_key="id"))
    d.add_table(Table.from_objects(spark, [{"id": 1, "p": 1}, {"id": 2, "p": 2}, {"id": 3, "p": None}], table_name="C", primary_key="id"))
    d.add_table(Table.from_objects(spark, [{"id": 1, "c": 1}, {"id": 2, "c": 2}], table_name="G", primary_key="id"))
    d.add_relation("pc", "P", "C", "id", "p")
    d.add_relation("cg", "C", "G", "id", "c")
    d.add_foreign_key_constraint("pc", rule, rule)
    d.add_foreign_key_constraint("cg", rule, rule)
    return d


def test_foreign_keys(spark):
    d = family(spark, "cascade").delete("P", "id = 1")
    assert states(d.table("C")) == {1: "DELETED", 2: "UNCHANGED", 3: "UNCHANGED"} and states(d.table("G")) == {1: "DELETED", 2: "UNCHANGED"}
    with pytest.raises(ConstraintViolationError):
        family(spark, "restrict").delete("P", "id = 1")
    d = family(spark, "setnull").delete("P", "id = 2")
    assert values(d.table("C"), "p") == [(1,), (None,), (None,)]
    d = family(spark, "cascade").update_key("P", "id = 1", {"id": 7})
    assert values(d.table("C"), "id", "p")[0] == (1, 7)
    d.replace_table(d.table("P").remove("id = 2"))
    assert [r["id"] for r in d.orphans("pc").collect()] == [2]
    with pytest.raises(ConstraintViolationError):
        d.validate()
    assert [r["id"] for r in family(spark, "cascade").get_child_rows({"id": 1}, "pc").frame().collect()] == [1]
    assert family(spark, "cascade").get_parent_row({"p": 2}, "pc")["id"] == 2


def test_cascade_follows_a_table_to_its_depth(spark):
    def staff(rule):
        d = DataSet("d")
        d.add_table(Table.from_objects(spark, [{"id": i, "boss": i - 1 if i > 1 else None} for i in range(1, 9)] + [{"id": 20, "boss": None}], table_name="E", primary_key="id"))
        d.add_table(Table.from_objects(spark, [{"id": 1, "e": 8}], table_name="T", primary_key="id"))
        d.add_relation("ee", "E", "E", "id", "boss")
        d.add_relation("et", "E", "T", "id", "e")
        d.add_foreign_key_constraint("ee", "cascade")
        d.add_foreign_key_constraint("et", rule)
        return d

    d = staff("setnull").delete("E", "id = 1")
    assert states(d.table("E")) == dict.fromkeys(range(1, 9), "DELETED") | {20: "UNCHANGED"}
    assert values(d.table("T"), "id", "e") == [(1, None)]
    with pytest.raises(ConstraintViolationError):
        staff("restrict").delete("E", "id = 1")


def test_data_set_round_trip(spark):
    d = family(spark, "cascade").delete("P", "id = 1")
    again = DataSet.deserialize(spark, d.serialize())
    assert again.change_count() == d.change_count() == 3 and [r.name for r in again.relations] == ["pc", "cg"]
    other = family(spark, "cascade")
    other.apply_change_set(d.get_change_set())
    assert states(other.table("G"))[1] == "DELETED"
    merged = DataSet("m")
    merged.merge(d, missing_schema_action="add")
    assert sorted(merged.tables) == ["C", "G", "P"] and len(merged.relations) == 2


# -- loading -------------------------------------------------------------------------------------------------------------


def test_result_shapes(spark):
    pg = Table.from_query_result(spark, {"rows": [{"id": 1, "name": "a"}], "fields": [{"name": "id", "dataTypeID": 23}, {"name": "name", "dataTypeID": 1043}]})
    assert [pg.column(c).tag for c in pg.columns] == ["integer", "string"]
    my = Table.from_query_result(spark, [[{"id": 1, "f": 1}], [{"name": "id", "columnType": 3}, {"name": "f", "columnType": 1, "columnLength": 1}]])
    assert [my.column(c).tag for c in my.columns] == ["integer", "boolean"] and my.rows(0)["f"] is True
    assert Table.from_query_result(spark, {"recordset": [{"a": 1}], "recordsets": [[{"a": 1}], [{"b": 2}]]}).columns == ["a"]
    assert Table.from_query_result(spark, {"data": {"items": [{"a": 1}]}}, rows_path="data.items").count() == 1
    assert Table.from_query_result(spark, {"data": {"items": [{"a": 1}]}}).count() == 1
    lite = Table.from_query_result(spark, {"rows": [[1, "Mario"]], "columns": [{"name": "id", "type": "INTEGER"}, {"name": "name", "type": "TEXT"}]}, provider="sqlite")
    assert lite.rows(0).asDict() == {"id": 1, "name": "Mario"}
    ora = Table.from_query_result(spark, {"rows": [[1]], "metaData": [{"name": "USER_ID", "dbTypeName": "NUMBER", "nullable": False}]}, column_name_transform="camelCase")
    assert ora.columns == ["userId"] and not ora.column("userId").allow_null
    js = Table.from_query_result(spark, results.ResultRows([{"id": 1}], columns=[{"name": "id", "type": 23}]), provider="postgres")
    assert js.column("id").tag == "integer"
    with pytest.raises(SchemaMismatchError):
        Table.from_query_result(spark, {"nothing": 1})
    d = DataSet.from_query_result(spark, {"recordsets": [[{"a": 1}], [{"b": 2}]]}, table_names=["X"])
    assert sorted(d.tables) == ["Table1", "X"]


def test_load_options(spark):
    rows = [{"user_id": 1, "full_name": "A", "skip": 0, "created_at": "2024-01-01T00:00:00Z"}]
    t = Table.from_objects(spark, rows, rename_columns={"user_id": "id"}, exclude_columns=["skip"], columns={"created_at": "date"}, column_name_transform="camelCase")
    assert t.columns == ["id", "fullName", "createdAt"] or t.columns == ["id", "fullName", "createdAt", "created_at"]
    base = Table.from_objects(spark, [{"id": 1, "name": "a"}], primary_key="id")
    assert base.load_rows([{"id": 2, "name": "b", "extra": True}]).columns == ["id", "name", "extra"]
    assert base.load_rows([{"id": 2, "extra": 1}], ignore_extra_columns=True).columns == ["id", "name"]
    with pytest.raises(SchemaMismatchError):
        base.load_rows([{"id": 2, "extra": 1}], throw_on_extra_columns=True)
    assert base.load_rows([{"id": 2}], clear_before_load=True).count() == 1 and base.load_rows([{"id": 2}], append=False).count() == 1
    assert base.load_rows([{"id": 2, "name": "b"}], row_state="added").has_changes()
    with pytest.raises(TypeMismatchError):
        base.load_rows([{"id": "x"}], strict=True)
    assert base.load_rows([{"id": "x"}], primary_key=None).column("id").tag == "any"
    with pytest.raises(SchemaMismatchError):
        Table.from_objects(spark, [])
    assert base.load_from_query([]).count() == 1 and base.load_from_query(lambda: [{"id": 9}]).rows(0)["id"] == 9


@pytest.mark.parametrize("local", [True, False])
def test_values_that_do_not_fit_widen_their_column(spark, local):
    base = Table.from_objects(spark, [{"id": 1, "n": 5, "m": 7, "at": dt.datetime(2024, 1, 2, tzinfo=dt.UTC)}], table_name="t")
    for n, m, kind in (("x", 1, "n string, m long"), ("2", 1.5, "n string, m double"), ("2", 4.0, "n string, m double")):
        rows = [{"id": 2, "n": n, "m": m}, {"id": 3, "n": None, "m": None}]
        found = base.load_rows(rows if local else spark.createDataFrame([tuple(r.values()) for r in rows], f"id long, {kind}"))
        wide = ("any" if n == "x" else "integer", "any" if m == 1.5 else "integer")
        assert (found.column("n").tag, found.column("m").tag) == wide and found.column("at").tag == "date"
        want = [("5", "7"), (n, str(m)), (None, None)]
        got = [(r["n"], r["m"]) for r in found.frame().orderBy("id").collect()]
        assert got == [tuple(v if v is None or w == "any" else int(float(v)) for v, w in zip(r, wide, strict=True)) for r in want]


def test_inference(spark):
    t = Table.from_objects(spark, [{"i": 1, "n": 1, "b": True, "m": 1, "o": {"a": 1}, "l": [1, 2]}, {"i": 2.0, "n": 1.5, "b": None, "m": "x", "o": {}, "l": []}])
    assert {c: t.column(c).tag for c in t.columns} == {"i": "integer", "n": "number", "b": "boolean", "m": "any", "o": "object", "l": "array"}
    assert t.add_column("oa", "integer", expression="o.a").rows(0)["oa"] == 1


def test_streaming_upsert(spark, tmp_path):
    from tabulon.streaming.upsert import StreamingUpsert

    source = tmp_path / "in"
    spark.createDataFrame([(1, "new", 1), (1, "newer", 2), (7, "seven", 1)], "id long, name string, at long").write.parquet(str(source))
    sink = StreamingUpsert(users(spark), str(tmp_path / "out"), order_by="at")
    stream = spark.readStream.schema("id long, name string, at long").parquet(str(source)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted((r["id"], r["name"]) for r in sink.table.frame().collect()) == [(1, "newer"), (2, "bob"), (3, None), (7, "seven")]


# -- rules that merges keep ----------------------------------------------------------------------------------------------


def test_merge_of_rows_that_repeat_a_key(spark):
    target = Table.from_objects(spark, [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}], table_name="t", primary_key="id")
    source = Table.from_objects(spark, [{"id": 1, "v": "x"}, {"id": 1, "v": "y"}, {"id": 9, "v": "p"}, {"id": 9, "v": "q"}], table_name="t")
    out, found = target.merge(source)
    assert values(out, "id", "v") == [(1, "y"), (2, "b"), (9, "q")] and outcomes(found) == {"updated": 1, "inserted": 1, "superseded": 2}
    kept, _ = target.merge(source, preserve_changes=True)
    assert values(kept, "id", "v") == [(1, "x"), (2, "b"), (9, "p")]
    with pytest.raises(DuplicatePrimaryKeyError):
        target.merge_rows(source.frame())
    assert values(target.merge_rows(source.df, order_by="__rid")[0], "id", "v") == [(1, "y"), (2, "b"), (9, "q")]


def test_a_row_that_the_last_one_restores_is_updated(spark):
    target = Table.from_objects(spark, [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}, {"id": 3, "v": None}], table_name="t", primary_key="id")
    source = Table.from_objects(spark, [{"id": 1, "v": "x"}, {"id": 1, "v": "a"}, {"id": 2, "v": "b"}, {"id": 2, "v": "b"}, {"id": 3, "v": "c"}, {"id": 3, "v": None}], table_name="t")
    out, found = target.merge(source)
    assert values(out, "id", "v") == [(1, "a"), (2, "b"), (3, None)] and states(out) == {1: "MODIFIED", 2: "UNCHANGED", 3: "MODIFIED"}
    assert outcomes(found) == {"updated": 2, "skipped": 1, "superseded": 3}


def test_merge_outcomes_lists_outcomes_without_rows(spark, tmp_path):
    spark.createDataFrame([(2, "a", 1, 5.0, "s")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, 7.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert outcomes(queries_rules.merge_outcomes(spark, str(tmp_path))) == {"superseded": 0, "inserted": 0, "updated": 1}


def test_merges_keep_constraints(spark):
    t = Table.from_objects(spark, [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}], table_name="t", primary_key="id").add_unique_constraint("v")
    bad = Table.from_objects(spark, [{"id": 3, "v": "b"}], table_name="t", primary_key="id")
    for action in (lambda: t.merge(bad), lambda: t.merge_rows([{"id": 1, "v": "b"}]), lambda: t.apply_change_set(bad.clear().add_row({"id": 3, "v": "b"}).get_change_set())):
        with pytest.raises(ConstraintViolationError):
            action()
    assert t.merge(bad, validate=False)[0].count() == 3
    moved = t.update("id = 1", {"id": 3, "v": "c"}).get_change_set()
    with pytest.raises(DuplicatePrimaryKeyError):
        t.apply_change_set({"modified": [{"state": "MODIFIED", "key": {"id": 7}, "originalKey": {"id": 1}, "values": {"id": 2, "v": "q"}}]})
    assert values(t.apply_change_set(moved)[0], "id", "v") == [(3, "c"), (2, "b")]
    loading = t.begin_load_data().merge_rows([{"id": 1, "v": "b"}])[0]
    with pytest.raises(ConstraintViolationError):
        loading.end_load_data()
    with pytest.raises(ConstraintViolationError):
        t.merge(Table.from_objects(spark, [{"id": None, "v": "n"}, {"id": 4, "v": "m"}], table_name="t"))
    with pytest.raises(SchemaMismatchError):
        t.merge(Table.from_objects(spark, [{"v": "n"}], table_name="t"))


def test_added_columns_keep_their_rules(spark):
    source = Table.from_objects(spark, [{"id": 1}], table_name="t", primary_key="id").add_column("code", "string", max_length=3, unique=True, default="x").add_column("twice", "integer", expression="id * 2")
    out, _ = Table.from_objects(spark, [{"id": 2}], table_name="t", primary_key="id").merge(source, missing_schema_action="add", validate=False)
    assert out.column("code").max_length == 3 and out.column("code").unique and sorted(r["twice"] for r in out.frame().collect()) == [2, 4]


def test_functions_that_are_no_columns_run_in_python(spark):
    t = users(spark).add_column("size", "integer", expression=lambda r: len(r.name or ""))
    assert sorted(r["id"] for r in t.select(lambda r: r.name is not None and r.name.lower() in ("ann", "bob")).frame().collect()) == [1, 2]
    assert sorted(r["size"] for r in t.frame().collect()) == [0, 3, 3]
    with pytest.raises(ConstraintViolationError):
        t.add_check_constraint(lambda r: len(r["NAME"] or "") > 0 and r.id > 0)


def test_loads_from_frames_and_awaitables(spark):
    async def later():
        return [{"id": 7, "name": "g", "email": None}]

    t = users(spark)
    assert values(t.load_from_query(t.where("id = 2").frame()), "id") == [(2,)]
    assert values(t.load_from_query(later), "id") == [(7,)] and t.load_from_query([]) is t
    assert results.extract_rows({"rows": [{"a": 1}]}) == [{"a": 1}] and results.extract_recordsets({"recordsets": [[{"a": 1}], [{"a": 2}]]}) == [[{"a": 1}], [{"a": 2}]]


def test_events_come_before_and_after_and_may_prevent(spark):
    seen = []

    def refuse(_):
        raise InvalidRowStateError("no")

    t = users(spark)
    for name in ("rowsRemoving", "rowsRemoved", "tableClearing", "tableCleared", "columnChanging", "columnChanged"):
        t = t.on(name, lambda _, n=name: seen.append(n))
    t.remove("id = 1").clear()
    t.update("id = 2", {"name": "x"})
    assert seen == ["rowsRemoving", "rowsRemoved", "tableClearing", "tableCleared", "columnChanging", "columnChanged"]
    with pytest.raises(InvalidRowStateError):
        t.on("rowsRemoving", refuse).remove("id = 1")


def test_versions_of_one_value(spark):
    t = users(spark).update("id = 1", {"name": "new"}).begin_edit("id = 2", {"name": "proposed"})
    assert (t.get(1, "name"), t.get(1, "name", "original"), t.get(2, "name"), t.get(2, "name", "proposed"), t.get(99, "name")) == ("new", "Ann", "bob", "proposed", None)


def test_children_need_parents(spark):
    d = family(spark, "cascade")
    with pytest.raises(ConstraintViolationError):
        d.add_rows("C", [{"id": 50, "p": 99}])
    with pytest.raises(ConstraintViolationError):
        d.update("C", "id = 1", {"p": 99})
    assert d.table("C").count() == family(spark, "cascade").table("C").count()


def test_written_data_set_is_read_again(spark, tmp_path):
    d = family(spark, "cascade").delete("P", "id = 1")
    d.write(str(tmp_path / "set"))
    again = DataSet.read(spark, str(tmp_path / "set"))
    assert again.change_count() == d.change_count() and [k.delete_rule for k in again.foreign_keys] == [k.delete_rule for k in d.foreign_keys]
    assert states(again.table("G")) == states(d.table("G"))


def test_the_engine_stands_without_the_optional_packages(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tabulon", tmp_path / "tabulon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
