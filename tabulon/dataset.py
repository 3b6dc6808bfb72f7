"""DataSet: tables by name, relations between them, foreign keys, and whole-set merge, changes and serialisation."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import ConstraintViolationError, SchemaMismatchError
from tabulon.operators.tracking import DELETED, STATE, ChangeSet, track, value_column
from tabulon.schema import TableSchema
from tabulon.table import Table, snake

RULES = ("restrict", "cascade", "setnull")
#: The folder of a written set's manifest.
MANIFEST = "manifest_table"
#: Levels of a cascade after which the plan is cut.
LEVELS = 3


@dataclass(frozen=True)
class Relation:
    name: str
    parent_table: str
    parent_column: str
    child_table: str
    child_column: str


@dataclass(frozen=True)
class ForeignKey:
    name: str
    relation: str
    delete_rule: str = "restrict"
    update_rule: str = "restrict"


class DataSet:
    """Holds the current version of each table; operations on rows go through it where relations matter."""

    def __init__(self, name: str = "DataSet"):
        self.name = name
        self.tables: dict[str, Table] = {}
        self.relations: list[Relation] = []
        self.foreign_keys: list[ForeignKey] = []
        self.enforce_constraints = True

    # -- tables and relations ------------------------------------------------------------------------------------------

    def add_table(self, table: Table, register: bool = False) -> Table:
        if table.name in self.tables or table.name == MANIFEST:
            raise SchemaMismatchError(f"data set {self.name!r} has a table {table.name!r} already")
        self.tables[table.name] = table
        if register:
            table.frame().createOrReplaceTempView(table.name)
        return table

    def replace_table(self, table: Table) -> Table:
        self.table(table.name)
        self.tables[table.name] = table
        return table

    def remove_table(self, name: str) -> None:
        self.table(name)
        del self.tables[name]
        for r in [r for r in self.relations if name in (r.parent_table, r.child_table)]:
            self.remove_relation(r.name)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise SchemaMismatchError(f"data set {self.name!r} has no table {name!r}")
        return self.tables[name]

    def has_table(self, name: str) -> bool:
        return name in self.tables

    def add_relation(self, name: str, parent_table: str, child_table: str, parent_column: str, child_column: str) -> Relation:
        if any(r.name == name for r in self.relations):
            raise SchemaMismatchError(f"there is a relation {name!r} already")
        found = Relation(name, parent_table, self.table(parent_table).schema[parent_column].name, child_table, self.table(child_table).schema[child_column].name)
        self.relations.append(found)
        return found

    def remove_relation(self, name: str) -> None:
        self.get_relation(name)
        self.relations = [r for r in self.relations if r.name != name]
        self.foreign_keys = [k for k in self.foreign_keys if k.relation != name]

    def get_relation(self, name: str) -> Relation:
        found = next((r for r in self.relations if r.name == name), None)
        if found is None:
            raise SchemaMismatchError(f"data set {self.name!r} has no relation {name!r}")
        return found

    def get_relations(self, table: str) -> list[Relation]:
        return [r for r in self.relations if table in (r.parent_table, r.child_table)]

    def get_child_rows(self, parent: object, relation: str) -> Table:
        """Children of one parent row, or of a whole parent table (a semi-join); deleted children are seen."""
        r = self.get_relation(relation)
        child = self.table(r.child_table)
        if isinstance(parent, Table):
            keys = parent.df.select(F.col(f"`{r.parent_column}`").alias("__p")).distinct()
            return child.over(child.df.join(keys, F.col(f"`{r.child_column}`").eqNullSafe(F.col("__p")), "left_semi"))
        return child.where({r.child_column: _value(parent, r.parent_column)})

    def get_parent_row(self, child: object, relation: str):
        r = self.get_relation(relation)
        return self.table(r.parent_table).find_one({r.parent_column: _value(child, r.child_column)})

    def with_parents(self, relation: str) -> DataFrame:
        """Every child row with its first parent's columns (``parent_*``)."""
        r = self.get_relation(relation)
        parent = self.table(r.parent_table).distinct(r.parent_column).frame()
        parent = parent.select(*[F.col(f"`{c}`").alias(f"parent_{c}") for c in parent.columns])
        return self.table(r.child_table).frame().join(parent, F.col(f"`{r.child_column}`").eqNullSafe(F.col(f"`parent_{r.parent_column}`")), "left")

    def is_valid(self, relation: str, parent: object, child: object) -> bool:
        r = self.get_relation(relation)
        return _value(parent, r.parent_column) == _value(child, r.child_column)

    # -- foreign keys --------------------------------------------------------------------------------------------------

    def add_foreign_key_constraint(self, relation: str, delete_rule: str = "restrict", update_rule: str = "restrict", name: str | None = None) -> ForeignKey:
        for rule in (delete_rule, update_rule):
            if rule.lower() not in RULES:
                raise SchemaMismatchError(f"unknown rule {rule!r}")
        found = ForeignKey(name or f"FK_{self.get_relation(relation).name}", relation, delete_rule.lower(), update_rule.lower())
        self.foreign_keys.append(found)
        return found

    def get_foreign_key_constraints(self) -> list[ForeignKey]:
        return list(self.foreign_keys)

    def orphans(self, relation: str) -> DataFrame:
        """Child rows whose key is not null and has no parent row that is not deleted."""
        r = self.get_relation(relation)
        parents = self.table(r.parent_table).live().df.select(F.col(f"`{r.parent_column}`").alias("__p"))
        child = self.table(r.child_table).live()
        own = F.col(f"`{r.child_column}`")
        return child.over(child.df.where(own.isNotNull()).join(parents, own == F.col("__p"), "left_anti")).frame()

    def validate(self) -> DataSet:
        for t in self.tables.values():
            t.validate()
        for key in self.foreign_keys if self.enforce_constraints else ():
            if self.orphans(key.relation).limit(1).take(1):
                raise ConstraintViolationError(f"foreign key {key.name!r}: a child has no parent")
        return self

    def add_rows(self, table: str, rows: object, **options: object) -> DataSet:
        """Adds rows to a table; a child whose key has no parent raises and leaves the set as it was."""
        return self._checked(self.table(table).add_rows(rows, **options), None)  # type: ignore[arg-type]

    def update(self, table: str, where: object, values: Mapping[str, object], validate: bool = True) -> DataSet:
        """Sets columns of a table: keys of children are looked up, and changed keys of parents follow the update rules."""
        t = self.table(table)
        names = {t.schema[n].name for n in values}
        if self.enforce_constraints and any(r.parent_table == table and r.parent_column in names for r in map(self.get_relation, {k.relation for k in self.foreign_keys})):
            return self.update_key(table, where, values)
        return self._checked(t.update(where, values, validate), names)

    def _checked(self, changed: Table, names: set[str] | None) -> DataSet:
        for key in self.foreign_keys if self.enforce_constraints else ():
            r = self.get_relation(key.relation)
            if r.child_table != changed.name or names is not None and r.child_column not in names:
                continue
            own = F.col(f"`{r.child_column}`")
            parents = (changed if r.parent_table == changed.name else self.table(r.parent_table)).live().df.select(F.col(f"`{r.parent_column}`").alias("__p"))
            fresh = changed.df.where(F.col(STATE).isin("ADDED", "MODIFIED") & own.isNotNull()).select(own.alias("__c")).distinct()
            if fresh.join(parents, F.col("__c") == F.col("__p"), "left_anti").limit(1).take(1):
                raise ConstraintViolationError(f"foreign key {key.name!r}: a row of {changed.name!r} has no parent")
        self.tables[changed.name] = changed
        return self

    def begin_load_data(self) -> DataSet:
        """Constraints of the set and its tables rest until ``end_load_data``, which checks them all once."""
        self.enforce_constraints = False
        self.tables = {n: t.begin_load_data() for n, t in self.tables.items()}
        return self

    def end_load_data(self) -> DataSet:
        self.tables = {n: t.end_load_data() for n, t in self.tables.items()}
        self.enforce_constraints = True
        return self.validate()

    def delete(self, table: str, where: object) -> DataSet:
        """Deletes rows; delete rules act on their children, level by level until nothing new is deleted."""
        before = track(self.table(table))
        hit = F.coalesce(before.condition(where), F.lit(False)) & (F.col(STATE) != DELETED)
        self._deleted({table: before.over(before.df.where(hit))}, {table: before.delete(where)})
        return self

    def _deleted(self, gone: dict[str, Table], now: dict[str, Table]) -> None:
        level, depth = gone, 0
        while True:  # each level deletes rows that were not deleted before, so there is a last one
            following: dict[str, Table] = {}
            for key in self.foreign_keys if self.enforce_constraints else ():
                r = self.get_relation(key.relation)
                if r.parent_table not in level:
                    continue
                child = track(now.get(r.child_table, self.table(r.child_table)))
                keys = level[r.parent_table].df.select(F.col(f"`{r.parent_column}`").alias("__p")).where("__p IS NOT NULL").distinct()
                met = child.over(child.df.where(F.col(STATE) != DELETED).join(keys, F.col(f"`{r.child_column}`") == F.col("__p"), "left_semi"))
                if not met.df.limit(1).take(1):
                    continue
                if key.delete_rule == "restrict":
                    raise ConstraintViolationError(f"foreign key {key.name!r}: rows of {r.child_table!r} refer to a deleted row")
                marked = child.df.join(keys.withColumn("__hit", F.lit(True)), F.col(f"`{r.child_column}`") == F.col("__p"), "left").drop("__p")
                flagged = child.over(marked)
                own = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col(STATE) != DELETED)
                if key.delete_rule == "cascade":
                    changed = _hidden(flagged, flagged.delete(own))
                    earlier = following.get(r.child_table)
                    following[r.child_table] = met if earlier is None else earlier.over(earlier.df.unionByName(met.df))
                else:
                    changed = _hidden(flagged, flagged.update(own, {r.child_column: None}, validate=False))
                now[r.child_table] = child.over(changed)
            if not following:
                break
            level, depth = following, depth + 1
            if depth % LEVELS == 0:
                level, now = {n: _cut(t) for n, t in level.items()}, {n: _cut(t) for n, t in now.items()}
        for name, t in now.items():
            self.tables[name] = t

    def update_key(self, table: str, where: object, values: Mapping[str, object]) -> DataSet:
        """Updates parent rows; update rules carry changed keys to the children."""
        before = track(self.table(table))
        after = before.update(where, values)
        now = {table: after}
        for key in self.foreign_keys if self.enforce_constraints else ():
            r = self.get_relation(key.relation)
            if r.parent_table != table or not any(before.schema[n].name == r.parent_column for n in values):
                continue
            given = next(v for n, v in values.items() if before.schema[n].name == r.parent_column)
            hit = F.coalesce(before.condition(where), F.lit(False)) & (F.col(STATE) != DELETED)
            moves = before.df.where(hit).select(F.col(f"`{r.parent_column}`").alias("__old"), value_column(before, r.parent_column, given).alias("__new"))
            moves = moves.where(~F.col("__old").eqNullSafe(F.col("__new"))).distinct()
            child = track(now.get(r.child_table, self.table(r.child_table)))
            joined = child.df.join(moves.withColumn("__hit", F.lit(True)), F.col(f"`{r.child_column}`") == F.col("__old"), "left")
            flagged = child.over(joined)
            own = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col(STATE) != DELETED)
            if key.update_rule == "restrict":
                if joined.where(own).limit(1).take(1):
                    raise ConstraintViolationError(f"foreign key {key.name!r}: rows of {r.child_table!r} refer to a changed key")
                continue
            value = F.col("__new") if key.update_rule == "cascade" else F.lit(None)
            now[r.child_table] = child.over(_hidden(flagged, flagged.update(own, {r.child_column: value}, validate=False)))
        self.tables.update(now)
        return self

    # -- whole sets ----------------------------------------------------------------------------------------------------

    @staticmethod
    def from_recordsets(spark: SparkSession, recordsets: Sequence[Sequence[object]], table_names: Sequence[str] | None = None, table_options: Sequence[Mapping] | Mapping | None = None, relations: Sequence[Mapping] = (), name: str = "DataSet", **options: object) -> DataSet:
        out = DataSet(name)
        for i, rows in enumerate(recordsets):
            title = table_names[i] if table_names and i < len(table_names) else f"Table{i}"
            own = table_options.get(title, {}) if isinstance(table_options, Mapping) else table_options[i] if table_options and i < len(table_options) else {}
            out.add_table(Table.from_objects(spark, rows, **{**options, **own, "table_name": title}))
        for r in relations:
            plain = {snake(k): v for k, v in r.items()}
            out.add_relation(plain.get("name") or plain["relation_name"], plain["parent_table"], plain["child_table"], plain["parent_column"], plain["child_column"])
        return out

    @staticmethod
    def from_query_result(spark: SparkSession, result: object, **options: object) -> DataSet:
        from tabulon.sources import results

        return DataSet.from_recordsets(spark, results.map_result(result).recordsets, **options)  # type: ignore[arg-type]

    def clear(self) -> DataSet:
        self.tables = {n: t.clear() for n, t in self.tables.items()}
        return self

    def clone(self) -> DataSet:
        out = DataSet(self.name)
        out.tables = {n: t.clone() for n, t in self.tables.items()}
        out.relations, out.foreign_keys, out.enforce_constraints = list(self.relations), list(self.foreign_keys), self.enforce_constraints
        return out

    def merge(self, source: DataSet | Table, preserve_changes: bool = False, missing_schema_action: str = "error") -> dict[str, DataFrame]:
        """Merges table by table; the outcomes of each."""
        action = missing_schema_action.lower()
        outcomes = {}
        for t in [source] if isinstance(source, Table) else source.tables.values():
            if t.name not in self.tables:
                if action == "error":
                    raise SchemaMismatchError(f"data set {self.name!r} has no table {t.name!r}")
                if action == "add":
                    self.tables[t.name] = t.clone()
                continue
            self.tables[t.name], outcomes[t.name] = self.tables[t.name].merge(t, preserve_changes, missing_schema_action)
        for r in source.relations if isinstance(source, DataSet) and action == "add" else ():
            mine = next((x for x in self.relations if x.name == r.name), None)
            if mine is not None and mine != r:
                raise SchemaMismatchError(f"relation {r.name!r} differs")
            if mine is None and r.parent_table in self.tables and r.child_table in self.tables:
                self.relations.append(r)
        return outcomes

    def get_change_set(self, include_unchanged_tables: bool = False, **options: object) -> dict[str, ChangeSet]:
        found = {n: t.get_change_set(**options) for n, t in self.tables.items() if t.tracked or include_unchanged_tables}
        return found if include_unchanged_tables else {n: c for n, c in found.items() if c.has_changes()}

    def change_count(self) -> int:
        return sum(c.count() for c in self.get_change_set().values())

    def has_changes(self) -> bool:
        return any(t.has_changes() for t in self.tables.values())

    def get_commands(self) -> dict[str, dict[str, DataFrame]]:
        return {n: t.get_commands() for n, t in self.tables.items() if t.tracked}

    def apply_change_set(self, changes: Mapping[str, object], missing_table_action: str = "ignore", **options: object) -> dict[str, DataFrame]:
        outcomes = {}
        for name, own in changes.items():
            if name not in self.tables:
                if missing_table_action == "error":
                    raise SchemaMismatchError(f"data set {self.name!r} has no table {name!r}")
                continue
            self.tables[name], outcomes[name] = self.tables[name].apply_change_set(own, **options)
        return outcomes

    def accept_changes(self) -> DataSet:
        self.tables = {n: t.accept_changes() for n, t in self.tables.items()}
        return self

    def reject_changes(self) -> DataSet:
        self.tables = {n: t.reject_changes() for n, t in self.tables.items()}
        return self

    def get_schema(self) -> dict:
        return {"dataSetName": self.name, "tables": [t.export_schema() for t in self.tables.values()], "relations": [vars(r) for r in self.relations]}

    def serialize(self) -> str:
        from tabulon import sinks

        return json.dumps({**self.get_schema(), "tables": [sinks.serialize(t) for t in self.tables.values()], "foreignKeys": [vars(k) for k in self.foreign_keys], "enforceConstraints": self.enforce_constraints})

    to_json = serialize

    @staticmethod
    def deserialize(spark: SparkSession, data: str | Mapping) -> DataSet:
        found = json.loads(data) if isinstance(data, str) else data
        out = DataSet(found["dataSetName"])
        for t in found["tables"]:
            out.add_table(Table.deserialize(spark, t))
        out.relations = [Relation(**r) for r in found["relations"]]
        out.foreign_keys = [ForeignKey(**k) for k in found["foreignKeys"]]
        out.enforce_constraints = found["enforceConstraints"]
        return out

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """One Parquet folder a table, hidden columns included; the manifest is a table too."""
        for n, t in self.tables.items():
            track(t).df.write.mode(mode).parquet(f"{path}/{n}")
        manifest = json.dumps({"schemas": {n: t.schema.to_dict() for n, t in self.tables.items()}, "name": self.name, "relations": [vars(r) for r in self.relations], "foreignKeys": [vars(k) for k in self.foreign_keys], "enforceConstraints": self.enforce_constraints}, default=str)
        spark = next(iter(self.tables.values())).spark
        spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode(mode).parquet(f"{path}/{MANIFEST}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataSet:
        """The set that ``write`` has written, states and versions included; nothing but the manifest is read before an action."""
        found = json.loads(spark.read.parquet(f"{path}/{MANIFEST}").first()["manifest"])
        out = DataSet(found["name"])
        for name, schema in found["schemas"].items():
            out.add_table(Table(spark.read.parquet(f"{path}/{name}"), TableSchema.from_dict(schema), tracked=True))
        out.relations = [Relation(**r) for r in found["relations"]]
        out.foreign_keys = [ForeignKey(**k) for k in found["foreignKeys"]]
        out.enforce_constraints = found["enforceConstraints"]
        return out

    def to_debug_view(self, rows: int = 10) -> dict:
        return {"type": "DataSet", "dataSetName": self.name, "tables": [t.to_debug_view(rows) for t in self.tables.values()], "relations": [vars(r) for r in self.relations]}

    def __getattr__(self, name: str):
        plain = snake(name)
        if plain != name and not name.startswith("_") and hasattr(type(self), plain):
            return getattr(self, plain)
        raise AttributeError(f"DataSet has no attribute {name!r}")


def _cut(t: Table) -> Table:
    """The same rows without the plan that led to them, by a checkpoint in the folder that all executors share: that of
    spark.checkpoint.dir, or, only where that is unset and all runs in one process, a temporary one."""
    sc = t.spark.sparkContext
    if not sc.getCheckpointDir():
        folder = t.spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabulon-checkpoint-"))
    return t.over(t.df.checkpoint())


def _hidden(flagged: Table, changed: Table) -> DataFrame:
    """Without the helper columns that a rule needed."""
    return changed.df.drop("__hit", "__p", "__old", "__new")


def _value(row: object, name: str) -> object:
    found = row.asDict() if hasattr(row, "asDict") else row
    return next((v for k, v in found.items() if k.lower() == name.lower()), None)  # type: ignore[union-attr]
