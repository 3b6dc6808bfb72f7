"""Typed, relational, change-tracked tables on Spark DataFrames."""

from tabulon.dataset import DataSet, ForeignKey, Relation
from tabulon.operators.tracking import ChangeSet
from tabulon.schema import ColumnSpec, TableSchema, column
from tabulon.table import Table
from tabulon.view import View

__all__ = ["ChangeSet", "ColumnSpec", "DataSet", "ForeignKey", "Relation", "Table", "TableSchema", "View", "column"]
