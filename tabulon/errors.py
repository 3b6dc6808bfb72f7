"""Errors of the engine; all derive from TableError."""


class TableError(Exception):
    """Base of all errors raised here."""


class ColumnNotFoundError(TableError):
    def __init__(self, column: str, table: str | None = None):
        super().__init__(f"no column {column!r}" + (f" in table {table!r}" if table else ""))
        self.column, self.table = column, table


class TypeMismatchError(TableError):
    """A value does not fit its column's type."""


class ConstraintViolationError(TableError):
    """A constraint does not hold."""


class DuplicatePrimaryKeyError(ConstraintViolationError):
    """A primary key occurs twice or has a null component."""


class ReadOnlyColumnError(ConstraintViolationError):
    """A read-only or computed column was written."""


class InvalidRowStateError(TableError):
    """The operation is not allowed in a row's state."""


class SchemaMismatchError(TableError):
    """Schemas, keys or arguments do not fit each other."""
