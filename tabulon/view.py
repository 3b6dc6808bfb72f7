"""View: filters, then sorts, then skip and take, whatever order they are set in; lazy, over one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Row
from pyspark.sql import functions as F

from tabulon.functions.criteria import compare
from tabulon.operators.relational import descending, parse_sort, sort_key
from tabulon.operators.tracking import STATE
from tabulon.table import Table, snake


def _whole(n: object) -> int:
    try:
        return max(0, int(float(n)))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return 0


class View:
    def __init__(self, table: Table, filters: tuple = (), sorts: tuple = (), skipped: int = 0, taken: int | None = None):
        self.source, self.filters, self.sorts, self.skipped, self.taken = table, filters, sorts, skipped, taken

    def _with(self, **changes: object) -> View:
        return View(**({"table": self.source, "filters": self.filters, "sorts": self.sorts, "skipped": self.skipped, "taken": self.taken} | changes))  # type: ignore[arg-type]

    def set_filter(self, where: object) -> View:
        """Replaces all filters."""
        return self._with(filters=() if where is None else (self.source.condition(where),))

    filter = set_filter

    def where(self, name: str, op: str, value: object) -> View:
        """Adds a filter."""
        return self._with(filters=(*self.filters, compare(self.source.resolve(name), op, value)))

    def set_sort(self, sort: str | Callable | None, order: str = "asc") -> View:
        """Replaces all sorts: ``"a ASC, b DESC"``, a column with an order, or a key function."""
        if sort is None:
            return self._with(sorts=())
        if callable(sort):
            key = sort(self.source.accessor())
            return self._with(sorts=(key.desc_nulls_first() if descending(order) else key.asc_nulls_last(),))
        found = parse_sort(sort)
        if len(found) == 1 and len(sort.split()) == 1:
            found = [(found[0][0], order)]
        return self._with(sorts=tuple(sort_key(self.source.resolve(n), descending(o), nulls_first_when_down=True) for n, o in found))

    sort = set_sort

    def order_by(self, name: str, direction: str = "asc") -> View:
        return self._with(sorts=(sort_key(self.source.resolve(name), descending(direction), nulls_first_when_down=True),))

    def skip(self, n: object) -> View:
        return self._with(skipped=_whole(n))

    def take(self, n: object) -> View:
        return self._with(taken=_whole(n))

    def table(self) -> Table:
        """The rows as a table, states and versions kept; sort, skip and take plan as one top-k."""
        df = self.source.df
        for f in self.filters:
            df = df.where(f)
        ties = self.source.order_columns()
        if self.sorts or ((self.skipped or self.taken is not None) and ties):
            df = df.orderBy(*self.sorts, *ties)
        if self.skipped:
            df = df.offset(self.skipped)
        if self.taken is not None:
            df = df.limit(self.taken)
        return self.source.over(df)

    to_table = to_data_table = table

    def frame(self, include_deleted: bool = True):
        found = self.table()
        if not include_deleted and found.tracked:  # after skip and take
            found = found.over(found.df.where(F.col(STATE) != "DELETED"))
        return found.frame()

    def get_rows(self) -> list[Row]:
        return self.frame().collect()

    def to_objects(self, include_deleted: bool = False) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.frame(include_deleted).collect()]

    to_array = to_json = to_objects

    def count(self) -> int:
        return self.table().df.count()

    def first_row(self) -> Row | None:
        return self.frame().limit(1).first()

    def row(self, i: int) -> Row:
        found = self.frame().offset(i).limit(1).first() if i >= 0 else None
        if found is None:
            raise IndexError(f"no row {i} in this view")
        return found

    def get_preview(self, rows: int = 10) -> list[dict]:
        from tabulon import debug

        return debug.rows_of(self.frame(include_deleted=False), rows)

    def to_debug_view(self, rows: int = 10) -> dict:
        from tabulon import debug

        return {"type": "View", "table": self.source.name, "filters": len(self.filters), "sorts": len(self.sorts), "skip": self.skipped, "take": self.taken, "preview": debug.rows_of(self.frame(), rows)}

    def create_temp_view(self, name: str) -> None:
        self.frame().createOrReplaceTempView(name)

    def __iter__(self) -> Iterator[Row]:
        return self.frame().toLocalIterator()

    def __getattr__(self, name: str):
        plain = snake(name)
        if plain != name and not name.startswith("_") and hasattr(type(self), plain):
            return getattr(self, plain)
        raise AttributeError(f"View has no attribute {name!r}")


__all__ = ["Mapping", "View"]
