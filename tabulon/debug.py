"""Previews and text forms; each runs a job over a few rows, ``repr`` runs none."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from tabulon.sinks import iso

if TYPE_CHECKING:
    from tabulon.table import Table

ROWS = 10


def cap(rows: object) -> int:
    """How many rows to show: whole, not negative, ten if that makes no sense."""
    try:
        found = float(rows)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return ROWS
    return max(0, math.floor(found)) if math.isfinite(found) else ROWS


def shown(v: object) -> object:
    if isinstance(v, (dt.datetime, dt.date)):
        return iso(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return f"<buffer of {len(v)} bytes>"
    if callable(v):
        return f"<function {getattr(v, '__name__', '')}>"
    if isinstance(v, dict):
        return {k: shown(x) for k, x in v.items()}
    return [shown(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(frame: DataFrame, rows: object) -> list[dict]:
    return [shown(r.asDict(recursive=True)) for r in frame.limit(cap(rows)).collect()]  # type: ignore[misc]


def preview(table: Table, rows: object = ROWS) -> list[dict]:
    frame = table.live().ordered().frame()
    return [shown(r.asDict(recursive=True)) for r in frame.collect()] if rows is None else rows_of(frame, rows)  # type: ignore[misc]


def view(table: Table, rows: object = ROWS) -> dict:
    from tabulon.operators.tracking import summary

    return {
        "type": "Table", "tableName": table.name, "columns": [c.to_dict() for c in table.schema.columns], "primaryKey": list(table.schema.primary_key),
        "rowCount": table.count(), "changes": {k: v for k, v in summary(table).items() if not k.endswith("Rows") or k == "totalRows"}, "preview": preview(table, rows),
    }


def row(table: Table, key: object) -> dict | None:
    """The row with a primary key, with its state and versions."""
    from tabulon.operators.tracking import ORIGINAL, PROPOSED, STATE, track

    rows = track(table).at_key(key)
    found = None if rows is None else rows.live().frame(hidden=True).limit(1).first()
    if found is None:
        return None
    full = found.asDict(recursive=True)
    versions = {"originalValues": shown(full[ORIGINAL]), "proposedValues": shown(full[PROPOSED])}
    return {"type": "Row", "tableName": table.name, "rowState": full[STATE], "values": {n: shown(full[n]) for n in table.schema.names}, **versions}


def text(table: Table, rows: object = ROWS) -> str:
    """A box-drawing table."""
    found = preview(table, rows)
    names = table.schema.names
    cells = [[str(r[n]) if r[n] is not None else "null" for n in names] for r in found]
    widths = [max(len(n), *(len(c[i]) for c in cells)) if cells else len(n) for i, n in enumerate(names)]
    line = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c
    row = lambda values: "│" + "│".join(f" {v:<{w}} " for v, w in zip(values, widths, strict=True)) + "│"
    return "\n".join([f"{table.name} ({table.count()} rows)", line("┌", "┬", "┐"), row(names), line("├", "┼", "┤"), *map(row, cells), line("└", "┴", "┘")])
