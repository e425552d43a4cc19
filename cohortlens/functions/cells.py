"""Cells that hold JSON text, parsed into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_cell(cell: str | Column, schema: str) -> Column:
    """A JSON object as a struct of ``schema`` (a DDL string). Missing fields, values of another
    type and text that is no JSON are NULL."""
    return F.from_json(cell, schema)


def json_array_cell(cell: str | Column, element: str) -> Column:
    """A JSON array as an array of ``element`` (a DDL type); no array: NULL."""
    return F.from_json(cell, f"array<{element}>")
