"""Expression front end: dialect text, Column helpers and window expressions."""

from .expr import as_column, cast, col, cond, div, if_, is_in, joined, lit, sql
from .windows import Over, over

__all__ = ["Over", "as_column", "cast", "col", "cond", "div", "if_", "is_in", "joined", "lit", "over", "sql"]
