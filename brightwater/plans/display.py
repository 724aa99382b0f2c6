"""Text views of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

WIDEST = 30


def _cell(value: object) -> str:
    text = "" if value is None else str(value).replace("\n", "\\n")
    return text if len(text) <= WIDEST else text[: WIDEST - 1] + "…"


def table_text(df: DataFrame, limit: int = 5) -> str:
    """The first rows as a table, with the shape below it. Counts the rows."""
    names = df.columns
    rows = [[_cell(v) for v in r] for r in df.limit(limit).collect()]
    widths = [max([len(_cell(n)), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, widths, strict=True)) + "|"
    body = [line, show([_cell(n) for n in names]), line, *map(show, rows), line]
    return "\n".join([*body, f"{df.count()} rows × {len(names)} columns"])
