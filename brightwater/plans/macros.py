"""Named macros: expression macros expand where they are used, table macros give frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import MACROS, literal, substitute, tokens


def define(name: str, params: Sequence[str], body: str) -> None:
    """Define or replace an expression macro; a body that cannot be parsed leaves the table as it was."""
    spark = SparkSession.getActiveSession()
    fake = {p: f"`{p}`" for p in params}
    text = substitute(body, fake, MACROS)
    if spark is not None:
        spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    MACROS.tables.pop(name.lower(), None)
    MACROS.scalars[name.lower()] = (list(params), body)


def define_table(name: str, params: Sequence[str], body: str) -> None:
    """Define or replace a table macro: a query with parameters."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(substitute(body, {p: "NULL" for p in params}, MACROS))
    MACROS.scalars.pop(name.lower(), None)
    MACROS.tables[name.lower()] = (list(params), body)


def call_table(spark: SparkSession, name: str, *args: object) -> DataFrame:
    params, body = MACROS.tables[name.lower()]
    if len(params) != len(args):
        raise ValueError(f"macro {name} takes {len(params)} arguments, not {len(args)}")
    return spark.sql(substitute(body, {p: literal(a) for p, a in zip(params, args, strict=True)}, MACROS))


def expand_tables(text: str) -> str:
    """Calls of table macros in a query, ``FROM m(1, 'x')``, become subqueries."""
    from ..functions.dialect import _call_args, _translate

    toks, out, subqueries, i = tokens(text), [], [], 0
    while i < len(toks):
        kind, t = toks[i]
        if kind == "name" and t.lower() in MACROS.tables and i + 1 < len(toks) and toks[i + 1][1] == "(":
            args, after = _call_args(toks, i + 1)
            params, body = MACROS.tables[t.lower()]
            if len(params) != len(args):
                raise ValueError(f"macro {t} takes {len(params)} arguments, not {len(args)}")
            values = {p: _translate(a, (), MACROS, 0).strip() for p, a in zip(params, args, strict=True)}
            out.append(("mark", f"__table{len(subqueries)}__"))
            subqueries.append("(" + substitute(body, values, MACROS) + ")")
            i = after
            continue
        out.append(toks[i])
        i += 1
    whole = _translate(out, (), MACROS, 0)  # the dialect holds beside the macro too
    for n, sub in enumerate(subqueries):
        whole = whole.replace(f"__table{n}__", sub)
    return whole


def query_text(text: str) -> str:
    """A dialect query as Spark SQL, macros expanded."""
    return expand_tables(text)


def undefine(name: str) -> None:
    """Drop a macro of either kind; nothing happens if there is none."""
    if MACROS.scalars.pop(name.lower(), None) is None:
        MACROS.tables.pop(name.lower(), None)


def list_macros() -> list[dict]:
    return [{"name": n, "kind": kind, "params": list(p), "body": b} for kind, table in (("scalar", MACROS.scalars), ("table", MACROS.tables)) for n, (p, b) in sorted(table.items())]


def macro_setup_sqls() -> list[str]:
    """The definitions as text, to define them again elsewhere."""
    return [f"CREATE OR REPLACE MACRO {m['name']}({', '.join(m['params'])}) AS {'TABLE ' if m['kind'] == 'table' else ''}({m['body']})" for m in list_macros()]
