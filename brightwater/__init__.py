"""brightwater: a PySpark-native analytics engine with a lazy, composable verb API.

Names load on first use, so that executors that need one module do not import all.
"""

from importlib import import_module

_PLACES = {
    "frame": "Frame should_broadcast",
    "functions": "cast col cond div if_ is_in joined lit over sql",
    "operators.graph": "Graph",
    "plans.macros": "call_table define define_table list_macros macro_setup_sqls undefine",
    "plans.session": "cut session",
    "sources.io": "ATTACHED exec_sql",
}
_WHERE = {name: place for place, names in _PLACES.items() for name in names.split()}
__all__ = sorted([*_WHERE, "events", "fts_search"])


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    if name == "events":
        return import_module(f"{__name__}.plans.events")
    if name == "fts_search":
        return import_module(f"{__name__}.operators.fts").search
    raise AttributeError(name)
