"""Ordered regex rewrite steps, rendered either as a Spark Column or as DuckDB SQL.

Patterns are written in the common subset of Java regex and RE2: no lookaround,
no backreferences, ``\\z`` for end of input. Replacements use ``{n}`` for group n.
The same step tuple feeds Spark (the engine) and DuckDB (the test oracle), so the
two cannot drift apart.
"""

from __future__ import annotations

import re
from typing import NamedTuple, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rx(NamedTuple):
    pattern: str
    repl: str


_GROUP = re.compile(r"\{(\d)\}")


def java_repl(repl: str) -> str:
    out = repl.replace("\\", "\\\\").replace("$", "\\$")
    return _GROUP.sub(lambda m: "$" + m.group(1), out)


def re2_repl(repl: str) -> str:
    out = repl.replace("\\", "\\\\")
    return _GROUP.sub(lambda m: "\\" + m.group(1), out)


def sql_str(s: str) -> str:
    """DuckDB string literal (no escape processing inside quotes)."""
    return "'" + s.replace("'", "''") + "'"


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Referencing a computed column several times inside one expression copies its
    whole subtree; binding it through a one-element ``transform`` keeps the plan small
    and evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def bind(value: Column, like: Column, fn) -> Column:
    """``let`` for the state of a fold: ``fn`` gives a value of the type of ``like``.

    What ``transform`` returns is copied down to the bytes of its strings, which would make
    a fold quadratic in its text; what ``aggregate`` returns isn't.
    """
    return F.aggregate(F.array(value), like, lambda _, v: fn(v))


def rx_spark(col: Column, steps: Sequence[Rx]) -> Column:
    for st in steps:
        col = F.regexp_replace(col, F.lit(st.pattern), F.lit(java_repl(st.repl)))
    return col


def rx_sql(expr: str, steps: Sequence[Rx]) -> str:
    for st in steps:
        expr = f"regexp_replace({expr}, {sql_str(st.pattern)}, {sql_str(re2_repl(st.repl))}, 'g')"
    return expr


# Whitespace as JavaScript's String.prototype.trim sees it in ASCII text.
WS = r"[ \t\r\n\f\x0B]"
TRIM_STEPS = (Rx(r"^" + WS + r"+", ""), Rx(WS + r"+\z", ""))


WS_CHARS = " \t\r\n\f\x0B"


def trim_ws(col: Column) -> Column:
    """TRIM_STEPS by the set of characters: a pattern is tried at every one of a text's."""
    return F.btrim(col, F.lit(WS_CHARS))


def trim_ws_sql(expr: str) -> str:
    return rx_sql(expr, TRIM_STEPS)
