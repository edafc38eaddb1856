"""Spark SQL expressions as text, with the names of ``pyspark.sql.functions``.

A fold of some thousand operations takes seconds to build through Column objects, each of
which is several calls into the JVM; as text it is one ``F.expr``. Only what the folds of
``dom`` need is here. A ``Text`` is an expression in parentheses or a call.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Sequence

_fresh = itertools.count()


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Text:
    """A SQL expression."""

    def __init__(self, sql: str, name: str = "") -> None:
        self.sql, self.name = sql, name

    def alias(self, name: str) -> Text:
        return Text(self.sql, name)

    def cast(self, kind: str) -> Text:
        return Text(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Text:
        return Text(f"TRY_CAST({self.sql} AS {kind})")

    def isin(self, *values: str) -> Text:
        return Text(f"({self.sql} IN ({', '.join(_sql(v) for v in values)}))")

    def isNull(self) -> Text:
        return Text(f"({self.sql} IS NULL)")

    def startswith(self, other) -> Text:
        return call("startswith", self, other)

    def contains(self, other) -> Text:
        return call("contains", self, other)

    def rlike(self, pattern: str) -> Text:
        return call("rlike", self, pattern)

    def __getitem__(self, field: str) -> Text:
        return Text(f"{self.sql}.`{field}`")

    def _two(self, op: str, other, turned: bool = False) -> Text:
        a, b = (_sql(other), self.sql) if turned else (self.sql, _sql(other))
        return Text(f"({a} {op} {b})")

    def __neg__(self) -> Text:
        return Text(f"(- {self.sql})")

    def __invert__(self) -> Text:
        return Text(f"(NOT {self.sql})")


for _name, _op in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "AND", "or": "OR", "eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Text, f"__{_name}__", lambda self, other, op=_op: self._two(op, other))
    setattr(Text, f"__r{_name}__", lambda self, other, op=_op: self._two(op, other, True))


class When(Text):
    """CASE WHEN, to be continued by ``when`` and ``otherwise``."""

    def __init__(self, parts: tuple[str, ...]) -> None:
        super().__init__(f"CASE {' '.join(parts)} END")
        self.parts = parts

    def when(self, test: Text, value) -> When:
        return When((*self.parts, f"WHEN {test.sql} THEN {_sql(value)}"))

    def otherwise(self, value) -> Text:
        return Text(f"CASE {' '.join(self.parts)} ELSE {_sql(value)} END")


def _sql(x) -> str:
    """SQL of an operand: text, a literal, or a column's or variable's expression."""
    if isinstance(x, Text):
        return x.sql
    return lit(x).sql


def lit(x) -> Text:
    if isinstance(x, bool):
        return Text(str(x).upper())
    if isinstance(x, str):
        return Text(quoted(x))
    return Text(f"{x!r}D" if isinstance(x, float) else str(x))


def col(name: str) -> Text:
    return Text("`" + name.replace("`", "``") + "`")


def call(name: str, *args) -> Text:
    return Text(f"{name}({', '.join(_sql(a) for a in args)})")


def _lambda(f: Callable[..., Text]) -> str:
    names = [Text(f"v{next(_fresh)}") for p in inspect.signature(f).parameters.values() if p.default is inspect.Parameter.empty]
    given = names[0].sql if len(names) == 1 else f"({', '.join(x.sql for x in names)})"
    return f"{given} -> {f(*names).sql}"


def when(test: Text, value) -> When:
    return When((f"WHEN {test.sql} THEN {_sql(value)}",))


def struct(*fields: Text) -> Text:
    return Text(f"named_struct({', '.join(f'{quoted(x.name)}, {x.sql}' for x in fields)})")


def array(*items) -> Text:
    return call("array", *items)


def arrays_zip(*items: Text) -> Text:
    """Arrays of equal lengths as one array of structs, with the arrays' aliases as names."""
    row = Text(f"v{next(_fresh)}")
    fields = struct(*[row[str(k)].alias(x.name) for k, x in enumerate(items)])
    return Text(f"transform({call('arrays_zip', *items).sql}, {row.sql} -> {fields.sql})")


def transform(x: Text, f: Callable[..., Text]) -> Text:
    return Text(f"transform({x.sql}, {_lambda(f)})")


def filter(x: Text, f: Callable[..., Text]) -> Text:
    return Text(f"filter({x.sql}, {_lambda(f)})")


def exists(x: Text, f: Callable[..., Text]) -> Text:
    return Text(f"exists({x.sql}, {_lambda(f)})")


def aggregate(x: Text, zero: Text, merge: Callable[..., Text], finish: Callable[..., Text] | None = None) -> Text:
    return Text(f"aggregate({x.sql}, {zero.sql}, {_lambda(merge)}{', ' + _lambda(finish) if finish else ''})")


def let(value: Text, f: Callable[[Text], Text]) -> Text:
    """``value`` evaluated once, as a variable of ``f``."""
    return Text(f"transform(array({value.sql}), {_lambda(f)})[0]")


def bind(value: Text, like: Text, f: Callable[[Text], Text]) -> Text:
    """``let`` for the state of a fold: ``f`` gives a value of the type of ``like``.

    What ``transform`` returns is copied down to the bytes of its strings, which would make
    a fold quadratic in its text; what ``aggregate`` returns isn't.
    """
    unused = Text(f"v{next(_fresh)}")
    name = Text(f"v{next(_fresh)}")
    return Text(f"aggregate(array({value.sql}), {like.sql}, ({unused.sql}, {name.sql}) -> {f(name).sql})")


def trimmed(x: Text, chars: str) -> Text:
    """A text without these characters at its ends."""
    return call("btrim", x, chars)


def replaced(x: Text, steps: Sequence[tuple[str, str]]) -> Text:
    """Patterns replaced one after the other; replacements hold no groups."""
    for pattern, new in steps:
        x = call("regexp_replace", x, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    return x


#: What a text holds if a pattern that begins like this can match in it.
_SIGNS = {"<": ("<",), "(?i)\u00a0|&": ("\u00a0", "&"), "[ \n]*\x06": ("\x06",), " *\x06": ("\x06",), " {2,}": ("  ",)}


def where_found(x: Text, steps: Sequence[tuple[str, str]]) -> Text:
    """``replaced``; texts without a sign of a pattern (see ``_SIGNS``) are spared it."""
    for pattern, new in steps:
        signs = next((v for k, v in _SIGNS.items() if pattern.startswith(k)), None)
        if signs is None:
            x = replaced(x, ((pattern, new),))
        else:
            x = let(x, lambda t, signs=signs, step=(pattern, new): when(Text("(" + " OR ".join(t.contains(s).sql for s in signs) + ")"), replaced(t, (step,))).otherwise(t))
    return x


def __getattr__(name: str) -> Callable[..., Text]:
    """Any other function of Spark SQL by its name."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: call(name, *args)
