"""A value computed once and used several times: within one expression, or as a column that is added first.

A value bound within an expression is a lambda's variable, and what reads it is not compiled. So ``with_bound`` makes a
column of every value that ``bind`` names while its expressions are built, one projection after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bound:
    """Names and values of one expression's columns, in the order in which they are added, and where they are looked at."""

    def __init__(self, prefix: str):
        self.prefix, self.made, self.where = prefix, [], None

    def named(self, value: Column) -> Column:
        self.made.append((f"{self.prefix}{len(self.made)}", value if self.where is None else F.when(self.where, value)))
        return F.col(self.made[-1][0])


_bound: ContextVar[Bound | None] = ContextVar("bound", default=None)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    own = _bound.get()
    return F.element_at(F.transform(F.array(value), body), 1) if own is None else body(own.named(value))


def named(value: Column) -> Column:
    """value, as a column where columns are bound; for what an expression otherwise reads once."""
    own = _bound.get()
    return value if own is None else own.named(value)


def only_where(condition: Column, make: Callable[[], Column]) -> Column:
    """make(), of which the caller looks at rows with the condition only; nothing bound in it is evaluated for others."""
    own = _bound.get()
    if own is None:
        return make()
    before, own.where = own.where, condition if own.where is None else own.where & condition
    own.where = own.named(own.where) if before is None else own.where
    try:
        return make()
    finally:
        own.where = before


def inlined(f: Callable[..., Column]) -> Callable[..., Column]:
    """f for a lambda over an array: what is bound in it depends on the lambda's variable and stays there."""

    @wraps(f)
    def run(*args: Column) -> Column:
        token = _bound.set(None)
        try:
            return f(*args)
        finally:
            _bound.reset(token)

    return run


def with_bound(df: DataFrame, **makes: Callable[[], Column]) -> DataFrame:
    """df with a column for each of ``makes``; what they bind is added before, the first values of all of them together."""
    chains, last, columns = [], {}, [c for c in df.columns if c not in makes]
    for k, (name, make) in enumerate(makes.items()):
        own = Bound(f"__bound_{k}_")
        token = _bound.set(own)
        try:
            last[name] = make()
        finally:
            _bound.reset(token)
        chains.append(own.made)
    for level in range(max(map(len, chains))):
        df = df.withColumns(dict(chain[level] for chain in chains if level < len(chain)))
    return df.select(*columns, *[c.alias(name) for name, c in last.items()])
