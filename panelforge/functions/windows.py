"""Windows over one instrument's dates and over one date's instruments, and null rules.

Missing is always NULL, never NaN. Rolling windows count rows of the dense grid, and a window with any
missing value has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def time():
    """An instrument's dates in order."""
    return Window.partitionBy("instrument").orderBy("date_idx")


def day():
    """A factor's instruments on one date."""
    return Window.partitionBy("factor_id", "date")


def series():
    """A factor's dates in order."""
    return Window.partitionBy("factor_id").orderBy("date_idx")


def clean(x: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def rolling(t: int):
    return time().rowsBetween(-(t - 1), 0)


_shared: ContextVar[dict[str, tuple[str, Column]] | None] = ContextVar("shared", default=None)


@contextmanager
def shared(prefix: str) -> Iterator[dict[str, tuple[str, Column]]]:
    """Within it, ``over`` gives each different window expression a column of its own, found in the values: (name, expression).

    So operators that need the same mean, count or deviation of the same window have it evaluated once.
    """
    held: dict[str, tuple[str, Column]] = {}
    before = _shared.set(held)
    held["__prefix"] = (prefix, F.lit(None))
    try:
        yield held
    finally:
        _shared.reset(before)
        held.pop("__prefix")


def over(x: Column, window) -> Column:
    """``x`` over the window, or the shared column that holds it."""
    made, held = x.over(window), _shared.get()
    if held is None:
        return made
    return F.col(held.setdefault(str(made), (f"{held['__prefix'][0]}{len(held)}", made))[0])


def full(x: Column, t: int, result: Column) -> Column:
    """``result`` where all ``t`` rows of the window have a value."""
    return F.when(over(F.count(x), rolling(t)) == t, result)


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """The two values where neither is missing."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)
