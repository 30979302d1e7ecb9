"""Column builders over the dense panel: one row per entity and day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ENTITY = "entity"
DATE = "date"
EPS = 1e-8


def by_entity(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (ENTITY,))).orderBy(DATE)


def by_date() -> WindowSpec:
    return Window.partitionBy(DATE)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(agg: Callable[[Column], Column], x: Column | str, n: int, m: int | None = None, w: WindowSpec | None = None) -> Column:
    """Trailing aggregate over n rows, null unless m values are present."""
    x = _col(x)
    frame = (w or by_entity()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if m is None else m), agg(x).over(frame))


def corr_of(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of complete pairs, null instead of a division by zero."""
    x, y = _col(x), _col(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = (F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y))
    cov, sx, sy = parts if over is None else (p.over(over) for p in parts)
    return F.try_divide(cov, sx * sy)


def roll_corr(x: Column | str, y: Column | str, n: int, m: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count("*").over(frame) >= m, corr_of(x, y, frame))


def lag(x: Column | str, k: int, w: WindowSpec | None = None) -> Column:
    return F.lag(_col(x), k).over(w or by_entity())


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that gives null, never infinity or an error, on a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def chg(x: Column | str, k: int, w: WindowSpec | None = None) -> Column:
    """Relative change against the value k rows earlier."""
    x = _col(x)
    return F.try_divide(x, F.lag(x, k).over(w or by_entity())) - 1.0


def pct_chg(x: Column | str, k: int, w: WindowSpec | None = None) -> Column:
    return chg(x, k, w) * 100.0


def ffill(x: Column | str, limit: int | None = None, w: WindowSpec | None = None) -> Column:
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(_col(x), ignorenulls=True).over((w or by_entity()).rowsBetween(start, 0))


def running(agg: Callable[[Column], Column], x: Column | str, w: WindowSpec | None = None) -> Column:
    return agg(_col(x)).over((w or by_entity()).rowsBetween(Window.unboundedPreceding, 0))


def first_value(x: Column | str, w: WindowSpec | None = None) -> Column:
    """First non-null value of the partition."""
    frame = (w or by_entity()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(_col(x), ignorenulls=True).over(frame)


def clip(x: Column | str, lo: Column | float | None, hi: Column | float | None) -> Column:
    """Clip that keeps null as null."""
    x = _col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def no_nan(x: Column | str) -> Column:
    """NaN and infinities become null."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
