"""Signals to family scores in one wide frame.

While a date's names fit one window, every z-score, family mean and family
rank shares a single exchange on date: no unpivot, no join back.  Larger
cross-sections go through the long form, whose ranks split each date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import FAMILIES, SETTINGS
from daygrid.functions.rolling import DATE, ENTITY, clip
from daygrid.operators import cross_section as X
from daygrid.operators import score as C
from daygrid.plans import signals as S


def z_frame(frame: DataFrame, names: list[str], max_names: int | None, prefix: str = "z_") -> DataFrame:
    """Adds a winsorised rank z per signal column; everything else is kept."""
    if not X.fits_window(max_names):
        long = S.z_signals(S.long_signals(frame, names), max_names)
        wide = long.groupBy(ENTITY, DATE).pivot("signal", names).agg(F.max("z"))
        renamed = wide.select(ENTITY, DATE, *[F.col(n).alias(f"{prefix}{n}") for n in names])
        return frame.join(renamed, [ENTITY, DATE], "left").drop(*names)
    src = frame
    if max_names > 100:
        w = Window.partitionBy(DATE)
        cut = src.withColumns({f"_q_{n}": F.percentile(n, F.array(F.lit(SETTINGS.winsor_lower), F.lit(SETTINGS.winsor_upper))).over(w) for n in names})
        src = cut.withColumns({n: clip(n, F.col(f"_q_{n}")[0], F.col(f"_q_{n}")[1]) for n in names}).drop(*[f"_q_{n}" for n in names])
    return src.withColumns({f"{prefix}{n}": X.rank_z_column(n, [DATE]) for n in names}).drop(*names)


def family_means(frame: DataFrame, signed: dict[str, list[tuple[str, int]]], prefix: str = "z_") -> DataFrame:
    """Row-wise signed mean of the available z of each family; `signed` maps family to (signal, sign)."""
    out = {}
    for family, members in signed.items():
        zs = [(F.col(f"{prefix}{s}"), g) for s, g in members]
        total = sum((F.coalesce(z, F.lit(0.0)) * g for z, g in zs), F.lit(0.0))
        n = sum((z.isNotNull().cast("int") for z, _ in zs), F.lit(0))
        out[family] = C.settle(F.try_divide(total, n))
    return frame.withColumns(out)


def decided(frame: DataFrame, decisions: list[tuple[str, str, int]], max_names: int | None) -> DataFrame:
    """Family scores of selected signals: signed mean, rank z, and factor improvement.

    `decisions` lists (family, signal, sign): at most one row per registered signal.
    """
    signed: dict[str, list[tuple[str, int]]] = {}
    for family, signal, sign in decisions:
        signed.setdefault(family, []).append((signal, sign))
    means = family_means(frame, signed)
    scored = means
    for family in FAMILIES[:3]:
        if family in signed:
            scored = X.rank_z(scored.withColumnRenamed(family, "_mean"), "_mean", [DATE], family, max_names).drop("_mean")
        else:
            scored = scored.withColumn(family, F.lit(None).cast("double"))
    return C.factor_improvement(scored, max_names)
