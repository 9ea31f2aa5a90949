"""Walking-cost formulas on a gradient, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: cost polynomial, highest power first ---------------------
COST_POLY = [1337.8, 278.19, -517.39, -78.199, 93.419, 19.825, 1.64]
GRAVITY = 9.81
# ---- end of fixed values ----------------------------------------------------


def minetti_cost(gradient: Column) -> Column:
    """J per kg and metre; the gradient is held inside +-0.5 where the fit is valid."""
    g = F.when(gradient.isNotNull(), F.least(F.greatest(gradient, F.lit(-0.5)), F.lit(0.5)))
    out = F.lit(COST_POLY[0])
    for c in COST_POLY[1:]:
        out = out * g + c
    return out


def tobler_speed(gradient: Column) -> Column:
    return 6.0 * F.exp(-3.5 * F.abs(gradient + 0.05))


def vertical_work_kj(delta_h: Column, mass_kg: float = 75.0) -> Column:
    up = F.when(delta_h.isNotNull(), F.greatest(delta_h, F.lit(0.0)))
    return mass_kg * GRAVITY * up / 1000.0
