"""Empirical relations of seismic velocities and density, and a near-surface velocity profile. SI units, as Columns.

The polynomials are those of Brocher (2005): Vp of Vs, Vs of Vp, and the Nafe-Drake density of Vp.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polynomial coefficients in km/s and g/cm3, constant first.
VP_OF_VS = (0.9409, 2.0947, -0.8206, 0.2683, -0.0251)
VS_OF_VP = (0.7858, -1.2344, 0.7949, -0.1238, 0.0064)
RHO_OF_VP = (0.0, 1.6612, -0.4721, 0.0671, -0.0043, 0.000106)
VS_MAX, VP_MIN, VP_MAX, RHO_MIN = 4500.0, 1500.0, 8500.0, 1000.0


def _polynomial(x: Column, a: tuple[float, ...]) -> Column:
    out = F.lit(a[-1])
    for c in reversed(a[:-1]):
        out = out * x + c
    return out


def brocher_vp(vs: Column) -> Column:
    """Vp of Vs for 0 < Vs <= 4500 m/s, else null."""
    return F.when((vs > 0) & (vs <= VS_MAX), 1000 * _polynomial(vs / 1000, VP_OF_VS))


def brocher_vs(vp: Column) -> Column:
    """Vs of Vp for 1500 <= Vp <= 8500 m/s, else null."""
    return F.when((vp >= VP_MIN) & (vp <= VP_MAX), 1000 * _polynomial(vp / 1000, VS_OF_VP))


def nafe_drake(vp: Column) -> Column:
    """Density of Vp, at least 1000 kg/m3."""
    return F.when(vp.isNotNull(), F.greatest(1000 * _polynomial(vp / 1000, RHO_OF_VP), F.lit(RHO_MIN)))


def ely_profile(q: Column, v_top: Column, v_anchor: Column) -> Column:
    """Velocity at q, the depth over the thickness of the layer: half of v_top at the surface, v_anchor at its base."""
    f = q + 2.0 / 3.0 * (q - q * q)
    g = 0.5 - q / 2 + 1.5 * (q * q + 2 * F.sqrt(q) - 3 * q)
    return f * v_anchor + g * v_top
