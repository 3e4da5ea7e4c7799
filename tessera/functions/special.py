"""Normalising constants: log-Bessel expansion and von Mises-Fisher constant."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_bessel(order: float, kappa: Column) -> Column:
    """log I_order(kappa) by the leading term of the uniform (Debye) expansion."""
    if order <= 0:
        raise ValueError("the expansion needs a positive order (at least 3 dimensions)")
    z = kappa / F.lit(float(order))
    root = F.sqrt(1.0 + z * z)
    eta = root + F.log(z / (1.0 + root))
    return F.lit(-0.5 * math.log(2 * math.pi * order)) + order * eta - 0.5 * F.log(root)


def log_bessel_np(order: float, kappa):
    if order <= 0:
        raise ValueError("the expansion needs a positive order (at least 3 dimensions)")
    z = np.asarray(kappa, dtype=float) / order
    root = np.sqrt(1 + z * z)
    eta = root + np.log(z / (1 + root))
    return -0.5 * math.log(2 * math.pi * order) + order * eta - 0.5 * np.log(root)


def vmf_log_constant(dim: int, kappa: Column) -> Column:
    h = dim / 2
    return (h - 1) * F.log(kappa) - h * math.log(2 * math.pi) - log_bessel(h - 1, kappa)


def vmf_log_constant_np(dim: int, kappa):
    h = dim / 2
    return (h - 1) * np.log(kappa) - h * math.log(2 * math.pi) - log_bessel_np(h - 1, kappa)


def concentration(r: Column, dim: int) -> Column:
    """Concentration from the mean resultant length, kept inside [0.01, 0.99]."""
    r = F.least(F.greatest(r, F.lit(0.01)), F.lit(0.99))
    return (r * dim - r * r * r) / (1 - r * r)


def concentration_np(r, dim: int):
    r = np.clip(r, 0.01, 0.99)
    return (r * dim - r**3) / (1 - r**2)


def fisher_z(r: Column) -> Column:
    return 0.5 * F.log((1 + r) / (1 - r))
