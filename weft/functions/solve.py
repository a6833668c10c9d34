"""Real roots of polynomials of degree one to three, and points on curves, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients nearer to zero than this count as zero.
EPSILON = 1e-7
#: The number of roots given for an equation that every x solves.
ALL = 4


def _null() -> Column:
    return F.lit(None).cast("double")


def _tiny(c: Column) -> Column:
    return F.abs(c) < EPSILON


def linear(c0: Column, c1: Column) -> tuple[Column, Column, Column, Column]:
    """(number of roots, three root columns) of c0 + c1 x = 0; missing roots are null."""
    n = F.when(~_tiny(c1), 1).when(_tiny(c0), ALL).otherwise(0)
    return n, F.when(n == 1, F.try_divide(-c0, c1)), _null(), _null()


def quadratic(c0: Column, c1: Column, c2: Column) -> tuple[Column, Column, Column, Column]:
    """Roots of c0 + c1 x + c2 x^2 = 0, the larger offset first; a double root counts once."""
    half = F.try_divide(c1, 2 * c2)
    disc = half * half - F.try_divide(c0, c2)
    reach = F.sqrt(F.greatest(disc, F.lit(0.0)))
    flat = linear(c0, c1)
    n = F.when(_tiny(c2), flat[0]).when(disc < 0, 0).when(disc > 0, 2).otherwise(1)
    first = F.when(_tiny(c2), flat[1]).when(disc >= 0, reach - half)
    second = F.when(~_tiny(c2) & (disc > 0), -half - reach)
    return n, first, second, _null()


def cubic(c0: Column, c1: Column, c2: Column, c3: Column) -> tuple[Column, Column, Column, Column]:
    """Roots of c0 + c1 x + c2 x^2 + c3 x^3 = 0 by its depressed form: cosines where there are three
    distinct roots, cube roots otherwise (a repeated root then fills the other two places)."""
    shift = F.try_divide(c2, 3 * c3)
    p = F.try_divide(c1, c3) / 3 - shift * shift
    q = 2 * shift * shift * shift - shift * F.try_divide(c1, c3) + F.try_divide(c0, c3)
    disc = q * q + 4 * p * p * p
    turn = F.atan2(F.sqrt(F.greatest(-disc, F.lit(0.0))), -q)
    radius = 2 * F.sqrt(F.greatest(-p, F.lit(0.0)))
    wave = lambda by: radius * F.cos((turn + by) / 3) - shift
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    lone = F.cbrt((root - q) / 2) + F.cbrt(-(root + q) / 2)
    less = quadratic(c0, c1, c2)
    n = F.when(_tiny(c3), less[0]).when(disc > 0, 1).otherwise(3)
    first = F.when(_tiny(c3), less[1]).when(disc < 0, wave(0.0)).otherwise(lone - shift)
    rest = [F.when(_tiny(c3), less[k]).when(disc < 0, wave(by)).when(disc == 0, -lone / 2 - shift) for k, by in ((2, 2 * math.pi), (3, -2 * math.pi))]
    return n, first, *rest


def bezier_point(p0: Column, p1: Column, p2: Column, p3: Column, t: float) -> Column:
    """One coordinate of a cubic curve at ``t``."""
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3
