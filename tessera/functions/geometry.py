"""Row-wise formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def d_spacing(h: Column, k: Column, l: Column, metric: list[float]) -> Column:  # noqa: E741
    """Resolution of an index under a reciprocal metric (a*a*, b*b*, c*c*, a*b*, a*c*, b*c*); null for (0, 0, 0)."""
    aa, bb, cc, ab, ac, bc = metric
    q = h * h * aa + k * k * bb + l * l * cc + 2 * (h * k * ab + h * l * ac + k * l * bc)
    return F.when(q > 0, 1 / F.sqrt(q))


def reciprocal_metric(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[float]:
    """The reciprocal metric of a cell in lengths and degrees."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sa, sb, sg = (math.sin(math.radians(x)) for x in (alpha, beta, gamma))
    volume = a * b * c * math.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    ra, rb, rc = b * c * sa / volume, a * c * sb / volume, a * b * sg / volume
    rca, rcb, rcg = (cb * cg - ca) / (sb * sg), (ca * cg - cb) / (sa * sg), (ca * cb - cg) / (sa * sb)
    return [ra * ra, rb * rb, rc * rc, ra * rb * rcg, ra * rc * rcb, rb * rc * rca]


def reindexed(index: list[Column], op: list[list[int]]) -> list[Column]:
    """The index triple under a 3x3 integer operator."""
    return [sum((x * m for x, m in zip(index, row, strict=True) if m), F.lit(0)) for row in op]


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def entering(s1: list[Column], s0: list[float], axis: list[float] | None) -> Column:
    """Whether a vector enters the sphere: s1 . (s0 x axis) < 0; false without an axis."""
    if axis is None:
        return F.lit(False)
    normal = [s0[(i + 1) % 3] * axis[(i + 2) % 3] - s0[(i + 2) % 3] * axis[(i + 1) % 3] for i in range(3)]
    return dot(s1, [F.lit(x) for x in normal]) < 0


def zeta(s1: list[Column], s0: list[float], axis: list[float]) -> Column:
    """axis . e1 with e1 the unit vector along s1 x s0."""
    e = cross(s1, [F.lit(x) for x in s0])
    return dot([F.lit(x) for x in axis], e) / F.sqrt(dot(e, e))


def blended(total: Column, fitted: Column, middle: float) -> Column:
    """Fitted and summed intensities mixed: the sum's weight falls from 1 with the cube of intensity over a middle value."""
    w = F.when(total <= 0, F.lit(1.0)).otherwise(1 / (1 + F.pow(total / middle, F.lit(3))))
    return w * total + (1 - w) * fitted


def error_model(variance: Column, intensity: Column, a: float, b: float) -> Column:
    """a^2 (variance + (b I)^2)."""
    return (variance + (b * intensity) * (b * intensity)) * (a * a)


def normalised_deviation(intensity: Column, scale: Column, mean: Column, sigma: Column, n: Column) -> Column:
    """sqrt((n - 1) / n) (I / g - mean) / sigma."""
    return F.sqrt((n - 1) / n) * (intensity / scale - mean) / sigma


def debye_waller(b: float, d: Column) -> Column:
    """exp(B / (2 d squared)): the scale of a relative B factor."""
    return F.exp(b / (2 * d * d))
