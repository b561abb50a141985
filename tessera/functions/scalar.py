"""Elementwise functions and reducers of the array namespace, as columns: each a built-in, or a short expression of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elementwise functions by name.
ELEMENTWISE = {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "exp": F.exp, "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "pow2": lambda x: x * x,
    "ceil": F.ceil, "floor": F.floor, "fabs": F.abs, "abs": F.abs,
}
#: Those of two columns.
BINARY = {"atan2": F.atan2, "pow": F.pow, "fmod": lambda a, b: a % b, "fmod_positive": F.pmod}


def _sq(x: Column) -> Column:
    return x * x


#: Reducers of one column; an empty input gives null.
REDUCERS = {
    "sum": F.sum,
    "sum_sq": lambda x: F.sum(_sq(x)),
    "product": F.product,
    "mean": F.avg,
    "mean_sq": lambda x: F.avg(_sq(x)),
    "min": F.min,
    "max": F.max,
    "max_absolute": lambda x: F.max(F.abs(x)),
    "median": lambda x: F.percentile(x, F.lit(0.5)),
}


def with_default(reduced: Column, default) -> Column:
    """A reducer's result, or a default where there were no rows."""
    return F.coalesce(reduced, F.lit(default))


def mean_weighted(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def mean_sq_weighted(x: Column, w: Column) -> Column:
    return F.sum(x * x * w) / F.sum(w)


def mean_and_variance(x: Column, w: Column | None = None) -> Column:
    """mean, variance: sample ones; with weights, the mean and the variance of it by 1 / sum of weights."""
    if w is None:
        return F.struct(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
    return F.struct(mean_weighted(x, w).alias("mean"), (1 / F.sum(w)).alias("variance"))


def min_index(x: Column, row_id: Column) -> Column:
    """The row of the least value, the first of equal ones."""
    return F.min(F.struct(x, row_id.alias("row")))["row"]


def max_index(x: Column, row_id: Column) -> Column:
    """The row of the greatest value, the first of equal ones."""
    return -F.max(F.struct(x, (-row_id).alias("row")))["row"]


# complex numbers as structs of re and im


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def polar(size: Column, angle: Column) -> Column:
    return complex_of(size * F.cos(angle), size * F.sin(angle))


def norm(z: Column) -> Column:
    """The squared size."""
    return z["re"] * z["re"] + z["im"] * z["im"]


def modulus(z: Column) -> Column:
    return F.sqrt(norm(z))


def arg(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def conj(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def times(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


# vectors of three columns


def norms(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def rotated(v: list[Column], axis: list[float], angle: Column) -> list[Column]:
    """v turned about a unit axis by an angle in radians."""
    from tessera.functions.geometry import cross, dot

    k = [F.lit(float(x)) for x in axis]
    along, turned = dot(k, v), cross(k, v)
    c, s = F.cos(angle), F.sin(angle)
    return [v[i] * c + turned[i] * s + k[i] * along * (1 - c) for i in range(3)]


def matrix_times(matrix: list[list[float]], v: list[Column]) -> list[Column]:
    return [sum((F.lit(float(m)) * x for m, x in zip(row[1:], v[1:], strict=True)), F.lit(float(row[0])) * v[0]) for row in matrix]


def parts(column: str, names: tuple[str, ...]) -> list[Column]:
    """The fields of a struct column."""
    return [F.col(f"{column}.{n}").alias(f"{column}_{n}") for n in names]


def joined(columns: list[Column], names: tuple[str, ...]) -> Column:
    """A struct of columns."""
    return F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True)))


# geometry of a flat panel


def px_to_mm(x: Column, y: Column, pixel: tuple[float, float]) -> list[Column]:
    return [x * pixel[0], y * pixel[1]]


def mm_to_lab(x: Column, y: Column, origin: list[float], fast: list[float], slow: list[float]) -> list[Column]:
    """A place on a panel in the laboratory frame."""
    return [F.lit(float(o)) + x * f + y * s for o, f, s in zip(origin, fast, slow, strict=True)]


def scattered(lab: list[Column], wavelength: float) -> list[Column]:
    """The vector of length 1 / wavelength towards a place."""
    size = norms(lab)
    return [v / size / wavelength for v in lab]


def to_reciprocal(s1: list[Column], s0: list[float], axis: list[float] | None, angle: Column | None) -> list[Column]:
    """s1 - s0, turned back by the angle of the scan; stills aren't turned."""
    r = [a - F.lit(float(b)) for a, b in zip(s1, s0, strict=True)]
    return r if axis is None else rotated(r, axis, -angle)


def phi_range(z0: Column, z1: Column, start: float, width: float, first: int) -> list[Column]:
    """The angles at which a range of images begins and ends."""
    return [(z0 - first) * width + start, (z1 - first) * width + start]


def ray_intersection(s1: list[Column], origin: list[float], fast: list[float], slow: list[float]) -> Column:
    """x, y in mm where a ray from the sample meets a panel's plane; null if it points away or runs along it."""
    from tessera.functions.geometry import dot

    normal = [fast[(i + 1) % 3] * slow[(i + 2) % 3] - fast[(i + 2) % 3] * slow[(i + 1) % 3] for i in range(3)]
    distance = sum(o * n for o, n in zip(origin, normal, strict=True))
    towards = dot(s1, [F.lit(float(n)) for n in normal])
    t = F.when(towards != 0, F.lit(distance) / towards)
    at = [s * t - F.lit(float(o)) for s, o in zip(s1, origin, strict=True)]
    x, y = dot(at, [F.lit(float(f)) for f in fast]), dot(at, [F.lit(float(f)) for f in slow])
    return F.when(t > 0, F.struct(x.alias("x"), y.alias("y")))


def lp_correction(s1: list[Column], s0: list[float], axis: list[float] | None, normal: list[float], fraction: float) -> Column:
    """Lorentz and polarisation correction: 1 / (Lorentz factor * polarisation factor), the former 1 for stills.

    The Lorentz factor is |s0| |s1| over |s1 . (axis x s0)|; ``normal`` and ``fraction`` describe the beam's polarisation.
    """
    from tessera.functions.geometry import dot

    size1, size0 = norms(s1), sum(x * x for x in s0) ** 0.5
    lorentz = F.lit(1.0)
    if axis is not None:
        n = [axis[(i + 1) % 3] * s0[(i + 2) % 3] - axis[(i + 2) % 3] * s0[(i + 1) % 3] for i in range(3)]
        lorentz = size1 * size0 / F.abs(dot(s1, [F.lit(x) for x in n]))
    p = dot(s1, [F.lit(float(x)) for x in normal]) / size1
    c = dot(s1, [F.lit(float(x)) for x in s0]) / (size1 * size0)
    return 1 / (lorentz * ((1 - 2 * fraction) * (1 - p * p) + fraction * (1 + c * c)))


def absorbed(s1: list[Column], normal: list[float], mu: float, thickness: float) -> Column:
    """The share of rays that a sensor of a thickness absorbs: 1 - exp(-mu t / cos of the angle to its normal)."""
    from tessera.functions.geometry import dot

    c = F.abs(dot(s1, [F.lit(float(x)) for x in normal])) / norms(s1)
    return 1 - F.exp(-mu * thickness / c)


def with_offset(index: list[Column], offset: list[int]) -> list[Column]:
    return [i + o for i, o in zip(index, offset, strict=True)]


def polygon_area(xy: Column) -> Column:
    """The area within an array of structs x, y, positive if they go round counterclockwise."""
    n = F.size(xy)
    terms = F.transform(xy, lambda p, i: p["x"] * F.get(xy, (i + 1) % n)["y"] - F.get(xy, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2


# series


def linear_fit(x: str, y: str) -> list[Column]:
    """slope, intercept and correlation of y over x."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("correlation")]


def interpolated(x: Column, table: list[tuple[float, float]]) -> Column:
    """y at x by the lines through the points of a table, ascending in x; null outside."""
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in zip(table, table[1:], strict=False):
        out = F.when((x >= x0) & (x <= x1), F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def histogram(table: DataFrame, x: Column, low: float, high: float, slots: int, weight: Column | None = None) -> DataFrame:
    """slot, n, total of equal slots over [low, high]; a value of high goes to the last, others outside go nowhere. Empty slots are told."""
    slot = F.least(F.lit(slots - 1), F.floor((x - low) / ((high - low) / slots))).cast("int")
    met = table.where((x >= low) & (x <= high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.sum(F.lit(1.0) if weight is None else weight).alias("total"))
    grid = table.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return grid.join(F.broadcast(met), "slot", "left").fillna(0, ["n", "total"])  # a row per slot


def condensed(integers: DataFrame, column: str) -> DataFrame:
    """first, last of the runs of consecutive integers."""
    w = Window.orderBy(column)
    rows = integers.select(column).distinct()
    return rows.withColumn("_run", F.col(column) - F.row_number().over(w)).groupBy("_run").agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("_run")


def union_of(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).union(b.select(column)).distinct()


def intersection_of(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def smoothed(x: Column, knots: list[float], values: list[float], sigma: float, reach: float = 3.0) -> Column:
    """The mean of knots' values weighted by a normal curve of their distance, of knots within ``reach`` deviations."""
    top, below = F.lit(0.0), F.lit(0.0)
    for k, v in zip(knots, values, strict=True):
        off = (x - k) / sigma
        w = F.when(F.abs(off) <= reach, F.exp(-off * off / 2)).otherwise(0.0)
        top, below = top + w * v, below + w
    return F.when(below > 0, top / below)


def random_value(seed: int, *order: Column) -> Column:
    """A number in [0, 1) that the seed and a row's columns fix, whatever the partitioning."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in order))), F.lit(1), F.lit(12)), 16, 10).cast("double") / float(1 << 48)
