"""Operators on a small array per row: data, mask and background, row-major over z, y, x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of a pixel's mask.
VALID, BACKGROUND, FOREGROUND, STRONG, BACKGROUND_USED, OVERLAPPED = 1, 2, 4, 8, 16, 32


def is_consistent(data: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Whether an array has as many elements as its box."""
    return F.size(data) == nx * ny * nz


def count_mask(mask: Column, code: int) -> Column:
    """Elements that have all bits of code."""
    return F.size(F.filter(mask, lambda m: m.bitwiseAND(F.lit(code)) == code))


def masked_sum(data: Column, mask: Column, code: int) -> Column:
    """Sum of the elements that have all bits of code."""
    kept = F.zip_with(data, mask, lambda d, m: F.when(m.bitwiseAND(F.lit(code)) == code, d).otherwise(0.0))
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)


def summed_intensity(data: Column, background: Column, mask: Column) -> Column:
    """value, variance: foreground less background; the variance adds the background's, times foreground over background pixels."""
    n_fg, n_bg = count_mask(mask, VALID | FOREGROUND), count_mask(mask, VALID | BACKGROUND_USED)
    total, bg = masked_sum(data, mask, VALID | FOREGROUND), masked_sum(background, mask, VALID | FOREGROUND)
    ratio = F.when(n_bg > 0, n_fg / n_bg).otherwise(0.0)
    return F.struct((total - bg).alias("value"), (F.abs(total - bg) + F.abs(bg) * (1 + ratio)).alias("variance"))


def peak(data: Column, nx: Column, ny: Column) -> Column:
    """x, y, z of the first greatest element."""
    at = F.array_position(data, F.array_max(data)) - 1
    return F.struct((at % nx).alias("x"), (F.floor(at / nx) % ny).alias("y"), F.floor(at / (nx * ny)).alias("z"))


def centroid(data: Column, nx: Column, ny: Column) -> Column:
    """x, y, z of the weighted centre, in pixels from the box's corner, pixel centres at halves; null if the weights sum to zero."""
    total = F.aggregate(data, F.lit(0.0), lambda s, v: s + v)

    def moment(place) -> Column:
        terms = F.transform(data, lambda v, i: v * (place(i) + 0.5))
        return F.when(total != 0, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / total)

    return F.struct(
        moment(lambda i: i % nx).alias("x"), moment(lambda i: F.floor(i / nx) % ny).alias("y"), moment(lambda i: F.floor(i / (nx * ny))).alias("z")
    )


def flatten_z(data: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Sum over z."""
    plane = nx * ny
    zero = F.transform(F.sequence(F.lit(1), plane), lambda _: F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), nz - 1), zero, lambda s, z: F.zip_with(s, F.slice(data, z * plane + 1, plane), lambda a, b: a + b))


def overloaded(data: Column, mask: Column, trusted: Column) -> Column:
    """flag, mask: whether any pixel exceeds the trusted maximum, and the mask with such pixels no longer valid."""
    new = F.zip_with(data, mask, lambda d, m: F.when(d > trusted, m.bitwiseAND(F.lit(~VALID))).otherwise(m))
    return F.struct(F.exists(data, lambda d: d > trusted).alias("flag"), new.alias("mask"))


# storage


def allocated(nx: Column, ny: Column, nz: Column, value: float = 0.0) -> Column:
    """An array of a box's size, filled."""
    return F.array_repeat(F.lit(value), (nx * ny * nz).cast("int"))


def released() -> Column:
    """No array."""
    return F.lit(None).cast("array<double>")


def is_allocated(data: Column) -> Column:
    return data.isNotNull() & (F.size(data) > 0)


def is_inside(box: list[Column], nx: int, ny: int, nz: tuple[int, int]) -> Column:
    """Whether a box x0, x1, y0, y1, z0, z1 lies within an image and a range of images."""
    x0, x1, y0, y1, z0, z1 = box
    return (x0 >= 0) & (x1 <= nx) & (y0 >= 0) & (y1 <= ny) & (z0 >= nz[0]) & (z1 <= nz[1])


def any_bad(mask: Column) -> Column:
    """Whether a pixel isn't valid."""
    return F.exists(mask, lambda m: m.bitwiseAND(F.lit(VALID)) == 0)


# centroids


#: Elements that each kind of centroid weighs: all bits of these codes.
CENTROIDS = {"all": 0, "valid": VALID, "foreground": VALID | FOREGROUND, "strong": VALID | STRONG}


def masked(data: Column, mask: Column, code: int) -> Column:
    """data with 0 where a bit of code is missing."""
    return F.zip_with(data, mask, lambda d, m: F.when(m.bitwiseAND(F.lit(code)) == code, d).otherwise(0.0)) if code else data


def minus(data: Column, background: Column) -> Column:
    """data less background, 0 where that is less."""
    return F.zip_with(data, background, lambda d, b: F.greatest(d - b, F.lit(0.0)))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def centroid_of(kind: str, data: Column, mask: Column, nx: Column, ny: Column, background: Column | None = None, code: int | None = None) -> Column:
    """position and variance of the weighted centre of a kind of elements: "all", "valid", "foreground", "strong", or "masked" with a code of one's own.

    Weights are data, or data less background. Positions are pixels from the corner, centres at halves; the variance is
    the weighted mean square distance from the centre. Both are null if the weights sum to zero.
    """
    bits = code if kind == "masked" else CENTROIDS[kind]
    w = masked(minus(data, background) if background is not None else data, mask, bits or 0)
    total = _sum(w)
    axes = {"x": lambda i: i % nx, "y": lambda i: F.floor(i / nx) % ny, "z": lambda i: F.floor(i / (nx * ny))}

    def moment(place, power: int) -> Column:
        return F.when(total != 0, _sum(F.transform(w, lambda v, i: v * F.pow(place(i) + 0.5, F.lit(power)))) / total)

    mean = {a: moment(p, 1) for a, p in axes.items()}
    return F.struct(*(mean[a].alias(a) for a in axes), *((moment(p, 2) - mean[a] * mean[a]).alias(f"var_{a}") for a, p in axes.items()))


# intensities and backgrounds


def bayesian_intensity(data: Column, background: Column, mask: Column) -> Column:
    """value, variance: the summed intensity, and the counts' and background's own variance under flat priors, one count more each."""
    total, bg = masked_sum(data, mask, VALID | FOREGROUND), masked_sum(background, mask, VALID | FOREGROUND)
    n_fg, n_bg = count_mask(mask, VALID | FOREGROUND), count_mask(mask, VALID | BACKGROUND_USED)
    ratio = F.when(n_bg > 0, n_fg / n_bg).otherwise(0.0)
    return F.struct(F.greatest(total - bg, F.lit(0.0)).alias("value"), (total + 1 + ratio * (bg + 1)).alias("variance"))


def mean_of(data: Column, mask: Column, code: int) -> Column:
    """Mean of the elements that have all bits of code; 0 without any."""
    n = count_mask(mask, code)
    return F.when(n > 0, masked_sum(data, mask, code) / n).otherwise(0.0)


def mean_background(data: Column, mask: Column) -> Column:
    """Mean of the pixels used for the background."""
    return mean_of(data, mask, VALID | BACKGROUND_USED)


def mean_modelled_background(background: Column, mask: Column) -> Column:
    """Mean of the modelled background under the foreground."""
    return mean_of(background, mask, VALID | FOREGROUND)


def invalid_flags(mask: Column) -> Column:
    """any, background, foreground: whether a pixel at all, of the background or of the foreground, isn't valid."""
    def missing(code: int) -> Column:
        return count_mask(mask, code) > count_mask(mask, code | VALID)

    return F.struct((count_mask(mask, VALID) < F.size(mask)).alias("any"), missing(BACKGROUND).alias("background"), missing(FOREGROUND).alias("foreground"))


# edits


def with_image(data: Column, pixels: Column) -> Column:
    """data with a box's pixels in place of it, where they are given."""
    return F.zip_with(data, pixels, lambda d, p: F.coalesce(p, d))


def with_static_mask(mask: Column, good: Column) -> Column:
    """mask without the valid bit where a static mask says no."""
    return F.zip_with(mask, good, lambda m, g: F.when(g, m).otherwise(m.bitwiseAND(F.lit(~VALID))))


def with_background_mask(mask: Column, background: Column) -> Column:
    """mask with the background bit where told, and not the foreground's there."""
    return F.zip_with(mask, background, lambda m, b: F.when(b, m.bitwiseOR(F.lit(BACKGROUND)).bitwiseAND(F.lit(~FOREGROUND))).otherwise(m))


def mask_neighbours(mask: Column, others: Column) -> Column:
    """mask with the overlap bit, and neither foreground nor background, where another box has foreground."""
    return F.zip_with(mask, others, lambda m, o: F.when(o, m.bitwiseOR(F.lit(OVERLAPPED)).bitwiseAND(F.lit(~(FOREGROUND | BACKGROUND)))).otherwise(m))


def planes(data: Column, z0: Column, z: Column, nx: Column, ny: Column) -> Column:
    """One plane of a box that begins at z0."""
    return F.slice(data, ((z - z0) * nx * ny + 1).cast("int"), (nx * ny).cast("int"))


# rejection of outlying background pixels: masks of what stays


def within_deviations(data: Column, deviations: float) -> Column:
    """Elements within so many sample deviations of the mean."""
    n = F.size(data)
    mean = _sum(data) / n
    spread = F.sqrt(_sum(F.transform(data, lambda v: v * v)) / n - mean * mean)
    return F.transform(F.array(F.struct(mean.alias("m"), spread.alias("s"))), lambda b: F.transform(data, lambda v: F.abs(v - b["m"]) <= deviations * b["s"]))[0]


def within_quantiles(data: Column, lower: float, upper: float) -> Column:
    """Elements left when so large a share of the lowest and of the highest ones goes."""
    ranked = F.array_sort(data)
    n = F.size(data)
    bounds = F.array(F.struct(F.get(ranked, F.floor(n * lower).cast("int")).alias("lo"), F.get(ranked, (n - 1 - F.floor(n * upper)).cast("int")).alias("hi")))
    return F.transform(bounds, lambda b: F.transform(data, lambda v: (v >= b["lo"]) & (v <= b["hi"])))[0]


def within_quartiles(data: Column, k: float = 1.5) -> Column:
    """Elements within k times the distance of the quartiles beyond them; quartiles by linear interpolation."""
    ranked = F.array_sort(data)

    def quantile(p: float) -> Column:
        at = (F.size(data) - 1) * F.lit(p)
        low = F.floor(at)
        return F.get(ranked, low.cast("int")) + (at - low) * (F.get(ranked, F.ceil(at).cast("int")) - F.get(ranked, low.cast("int")))

    bounds = F.array(F.struct(quantile(0.25).alias("a"), quantile(0.75).alias("b")))
    return F.transform(bounds, lambda q: F.transform(data, lambda v: (v >= q["a"] - k * (q["b"] - q["a"])) & (v <= q["b"] + k * (q["b"] - q["a"]))))[0]


def robust_poisson_mean(data: Column, rounds: int = 30, tuning: float = 1.345) -> Column:
    """A mean of counts by reweighting: elements farther than ``tuning`` deviations weigh less by their distance; of so many rounds."""
    def step(mean: Column) -> Column:
        def weight(v: Column) -> Column:
            off = F.abs(v - mean) / F.sqrt(F.greatest(mean, F.lit(1e-6)))
            return F.when(off <= tuning, 1.0).otherwise(tuning / off)

        sums = F.aggregate(data, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda s, v: F.struct((s["v"] + weight(v) * v).alias("v"), (s["w"] + weight(v)).alias("w")))
        return F.transform(F.array(sums), lambda s: s["v"] / s["w"])[0]

    start = F.get(F.array_sort(data), F.floor((F.size(data) - 1) / 2).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: step(m))
