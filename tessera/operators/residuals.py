"""Report tables over one pass each: residuals of positions, significance, partiality, profiles, integration summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.flags import FLAGS, has_flags
from tessera.functions.scalar import histogram


def spots_per_image(table: DataFrame, z: Column, flags: Column, dataset: str = "id") -> DataFrame:
    """image, id, n, n_indexed: rows and indexed rows per image and dataset, and of all datasets with a null id."""
    rows = table.select(F.floor(z).cast("int").alias("image"), F.col(dataset).alias("id"), has_flags(flags, FLAGS["indexed"]).cast("long").alias("i"))
    return rows.groupBy("image", "id").agg(F.count("*").alias("n"), F.sum("i").alias("n_indexed")).rollup("image", "id").agg(F.sum("n").alias("n"), F.sum("n_indexed").alias("n_indexed")).where("image IS NOT NULL")


def residual(observed: list[Column], predicted: list[Column]) -> Column:
    """The distance of observed from predicted positions."""
    d2 = F.lit(0.0)
    for a, b in zip(observed, predicted, strict=True):
        d2 = d2 + (a - b) * (a - b)
    return F.sqrt(d2)


def residual_histogram(table: DataFrame, observed: list[Column], predicted: list[Column], most: float, slots: int) -> DataFrame:
    """slot, n, total of distances up to ``most``."""
    return histogram(table, residual(observed, predicted), 0.0, most, slots)


def map_of(table: DataFrame, x: Column, y: Column, step: float, value: Column, condition: Column | None = None) -> DataFrame:
    """xbin, ybin, n, mean of a value over a grid of cells."""
    rows = table if condition is None else table.where(condition)
    return rows.groupBy(F.floor(x / step).cast("int").alias("xbin"), F.floor(y / step).cast("int").alias("ybin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def residuals_by_angle(table: DataFrame, angle: Column, step: float, parts: dict[str, Column]) -> DataFrame:
    """bin, n, and mean and root mean square of each part of the residual, per bin of angle."""
    aggs = [f.alias(f"{kind}_{n}") for n, c in parts.items() for kind, f in (("mean", F.avg(c)), ("rms", F.sqrt(F.avg(c * c))))]
    return table.groupBy(F.floor(angle / step).cast("int").alias("bin")).agg(F.count("*").alias("n"), *aggs)


def cross_plots(table: DataFrame, parts: dict[str, Column], step: float) -> DataFrame:
    """pair, a, b, n: two-dimensional histograms of all pairs of residual parts, by one pass over grouping sets of their bins."""
    names = list(parts)
    binned = table.select(*(F.floor(c / step).cast("int").alias(n) for n, c in parts.items()))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = F.explode(F.array(*(F.struct(F.lit(f"{a}{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))).alias("s")
    return binned.groupBy(*names).agg(F.count("*").alias("n")).select(each, "n").groupBy("s.pair", "s.a", "s.b").agg(F.sum("n").alias("n"))


def significance_histogram(table: DataFrame, value: str, variance: str, most: float, slots: int) -> DataFrame:
    """slot, n, total of I / sigma of rows of positive value and variance; larger ones in the last slot."""
    good = table.where((F.col(value) > 0) & (F.col(variance) > 0))
    return histogram(good, F.least(F.col(value) / F.sqrt(variance), F.lit(most)), 0.0, most, slots)


def significance_by_image(table: DataFrame, z: Column, value: str, variance: str) -> DataFrame:
    """image, n, i_over_sigma of rows of positive value and variance."""
    good = table.where((F.col(value) > 0) & (F.col(variance) > 0))
    return good.groupBy(F.floor(z).cast("int").alias("image")).agg(F.count("*").alias("n"), F.avg(F.col(value) / F.sqrt(variance)).alias("i_over_sigma"))


def partiality_histogram(table: DataFrame, partiality: str = "partiality", slots: int = 20) -> DataFrame:
    """slot, n, total of positive partialities over [0, 1]."""
    return histogram(table.where(F.col(partiality) > 0), F.col(partiality), 0.0, 1.0, slots)


def correlation_by(table: DataFrame, bin_: Column, correlation: str) -> DataFrame:
    """bin, n, mean, low, high of profile correlations."""
    return table.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(correlation).alias("mean"), F.min(correlation).alias("low"), F.max(correlation).alias("high"))


#: Counts of an integration report: name and flag.
REPORT_FLAGS = {
    "n_overload": "overloaded",
    "n_ice": "in_powder_ring",
    "n_summed": "integrated_sum",
    "n_fitted": "integrated_prf",
    "n_integrated": "integrated",
    "n_invalid_bg": "background_includes_bad_pixels",
    "n_invalid_fg": "foreground_includes_bad_pixels",
    "n_failed_background": "failed_during_background_modelling",
    "n_failed_summation": "failed_during_summation",
    "n_failed_fitting": "failed_during_profile_fitting",
}


def _report_aggs(full: float) -> list[Column]:
    flags = F.col("flags")

    def has(name: str) -> Column:
        return has_flags(flags, FLAGS[name], every=name != "integrated")

    def mean(condition: Column, value: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))

    fitted, summed = has("integrated_prf"), has("integrated_sum")
    return [
        F.count("*").alias("n"),
        F.sum((F.col("partiality") >= full).cast("long")).alias("n_full"),
        F.sum((~(F.col("partiality") >= full)).cast("long")).alias("n_partial"),
        *(F.sum(has(f).cast("long")).alias(n) for n, f in REPORT_FLAGS.items()),
        mean(has("integrated"), F.col("background")).alias("mean_background"),
        mean(summed, F.col("sum_value") / F.sqrt("sum_variance")).alias("ios_sum"),
        mean(fitted, F.col("prf_value") / F.sqrt("prf_variance")).alias("ios_prf"),
        mean(fitted, F.col("correlation")).alias("cc_prf"),
        F.coalesce(F.corr(F.when(summed & fitted, F.col("sum_value")), F.when(summed & fitted, F.col("prf_value"))), F.lit(0.0)).alias("cc_pearson_sum_prf"),
    ]


def integration_overall(table: DataFrame, full: float = 0.99) -> DataFrame:
    """One row: counts of full and partial rows and of flags, mean background, mean I / sigma, mean profile correlation, correlation of summed and fitted values; 0 where there is none."""
    return table.agg(*_report_aggs(full))


def integration_binned(table: DataFrame, bin_: Column, bins: int, full: float = 0.99) -> DataFrame:
    """The same per bin, with zeros for empty bins."""
    out = table.groupBy(bin_.cast("int").alias("bin")).agg(*_report_aggs(full))
    grid = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(out), "bin", "left").fillna(0)  # a row per bin


def as_integrated(table: DataFrame) -> DataFrame:
    """Indexed spots in the shape of integrated rows: summed intensity as scaled-ready columns, flags set, partiality 1."""
    rows = table.where(has_flags(F.col("flags"), FLAGS["indexed"]))
    flags = F.col("flags").bitwiseOR(F.lit(FLAGS["integrated_sum"]))
    return rows.withColumns({"flags": flags, "partiality": F.lit(1.0), "partial_id": F.col("row_id")})


def connectivity(table: DataFrame, dataset: str, model: str) -> DataFrame:
    """dataset, model: which models a dataset's rows name; pivot it for the matrix."""
    return table.select(dataset, model).distinct()


def text_histogram(counts: DataFrame, at: str, n: str, rows: int = 10, width: int = 60) -> str:
    """A plot in characters of a table of counts, summed to ``width`` columns; the table has a row per image."""
    ends = counts.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if ends.lo is None:
        return ""
    step = max(1, -(-(ends.hi - ends.lo + 1) // width))
    summed = counts.groupBy(F.floor((F.col(at) - ends.lo) / step).cast("int").alias("c")).agg(F.sum(n).alias("n")).collect()  # ``width`` rows
    heights = {r.c: r.n for r in summed}
    top = max(heights.values())
    columns = range(max(heights) + 1)
    lines = ["".join("*" if heights.get(c, 0) * rows > top * (rows - 1 - r) else " " for c in columns).rstrip() for r in range(rows)]
    return "\n".join([f"{top} rows at most, {step} images a column", *lines, f"images {ends.lo} to {ends.hi}"])


def reject_brightest(table: DataFrame, image: str, value: str, row_id: str, least: float = 1e-10) -> DataFrame:
    """Rows of each image without its brightest ones, one after the other, while so bright a row among so many is less likely than ``least``.

    With values as exponential about the mean of the others, the brightest of n is so bright with 1 - (1 - exp(-v / mean))^n.
    One image is one group: some thousands of rows.
    """
    import numpy as np

    def kept(f):
        f = f.sort_values([value, row_id]).reset_index(drop=True)
        v = f[value].to_numpy(dtype=float)
        n = len(v)
        sums = np.cumsum(v)
        while n > 2:
            mean = sums[n - 2] / (n - 1)
            if mean <= 0 or -np.expm1((n) * np.log1p(-np.exp(-v[n - 1] / mean))) >= least:
                break
            n -= 1
        return f.iloc[:n]

    return table.groupBy(image).applyInPandas(kept, table.schema)


def mahalanobis_outliers(table: DataFrame, by: list[str], columns: list[str], threshold: float, row_id: str, share: float = 0.75, least: int = 20, steps: int = 20) -> DataFrame:
    """by, row_id, distance, outlier: squared robust distances from the centre of the densest part of each job's rows.

    The minimum covariance determinant: from several starts, the ``share`` of rows nearest to the centre gives the next
    centre and covariance until they stand still; the least determinant wins, and distances are scaled so that their
    median is the chi-square one. Jobs of fewer than ``least`` rows are outliers all. A job is one group.
    """
    import numpy as np
    import pandas as pd

    p = len(columns)
    chi_median = p * (1 - 2 / (9 * p)) ** 3

    def judged(f):
        x = f[columns].to_numpy(dtype=float)
        out = pd.DataFrame({**{c: f[c] for c in by}, row_id: f[row_id], "distance": np.inf, "outlier": True})
        n = len(x)
        if n < least:
            return out
        h = max(p + 1, int(np.ceil(share * n)))
        order = np.argsort(f[row_id].to_numpy(), kind="stable")
        best = (np.inf, None)
        for start in range(5):
            near = order[np.arange(start, n, 5)] if start else order
            centre, cov = np.median(x[near], axis=0), np.cov(x[near], rowvar=False).reshape(p, p)
            for _ in range(steps):
                d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
                near = np.argsort(d, kind="stable")[:h]
                new = x[near].mean(axis=0)
                cov = np.cov(x[near], rowvar=False).reshape(p, p)
                if np.allclose(new, centre, rtol=1e-12, atol=0):
                    break
                centre = new
            if (det := float(np.linalg.det(cov))) < best[0]:
                best = (det, (centre, cov))
        centre, cov = best[1]
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
        d *= chi_median / np.median(d)
        return out.assign(distance=d, outlier=d > threshold)

    kinds = dict(table.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, row_id]) + ", distance double, outlier boolean"
    return table.select(*by, row_id, *columns).groupBy(*by).applyInPandas(judged, schema)


def fit_mixture(table: DataFrame, bin_: str, value: str, parts: int = 2, rounds: int = 100) -> DataFrame:
    """bin, part, weight, mean, variance: a mixture of normal curves per bin by expectation and maximisation, parts by mean. A bin is one group."""
    import numpy as np
    import pandas as pd

    def fitted(f):
        x = np.sort(f[value].to_numpy(dtype=float))
        k = min(parts, len(np.unique(x)))
        mean = np.quantile(x, (np.arange(k) + 0.5) / k)
        var, weight = np.full(k, x.var() + 1e-12), np.full(k, 1 / k)
        for _ in range(rounds):
            logp = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
            r = np.exp(logp - logp.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            n = r.sum(axis=0) + 1e-300
            new = (r * x[:, None]).sum(axis=0) / n
            var = (r * (x[:, None] - new) ** 2).sum(axis=0) / n + 1e-12
            weight = n / n.sum()
            if np.allclose(new, mean, rtol=1e-12, atol=0):
                break
            mean = new
        at = np.argsort(mean)
        return pd.DataFrame({bin_: f[bin_].iloc[0], "part": np.arange(k, dtype=np.int32), "weight": weight[at], "mean": mean[at], "variance": var[at]})

    return table.select(bin_, value).groupBy(bin_).applyInPandas(fitted, f"{bin_} {dict(table.dtypes)[bin_]}, part int, weight double, mean double, variance double")


def poisson_expected_max(mean: float, n: int) -> int:
    """The count that the greatest of n counts of a mean reaches with one expected: the least k with n P(X > k) < 1."""
    import math

    term = total = math.exp(-mean)
    k = 0
    while n * (1 - total) >= 1 and k < 10_000_000:
        k += 1
        term *= mean / k
        total += term
        if term == 0:
            break
    return k
