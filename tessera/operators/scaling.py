"""Loops around grouped sums: scales of datasets, error models, removal of bad datasets, cross validation, clusters of cells.

What a loop carries is a row per dataset or bin; the rows stay where they are and each round reads them once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import groups, outliers, statistics


def scale_datasets(table: DataFrame, key: list[str], dataset: str, value: str, variance: str, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """dataset, scale: the scales g that bring I / g of common keys together, of mean 1 weighted by rows.

    Each round estimates every key's intensity with the present scales, and each dataset's scale against these, weighted by
    1 / variance, until no scale changes by more than the tolerance, or for so many rounds. A dataset that shares no key
    keeps 1.
    """
    rows = table.where(F.col(variance) > 0).select(*key, dataset, value, variance)
    own = rows.groupBy(*key, dataset).agg(F.count("*").alias("n"), F.sum(F.col(value) / F.col(variance)).alias("x"), F.sum(1 / F.col(variance)).alias("w")).checkpoint()
    scales = own.groupBy(dataset).agg(F.lit(1.0).alias("g"), F.sum("n").alias("n"))
    scales = scales.checkpoint()
    for _ in range(rounds):
        met = own.join(F.broadcast(scales.select(dataset, "g")), dataset)  # a row per dataset
        by = Window.partitionBy(*key)
        best = F.sum(F.col("g") * F.col("x")).over(by) / F.sum(F.col("g") * F.col("g") * F.col("w")).over(by)
        new = met.withColumn("ih", best).groupBy(dataset).agg((F.sum(F.col("ih") * F.col("x")) / F.sum(F.col("ih") * F.col("ih") * F.col("w"))).alias("new"))
        joined = scales.join(new, dataset)
        mean = joined.agg((F.sum(F.col("new") * F.col("n")) / F.sum("n")).alias("m")).first().m or 1.0
        after = joined.select(dataset, (F.coalesce("new", "g") / mean).alias("g"), "n", F.abs(F.coalesce("new", "g") / mean - F.col("g")).alias("moved")).checkpoint()
        moved = after.agg(F.max("moved").alias("m")).first().m
        scales = after.drop("moved")
        if moved is None or moved <= tolerance:
            break
    return scales.select(dataset, F.col("g").alias("scale"))


def scaled(table: DataFrame, scales: DataFrame, dataset: str, value: str, variance: str) -> DataFrame:
    """table with value and variance on the common scale."""
    met = table.join(F.broadcast(scales.withColumnRenamed("scale", "_g")), dataset)  # a row per dataset
    return met.withColumns({value: F.col(value) / F.col("_g"), variance: F.col(variance) / (F.col("_g") * F.col("_g"))}).drop("_g")


def error_deviations(table: DataFrame, key: list[str], value: str, variance: str, bins: int = 10) -> DataFrame:
    """bin, n, intensity, variance, spread: by tenths of the logarithm of the group's mean, mean squared intensity, mean variance, and mean squared deviation from the group's mean times n / (n - 1)."""
    by = Window.partitionBy(*key)
    n, mean = F.count("*").over(by), F.avg(value).over(by)
    rows = table.withColumns({"_n": n, "_m": mean}).where("_n > 1 AND _m > 0")
    ends = rows.agg(F.min(F.ln("_m")).alias("lo"), F.max(F.ln("_m")).alias("hi")).first()
    if ends.lo is None:
        return rows.sparkSession.createDataFrame([], "bin int, n long, intensity double, variance double, spread double")
    step = (ends.hi - ends.lo) / bins or 1.0
    bin_ = F.least(F.lit(bins - 1), F.floor((F.ln("_m") - ends.lo) / step)).cast("int")
    off = (F.col(value) - F.col("_m")) * (F.col(value) - F.col("_m")) * F.col("_n") / (F.col("_n") - 1)
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("_m") * F.col("_m")).alias("intensity"), F.avg(variance).alias("variance"), F.avg(off).alias("spread"))


def fit_error_model(deviations: DataFrame) -> tuple[float, float]:
    """a, b of a^2 (variance + (b I)^2) that meet the bins' spreads: least squares of spread over variance, weighted by rows; a row per bin reaches the driver."""
    rows = deviations.where("n > 0").collect()
    if not rows:
        return 1.0, 0.0
    x = np.array([r.intensity / r.variance for r in rows])
    y = np.array([r.spread / r.variance for r in rows])
    w = np.array([r.n for r in rows], float) / np.maximum(y, 1e-12) ** 2
    design = np.stack([np.ones_like(x), x], axis=1)
    h, g = design.T @ (design * w[:, None]), design.T @ (w * y)
    aa, slope = np.linalg.lstsq(h, g, rcond=None)[0]
    if aa <= 0:
        return 1.0, math.sqrt(max(0.0, float((w * y * x).sum() / (w * x * x).sum())))
    return math.sqrt(aa), math.sqrt(max(0.0, slope / aa))


def scale_and_filter(table: DataFrame, key: list[str], dataset: str, bin_: str, value: str, variance: str, bins: int, deviations: float, most_removed: float = 0.1, cycles: int = 6) -> tuple[DataFrame, list]:
    """Rows left and the datasets removed: scaling, then removal of datasets whose delta CC1/2 is low, until none is, so many cycles are done or the share of rows removed would pass a limit."""
    removed: list = []
    total = table.count()
    for _ in range(cycles):
        left = scaled(table, scale_datasets(table, key, dataset, value, variance), dataset, value, variance)
        judged = statistics.below_cutoff(statistics.delta_cc_half_binned(left, key, dataset, bin_, value, bins), deviations)
        bad = [r[dataset] for r in judged.where("removed").select(dataset).collect()]  # datasets below a cutoff: a small share of them
        if not bad:
            break
        kept = table.where(~F.col(dataset).isin(bad))
        if kept.count() < (1 - most_removed) * total:
            break
        removed += sorted(bad)
        table = kept
    return table, removed


def cross_validate(table: DataFrame, key: str, value: str, variance: str, every: int, folds: int, dataset: str) -> DataFrame:
    """fold, r_work, r_free: R-merge of the keys used and of those set apart, with scales found without the latter, for each offset of the free set."""
    out = None
    for k in range(folds):
        free = F.pmod(F.col(key), F.lit(every)) == k
        scales = scale_datasets(table.where(~free), [key], dataset, value, variance, rounds=3)
        rows = scaled(table, scales, dataset, value, variance).withColumn("_free", free)
        off = F.abs(F.col(value) - F.avg(value).over(Window.partitionBy(key)))
        rows = rows.withColumn("_off", off)

        def r(side: Column) -> Column:
            return F.sum(F.when(side, F.col("_off"))) / F.sum(F.when(side, F.col(value)))

        one = rows.agg(F.lit(k).alias("fold"), r(~F.col("_free")).alias("r_work"), r(F.col("_free")).alias("r_free"))
        out = one if out is None else out.unionByName(one)
    return out


def scaling_cycle(table: DataFrame, key: list[str], dataset: str, value: str, variance: str, zmax: float, row_id: str = "row_id") -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """scales, outliers and error model of one cycle: scale, reject outliers, scale again without them, fit the error model."""
    first = scaled(table, scale_datasets(table, key, dataset, value, variance), dataset, value, variance)
    bad = outliers.iterative_outliers(first, key, F.col(value), F.lit(1.0), 1 / F.col(variance), zmax, row_id)
    good = table.join(bad, row_id, "left_anti")
    scales = scale_datasets(good, key, dataset, value, variance)
    return scales, bad, fit_error_model(error_deviations(scaled(good, scales, dataset, value, variance), key, value, variance))


def select_connected(table: DataFrame, key: list[str], dataset: str, least: int) -> DataFrame:
    """Rows of the keys that most datasets share, as many keys as give each dataset ``least`` rows, ties by key."""
    shared = table.groupBy(*key).agg(F.countDistinct(dataset).alias("_d"))
    ranked = table.join(shared, key).withColumn("_r", F.row_number().over(Window.partitionBy(dataset).orderBy(F.desc("_d"), *key)))
    wanted = ranked.where(F.col("_r") <= least).select(*key).distinct()
    return table.join(wanted, key, "left_semi")


def cell_clusters(cells: list[tuple], threshold: float) -> list[int]:
    """Clusters of unit cells by single linkage of their Euclidean distance, numbered by first member: for the list of datasets' models, on the driver."""
    x = np.asarray(cells, float)
    label = list(range(len(x)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.sqrt(((x[:i] - x[i]) ** 2).sum(axis=1)) <= threshold) if i else ():
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names)) for i in range(len(x))]


def merged(table: DataFrame, key: list[str], value: str, variance: str, internal: bool = False) -> DataFrame:
    """key, merged, merged_var, n; with ``internal`` the greater of the variance by 1 / variance and that of the rows' spread."""
    out = groups.merge_equivalents(table, key, value, variance)
    if not internal:
        return out
    w = 1 / F.col(variance)
    sums = table.groupBy(*key).agg(F.count("*").alias("_n"), F.sum(w).alias("_w"), F.sum(w * F.col(value)).alias("_x"), F.sum(w * F.col(value) * F.col(value)).alias("_xx"))
    spread = (F.col("_xx") / F.col("_w") - (F.col("_x") / F.col("_w")) * (F.col("_x") / F.col("_w"))) / (F.col("_n") - 1)
    return out.join(sums, key).withColumn("merged_var", F.when(F.col("_n") > 1, F.greatest("merged_var", spread)).otherwise(F.col("merged_var"))).select(*out.columns)


def posterior_moments(table: DataFrame, bin_: str, value: str, variance: str, steps: int = 400) -> DataFrame:
    """table with intensity and amplitude, and their deviations, expected of true intensities that are positive and exponential about their bin's mean (weak or negative ones are drawn up)."""
    mean = table.groupBy(bin_).agg(F.greatest(F.avg(value), F.lit(1e-6)).alias("_mean"))
    rows = table.join(F.broadcast(mean), bin_)  # a row per bin
    schema = table.select("*").schema
    for c in ("intensity", "intensity_sigma", "amplitude", "amplitude_sigma"):
        schema = schema.add(c, "double")

    def expected(frames):
        for f in frames:
            i, s, m = f[value].to_numpy(float), np.sqrt(f[variance].to_numpy(float)), f["_mean"].to_numpy(float)
            mid = i - s * s / m  # the product of both curves is normal about this, cut at zero
            top = np.maximum(mid, 0) + 8 * s
            low = np.maximum(mid - 8 * s, 0)
            at = (np.arange(steps) + 0.5) / steps
            j = low[:, None] + (top - low)[:, None] * at
            logp = -((j - mid[:, None]) ** 2) / (2 * s * s)[:, None]
            p = np.exp(logp - logp.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            one, two, half = (p * j).sum(axis=1), (p * j * j).sum(axis=1), (p * np.sqrt(j)).sum(axis=1)
            yield f.drop(columns="_mean").assign(
                intensity=one, intensity_sigma=np.sqrt(np.maximum(two - one * one, 0)), amplitude=half, amplitude_sigma=np.sqrt(np.maximum(one - half * half, 0))
            )

    return rows.mapInPandas(expected, schema)
