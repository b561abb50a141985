"""Bins by edges, by equal width or population, and statistics of each bin, empty ones included."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Number of the last edge that is at most x; 0 below the first. There are as many bins as edges: the last is open."""
    if sorted(set(edges)) != list(edges):
        raise ValueError("edges must increase")
    below = F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= x)
    return F.greatest(F.lit(0), F.size(below) - 1)


def uniform_bin(x: Column, low: float, high: float, n: int) -> Column:
    """0 to n - 1 in equal steps from low to high; values outside go to the end bins."""
    step = (high - low) / n
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) / step).cast("int")))


def resolution_bin(d: Column, d_min: float, d_max: float, n: int) -> Column:
    """Bins of equal width in 1 / d squared."""
    return uniform_bin(1 / (d * d), 1 / d_max**2, 1 / d_min**2, n)


def volume_bin(d: Column, d_min: float, d_max: float, n: int) -> Column:
    """Shells of equal volume: bins of equal width in 1 / d cubed."""
    return uniform_bin(1 / (d * d * d), 1 / d_max**3, 1 / d_min**3, n)


def all_bins(binned: DataFrame, n: int, zeros: list[str], key: str = "bin") -> DataFrame:
    """A row per bin 0 to n - 1, with zeros for bins that have none."""
    grid = binned.sparkSession.range(n).select(F.col("id").cast("int").alias(key))
    return grid.join(F.broadcast(binned), key, "left").fillna(0, zeros)  # a row per bin


def bin_sums(table: DataFrame, bin_: Column, value: str, n: int) -> DataFrame:
    """bin, n, total, mean of each bin; an empty one has zeros."""
    out = table.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return all_bins(out, n, ["n", "total", "mean"])


def bin_quartiles(table: DataFrame, bin_: Column, value: str, n: int) -> DataFrame:
    """bin, median, iqr by linear interpolation, exact; an empty bin has zeros."""
    from tessera.operators.ranks import quantiles

    out = quantiles(table.withColumn("bin", bin_.cast("int")), ["bin"], value, [0.25, 0.5, 0.75], ["a", "b", "c"])
    return all_bins(out.select("bin", F.col("b").alias("median"), (F.col("c") - F.col("a")).alias("iqr")), n, ["median", "iqr"])


def equal_population(table: DataFrame, key: str, value: str, order: list[str], target: int, least: int = 5, most: int = 20) -> DataFrame:
    """table with slot: within each key, as many slots of equal population as hold about target rows, between least and most.

    A row's place is that of its value and, among rows of one value, its order.
    """
    from tessera.operators.ranks import value_places

    places = value_places(table, [key], value)
    sizes = places.groupBy(key).agg(F.sum("n").alias("_all"))
    met = table.join(places.select(key, value, "before"), [key, value]).join(sizes, key)
    place = F.col("before") + F.row_number().over(Window.partitionBy(key, value).orderBy(*order)) - 1
    slots = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("_all") / target)))
    return met.withColumn("slot", F.floor(place * slots / F.col("_all")).cast("int")).drop("before", "_all")


def step_bin(d: Column, d_min: float, d_max: float, least: float = 0.004, bins: int = 20) -> Column:
    """Bins of equal width in 1 / d squared, over a range widened by 1e-6, in steps of ``least`` or more."""
    low, high = 1 / d_max**2 - 1e-6, 1 / d_min**2 + 1e-6
    step = max((high - low) / bins, least)
    return F.greatest(F.lit(0), F.least(F.lit(max(1, math.ceil((high - low) / step)) - 1), F.floor((1 / (d * d) - low) / step).cast("int")))


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of bins of equal width in the logarithm, ascending."""
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * k / bins) for k in range(bins)]


def merge_small(counts: list[int], edges: list[float], least: int) -> list[float]:
    """The edges left when bins of fewer than ``least`` rows join the next lower one, from the highest down."""
    out, held = [], 0
    for n, edge in zip(counts[::-1], edges[::-1], strict=True):
        held += n
        if held >= least:
            out.append(edge)
            held = 0
    return sorted({edges[0], *out[: len(out)]} if out else {edges[0]})


def bin_variances(table: DataFrame, bin_: Column, value: str, n: int) -> DataFrame:
    """bin, variance: mean square less squared mean; 0 for an empty bin."""
    return all_bins(table.groupBy(bin_.cast("int").alias("bin")).agg(F.var_pop(value).alias("variance")), n, ["variance"])


def shell_counts(table: DataFrame, d: Column, d_min: float, d_max: float, n: int) -> DataFrame:
    """bin, n: rows per shell of equal width in 1 / d squared."""
    return all_bins(table.groupBy(resolution_bin(d, d_min, d_max, n).alias("bin")).agg(F.count("*").alias("n")), n, ["n"])


def islands(flagged: DataFrame, at: str, bad: str, by: list[str] | None = None) -> DataFrame:
    """first, last of each run of consecutive integers ``at`` for which ``bad`` holds."""
    by = by or []
    rows = flagged.where(bad)
    order = Window.partitionBy(*by).orderBy(at)
    run = rows.withColumn("run", F.col(at) - F.row_number().over(order))
    return run.groupBy(*by, "run").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("run")
