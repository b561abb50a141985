"""Filters and reports that work in two steps: a small aggregate, then rows against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import value_places


def significance_filter(table: DataFrame, dataset: str, bin_: str, i_over_sigma: Column, least: float) -> DataFrame:
    """Rows of each dataset's leading run of bins whose mean of positive I / sigma is at least ``least``; datasets without such a bin are gone."""
    bins = table.where(i_over_sigma > 0).groupBy(dataset, bin_).agg((F.avg(i_over_sigma) >= least).cast("int").alias("ok"))
    lead = Window.partitionBy(dataset).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)  # a row per bin
    good = bins.withColumn("run", F.min("ok").over(lead)).where("run = 1").groupBy(dataset).agg(F.max(bin_).alias("_last"))
    return table.join(F.broadcast(good), dataset).where(F.col(bin_) <= F.col("_last")).drop("_last")  # a row per dataset


def dead_time(table: DataFrame, windows: DataFrame, z0: str, z1: str, most: float) -> DataFrame:
    """Rows of which dead windows (lo, hi) cover at most a share of [z0, z1)."""
    spans = windows.agg(F.collect_list(F.struct("lo", "hi")).alias("_w"))  # one row: a few windows of one scan
    rows = table.withColumn("_k", F.pmod(F.col(z0).cast("long"), F.lit(1)))
    met = rows.join(F.broadcast(spans.withColumn("_k", F.lit(0).cast("long"))), "_k", "left")
    covered = F.aggregate(
        F.coalesce("_w", F.array()),
        F.lit(0.0),
        lambda s, w: s + F.greatest(F.lit(0.0), F.least(F.col(z1), w["hi"]) - F.greatest(F.col(z0), w["lo"])),
    )
    return met.where(covered / (F.col(z1) - F.col(z0)) <= most).drop("_k", "_w")


def unique_pixels(boxes: DataFrame, by: list[str], x: tuple[str, str], y: tuple[str, str], row_id: str = "row_id", diagonal_only: bool = False) -> DataFrame:
    """Rows none of whose pixels another row claims; the diagonal alone on request."""
    a = boxes.withColumn("_x", F.explode(F.sequence(F.col(x[0]), F.col(x[1]) - 1)))
    if diagonal_only:
        pixels = a.withColumn("_y", F.col(y[0]) + F.col("_x") - F.col(x[0])).where(F.col("_y") < F.col(y[1]))
    else:
        pixels = a.withColumn("_y", F.explode(F.sequence(F.col(y[0]), F.col(y[1]) - 1)))
    place = [*by, "_x", "_y"]
    many = pixels.groupBy(*place).agg(F.min(row_id).alias("lo"), F.max(row_id).alias("hi")).where("lo <> hi").select(*place)
    return boxes.join(pixels.join(many, place).select(row_id).distinct(), row_id, "left_anti")


def normalised_squares(table: DataFrame, bin_: str, value: str) -> DataFrame:
    """table with e_squared: the value over its bin's mean."""
    mean = table.groupBy(bin_).agg(F.avg(value).alias("_m"))
    return table.join(F.broadcast(mean), bin_).withColumn("e_squared", F.col(value) / F.col("_m")).drop("_m")  # a row per bin


def anomalous_signal(mates: DataFrame, sigma: float) -> DataFrame:
    """n, dano_over_sigma of pairs with both mates."""
    both = mates.where(F.col("plus").isNotNull() & F.col("minus").isNotNull())
    return both.agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("plus") - F.col("minus"))) / sigma).alias("dano_over_sigma"))


def missing_keys(observed: DataFrame, complete: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the complete set that no row has."""
    return complete.select(*keys).join(observed.select(*keys).distinct(), keys, "left_anti")


def free_set(table: DataFrame, key: str, every: int, offset: int = 0) -> DataFrame:
    """table with free: whether the row's key is each every-th of the distinct keys in order."""
    # distinct keys ranked in two steps: within ranges, then by the ranges' sizes
    keys = table.select(key).distinct().withColumn("_part", F.floor(F.col(key) / 65536))
    sizes = keys.groupBy("_part").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).select("_part", "_before")
    ranked = keys.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1).join(before, "_part")
    free = (F.col("_rank") + F.col("_before") - offset) % every == 0
    return table.join(ranked.select(key, free.alias("free")), key)


def expanded_multiples(first: int, last: int, every: int, spark) -> DataFrame:
    """image: each every-th image of first to last."""
    return spark.range(first, last + 1, every).select(F.col("id").cast("int").alias("image"))


def block_ranges(first: int, last: int, blocks: int) -> list[tuple[int, int]]:
    """Near-equal half-open blocks of a scan."""
    n = last - first
    return [(first + n * k // blocks, first + n * (k + 1) // blocks) for k in range(blocks)]


def batch_offsets(ranges: list[tuple[int, int]], step: int = 100) -> list[int]:
    """Offsets that make the scans' image ranges (first, last) disjoint, not adjacent and positive, each on the next step."""
    out, top = [], 0
    for first, last in ranges:
        offset = 0
        if first < 1 or first <= top + 1:
            offset = (top // step + 1) * step + 1 - first
        out.append(offset)
        top = last + offset
    return out


def column_summary(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, low, high, mean of numeric columns, in one pass."""
    aggs = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}_{n}").alias(n) for n in ("low", "high", "mean"))) for c in columns))
    return table.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def kolmogorov_smirnov(table: DataFrame, by: list[str], cdf: Column, value: str) -> DataFrame:
    """by, n, d, above, below: the largest distance of each group's empirical distribution from a given one, either way and by side.

    Equal values are one step of the distribution.
    """
    places = value_places(table, by, value)
    sizes = places.groupBy(*by).agg(F.sum("n").alias("_all"))
    met = places.join(sizes, by)
    above, below = (F.col("before") + F.col("n")) / F.col("_all") - cdf, cdf - F.col("before") / F.col("_all")
    out = met.withColumns({"_a": above, "_b": below}).groupBy(*by).agg(F.sum("n").alias("n"), F.max("_a").alias("above"), F.max("_b").alias("below"))
    return out.select(*by, "n", F.greatest("above", "below").alias("d"), "above", "below")


def kolmogorov_p(d: float, n: int, terms: int = 100) -> float:
    """The chance of so large a distance for n rows, by the asymptotic series."""
    import math

    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, terms))))
