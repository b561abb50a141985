"""Ranks and exact quantiles of groups of any size: no group is sorted in one task, none is collected.

Rows are counted by distinct value first, so a frequent value is one row. Values are dealt to buckets between quantiles of
the whole table, estimated once (BUCKETS numbers reach the driver); a value's place is its place in the bucket and the
buckets' sizes before. Where a bucket begins changes the work's shape only, never a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that values are dealt to.
BUCKETS = 256


def cuts(table: DataFrame, values: list[str]) -> list[list[float]]:
    """For each value, where buckets begin: estimated quantiles of the whole table."""
    shares = F.array(*(F.lit(k / BUCKETS) for k in range(1, BUCKETS)))
    return [sorted(set(e or [])) for e in table.agg(*(F.percentile_approx(F.col(v).cast("double"), shares, F.lit(10 * BUCKETS)) for v in values)).first()]


def with_equal(table: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """table joined with the rows of other that have its keys, where null equals null."""
    named = other.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return table.join(named, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]).drop(*(f"_on_{c}" for c in on))


def value_places(table: DataFrame, by: list[str], value: str, count: str | None = None, edges: list[float] | None = None, nulls: bool = False) -> DataFrame:
    """by, value, n, before: how many rows of a group have each value, and how many less. Nulls take no part.

    With ``count`` a row of the table stands for so many; ``edges`` are its ``cuts``, if known. With ``nulls`` a null is a
    value, after all others, and a key like others.
    """
    counts = (table if nulls else table.where(F.col(value).isNotNull())).groupBy(*by, value).agg((F.sum(count) if count else F.count("*")).alias("n"))
    edges = cuts(table, [value])[0] if edges is None else edges
    bucket = F.lit(0)
    if edges:
        upto = lambda of: F.size(F.filter(of, lambda e: e <= F.col(value).cast("double")))
        blocks = [F.array(*map(F.lit, edges[k : k + 16])) for k in range(0, len(edges), 16)]
        block = upto(F.array(*map(F.lit, edges[16::16]))) if len(blocks) > 1 else F.lit(0)  # by 16, then within 16
        bucket = block * 16 + upto(F.get(F.array(*blocks), block))
    dealt = counts.withColumn("_b", F.when(F.col(value).isNull(), len(edges) + 1).otherwise(bucket))
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "_b").agg(F.sum("n").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    met = dealt.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    met = with_equal(met, sizes, [*by, "_b"]) if nulls else met.join(sizes, [*by, "_b"])
    return met.select(*by, value, "n", (F.col("_before") + F.col("_in")).alias("before"))


def average_ranks(table: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """table with the rank from 1 of a row's value in its group, equal values sharing their mean."""
    places = value_places(table, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return table.join(places, [*by, value])


def quantiles(table: DataFrame, by: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """by and one column per share: exact quantiles by linear interpolation between neighbours, of each group."""
    places = value_places(table, by, value)
    sizes = places.groupBy(*by).agg(F.sum("n").alias("_all"))
    met = places.join(sizes, by)
    picks = []
    for share, name in zip(shares, names, strict=True):
        at = (F.col("_all") - 1) * F.lit(share)

        def holds(place: Column) -> Column:
            return (F.col("before") <= place) & (place < F.col("before") + F.col("n"))

        low, high = (F.max(F.when(holds(f(at)), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
        picks.append((low + (F.max(at) - F.floor(F.max(at))) * (high - low)).alias(name))
    return met.groupBy(*by).agg(*picks)
