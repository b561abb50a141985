"""Statistics of groups of equivalent rows: merging, broadcast, half sets, leave-one-out.

Aggregates are partial before any shuffle; group totals come back to rows by window where each row needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_key(index: list[str], operators: list[list[list[int]]], friedel: bool = True) -> Column:
    """The greatest of an index triple's images under 3x3 integer operators, and their inverses."""
    images = []
    for op in operators:
        image = [sum((F.col(c) * m for c, m in zip(index, row, strict=True) if m), F.lit(0)) for row in op]
        for sign in (1, -1) if friedel else (1,):
            images.append(F.struct(*((x * sign).cast("int").alias(c) for x, c in zip(image, index, strict=True))))
    return F.greatest(*images) if len(images) > 1 else images[0]


def merge_equivalents(table: DataFrame, key: list[str], value: str, variance: str) -> DataFrame:
    """key, merged (mean weighted by 1 / variance), merged_var, n."""
    w = 1 / F.col(variance)
    out = table.groupBy(*key).agg(F.sum(F.col(value) * w).alias("_s"), F.sum(w).alias("_w"), F.count("*").alias("n"))
    return out.select(*key, (F.col("_s") / F.col("_w")).alias("merged"), (1 / F.col("_w")).alias("merged_var"), "n")


def best_estimate(value: Column, scale: Column, weight: Column, key: list[str]) -> Column:
    """Sum of g I w over sum of g g w of the row's group."""
    over = Window.partitionBy(*key)
    return F.sum(scale * value * weight).over(over) / F.sum(scale * scale * weight).over(over)


def clip_weights(table: DataFrame, key: list[str], weight: str, most: float = 10.0) -> DataFrame:
    """table with weight at most so many times the median of its group."""
    median = table.groupBy(*key).agg(F.percentile(weight, F.lit(0.5)).alias("_m"))
    return table.join(median, key).withColumn(weight, F.least(F.col(weight), F.col("_m") * most)).drop("_m")


def sum_partials(table: DataFrame, key: list[str], row_id: str, value: str, variance: str, partiality: str, how: str) -> DataFrame:
    """One row per group of partial measurements: key, row_id of the first, value, variance, partiality summed, n.

    how "sum" adds values and variances; "scale" takes the mean weighted by 1 / variance; "prf" weights by value squared
    over variance, or gives 0 with the variances' sum if no weight is left.
    """
    v, s = F.col(value), F.col(variance)
    parts = table.groupBy(*key).agg(
        F.min(row_id).alias("_row"),
        F.sum(v).alias("_v"),
        F.sum(s).alias("_s"),
        F.sum(v / s).alias("_vw"),
        F.sum(1 / s).alias("_w"),
        F.sum(v * v * v / s).alias("_vp"),
        F.sum(v * v / s).alias("_p"),
        F.sum(v * v / s * s).alias("_sp"),
        F.sum(F.col(partiality)).alias(partiality),
        F.count("*").alias("n"),
    )
    results = {
        "sum": (F.col("_v"), F.col("_s")),
        "scale": (F.col("_vw") / F.col("_w"), 1 / F.col("_w")),
        "prf": (
            F.when(F.col("_p") > 0, F.col("_vp") / F.col("_p")).otherwise(F.lit(0.0)),
            F.when(F.col("_p") > 0, F.col("_sp") / F.col("_p")).otherwise(F.col("_s")),
        ),
    }
    new_value, new_variance = results[how]
    return parts.select(*key, F.col("_row").alias(row_id), new_value.alias(value), new_variance.alias(variance), partiality, "n")


def half_sets(table: DataFrame, key: list[str], value: str, variance: str, order: list[str], seed: int = 0) -> DataFrame:
    """key, a, b: weighted means of two random halves of each group of two rows or more; an odd row goes to either."""
    by = Window.partitionBy(*key)
    rank = F.row_number().over(by.orderBy(F.xxhash64(F.lit(seed), *order), *order))
    n = F.count("*").over(by)
    coin = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2))
    rows = table.withColumns({"_first": rank <= F.floor((n + coin) / 2), "_n": n}).where("_n > 1")
    w = 1 / F.col(variance)

    def mean(side: Column) -> Column:
        return F.sum(F.when(side, F.col(value) * w)) / F.sum(F.when(side, w))

    return rows.groupBy(*key).agg(mean(F.col("_first")).alias("a"), mean(~F.col("_first")).alias("b"))


def r_split(halves: DataFrame) -> DataFrame:
    """r_split: sqrt(1/2) sum |a - b| over half the sum of a + b; -1 where that is zero."""
    below = F.sum(F.col("a") + F.col("b")) / 2
    return halves.agg(F.when(below != 0, F.sum(F.abs(F.col("a") - F.col("b"))) / F.sqrt(F.lit(2.0)) / below).otherwise(-1.0).alias("r_split"))


def cc_half(table: DataFrame, key: list[str], bin_: str, value: str) -> DataFrame:
    """bin, n, cc_half of the groups of two rows or more: (s - e) / (s + e), s the sample variance of group means, e the mean variance of a mean."""
    means = table.groupBy(bin_, *key).agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.count("*").alias("_n")).where("_n > 1")
    out = means.groupBy(bin_).agg(F.count("*").alias("n"), F.var_samp("_m").alias("s"), (F.avg(F.col("_v") / F.col("_n"))).alias("e"))
    return out.select(bin_, "n", ((F.col("s") - F.col("e")) / (F.col("s") + F.col("e"))).alias("cc_half"))


def delta_cc_half(table: DataFrame, key: list[str], dataset: str, value: str) -> DataFrame:
    """dataset, cc_half_without, delta: CC1/2 of all rows but a dataset's, and what the dataset adds to that of all.

    Totals of each key, less each dataset's own; keys that a dataset lacks enter by the totals' sums, so nothing is
    expanded to datasets times keys.
    """
    x = F.col(value)
    own = table.groupBy(*key, dataset).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"))
    total = own.groupBy(*key).agg(F.sum("n").alias("n_all"), F.sum("x").alias("x_all"), F.sum("xx").alias("xx_all"))

    def terms(n: Column, x: Column, xx: Column) -> list[Column]:
        """Of one key: whether it counts, its mean, the mean's square and the variance of the mean."""
        some = n > 1
        mean = x / n
        var = (xx - x * x / n) / (n - 1) / n
        return [F.when(some, v).otherwise(0.0) for v in (F.lit(1.0), mean, mean * mean, var)]

    names = ["c", "m", "mm", "e"]
    whole = total.select(*(t.alias(a) for t, a in zip(terms(F.col("n_all"), F.col("x_all"), F.col("xx_all")), names, strict=True))).agg(*(F.sum(a).alias(f"t{a}") for a in names))
    met = own.join(total, key)
    before = terms(F.col("n_all"), F.col("x_all"), F.col("xx_all"))
    after = terms(F.col("n_all") - F.col("n"), F.col("x_all") - F.col("x"), F.col("xx_all") - F.col("xx"))
    change = met.groupBy(dataset).agg(*(F.sum(b - a).alias(n) for a, b, n in zip(before, after, names, strict=True)))

    def cc(c: Column, m: Column, mm: Column, e: Column) -> Column:
        s, e = (mm - m * m / c) / (c - 1), e / c
        return (s - e) / (s + e)

    both = change.join(F.broadcast(whole))  # one row of totals
    without = cc(*(F.col(f"t{a}") + F.col(a) for a in names))
    return both.select(dataset, without.alias("cc_half_without"), (cc(*(F.col(f"t{a}") for a in names)) - without).alias("delta"))


def r_merge(table: DataFrame, key: list[str], batch: str, value: str) -> DataFrame:
    """batch, r_merge: sum |I - mean of the row's group| over sum I; 0 where that isn't positive."""
    off = F.abs(F.col(value) - F.avg(value).over(Window.partitionBy(*key)))
    out = table.withColumn("_off", off).groupBy(batch).agg(F.sum("_off").alias("_o"), F.sum(value).alias("_i"))
    return out.select(batch, F.when(F.col("_i") > 0, F.col("_o") / F.col("_i")).otherwise(0.0).alias("r_merge"))


def merging_statistics(table: DataFrame, key: list[str], bin_: str, value: str, variance: str) -> DataFrame:
    """Per bin, and overall with a null bin: n_obs, n_unique, multiplicity, i_over_sigma, r_merge, r_meas, r_pim. Two levels of partial sums."""
    by = Window.partitionBy(bin_, *key)
    rows = table.withColumns({"_off": F.abs(F.col(value) - F.avg(value).over(by)), "_n": F.count("*").over(by)})
    many = F.col("_n") > 1
    rows = rows.withColumns({"_meas": F.when(many, F.sqrt(F.col("_n") / (F.col("_n") - 1)) * F.col("_off")), "_pim": F.when(many, F.sqrt(1 / (F.col("_n") - 1)) * F.col("_off"))})
    sums = rows.groupBy(bin_, *key).agg(
        F.count("*").alias("n"),
        F.sum(value).alias("i"),
        F.sum(F.when(many, F.col(value))).alias("im"),
        F.sum(F.when(many, F.col("_off"))).alias("off"),
        F.sum("_meas").alias("meas"),
        F.sum("_pim").alias("pim"),
        (F.sum(F.col(value) / F.col(variance)) / F.sqrt(F.sum(1 / F.col(variance)))).alias("ios"),
    )
    return sums.rollup(bin_).agg(
        F.sum("n").alias("n_obs"),
        F.count("*").alias("n_unique"),
        (F.sum("n") / F.count("*")).alias("multiplicity"),
        F.avg("ios").alias("i_over_sigma"),
        *((F.sum(c) / F.sum("im")).alias(f"r_{a}") for c, a in (("off", "merge"), ("meas", "meas"), ("pim", "pim"))),
    )


def dataset_correlations(table: DataFrame, key: list[str], dataset: str, value: str, least: int = 3) -> DataFrame:
    """a, b, n, cc of the datasets' mean values on common keys, a < b, pairs with so many keys at least."""
    means = table.groupBy(dataset, *key).agg(F.avg(value).alias("v"))
    a = means.select(*key, F.col(dataset).alias("a"), F.col("v").alias("va"))
    b = means.select(*key, F.col(dataset).alias("b"), F.col("v").alias("vb"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("va", "vb").alias("cc")).where(F.col("n") >= least)


def pair_differences(table: DataFrame, key: list[str], dose: str, value: str, order: str) -> DataFrame:
    """Pairs of rows of a key: dose_max, dose_gap, diff, half_sum."""
    a = table.select(*key, F.col(dose).alias("da"), F.col(value).alias("va"), F.col(order).alias("oa"))
    b = table.select(*key, F.col(dose).alias("db"), F.col(value).alias("vb"), F.col(order).alias("ob"))
    met = a.join(b, key).where("oa < ob")
    diff, half = F.abs(F.col("va") - F.col("vb")), F.abs(F.col("va") + F.col("vb")) / 2
    return met.select(F.greatest("da", "db").alias("dose_max"), F.abs(F.col("da") - F.col("db")).alias("dose_gap"), diff.alias("diff"), half.alias("half_sum"))


def r_cumulative(pairs: DataFrame) -> DataFrame:
    """dose, rcp: over pairs complete by each dose, the sum of differences over that of half sums."""
    per = pairs.groupBy(F.col("dose_max").alias("dose")).agg(F.sum("diff").alias("d"), F.sum("half_sum").alias("s"))
    up = Window.orderBy("dose").rowsBetween(Window.unboundedPreceding, 0)  # a row per dose step
    return per.select("dose", (F.sum("d").over(up) / F.sum("s").over(up)).alias("rcp"))


def r_by_gap(pairs: DataFrame) -> DataFrame:
    """gap, rd: the same ratio by difference of dose."""
    return pairs.groupBy(F.col("dose_gap").alias("gap")).agg((F.sum("diff") / F.sum("half_sum")).alias("rd"))


def completeness(table: DataFrame, key: list[str], dose: str, complete: int) -> DataFrame:
    """dose, seen, completeness: keys met by each dose, of a complete set."""
    first = table.groupBy(*key).agg(F.min(dose).alias("dose")).groupBy("dose").agg(F.count("*").alias("new"))
    up = Window.orderBy("dose").rowsBetween(Window.unboundedPreceding, 0)  # a row per dose step
    seen = F.sum("new").over(up)
    return first.select("dose", seen.alias("seen"), (seen / F.lit(complete)).alias("completeness"))
