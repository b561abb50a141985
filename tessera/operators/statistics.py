"""Statistics of merged data: half-set correlations and their significance, leave-one-out by bins, dose series, tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# leave-one-group-out correlation by resolution bins

_SUMS = ("c", "m", "mm", "e")


def _terms(n: Column, x: Column, xx: Column) -> list[Column]:
    """Of one key: whether it counts, its mean, the mean's square and the variance of the mean."""
    mean = x / n
    return [F.when(n > 1, v).otherwise(0.0) for v in (F.lit(1.0), mean, mean * mean, (xx - x * x / n) / (n - 1) / n)]


def _cc(c: Column, m: Column, mm: Column, e: Column) -> Column:
    s, noise = (mm - m * m / c) / (c - 1), e / c
    return (s - noise) / (s + noise)


def _binned_cc(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, cc: the mean over bins of two keys or more, weighted by their keys; 0 without any."""
    good = rows.where("c > 1.5").withColumn("_cc", _cc(*(F.col(a) for a in _SUMS)))
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("_cc"))
    return good.groupBy(*by).agg((total / n).alias("cc")) if by else good.agg(F.coalesce(total / n, F.lit(0.0)).alias("cc"))


def delta_cc_half_binned(table: DataFrame, key: list[str], group: str, bin_: str, value: str, bins: int) -> DataFrame:
    """group, cc_without, delta: the binned CC1/2 of all rows but a group's, and what the group adds to that of all.

    ``group`` is a dataset or an image group, ``bin_`` the bin of the row's key. The totals' sums per bin, less what each
    group changes: a row per group and bin, nothing of groups times keys.
    """
    x = F.col(value)
    own = table.groupBy(bin_, *key, group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"))
    total = own.groupBy(bin_, *key).agg(F.sum("n").alias("n_all"), F.sum("x").alias("x_all"), F.sum("xx").alias("xx_all"))
    before = _terms(F.col("n_all"), F.col("x_all"), F.col("xx_all"))
    whole = total.select(bin_, *(t.alias(a) for t, a in zip(before, _SUMS, strict=True))).groupBy(bin_).agg(*(F.sum(a).alias(a) for a in _SUMS))
    after = _terms(F.col("n_all") - F.col("n"), F.col("x_all") - F.col("x"), F.col("xx_all") - F.col("xx"))
    met = own.join(total, [bin_, *key])
    change = met.groupBy(group, bin_).agg(*(F.sum(b - a).alias(f"d{n}") for a, b, n in zip(before, after, _SUMS, strict=True)))
    grid = own.select(group).distinct().withColumn(bin_, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    each = grid.join(F.broadcast(whole), bin_).join(change, [group, bin_], "left")  # a row per bin
    without = _binned_cc(each.select(group, *((F.col(a) + F.coalesce(f"d{a}", F.lit(0.0))).alias(a) for a in _SUMS)), [group])
    overall = _binned_cc(whole, []).withColumnRenamed("cc", "_all")
    return without.join(F.broadcast(overall)).select(group, F.col("cc").alias("cc_without"), (F.col("_all") - F.col("cc")).alias("delta"))  # one row


def image_groups(dataset: Column, image: Column, size: int) -> Column:
    """The group of so many consecutive images of a dataset that a row belongs to."""
    return F.concat_ws(":", dataset.cast("string"), F.floor(image / size).cast("int").cast("string"))


def below_cutoff(deltas: DataFrame, deviations: float) -> DataFrame:
    """deltas with removed: less than the mean less so many population deviations."""
    cut = deltas.agg((F.avg("delta") - deviations * F.stddev_pop("delta")).alias("_cut"))
    return deltas.join(F.broadcast(cut)).withColumn("removed", F.col("delta") < F.col("_cut")).drop("_cut")  # one row


def without_groups(table: DataFrame, judged: DataFrame, group: str) -> DataFrame:
    """The rows of groups that weren't removed."""
    return table.join(judged.where("removed").select(group), group, "left_anti")


def edge_groups(removable: list[tuple[str, int]], present: dict[str, list[int]]) -> list[tuple[str, int]]:
    """Of image groups (dataset, number) to remove those that leave one run of images: taken from either end, again and again."""
    left, out, wanted = {k: sorted(v) for k, v in present.items()}, [], sorted(removable)
    while True:
        now = [(d, g) for d, g in wanted if left.get(d) and g in (left[d][0], left[d][-1])]
        if not now:
            return out
        for d, g in now:
            if left[d] and g in (left[d][0], left[d][-1]):
                left[d].remove(g)
                out.append((d, g))
                wanted.remove((d, g))


# half-set correlations


def cc_half_sigma_tau(table: DataFrame, key: list[str], bin_: str, value: str, variance: str | None = None) -> DataFrame:
    """bin, n, cc_half from the variance of group means and twice the mean variance of a mean; weighted by 1 / variance where that is given.

    n is the groups of two rows or more; 0 where either variance is 0.
    """
    x = F.col(value)
    w = 1 / F.col(variance) if variance else F.lit(1.0)
    sums = table.groupBy(bin_, *key).agg(F.count("*").alias("_n"), F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx"))
    mean = F.col("_x") / F.col("_w")
    spread = F.col("_xx") / F.col("_w") - mean * mean
    many = (F.col("_n") > 1) & (F.col("_w") * F.col("_w") / F.col("_ww") > 1)
    noise = F.when(many, 2.0 / (F.col("_w") * F.col("_w") / F.col("_ww") - 1) * spread)
    out = sums.select(bin_, mean.alias("_m"), noise.alias("_e")).groupBy(bin_).agg(F.count("_e").alias("n"), F.avg("_e").alias("_e"), F.var_samp("_m").alias("_y"))
    good = (F.coalesce("_e", F.lit(0.0)) != 0) & (F.coalesce("_y", F.lit(0.0)) != 0)
    cc = (F.col("_y") - 0.5 * F.col("_e")) / (F.col("_y") + 0.5 * F.col("_e"))
    return out.select(bin_, F.when(good, F.col("n")).otherwise(0).alias("n"), F.when(good, cc).otherwise(0.0).alias("cc_half"))


def halves_by_hash(table: DataFrame, key: list[str], value: str, variance: str, order: list[str], seed: int = 0) -> DataFrame:
    """key, a, va, b, vb: weighted means of two halves of each group of two rows or more, and their variances.

    A row's place is its rank by md5 of seed and row number, which other engines can work out too; an odd row goes to the
    first half by the parity of the group's hash.
    """
    def md5_of(*c: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), *(x.cast("string") for x in c)))

    by = Window.partitionBy(*key)
    rank = F.row_number().over(by.orderBy(md5_of(*map(F.col, order)), *order))
    n = F.count("*").over(by)
    coin = F.when(F.substr(md5_of(*map(F.col, key)), F.lit(1), F.lit(1)) < "8", 1).otherwise(0)
    rows = table.withColumns({"_first": rank <= F.floor((n + coin) / 2), "_n": n}).where("_n > 1")
    w = 1 / F.col(variance)

    def mean(side: Column) -> tuple[Column, Column]:
        return F.sum(F.when(side, F.col(value) * w)) / F.sum(F.when(side, w)), 1 / F.sum(F.when(side, w))

    (a, va), (b, vb) = mean(F.col("_first")), mean(~F.col("_first"))
    return rows.groupBy(*key).agg(a.alias("a"), va.alias("va"), b.alias("b"), vb.alias("vb"))


def weighted_correlation(halves: DataFrame, by: list[str] | None = None, floor: float = 0.0) -> DataFrame:
    """by, cc, n_eff of (a, va, b, vb): correlation with weights 1 / (va + vb + floor * median of all variances), and the effective number.

    Sums of weights and moments of values taken from their group's weighted mean.
    """
    by = by or []
    if floor:
        both = halves.select(*by, F.explode(F.array("va", "vb")).alias("_v")).groupBy(*by).agg((floor * F.percentile("_v", F.lit(0.5))).alias("_t"))
        halves = halves.join(both, by) if by else halves.join(F.broadcast(both))  # one row
    w = 1 / (F.col("va") + F.col("vb") + (F.col("_t") if floor else 0.0))
    rows = halves.withColumn("_w", w)
    means = rows.groupBy(*by).agg(*((F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_m{c}") for c in "ab"))
    rows = rows.join(means, by) if by else rows.join(F.broadcast(means))  # one row
    da, db = F.col("a") - F.col("_ma"), F.col("b") - F.col("_mb")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.sum(F.col("_w") * da * db).alias("_ab"), F.sum(F.col("_w") * da * da).alias("_aa"), F.sum(F.col("_w") * db * db).alias("_bb"),
        (F.sum("_w") * F.sum("_w") / F.sum(F.col("_w") * F.col("_w"))).alias("n_eff"),
    )
    some = (F.col("_n") > 1) & (F.col("_aa") > 0) & (F.col("_bb") > 0)
    return out.select(*by, F.when(some, F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("cc"), F.when(some, F.col("n_eff")).when(F.col("_n") == 0, 0.0).otherwise(1.0).alias("n_eff"))


def weighted_r_split(halves: DataFrame) -> DataFrame:
    """r_split of (a, va, b, vb): differences and sums weighted by 1 / (va + vb); -1 where the sum is 0."""
    w = 1 / (F.col("va") + F.col("vb"))
    below = F.sum(w * (F.col("a") + F.col("b"))) / 2
    return halves.agg(F.when(below != 0, F.sum(w * F.abs(F.col("a") - F.col("b"))) / F.sqrt(F.lit(2.0)) / below).otherwise(-1.0).alias("r_split"))


def anomalous_halves(halves: DataFrame, index: list[str]) -> DataFrame:
    """Half-set differences of mates: halves (index, a, va, b, vb) to (index, a, va, b, vb) of plus less minus, where both mates are."""
    here, there = F.struct(*index), F.struct(*((-F.col(c)).alias(c) for c in index))
    rows = halves.select(F.greatest(here, there).alias("k"), (here >= there).alias("plus"), "a", "va", "b", "vb")
    plus, minus = ({c: F.first(F.when(side, F.col(c)), ignorenulls=True) for c in ("a", "va", "b", "vb")} for side in (F.col("plus"), ~F.col("plus")))
    out = rows.groupBy("k").agg(*(plus[c].alias(f"p{c}") for c in plus), *(minus[c].alias(f"m{c}") for c in minus)).where("pa IS NOT NULL AND ma IS NOT NULL")
    return out.select(
        *(F.col(f"k.{c}").alias(c) for c in index), *((F.col(f"p{c}") - F.col(f"m{c}")).alias(c) for c in "ab"), *((F.col(f"p{c}") + F.col(f"m{c}")).alias(c) for c in ("va", "vb"))
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_cdf(t: float, n: float) -> float:
    tail = incomplete_beta(n / 2, 0.5, n / (n + t * t)) / 2
    return 1 - tail if t > 0 else tail


def student_quantile(p: float, n: float) -> float:
    """The t below which a share p of Student's distribution lies, by bisection."""
    low, high = -1.0, 1.0
    while student_cdf(high, n) < p:
        high *= 2
    while student_cdf(low, n) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, n) < p else (low, mid)
    return (low + high) / 2


def cc_significance(r: float, n: float, p: float) -> tuple[bool, float]:
    """Whether a correlation of n pairs is over the critical value of level p, and that value; (False, 0) for r of -1 or two pairs or fewer."""
    if r == -1 or n <= 2:
        return False, 0.0
    t = student_quantile(1 - p, n - 2)
    critical = t / math.sqrt(n - 2 + t * t)
    return r > critical, critical


def with_significance(binned: DataFrame, r: str, n: str, p: float = 0.01) -> DataFrame:
    """A row per bin with significant and critical_value."""
    schema = binned.select("*").schema.add("significant", "boolean").add("critical_value", "double")

    def judged(frames):
        for f in frames:
            both = [cc_significance(a, b, p) for a, b in zip(f[r], f[n], strict=True)]
            yield f.assign(significant=[x for x, _ in both], critical_value=[float(c) for _, c in both])

    return binned.mapInPandas(judged, schema)


# tables and series


def table_one(statistics: DataFrame, bin_: str, low: int, high: int) -> DataFrame:
    """statistic, overall, low, high: the columns of ``merging_statistics`` for all data and two bins, turned."""
    names = [c for c in statistics.columns if c != bin_]
    kind = F.when(F.col(bin_).isNull(), "overall").when(F.col(bin_) == low, "low").when(F.col(bin_) == high, "high")
    rows = statistics.withColumn("_kind", kind).where("_kind IS NOT NULL")
    long = rows.select("_kind", F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("v")) for c in names))).alias("x"))
    pick = [F.max(F.when(F.col("_kind") == k, F.col("x.v"))).alias(k) for k in ("overall", "low", "high")]
    return long.groupBy(F.col("x.statistic").alias("statistic")).agg(*pick)


def per_batch(table: DataFrame, batch: str, value: str, variance: str, scale: str) -> DataFrame:
    """batch, i_over_sigma (rows of positive variance), scale: means."""
    ios = F.when(F.col(variance) > 0, F.col(value) / F.sqrt(variance))
    return table.groupBy(batch).agg(F.avg(ios).alias("i_over_sigma"), F.avg(scale).alias("scale"))


def run_length(table: DataFrame, at: str, value: str, order: str) -> DataFrame:
    """value, first, n, mean of ``at`` for each run of equal consecutive values in an order: a run starts where the value before differs.

    For a series of one scan; its rows go through one task in order.
    """
    w = Window.orderBy(order)
    starts = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    runs = table.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("_run", value).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.avg(at).alias("mean")).drop("_run")


#: Rows of a key in one block of ``pair_sums``.
PAIR_BLOCK = 256


def pair_sums(table: DataFrame, key: list[str], dose: str, value: str, variance: str, order: str, by: str) -> DataFrame:
    """(dose or gap), diff, half_sum, ios, n over all pairs of rows of a key: by "dose" of the later row or "gap" of doses.

    A key's rows are collected in blocks, and its blocks meet pairwise, so no task holds a key of any size; pairs are summed
    where they are made, and only a row per value and task is shuffled.
    """
    sizes = table.groupBy(*key).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("_blocks"))
    rows = table.select(*key, F.struct(F.col(order).alias("o"), F.col(dose).alias("d"), F.col(value).alias("v"), (F.col(value) / F.sqrt(variance)).alias("s")).alias("r"))
    rows = rows.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("r.o"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other"), "_left": F.col("_own") <= F.col("_other"), "_right": F.col("_own") >= F.col("_other")})
    met = rows.groupBy(*key, "_a", "_b").agg(F.collect_list(F.when(F.col("_left"), F.col("r"))).alias("left"), F.collect_list(F.when(F.col("_right"), F.col("r"))).alias("right"))
    met = met.select("_a", "_b", F.explode("left").alias("x"), "right").where(F.size("right") > 0)
    each = F.filter("right", lambda y: (F.col("_a") != F.col("_b")) | (y["o"] > F.col("x.o")))
    pairs = met.select("x", F.explode(each).alias("y"))
    at = F.greatest("x.d", "y.d") if by == "dose" else F.abs(F.col("x.d") - F.col("y.d"))
    return pairs.groupBy(at.alias(by)).agg(
        F.sum(F.abs(F.col("x.v") - F.col("y.v"))).alias("diff"),
        (F.sum(F.abs(F.col("x.v") + F.col("y.v"))) / 2).alias("half_sum"),
        F.sum(F.col("x.s") + F.col("y.s")).alias("ios"),
        (2 * F.count("*")).alias("n"),
    )


def cumulative_r(sums: DataFrame, least: int = 100, expected: float = 1.1284) -> DataFrame:
    """dose, rcp, scp: differences over half sums of all pairs complete by each dose, and that over what noise alone would give.

    scp is 0 up to ``least`` rows; ``expected`` is a fixed value, the mean difference of two normal deviates.
    """
    up = Window.orderBy("dose").rowsBetween(Window.unboundedPreceding, 0)  # a row per dose step
    total = sums.select("dose", *(F.sum(c).over(up).alias(c) for c in ("diff", "half_sum", "ios", "n")))
    rcp = F.when(F.col("half_sum") > 0, F.col("diff") / F.col("half_sum")).otherwise(0.0)
    scp = F.when((F.col("half_sum") > 0) & (F.col("n") > least), rcp / (expected / (F.col("ios") / F.col("n")))).otherwise(0.0)
    return total.select("dose", rcp.alias("rcp"), scp.alias("scp"))


def completeness_by_sign(table: DataFrame, index: list[str], dose: str, complete: int) -> DataFrame:
    """dose, seen, seen_plus, seen_minus, both, completeness: keys met by each dose, of either mate, of each and of both."""
    here, there = F.struct(*index), F.struct(*((-F.col(c)).alias(c) for c in index))
    rows = table.select(F.greatest(here, there).alias("k"), (here >= there).alias("plus"), F.col(dose).alias("dose"))
    first = rows.groupBy("k").agg(F.min("dose").alias("any"), F.min(F.when(F.col("plus"), F.col("dose"))).alias("p"), F.min(F.when(~F.col("plus"), F.col("dose"))).alias("m"))
    kinds = {"seen": F.col("any"), "seen_plus": F.col("p"), "seen_minus": F.col("m"), "both": F.when(F.col("p").isNotNull() & F.col("m").isNotNull(), F.greatest("p", "m"))}
    long = first.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), c.alias("dose")) for n, c in kinds.items()))).alias("x")).where("x.dose IS NOT NULL")
    new = long.groupBy(F.col("x.dose").alias("dose")).agg(*(F.sum((F.col("x.kind") == n).cast("long")).alias(n) for n in kinds))
    up = Window.orderBy("dose").rowsBetween(Window.unboundedPreceding, 0)  # a row per dose step
    out = new.select("dose", *(F.sum(n).over(up).alias(n) for n in kinds))
    return out.withColumn("completeness", F.col("seen") / F.lit(complete))


def dose_step(doses: DataFrame, dose: str) -> DataFrame:
    """step: the least positive difference of neighbouring distinct doses, by ranges: neighbours across a cut are told from the ranges' ends."""
    parts = doses.select(dose).distinct().repartitionByRange(dose).withColumn("_part", F.spark_partition_id())
    inside = parts.withColumn("_gap", F.col(dose) - F.lag(dose).over(Window.partitionBy("_part").orderBy(dose)))
    ends = inside.groupBy("_part").agg(F.min(dose).alias("lo"), F.max(dose).alias("hi"), F.min("_gap").alias("gap"))
    across = F.col("lo") - F.lag("hi").over(Window.orderBy("_part"))  # a row per range
    return ends.select(F.least("gap", across).alias("g")).agg(F.min("g").alias("step"))


def batches_to_dose(table: DataFrame, batch: str, offsets: DataFrame, per_image: float) -> DataFrame:
    """table with dose: images since the start of the batch's range (first, last, start of dose), times the dose of one."""
    met = table.join(F.broadcast(offsets), (F.col(batch) >= F.col("first")) & (F.col(batch) <= F.col("last")))  # a row per dataset
    return met.withColumn("dose", F.col("start") + (F.col(batch) - F.col("first") + 1) * per_image).drop("first", "last", "start")


def axial_absences(table: DataFrame, axis: int, order: int, index: list[str], value: str, variance: str) -> DataFrame:
    """present, n, i, i_over_sigma of rows on an axis, by whether a screw axis of that order lets them be seen."""
    others = [F.col(c) == 0 for k, c in enumerate(index) if k != axis]
    rows = table.where(others[0] & others[1] & (F.col(index[axis]) != 0))
    return rows.groupBy((F.pmod(index[axis], F.lit(order)) == 0).alias("present")).agg(
        F.count("*").alias("n"), F.avg(value).alias("i"), F.avg(F.col(value) / F.sqrt(variance)).alias("i_over_sigma")
    )


def z_scores(table: DataFrame, key: list[str], value: str, variance: str) -> DataFrame:
    """table of positive values and variances with mean (weighted by 1 / variance), n and z = (value - mean) / deviation of its group."""
    rows = table.where((F.col(variance) > 0) & (F.col(value) > 0))
    by, w = Window.partitionBy(*key), 1 / F.col(variance)
    mean = F.sum(w * F.col(value)).over(by) / F.sum(w).over(by)
    return rows.withColumns({"mean": mean, "n": F.count("*").over(by)}).withColumn("z", (F.col(value) - F.col("mean")) / F.sqrt(variance))


def cosine_matrix(correlations: DataFrame) -> DataFrame:
    """a, b, cosine of the rows of a dataset correlation matrix (a, b, cc with a < b; 1 on the diagonal), over datasets that both rows have.

    The matrix is a row per pair of datasets; its rows are joined on the third dataset.
    """
    flipped = correlations.select(F.col("b").alias("a"), F.col("a").alias("b"), "cc")
    ids = correlations.select("a").union(correlations.select("b")).distinct()
    full = correlations.select("a", "b", "cc").unionByName(flipped).unionByName(ids.select("a", F.col("a").alias("b"), F.lit(1.0).alias("cc")))
    left, right = full.select("a", F.col("b").alias("k"), F.col("cc").alias("x")), full.select(F.col("a").alias("b"), F.col("b").alias("k"), F.col("cc").alias("y"))
    met = left.join(right, "k").where("a < b")
    return met.groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def imid_search(table: DataFrame, key: list[str], summed: str, fitted: str, variance: str, cuts: list[float]) -> DataFrame:
    """imid, r_meas of each cut of a blend of summed and fitted intensities, in one pass; the best is the least."""
    cut = F.explode(F.array(*(F.lit(float(c)) for c in cuts)))
    rows = table.select(*key, summed, fitted, variance, cut.alias("imid"))
    s = F.col(summed)
    w = F.when(s <= 0, 1.0).otherwise(1 / (1 + F.pow(s / F.col("imid"), 3)))
    rows = rows.withColumn("_i", w * s + (1 - w) * F.col(fitted))
    by = Window.partitionBy("imid", *key)
    rows = rows.withColumns({"_off": F.abs(F.col("_i") - F.avg("_i").over(by)), "_n": F.count("*").over(by)}).where("_n > 1")
    top = F.sum(F.sqrt(F.col("_n") / (F.col("_n") - 1)) * F.col("_off"))
    return rows.groupBy("imid").agg((top / F.sum("_i")).alias("r_meas"))


# fits on binned statistics: some tens of rows on the driver


def polynomial_fit(x, y, degree: int = 6) -> np.ndarray:
    """The values at x of the least-squares polynomial through (x, y), of a degree that the points can tell."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    return np.polynomial.Polynomial.fit(x, y, min(degree, len(x) - 1))(x)


def log_fit(x, y, degree: int = 6) -> np.ndarray:
    """exp of the polynomial through the logarithms of positive values."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    good = y > 0
    return np.exp(np.polynomial.Polynomial.fit(x[good], np.log(y[good]), min(degree, int(good.sum()) - 1))(x))


def log_inverse_fit(x, y, degree: int = 6) -> np.ndarray:
    """The inverse of ``log_fit`` of inverse values."""
    y = np.asarray(y, float)
    return 1 / log_fit(x, np.where(y > 0, 1 / np.where(y > 0, y, 1), 0), degree)


def tanh_fit(x, y, n_obs) -> np.ndarray:
    """A fall from 1 to 0 by tanh((x - s0) / r), weighted by the standard errors of correlations of n_obs pairs; Gauss-Newton with damping."""
    x, y, n = (np.asarray(v, float) for v in (x, y, n_obs))
    if (n > 3).sum() < 3:
        raise RuntimeError("too few rows to fit")
    w = np.where(n > 4, np.sqrt(np.maximum(n - 3, 1e-9)), 1 / 100)
    r, s0, damping = 0.2, 0.4, 1e-3

    def at(r, s0):
        return 0.5 * (1 - np.tanh((x - s0) / r))

    def loss(r, s0):
        return float((((at(r, s0) - y) * w) ** 2).sum())

    for _ in range(500):
        t = (x - s0) / r
        slope = 0.5 / np.cosh(np.clip(t, -300, 300)) ** 2 / r
        j = np.stack([slope * t, slope], axis=1) * w[:, None]
        g, h = j.T @ ((at(r, s0) - y) * w), j.T @ j
        step = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), -g)
        if r + step[0] != 0 and loss(r + step[0], s0 + step[1]) < loss(r, s0):
            r, s0, damping = r + step[0], s0 + step[1], max(damping / 4, 1e-12)
            if np.abs(step).max() < 1e-12:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return at(r, s0)


def crossing(x, y, limit: float) -> float:
    """The x at which the lines through the points cross a limit; RuntimeError if the limit lies outside."""
    if limit > max(y) or limit < min(y):
        raise RuntimeError("the limit lies outside of the values")
    for (x0, y0), (x1, y1) in zip(zip(x, y, strict=True), zip(x[1:], y[1:], strict=True), strict=False):
        if y0 == limit:
            return x0
        if (y0 - limit) * (y1 - limit) < 0:
            return x0 + (limit - y0) * (x1 - x0) / (y1 - y0)
    return x[-1]


#: Statistics that tell a resolution limit: the fit of each, and the limit where one is given by default (fixed values).
RESOLUTION_METRICS = {
    "cc_half": ("tanh", 0.3),
    "cc_ref": ("tanh", 0.1),
    "unmerged_i_over_sigma_mean": ("log", None),
    "i_over_sigma_mean": ("log", None),
    "i_mean_over_sigi_mean": ("log", None),
    "r_merge": ("log_inverse", None),
    "completeness": ("polynomial", None),
}


def resolution_limit(d_star_sq, y, model: str, limit: float, n_obs=None) -> float | None:
    """The d at which a fit through (1 / d squared, y) crosses a limit; the last d if all y are above it, None if nothing crosses."""
    if min(y) > limit:
        return 1 / math.sqrt(max(d_star_sq))
    fits = {"polynomial": polynomial_fit, "log": log_fit, "log_inverse": log_inverse_fit}
    fit = tanh_fit(d_star_sq, y, n_obs) if model == "tanh" else fits[model](d_star_sq, y)
    try:
        return 1 / math.sqrt(crossing(list(d_star_sq), list(fit), limit))
    except RuntimeError:
        return None


def estimate_resolution(binned: DataFrame, metric: str, limit: float | None = None) -> float | None:
    """The resolution limit of one of RESOLUTION_METRICS from a row per bin: d_min, the metric, n."""
    model, default = RESOLUTION_METRICS[metric]
    if limit is None and default is None:
        raise ValueError(f"{metric} has no limit by default")
    rows = binned.where(F.col(metric).isNotNull()).select("d_min", F.col(metric).alias("y"), "n").orderBy(F.desc("d_min")).collect()  # a row per bin
    x = [1 / r.d_min**2 for r in rows]
    return resolution_limit(x, [r.y for r in rows], model, default if limit is None else limit, [r.n for r in rows])
