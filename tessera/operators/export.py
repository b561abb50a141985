"""Choosing, correcting and combining intensities for export: one order of filters, seven choices of intensity.

A table has, for each kind of intensity, ``<kind>_value`` and ``<kind>_variance``; ``flags``; and where known ``id``, ``d``,
``partiality``, ``partial_id``, ``inverse_scale_factor``, ``lp`` and ``qe``. Filters are conditions and products of one
projection; only rows that are partial are shuffled, by their partial id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.flags import FLAGS, has_flags

KINDS = ("prf", "scale", "sum")
#: Kinds of intensity of each choice; "sum|prf" asks for either integration, the others for all their kinds.
CHOICES = {
    "sum": ("sum",),
    "prf": ("prf",),
    "scale": ("scale",),
    "sum+prf": ("sum", "prf"),
    "sum|prf": ("sum", "prf"),
    "sum+scale": ("sum", "scale"),
    "all": ("sum", "prf", "scale"),
}


def value_of(kind: str) -> str:
    return f"{kind}_value"


def variance_of(kind: str) -> str:
    return f"{kind}_variance"


def require_rows(table: DataFrame, what: str = "All data has been filtered from the table") -> DataFrame:
    """table, if it has a row; else ValueError. One action, for the end of a chain."""
    if table.isEmpty():
        raise ValueError(what)
    return table


def assigned(table: DataFrame) -> DataFrame:
    """Rows of a dataset: id 0 or more."""
    return table.where(F.col("id") >= 0)


def chosen(table: DataFrame, choice: str) -> DataFrame:
    """Rows that the choice's kinds of intensity are good for: integrated that way, and for scaled ones not bad and of positive scale."""
    flags = F.col("flags")
    integrated = {k: has_flags(flags, FLAGS[f"integrated_{k}"]) for k in ("sum", "prf")}
    if choice == "sum|prf":
        table = table.where(integrated["sum"] | integrated["prf"])
    else:
        for kind in CHOICES[choice]:
            if kind in integrated:
                table = table.where(integrated[kind])
    if "scale" in CHOICES[choice]:
        table = table.where(~has_flags(flags, FLAGS["bad_for_scaling"], every=False) & ~(F.col("inverse_scale_factor") <= 0))
    return table


def drop_other_kinds(table: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Without the intensities that weren't chosen; KeyError if a chosen one is missing."""
    for kind in kinds:
        if value_of(kind) not in table.columns or variance_of(kind) not in table.columns:
            raise KeyError(f"no {kind} intensity in the table")
    return table.drop(*(f(k) for k in KINDS if k not in kinds for f in (value_of, variance_of)))


def good_variance(table: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Without rows of variance 0 or less; for integrated kinds only where the row was integrated that way."""
    for kind in kinds:
        bad = F.col(variance_of(kind)) <= 0
        if kind != "scale":
            bad = bad & has_flags(F.col("flags"), FLAGS[f"integrated_{kind}"])
        table = table.where(~bad)
    return table


def outside_rings(table: DataFrame) -> DataFrame:
    """Without rows flagged as in a powder ring."""
    return table.where(~has_flags(F.col("flags"), FLAGS["in_powder_ring"]))


def within_d(table: DataFrame, d_min: float | None = None, d_max: float | None = None) -> DataFrame:
    """Without d <= d_min and d >= d_max; none of a limit of None or 0."""
    if d_min:
        table = table.where(~(F.col("d") <= d_min))
    if d_max:
        table = table.where(~(F.col("d") >= d_max))
    return table


def conversion(table: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of positive quantum efficiency, and the factor lp / qe of those columns that the table has."""
    factor = F.lit(1.0)
    for qe in ("qe", "dqe"):
        if qe in table.columns:
            table = table.where(F.col(qe) > 0)
            factor = factor / F.col(qe)
            break
    return table, factor * F.col("lp") if "lp" in table.columns else factor


def corrected(table: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Values times their corrections, variances times the squares: lp / qe of integrated kinds, summed ones over partiality too, scaled ones over the scale."""
    factors: dict[str, Column] = {}
    if "sum" in kinds or "prf" in kinds:
        table, factor = conversion(table)
        factors = {k: factor for k in ("sum", "prf") if k in kinds}
    if "partiality" in table.columns:
        table = table.where(F.col("partiality") > 0)
        if "sum" in factors:
            factors["sum"] = factors["sum"] / F.col("partiality")
    if "scale" in kinds:
        factors["scale"] = 1 / F.col("inverse_scale_factor")
    new = {}
    for kind, factor in factors.items():
        new[value_of(kind)] = F.col(value_of(kind)) * factor
        new[variance_of(kind)] = F.col(variance_of(kind)) * factor * factor
    return table.withColumns(new)


def combined_partials(table: DataFrame, kinds: tuple[str, ...], row_id: str = "row_id", full: float = 0.99) -> DataFrame:
    """Partial rows of one (id, partial_id) as one row, in place of the first; partialities are summed.

    Summed intensities add up, scaled ones take the mean weighted by 1 / variance, fitted ones weights of value squared
    over variance (without any weight 0, with the variances' sum). Rows that aren't partial, have a variance of 0 or less
    or are alone stay as they are.
    """
    partial = F.col("partiality") < full
    for kind in kinds:
        partial = partial & (F.col(variance_of(kind)) > 0)
    partial = F.coalesce(partial, F.lit(False))
    sums = [F.count("*").alias("_n"), F.sum("partiality").alias("_p"), F.min_by(F.struct(*table.columns), row_id).alias("_first")]
    results: dict[str, Column] = {"partiality": F.col("_p")}
    for kind in kinds:
        v, s = F.col(value_of(kind)), F.col(variance_of(kind))
        if kind == "sum":
            sums += [F.sum(v).alias("_sum_v"), F.sum(s).alias("_sum_s")]
            results[value_of(kind)], results[variance_of(kind)] = F.col("_sum_v"), F.col("_sum_s")
        elif kind == "scale":
            sums += [F.sum(v / s).alias("_scale_v"), F.sum(1 / s).alias("_scale_w")]
            results[value_of(kind)], results[variance_of(kind)] = F.col("_scale_v") / F.col("_scale_w"), 1 / F.col("_scale_w")
        else:
            w = v * v / s
            sums += [F.sum(w * v).alias("_prf_v"), F.sum(w * s).alias("_prf_s"), F.sum(w).alias("_prf_w"), F.sum(s).alias("_prf_all")]
            some = F.col("_prf_w") != 0
            results[value_of(kind)] = F.when(some, F.col("_prf_v") / F.col("_prf_w")).otherwise(F.lit(0.0))
            results[variance_of(kind)] = F.when(some, F.col("_prf_s") / F.col("_prf_w")).otherwise(F.col("_prf_all"))
    met = table.where(partial).groupBy("id", "partial_id").agg(*sums)
    several = F.col("_n") > 1
    out = met.select(*(F.when(several, results[c]).otherwise(F.col(f"_first.{c}")).alias(c) if c in results else F.col(f"_first.{c}").alias(c) for c in table.columns))
    return table.where(~partial).unionByName(out)


def least_i_over_sigma(table: DataFrame, kinds: tuple[str, ...], least: float | None) -> DataFrame:
    """Without rows whose value over its deviation is below least; 0 or None keeps all."""
    if least:
        for kind in kinds:
            table = table.where(~(F.col(value_of(kind)) / F.sqrt(variance_of(kind)) < least))
    return table


def filter_for_export(
    table: DataFrame,
    choice: str,
    *,
    min_i_over_sigma: float | None = None,
    rings: bool = False,
    combine_partials: bool = True,
    partiality: float = 0.99,
    d_min: float | None = None,
    d_max: float | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """The rows of a choice of intensities, corrected and combined, with ``fractioncalc``.

    The order shows in the result: assigned rows, the choice, bad variances, rings, d, corrections, partials, I over
    sigma. An empty result is the caller's to refuse (``require_rows``).
    """
    if choice not in CHOICES:
        raise ValueError(f"unknown intensity choice {choice}; one of {', '.join(CHOICES)}")
    kinds = CHOICES[choice]
    table = good_variance(drop_other_kinds(chosen(assigned(table), choice), kinds), kinds)
    table = corrected(within_d(outside_rings(table) if rings else table, d_min, d_max), kinds)
    if "partiality" not in table.columns:
        table = table.withColumn("fractioncalc", F.lit(1.0))
    else:
        if combine_partials and "partial_id" in table.columns:
            table = combined_partials(table, kinds, row_id)
        table = table.withColumn("fractioncalc", F.col("partiality")).where(~(F.col("partiality") < partiality))
    return least_i_over_sigma(table, kinds, min_i_over_sigma)


def export_or_fall_back(table: DataFrame, choice: str, **options) -> DataFrame:
    """``filter_for_export``; a choice with fitted intensities falls back to one without where no row was fitted. ValueError if nothing is left."""
    without = {"prf": None, "sum+prf": "sum", "sum|prf": "sum", "all": "sum+scale"}
    if choice in without and table.where(has_flags(F.col("flags"), FLAGS["integrated_prf"])).isEmpty():
        if without[choice] is None:
            raise ValueError("no fitted intensities in the table")
        choice = without[choice]
    return require_rows(filter_for_export(table, choice, **options))


def export_mask(table: DataFrame, choice: str, row_id: str = "row_id", **options) -> DataFrame:
    """(row_id, kept): which rows of the table the export keeps."""
    kept = filter_for_export(table, choice, row_id=row_id, **options).select(row_id).withColumn("_kept", F.lit(True))
    return table.select(row_id).join(kept, row_id, "left").select(row_id, F.coalesce("_kept", F.lit(False)).alias("kept"))


# filters of rows by columns, for programs

#: Comparisons of a selector.
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "&": lambda a, b: a.bitwiseAND(b) != 0,
}


def selector(table: DataFrame, column: str, op: str, value) -> Column:
    """The mask of ``column op value``. ``<kind>.i_over_sigma`` is false where the variance is not positive; columns of parts raise TypeError."""
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op}")
    if column.endswith(".i_over_sigma"):
        kind = column.rsplit(".", 1)[0]
        value_, variance = F.col(value_of(kind)), F.col(variance_of(kind))
        return (variance > 0) & COMPARE[op](F.when(variance > 0, value_ / F.sqrt(variance)), F.lit(value))
    if column not in table.columns:
        raise KeyError(column)
    if dict(table.dtypes)[column].startswith(("struct", "array", "map")):
        raise TypeError(f"{column} has several parts")
    return COMPARE[op](F.col(column), F.lit(value))


def select_where(table: DataFrame, text: str) -> DataFrame:
    """Rows of a comparison written as "column op value"."""
    column, op, value = text.split(None, 2)
    kind = dict(table.dtypes).get(column, "double")
    return table.where(selector(table, column, op, value if kind == "string" else int(value) if op == "&" or kind in ("int", "bigint") else float(value)))


def in_ring_ranges(d: Column, rings: list[tuple[float, float]]) -> Column:
    """Whether 1 / d squared lies less than half a width from a ring (place, width)."""
    x = 1 / (d * d)
    return F.exists(F.array(*(F.struct(F.lit(float(r)).alias("r"), F.lit(float(w)).alias("w")) for r, w in rings)), lambda y: F.abs(x - y["r"]) < y["w"] / 2)


#: Ranges of 1 / d squared of ice rings (fixed values).
ICE_RINGS = [
    (0.064, 0.069), (0.071, 0.078), (0.0825, 0.088), (0.138, 0.144), (0.19, 0.205), (0.228, 0.24), (0.262, 0.266), (0.267, 0.278),
    (0.28, 0.288), (0.337, 0.341), (0.429, 0.435), (0.459, 0.466), (0.478, 0.486), (0.531, 0.537),
]


def in_ice_ring(d: Column, ranges: list[tuple[float, float]] | None = None) -> Column:
    """Whether 1 / d squared lies in a closed range."""
    x = 1 / (d * d)
    out = F.lit(False)
    for low, high in ranges or ICE_RINGS:
        out = out | ((x >= low) & (x <= high))
    return out


def filter_rows(
    table: DataFrame,
    *,
    flags: Column | None = None,
    ids: list[int] | None = None,
    panels: list[int] | None = None,
    d_min: float | None = None,
    d_max: float | None = None,
    partiality_min: float | None = None,
    partiality_max: float | None = None,
    good: str | None = None,
    indices: DataFrame | None = None,
    index: list[str] | None = None,
    ice: bool = False,
) -> DataFrame:
    """The chain of the filter program: flags, ids, panels, d (both limits kept), partiality, positive variance of a kind, a list of indices, ice rings."""
    conditions = [
        flags,
        F.col("id").isin(ids) if ids else None,
        F.col("panel").isin(panels) if panels else None,
        F.col("d") >= d_min if d_min is not None else None,
        F.col("d") <= d_max if d_max is not None else None,
        F.col("partiality") >= partiality_min if partiality_min is not None else None,
        F.col("partiality") <= partiality_max if partiality_max is not None else None,
        F.col(variance_of(good)) > 0 if good else None,
    ]
    for c in conditions:
        if c is not None:
            table = table.where(c)
    if indices is not None:
        table = table.join(indices.select(*index).distinct(), index, "left_semi")
    return table.where(~in_ice_ring(F.col("d"))) if ice else table


# validity of rows by their geometry and boxes


def by_least_zeta(zeta: Column, least: float) -> Column:
    """|zeta| of at least so much."""
    return F.abs(zeta) >= least


def by_volume(table: DataFrame, volume: Column, bins: int = 200) -> DataFrame:
    """Rows of box volumes up to the threshold of their histogram: the bin farthest from the line from the highest bin to the last one."""
    ends = table.agg(F.min(volume).alias("lo"), F.max(volume).alias("hi")).first()
    if ends.lo is None or ends.hi == ends.lo:
        return table
    step = (ends.hi - ends.lo) / bins
    slot = F.least(F.lit(bins - 1), F.floor((volume - ends.lo) / step)).cast("int")
    counts = dict(table.groupBy(slot.alias("b")).count().collect())  # a row per bin
    heights = [counts.get(k, 0) for k in range(bins)]
    top = max(range(bins), key=lambda k: heights[k])
    last = max(k for k in range(bins) if heights[k])
    best, at = -1.0, last
    for k in range(top, last + 1):
        line = heights[top] + (heights[last] - heights[top]) * (k - top) / max(1, last - top)
        if line - heights[k] > best:
            best, at = line - heights[k], k
    return table.where(volume <= ends.lo + step * (at + 1))
