"""Programs by name: each takes tables and options and returns a table. ``python -m tessera.programs NAME in=PATH out=PATH option=value``."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import plugins
from tessera.functions import binning
from tessera.functions.flags import FlagExpression, flag_census
from tessera.operators import datasets, export, groups, reports, residuals, scaling, spots, statistics, table
from tessera.sources import formats

VERSION = "2.0"
PROGRAMS: dict[str, Callable[..., DataFrame]] = {}


def program(f):
    PROGRAMS[f.__name__] = f
    return f


@program
def filter_reflections(rows: DataFrame, flag_expression: str = "", **options) -> DataFrame:
    """Rows by flags, ids, panels, d, partiality, indices, ice rings; without any option the census of flags."""
    if not flag_expression and not options:
        return flag_census(rows)
    flags = FlagExpression(flag_expression).column(F.col("flags")) if flag_expression else None
    return export.filter_rows(rows, flags=flags, **options)


@program
def sort_reflections(rows: DataFrame, key: str = "row_id", reverse: bool = False, head: int | None = None) -> DataFrame:
    out = table.sort_rows(rows, key, "row_id", reverse)
    return out.limit(head) if head else out


@program
def merge_reflection_lists(rows: DataFrame, other: DataFrame, how: str = "update") -> DataFrame:
    """``update`` takes the other's columns row by row, of as many rows; ``extend`` appends its rows, of as many columns."""
    if how == "extend":
        if set(rows.columns) != set(other.columns):
            raise ValueError("the tables have different columns")
        return rows.unionByName(other)
    if rows.count() != other.count():
        raise ValueError("the tables have different numbers of rows")
    return table.update(rows, other, "row_id")


@program
def split_experiments(rows: DataFrame, chunk_size: int = 1) -> DataFrame:
    """rows with the chunk that they are written under."""
    return rows.withColumn("chunk", datasets.chunk_of(chunk_size))


@program
def combine_experiments(rows: DataFrame, ids: DataFrame, other: DataFrame, other_ids: DataFrame) -> DataFrame:
    return datasets.combine([datasets.Datasets(rows, ids), datasets.Datasets(other, other_ids)]).rows


@program
def assign_experiment_identifiers(rows: DataFrame, ids: DataFrame, seed: int = 0) -> DataFrame:
    return datasets.Datasets(rows, ids).assign_identifiers(seed).ids


@program
def slice_sequence(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    return table.in_ranges(rows, ranges, "z", "slice")


@program
def sequence_to_stills(rows: DataFrame, points: DataFrame) -> DataFrame:
    return datasets.stills_of_sequence(rows, points)


@program
def detect_blanks(rows: DataFrame, z: str = "z", loss: float = 0.1, by: str = "id") -> DataFrame:
    """Runs of images with at most a share of the rows of the fullest one."""
    counts = rows.groupBy(by, F.floor(z).cast("int").alias("image")).agg(F.count("*").alias("c"))
    most = counts.groupBy(by).agg(F.max("c").alias("most"), F.min("image").alias("lo"), F.max("image").alias("hi"))
    every = most.select(by, "most", F.explode(F.sequence("lo", "hi")).alias("image"))
    flagged = every.join(counts, [by, "image"], "left").withColumn("bad", F.coalesce("c", F.lit(0)) <= loss * F.col("most"))
    return binning.islands(flagged, "image", "bad", [by])


@program
def missing_reflections(rows: DataFrame, complete: DataFrame) -> DataFrame:
    return spots.missing_regions(rows, complete, ["h", "k", "l"])


@program
def spot_counts_per_image(rows: DataFrame) -> DataFrame:
    return residuals.spots_per_image(rows, F.col("z"), F.col("flags"))


@program
def spot_resolution_shells(rows: DataFrame, d_min: float = 1.0, d_max: float = 50.0, shells: int = 10) -> DataFrame:
    return binning.shell_counts(rows, F.col("d"), d_min, d_max, shells)


@program
def find_spots(pixels: DataFrame, least: int = 3, most: int = 1000, flat: bool = False) -> DataFrame:
    """Spots from a table of strong pixels (panel, z, y, x, node, value)."""
    return spots.by_size(spots.boxes(spots.label_pixels(pixels, flat=flat), "value"), least, most)


@program
def find_hot_pixels(found: DataFrame, depth: int) -> DataFrame:
    return spots.spanning(found, depth)


@program
def indexed_as_integrated(rows: DataFrame) -> DataFrame:
    return residuals.as_integrated(rows)


@program
def reindex(rows: DataFrame, operator: list[list[int]]) -> DataFrame:
    from tessera.functions.geometry import reindexed

    return rows.withColumns({c: v.cast("int") for c, v in zip("hkl", reindexed([F.col(c) for c in "hkl"], operator), strict=True)})


@program
def export_rows(rows: DataFrame, format: str = "shelx", choice: str = "sum", **options) -> DataFrame:
    """The lines of a text format of a choice of intensities."""
    kind = export.CHOICES[choice][-1]
    out = export.export_or_fall_back(rows, choice, **options)
    out = out.withColumns({"value": F.col(export.value_of(kind)), "sigma": F.sqrt(export.variance_of(kind)), "batch": F.floor("z").cast("int")})
    return formats.lines(formats.scale_to_fit(out, format), format, ["h", "k", "l"])


@program
def merge(rows: DataFrame, key: str = "key", internal: bool = False) -> DataFrame:
    return scaling.merged(rows, [key], "intensity", "variance", internal)


@program
def merging_statistics(rows: DataFrame, key: str = "key", bin: str = "bin") -> DataFrame:
    return groups.merging_statistics(rows, [key], bin, "intensity", "variance")


@program
def compute_delta_cchalf(rows: DataFrame, key: str = "key", group: str = "id", bin: str = "bin", bins: int = 10, deviations: float = 4.0) -> DataFrame:
    return statistics.below_cutoff(statistics.delta_cc_half_binned(rows, [key], group, bin, "intensity", bins), deviations)


@program
def correlation_matrix(rows: DataFrame, key: str = "key") -> DataFrame:
    return groups.dataset_correlations(rows, [key], "id", "intensity")


@program
def damage_analysis(rows: DataFrame, key: str = "key", dose: str = "dose") -> DataFrame:
    return statistics.cumulative_r(statistics.pair_sums(rows, [key], dose, "intensity", "variance", "row_id", "dose"))


@program
def scale(rows: DataFrame, key: str = "key") -> DataFrame:
    scales = scaling.scale_datasets(rows, [key], "id", "intensity", "variance")
    return scaling.scaled(rows, scales, "id", "intensity", "variance")


@program
def refine_error_model(rows: DataFrame, key: str = "key") -> DataFrame:
    a, b = scaling.fit_error_model(scaling.error_deviations(rows, [key], "intensity", "variance"))
    return rows.sparkSession.createDataFrame([(a, b)], "a double, b double")


@program
def estimate_resolution(binned: DataFrame, metric: str = "cc_half", limit: float | None = None) -> DataFrame:
    return binned.sparkSession.createDataFrame([(metric, statistics.estimate_resolution(binned, metric, limit))], "metric string, d_min double")


@program
def report(rows: DataFrame) -> DataFrame:
    return residuals.integration_overall(rows)


@program
def show(rows: DataFrame) -> DataFrame:
    """Least, greatest and mean value of each numeric column, parts of structs one by one."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    flat = rows.select(*(F.col(f"{c}.{f.name}").alias(f"{c}_{f.name}") for c in rows.columns if rows.schema[c].dataType.typeName() == "struct" for f in rows.schema[c].dataType.fields), *(c for c, t in rows.dtypes if t in numeric))
    return reports.column_summary(flat, [c for c, t in flat.dtypes if t in numeric])


@program
def rs_mapper(points: DataFrame, step: float = 0.01) -> DataFrame:
    return spots.voxels(points, [F.col(c) for c in "xyz"], step, "value")


@program
def show_extensions(rows: DataFrame) -> DataFrame:
    known = [(g, n, k == 0) for g in plugins.groups() for k, n in enumerate(plugins.extensions(g))]
    return rows.sparkSession.createDataFrame(known, "grp string, name string, is_default boolean")


@program
def version(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([(VERSION,)], "version string")


def run(name: str, *tables: DataFrame, **options) -> DataFrame:
    """A program's result; KeyError for an unknown name."""
    if name not in PROGRAMS:
        raise KeyError(f"no program {name}; known: {', '.join(sorted(PROGRAMS))}")
    return PROGRAMS[name](*tables, **options)


def main(argv: list[str]) -> None:
    """Reads the tables of ``in=``, runs the program with the other options, and writes ``out=`` or shows rows."""
    import json

    from pyspark.sql import SparkSession

    name, options, paths, out = argv[0], {}, [], None
    for word in argv[1:]:
        key, value = word.split("=", 1)
        if key == "in":
            paths.append(value)
        elif key == "out":
            out = value
        else:
            try:
                options[key] = json.loads(value)
            except ValueError:
                options[key] = value
    spark = SparkSession.builder.getOrCreate()
    result = run(name, *(formats.read(spark, p, "auto") for p in paths), **options)
    if out:
        formats.write(result, out, "parquet")
    else:
        result.show(50, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
