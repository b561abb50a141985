"""Further registered queries: reports, spots and regions, scalar and array functions, whole-table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar, shoebox
from tessera.operators import graph, joins, outliers, reports, residuals, scaling, spots, table
from tessera.plans.more import E, integrated
from tessera.plans.queries import M, measurements, query, read

# reports

#: Observed positions x, z beside predicted ones, which a row's other columns stand for.
RES = f"{M}, r AS (SELECT row_id, id, panel, x, z, flags, x + scale * 3 - 3.1 AS px, z + partiality * 2 - 1.9 AS pz, d FROM m)"


def _residuals(spark, d) -> DataFrame:
    m = measurements(spark, d)
    return m.withColumns({"px": F.col("x") + F.col("scale") * 3 - 3.1, "pz": F.col("z") + F.col("partiality") * 2 - 1.9})


@query(f"{M}, c AS (SELECT CAST(floor(z) AS INT) AS image, id, count(*) AS n, CAST(count(*) FILTER ((flags & 4) = 4) AS BIGINT) AS n_indexed FROM m GROUP BY ROLLUP (1, id)) SELECT * FROM c WHERE image IS NOT NULL")
def spots_per_image(spark, d):
    return residuals.spots_per_image(measurements(spark, d), F.col("z"), F.col("flags"))


@query(f"{RES}, v AS (SELECT sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) AS v FROM r), b AS (SELECT CAST(least(19, floor(v / (0.3 / 20))) AS INT) AS slot, count(*) AS n FROM v WHERE v >= 0 AND v <= 0.3 GROUP BY 1) SELECT CAST(range AS INT) AS slot, coalesce(n, 0) AS n, CAST(coalesce(n, 0) AS DOUBLE) AS total FROM range(20) LEFT JOIN b ON slot = range")
def residual_histogram(spark, d):
    return residuals.residual_histogram(_residuals(spark, d), [F.col("x"), F.col("z").cast("double")], [F.col("px"), F.col("pz")], 0.3, 20)


@query(f"{RES} SELECT CAST(floor(x / 7.0) AS INT) AS xbin, CAST(floor(z / 7.0) AS INT) AS ybin, count(*) AS n, round(avg(x - px + 7), 7) AS mean FROM r WHERE (flags & 4) = 4 GROUP BY ALL")
def residual_map(spark, d):
    out = residuals.map_of(_residuals(spark, d), F.col("x"), F.col("z"), 7.0, F.col("x") - F.col("px") + 7, F.col("flags").bitwiseAND(F.lit(4)) == 4)
    return out.withColumn("mean", F.round("mean", 7))


@query(f"{RES} SELECT CAST(floor(z / 30.0) AS INT) AS bin, count(*) AS n, round(avg(x - px), 7) AS mean_dx, round(sqrt(avg((x - px) * (x - px))), 7) AS rms_dx, round(avg(z - pz), 7) AS mean_dz, round(sqrt(avg((z - pz) * (z - pz))), 7) AS rms_dz FROM r GROUP BY 1")
def residuals_by_angle(spark, d):
    out = residuals.residuals_by_angle(_residuals(spark, d), F.col("z"), 30.0, {"dx": F.col("x") - F.col("px"), "dz": F.col("z") - F.col("pz")})
    return out.select("bin", "n", *(F.round(c, 7).alias(c) for c in out.columns[2:]))


@query(f"{RES}, b AS (SELECT CAST(floor((x - px) / 0.0171) AS INT) AS x, CAST(floor((z - pz) / 0.0171) AS INT) AS z, CAST(floor(d / 0.0171) AS INT) AS d FROM r) SELECT 'xz' AS pair, x AS a, z AS b, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'xd', x, d, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'zd', z, d, count(*) FROM b GROUP BY ALL")
def residual_cross_plots(spark, d):
    return residuals.cross_plots(_residuals(spark, d), {"x": F.col("x") - F.col("px"), "z": F.col("z") - F.col("pz"), "d": F.col("d")}, 0.0171)


@query(f"{E}, v AS (SELECT least(sum_value / sqrt(sum_variance), 20000) AS v FROM e WHERE sum_value > 0 AND sum_variance > 0), b AS (SELECT CAST(least(49, floor(v / (20000.0 / 50))) AS INT) AS slot, count(*) AS n FROM v GROUP BY 1) SELECT CAST(range AS INT) AS slot, coalesce(n, 0) AS n, CAST(coalesce(n, 0) AS DOUBLE) AS total FROM range(50) LEFT JOIN b ON slot = range")
def significance_histogram(spark, d):
    return residuals.significance_histogram(integrated(spark, d), "sum_value", "sum_variance", 20000.0, 50)


@query(f"{E} SELECT CAST(floor(z) AS INT) AS image, count(*) AS n, round(avg(sum_value / sqrt(sum_variance)), 3) AS i_over_sigma FROM e WHERE sum_value > 0 AND sum_variance > 0 GROUP BY 1")
def significance_by_image(spark, d):
    return residuals.significance_by_image(integrated(spark, d), F.col("z"), "sum_value", "sum_variance").withColumn("i_over_sigma", F.round("i_over_sigma", 3))


@query(f"{M}, b AS (SELECT CAST(least(19, floor(partiality / 0.05)) AS INT) AS slot, count(*) AS n FROM m WHERE partiality > 0 GROUP BY 1) SELECT CAST(range AS INT) AS slot, coalesce(n, 0) AS n, CAST(coalesce(n, 0) AS DOUBLE) AS total FROM range(20) LEFT JOIN b ON slot = range")
def partiality_histogram(spark, d):
    return residuals.partiality_histogram(measurements(spark, d))


@query(f"{M} SELECT CAST(floor(d) AS INT) AS bin, count(*) AS n, round(avg(partiality), 8) AS mean, min(partiality) AS low, max(partiality) AS high FROM m GROUP BY 1")
def profile_correlation_by_d(spark, d):
    return residuals.correlation_by(measurements(spark, d), F.floor("d").cast("int"), "partiality").withColumn("mean", F.round("mean", 8))


_FLAG_COUNTS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN (flags & {v}) {test} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}"
    for n, v, test in (
        ("n_overload", 1024, "= 1024"), ("n_ice", 8192, "= 8192"), ("n_summed", 256, "= 256"), ("n_fitted", 512, "= 512"), ("n_integrated", 768, "<> 0"),
        ("n_invalid_bg", 32768, "= 32768"), ("n_invalid_fg", 16384, "= 16384"), ("n_failed_background", 262144, "= 262144"), ("n_failed_summation", 524288, "= 524288"), ("n_failed_fitting", 1048576, "= 1048576"),
    )
)
_REPORT = (
    f"count(*) AS n, CAST(count(*) FILTER (partiality >= 0.99) AS BIGINT) AS n_full, CAST(count(*) FILTER (NOT partiality >= 0.99) AS BIGINT) AS n_partial, {_FLAG_COUNTS}, "
    "round(coalesce(avg(scale * 10) FILTER ((flags & 768) <> 0), 0), 6) AS mean_background, round(coalesce(avg(sum_value / sqrt(sum_variance)) FILTER ((flags & 256) = 256), 0), 3) AS ios_sum, "
    "round(coalesce(avg(prf_value / sqrt(prf_variance)) FILTER ((flags & 512) = 512), 0), 3) AS ios_prf, round(coalesce(avg(partiality) FILTER ((flags & 512) = 512), 0), 8) AS cc_prf, "
    "round(coalesce(corr(sum_value, prf_value) FILTER ((flags & 768) = 768), 0), 6) AS cc_pearson_sum_prf"
)


def _reported(spark, d) -> DataFrame:
    rows = integrated(spark, d).where("prf_variance > 0 AND sum_variance > 0")
    return rows.withColumns({"background": F.col("scale") * 10, "correlation": F.col("partiality")})


def _rounded(out: DataFrame) -> DataFrame:
    digits = {"mean_background": 6, "ios_sum": 3, "ios_prf": 3, "cc_prf": 8, "cc_pearson_sum_prf": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(f"{E} SELECT {_REPORT} FROM e WHERE prf_variance > 0 AND sum_variance > 0")
def integration_overall(spark, d):
    return _rounded(residuals.integration_overall(_reported(spark, d)))


@query(f"{E}, b AS (SELECT CAST(floor(d) AS INT) AS bin, {_REPORT} FROM e WHERE prf_variance > 0 AND sum_variance > 0 GROUP BY 1) SELECT CAST(range AS INT) AS bin, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["n", "n_full", "n_partial", *residuals.REPORT_FLAGS, "mean_background", "ios_sum", "ios_prf", "cc_prf", "cc_pearson_sum_prf"]) + " FROM range(8) LEFT JOIN b ON bin = range")
def integration_binned(spark, d):
    return _rounded(residuals.integration_binned(_reported(spark, d), F.floor("d"), 8))


@query(f"{M} SELECT DISTINCT id, key % 17 AS model FROM m")
def model_connectivity(spark, d):
    return residuals.connectivity(measurements(spark, d).withColumn("model", F.col("key") % 17), "id", "model")


@query(f"{M} SELECT row_id, flags | 256 AS flags, CAST(1 AS DOUBLE) AS partiality, row_id AS partial_id FROM m WHERE (flags & 4) = 4")
def indexed_as_integrated(spark, d):
    return residuals.as_integrated(measurements(spark, d)).select("row_id", "flags", "partiality", "partial_id")


# spots and regions


def _pixels(spark, d) -> DataFrame:
    cells = measurements(spark, d).select(
        "panel", F.floor(F.col("z") / 40).cast("int").alias("z"), (F.col("key") % 60).cast("int").alias("x"), (F.floor(F.col("key") / 60) % 60).cast("int").alias("y"), "row_id"
    )
    return cells.groupBy("panel", "z", "x", "y").agg(F.min("row_id").alias("node"), F.count("*").cast("double").alias("v"))


@query()
def pixel_labels(spark, d):
    found = spots.boxes(spots.label_pixels(_pixels(spark, d)), "v")
    return found.select("label", "panel", "x0", "x1", "y0", "y1", "z0", "z1", "n", "total")


@query()
def spot_finding(spark, d):
    found = spots.by_size(spots.boxes(spots.label_pixels(_pixels(spark, d), flat=True), "v"), 2, 50)
    found = spots.peak_near_centre(found, [F.col("x0") + 0.5, F.col("y0") + 0.5], [F.col("x_centre"), F.col("y_centre")], 3.0)
    return spots.in_dense_cells(found, F.col("x_centre"), F.col("y_centre"), 10.0, 40).select("label", "panel", "n", "total", "dense")


@query()
def near_clusters(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return spots.near_clusters(e.where("x IS NOT NULL"), ["x", "y", "z"], 0.03)


@query()
def missing_regions(spark, d):
    complete = spark.range(13 * 11 * 7).selectExpr("CAST(id % 13 - 6 AS INT) AS h", "CAST(floor(id / 13) % 11 - 5 AS INT) AS k", "CAST(floor(id / 143) - 3 AS INT) AS l")
    return spots.missing_regions(measurements(spark, d).where("id = 0 AND panel > 4"), complete, ["h", "k", "l"])


@query("SELECT CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.1) AS INT) AS vx, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.1) AS INT) AS vy, CAST(floor(CAST(embedding[3] AS DOUBLE) / 0.1) AS INT) AS vz, count(*) AS n, round(avg(CAST(embedding[4] AS DOUBLE)), 7) AS mean FROM embeddings GROUP BY ALL")
def voxels(spark, d):
    e = read(spark, d, "embeddings").select(*(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyzv")))
    return spots.voxels(e, [F.col(c) for c in "xyz"], 0.1, "v").withColumn("mean", F.round("mean", 7))


@query("WITH v AS (SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) * 20 AS a, CAST(embedding[2] AS DOUBLE) * 15 + CAST(embedding[1] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) * 10 AS c FROM embeddings), r AS (SELECT row_id, CAST(round(a) AS INT) AS h, CAST(round(b) AS INT) AS k, CAST(round(c) AS INT) AS l, (a - round(a)) * (a - round(a)) + (b - round(b)) * (b - round(b)) + (c - round(c)) * (c - round(c)) AS off FROM v WHERE abs(a - round(a)) <= 0.35 AND abs(b - round(b)) <= 0.35 AND abs(c - round(c)) <= 0.35) SELECT row_id, h, k, l FROM r QUALIFY row_number() OVER (PARTITION BY h, k, l ORDER BY off, row_id) = 1")
def assign_indices(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return spots.assign_indices(e, [F.col(c) for c in "xyz"], [[20, 0, 0], [1, 15, 0], [0, 0, 10]], 0.35)


@query("WITH e AS (SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), p AS (SELECT a.row_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM e a JOIN e b ON a.row_id <> b.row_id) SELECT row_id, round(sqrt(min(d2)), 8) AS distance FROM p WHERE d2 <= 0.0036 GROUP BY row_id")
def neighbour_distances(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return spots.nearest_distances(e, ["x", "y", "z"], 0.06).withColumn("distance", F.round("distance", 8))


@query(f"{M}, a AS (SELECT h, k, l, avg(intensity) AS v FROM m WHERE id < 5 GROUP BY ALL), r AS (SELECT 0 AS operator, h, k, l, intensity FROM m WHERE id >= 5 UNION ALL SELECT 1, k, h, -l, intensity FROM m WHERE id >= 5 UNION ALL SELECT 2, -h, -k, l, intensity FROM m WHERE id >= 5), b AS (SELECT operator, h, k, l, avg(intensity) AS v FROM r GROUP BY ALL) SELECT operator, count(*) AS n, round(corr(a.v, b.v), 6) AS cc FROM a JOIN b USING (h, k, l) GROUP BY operator")
def reindex_search(spark, d):
    m = measurements(spark, d)
    operators = [[[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[0, 1, 0], [1, 0, 0], [0, 0, -1]], [[-1, 0, 0], [0, -1, 0], [0, 0, 1]]]
    out = spots.best_reindexing(m.where("id < 5"), m.where("id >= 5"), ["h", "k", "l"], operators, "intensity", lambda c: F.struct(*c))
    return out.withColumn("cc", F.round("cc", 6))


# scalar functions

_ONE = ["acos", "asin", "atan", "cos", "cosh", "sin", "sinh", "tan", "tanh", "exp"]


@query(f"{M} SELECT row_id, " + ", ".join(f"round({f}(partiality), 9) AS {f}" for f in _ONE) + ", round(ln(intensity), 9) AS log, round(log10(intensity), 9) AS log10, round(sqrt(intensity), 9) AS sqrt, intensity * intensity AS pow2, CAST(ceil(d) AS BIGINT) AS ceil, CAST(floor(d) AS BIGINT) AS floor, abs(z - 1000) AS abs, round(atan2(partiality, scale), 9) AS atan2, round(power(d, 1.5), 9) AS pow, (z - 1000) % 7 AS fmod, ((z - 1000) % 7 + 7) % 7 AS fmod_positive FROM m")
def elementwise(spark, d):
    m = measurements(spark, d)
    f, two = scalar.ELEMENTWISE, scalar.BINARY
    out = [F.round(f[n](F.col("partiality")), 9).alias(n) for n in _ONE] + [F.round(f[n](F.col("intensity")), 9).alias(n) for n in ("log", "log10", "sqrt")]
    off = F.col("z") - 1000
    out += [f["pow2"](F.col("intensity")).alias("pow2"), f["ceil"](F.col("d")).alias("ceil"), f["floor"](F.col("d")).alias("floor"), f["abs"](off).alias("abs")]
    out += [F.round(two["atan2"](F.col("partiality"), F.col("scale")), 9).alias("atan2"), F.round(two["pow"](F.col("d"), F.lit(1.5)), 9).alias("pow")]
    return m.select("row_id", *out, two["fmod"](off, F.lit(7)).alias("fmod"), two["fmod_positive"](off, F.lit(7)).alias("fmod_positive"))


@query(f"{M} SELECT panel, round(sum(d), 4) AS sum, round(sum(d * d), 4) AS sum_sq, round(avg(d), 8) AS mean, round(avg(d * d), 8) AS mean_sq, min(d) AS min, max(d) AS max, max(abs(z - 1000)) AS max_absolute, median(intensity) AS median, round(sum(intensity * scale) / sum(scale), 4) AS mean_weighted, round(sum(intensity * intensity * scale) / sum(scale), 0) AS mean_sq_weighted, round(var_samp(d), 8) AS variance, arg_min(row_id, (intensity, row_id)) AS min_index, arg_max(row_id, (intensity, -row_id)) AS max_index, CAST(0 AS DOUBLE) AS none FROM m GROUP BY panel")
def reducers(spark, d):
    r, v, w = scalar.REDUCERS, F.col("d"), F.col("scale")
    i, row = F.col("intensity"), F.col("row_id")
    return measurements(spark, d).groupBy("panel").agg(
        *(F.round(r[n](v), k).alias(n) for n, k in (("sum", 4), ("sum_sq", 4), ("mean", 8), ("mean_sq", 8))),
        r["min"](v).alias("min"), r["max"](v).alias("max"), r["max_absolute"](F.col("z") - 1000).alias("max_absolute"), r["median"](i).alias("median"),
        F.round(scalar.mean_weighted(i, w), 4).alias("mean_weighted"), F.round(scalar.mean_sq_weighted(i, w), 0).alias("mean_sq_weighted"),
        F.round(scalar.mean_and_variance(v)["variance"], 8).alias("variance"), scalar.min_index(i, row).alias("min_index"), scalar.max_index(i, row).alias("max_index"),
        scalar.with_default(r["min"](F.when(v < 0, v)), 0.0).alias("none"),
    )


@query(f"{M} SELECT row_id, round(d * cos(scale), 9) AS re, round(d * sin(scale), 9) AS im, round(d * d, 8) AS norm, round(atan2(sin(scale), cos(scale)), 9) AS arg, round(d * partiality * cos(scale) , 9) AS times_re, round(-d * sin(scale), 9) AS conj_im FROM m")
def complex_numbers(spark, d):
    z = scalar.polar(F.col("d"), F.col("scale"))
    out = {"re": z["re"], "im": z["im"], "arg": scalar.arg(z), "times_re": scalar.times(z, scalar.complex_of(F.col("partiality"), F.lit(0)))["re"], "conj_im": scalar.conj(z)["im"]}
    return measurements(spark, d).select("row_id", *(F.round(c, 9).alias(n) for n, c in out.items()), F.round(scalar.norm(z), 8).alias("norm"))


_LAB = "SELECT row_id, x * 0.172 - 40 AS a, d * 10 * 0.172 - 45 AS b, CAST(200 AS DOUBLE) AS c, CAST(z AS DOUBLE) / 1000 AS w FROM m"


@query(f"{M}, lab AS ({_LAB}), s AS (SELECT row_id, w, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM lab), r AS (SELECT row_id, w, x, y, z - 1 AS q FROM s) SELECT row_id, round(x, 9) AS rx, round(y * cos(w) + q * sin(w), 9) AS ry, round(q * cos(w) - y * sin(w), 9) AS rz, round(sqrt(x * x + y * y + q * q), 9) AS size FROM r")
def reciprocal_positions(spark, d):
    mm = scalar.px_to_mm(F.col("x"), F.col("d") * 10, (0.172, 0.172))
    s1 = scalar.scattered(scalar.mm_to_lab(*mm, [-40, -45, 200], [1, 0, 0], [0, 1, 0]), 1.0)
    still = scalar.to_reciprocal(s1, [0, 0, 1], None, None)
    r = scalar.to_reciprocal(s1, [0, 0, 1], [1, 0, 0], F.col("z") / 1000)
    return measurements(spark, d).select("row_id", *(F.round(c, 9).alias(n) for c, n in zip(r, ("rx", "ry", "rz"), strict=True)), F.round(scalar.norms(still), 9).alias("size"))


@query(f"{M}, lab AS ({_LAB}), s AS (SELECT row_id, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM lab) SELECT row_id, round(abs(y) / ((1 - 2 * 0.9) * (1 - y * y) + 0.9 * (1 + z * z)), 8) AS lp, round(1 - exp(-0.5 / abs(z)), 9) AS qe, round(200 * x / z + 40, 6) AS hit_x, round(200 * y / z + 45, 6) AS hit_y FROM s")
def corrections_and_hits(spark, d):
    mm = scalar.px_to_mm(F.col("x"), F.col("d") * 10, (0.172, 0.172))
    s1 = scalar.scattered(scalar.mm_to_lab(*mm, [-40, -45, 200], [1, 0, 0], [0, 1, 0]), 1.0)
    hit = scalar.ray_intersection(s1, [-40, -45, 200], [1, 0, 0], [0, 1, 0])
    lp = scalar.lp_correction(s1, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.9)
    return measurements(spark, d).select(
        "row_id", F.round(lp, 8).alias("lp"), F.round(scalar.absorbed(s1, [0, 0, 1], 0.5, 1.0), 9).alias("qe"), F.round(hit["x"], 6).alias("hit_x"), F.round(hit["y"], 6).alias("hit_y")
    )


@query(f"{M} SELECT panel, round(regr_slope(intensity, x), 6) AS slope, round(regr_intercept(intensity, x), 4) AS intercept, round(corr(intensity, x), 9) AS correlation FROM m GROUP BY panel")
def linear_fit(spark, d):
    out = measurements(spark, d).groupBy("panel").agg(*scalar.linear_fit("x", "intensity"))
    return out.select("panel", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("correlation", 9).alias("correlation"))


@query(f"{M} SELECT row_id, round(CASE WHEN d <= 2 THEN 10 + (d - 1) * 5 WHEN d <= 4 THEN 15 - (d - 2) * 3.5 END, 8) AS y, round((CASE WHEN abs(d - 1) <= 2.03 THEN exp(-(d - 1) * (d - 1) / 0.98) * 3 ELSE 0 END + CASE WHEN abs(d - 3) <= 2.03 THEN exp(-(d - 3) * (d - 3) / 0.98) * 5 ELSE 0 END + CASE WHEN abs(d - 5) <= 2.03 THEN exp(-(d - 5) * (d - 5) / 0.98) * 4 ELSE 0 END) / (CASE WHEN abs(d - 1) <= 2.03 THEN exp(-(d - 1) * (d - 1) / 0.98) ELSE 0 END + CASE WHEN abs(d - 3) <= 2.03 THEN exp(-(d - 3) * (d - 3) / 0.98) ELSE 0 END + CASE WHEN abs(d - 5) <= 2.03 THEN exp(-(d - 5) * (d - 5) / 0.98) ELSE 0 END), 8) AS smooth FROM m")
def interpolation_and_smoothing(spark, d):
    x = F.col("d")
    y, smooth = scalar.interpolated(x, [(1, 10), (2, 15), (4, 8)]), scalar.smoothed(x, [1, 3, 5], [3, 5, 4], 0.7, 2.9)
    return measurements(spark, d).select("row_id", F.round(y, 8).alias("y"), F.round(smooth, 8).alias("smooth"))


@query(f"{M}, v AS (SELECT DISTINCT key AS v FROM m WHERE key % 7 < 4 AND x < 20), r AS (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM v) SELECT min(v) AS first, max(v) AS last FROM r GROUP BY g")
def condensed_ranges(spark, d):
    return scalar.condensed(measurements(spark, d).where("key % 7 < 4 AND x < 20"), "key")


@query(f"{M}, a AS (SELECT DISTINCT key FROM m WHERE id = 1), b AS (SELECT DISTINCT key FROM m WHERE id = 2) SELECT 'union' AS kind, key FROM (SELECT key FROM a UNION SELECT key FROM b) UNION ALL SELECT 'intersection', key FROM a WHERE key IN (SELECT key FROM b)")
def index_sets(spark, d):
    m = measurements(spark, d)
    a, b = m.where("id = 1"), m.where("id = 2")
    both = scalar.intersection_of(a, b, "key").select(F.lit("intersection").alias("kind"), "key")
    return scalar.union_of(a, b, "key").select(F.lit("union").alias("kind"), "key").unionByName(both)


# arrays

_W = {"all": "TRUE", "valid": "e > -0.2", "foreground": "e > 0", "strong": "e > 0.1"}
_BOX = "WITH b AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS data FROM embeddings)"


def _box(spark, d) -> DataFrame:
    mask = F.transform(
        "data",
        lambda e: F.when(e > -0.2, shoebox.VALID).otherwise(0).bitwiseOR(F.when(e > 0, shoebox.FOREGROUND).otherwise(shoebox.BACKGROUND | shoebox.BACKGROUND_USED)).bitwiseOR(F.when(e > 0.1, shoebox.STRONG).otherwise(0)),
    )
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("data"))
    return e.withColumn("mask", mask)


def _centroid_sql() -> str:
    cells = "(SELECT vec_id, unnest(data) AS e, unnest(range(len(data))) AS i FROM b)"
    parts = []
    for kind, test in _W.items():
        w = f"CASE WHEN {test} AND e > -0.05 THEN e + 0.05 ELSE 0 END"
        x, y = "(i % 8 + 0.5)", "(i // 8 + 0.5)"
        for axis, at in (("x", x), ("y", y)):
            mean = f"sum({w} * {at}) / sum({w})"
            parts.append(f"round({mean}, 7) AS {kind}_{axis}")
            parts.append(f"round(sum({w} * {at} * {at}) / sum({w}) - ({mean}) * ({mean}), 6) AS {kind}_var_{axis}")
    return f"{_BOX} SELECT vec_id, {', '.join(parts)} FROM {cells} GROUP BY vec_id"


@query(_centroid_sql())
def shoebox_centroids(spark, d):
    out = []
    background = F.transform("data", lambda _: F.lit(-0.05))
    for kind in _W:
        c = shoebox.centroid_of(kind, F.col("data"), F.col("mask"), F.lit(8), F.lit(8), background)
        for axis in "xy":
            out += [F.round(c[axis], 7).alias(f"{kind}_{axis}"), F.round(c[f"var_{axis}"], 6).alias(f"{kind}_var_{axis}")]
    return _box(spark, d).select("vec_id", *out)


@query(f"{_BOX}, s AS (SELECT vec_id, list_sum(list_filter(data, lambda e: e > 0)) AS t, len(list_filter(data, lambda e: e > 0)) AS f, coalesce(list_sum(list_filter(data, lambda e: e <= 0 AND e > -0.2)), 0) AS u, len(list_filter(data, lambda e: e <= 0 AND e > -0.2)) AS n, len(list_filter(data, lambda e: e > -0.2)) AS v, len(data) AS c FROM b) SELECT vec_id, round(t - 0.01 * f, 7) AS value, round(abs(t - 0.01 * f) + 0.01 * f * (1 + f / n), 7) AS variance, round(greatest(t - 0.01 * f, 0), 7) AS bayes, round(t + 1 + f / n * (0.01 * f + 1), 7) AS bayes_variance, round(u / n, 8) AS background, CAST(0.01 AS DOUBLE) AS modelled, v < c AS any, v < c AS invalid_background, FALSE AS invalid_foreground FROM s")
def shoebox_intensities(spark, d):
    background = F.transform("data", lambda _: F.lit(0.01))
    data, mask = F.col("data"), F.col("mask")
    total, bayes, bad = shoebox.summed_intensity(data, background, mask), shoebox.bayesian_intensity(data, background, mask), shoebox.invalid_flags(mask)
    return _box(spark, d).select(
        "vec_id", F.round(total["value"], 7).alias("value"), F.round(total["variance"], 7).alias("variance"), F.round(bayes["value"], 7).alias("bayes"), F.round(bayes["variance"], 7).alias("bayes_variance"),
        F.round(shoebox.mean_background(data, mask), 8).alias("background"), F.round(shoebox.mean_modelled_background(background, mask), 8).alias("modelled"),
        bad["any"].alias("any"), bad["background"].alias("invalid_background"), bad["foreground"].alias("invalid_foreground"),
    )


@query(f"{_BOX}, q AS (SELECT vec_id, data, list_sort(data) AS s, len(data) AS n, list_avg(data) AS m, list_stddev_pop(data) AS dev FROM b) SELECT vec_id, CAST(len(list_filter(data, lambda e: abs(e - m) <= 1.5 * dev)) AS INT) AS deviations, CAST(len(list_filter(data, lambda e: e >= s[CAST(floor(n * 0.1) AS INT) + 1] AND e <= s[n - CAST(floor(n * 0.2) AS INT)])) AS INT) AS quantiles, CAST(len(list_filter(data, lambda e: e >= quantile_1 - 0.2 * (quantile_3 - quantile_1) AND e <= quantile_3 + 0.2 * (quantile_3 - quantile_1))) AS INT) AS quartiles FROM (SELECT *, list_aggregate(data, 'quantile_cont', 0.25) AS quantile_1, list_aggregate(data, 'quantile_cont', 0.75) AS quantile_3 FROM q)")
def background_rejectors(spark, d):
    kept = {"deviations": shoebox.within_deviations(F.col("data"), 1.5), "quantiles": shoebox.within_quantiles(F.col("data"), 0.1, 0.2), "quartiles": shoebox.within_quartiles(F.col("data"), 0.2)}
    return _box(spark, d).select("vec_id", *(F.size(F.filter(k, lambda x: x)).alias(n) for n, k in kept.items()))


@query(f"{_BOX} SELECT vec_id, CAST(len(list_filter(range(len(data)), lambda i: data[i + 1] > -0.2 AND i % 3 <> 0)) AS INT) AS valid, CAST(len(list_filter(range(len(data)), lambda i: data[i + 1] > 0 AND i % 5 <> 0 AND i % 7 <> 0)) AS INT) AS foreground, CAST(len(list_filter(range(len(data)), lambda i: i % 7 = 0)) AS INT) AS overlapped FROM b")
def shoebox_masks(spark, d):
    places = F.sequence(F.lit(0), F.size("data") - 1)

    def not_every(n: int):
        return F.transform(places, lambda i: i % n != 0)

    third, fifth, seventh = not_every(3), not_every(5), not_every(7)
    mask = shoebox.with_static_mask(F.col("mask"), third)
    mask = shoebox.with_background_mask(mask, F.transform(fifth, lambda x: ~x))
    mask = shoebox.mask_neighbours(mask, F.transform(seventh, lambda x: ~x))
    out = _box(spark, d).withColumn("m", mask)
    return out.select("vec_id", *(shoebox.count_mask(F.col("m"), c).alias(n) for n, c in (("valid", shoebox.VALID), ("foreground", shoebox.FOREGROUND), ("overlapped", shoebox.OVERLAPPED))))


# robust fits: no SQL, tested against brute force


@query()
def mahalanobis_outliers(spark, d):
    rows = measurements(spark, d).select("id", "panel", "row_id", (F.col("d") - 3).alias("a"), F.ln("intensity").alias("b"))
    return residuals.mahalanobis_outliers(rows, ["id", "panel"], ["a", "b"], 9.0, "row_id").select("row_id", "outlier")


@query()
def binned_mixtures(spark, d):
    return residuals.fit_mixture(measurements(spark, d).withColumn("log", F.ln("intensity")), "panel", "log")


@query()
def brightest_rejected(spark, d):
    rows = measurements(spark, d).select("z", "row_id", "intensity")
    return residuals.reject_brightest(rows, "z", "intensity", "row_id", 0.1)


# rows and columns one by one, and small filters


@query(f"{M}, o AS (SELECT row_id, d * 2 AS d, 7 AS panel FROM m WHERE key % 3 = 0) SELECT m.row_id, coalesce(o.panel, m.panel) AS panel, coalesce(o.d, m.d) AS d, m.x FROM m LEFT JOIN o USING (row_id)")
def set_selected_rows(spark, d):
    m = measurements(spark, d).select("row_id", "panel", "d", "x", "key")
    other = m.where("key % 3 = 0").select("row_id", (F.col("d") * 2).alias("d"), F.lit(7).alias("panel"))
    return table.set_selected_rows(m.drop("key"), other, "row_id")


@query("SELECT o_orderkey AS row_id, o_totalprice * 2 AS a, o_custkey AS c, o_orderkey + o_custkey AS s FROM orders")
def set_selected_columns(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("c"))
    other = o.select("row_id", (F.col("a") * 2).alias("a"), (F.col("row_id") + F.col("c")).alias("s"))
    return table.set_selected_columns(o, other, ["a", "s"], "row_id")


@query("WITH o AS (SELECT o_orderkey AS row_id, o_totalprice AS a FROM orders), i AS (SELECT CASE WHEN row_id >= 100 THEN row_id + 3 ELSE row_id END AS row_id, a FROM o UNION ALL SELECT 100 + range, 0 FROM range(3)) SELECT row_id, CASE WHEN row_id = 7 THEN 1.5 ELSE a END AS a FROM i WHERE row_id <> 9 AND NOT (row_id >= 20 AND row_id < 40 AND (row_id - 20) % 4 = 0)")
def row_edits(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("a"))
    out = table.insert_rows(o, spark.range(3).withColumnRenamed("id", "row_id"), "row_id", 100)
    return table.delete_slice(table.delete_row(table.set_row(out, "row_id", 7, {"a": 1.5}), "row_id", 9), "row_id", 20, 40, 4)


@query("WITH o AS (SELECT o_orderkey AS row_id, o_totalprice AS a FROM orders) SELECT row_id * 7 % 1000003 AS row_id, a FROM o")
def reorder_rows(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("a"))
    return table.reordered(o, o.select((F.col("row_id") * 7 % 1000003).alias("pos"), F.col("row_id").alias("row")), "row_id")


@query(f"{M}, b AS (SELECT panel, avg(intensity) AS mean FROM m GROUP BY panel) SELECT row_id FROM m JOIN b USING (panel) WHERE intensity / mean * 10 > CASE WHEN key % 2 = 0 THEN 23.91 ELSE 13.82 END")
def wilson_cut(spark, d):
    rows = reports.normalised_squares(measurements(spark, d).select("row_id", "panel", "key", "intensity"), "panel", "intensity")
    return rows.where(outliers.wilson_cut(F.col("e_squared") * 10, F.col("key") % 2 == 0)).select("row_id")


@query(f"{M}, g AS (SELECT (h, k, l) >= (-h, -k, -l) AS p, greatest((h, k, l), (-h, -k, -l)) AS q, intensity FROM m), f AS (SELECT avg(intensity) FILTER (p) AS plus, avg(intensity) FILTER (NOT p) AS minus FROM g GROUP BY q) SELECT count(*) AS n, round(avg(abs(plus - minus)) / 50, 6) AS dano_over_sigma FROM f WHERE plus IS NOT NULL AND minus IS NOT NULL")
def anomalous_signal(spark, d):
    pairs = joins.mates(measurements(spark, d), ["h", "k", "l"], "intensity")
    return reports.anomalous_signal(pairs, 50.0).withColumn("dano_over_sigma", F.round("dano_over_sigma", 6))


@query(f"{M} SELECT row_id FROM m WHERE NOT (z BETWEEN 100 AND 2000 AND (z - 100) % 25 = 0)")
def exclude_every_nth(spark, d):
    images = reports.expanded_multiples(100, 2000, 25, spark).withColumnRenamed("image", "z")
    return measurements(spark, d).select("row_id", "z").join(F.broadcast(images), "z", "left_anti").select("row_id")  # of one scan


@query(f"{M} SELECT row_id, CAST(range_id AS INT) AS block FROM (SELECT row_id, z, unnest(range(7)) AS range_id FROM m) WHERE z >= 50 + 2000 * range_id // 7 AND z < 50 + 2000 * (range_id + 1) // 7")
def scan_blocks(spark, d):
    blocks = [(k, a, b) for k, (a, b) in enumerate(reports.block_ranges(50, 2050, 7))]
    m = measurements(spark, d).select("row_id", "z")
    met = m.join(F.broadcast(spark.createDataFrame(blocks, "block int, lo int, hi int")), (F.col("z") >= F.col("lo")) & (F.col("z") < F.col("hi")))  # a row per block
    return met.select("row_id", "block")


@query(f"{M}, g AS (SELECT key, count(*) AS n, sum(1 / variance) AS w, sum(intensity / variance) AS x, sum(intensity * intensity / variance) AS xx FROM m GROUP BY key) SELECT key, round(x / w, 3) AS merged, round(CASE WHEN n > 1 THEN greatest(1 / w, (xx / w - x / w * (x / w)) / (n - 1)) ELSE 1 / w END, 1) AS merged_var, n FROM g")
def merge_internal_variance(spark, d):
    out = scaling.merged(measurements(spark, d), ["key"], "intensity", "variance", internal=True)
    return out.withColumns({"merged": F.round("merged", 3), "merged_var": F.round("merged_var", 1)})


@query()
def scale_datasets(spark, d):
    m = measurements(spark, d)
    graph.checkpoint_dir(m)
    return scaling.scale_datasets(m, ["key"], "id", "intensity", "variance", rounds=4)


@query()
def error_model_fit(spark, d):
    a, b = scaling.fit_error_model(scaling.error_deviations(measurements(spark, d), ["key"], "intensity", "variance"))
    return spark.createDataFrame([(a, b)], "a double, b double")


@query()
def posterior_moments(spark, d):
    rows = measurements(spark, d).select("row_id", "panel", (F.col("intensity") - 3000).alias("v"), (F.col("variance") * 1000).alias("s"))
    return scaling.posterior_moments(rows, "panel", "v", "s").select("row_id", "intensity", "amplitude")
