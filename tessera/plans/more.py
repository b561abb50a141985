"""Further registered queries: export, datasets, statistics of merged data."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.flags import FlagExpression
from tessera.operators import datasets, export, groups, statistics, table
from tessera.plans.queries import REGISTRY, M, measurements, query

# export

EXTRA = {
    "prf_value": "intensity * 1.01",
    "prf_variance": "variance - 3",
    "sum_value": "intensity",
    "sum_variance": "variance - 2",
    "scale_value": "intensity * 0.98",
    "scale_variance": "variance",
    "inverse_scale_factor": "scale - 1.01",
    "lp": "1 + CAST(x AS DOUBLE) / 100",
    "qe": "partiality - 0.905",
    "partial_id": "key",
    "state": "flags + CASE WHEN x = 7 THEN 8388608 ELSE 0 END + CASE WHEN z % 10 = 3 THEN 8192 ELSE 0 END",
}
E = f"{M}, e AS (SELECT * EXCLUDE (flags, state), state AS flags FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in EXTRA.items())} FROM m))"
OPTIONS = {"min_i_over_sigma": 100.0, "rings": True, "partiality": 0.95, "d_min": 1.5, "d_max": 5.5}


def integrated(spark, d: str) -> DataFrame:
    """Measurements with intensities of each kind and what corrects them."""
    rows = measurements(spark, d).selectExpr("*", *(f"{v} AS {k}" for k, v in EXTRA.items()))
    return rows.drop("flags").withColumnRenamed("state", "flags")


def _export_sql(choice: str) -> str:
    kinds = export.CHOICES[choice]
    where = {"sum": "(flags & 256) = 256", "prf": "(flags & 512) = 512", "scale": "(flags & 29360128) = 0 AND NOT inverse_scale_factor <= 0"}
    picked = "(flags & 768) <> 0" if choice == "sum|prf" else " AND ".join(where[k] for k in kinds)
    bits = {"sum": "AND (flags & 256) = 256", "prf": "AND (flags & 512) = 512", "scale": ""}
    good = " AND ".join(f"NOT ({k}_variance <= 0 {bits[k]})" for k in kinds)
    factor = {"sum": "lp / qe / partiality", "prf": "lp / qe", "scale": "1 / inverse_scale_factor"}
    qe = "AND qe > 0" if set(kinds) & {"sum", "prf"} else ""
    values = ", ".join(f"{k}_value * ({factor[k]}) AS {k}_value, {k}_variance * ({factor[k]}) * ({factor[k]}) AS {k}_variance" for k in kinds)
    part = " AND ".join(["partiality < 0.99", *(f"{k}_variance > 0" for k in kinds)])
    w = "prf_value * prf_value / prf_variance"
    sums = {
        "sum": "sum(sum_value) AS sum_value, sum(sum_variance) AS sum_variance",
        "scale": "sum(scale_value / scale_variance) / sum(1 / scale_variance) AS scale_value, 1 / sum(1 / scale_variance) AS scale_variance",
        "prf": f"sum({w} * prf_value) / sum({w}) AS prf_value, sum({w} * prf_variance) / sum({w}) AS prf_variance",
    }
    names = ", ".join(f"{k}_value, {k}_variance" for k in kinds)
    strong = " AND ".join(f"NOT {k}_value / sqrt({k}_variance) < 100" for k in kinds)
    out = ", ".join(f"round({k}_value, 5) AS {k}_value, round({k}_variance, 5) AS {k}_variance" for k in kinds)
    return (
        f"{E}, f AS (SELECT * FROM e WHERE id >= 0 AND {picked} AND {good} AND (flags & 8192) = 0 AND NOT d <= 1.5 AND NOT d >= 5.5), "
        f"c AS (SELECT row_id, id, partial_id, partiality, {values} FROM f WHERE partiality > 0 {qe}), "
        f"u AS (SELECT row_id, partiality, {names} FROM c WHERE NOT ({part}) UNION ALL "
        f"SELECT min(row_id), sum(partiality), {', '.join(sums[k] for k in kinds)} FROM c WHERE {part} GROUP BY id, partial_id) "
        f"SELECT row_id, round(partiality, 6) AS fractioncalc, {out} FROM u WHERE NOT partiality < 0.95 AND {strong}"
    )


def _export(spark, d, choice: str) -> DataFrame:
    kinds = export.CHOICES[choice]
    out = export.filter_for_export(integrated(spark, d), choice, **OPTIONS)
    values = [F.round(f(k), 5).alias(f(k)) for k in kinds for f in (export.value_of, export.variance_of)]
    return out.select("row_id", F.round("fractioncalc", 6).alias("fractioncalc"), *values)


for _choice in export.CHOICES:
    _name = "export_" + _choice.replace("+", "_and_").replace("|", "_or_")
    REGISTRY[_name] = (partial(_export, choice=_choice), _export_sql(_choice))


@query(f"{E}, k AS (SELECT row_id FROM e WHERE id >= 0 AND (flags & 512) = 512 AND NOT prf_variance <= 0 AND (flags & 8192) = 0 AND partiality > 0 AND qe > 0 AND NOT partiality < 0.95) SELECT row_id, row_id IN (SELECT row_id FROM k) AS kept FROM e")
def export_mask(spark, d):
    return export.export_mask(integrated(spark, d), "prf", rings=True, partiality=0.95, combine_partials=False)


@query(f"{M} SELECT row_id FROM m WHERE " + " OR ".join(f"(1 / (d * d) >= {a} AND 1 / (d * d) <= {b})" for a, b in export.ICE_RINGS))
def ice_rings(spark, d):
    return measurements(spark, d).where(export.in_ice_ring(F.col("d"))).select("row_id")


@query(f"{E} SELECT row_id FROM e WHERE sum_variance > 0 AND sum_value / sqrt(sum_variance) >= 9000 AND (flags & 768) <> 0 AND panel <> 3")
def comparison_selector(spark, d):
    rows = export.select_where(integrated(spark, d), "sum.i_over_sigma >= 9000")
    return export.select_where(export.select_where(rows, "flags & 768"), "panel != 3").select("row_id")


@query(f"{E}, i AS (SELECT DISTINCT h, k, l FROM m WHERE id = 0 AND x < 10) SELECT row_id FROM e JOIN i USING (h, k, l) WHERE (flags & 256) = 256 AND id IN (1, 2, 3) AND panel IN (1, 2, 4) AND d >= 1.4 AND d <= 5.2 AND partiality >= 0.92 AND partiality <= 0.99 AND sum_variance > 0 AND NOT (" + " OR ".join(f"(1 / (d * d) >= {a} AND 1 / (d * d) <= {b})" for a, b in export.ICE_RINGS) + ")")
def filter_program(spark, d):
    m = integrated(spark, d)
    known = measurements(spark, d).where("id = 0 AND x < 10")
    flags = FlagExpression("integrated_sum").column(F.col("flags"))
    out = export.filter_rows(
        m, flags=flags, ids=[1, 2, 3], panels=[1, 2, 4], d_min=1.4, d_max=5.2, partiality_min=0.92, partiality_max=0.99, good="sum", indices=known, index=["h", "k", "l"], ice=True
    )
    return out.select("row_id")


# datasets

IDS = "n AS (SELECT CAST(range AS INT) AS id, CASE WHEN range = 4 THEN '' ELSE concat('d', CAST(range * 7 % 10 AS VARCHAR)) END AS identifier FROM range(10))"


def _datasets(spark, d) -> datasets.Datasets:
    name = F.when(F.col("id") == 4, "").otherwise(F.concat(F.lit("d"), (F.col("id") * 7 % 10).cast("string")))
    ids = spark.range(10).select(F.col("id").cast("int").alias("id"), name.alias("identifier"))
    return datasets.Datasets(measurements(spark, d).select("row_id", "id", "intensity", "variance", "panel", "z"), ids)


@query(f"{M}, {IDS} SELECT row_id, id, identifier FROM m JOIN n USING (id) WHERE identifier IN ('d1', 'd7', 'd4')")
def select_on_identifiers(spark, d):
    got = _datasets(spark, d).select_identifiers(["d1", "d7", "d4", "unknown"])
    return got.rows.join(got.ids, "id").select("row_id", "id", "identifier")


@query(f"{M}, {IDS} SELECT row_id, id FROM m JOIN n USING (id) WHERE identifier NOT IN ('d1', 'd7', 'd4')")
def remove_on_identifiers(spark, d):
    got = _datasets(spark, d).remove_identifiers(["d1", "d7", "d4"])
    return got.rows.join(got.ids, "id", "left_semi").select("row_id", "id")


@query(f"{M}, {IDS} SELECT row_id, CAST(id // 3 AS INT) AS id, identifier FROM m JOIN n USING (id) WHERE id IN (0, 3, 6, 9)")
def reset_dataset_ids(spark, d):
    got = _datasets(spark, d).choose_ids(use=[0, 3, 6, 9]).reset_ids()
    return got.rows.join(got.ids, "id").select("row_id", "id", "identifier")


@query(f"{M}, {IDS} SELECT id, CASE WHEN identifier = '' THEN md5(concat('5:', CAST(id AS VARCHAR))) ELSE identifier END AS identifier FROM n")
def assign_identifiers(spark, d):
    return _datasets(spark, d).assign_identifiers(seed=5).ids


@query(f"{M}, {IDS} SELECT 'rows without a dataset' AS fault, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM n WHERE id <> 8) UNION ALL SELECT 'identifier of two ids', 1")
def identifier_faults(spark, d):
    s = _datasets(spark, d)
    ids = s.ids.where("id <> 8").withColumn("identifier", F.when(F.col("id") == 3, "d7").otherwise(F.col("identifier")))
    return datasets.Datasets(s.rows, ids).faults()


@query(f"{M}, {IDS} SELECT row_id, CAST(CASE WHEN panel = 1 THEN id ELSE 10 + id - 5 END AS INT) AS id FROM m WHERE panel = 1 OR (panel = 2 AND id >= 5)")
def combine_datasets(spark, d):
    s = _datasets(spark, d)
    out = datasets.combine([datasets.Datasets(s.rows.where("panel = 1"), s.ids), datasets.Datasets(s.rows.where("panel = 2 AND id >= 5"), s.ids.where("id >= 5"))])
    return out.rows.select("row_id", "id")


@query(f"{M}, s AS (SELECT id, list(row_id ORDER BY row_id) AS rows FROM m WHERE id <> 2 GROUP BY id), g AS (SELECT CAST(range AS INT) AS id FROM range(12)) SELECT id, md5(coalesce(array_to_string(rows, ','), '')) AS rows, coalesce(len(rows), 0) AS n FROM g LEFT JOIN s USING (id)")
def indices_by_dataset(spark, d):
    s = _datasets(spark, d)
    out = s.select(F.col("id") != 2).indices_by_id(12)
    text = F.concat_ws(",", F.transform("rows", lambda r: r.cast("string")))
    return out.select("id", F.md5(text).alias("rows"), F.size("rows").cast("long").alias("n"))


@query(f"{M}, b AS (SELECT id FROM m GROUP BY id ORDER BY avg(intensity / sqrt(variance)) DESC, id LIMIT 4) SELECT id, count(*) AS n FROM m WHERE id IN (SELECT id FROM b) GROUP BY id")
def top_datasets_by_significance(spark, d):
    return _datasets(spark, d).top_by_significance(4, F.col("intensity") / F.sqrt("variance")).rows.groupBy("id").agg(F.count("*").alias("n"))


@query(f"{M}, b AS (SELECT range AS id FROM range(10) ORDER BY md5(concat('3:', CAST(range AS VARCHAR))), range LIMIT 4) SELECT id, count(*) AS n FROM m WHERE id IN (SELECT id FROM b) GROUP BY id")
def random_datasets(spark, d):
    return _datasets(spark, d).random(4, seed=3).rows.groupBy("id").agg(F.count("*").alias("n"))


@query(f"{M}, f AS (SELECT id * 3 % 7 AS s, min(row_id) AS first FROM m GROUP BY 1), r AS (SELECT s, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INT) AS imageset_id FROM f) SELECT row_id, imageset_id FROM m JOIN r ON m.id * 3 % 7 = r.s")
def image_sets(spark, d):
    rows = measurements(spark, d).select("row_id", (F.col("id") * 3 % 7).alias("s"))
    return datasets.image_set_ids(rows, "s").select("row_id", "imageset_id")


@query(f"{M}, b AS (SELECT range AS job, 500 + range * 80 AS lo, least(500 + range * 80 + 100, 2000) AS hi FROM range(19)) SELECT row_id, CAST(job AS INT) AS job FROM m JOIN b ON z < hi AND z + 3 > lo")
def split_over_jobs(spark, d):
    rows = measurements(spark, d).select("row_id", F.col("z").alias("z0"), (F.col("z") + 3).alias("z1"))
    return datasets.split_over_blocks(rows, 500, 2000, 100, 20).select("row_id", "job")


@query(f"{M} SELECT CAST(floor(id / 4) AS INT) AS chunk, CAST(z % 6 AS INT) AS grp, count(*) AS n FROM m GROUP BY ALL")
def chunks_and_repeats(spark, d):
    m = measurements(spark, d)
    return m.groupBy(datasets.chunk_of(4).alias("chunk"), datasets.repeat_groups(F.col("z"), 6).alias("grp")).agg(F.count("*").alias("n"))


@query(f"{M}, b AS (SELECT DISTINCT z * 3 AS batch FROM m WHERE z % 4 = 1) SELECT batch, CAST(row_number() OVER (ORDER BY batch) - 1 AS INT) AS new FROM b")
def gap_free_batches(spark, d):
    return datasets.gap_free(measurements(spark, d).where("z % 4 = 1").select((F.col("z") * 3).alias("batch")), "batch")


@query(f"{M} SELECT row_id FROM m WHERE NOT ((id = 1 AND z >= 99 AND z <= 900) OR (id = 4 AND z >= 1999 AND z <= 3000))")
def excluded_images(spark, d):
    ranges = spark.createDataFrame(datasets.parse_excluded(["1:100:900", "4:2000:2500,4:2501:3000"]), "id int, lo int, hi int")
    m = measurements(spark, d).select("row_id", "id", "z")
    return m.join(table.in_ranges(m, ranges, "z", "valid").select("row_id"), "row_id", "left_anti").select("row_id")


@query(f"{M}, p AS (SELECT CAST(range AS INT) AS id, 100 * range AS first, 100 * range + 2000 AS last, 2000 * range AS before FROM range(10)), r AS (SELECT row_id, first, before, unnest(range(greatest(z, first), least(z + 2, last))) AS point FROM m JOIN p USING (id)) SELECT row_id, CAST(before + point - first AS INT) AS id, CAST(point AS INT) AS point FROM r")
def sequence_to_stills(spark, d):
    rows = measurements(spark, d).select("row_id", "id", F.col("z").alias("z0"), (F.col("z") + 2).alias("z1"))
    points = spark.range(10).selectExpr("CAST(id AS INT) AS id", "100 * id AS first", "100 * id + 2000 AS last")
    return datasets.stills_of_sequence(rows, points).select("row_id", "id", "point")


@query(f"{M} SELECT row_id, id FROM m WHERE id >= 0 AND row_id IS NOT NULL AND panel IN (1, 2)")
def split_by_dataset(spark, d):
    s = _datasets(spark, d).select(F.col("panel").isin(1, 2))
    return s.by_dataset(lambda f: f[["row_id", "id"]], "row_id long, id int")


# statistics

BIN = "CAST(key % 5 AS INT)"


def _loo_sql(group: str, digits: int = 5) -> str:
    """Leave one group out by brute force: every group against all rows but its own."""
    return (
        f"{M}, b AS (SELECT key, {BIN} AS bin, intensity, {group} AS g FROM m), ds AS (SELECT DISTINCT g FROM b), "
        "k AS (SELECT ds.g, bin, key, avg(intensity) AS mean, var_samp(intensity) / count(*) AS v FROM ds JOIN b ON b.g <> ds.g GROUP BY ds.g, bin, key HAVING count(*) > 1), "
        "c AS (SELECT g, bin, count(*) AS n, var_samp(mean) AS s, avg(v) AS e FROM k GROUP BY g, bin HAVING count(*) > 1), "
        "w AS (SELECT g, sum(n * (s - e) / (s + e)) / sum(n) AS cc FROM c GROUP BY g), "
        "ka AS (SELECT bin, key, avg(intensity) AS mean, var_samp(intensity) / count(*) AS v FROM b GROUP BY bin, key HAVING count(*) > 1), "
        "ca AS (SELECT bin, count(*) AS n, var_samp(mean) AS s, avg(v) AS e FROM ka GROUP BY bin HAVING count(*) > 1), "
        "a AS (SELECT sum(n * (s - e) / (s + e)) / sum(n) AS cc FROM ca), "
        "r AS (SELECT g, w.cc AS cc_without, a.cc - w.cc AS delta FROM w, a) "
    )


def _deltas(spark, d, group):
    m = measurements(spark, d).withColumns({"bin": (F.col("key") % 5).cast("int"), "g": group})
    return statistics.delta_cc_half_binned(m, ["key"], "g", "bin", "intensity", 5)


@query(_loo_sql("id") + "SELECT g, round(cc_without, 5) AS cc_without, round(delta, 5) AS delta FROM r")
def delta_cc_half_binned(spark, d):
    return _deltas(spark, d, F.col("id")).select("g", F.round("cc_without", 5).alias("cc_without"), F.round("delta", 5).alias("delta"))


@query(_loo_sql("concat_ws(':', CAST(id AS VARCHAR), CAST(floor(z / 1300) AS INT))") + "SELECT g, round(delta, 5) AS delta, delta < (SELECT avg(delta) - 1.0 * stddev_pop(delta) FROM r) AS removed FROM r")
def delta_cc_half_image_groups(spark, d):
    out = statistics.below_cutoff(_deltas(spark, d, statistics.image_groups(F.col("id"), F.col("z"), 1300)), 1.0)
    return out.select("g", F.round("delta", 5).alias("delta"), "removed")


def _tau_sql(w: str) -> str:
    return (
        f"{M}, g AS (SELECT {BIN} AS bin, key, count(*) AS n, sum({w}) AS w, sum({w} * {w}) AS ww, sum({w} * intensity) AS x, sum({w} * intensity * intensity) AS xx FROM m GROUP BY ALL), "
        "t AS (SELECT bin, x / w AS mean, CASE WHEN n > 1 AND w * w / ww > 1 THEN 2 / (w * w / ww - 1) * (xx / w - x / w * (x / w)) END AS e FROM g), "
        "s AS (SELECT bin, count(e) AS n, avg(e) AS e, var_samp(mean) AS y FROM t GROUP BY bin) SELECT bin, n, round((y - e / 2) / (y + e / 2), 6) AS cc_half FROM s"
    )


def _tau(spark, d, variance):
    m = measurements(spark, d).withColumn("bin", (F.col("key") % 5).cast("int"))
    return statistics.cc_half_sigma_tau(m, ["key"], "bin", "intensity", variance).withColumn("cc_half", F.round("cc_half", 6))


@query(_tau_sql("1.0"))
def cc_half_sigma_tau(spark, d):
    return _tau(spark, d, None)


@query(_tau_sql("(1 / variance)"))
def cc_half_sigma_tau_weighted(spark, d):
    return _tau(spark, d, "variance")


HALVES = (
    f"{M}, k AS (SELECT key, intensity, 1 / variance AS w, row_number() OVER (PARTITION BY key ORDER BY md5(concat('1:', CAST(row_id AS VARCHAR))), row_id) AS r, count(*) OVER (PARTITION BY key) AS n, "
    "CASE WHEN substr(md5(concat('1:', CAST(key AS VARCHAR))), 1, 1) < '8' THEN 1 ELSE 0 END AS coin FROM m), "
    "h AS (SELECT key, sum(intensity * w) FILTER (r <= floor((n + coin) / 2)) / sum(w) FILTER (r <= floor((n + coin) / 2)) AS a, 1 / sum(w) FILTER (r <= floor((n + coin) / 2)) AS va, "
    "sum(intensity * w) FILTER (r > floor((n + coin) / 2)) / sum(w) FILTER (r > floor((n + coin) / 2)) AS b, 1 / sum(w) FILTER (r > floor((n + coin) / 2)) AS vb FROM k WHERE n > 1 GROUP BY key)"
)


def _halves(spark, d):
    return statistics.halves_by_hash(measurements(spark, d), ["key"], "intensity", "variance", ["row_id"], seed=1)


@query(f"{HALVES} SELECT round(sum(abs(a - b)) / sqrt(2) / (sum(a + b) / 2), 8) AS r_split, round((SELECT sum(abs(a - b) / (va + vb)) / sqrt(2) / (sum((a + b) / (va + vb)) / 2) FROM h), 8) AS weighted FROM h")
def half_set_r_split(spark, d):
    h = _halves(spark, d)
    return groups.r_split(h).select(F.round("r_split", 8).alias("r_split")).join(statistics.weighted_r_split(h).select(F.round("r_split", 8).alias("weighted")))  # a row each


@query(f"{HALVES}, v AS (SELECT unnest([va, vb]) AS v FROM h), f AS (SELECT 0.01 * median(v) AS f FROM v), w AS (SELECT key % 5 AS bin, a, b, 1 / (va + vb + f) AS w FROM h, f), s AS (SELECT sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM w) SELECT round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb))), 7) AS cc, round(sum(w) * sum(w) / sum(w * w), 3) AS n_eff FROM w, s")
def weighted_cc_half(spark, d):
    return statistics.weighted_correlation(_halves(spark, d), floor=0.01).select(F.round("cc", 7).alias("cc"), F.round("n_eff", 3).alias("n_eff"))


MATES = (
    f"{M}, k AS (SELECT h, k, l, intensity, 1 / variance AS w, row_number() OVER (PARTITION BY h, k, l ORDER BY md5(concat('1:', CAST(row_id AS VARCHAR))), row_id) AS r, count(*) OVER (PARTITION BY h, k, l) AS n, "
    "CASE WHEN substr(md5(concat_ws(':', '1', CAST(h AS VARCHAR), CAST(k AS VARCHAR), CAST(l AS VARCHAR))), 1, 1) < '8' THEN 1 ELSE 0 END AS coin FROM m), "
    "s AS (SELECT h, k, l, sum(intensity * w) FILTER (r <= floor((n + coin) / 2)) / sum(w) FILTER (r <= floor((n + coin) / 2)) AS a, 1 / sum(w) FILTER (r <= floor((n + coin) / 2)) AS va, "
    "sum(intensity * w) FILTER (r > floor((n + coin) / 2)) / sum(w) FILTER (r > floor((n + coin) / 2)) AS b, 1 / sum(w) FILTER (r > floor((n + coin) / 2)) AS vb FROM k WHERE n > 1 GROUP BY h, k, l), "
    "p AS (SELECT x.a - y.a AS a, x.b - y.b AS b, x.va + y.va AS va, x.vb + y.vb AS vb FROM s x JOIN s y ON x.h = -y.h AND x.k = -y.k AND x.l = -y.l AND (x.h, x.k, x.l) > (y.h, y.k, y.l))"
)


@query(f"{MATES}, w AS (SELECT a, b, 1 / (va + vb) AS w FROM p), t AS (SELECT sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM w) SELECT CASE WHEN count(*) > 1 THEN round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb))), 6) END AS cc, CASE WHEN count(*) > 1 THEN round(sum(w) * sum(w) / sum(w * w), 3) ELSE CAST(count(*) AS DOUBLE) END AS n_eff FROM w, t")
def anomalous_cc_half(spark, d):
    h = statistics.halves_by_hash(measurements(spark, d), ["h", "k", "l"], "intensity", "variance", ["row_id"], seed=1)
    out = statistics.weighted_correlation(statistics.anomalous_halves(h, ["h", "k", "l"]))
    return out.select(F.round("cc", 6).alias("cc"), F.round("n_eff", 3).alias("n_eff"))


@query(f"{M}, o AS (SELECT panel, key, intensity, variance, abs(intensity - avg(intensity) OVER w) AS off, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY panel, key)), g AS (SELECT panel, key, count(*) AS n, sum(CASE WHEN c > 1 THEN intensity END) AS im, sum(CASE WHEN c > 1 THEN off END) AS a, sum(intensity / variance) / sqrt(sum(1 / variance)) AS ios FROM o GROUP BY panel, key), s AS (SELECT panel, CAST(sum(n) AS DOUBLE) AS n_obs, CAST(count(*) AS DOUBLE) AS n_unique, round(avg(ios), 3) AS i_over_sigma, round(sum(a) / sum(im), 6) AS r_merge FROM g GROUP BY ROLLUP (panel)), l AS (UNPIVOT s ON n_obs, n_unique, i_over_sigma, r_merge INTO NAME statistic VALUE v) SELECT statistic, max(v) FILTER (panel IS NULL) AS overall, max(v) FILTER (panel = 1) AS low, max(v) FILTER (panel = 4) AS high FROM l GROUP BY statistic")
def table_one(spark, d):
    s = groups.merging_statistics(measurements(spark, d), ["key"], "panel", "intensity", "variance")
    s = s.select("panel", "n_obs", "n_unique", F.round("i_over_sigma", 3).alias("i_over_sigma"), F.round("r_merge", 6).alias("r_merge"))
    return statistics.table_one(s, "panel", 1, 4)


@query(f"{M} SELECT z % 50 AS batch, round(avg(CASE WHEN variance > 5 THEN intensity / sqrt(variance - 5) END), 4) AS i_over_sigma, round(avg(scale), 6) AS scale FROM m GROUP BY 1")
def per_batch_means(spark, d):
    m = measurements(spark, d).withColumns({"batch": F.col("z") % 50, "v": F.col("variance") - 5})
    return statistics.per_batch(m, "batch", "intensity", "v", "scale").select("batch", F.round("i_over_sigma", 4).alias("i_over_sigma"), F.round("scale", 6).alias("scale"))


_PAIRS = f"{M}, p AS (SELECT greatest(a.z % 100, b.z % 100) AS dose, abs(a.z % 100 - b.z % 100) AS gap, abs(a.intensity - b.intensity) AS diff, abs(a.intensity + b.intensity) / 2 AS half, a.intensity / sqrt(a.variance) + b.intensity / sqrt(b.variance) AS ios FROM m a JOIN m b ON a.key = b.key AND a.row_id < b.row_id)"


def _pairs(spark, d, by):
    return statistics.pair_sums(measurements(spark, d).withColumn("dose", F.col("z") % 100), ["key"], "dose", "intensity", "variance", "row_id", by)


@query(f"{_PAIRS}, g AS (SELECT dose, sum(diff) AS a, sum(half) AS s, sum(ios) AS i, 2 * count(*) AS n FROM p GROUP BY dose), c AS (SELECT dose, sum(a) OVER w AS a, sum(s) OVER w AS s, sum(i) OVER w AS i, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY dose)) SELECT dose, round(a / s, 6) AS rcp, round(CASE WHEN n > 100 THEN a / s / (1.1284 / (i / n)) ELSE 0 END, 2) AS scp FROM c")
def rcp(spark, d):
    out = statistics.cumulative_r(_pairs(spark, d, "dose"))
    return out.select("dose", F.round("rcp", 6).alias("rcp"), F.round("scp", 2).alias("scp"))


@query(f"{_PAIRS} SELECT gap, round(sum(diff) / sum(half), 6) AS rd FROM p GROUP BY gap")
def rd(spark, d):
    return _pairs(spark, d, "gap").select("gap", F.round(F.col("diff") / F.col("half_sum"), 6).alias("rd"))


@query(f"{M}, c AS (SELECT greatest((h, k, l), (-h, -k, -l)) AS q, (h, k, l) >= (-h, -k, -l) AS plus, z FROM m), f AS (SELECT q, min(z) AS a, min(z) FILTER (plus) AS p, min(z) FILTER (NOT plus) AS m FROM c GROUP BY q), e AS (SELECT unnest([a, p, m, CASE WHEN p IS NOT NULL AND m IS NOT NULL THEN greatest(p, m) END]) AS dose, unnest([1, 2, 3, 4]) AS kind FROM f), g AS (SELECT dose, count(*) FILTER (kind = 1) AS a, count(*) FILTER (kind = 2) AS p, count(*) FILTER (kind = 3) AS m, count(*) FILTER (kind = 4) AS b FROM e WHERE dose IS NOT NULL GROUP BY dose) SELECT dose, CAST(sum(a) OVER w AS BIGINT) AS seen, CAST(sum(p) OVER w AS BIGINT) AS seen_plus, CAST(sum(m) OVER w AS BIGINT) AS seen_minus, CAST(sum(b) OVER w AS BIGINT) AS both, round(sum(a) OVER w / 501, 6) AS completeness FROM g WINDOW w AS (ORDER BY dose)")
def dose_completeness_by_sign(spark, d):
    out = statistics.completeness_by_sign(measurements(spark, d), ["h", "k", "l"], "z", 501)
    return out.withColumn("completeness", F.round("completeness", 6))


@query(f"{M}, v AS (SELECT DISTINCT intensity AS v FROM m), g AS (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM v) SELECT round(min(g), 6) AS step FROM g")
def dose_step(spark, d):
    return statistics.dose_step(measurements(spark, d), "intensity").select(F.round("step", 6).alias("step"))


@query(f"{M} SELECT row_id, round(CASE WHEN z <= 1000 THEN (z + 1) * 0.5 ELSE 10 + (z - 1500 + 1) * 0.5 END, 4) AS dose FROM m WHERE z <= 1000 OR z BETWEEN 1500 AND 3000")
def batches_to_dose(spark, d):
    offsets = spark.createDataFrame([(0, 1000, 0.0), (1500, 3000, 10.0)], "first int, last int, start double")
    return statistics.batches_to_dose(measurements(spark, d).select("row_id", "z"), "z", offsets, 0.5).select("row_id", F.round("dose", 4).alias("dose"))


@query(f"{M} SELECT l % 2 = 0 AS present, count(*) AS n, round(avg(intensity), 4) AS i, round(avg(intensity / sqrt(variance)), 4) AS i_over_sigma FROM m WHERE h = 0 AND k = 0 AND l <> 0 GROUP BY 1")
def axial_absences(spark, d):
    out = statistics.axial_absences(measurements(spark, d), 2, 2, ["h", "k", "l"], "intensity", "variance")
    return out.withColumns({c: F.round(c, 4) for c in ("i", "i_over_sigma")})


@query(f"{M}, g AS (SELECT row_id, count(*) OVER w AS n, (intensity - sum(intensity / (variance - 5)) OVER w / sum(1 / (variance - 5)) OVER w) / sqrt(variance - 5) AS z FROM m WHERE variance > 5 AND intensity > 0 WINDOW w AS (PARTITION BY key)) SELECT row_id, n, round(z, 3) AS z FROM g")
def z_scores(spark, d):
    m = measurements(spark, d).select("row_id", "key", "intensity", (F.col("variance") - 5).alias("v"))
    return statistics.z_scores(m, ["key"], "intensity", "v").select("row_id", "n", F.round("z", 3).alias("z"))


@query(f"{M}, g AS (SELECT id, key, avg(intensity) AS v FROM m GROUP BY id, key), c AS (SELECT a.id AS a, b.id AS b, round(corr(a.v, b.v), 6) AS cc FROM g a JOIN g b ON a.key = b.key AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 3), f AS (SELECT a, b, cc FROM c UNION ALL SELECT b, a, cc FROM c UNION ALL SELECT DISTINCT x, x, 1.0 FROM (SELECT a AS x FROM c UNION SELECT b FROM c)) SELECT x.a AS a, y.a AS b, round(sum(x.cc * y.cc) / sqrt(sum(x.cc * x.cc) * sum(y.cc * y.cc)), 6) AS cosine FROM f x JOIN f y ON x.b = y.b AND x.a < y.a GROUP BY x.a, y.a")
def dataset_cosines(spark, d):
    cc = groups.dataset_correlations(measurements(spark, d), ["key"], "id", "intensity").select("a", "b", F.round("cc", 6).alias("cc"))
    return statistics.cosine_matrix(cc).withColumn("cosine", F.round("cosine", 6))


@query(f"{M}, c AS (SELECT unnest([10000.0, 30000.0, 60000.0]) AS imid), b AS (SELECT imid, key, intensity / (1 + power(intensity / imid, 3)) + (1 - 1 / (1 + power(intensity / imid, 3))) * intensity * scale AS i FROM m, c), o AS (SELECT imid, i, abs(i - avg(i) OVER w) AS off, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY imid, key)) SELECT CAST(imid AS DOUBLE) AS imid, round(sum(sqrt(n / (n - 1)) * off) / sum(i), 7) AS r_meas FROM o WHERE n > 1 GROUP BY imid")
def imid_search(spark, d):
    m = measurements(spark, d).withColumn("fitted", F.col("intensity") * F.col("scale"))
    return statistics.imid_search(m, ["key"], "intensity", "fitted", "variance", [10000, 30000, 60000]).withColumn("r_meas", F.round("r_meas", 7))


