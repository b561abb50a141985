"""Registered queries of the table operators on stand-in tables, each with its SQL.

``measurements`` reads lineitem as a measurement table: parts are the group key, suppliers modulo ten the datasets,
extended prices the intensities. Sums are rounded where the order of addition would show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import binning, geometry, shoebox
from tessera.functions.flags import FLAGS, FlagExpression, flag_census, has_flags, set_flags, unset_flags
from tessera.operators import graph, groups, joins, outliers, reports, table
from tessera.sources import formats
from tessera.streaming import events as streams

COLUMNS = {
    "row_id": "((l_orderkey * 1000000 + l_partkey) * 100000 + l_suppkey) * 8 + l_linenumber",
    "id": "CAST(l_suppkey % 10 AS INT)",
    "panel": "l_linenumber",
    "key": "l_partkey",
    "h": "CAST(l_partkey % 13 - 6 AS INT)",
    "k": "CAST(l_partkey % 11 - 5 AS INT)",
    "l": "CAST(l_partkey % 7 - 3 AS INT)",
    "entering": "CAST(l_orderkey % 2 AS INT)",
    "intensity": "l_extendedprice",
    "variance": "1 + l_quantity",
    "scale": "1 + l_tax",
    "partiality": "1 - l_discount",
    "d": "1 + l_quantity / 10",
    "x": "CAST(l_quantity AS INT)",
    "z": "CAST({days} AS INT)",
    "flags": "CAST(CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 32 ELSE 256 END + CASE WHEN l_linestatus = 'F' THEN 512 ELSE 0 END"
    " + CASE WHEN l_tax > 0.055 THEN 131072 ELSE 0 END AS BIGINT)",
}
SPARK_DAYS, DUCK_DAYS = "datediff(l_shipdate, DATE'1992-01-01')", "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"


def _select(days: str) -> str:
    return ", ".join(f"{v.replace('{days}', days)} AS {k}" for k, v in COLUMNS.items())


#: The stand-in as the start of an SQL query.
M = f"WITH m AS (SELECT {_select(DUCK_DAYS)} FROM lineitem)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return formats.read(spark, f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a measurement table; columns that a query doesn't use are pruned from the scan."""
    return read(spark, sf_dir, "lineitem").selectExpr(*(f"{v.replace('{days}', SPARK_DAYS)} AS {k}" for k, v in COLUMNS.items()))


REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


# flags and filters


@query(f"{M} SELECT row_id, flags FROM m WHERE (((flags & 5) = 5) OR ((flags & 32) = 32)) AND NOT ((flags & 131072) = 131072)")
def flag_expression(spark, d):
    m = measurements(spark, d)
    return m.where(FlagExpression("((predicted & indexed) | strong) & ~centroid_outlier").column(F.col("flags"))).select("row_id", "flags")


@query(
    f"{M} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS flag, CAST(count(*) AS BIGINT) AS n FROM m WHERE (flags & {v}) = {v}" for n, v in FLAGS.items())
    + ") WHERE n > 0"
)
def flag_counts(spark, d):
    return flag_census(measurements(spark, d))


@query(f"{M} SELECT row_id, CASE WHEN d < 3 THEN (flags | 2097152) & ~32 ELSE flags END AS flags FROM m WHERE (flags & 768) <> 0")
def flag_update(spark, d):
    m = measurements(spark, d).where(has_flags(F.col("flags"), FLAGS["integrated"], every=False))
    near = F.col("d") < 3
    f = unset_flags(set_flags(F.col("flags"), near, FLAGS["bad_reference"]), near, FLAGS["strong"])
    return m.select("row_id", f.alias("flags"))


@query(f"{M} SELECT row_id, id, d FROM m WHERE (flags & 256) = 256 AND id IN (1, 3, 5) AND panel <> 2 AND d >= 2 AND d <= 4.5 AND partiality >= 0.95 AND intensity / sqrt(variance) >= 500")
def filter_chain(spark, d):
    m = measurements(spark, d)
    m = m.where(FlagExpression("integrated_sum").column(F.col("flags"))).where(F.col("id").isin(1, 3, 5) & (F.col("panel") != 2))
    m = m.where((F.col("d") >= 2) & (F.col("d") <= 4.5) & (F.col("partiality") >= 0.95))
    return m.where(~(F.col("intensity") / F.sqrt("variance") < 500)).select("row_id", "id", "d")


@query(f"{M} SELECT row_id, intensity * scale / partiality AS corrected FROM m WHERE id >= 0 AND NOT (variance <= 3 AND (flags & 256) = 256) AND NOT (d <= 1.5) AND NOT (d >= 5.5)")
def export_reducer(spark, d):
    m = measurements(spark, d).where("id >= 0").where(~((F.col("variance") <= 3) & has_flags(F.col("flags"), FLAGS["integrated_sum"])))
    m = m.where(~(F.col("d") <= 1.5)).where(~(F.col("d") >= 5.5))
    return m.select("row_id", (F.col("intensity") * F.col("scale") / F.col("partiality")).alias("corrected"))


@query(f"{M} SELECT row_id, d FROM m WHERE abs(1 / (d * d) - 0.11) < 0.005 OR abs(1 / (d * d) - 0.25) < 0.01")
def powder_rings(spark, d):
    rings = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(w).alias("w")) for r, w in ((0.11, 0.01), (0.25, 0.02))))
    m = measurements(spark, d)
    return m.where(F.exists(rings, lambda x: F.abs(1 / (F.col("d") * F.col("d")) - x["r"]) < x["w"] / 2)).select("row_id", "d")


RANGES = "r AS (SELECT * FROM (VALUES (1, 100, 900), (1, 800, 1500), (4, 2000, 3000), (7, 10, 20)) t(id, lo, hi))"


def _ranges(spark):
    return spark.createDataFrame([(1, 100, 900), (1, 800, 1500), (4, 2000, 3000), (7, 10, 20)], "id int, lo int, hi int")


@query(f"{M}, {RANGES} SELECT row_id, id, z FROM m WHERE EXISTS (SELECT 1 FROM r WHERE r.id = m.id AND z >= lo - 1 AND z < hi)")
def slice_ranges(spark, d):
    return table.in_ranges(measurements(spark, d).select("row_id", "id", "z"), _ranges(spark), "z", "slice").select("row_id", "id", "z")


@query(f"{M}, {RANGES} SELECT row_id, id, z FROM m WHERE EXISTS (SELECT 1 FROM r WHERE r.id = m.id AND z >= lo - 1 AND z <= hi)")
def exclude_ranges(spark, d):
    return table.in_ranges(measurements(spark, d).select("row_id", "id", "z"), _ranges(spark), "z", "valid").select("row_id", "id", "z")


# table algebra


@query(f"{M} SELECT row_id, CAST(entering AS BIGINT) * 1073741824 + (h + 512) * 1048576 + (k + 512) * 1024 + (l + 512) AS hash, floor(z) + 1 + 100 AS batch FROM m")
def hash_and_batch(spark, d):
    m = measurements(spark, d)
    return m.select("row_id", table.add_hash(F.col("h"), F.col("k"), F.col("l"), F.col("entering")).alias("hash"), table.batch_of(F.col("z"), F.lit(100)).cast("double").alias("batch"))


@query(f"{M}, u AS (SELECT 0 AS t, id, row_id FROM m WHERE panel <= 3 UNION ALL SELECT 1, id, row_id FROM m WHERE panel > 3), s AS (SELECT t, id, CAST(dense_rank() OVER (ORDER BY t, id) - 1 AS INT) AS new FROM (SELECT DISTINCT t, id FROM u)) SELECT row_id, new AS id FROM u JOIN s USING (t, id)")
def concat_renumber(spark, d):
    m = measurements(spark, d)
    return table.concat([m.where("panel <= 3").select("id", "row_id"), m.where("panel > 3").select("id", "row_id")]).select("row_id", "id")


@query(f"{M} SELECT row_id AS partial_id, CAST(p AS INT) AS z0, CAST(p + 1 AS INT) AS z1 FROM (SELECT row_id, unnest(range(z, z + 1 + panel % 3)) AS p FROM m)")
def split_partials(spark, d):
    m = measurements(spark, d).select("row_id", F.col("z").alias("z0"), (F.col("z") + 1 + F.col("panel") % 3).alias("z1"))
    return table.split_partials(m).select("partial_id", "z0", "z1")


@query(f"{M}, b AS (SELECT id FROM m GROUP BY id ORDER BY count(*) DESC, id LIMIT 3) SELECT id, count(*) AS n, round(sum(intensity), 2) AS total FROM m WHERE id IN (SELECT id FROM b) GROUP BY id")
def top_n_datasets(spark, d):
    return table.top_datasets(measurements(spark, d).select("id", "intensity"), 3).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("total"))


@query(f"{M} SELECT row_id, CAST((row_number() OVER (ORDER BY md5(concat('3:', CAST(row_id AS VARCHAR))), row_id) - 1) % 7 AS INT) AS part FROM m")
def random_split(spark, d):
    return table.random_split(measurements(spark, d).select("row_id"), 7, 3, ["row_id"])


@query("SELECT o_orderkey AS row_id, o_totalprice AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS s FROM orders WHERE (o_orderkey - 10) % 2 = 0 AND o_orderkey >= 10")
def update_and_slice(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("a"), F.col("o_orderstatus").alias("s"))
    new = o.select("row_id", F.when(F.col("row_id") % 3 == 0, F.lit("x")).otherwise(F.col("s")).alias("s"))
    return table.slice_rows(table.update(o, new, "row_id"), "row_id", 10, 1 << 62, 2).select("row_id", "a", "s")


@query()
def tolerance_groups(spark, d):
    prices = read(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    graph.checkpoint_dir(prices)
    return table.tolerance_groups(prices, "v", 50.0)


# joins


@query(f"{M} SELECT a.row_id AS left_row, b.row_id AS right_row FROM m a JOIN m b USING (h, k, l, entering) WHERE a.id = 1 AND b.id = 2")
def match_hkle(spark, d):
    m = measurements(spark, d)
    return joins.match_keys(m.where("id = 1"), m.where("id = 2"), ["h", "k", "l", "entering"])


@query(f"{M}, p AS (SELECT a.row_id AS left_row, b.row_id AS right_row, (a.x - b.x) * (a.x - b.x) + (a.d - b.d) * (a.d - b.d) AS d2 FROM m a JOIN m b USING (key) WHERE a.id < 5 AND b.id >= 5), o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY left_row ORDER BY d2, right_row) = 1), t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY right_row ORDER BY d2, left_row) = 1) SELECT left_row, right_row, round(d2, 6) AS d2 FROM t WHERE d2 < 4")
def match_nearest_tiebreak(spark, d):
    m = measurements(spark, d).select("row_id", "id", "key", "x", "d")
    return joins.match_nearest_keyed(m.where("id < 5"), m.where("id >= 5"), ["key"], ["x", "d"]).withColumn("d2", F.round("d2", 6))


EMB = "SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


@query(f"WITH e AS ({EMB}), p AS (SELECT a.row_id AS left_row, b.row_id AS right_row, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM e a JOIN e b ON a.row_id % 2 = 0 AND b.row_id % 2 = 1) SELECT left_row, right_row, round(d2, 9) AS d2 FROM p WHERE d2 <= 0.0064 QUALIFY row_number() OVER (PARTITION BY left_row ORDER BY d2, right_row) = 1")
def knn_radius(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    return joins.match_within(e.where("row_id % 2 = 0"), e.where("row_id % 2 = 1"), ["x", "y", "z"], 0.08).withColumn("d2", F.round("d2", 9))


@query(f"{M}, b AS (SELECT row_id, id, panel, x AS x0, x + 2 + panel AS x1, z AS z0, z + 3 AS z1 FROM m) SELECT a.row_id AS i, b.row_id AS j FROM b a JOIN b ON a.id = b.id AND a.panel = b.panel AND a.row_id < b.row_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.z0 < b.z1 AND b.z0 < a.z1")
def overlap_join(spark, d):
    m = measurements(spark, d)
    boxes = m.select("row_id", "id", "panel", F.col("x").alias("x0"), (F.col("x") + 2 + F.col("panel")).alias("x1"), F.col("z").alias("z0"), (F.col("z") + 3).alias("z1"))
    return joins.overlaps(boxes, ["id", "panel"], [("z0", "z1"), ("x0", "x1")])


@query(f"{M}, t AS (SELECT key, avg(intensity) AS target FROM m WHERE id = 0 GROUP BY key) SELECT row_id, round(target, 3) AS target FROM m JOIN t USING (key) WHERE id = 1 AND target <> 0")
def target_lookup(spark, d):
    m = measurements(spark, d)
    target = m.where("id = 0").groupBy("key").agg(F.avg("intensity").alias("target"))
    return joins.lookup_target(m.where("id = 1").select("row_id", "key"), target, ["key"], "target").select("row_id", F.round("target", 3).alias("target"))


@query(f"{M}, g AS (SELECT CASE WHEN (h, k, l) >= (-h, -k, -l) THEN 1 ELSE 0 END AS p, h, k, l, intensity FROM m), f AS (SELECT CASE WHEN p = 1 THEN h ELSE -h END AS h, CASE WHEN p = 1 THEN k ELSE -k END AS k, CASE WHEN p = 1 THEN l ELSE -l END AS l, p, intensity FROM g) SELECT h, k, l, round(avg(intensity) FILTER (p = 1), 3) AS plus, round(avg(intensity) FILTER (p = 0), 3) AS minus FROM f GROUP BY h, k, l")
def bijvoet_mates(spark, d):
    return joins.mates(measurements(spark, d), ["h", "k", "l"], "intensity").withColumns({c: F.round(c, 3) for c in ("plus", "minus")})


@query(f"{M} SELECT b.row_id AS right_row, (SELECT min(a.row_id) FROM m a WHERE a.id = 3 AND a.key = b.key) AS left_row FROM m b WHERE b.id = 4 AND b.key IN (SELECT key FROM m WHERE id = 3)")
def common_set_match(spark, d):
    m = measurements(spark, d)
    return joins.first_match_in_order(m.where("id = 3"), m.where("id = 4"), ["key"]).select("right_row", "left_row")


# groups


@query(f"{M} SELECT key, round(sum(intensity / variance) / sum(1 / variance), 3) AS merged, round(1 / sum(1 / variance), 6) AS merged_var, count(*) AS n FROM m GROUP BY key")
def merge_equivalents(spark, d):
    out = groups.merge_equivalents(measurements(spark, d), ["key"], "intensity", "variance")
    return out.withColumns({"merged": F.round("merged", 3), "merged_var": F.round("merged_var", 6)})


@query()
def symmetry_key(spark, d):
    key = groups.canonical_key(["h", "k", "l"], [[[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[0, 1, 0], [1, 0, 0], [0, 0, -1]]])
    out = measurements(spark, d).groupBy(key.alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("total"))
    return out.select("s.h", "s.k", "s.l", "n", "total")


REGISTRY["symmetry_key"] = (
    symmetry_key,
    f"""{M}, u AS (SELECT *, row_number() OVER () AS u FROM m), i AS (SELECT u, intensity, h, k, l FROM u UNION ALL SELECT u, intensity, -h, -k, -l FROM u
      UNION ALL SELECT u, intensity, k, h, -l FROM u UNION ALL SELECT u, intensity, -k, -h, l FROM u),
    s AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY u ORDER BY h DESC, k DESC, l DESC) = 1)
    SELECT h, k, l, count(*) AS n, round(sum(intensity), 2) AS total FROM s GROUP BY h, k, l""",
)


@query(f"{M} SELECT row_id, round(sum(scale * intensity / variance) OVER w / sum(scale * scale / variance) OVER w, 3) AS ih FROM m WINDOW w AS (PARTITION BY key)")
def ih_broadcast(spark, d):
    ih = groups.best_estimate(F.col("intensity"), F.col("scale"), 1 / F.col("variance"), ["key"])
    return measurements(spark, d).select("row_id", F.round(ih, 3).alias("ih"))


@query(f"{M}, g AS (SELECT key, median(1 / variance) AS med FROM m GROUP BY key) SELECT row_id, round(least(1 / variance, 10 * med), 9) AS w FROM m JOIN g USING (key)")
def median_weight_clip(spark, d):
    m = measurements(spark, d).select("row_id", "key", (1 / F.col("variance")).alias("w"))
    return groups.clip_weights(m, ["key"], "w").select("row_id", F.round("w", 9).alias("w"))


def _partials(how, value, variance):
    return f"{M} SELECT key, id, min(row_id) AS row_id, round({value}, 3) AS intensity, round({variance}, 6) AS variance, round(sum(partiality), 6) AS partiality, count(*) AS n FROM m WHERE partiality < 0.99 GROUP BY key, id"


def _sum_partials(spark, d, how):
    m = measurements(spark, d).where("partiality < 0.99")
    out = groups.sum_partials(m, ["key", "id"], "row_id", "intensity", "variance", "partiality", how)
    return out.withColumns({"intensity": F.round("intensity", 3), "variance": F.round("variance", 6), "partiality": F.round("partiality", 6)})


@query(_partials("sum", "sum(intensity)", "sum(variance)"))
def partial_sum(spark, d):
    return _sum_partials(spark, d, "sum")


@query(_partials("scale", "sum(intensity / variance) / sum(1 / variance)", "1 / sum(1 / variance)"))
def partial_scale(spark, d):
    return _sum_partials(spark, d, "scale")


@query(f"{M}, b AS (SELECT *, CAST(greatest(0, least(4, floor((1 / (d * d) - 0.02) / 0.05))) AS INT) AS bin FROM m), g AS (SELECT bin, key, avg(intensity) AS me, var_samp(intensity) AS v, count(*) AS c FROM b GROUP BY bin, key HAVING count(*) > 1), a AS (SELECT bin, count(*) AS n, var_samp(me) AS s, avg(v / c) AS e FROM g GROUP BY bin) SELECT bin, n, round((s - e) / (s + e), 6) AS cc_half FROM a")
def resolution_bins_cc_half(spark, d):
    binned = measurements(spark, d).withColumn("bin", binning.uniform_bin(1 / (F.col("d") * F.col("d")), 0.02, 0.27, 5))
    return groups.cc_half(binned, ["key"], "bin", "intensity").withColumn("cc_half", F.round("cc_half", 6))


_CC = "((mm - m * m / c) / (c - 1) - e / c) / ((mm - m * m / c) / (c - 1) + e / c)"
_TERMS = "count(*) AS c, sum(x / n) AS m, sum(x / n * (x / n)) AS mm, sum((xx - x * x / n) / (n - 1) / n) AS e"


@query(f"{M}, ds AS (SELECT DISTINCT id FROM m), w AS (SELECT ds.id, m.key, count(*) AS n, sum(intensity) AS x, sum(intensity * intensity) AS xx FROM ds JOIN m ON m.id <> ds.id GROUP BY ds.id, m.key HAVING count(*) > 1), t AS (SELECT key, count(*) AS n, sum(intensity) AS x, sum(intensity * intensity) AS xx FROM m GROUP BY key HAVING count(*) > 1), a AS (SELECT id, {_TERMS} FROM w GROUP BY id), z AS (SELECT {_TERMS} FROM t), za AS (SELECT {_CC} AS cc FROM z), aa AS (SELECT id, {_CC} AS cc FROM a) SELECT id, round(aa.cc, 5) AS cc_half_without, round(za.cc - aa.cc, 5) AS delta FROM aa, za")
def delta_cc_half(spark, d):
    out = groups.delta_cc_half(measurements(spark, d), ["key"], "id", "intensity")
    return out.select("id", F.round("cc_half_without", 5).alias("cc_half_without"), F.round("delta", 5).alias("delta"))


@query(f"{M}, o AS (SELECT z % 50 AS batch, intensity, abs(intensity - avg(intensity) OVER (PARTITION BY key)) AS off FROM m) SELECT batch, round(CASE WHEN sum(intensity) > 0 THEN sum(off) / sum(intensity) ELSE 0 END, 6) AS r_merge FROM o GROUP BY batch")
def r_merge_per_batch(spark, d):
    m = measurements(spark, d).withColumn("batch", F.col("z") % 50)
    return groups.r_merge(m, ["key"], "batch", "intensity").withColumn("r_merge", F.round("r_merge", 6))


@query(f"{M}, o AS (SELECT panel, key, intensity, variance, abs(intensity - avg(intensity) OVER w) AS off, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY panel, key)), g AS (SELECT panel, key, count(*) AS n, sum(CASE WHEN c > 1 THEN intensity END) AS im, sum(CASE WHEN c > 1 THEN off END) AS a, sum(CASE WHEN c > 1 THEN sqrt(c / (c - 1)) * off END) AS b, sum(CASE WHEN c > 1 THEN sqrt(1 / (c - 1)) * off END) AS p, sum(intensity / variance) / sqrt(sum(1 / variance)) AS ios FROM o GROUP BY panel, key) SELECT panel, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_unique, round(sum(n) / count(*), 6) AS multiplicity, round(avg(ios), 3) AS i_over_sigma, round(sum(a) / sum(im), 6) AS r_merge, round(sum(b) / sum(im), 6) AS r_meas, round(sum(p) / sum(im), 6) AS r_pim FROM g GROUP BY ROLLUP (panel)")
def merging_statistics(spark, d):
    out = groups.merging_statistics(measurements(spark, d), ["key"], "panel", "intensity", "variance")
    return out.withColumns({c: F.round(c, 3 if c == "i_over_sigma" else 6) for c in ("multiplicity", "i_over_sigma", "r_merge", "r_meas", "r_pim")})


@query(f"{M}, g AS (SELECT id, key, avg(intensity) AS v FROM m GROUP BY id, key) SELECT a.id AS a, b.id AS b, count(*) AS n, round(corr(a.v, b.v), 6) AS cc FROM g a JOIN g b ON a.key = b.key AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 3")
def dataset_corr_matrix(spark, d):
    return groups.dataset_correlations(measurements(spark, d), ["key"], "id", "intensity").withColumn("cc", F.round("cc", 6))


@query(f"{M}, f AS (SELECT key, min(z) AS dose FROM m GROUP BY key), g AS (SELECT dose, count(*) AS c FROM f GROUP BY dose) SELECT dose, CAST(sum(c) OVER (ORDER BY dose) AS BIGINT) AS seen, round(sum(c) OVER (ORDER BY dose) / 2000, 6) AS completeness FROM g")
def dose_completeness(spark, d):
    return groups.completeness(measurements(spark, d), ["key"], "z", 2000).withColumn("completeness", F.round("completeness", 6))


# outliers


def _z(leave):
    top, below = "sum(scale * intensity / variance) OVER w", "sum(scale * scale / variance) OVER w"
    if leave:
        top, below = f"({top} - scale * intensity / variance)", f"({below} - scale * scale / variance)"
    return f"{M}, t AS (SELECT *, {top} AS top, {below} AS below, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY key)), q AS (SELECT row_id, key, CASE WHEN below = 0 THEN 1000 ELSE abs(intensity - scale * top / below) / sqrt(variance + scale * scale / below) END AS z FROM t WHERE c > 2)"


@query(f"{_z(False)} SELECT row_id, round(z, 3) AS z FROM q WHERE z > 9000")
def simple_outliers(spark, d):
    out = outliers.simple_outliers(measurements(spark, d).drop("z"), ["key"], F.col("intensity"), F.col("scale"), 1 / F.col("variance"), 9000.0)
    return out.select("row_id", F.round("z", 3).alias("z"))


@query(f"{_z(True)} SELECT row_id, round(z, 3) AS z FROM q WHERE z > 6 QUALIFY row_number() OVER (PARTITION BY key ORDER BY z DESC, row_id) = 1")
def leave_one_out_round1(spark, d):
    out = outliers.worst_outliers(measurements(spark, d).drop("z"), ["key"], F.col("intensity"), F.col("scale"), 1 / F.col("variance"), 6.0)
    return out.select("row_id", F.round("z", 3).alias("z"))


@query()
def iterative_outliers(spark, d):
    graph.checkpoint_dir(measurements(spark, d))
    m = measurements(spark, d).select("row_id", "key", "intensity", "variance", "scale")
    return outliers.iterative_outliers(m, ["key"], F.col("intensity"), F.col("scale"), 1 / F.col("variance"), 8000.0)


@query(f"{M}, t AS (SELECT key, sum(intensity / variance) / sum(1 / variance) AS g, 1 / sum(1 / variance) AS v FROM m WHERE id < 5 GROUP BY key) SELECT row_id, round(abs(intensity - g) / sqrt(variance + v), 3) AS z FROM m JOIN t USING (key) WHERE id >= 5 AND g <> 0 AND abs(intensity - g) / sqrt(variance + v) > 5000")
def target_outliers(spark, d):
    m = measurements(spark, d).drop("z")
    target = groups.merge_equivalents(m.where("id < 5"), ["key"], "intensity", "variance").drop("n")
    out = outliers.target_outliers(m.where("id >= 5"), target, ["key"], F.col("intensity"), F.col("variance"), 5000.0)
    return out.select("row_id", F.round("z", 3).alias("z"))


@query(f"{M}, q AS (SELECT panel, quantile_cont(intensity, 0.25) AS a, quantile_cont(intensity, 0.75) AS b FROM m GROUP BY panel) SELECT panel, count(*) AS n, CAST(count(*) FILTER (intensity < a - 0.2 * (b - a) OR intensity > b + 0.2 * (b - a)) AS BIGINT) AS outliers FROM m JOIN q USING (panel) GROUP BY panel")
def tukey_outliers(spark, d):
    out = outliers.tukey(measurements(spark, d).select("panel", "intensity"), ["panel"], "intensity", 0.2)
    return out.groupBy("panel").agg(F.count("*").alias("n"), F.sum(F.col("outlier").cast("long")).alias("outliers"))


@query(f"{M}, r AS (SELECT id, rank() OVER (PARTITION BY id ORDER BY intensity) + (count(*) OVER (PARTITION BY id, intensity) - 1) / 2 AS a, rank() OVER (PARTITION BY id ORDER BY x) + (count(*) OVER (PARTITION BY id, x) - 1) / 2 AS b FROM m) SELECT id, count(*) AS n, round(1 - 6 * sum((a - b) * (a - b)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 8) AS rho FROM r GROUP BY id")
def spearman(spark, d):
    return outliers.spearman(measurements(spark, d).select("id", "intensity", "x"), ["id"], "intensity", "x").withColumn("rho", F.round("rho", 8))


# bins and histograms


@query(f"{M}, b AS (SELECT CASE WHEN d < 2 THEN 0 WHEN d < 3 THEN 1 WHEN d < 5 THEN 2 WHEN d < 9 THEN 3 ELSE 4 END AS bin, intensity FROM m) SELECT CAST(r.range AS INT) AS bin, count(b.bin) AS n, round(coalesce(sum(intensity), 0), 2) AS total, round(coalesce(avg(intensity), 0), 4) AS mean FROM range(5) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range")
def binner_sum_mean(spark, d):
    out = binning.bin_sums(measurements(spark, d), binning.edge_bin(F.col("d"), [1, 2, 3, 5, 9]), "intensity", 5)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query(f"{M}, b AS (SELECT CAST(least(9, floor((d - 1) / 0.6)) AS INT) AS bin, intensity FROM m) SELECT CAST(r.range AS INT) AS bin, round(coalesce(median(intensity), 0), 4) AS median, round(coalesce(quantile_cont(intensity, 0.75) - quantile_cont(intensity, 0.25), 0), 4) AS iqr FROM range(10) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range")
def binned_median_iqr(spark, d):
    out = binning.bin_quartiles(measurements(spark, d), binning.uniform_bin(F.col("d"), 1.0, 7.0, 10), "intensity", 10)
    return out.withColumns({c: F.round(c, 4) for c in ("median", "iqr")})


@query(f"{M}, h AS (SELECT panel, z, count(*) AS c FROM m GROUP BY panel, z), x AS (SELECT panel, max(c) AS most FROM h GROUP BY panel), f AS (SELECT h.panel, z FROM h JOIN x USING (panel) WHERE c <= 0.4 * most), g AS (SELECT panel, z, z - row_number() OVER (PARTITION BY panel ORDER BY z) AS run FROM f) SELECT panel, min(z) AS first, max(z) AS last FROM g GROUP BY panel, run")
def blank_regions(spark, d):
    counts = measurements(spark, d).groupBy("panel", "z").agg(F.count("*").alias("c"))
    most = counts.groupBy("panel").agg(F.max("c").alias("most"))
    return binning.islands(counts.join(F.broadcast(most), "panel").withColumn("bad", F.col("c") <= 0.4 * F.col("most")), "z", "bad", ["panel"])


@query(f"{M}, r AS (SELECT id, row_id, intensity, row_number() OVER (PARTITION BY id ORDER BY intensity, row_id) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM m), s AS (SELECT id, CAST(floor(i * greatest(5, least(20, floor(n / 100))) / n) AS INT) AS slot, intensity FROM r) SELECT id, slot, count(*) AS n, min(intensity) AS low FROM s GROUP BY id, slot")
def equal_population(spark, d):
    out = binning.equal_population(measurements(spark, d).select("id", "row_id", "intensity"), "id", "intensity", ["row_id"], 100)
    return out.groupBy("id", "slot").agg(F.count("*").alias("n"), F.min("intensity").alias("low"))


@query(f"{M} SELECT CAST(floor(x / 10) AS INT) AS xbin, panel, count(*) AS n, round(sum(intensity), 2) AS total, round(avg(d), 6) AS mean_d FROM m GROUP BY ALL")
def histogram_2d(spark, d):
    m = measurements(spark, d).withColumn("xbin", F.floor(F.col("x") / 10).cast("int"))
    return m.groupBy("xbin", "panel").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("total"), F.round(F.avg("d"), 6).alias("mean_d"))


@query(f"{M} SELECT z, count(*) AS n, CAST(count(*) FILTER ((flags & 4) = 4) AS BIGINT) AS n_indexed, round(avg(intensity / sqrt(variance)), 4) AS i_over_sigma, min(d) AS d_min FROM m GROUP BY z")
def per_image_statistics(spark, d):
    m = measurements(spark, d)
    return m.groupBy("z").agg(
        F.count("*").alias("n"),
        F.sum(has_flags(F.col("flags"), FLAGS["indexed"]).cast("long")).alias("n_indexed"),
        F.round(F.avg(F.col("intensity") / F.sqrt("variance")), 4).alias("i_over_sigma"),
        F.min("d").alias("d_min"),
    )


# rows against a small aggregate


@query(f"{M}, b AS (SELECT id, panel AS bin, CASE WHEN avg(intensity / sqrt(variance)) >= 12800 THEN 1 ELSE 0 END AS ok FROM m WHERE intensity / sqrt(variance) > 0 GROUP BY id, panel), r AS (SELECT id, bin, min(ok) OVER (PARTITION BY id ORDER BY bin) AS run FROM b), g AS (SELECT id, max(bin) AS last FROM r WHERE run = 1 GROUP BY id) SELECT row_id, id, panel FROM m JOIN g USING (id) WHERE panel <= last")
def significance_filter(spark, d):
    m = measurements(spark, d)
    return reports.significance_filter(m, "id", "panel", F.col("intensity") / F.sqrt("variance"), 12800.0).select("row_id", "id", "panel")


@query(f"{M}, w AS (SELECT * FROM (VALUES (2600, 2620), (3000, 3400)) t(lo, hi)), c AS (SELECT row_id, z, z + 4 AS z1, (SELECT sum(greatest(0, least(z + 4, hi) - greatest(z, lo))) FROM w) AS dead FROM m) SELECT row_id FROM c WHERE dead / 4 <= 0.3")
def dead_time_filter(spark, d):
    m = measurements(spark, d).select("row_id", F.col("z").cast("double").alias("z0"), (F.col("z") + 4.0).alias("z1"))
    windows = spark.createDataFrame([(2600.0, 2620.0), (3000.0, 3400.0)], "lo double, hi double")
    return reports.dead_time(m, windows, "z0", "z1", 0.3).select("row_id")


@query(f"{M}, b AS (SELECT row_id, id, z, panel, x, x + 1 + panel % 2 AS x1, CAST(round(d * 10) AS INT) AS y, CAST(round(d * 10) AS INT) + 2 AS y1 FROM m), p AS (SELECT row_id, id, z, px, py FROM (SELECT *, unnest(range(x, x1)) AS px FROM b), LATERAL (SELECT unnest(range(y, y1)) AS py)), q AS (SELECT id, z, px, py FROM p GROUP BY ALL HAVING min(row_id) <> max(row_id)) SELECT row_id FROM b WHERE row_id NOT IN (SELECT row_id FROM p JOIN q USING (id, z, px, py))")
def unique_pixel_filter(spark, d):
    b = measurements(spark, d).select("row_id", "id", "z", "x", (F.col("x") + 1 + F.col("panel") % 2).alias("x1"), F.round(F.col("d") * 10).cast("int").alias("y"))
    b = b.withColumn("y1", F.col("y") + 2)
    return reports.unique_pixels(b, ["id", "z"], ("x", "x1"), ("y", "y1")).select("row_id")


@query(f"{M}, b AS (SELECT panel, avg(intensity) AS mean FROM m GROUP BY panel) SELECT row_id, round(intensity / mean, 6) AS e_squared FROM m JOIN b USING (panel) WHERE intensity / mean > 1.9")
def wilson_outliers(spark, d):
    out = reports.normalised_squares(measurements(spark, d).select("row_id", "panel", "intensity"), "panel", "intensity")
    return out.where("e_squared > 1.9").select("row_id", F.round("e_squared", 6).alias("e_squared"))


@query(f"{M}, k AS (SELECT DISTINCT key FROM m), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM k) SELECT row_id, (r - 1) % 20 = 0 AS free FROM m JOIN r USING (key)")
def free_set(spark, d):
    return reports.free_set(measurements(spark, d).select("row_id", "key"), "key", 20, 1).select("row_id", "free")


@query(f"{M}, c AS (SELECT range AS key FROM range(0, 2500)) SELECT key FROM c WHERE key NOT IN (SELECT key FROM m WHERE id = 0)")
def missing_keys(spark, d):
    complete = spark.range(0, 2500).select(F.col("id").alias("key"))
    return reports.missing_keys(measurements(spark, d).where("id = 0"), complete, ["key"])


@query(f"{M} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 6) AS mean FROM m" for c in ("intensity", "variance", "d", "z")))
def column_summary(spark, d):
    return reports.column_summary(measurements(spark, d), ["intensity", "variance", "d", "z"]).withColumn("mean", F.round("mean", 6))


@query(f"{M}, g AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r, count(*) OVER (PARTITION BY id) AS n FROM m) SELECT id, count(*) AS n, round(max(greatest(r / n - (d - 1) / 5.1, (d - 1) / 5.1 - (r - 1) / n)), 9) AS d FROM g GROUP BY id")
def ks_distance(spark, d):
    m = measurements(spark, d).select("id", F.col("d").alias("v"))
    return reports.kolmogorov_smirnov(m, ["id"], (F.col("v") - 1) / 5.1, "v").select("id", "n", F.round("d", 9).alias("d"))


# formulas


@query(f"{M} SELECT row_id, k AS h2, -h AS k2, l + h AS l2, round(CASE WHEN h * h + k * k + l * l > 0 THEN 1 / sqrt(h * h / 100.0 + k * k / 400.0 + l * l / 900.0) END, 6) AS spacing FROM m")
def reindex_and_spacing(spark, d):
    m = measurements(spark, d)
    index = [F.col(c) for c in "hkl"]
    h2, k2, l2 = geometry.reindexed(index, [[0, 1, 0], [-1, 0, 0], [1, 0, 1]])
    spacing = geometry.d_spacing(*index, geometry.reciprocal_metric(10, 20, 30, 90, 90, 90))
    return m.select("row_id", h2.alias("h2"), k2.alias("k2"), l2.alias("l2"), F.round(spacing, 6).alias("spacing"))


@query("SELECT vec_id, -embedding[1] * 0.5 + embedding[3] * 0 < 0 AS entering, round((x * 0 + y * 1 + z * 0) / sqrt(x * x + y * y + z * z), 6) AS zeta FROM (SELECT vec_id, embedding, CAST(embedding[2] AS DOUBLE) * 0.5 AS x, -CAST(embedding[1] AS DOUBLE) * 0.5 AS y, 0.0 AS z FROM embeddings)")
def entering_and_zeta(spark, d):
    s1 = [F.col("embedding")[i].cast("double") for i in range(3)]
    e = read(spark, d, "embeddings")
    s0, axis = [0.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    return e.select("vec_id", geometry.entering(s1, s0, axis).alias("entering"), F.round(geometry.zeta(s1, s0, axis), 6).alias("zeta"))


@query(f"{M} SELECT row_id, round(CASE WHEN intensity <= 0 THEN intensity ELSE intensity / (1 + power(intensity / 40000, 3)) + (1 - 1 / (1 + power(intensity / 40000, 3))) * intensity * scale END, 3) AS blended, round((variance + (0.02 * intensity) * (0.02 * intensity)) * 1.44, 3) AS new_variance FROM m")
def blend_and_error_model(spark, d):
    m = measurements(spark, d)
    fitted = F.col("intensity") * F.col("scale")
    return m.select("row_id", F.round(geometry.blended(F.col("intensity"), fitted, 40000.0), 3).alias("blended"), F.round(geometry.error_model(F.col("variance"), F.col("intensity"), 1.2, 0.02), 3).alias("new_variance"))


# arrays and graphs


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS n_foreground, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST((list_position(embedding, list_max(embedding)) - 1) % 8 AS INT) AS x, CAST((list_position(embedding, list_max(embedding)) - 1) // 8 AS BIGINT) AS y FROM embeddings")
def shoebox_statistics(spark, d):
    data = F.transform("embedding", lambda x: x.cast("double"))
    mask = F.transform("embedding", lambda x: F.when(x > 0, shoebox.VALID | shoebox.FOREGROUND).otherwise(shoebox.VALID))
    e = read(spark, d, "embeddings").select("vec_id", data.alias("data"), mask.alias("mask"))
    code, n = shoebox.VALID | shoebox.FOREGROUND, F.lit(8)
    at = shoebox.peak(F.col("data"), n, n)
    return e.select("vec_id", shoebox.count_mask(F.col("mask"), code).alias("n_foreground"), F.round(shoebox.masked_sum(F.col("data"), F.col("mask"), code), 6).alias("total"), at["x"].cast("int").alias("x"), at["y"].alias("y"))


@query("WITH o AS (SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, o_custkey AS c FROM orders), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR (node + prev) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY node ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT node, min(node) OVER (PARTITION BY c, run) AS label FROM s")
def connected_components(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey")
    prev = F.lag("node").over(Window.partitionBy("o_custkey").orderBy("node"))
    edges = o.select(F.col("node").alias("i"), prev.alias("j")).where("j IS NOT NULL AND (i + j) % 3 <> 0")
    return graph.components(o.select("node"), edges)


# streams


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streams.windowed(read(spark, d, "events")).withColumn("total", F.round("total", 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(spark, d):
    return streams.sessions(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# sinks


@query(f"{M} SELECT printf('%4d%4d%4d%8.2f%8.2f%4d', h, k, l, intensity, sqrt(variance), panel) AS value FROM m")
def shelx_lines(spark, d):
    m = measurements(spark, d)
    rows = m.select("h", "k", "l", F.col("intensity").alias("value"), F.sqrt("variance").alias("sigma"), F.col("panel").alias("batch"))
    return formats.lines(rows, "shelx", ["h", "k", "l"])


def _all() -> dict[str, tuple]:
    from tessera.plans import more, reports  # noqa: F401  # they register their queries

    return REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
