"""Small vectors for the table operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import binning, shoebox
from tessera.functions.flags import FLAGS, FlagExpression, has_flags
from tessera.operators import graph, groups, joins, outliers, table
from tessera.plans import queries as plans
from tessera.sources import formats
from tessera.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_flags(spark):
    assert FLAGS["integrated"] == 768 and FLAGS["bad_for_scaling"] == 7 << 22 and FLAGS["overloaded"] == 1 << 10
    df = frame(spark, [(i, v) for i, v in enumerate([0, 1, 256, 512, 768, 769, 32])], "i int, flags long")

    def ids(expression):
        return [r.i for r in df.where(FlagExpression(expression).column(F.col("flags"))).orderBy("i").collect()]

    assert ids("integrated") == [4, 5] and ids("integrated_sum | strong") == [2, 4, 5, 6]
    assert ids("~(integrated_sum | integrated_prf) & predicted") == [1] and ids("predicted | strong & predicted") == [1, 5]
    assert [r.i for r in df.where(has_flags(F.col("flags"), 768, every=False)).orderBy("i").collect()] == [2, 3, 4, 5]
    for bad in ("", "nothing", "(strong", "strong strong", "strong &", "__import__('os')"):
        with pytest.raises(ValueError):
            FlagExpression(bad).column(F.col("flags"))


def test_binned_statistics(spark):
    df = frame(spark, [(0, float(v)) for v in (1, 2, 3, 4)] + [(1, float(v)) for v in (1, 2, 3, 100, 1000)] + [(3, 1.0)], "b int, v double")
    got = {r.bin: (r.median, r.iqr) for r in binning.bin_quartiles(df, F.col("b"), "v", 4).collect()}
    assert got == {0: (2.5, 1.5), 1: (3.0, 98.0), 2: (0.0, 0.0), 3: (1.0, 0.0)}
    edges = frame(spark, [(x,) for x in (-1.0, 0.0, 0.9, 1.0, 5.0)], "x double").select(binning.edge_bin(F.col("x"), [0, 1, 2]).alias("b"))
    assert [r.b for r in edges.collect()] == [0, 0, 0, 1, 2]
    with pytest.raises(ValueError):
        binning.edge_bin(F.col("x"), [1, 1])


@pytest.mark.parametrize(("how", "want"), [("scale", (1.5, 0.5)), ("prf", (1.8, 1.0)), ("sum", (3.0, 2.0))])
def test_partial_sums(spark, how, want):
    df = frame(spark, [(0, 1, 1.0, 1.0, 0.4), (0, 2, 2.0, 1.0, 0.5)], "k int, row_id long, v double, s double, p double")
    r = groups.sum_partials(df, ["k"], "row_id", "v", "s", "p", how).first()
    assert (r.v, r.s) == pytest.approx(want) and r.row_id == 1 and r.p == pytest.approx(0.9) and r.n == 2


def test_d_filter_and_ranges(spark):
    df = frame(spark, [(i, d) for i, d in enumerate([50.0, 40.0, 3.0, 2.5, 2.0, 1.0])], "i int, d double")
    assert [r.i for r in df.where((F.col("d") >= 2) & (F.col("d") <= 3)).collect()] == [2, 3, 4]
    z = frame(spark, [(0, float(v)) for v in (0, 4, 5, 5.5, 9, 10)], "id int, z double")
    r = frame(spark, [(0, 6, 10)], "id int, lo int, hi int")
    assert [[x.z for x in table.in_ranges(z, r, "z", how).collect()] for how in ("slice", "valid", "inside")] == [[5, 5.5, 9], [5, 5.5, 9, 10], [9]]


def test_table_algebra(spark):
    a = frame(spark, [(0, 5), (-1, 6), (2, 7)], "id int, v int")
    assert sorted((r.id, r.v) for r in table.concat([a, a.where("id = 2")]).collect()) == [(-1, 6), (0, 5), (1, 7), (2, 7)]
    ids = frame(spark, [(0, "x")], "id int, identifier string")
    with pytest.raises(ValueError):
        table.extend(a, a, ids, frame(spark, [(0, "y")], "id int, identifier string"))
    assert table.extend(a, a, ids, ids)[0].count() == 6
    filled = table.append_defaults(a, frame(spark, [(9,)], "id int"))
    assert [r.v for r in filled.where("id = 9").collect()] == [0]
    with pytest.raises(KeyError, match="Unknown column"):
        table.require(a, ["nothing"])
    parts = table.random_split(spark.range(103).withColumnRenamed("id", "row_id"), 4, 7, ["row_id"]).groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == [25, 26, 26, 26]
    groups_ = {r.v: r.grp for r in table.tolerance_groups(frame(spark, [(float(v),) for v in (1, 1.4, 1.6, 2, 9)], "v double"), "v", 0.5).collect()}
    assert groups_ == {1.0: 0, 1.4: 0, 1.6: 1, 2.0: 1, 9.0: 2}
    assert formats.empty_standard(spark, 3).distinct().count() == 1


def test_overlaps_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    boxes = []
    for i in range(300):
        lo = [rng.randint(0, 100) for _ in range(3)]
        boxes.append((i, i % 3, *[v for x in lo for v in (x, x + rng.randint(1, 10))]))
    df = frame(spark, boxes, "row_id long, panel int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")
    for border in (0, 2, 5):
        got = {tuple(r) for r in joins.overlaps(df, ["panel"], [("z0", "z1"), ("x0", "x1"), ("y0", "y1")], 7, border).collect()}
        want = {
            (a[0], b[0]) for a in boxes for b in boxes
            if a[0] < b[0] and a[1] == b[1] and all(a[k] - border < b[k + 1] + border and b[k] - border < a[k + 1] + border for k in (2, 4, 6))
        }
        assert got == want


def test_matches(spark):
    a = frame(spark, [(0, 1, 0.0), (1, 1, 1.0), (2, 2, 0.0)], "row_id long, k int, x double")
    b = frame(spark, [(10, 1, 0.9), (11, 1, 5.0), (12, 2, 2.0)], "row_id long, k int, x double")
    assert [(r.left_row, r.right_row) for r in joins.match_nearest_keyed(a, b, ["k"], ["x"]).collect()] == [(1, 10)]
    assert sorted((r.left_row, r.right_row) for r in joins.match_within(a, b, ["x"], 2.0).collect()) == [(0, 10), (1, 10), (2, 10)]


def test_outliers_and_ranks(spark):
    df = frame(spark, [(i, 0, v, 1.0, 1.0) for i, v in enumerate([10.0, 10.5, 9.5, 90.0, 40.0])] + [(9, 1, 1.0, 1.0, 1.0), (10, 1, 99.0, 1.0, 1.0)], "row_id long, key int, v double, g double, w double")
    args = (["key"], F.col("v"), F.col("g"), F.col("w"), 5.0)
    assert sorted(r.row_id for r in outliers.iterative_outliers(df, *args).collect()) == [3, 4]
    assert [r.row_id for r in outliers.worst_outliers(df, *args).collect()] == [3]
    r = frame(spark, [(0, x, y) for x, y in ((1, 1), (2, 3), (2, 2), (4, 4))], "g int, x int, y int")
    assert outliers.spearman(r, ["g"], "x", "y").first().rho == pytest.approx(1 - 6 * 0.5 / 60)


def test_outliers_until_none_is_left(spark):
    """A group that takes more than 20 rounds, and the registered query, against removing the worst row one by one."""

    def brute(groups, zmax):
        out = set()
        for rows in groups.values():
            while len(rows) > 2:
                top, below = sum(v * g * w for _, v, g, w in rows), sum(g * g * w for _, _, g, w in rows)
                scored = []
                for i, v, g, w in rows:
                    t, b = top - v * g * w, below - g * g * w
                    scored.append((-abs(v - g * t / b) / math.sqrt(1 / w + g * g / b), i))
                worst = min(scored)
                if -worst[0] <= zmax:
                    break
                out.add(worst[1])
                rows = [r for r in rows if r[0] != worst[1]]
        return out

    rows = [(k, 0, float(2**k), 1.0, 1.0) for k in range(30)]
    df = frame(spark, rows, "row_id long, key int, v double, g double, w double")
    want = brute({0: [(i, v, g, w) for i, _, v, g, w in rows]}, 5.0)
    assert len(want) > 20
    assert {r.row_id for r in outliers.iterative_outliers(df, ["key"], F.col("v"), F.col("g"), F.col("w"), 5.0).collect()} == want

    kept = {}
    for r in plans.measurements(spark, "/root/testdata/sf0.001").select("row_id", "key", "intensity", "scale", "variance").collect():
        kept.setdefault(r.key, []).append((r.row_id, r.intensity, r.scale, 1 / r.variance))
    got = [r.row_id for r in plans.iterative_outliers(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(kept, 8000.0)


def test_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = frame(spark, [(11, 9), (9, 7), (7, 5), (5, 3), (0, 2), (2, 0), (4, 4)], "i long, j long")
    got = {r.node: r.label for r in graph.components(nodes, edges).collect()}
    assert got == {0: 0, 2: 0, 1: 1, 4: 4, 6: 6, 8: 8, 10: 10, **dict.fromkeys((3, 5, 7, 9, 11), 3)}
    grid = frame(spark, [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 3, 3)], "node int, x int, y int")
    assert sorted((r.i, r.j) for r in graph.grid_neighbours(grid, ["x", "y"]).collect()) == [(0, 1), (1, 2)]


def test_shoebox(spark):
    data = [float(v) for v in range(1, 9)]
    mask = [5, 5, 5, 17, 17, 1, 1, 1]
    df = frame(spark, [(data, [1.0] * 8, mask)], "data array<double>, bg array<double>, mask array<int>")
    two = F.lit(2)
    r = df.select(
        shoebox.count_mask(F.col("mask"), 5).alias("n"),
        shoebox.summed_intensity(F.col("data"), F.col("bg"), F.col("mask")).alias("i"),
        shoebox.peak(F.col("data"), two, two).alias("p"),
        shoebox.centroid(F.col("data"), two, two).alias("c"),
        shoebox.flatten_z(F.col("data"), two, two, two).alias("f"),
        shoebox.overloaded(F.col("data"), F.col("mask"), F.lit(7.5)).alias("o"),
    ).first()
    assert r.n == 3 and tuple(r.i) == (3.0, 3.0 + 3.0 * 2.5) and tuple(r.p) == (1, 1, 1)
    assert r.c.z == pytest.approx((10 * 0.5 + 26 * 1.5) / 36) and r.f == [6.0, 8.0, 10.0, 12.0]
    assert r.o.flag and r.o.mask == [*mask[:7], 0]


def test_formats(spark, tmp_path):
    df = frame(spark, [(1, -2, 3, 1.5, 0.25, 7)], "h int, k int, l int, value double, sigma double, batch int")
    formats.write(df, f"{tmp_path}/a", "shelx")
    assert [r.value for r in spark.read.text(f"{tmp_path}/a").collect()] == ["   1  -2   3    1.50    0.25   7"]
    (tmp_path / "b.hkl").write_text("!HEADER\n 1 2 3 10.5 0.5 1.0 2.0 3.0\n\n")
    assert tuple(formats.read(spark, str(tmp_path / "b.hkl"), "integrate_hkl").first()) == (1, 2, 3, 10.5, 0.5, 1.0, 2.0, 3.0)
    for name in ("parquet", "orc", "json", "csv"):
        formats.write(df, f"{tmp_path}/{name}", name)
        assert formats.read(spark, f"{tmp_path}/{name}", name).count() == 1
    with pytest.raises(ValueError):
        formats.read(spark, "x", "nothing")


def test_event_stream_equals_batch(spark, tmp_path):
    import glob
    import shutil

    source = glob.glob("/root/testdata/sf0.001/events.parquet")[0]
    (tmp_path / "in").mkdir()
    shutil.copy(source, tmp_path / "in/events.parquet")
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = events.windowed(stream, "1 day").writeStream.format("memory").queryName("days").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("days").collect()}
    assert got == {(r.start, r.event_type): r.n for r in events.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").collect()}
