"""Operators that SQL can't express against brute force, the fixtures' literal values, files and registries."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plugins, programs
from tessera.functions import binning, scalar, shoebox
from tessera.operators import datasets, export, graph, outliers, ranks, reports, residuals, scaling, spots, statistics, table
from tessera.sources import formats, table_file


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


# outliers and ranks


def test_iterative_outliers_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 23 if i % 3 else 0, rng.gauss(100, 10) if rng.random() < 0.8 else rng.gauss(300, 80), 1 + rng.random(), 1 + 10 * rng.random()) for i in range(900)]
    want = set()
    for key in {r[1] for r in rows}:
        left = [r for r in rows if r[1] == key]
        while len(left) > 2:
            top, below = sum(g * i / v for _, _, i, g, v in left), sum(g * g / v for _, _, _, g, v in left)
            z = []
            for row, _, i, g, v in left:
                t, b = top - g * i / v, below - g * g / v
                z.append((abs(i - g * t / b) / math.sqrt(v + g * g / b), -row))
            worst = max(z)
            if worst[0] <= 8:
                break
            want.add(-worst[1])
            left = [r for r in left if r[0] != -worst[1]]
    df = spark.createDataFrame(rows, "row_id long, key int, i double, g double, v double")
    graph.checkpoint_dir(df)
    ask = lambda: [r.row_id for r in outliers.iterative_outliers(df, ["key"], F.col("i"), F.col("g"), 1 / F.col("v"), 8.0).collect()]
    got = ask()
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    monkeypatch.setattr(outliers, "BIG", 100)  # the group of key 0 goes by rounds over the table
    assert set(ask()) == want
    assert outliers.iterative_outliers(df.limit(0), ["key"], F.col("i"), F.col("g"), 1 / F.col("v"), 8.0).count() == 0


def test_quantiles_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", 7)
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), float(rng.choice([1, 1, 1, 2, 3.5, rng.gauss(0, 9)]))) for _ in range(700)] + [(5, 4.0), (6, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    by = {k: np.array(sorted(v for j, v in rows if j == k and v is not None)) for k in (0, 1, 2, 5)}
    for r in ranks.quantiles(df, ["k"], "v", [0, 0.25, 0.5, 0.9, 1], list("abcde")).collect():
        assert [r[c] for c in "abcde"] == pytest.approx(np.quantile(by[r.k], [0, 0.25, 0.5, 0.9, 1]).tolist())
    for r in ranks.average_ranks(df, ["k"], "v", "rank").collect():
        assert r["rank"] == (by[r.k] < r.v).sum() + ((by[r.k] == r.v).sum() + 1) / 2
    assert ranks.quantiles(df.limit(0), ["k"], "v", [0.5], ["m"]).count() == 0


def test_spearman_of_many_rows_and_odd_ones(spark):
    """A group of over 2.1 million rows (their number's cube is no long), a group of one, null keys and values."""
    n, c = 2_100_000, 42_000
    many = spark.range(n).selectExpr("1 AS k", "CAST(id % 50 AS DOUBLE) AS a", "CAST(49 - id % 50 AS INT) AS b")
    (r,) = outliers.spearman(many, ["k"], "a", "b").collect()
    assert r.n == n and r.rho == pytest.approx(1 - 6 * c**3 * sum((2 * v - 49) ** 2 for v in range(50)) / (n**3 - n), rel=1e-9)
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 1.5, 2.0, rng.gauss(0, 9)]), rng.choice([None, 1, 2, 3, rng.randint(0, 99)])) for _ in range(300)] + [(9, 1.0, 1)]
    rank = lambda v, of: sum(w < v for w in of) + (of.count(v) + 1) / 2
    got = {r.k: (r.n, r.rho) for r in outliers.spearman(spark.createDataFrame(rows, "k int, a double, b int"), ["k"], "a", "b").collect()}
    assert set(got) == {1, 2, 9, None} and got[9][0] == 1 and math.isnan(got[9][1])
    for k in (1, 2, None):
        a, b = ([math.inf if r[at] is None else r[at] for r in rows if r[0] == k] for at in (1, 2))
        d2 = sum((rank(v, a) - rank(w, b)) ** 2 for v, w in zip(a, b, strict=True))
        assert got[k][0] == len(a) and got[k][1] == pytest.approx(1 - 6 * d2 / (len(a) ** 3 - len(a)))


def test_tolerance_groups(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 900), 2) for _ in range(600)] + [2000.0, 2000.0, 5000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    graph.checkpoint_dir(df)
    want, start, group = {}, None, -1
    for v in sorted(set(values)):
        if start is None or v - start > 3:
            start, group = v, group + 1
        want[v] = group
    assert {r.v: r.grp for r in table.tolerance_groups(df, "v", 3.0).collect()} == want


def test_kolmogorov(spark):
    df = spark.createDataFrame([(0, x) for x in (0.1, 0.4, 0.4, 0.9)], "k int, v double")
    r = reports.kolmogorov_smirnov(df, ["k"], F.col("v"), "v").first()
    assert (r.n, r.d, r.above, r.below) == (4, pytest.approx(0.35), pytest.approx(0.35), pytest.approx(0.15))
    assert reports.kolmogorov_p(0.05, 100) > 0.9 > 0.01 > reports.kolmogorov_p(0.3, 100)


# graphs and spots


def test_components_of_long_chains(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(0, 40, 2)] + [(1000 + i, 1003 + i) for i in range(0, 20, 2)]
    nodes = [*range(n + 1), *range(1000, 1060)]
    got = graph.components(spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame(edges, "i long, j long"))
    assert {r.node: r.label for r in got.collect()} == components(nodes, edges)


@pytest.mark.parametrize("flat", [False, True])
def test_pixel_labels(spark, flat):
    rng = random.Random(2)
    places = sorted({(rng.randint(0, 1), rng.randint(0, 3), rng.randint(0, 7), rng.randint(0, 7)) for _ in range(220)})
    rows = [(i, *p, float(rng.randint(1, 9))) for i, p in enumerate(places)]
    at = {p: i for i, p in enumerate(places)}
    steps = [(0, 0, 0, 1), (0, 0, 1, 0)] + ([] if flat else [(0, 1, 0, 0)])
    edges = [(i, at[q]) for p, i in at.items() for s in steps if (q := tuple(a + b for a, b in zip(p, s, strict=True))) in at]
    want = components(range(len(rows)), edges)
    df = spark.createDataFrame(rows, "node long, panel int, z int, y int, x int, value double")
    labelled = spots.label_pixels(df, flat=flat)
    assert {r.node: r.label for r in labelled.collect()} == want
    sizes = {}
    for n in want.values():
        sizes[n] = sizes.get(n, 0) + 1
    found = programs.run("find_spots", df, least=2, most=30, flat=flat).collect()
    assert {r.label: r.n for r in found} == {k: n for k, n in sizes.items() if 2 <= n <= 30}
    assert all(r.total == sum(rows[i][5] for i, k in want.items() if k == r.label) for r in found)


def test_components_by_rounds(spark, monkeypatch):
    """Many rounds of contraction, with edges both ways, twice and to themselves: the planner's estimates of
    size stay small (their digits doubled with each join, until planning took all the time)."""
    monkeypatch.setattr(graph, "SMALL", 0)
    rng = random.Random(4)
    numbers = rng.sample(range(10**12, 10**12 + 10**6), 900)
    at = {(k // 30, k % 30): n for k, n in enumerate(numbers) if rng.random() < 0.62}
    edges = [(n, at[q]) for (x, y), n in at.items() for q in ((x + 1, y), (x, y + 1)) if q in at]
    edges += [(j, i) for i, j in edges[::3]] + edges[::5] + [(n, n) for n in list(at.values())[:9]]
    nodes = spark.createDataFrame([(n,) for n in at.values()], "node long")
    got = graph.components(nodes, spark.createDataFrame(edges, "i long, j long"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**300
    want = components(at.values(), edges)
    assert sorted((r.node, r.label) for r in got.collect()) == sorted(want.items())
    monkeypatch.undo()
    got = graph.components(nodes, spark.createDataFrame(edges, "i long, j long"))
    assert sorted((r.node, r.label) for r in got.collect()) == sorted(want.items())
    alone = graph.components(nodes, spark.createDataFrame([], "i long, j long"))
    assert all(r.node == r.label for r in alone.collect())


def test_near_clusters_and_missing_regions(spark):
    rng = random.Random(8)
    pts = [(i, rng.random(), rng.random(), rng.random()) for i in range(150)]
    edges = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 0.12]
    got = spots.near_clusters(spark.createDataFrame(pts, "node long, x double, y double, z double"), ["x", "y", "z"], 0.12)
    assert {r.node: r.label for r in got.collect()} == components(range(150), edges)
    whole = [(h, k, l) for h in range(6) for k in range(6) for l in range(4)]
    seen = [p for p in whole if rng.random() < 0.8]
    gone = [p for p in whole if p not in seen]
    near = [(a, b) for i, a in enumerate(gone) for b in gone[i + 1 :] if sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) <= 2]
    names = components(gone, near)
    want = {p for p in gone if list(names.values()).count(names[p]) > 1}
    frame = lambda rows: spark.createDataFrame(rows, "h int, k int, l int")
    rows = spots.missing_regions(frame(seen), frame(whole), ["h", "k", "l"]).collect()
    assert {(r.h, r.k, r.l) for r in rows} == want and len({r.region for r in rows}) == len({names[p] for p in want})


# robust fits


def test_robust_fits(spark):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 2]], 200)
    bad = rng.normal(30, 1, (20, 2))
    rows = [(0, i, *map(float, p)) for i, p in enumerate(np.r_[good, bad])] + [(1, 900 + i, 0.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "job int, row_id long, a double, b double")
    got = {r.row_id: r.outlier for r in residuals.mahalanobis_outliers(df, ["job"], ["a", "b"], 13.8, "row_id").collect()}
    assert all(got[i] for i in range(200, 220)) and sum(got[i] for i in range(200)) < 6 and all(got[900 + i] for i in range(5))
    mix = spark.createDataFrame([(0, float(x)) for x in np.r_[rng.normal(0, 1, 600), rng.normal(9, 2, 300)]], "bin int, v double")
    one, two = residuals.fit_mixture(mix, "bin", "v").orderBy("part").collect()
    assert one.mean == pytest.approx(0, abs=0.2) and two.mean == pytest.approx(9, abs=0.4) and one.weight == pytest.approx(2 / 3, abs=0.04)
    bright = [(0, i, float(x)) for i, x in enumerate(rng.exponential(1, 200))] + [(0, 500, 300.0), (0, 501, 90.0)]
    left = residuals.reject_brightest(spark.createDataFrame(bright, "z int, row_id long, v double"), "z", "v", "row_id").collect()
    assert len(left) == 200 and max(r.row_id for r in left) < 500
    assert residuals.poisson_expected_max(0.5, 1000) == 4
    data = [(0, [10.0, 11.0, 9.0, 10.0, 12.0, 500.0])]
    r = spark.createDataFrame(data, "i int, data array<double>").select(shoebox.robust_poisson_mean(F.col("data")).alias("m")).first()
    assert 9 < r.m < 25


def test_significance_and_fits(spark):
    assert statistics.student_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert statistics.student_quantile(0.1, 3) == pytest.approx(-1.637744354, abs=1e-7)
    assert statistics.cc_significance(-1, 50, 0.01) == (False, 0.0) and statistics.cc_significance(0.9, 2, 0.01) == (False, 0.0)
    yes, critical = statistics.cc_significance(0.5, 30, 0.01)
    assert yes and critical == pytest.approx(2.467140098 / math.sqrt(28 + 2.467140098**2), abs=1e-7)
    x = np.linspace(0.01, 0.6, 20)
    curve = 0.5 * (1 - np.tanh((x - 0.35) / 0.08))
    assert statistics.resolution_limit(x, curve, "tanh", 0.3, [100] * 20) == pytest.approx(1 / math.sqrt(0.35 + 0.08 * math.atanh(0.4)), rel=1e-3)
    assert statistics.resolution_limit(x, np.exp(3 - 10 * x), "log", 1.0) == pytest.approx(1 / math.sqrt(0.3), rel=1e-2)
    assert statistics.resolution_limit(x, curve + 2, "polynomial", 1.0) == pytest.approx(1 / math.sqrt(0.6))
    assert statistics.resolution_limit(x, curve, "polynomial", 0.999999) in (None, pytest.approx(1 / math.sqrt(0.03), rel=0.9))
    with pytest.raises(RuntimeError):
        statistics.tanh_fit([1, 2], [1, 0], [2, 2])
    rows = spark.createDataFrame([(1 / math.sqrt(a), float(b), 100) for a, b in zip(x, curve, strict=True)], "d_min double, cc_half double, n long")
    assert programs.run("estimate_resolution", rows).first().d_min == pytest.approx(1.59, abs=0.03)
    judged = statistics.with_significance(spark.createDataFrame([(0, 0.9, 50.0), (1, 0.05, 50.0)], "bin int, r double, n double"), "r", "n").collect()
    assert [r.significant for r in judged] == [True, False]


def test_scaling_finds_scales_and_errors(spark):
    rng = np.random.default_rng(2)
    truth = {0: 0.5, 1: 1.0, 2: 1.5}
    strong = rng.uniform(50, 2000, 200)
    rows = [(i, int(k), d, float(g * strong[k] + rng.normal(0, 5)), 25.0) for i, (k, d, g) in enumerate((k, d, g) for k in range(200) for d, g in truth.items() for _ in range(2))]
    df = spark.createDataFrame(rows, "row_id long, key int, id int, intensity double, variance double")
    graph.checkpoint_dir(df)
    got = {r.id: r.scale for r in scaling.scale_datasets(df, ["key"], "id", "intensity", "variance").collect()}
    assert {k: v / got[1] for k, v in got.items()} == pytest.approx({k: g for k, g in truth.items()}, rel=0.01)
    flat = spark.createDataFrame([(i, i % 300, float(v), 4.0) for i, v in enumerate(np.repeat(rng.uniform(10, 3000, 300)[None], 12, 0).ravel() * (1 + rng.normal(0, 0.05, 3600)) + rng.normal(0, 4, 3600))], "row_id long, key int, intensity double, variance double")
    a, b = scaling.fit_error_model(scaling.error_deviations(flat, ["key"], "intensity", "variance"))
    assert a * b == pytest.approx(0.05, rel=0.2) and a == pytest.approx(2, rel=0.5)
    noisy = [(i, k, d, float(strong[k] + rng.normal(0, 5) if d < 5 else rng.uniform(50, 2000)), 25.0, k % 2) for i, (k, d) in enumerate((k, d) for k in range(200) for d in range(6))]
    df = spark.createDataFrame(noisy, "row_id long, key int, id int, intensity double, variance double, bin int")
    left, removed = scaling.scale_and_filter(df, ["key"], "id", "bin", "intensity", "variance", 2, 1.5, most_removed=0.3)
    assert removed == [5] and left.count() == 1000
    folds = scaling.cross_validate(df.where("id < 5"), "key", "intensity", "variance", 10, 2, "id").collect()
    assert [r.fold for r in folds] == [0, 1] and all(0 < r.r_work < 0.05 and 0 < r.r_free < 0.05 for r in folds)
    assert scaling.cell_clusters([(10, 10), (10.1, 10), (20, 20), (10.2, 10)], 0.15) == [0, 0, 1, 0]
    weak = spark.createDataFrame([(0, -5.0, 25.0), (0, 100.0, 25.0), (0, 40.0, 25.0)], "bin int, v double, s double")
    out = {r.v: r for r in scaling.posterior_moments(weak, "bin", "v", "s").collect()}
    assert 0 < out[-5.0].intensity < 5 and out[100.0].intensity == pytest.approx(100 - 25 / 45, rel=1e-3)


# literal values of the fixtures


def test_partial_sums_of_the_fixtures(spark):
    rows = [(1, 0, 0, 0.5, 1.0, 1.0, 0.5, 0.25, 1.0, 1.0), (2, 0, 0, 0.4, 2.0, 1.0, 1.0, 0.25, 2.0, 1.0), (3, 0, 1, 0.9, 7.0, 1.0, 3.0, 1.0, 1.0, 1.0)]
    schema = "row_id long, id int, partial_id int, partiality double, prf_value double, prf_variance double, sum_value double, sum_variance double, scale_value double, scale_variance double"
    got = {r.row_id: r for r in export.combined_partials(spark.createDataFrame(rows, schema), ("prf", "sum", "scale")).collect()}
    assert set(got) == {1, 3} and got[1].partiality == 0.9 and got[3].prf_value == 7.0
    assert (got[1].prf_value, got[1].prf_variance, got[1].sum_value, got[1].sum_variance, got[1].scale_value, got[1].scale_variance) == pytest.approx((1.8, 1.0, 1.5, 0.5, 1.5, 0.5))


def test_export_errors(spark):
    df = spark.createDataFrame([(1, 0, 256, 1.0, 4.0, 2.0)], "row_id long, id int, flags long, sum_value double, sum_variance double, d double")
    assert export.export_or_fall_back(df, "sum").select("sum_value", "fractioncalc").first()[:] == (1.0, 1.0)
    with pytest.raises(ValueError):
        export.filter_for_export(df, "fitted")
    with pytest.raises(ValueError):
        export.export_or_fall_back(df.withColumns({"prf_value": F.lit(1.0), "prf_variance": F.lit(1.0)}), "prf")
    with pytest.raises(ValueError):
        export.export_or_fall_back(df, "sum", d_min=5.0)
    with pytest.raises(KeyError):
        export.filter_for_export(df.withColumn("inverse_scale_factor", F.lit(1.0)), "scale")
    with pytest.raises(TypeError):
        export.selector(df.withColumn("v", F.struct("d")), "v", "<", 1)
    volumes = spark.createDataFrame([(float(v),) for v in [*range(1, 40)] * 5 + [400]], "v double")
    assert export.by_volume(volumes, F.col("v")).count() == 195


def test_identifier_maps(spark):
    def ds(ids, names):
        return datasets.Datasets(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id int, row_id long"), spark.createDataFrame(names, "id int, identifier string"))

    both = datasets.combine([ds([0, 0, 1, 1], [(0, "a"), (1, "b")]), ds([0, 0, 1, 1], [(0, "c"), (1, "d")])])
    assert sorted(r.id for r in both.rows.collect()) == [0, 0, 1, 1, 2, 2, 3, 3] and {r.id: r.identifier for r in both.ids.collect()} == dict(enumerate("abcd"))
    with_none = datasets.combine([ds([-1, 7, 7], [(7, "x")]), ds([-1, 9, 9], [(9, "y")])])
    assert sorted(r.id for r in with_none.rows.collect()) == [-1, -1, 0, 0, 1, 1]
    s = ds([0, 1, 1, 2, -1], [(0, "a"), (1, "b"), (2, "c")])
    assert sorted(r.identifier for r in s.select(F.col("id") > 0).ids.collect()) == ["b", "c"]
    assert [r.identifier for r in s.slice("row_id", 0, 3, 2).ids.orderBy("id").collect()] == ["a", "b"]
    assert sorted(r.id for r in s.remove_identifiers(["b"]).reset_ids().rows.collect()) == [-1, 0, 1]
    assert s.unknown(["b", "q"]) == ["q"] and s.consistent() and s.top(1).rows.count() == 2
    assert [(r.place, r.id) for r in s.in_order(["c", "a"]).orderBy("place").collect()] == [(0, 2), (1, 0)]
    with pytest.raises(ValueError):
        s.choose(use=["a"], exclude=["b"])
    with pytest.raises(ValueError):
        s.choose(use=["q"])
    with pytest.raises(ValueError):
        s.extend(ds([0], [(0, "other")]))
    assert s.choose(exclude=["a"]).rows.count() == 4 and s.choose_ids(use=[1]).rows.count() == 2
    parsed = datasets.parse_multiple([ds([0], [(0, "a")]), ds([5], [(5, "b")])])
    assert sorted(r.id for r in parsed.rows.collect()) == [0, 5]
    assert datasets.remove_ranges([(1, 100)], [(20, 30), (90, 120)]) == [(1, 19), (31, 89)]
    assert datasets.job_blocks(0, 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    with pytest.raises(ValueError):
        datasets.parse_excluded(["1:5"])
    assert statistics.edge_groups([("a", 2), ("a", 3), ("a", 1)], {"a": [0, 1, 2, 3]}) == [("a", 3), ("a", 2), ("a", 1)]


# files and registries


def test_table_files(spark, tmp_path):
    box = {"panel": 1, "bbox": [0, 2, 0, 1, 3, 4], "data": [1.5, 2.0], "mask": [5, 1], "background": [0.0, 0.5]}
    columns = {
        "id": ("int", [0, -1, 7]), "flags": ("std::size_t", [1, 2, 1 << 40]), "d": ("double", [1.5, float("inf"), -2.0]), "ok": ("bool", [True, False, True]),
        "name": ("std::string", ["a", "é" * 40, ""]), "xyz.px": ("vec3<double>", [[1.0, 2.0, 3.0]] * 3), "bbox": ("int6", [[0, 1, 2, 3, 4, 5]] * 3), "hkl": ("miller::index<>", [[1, -2, 3]] * 3),
        "box": ("Shoebox<>", [box, {**box, "data": None, "mask": None, "background": None}, box]),
    }
    raw = table_file.encoded({0: "first", 7: "second"}, columns, 3)
    assert table_file.decoded(raw) == ({0: "first", 7: "second"}, 3, {k: v for k, (_, v) in columns.items()})
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.refl").write_bytes(raw)
    import gzip

    (tmp_path / "f/b.refl").write_bytes(gzip.compress(raw))
    df = formats.read(spark, str(tmp_path / "f"), "auto")
    assert df.count() == 6 and df.where("row = 1").select("name", "xyz_px", "box.panel", "d").distinct().first()[:] == ("é" * 40, [1.0, 2.0, 3.0], 1, float("inf"))
    assert {(r.id, r.identifier) for r in table_file.identifiers(spark, str(tmp_path / "f")).collect()} == {(0, "first"), (7, "second")}
    (tmp_path / "g").mkdir()
    assert table_file.write(df.select("id", "d"), str(tmp_path / "g"), {"id": "int", "d": "double"}) >= 1
    again = table_file.read(spark, str(tmp_path / "g"))
    assert sorted((r.id, r.d) for r in again.collect()) == sorted([(0, 1.5), (-1, float("inf")), (7, -2.0)] * 2)
    for broken in (raw[:-4], table_file.packed(["other", 2, {}]), table_file.packed(["reflection_table", 9, {}])):
        with pytest.raises(ValueError):
            table_file.decoded(broken)
    for value in (0, 127, 128, -1, -33, 1 << 63, -(1 << 40), 1.25, None, True, "x" * 300, b"\x00" * 5, [1, [2]], {"a": 1}):
        assert table_file.Unpacker(table_file.packed(value)).value() == value


def test_text_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2, 3, 250_000.0, 10.0, 5.0, 1, 0.123456)], "row_id long, h int, k int, l int, value double, sigma double, z double, batch int, x double")
    formats.write(df, str(tmp_path / "s"), "shelx")
    assert spark.read.text(str(tmp_path / "s")).first()[0] == "   1   2   325000.00    1.00   1"
    formats.write(df, str(tmp_path / "m"), "mmcif")
    text = [r[0] for r in spark.read.text(str(tmp_path / "m/part=0")).collect()]
    assert text[0] == "loop_" and len(text) == 8
    assert formats.lines(df, "best", ["h"]).first()[0] == "   1    2    3  250000.00      10.00"
    with pytest.raises(ValueError):
        formats.scale_to_fit(df.withColumn("h", F.lit(1000)), "shelx")
    assert json.loads(formats.reciprocal_json(df.withColumn("id", F.lit(3)), ["x", "x", "x"], 2).first()[0]) == {"rlp": [0.12] * 3, "experiment_id": 3}
    side = formats.aligned({"a": df.select("h", "value"), "b": df.select((F.col("h") + 1).alias("h"), "value")}, ["h"], ["value"])
    assert sorted(r[:] for r in side.collect()) == sorted([(1, 250_000.0, None), (2, None, 250_000.0)])
    with pytest.raises(KeyError):
        formats.as_indexed_array(df, ["h"], "sum")


def test_plugins_and_programs(spark):
    assert plugins.extensions("background")[0] == "simple" and plugins.load("centroid") is shoebox.centroid_of
    with pytest.raises(KeyError):
        plugins.load("centroid", "none")
    told = []
    s = plugins.Subject(["done"])
    s.attach("done", "a", lambda _: told.append(1))
    s.notify("done")
    s.detach("done", "a")
    s.notify("done")
    assert told == [1]
    df = spark.createDataFrame([(i, i % 3, float(i), i % 2 * 4) for i in range(30)], "row_id long, id int, z double, flags long")

    class Doubler(plugins.Executor):
        def process(self, rows):
            return rows.assign(z=rows["z"] * 2)

    assert sorted(r.z for r in plugins.run_jobs(df, "id", Doubler, df.schema).collect()) == [2.0 * i for i in range(30)]
    assert programs.run("sort_reflections", df, key="z", reverse=True, head=2).collect()[0].row_id == 29
    assert programs.run("split_experiments", df, chunk_size=2).select("chunk").distinct().count() == 2
    assert programs.run("merge_reflection_lists", df, df, how="extend").count() == 60
    with pytest.raises(ValueError):
        programs.run("merge_reflection_lists", df, df.limit(3))
    blanks = programs.run("detect_blanks", df.where("z < 5 OR z > 20"), loss=0.1, by="id").where("id = 0").collect()
    assert (1, 2) in [(r["first"], r["last"]) for r in blanks] and (4, 20) in [(r["first"], r["last"]) for r in blanks]
    assert programs.run("show", df).count() == 4 and programs.run("version", df).first()[0] == programs.VERSION
    with pytest.raises(KeyError):
        programs.run("unknown", df)


def test_binners(spark):
    df = spark.createDataFrame([(float(d),) for d in (1.5, 2.0, 3.0, 9.0)], "d double")
    assert [r[0] for r in df.select(binning.step_bin(F.col("d"), 1.5, 9.0, bins=4)).collect()] == [3, 2, 0, 0]
    assert [r.n for r in binning.shell_counts(df, F.col("d"), 1.5, 9.0, 3).orderBy("bin").collect()] == [2, 1, 1]
    assert binning.log_edges(1, 100, 2) == pytest.approx([1, 10])
    assert binning.merge_small([50, 3, 4, 60], [1, 2, 3, 4], 10) == [1, 4]
    r = binning.bin_variances(df, F.lit(0), "d", 2).orderBy("bin").collect()
    assert r[0].variance == pytest.approx(np.var([1.5, 2, 3, 9])) and r[1].variance == 0
    square = spark.range(1).select(scalar.polygon_area(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))))))
    assert square.first()[0] == 6.0
