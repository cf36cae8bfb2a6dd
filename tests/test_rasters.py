import math
import random

import numpy as np
from brute import segment_distance
from pyspark.sql import functions as F

from netresil.functions.projection import utm_to_wgs84, wgs84_to_utm
from netresil.operators import raster as R
from netresil.operators import resample as RS
from netresil.operators import skeleton as SK
from netresil.operators import spatial as S
from netresil.operators.catalog import fuzzy_match_tiles
from netresil.operators.population import population_in_zone
from netresil.operators.raster import Grid


def pixels(spark, a, name="value"):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(a)], f"r long, c long, {name} double")


def setpx(spark, pts):
    return spark.createDataFrame(sorted(pts), "r long, c long")


def as_array(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row["r"], row["c"]] = row[name]
    return out


def test_projection_round_trip(spark):
    pts = spark.createDataFrame([(72.5714, 23.0225), (75.0, 1.0), (70.5, 45.0), (77.9, 60.0)], "lon double, lat double")
    x, y = wgs84_to_utm(F.col("lon"), F.col("lat"))
    lon, lat = utm_to_wgs84(F.col("x"), F.col("y"))
    for r in pts.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).collect():
        assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9


def test_percentiles_match_numpy(spark):
    rnd = random.Random(1)
    rows = [(k, float(rnd.choice([rnd.randint(0, 9), rnd.random()]))) for k in (1, 2) for _ in range(500 + k)]
    got = R.exact_percentiles(spark.createDataFrame(rows, "k long, v double").repartition(5), "v", [0.02, 0.5, 0.98], ["k"])
    for r in got.collect():
        want = np.percentile([v for k, v in rows if k == r.k], [2, 50, 98])
        assert np.allclose([r.p0, r.p1, r.p2], want)


def test_norm01_of_invalid_is_zero(spark):
    out = R.norm01(pixels(spark, np.array([[0.0, -1.0], [0.0, 0.0]])))
    assert {r.value for r in out.collect()} == {0.0}


def test_distance_transform(spark):
    rnd = np.random.default_rng(0)
    m = (rnd.random((14, 11)) < 0.8).astype(int)
    m[:, 4] = 1  # a column without background
    df = spark.createDataFrame([(r, c, int(v)) for (r, c), v in np.ndenumerate(m)], "r long, c long, mask int")
    got = as_array(R.distance_to_background(df), m.shape, "dist")
    zeros = np.argwhere(m == 0)
    for r, c in np.argwhere(m == 1):
        assert abs(got[r, c] - np.sqrt(((zeros - [r, c]) ** 2).sum(1)).min()) < 1e-9


def test_distance_transform_on_wide_runs_and_without_background(spark):
    rnd = np.random.default_rng(5)
    frames, want = [], {}
    for k, (shape, rate) in enumerate([((40, 37), 0.97), ((9, 60), 0.995), ((25, 25), 0.5), ((4, 5), 1.0), ((3, 4), 0.0)]):
        m = (rnd.random(shape) < rate).astype(int)
        zeros = np.argwhere(m == 0)
        frames += [(k, r, c, int(v)) for (r, c), v in np.ndenumerate(m)]
        for r, c in np.argwhere(m == 1):
            want[k, int(r), int(c)] = float(np.sqrt(((zeros - [r, c]) ** 2).sum(1)).min()) if len(zeros) else None
    df = spark.createDataFrame(frames, "raster long, r long, c long, mask int").repartition(5)
    rows = R.distance_to_background(df, ["raster"]).collect()
    assert len(rows) == len(want) and {(p.raster, p.r, p.c): p.dist for p in rows} == want


def test_distance_transform_has_no_frame_that_looks_ahead(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "r long, c long, mask int")
    plan = R.distance_to_background(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_envelope_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(2000):
        n = rnd.randint(1, 12)
        c0 = rnd.randint(0, 5)
        cols = list(range(c0, c0 + n))
        heights = [rnd.choice([None, rnd.randint(1, 9)]) for _ in cols]
        lo, hi = rnd.choice([None, c0 - 1]), rnd.choice([None, c0 + n])
        feet = [(c, g) for c, g in zip(cols, heights) if g is not None] + [(e, 0) for e in (lo, hi) if e is not None]
        want = [min(((c - u) ** 2 + g * g for u, g in feet), default=None) for c in cols]
        assert R._envelope(lo, hi, cols, heights) == want


def test_population_by_sums_equals_counting_cells(spark):
    rnd = random.Random(8)
    h, w = 23, 31
    a = np.array([[rnd.choice([0.0, -3.0, float("nan"), round(rnd.random() * 9, 3)]) for _ in range(w)] for _ in range(h)])
    some = [(r, c, float(v)) for (r, c), v in np.ndenumerate(a) if rnd.random() < 0.9]  # cells without a row
    some += [(3, 4, 2.5), (3, 4, 2.5)]  # repeated pixels
    off = [(-1, 3, 50.0), (2, -1, 50.0), (h, 2, 50.0), (2, w, 50.0)]  # outside the raster
    pix = spark.createDataFrame(some + off, "r long, c long, value double")
    zones = [(i, rnd.uniform(-300, 3400), rnd.uniform(-300, 2600), rnd.choice([0.0, 40.0, 100.0, 333.3, 900.0, 9000.0])) for i in range(120)]
    zones += [(900, 1050.0, 1050.0, 100.0), (901, 1050.0, 1050.0, 500.0), (902, None, 5.0, 50.0), (903, 5.0, 5.0, None)]
    zdf = spark.createDataFrame(zones, "incident_id long, x double, y double, radius_m double")
    for g in (Grid(h, w, 100.0, 0.0, 0.0, 0.0, 100.0, 0.0), Grid(h, w, 100.0, 0.0, 0.0, 0.0, -100.0, 2300.0)):
        for shape in ("square", "disc"):
            got = {r.incident_id: r.population_affected for r in population_in_zone(zdf, pix, g, shape=shape).collect()}
            assert len(got) == len(zones)
            for i, x, y, rad in zones:
                s = 0
                for r, c, v in some:
                    if x is None or rad is None or not v > 0:
                        continue
                    dx, dy = g.c + g.a * (c + 0.5) - x, g.f + g.e * (r + 0.5) - y
                    near = max(abs(dx), abs(dy)) <= rad + 1e-7 if shape == "square" else math.hypot(dx, dy) <= rad
                    s += round(v * 1000) if near else 0
                assert got[i] == s // 1000, (shape, i)


def test_tiles_reflect_and_stitch_back(spark):
    a = np.random.default_rng(1).random((20, 7))
    tiles = R.extract_tiles(pixels(spark, a), a.shape, 12, 4)
    assert R.tile_origins(20, 12, 4) == [0, 8] and R.tile_origins(7, 12, 4) == [0]
    one = {(r.tr, r.tc): r.value for r in tiles.where("r0 = 8").collect()}
    padded = np.pad(a[8:20], ((0, 0), (0, 5)), mode="reflect")
    assert len(one) == 144 and all(one[k] == padded[k] for k in one)
    assert np.allclose(as_array(R.stitch(tiles, a.shape), a.shape), a)


def test_focal_max_and_dilate(spark):
    a = np.random.default_rng(2).random((9, 8))
    got = as_array(R.focal_max(pixels(spark, a), 5), a.shape)
    for (r, c), _ in np.ndenumerate(a):
        assert got[r, c] == a[max(0, r - 2):r + 3, max(0, c - 2):c + 3].max()
    ball = {(r.r, r.c) for r in R.dilate(setpx(spark, [(5, 5)]), 3).collect()}
    assert ball == {(5 + i, 5 + j) for i in range(-3, 4) for j in range(-3, 4) if abs(i) + abs(j) <= 3}


def test_align_sum_preserves_total(spark):
    a = np.random.default_rng(3).random((12, 9))
    src = Grid(12, 9, 30.0, 0.0, 100.0, 0.0, -30.0, 1000.0)
    dst = Grid(9, 9, 47.0, 0.0, 90.0, 0.0, -47.0, 1010.0)
    assert math.isclose(RS.align_sum(pixels(spark, a), src, dst).agg(F.sum("value")).first()[0], a.sum())


def test_align_bilinear_identity_and_midpoints(spark):
    a = np.arange(20.0).reshape(4, 5)
    g = Grid(4, 5, 10.0, 0.0, 0.0, 0.0, -10.0, 40.0)
    assert np.allclose(as_array(RS.align_bilinear(pixels(spark, a), g, g), a.shape), a)
    half = Grid(3, 4, 10.0, 0.0, 5.0, 0.0, -10.0, 35.0)
    got = as_array(RS.align_bilinear(pixels(spark, a), g, half), (3, 4))
    assert np.allclose(got, (a[:-1, :-1] + a[1:, :-1] + a[:-1, 1:] + a[1:, 1:]) / 4)


def test_rasterize_long_diagonal(spark):
    g = Grid(40, 40, 10.0, 0.0, 0.0, 0.0, -10.0, 400.0)
    seg = (13.0, 377.0, 371.0, 52.0)
    got = {(r.r, r.c) for r in RS.rasterize_lines(spark.createDataFrame([seg], "ax double, ay double, bx double, by double"), g, 2.0).collect()}
    want = {(r, c) for r in range(40) for c in range(40) if segment_distance(c * 10 + 5, 400 - r * 10 - 5, *seg) <= 20}
    assert got == want


def test_road_aware_crop_takes_the_first_try_with_enough_road(spark):
    rnd, size, tries = random.Random(9), 6, 10
    shape, need = (15, 13), 9
    rows = [(t, r, c, int(rnd.random() < rate)) for t, rate in enumerate((0.0, 0.05, 0.2, 0.3, 0.6, 1.0)) for r in range(15) for c in range(13)]
    df = spark.createDataFrame(rows, "tile long, r long, c long, mask int")
    road = {(t, r, c) for t, r, c, m in rows if m}
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(42), F.lit(k), "tile", "t"), F.lit(n))
    tried = df.select("tile").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).select(
        "tile", "t", draw(1, shape[0] - size + 1).alias("r0"), draw(2, shape[1] - size + 1).alias("c0")).collect()
    inside = lambda t, r0, c0: sum((t, r, c) in road for r in range(r0, r0 + size) for c in range(c0, c0 + size))
    got = {p.tile: (p.r0, p.c0, p.road) for p in R.road_aware_crop(df, shape, size, need, tries, seed=42).collect()}
    assert len(got) == 6
    for tile, crop in got.items():
        mine = [(p.r0, p.c0, inside(tile, p.r0, p.c0)) for p in sorted(tried, key=lambda p: p.t) if p.tile == tile]
        enough = [m for m in mine if m[2] >= need]
        want = enough[0] if enough else max(mine, key=lambda m: m[2])
        assert crop == (want if want[2] else ((15 - size) // 2, (13 - size) // 2, 0))


def thinned_whole(pts):
    """Zhang and Suen pixel by pixel over the whole picture."""
    on, ring = set(pts), [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        start = len(on)
        for three in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            gone = set()
            for r, c in on:
                b = [(r + dr, c + dc) in on for dr, dc in ring]
                rises = sum(not b[k] and b[(k + 1) % 8] for k in range(8))
                if 2 <= sum(b) <= 6 and rises == 1 and not any(all(b[k] for k in t) for t in three):
                    gone.add((r, c))
            on -= gone
        if len(on) == start:
            return on


def test_thinning_by_tiles_equals_thinning_the_whole(spark):
    rnd = random.Random(6)
    pts = {(r, c) for r in range(-20, 25) for c in range(-25, 30) if rnd.random() < 0.97}  # a block with holes
    for _ in range(12):  # wide roads across the tiles
        r, c, dr, dc = rnd.randint(30, 60), rnd.randint(-20, 40), rnd.choice([-1, 0, 1]), rnd.choice([-1, 1])
        pts |= {(r + i * dr + a, c + i * dc + b) for i in range(30) for a in range(rnd.randint(1, 6)) for b in range(5)}
    pts |= {(16, 31), (16, 32), (17, 31), (17, 32), (-40, -40)}  # a square that vanishes and a lone pixel
    rows = [*pts, (16, 31), (None, 3)]
    df = spark.createDataFrame(rows, "r long, c long").repartition(3)
    want = thinned_whole(pts)
    for tile, halo in ((16, 4), (16, 9), (256, 32)):
        got = [(p.r, p.c) for p in SK.thin(df, tile, halo).collect()]
        assert len(got) == len(want) and set(got) == want
    assert SK.thin(df.limit(0)).isEmpty()


def test_thin_and_trace_a_cross(spark):
    road = {(r, c) for r in range(21) for c in range(21) if 9 <= r <= 11 or 9 <= c <= 11}
    skel = SK.thin(setpx(spark, road))
    pts = {(r.r, r.c) for r in skel.collect()}
    assert pts <= road and len(pts) < 60
    nodes, edges = SK.trace_edges(skel, 21, 10.0)
    kinds = [r.node_type for r in nodes.collect()]
    assert kinds.count("endpoint") == 4 and kinds.count("junction") >= 1


def test_trace_lengths_by_both_rules(spark):
    line = setpx(spark, [(0, c) for c in range(7)] + [(5, 0), (5, 1)])
    for count_pixels, want in ((True, [(0, 6, 70.0), (50, 51, 20.0)]), (False, [(0, 6, 60.0), (50, 51, 10.0)])):
        _, e = SK.trace_edges(line, 10, 10.0, count_pixels=count_pixels)
        assert sorted((r.src, r.dst, r.length_m) for r in e.collect()) == want


def test_stubs_and_pixel_paths(spark):
    skel = setpx(spark, [(3, c) for c in range(10)] + [(8, 8)])
    ends = spark.createDataFrame([(1, 3, 0), (2, 8, 8)], "id long, r long, c long")
    got = {r.id: (r.ur, r.uc) for r in SK.stub_vectors(ends, skel).collect()}
    assert got[1] == (0.0, -1.0) and got[2] == (None, None)
    path = {r.id: [(p.r, p.c) for p in r.pixel_path] for r in SK.pixel_paths(ends, skel).collect()}
    assert path[1] == [(3, c) for c in range(5)] and path[2] == [(8, 8)]


def test_a_walk_holds_no_joins_of_earlier_steps(spark):
    skel = setpx(spark, [(3, c) for c in range(10)])
    ends = spark.createDataFrame([(1, 3, 0), (2, 3, 9)], "id long, r long, c long")
    walk = SK.walk_stubs(ends, skel, 5)
    assert walk._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {r.id: (r.cr, r.cc) for r in walk.collect()} == {1: (3, 5), 2: (3, 4)}


def test_bounded_reach(spark):
    skel = setpx(spark, [(0, c) for c in range(8)] + [(1, 7), (2, 6), (9, 9)])
    pairs = spark.createDataFrame([(1, 0, 0, 0, 7, 7), (2, 0, 0, 2, 6, 8), (3, 0, 0, 2, 6, 12), (4, 0, 0, 9, 9, 30)], "pair long, r1 long, c1 long, r2 long, c2 long, limit long")
    got = {r.pair: r.joined for r in SK.bounded_reach(pairs, skel).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_nearest_with_a_hot_cell(spark):
    rnd = random.Random(2)
    nodes = [(i, 500.0, 500.0) for i in range(300)] + [(i, 500 + rnd.random(), 500 + rnd.random()) for i in range(300, 600)]
    nodes += [(i, rnd.uniform(0, 4000), rnd.uniform(0, 4000)) for i in range(600, 900)]
    pts = [(i, rnd.uniform(-200, 4200), rnd.uniform(-200, 4200)) for i in range(40)] + [(i, 500.2, 500.3) for i in range(40, 60)]
    n = spark.createDataFrame(nodes, "node_id long, x double, y double")
    p = spark.createDataFrame(pts, "point_id long, x double, y double")
    for k, limit in ((1, None), (4, None), (3, 300.0)):
        got = {}
        for r in S.nearest_nodes(p, n, k, limit).orderBy("point_id", "rank").collect():
            got.setdefault(r.point_id, []).append(r.node_id)
        for i, x, y in pts:
            near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in nodes)
            want = [j for d, j in near if limit is None or d <= limit][:k]
            assert got.get(i, []) == want


def test_zones_of_unlike_sizes_meet_long_segments(spark):
    rnd = random.Random(6)
    segs = [(i, i + 1000, rnd.uniform(0, 3000), rnd.uniform(0, 3000)) for i in range(60)]
    segs = [(a, b, x, y, x + rnd.uniform(-1500, 1500), y + rnd.uniform(-1500, 1500)) for a, b, x, y in segs] + [(900, 901, 50.0, 50.0, 50.0, 50.0)]
    zones = [(i, rnd.uniform(0, 3000), rnd.uniform(0, 3000), rnd.choice([5.0, 80.0, 700.0])) for i in range(30)] + [(99, 50.0, 55.0, 5.0)]
    got = S.segments_within(spark.createDataFrame(zones, "incident_id long, x double, y double, radius_m double"),
                            spark.createDataFrame(segs, "src long, dst long, ax double, ay double, bx double, by double"))
    want = {(i, a) for i, x, y, r in zones for a, _, *s in segs if segment_distance(x, y, *s) <= r}
    assert {(r.incident_id, r.src) for r in got.collect()} == want


def test_fuzzy_names(spark):
    img = spark.createDataFrame([("A_PS-RGB_img7",), ("x_9",), ("city_a_b",), ("lonely",)], "stem string")
    vec = spark.createDataFrame([("A_geojson_roads_img7",), ("q9",), ("zz_a_b_zz",), ("other",)], "stem string")
    got = {r.stem: r.vector for r in fuzzy_match_tiles(img, vec).collect()}
    assert got == {"A_PS-RGB_img7": "A_geojson_roads_img7", "x_9": "q9", "city_a_b": "zz_a_b_zz"}


def test_fuzzy_names_against_the_rules(spark):
    from netresil.operators.catalog import IMAGE_TOKENS, VECTOR_TOKENS

    rnd = random.Random(5)
    name = lambda: rnd.choice("_-").join(rnd.choice(["", "a", "ab", "PS-RGB", "MS", "geojson", "7", "17", "b71", "RGB"]) for _ in range(rnd.randint(1, 5)))
    images = [name() for _ in range(150)]
    vectors = [name() for _ in range(40)]
    swaps = [(a, b) for a in IMAGE_TOKENS for b in VECTOR_TOKENS]
    want = {}
    for s in images:
        parts = s.replace("-", "_").split("_")
        met = [(0, v) for v in vectors if v == s]
        met += [(1 + i, v) for i, (a, b) in enumerate(swaps) for v in vectors if v == s.replace(a, b)]
        met += [(20 + n, v) for n in range(1, 5) if len(parts) >= n for v in vectors if "_".join(parts[-n:]) in v]
        met += [(30 + k, v) for k, q in enumerate(parts[::-1]) if q.isdigit() for v in vectors if v.endswith(q)]
        if met:
            want[s] = min(met)
    rows = lambda names: spark.createDataFrame([(x,) for x in [*names, None]], "stem string")
    got = {r.stem: (r.priority, r.vector) for r in fuzzy_match_tiles(rows(images), rows(vectors)).collect()}
    assert got == want


def test_fuzzy_names_send_parts_not_all_texts(spark):
    # a vector's name holds 20 texts of the asked lengths, but three parts
    from netresil.operators.catalog import contained_parts
    vec = spark.createDataFrame([(i, f"aaaa_bbbb-c{i:05d}") for i in range(50)], "pos long, vector string")
    got = {r.part: r.pos for r in contained_parts(vec, spark.createDataFrame([([4, 6],)], "lens array<int>")).collect()}
    assert got["aaaa"] == got["bbbb"] == got["c000"] == 0 and got["c00049"] == 49 and len(got) == 2 + 50 + len({f"c{i:05d}"[j:j + 4] for i in range(50) for j in range(3)})


def test_code_of_segments_on_cells_is_compiled(spark):
    segs = spark.createDataFrame([(1, 2, 0.0, 0.0, 500.0, 300.0)], "src long, dst long, ax double, ay double, bx double, by double")
    zones = spark.createDataFrame([(1, 100.0, 50.0, 80.0)], "incident_id long, x double, y double, radius_m double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = S.segments_within(zones, segs)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert max(sizes) <= 8000  # the JVM leaves longer methods to its interpreter


def test_predict_function_per_tile(spark):
    a = np.random.default_rng(4).random((16, 16))
    tiles = R.extract_tiles(pixels(spark, a), a.shape, 8, 2)
    out = as_array(R.stitch(R.score_tiles(tiles, lambda t: t["value"] * 0 + 2.0), a.shape), a.shape)
    assert np.allclose(out, 1 / (1 + math.exp(-2)))
