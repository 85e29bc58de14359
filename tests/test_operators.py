"""Analytic cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.dataset import MeshDataset
from lattica.functions import names, vectors
from lattica.operators import blocks, grid, integrate, mesh_probe, metrics, resample, scan, spatial, select, stats, temporal, topology
from lattica.plans import registry, views


@pytest.fixture(scope="module")
def mesh(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 9.0, 9.0, 9.0)], "point_idx long, x double, y double, z double")
    cells = spark.createDataFrame([(10, 5.0), (11, 7.0)], "cell_idx long, value double")
    links = spark.createDataFrame([(10, 0), (10, 1), (10, 2)], "cell_idx long, point_idx long")
    return MeshDataset(points, cells, links)


def test_empty_cells_and_orphans_are_zero(mesh):
    got = {r.cell_idx: r for r in metrics.cell_metrics(mesh).collect()}
    assert got[11].n_points == 0 and got[11].size == 0 and got[11].center_x == 0
    assert got[10].size == pytest.approx(math.sqrt(5)) and got[10].center_y == pytest.approx(2 / 3)
    assert [r.point_idx for r in select.unused_points(mesh).collect()] == [3]


def test_box_modes_are_nested(mesh):
    box = ((-0.5, -0.5, -0.5), (1.5, 1.5, 0.5))
    hit = {m: {r.cell_idx for r in select.box_mask(mesh, box, m).where("mask = 1").collect()} for m in ("all", "any", "centroid")}
    assert hit["all"] == set() and hit["any"] == hit["centroid"] == {10}
    with pytest.raises(ValueError):
        select.box_mask(mesh, box, "some")
    with pytest.raises(ValueError):
        select.inside(((1, 0, 0), (0, 1, 1)))


def test_histogram_leaves_out_the_maximum(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)], "v double")
    assert [r.n for r in stats.histogram(df, "v", 4).orderBy("bin").collect()] == [1, 1, 1, 1]
    same = spark.createDataFrame([(7.0,)] * 5, "v double")
    assert [r.n for r in stats.histogram(same, "v", 4).orderBy("bin").collect()] == [5, 0, 0, 0]
    row = stats.scalar_stats(same, "v", 4).first()
    assert (row.n, row.mean, row.min, row.max) == (5, 7.0, 7.0, 7.0)


def test_scan_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), (F.col("id") % 7).alias("v"))
    got = scan.prefix_sum(df, "k", "v", "s", rows=100).orderBy("k").collect()
    assert [r.s for r in got] == [0, *np.cumsum([r.v for r in got])[:-1].tolist()]
    assert [r.idx for r in scan.dense_index(df, "k", rows=64).orderBy("k").collect()] == list(range(1000))


def test_bracket(spark):
    known = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 500.0)], "k long, t double")
    asked = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 15.0), (1, 100.0), (1, 900.0), (2, 1.0)], "k long, t double")
    got = {(r.k, r.t): (r.lower, r.upper) for r in temporal.bracket(asked, known, "k", "t", 50.0).collect()}
    assert got == {(1, 5.0): (10, 10), (1, 10.0): (10, 10), (1, 15.0): (10, 20), (1, 100.0): (20, 500), (1, 900.0): (500, 500), (2, 1.0): (None, None)}


def test_bracket_with_a_hot_key_in_one_bucket_of_time(spark):
    rng = np.random.default_rng(5)

    def rows(n):  # key 0 has most rows, nearly all within a second, many of them at one time
        keys = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n))
        times = np.where(rng.random(n) < 0.9, rng.integers(0, 40, n) / 40, rng.integers(-1000, 1000, n).astype(float))
        return list(zip(keys.tolist(), np.where(rng.random(n) < 0.3, 0.5, times).tolist(), range(n), strict=True))

    asked, known = rows(600), [r for r in rows(80) if r[0] != 3]
    nulls = [(None, 1.0, 900), (1, None, 901)]
    q, k = spark.createDataFrame(asked + nulls, "k long, t double, id long"), spark.createDataFrame(known + nulls, "k long, t double, id long")
    want = []
    for key, t, i in asked:
        times = sorted(x[1] for x in known if x[0] == key)
        low, high = [x for x in times if x <= t], [x for x in times if x >= t]
        want.append((i, low[-1] if low else times[0] if times else None, high[0] if high else times[-1] if times else None))
    for width in (None, 50.0):
        got = temporal.bracket(q, k, "k", "t", width, rows=40).select("id", "lower", "upper").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert len(scan.key_bounds(q, "t", 40)) > 5
    after = {(r.k, r.t): r.next for r in temporal.next_sample(k.where("k is not null and t is not null"), "k", "t", rows=10).collect()}
    moments = sorted({x[:2] for x in known})
    assert after == {x: next((y[1] for y in moments if y[0] == x[0] and y[1] > x[1]), None) for x in moments}


def linear_nodes(spark, g):
    return grid.grid_points(spark, g).withColumn("value", F.expr("2 * x - 3 * y + z + 1"))


def test_linear_field_is_exact_on_a_grid(spark):
    g = grid.ImageGrid((1.0, 2.0, 3.0), (0.5, 1.0, 2.0), (0, 0, 0), (4, 3, 2))
    samples = spark.createDataFrame([(0, 1.3, 2.7, 4.1), (1, 3.0, 5.0, 7.0), (2, 3.01, 2.0, 3.0), (3, 1.0, 2.0, 3.0)], "id long, x double, y double, z double")
    got = {r.id: r for r in grid.probe(samples, linear_nodes(spark, g), g).collect()}
    for r in got.values():
        assert r.mask == (r.id != 2)
        assert r.probed_value == pytest.approx(2 * r.x - 3 * r.y + r.z + 1 if r.mask else 0.0)
    assert got[1].cell_idx == 4 * 3 * 2 - 1  # the upper face belongs to the last cell
    assert grid.cell_points(spark, g).count() == 24 * 8


@pytest.mark.parametrize("resolution", [3, 4, 16, 128])
@pytest.mark.parametrize("low, high", [((0.0, 0.0, 0.0), (10.0, 4.0, 1.0)), ((-3.3, 2.0, 7.1), (1.7, 2.5, 7.2)), ((-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)), ((2.0, 2.0, 2.0), (2.0, 2.0, 2.0))])
def test_fit_encloses_bounds(resolution, low, high):
    first, last, size = grid.fit_voxels(low, high, resolution)
    assert max(b - a for a, b in zip(first, last)) <= resolution
    assert all(a * size < x for a, x in zip(first, low)) and all(b * size > x for b, x in zip(last, high))
    if high != low:  # no more than two layers coarser than it could be
        assert max(b - a for a, b in zip(low, high)) / size >= resolution - 2 - 1e-9 or resolution < 5


def test_regions():
    assert grid.region((0.0, 0.0, 0.0), (10.0, 10.0, 10.0), ((5.0, -1.0, 2.0), (20.0, 3.0, 4.0)), 10) == ((4.75, -0.15, 1.9), (10.25, 3.15, 4.1))
    with pytest.raises(ValueError):
        grid.region((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), ((2.0, 0.0, 0.0), (3.0, 1.0, 1.0)))
    assert grid.voxel_extents((0.1, 0.0, 1.0), (0.9, 1.0, 2.2), 0.5) == ((0, -1, 1), (2, 3, 5))


def test_plane_quad():
    quad = grid.plane_quad((0.5, 0.5, 0.25), (0.0, 0.0, 1.0), (0, 0, 0), (1, 2, 3))
    assert [tuple(round(x, 9) for x in p) for p in quad] == [(0, 0, 0.25), (1, 0, 0.25), (1, 2, 0.25), (0, 2, 0.25)]
    assert grid.plane_quad((9.0, 9.0, 9.0), (0.0, 0.0, 1.0), (0, 0, 0), (1, 1, 1)) == [(9.0, 9.0, 9.0)] * 4
    for axis in range(3):  # the box's own faces and its middle
        normal = tuple(float(axis == a) for a in range(3))
        for at in (-0.5, 0.0, 0.5):
            centre = tuple(at * n for n in normal)
            corners = np.array(grid.plane_quad(centre, normal, (-0.5,) * 3, (0.5,) * 3))
            assert np.allclose(corners[:, axis], at)
            assert all(sorted(corners[:, a].round(6)) == [-0.5, -0.5, 0.5, 0.5] for a in range(3) if a != axis)
    tilted = np.array(grid.plane_quad((0.0, 0.0, 0.0), (0.5**0.5, 0.5**0.5, 0.0), (-1,) * 3, (1,) * 3))
    assert np.abs(tilted).max() <= 1 + 1e-9 and np.allclose(tilted @ (1, 1, 0), 0)
    # Six corners of the cut through all axes: the rectangle touches each side.
    u, v = (np.array(a) for a in grid.plane_axes((1.0, 1.0, 1.0)))
    hexagon = np.array([p for p in itertools.product((-1, 0, 1), repeat=3) if sum(p) == 0 and any(p)], float)
    quad = np.array(grid.plane_quad((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (-1,) * 3, (1,) * 3))
    for w in (u, v):
        assert (quad @ w).max() == pytest.approx((hexagon @ w).max()) and (quad @ w).min() == pytest.approx((hexagon @ w).min())


def test_tetrahedra(spark):
    rows = [(5, 10, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]), (4, 10, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 1.0)])]
    rows.append((1, 10, [(0.1, 0.2, 0.3)] * 2 + [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]))  # a flat one holds nothing
    tetra = spark.createDataFrame([(c, t, [(0, n, n, *p) for n, p in enumerate(ps)]) for c, t, ps in rows], "cell_idx long, cell_type int, corners array<struct<face:long,pos:int,point_idx:long,x:double,y:double,z:double>>")
    samples = spark.createDataFrame([(0, 0.1, 0.2, 0.3), (1, 0.5, 0.5, 0.0), (2, 2.0, 2.0, 2.0)], "id long, x double, y double, z double")
    got = {r.id: r for r in spatial.located(samples, "id", tetra, 0).collect()}
    assert got[0].cell_idx == 5 and list(got[0].weights) == pytest.approx([0.4, 0.1, 0.2, 0.3])
    assert got[1].cell_idx == 4 and set(got) == {0, 1}  # a shared face goes to the smaller cell


def test_gaussian_of_a_constant_is_constant(spark):
    points = spark.range(50).select(F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"), F.lit(4.0).alias("value"))
    samples = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    got = {r.id: r.value for r in resample.gaussian(samples, points, 0.5, 2.0, ["id"]).collect()}
    assert got[0] == pytest.approx(4.0) and got[1] == 0.0


def test_faces_of_two_cubes(spark):
    dims = (3, 2, 2)
    at = lambda i, j, k: k * 6 + j * 3 + i
    cube = lambda i: [at(i + a, b, c) for a, b, c in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))]
    cells = spark.createDataFrame([(0, 12, cube(0)), (1, 12, cube(1))], "cell_idx long, cell_type int, pts array<long>")
    assert topology.cell_faces(cells).count() == 12 and topology.external_faces(cells).count() == 10
    points, faces = topology.compacted(topology.cell_faces(cells))
    assert points.count() == math.prod(dims) and faces.count() == 12


GRID = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0, 0, 0), (8, 8, 2))


def flow(spark, vx, vy):
    return grid.grid_points(spark, GRID).select("i", "j", "k", F.expr(vx).cast("double").alias("vx"), F.expr(vy).cast("double").alias("vy"), F.lit(0.0).alias("vz"))


def test_uniform_flow_is_straight(spark):
    seeds = spark.createDataFrame([(0, 1.0, 4.0, 1.0), (1, 99.0, 0.0, 0.0)], "seed_idx long, x double, y double, z double")
    line = integrate.streamlines(seeds, flow(spark, "3", "0"), GRID, "both").orderBy("seq").collect()
    assert {r.seed_idx for r in line} == {0} and all(r.y == 4.0 and 0 <= r.x <= 8 for r in line)
    assert all(r.t == pytest.approx(r.x - 1.0) for r in line) and line[0].x < 1.0 < line[-1].x
    with pytest.raises(ValueError):
        integrate.streamlines(seeds, flow(spark, "1", "0"), GRID, "up")


def test_rotation_keeps_its_radius(spark):
    """Steps are as long as asked, so a line drifts outwards by h^3 / 24 R^2 a step; short steps keep it in."""
    seeds = spark.createDataFrame([(0, 6.0, 4.0, 1.0)], "seed_idx long, x double, y double, z double")
    line = integrate.streamlines(seeds, flow(spark, "4 - y", "x - 4"), GRID, "forward", initial=0.05, most=0.05, steps=60).collect()
    assert len(line) > 20 and all(math.hypot(r.x - 4, r.y - 4) == pytest.approx(2.0, abs=1e-3) for r in line)


def test_blocks_take_the_same_steps(spark):
    """A swirl over small blocks, with a block that many lines share, against the whole grid at once."""
    space = grid.ImageGrid((1.0, 0.0, -2.0), (1.0, 0.5, 2.0), (2, 0, 0), (42, 36, 12))
    nodes = grid.grid_points(spark, space).select("i", "j", "k", F.expr("9 - y + 0.1 * z").alias("vx"), F.expr("x - 22").alias("vy"), F.expr("sin(x) + 0.3").alias("vz"))
    rnd = np.random.default_rng(3)
    seeds = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rnd.random((60, 3)) * (40, 18, 24) + (3, 0, -2))], "seed_idx long, x double, y double, z double")
    for direction in ("both", "backward"):
        whole, parts = (integrate.streamlines(seeds, nodes, space, direction, block=b, steps=40, most=0.5).orderBy("seed_idx", "seq").collect() for b in (None, 7))
        assert len(whole) > 1000 and [(r.seed_idx, r.seq, r.cell_idx) for r in whole] == [(r.seed_idx, r.seq, r.cell_idx) for r in parts]
        assert np.allclose([tuple(r)[2:6] for r in whole], [tuple(r)[2:6] for r in parts], atol=1e-9)


def test_small_functions(spark):
    assert vectors.colour_table([(0.0, (0.0,)), (1.0, (2.0,))], 3) == [(0.0,), (1.0,), (2.0,)]
    assert names.parse_slices("1:5, ::2, -3:, {ts}", ts=4) == (slice(1, 5), slice(None, None, 2), slice(-3, None), slice(4, 5))
    assert names.identifier("2 a-b") == "_2_a_b"
    assert stats.rescaled("grow", (0.0, 1.0), (0.5, 2.0)) == (0.0, 2.0) and stats.rescaled("clamp", (0.0, 1.0), (0.5, 2.0)) == (0.5, 2.0)
    row = spark.range(1).select(vectors.remap(F.lit(5.0), (0, 10), (0, 1)).alias("a"), vectors.remap(F.lit(5.0), (9, 1), (0, 1)).alias("b"), vectors.remap(F.lit(5.0), (3, 3), (2, 8)).alias("c"), vectors.truncate(F.lit(-0.5)).cast("int").alias("d")).first()
    assert tuple(row) == (0.5, 5.0, 2.0, 0)


def test_registry(mesh):
    assert registry.resolve("bounds", {"mesh"}).run(mesh).count() == 1
    with pytest.raises(NotImplementedError):
        registry.resolve("fly", {"mesh"})


@pytest.mark.parametrize("corners", [
    [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1.2, 1.1, 1.3), (0, 1, 1)],
    [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1.2), (0, 1, 1)],
    [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.4, 0.5, 1)],
])
def test_shape_weights_reproduce_positions(corners):
    from lattica.operators import shapes

    corners = np.array(corners, float)
    rng = np.random.default_rng(1)
    mix = rng.dirichlet(np.ones(len(corners)), 200)
    positions = mix @ corners
    w, ok = shapes.weights(positions, np.repeat(corners[None], 200, axis=0))
    assert ok.mean() > 0.9 and np.allclose(w.sum(axis=1), 1) and np.allclose(w[ok] @ corners, positions[ok], atol=1e-6)
    w, ok = shapes.weights(corners[:1] - 0.5, corners[None])
    assert not ok[0]


def test_polyhedra_are_exact_for_linear_fields(spark):
    """A cube whose faces are five quadrilaterals and two triangles, and a point outside."""
    at = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    points = spark.createDataFrame([(i, *map(float, p), 2.0 * p[0] - p[1] + 3 * p[2]) for i, p in enumerate(at)], "point_idx long, x double, y double, z double, value double")
    rings = [list(f) for f in topology.FACES[12]]
    rings = [*rings[:5], rings[5][:3], [rings[5][0], *rings[5][2:]]]
    faces = spark.createDataFrame([(7, i, r) for i, r in enumerate(rings)], "cell_idx long, face_idx int, face_pts array<long>")
    cells = spark.createDataFrame([(7, 42, list(range(8)))], "cell_idx long, cell_type int, pts array<long>")
    samples = spark.createDataFrame([(0, 0.2, 0.7, 0.4), (1, 1.0, 1.0, 1.0), (2, 1.2, 0.7, 0.4)], "id long, x double, y double, z double")
    got = {r.id: r for r in mesh_probe.probe_mesh(samples, "id", cells, points, faces).collect()}
    assert got[0].value == pytest.approx(0.4 - 0.7 + 1.2) and got[1].value == pytest.approx(4.0) and got[0].cell_idx == 7
    assert (got[2].mask, got[2].value) == (0, 0.0)
    with pytest.raises(ValueError):
        mesh_probe.probe_mesh(samples, "id", cells.withColumn("cell_type", F.lit(9)), points)


def cubes(rng, n):
    """Boxes of sizes that differ a thousandfold, as corner lists in a hexahedron's order."""
    size = 10.0 ** rng.uniform(-2, 1, (n, 3))
    low = rng.uniform(0, 10, (n, 3))
    unit = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)])
    return low[:, None] + unit * size[:, None]


CORNERS = "cell_idx long, cell_type int, corners array<struct<face:long,pos:int,point_idx:long,x:double,y:double,z:double,v0:double>>"


@pytest.mark.parametrize("per_leaf", [None, 7])
def test_location_among_cells_of_any_size(spark, per_leaf, monkeypatch):
    """In one box of space and in many, with many samples in one place, against all pairs."""
    monkeypatch.setattr(spatial, "POSITIONS", 100)
    rng = np.random.default_rng(2)
    at = cubes(rng, 150)
    cells = spark.createDataFrame([(int(k), 12, [(0, n, n, *map(float, p), float(p.sum())) for n, p in enumerate(c)]) for k, c in enumerate(at)], CORNERS)
    p = np.concatenate([rng.uniform(0, 12, (300, 3)), at[:40].reshape(-1, 3), at[3].mean(axis=0) + rng.normal(0, 1e-3, (400, 3))])
    samples = spark.createDataFrame([(int(i), *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    inside = ((p[:, None] >= at.min(axis=1) - 1e-9) & (p[:, None] <= at.max(axis=1) + 1e-9)).all(axis=2)
    want = {i: int(np.flatnonzero(row)[0]) for i, row in enumerate(inside) if row.any()}
    got = {r.id: r for r in spatial.located(samples, "id", cells, 1, per_leaf).collect()}
    assert {i: r.cell_idx for i, r in got.items()} == want
    assert all(r["values"][0] == pytest.approx(p[i].sum()) for i, r in got.items())


def test_splits_send_boxes_to_all_leaves_they_meet():
    rng = np.random.default_rng(4)
    centres = np.concatenate([rng.uniform(0, 1, (500, 3)), np.full((200, 3), 0.5)])
    tree = spatial.splits(centres, 16)
    p = rng.uniform(-0.2, 1.2, (300, 3))
    leaf = tree.leaf_of(p)
    assert 8 <= len(set(leaf.tolist())) <= 16 and leaf.min() >= 0 and leaf.max() < tree.leaves
    reach = rng.uniform(0, 0.2, tree.leaves)
    for grown in (None, reach):
        far = 0.05 if grown is None else 0.05 + grown[leaf][:, None]
        centre = p + rng.uniform(-1, 1, p.shape) * far
        row, met = tree.meeting(centre - 0.05, centre + 0.05, grown)
        assert set(zip(range(300), leaf.tolist())) <= set(zip(row.tolist(), met.tolist()))
        assert len(set(zip(row.tolist(), met.tolist()))) == len(row)
    assert spatial.splits(np.zeros((9, 3)), 4).leaves == 1 and (spatial.splits(np.zeros((0, 3)), 1).leaf_of(p) == 0).all()


def mixed_mesh(spark):
    """Two unit cubes side by side, as a hexahedron and a polyhedron, with a linear point field and a cell field."""
    at = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1, 2)]
    points = spark.createDataFrame([(i, *map(float, p), float(2 * p[0] - p[1] + 3 * p[2])) for i, p in enumerate(at)], "point_idx long, x double, y double, z double, value double")
    pts = lambda o: [o, o + 1, o + 4, o + 3, o + 6, o + 7, o + 10, o + 9]
    cells = spark.createDataFrame([(0, 12, pts(0), 10.0), (1, 42, pts(1), 20.0)], "cell_idx long, cell_type int, pts array<long>, heat double")
    faces = spark.createDataFrame([(1, i, [pts(1)[n] for n in f]) for i, f in enumerate(topology.FACES[12])], "cell_idx long, face_idx int, face_pts array<long>")
    return cells, points, faces


@pytest.mark.parametrize("association", ["cell", "point"])
def test_voxels_of_a_mixed_mesh(spark, association):
    cells, points, faces = mixed_mesh(spark)
    low, high, size = (-1, 0, 0), (5, 2, 1), (0.5, 0.5, 0.5)
    shift = 0.25 if association == "cell" else 0.0
    got = {(r.i, r.j, r.k): r for r in mesh_probe.voxelize(cells, points, low, high, size, association, faces).collect()}
    heat = {(r.i, r.j, r.k): r for r in mesh_probe.voxelize(cells, points, low, high, size, association, faces, -1.0, "heat", True).collect()}
    assert len(got) == len(heat) == 7 * 3 * 2
    for (i, j, k), r in got.items():
        x, y, z = (n / 2 + shift for n in (i, j, k))
        inside = 0 <= x <= 2 and y <= 1 and z <= 1
        assert (r.mask, heat[i, j, k].mask) == (inside, inside)
        assert r.value == pytest.approx(2 * x - y + 3 * z if inside else -1.0)
        assert heat[i, j, k].value == ((10.0 if x <= 1 else 20.0) if inside else -1.0)


def test_slices_of_a_mixed_mesh(spark):
    cells, points, faces = mixed_mesh(spark)
    got = {(r.slice, r.col, r.row): r for r in mesh_probe.slices(cells, points, "xyz", (1.5, 0.5, 0.5), 4, 4, faces=faces).collect()}
    want = {(r.slice, r.col, r.row): r for r in mesh_probe.probe_mesh(plane_samples(spark), "key", cells, points, faces).collect()}
    assert len(got) == 48 and {k: (r.mask, r.cell_idx, round(r.value, 9)) for k, r in got.items()} == {k: (r.mask, r.cell_idx, round(r.value, 9)) for k, r in want.items()}
    free = mesh_probe.slices(cells, points, "free", (0.5, 0.5, 0.5), 6, 6, (1.0, 1.0, 0.0), faces)
    assert {r.cell_idx for r in free.collect()} >= {0}
    assert mesh_probe.cut_cells(spatial.solids(cells, points, ["value"], faces), [(1.0, 0.0, 0.0)], (1.5, 0.5, 0.5)).count() == 1


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_streamlines_of_a_grid_written_as_cells(spark, direction):
    """One box of space and many, and the gridded way, take the same steps."""
    space = grid.ImageGrid((0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (0, 0, 0), (12, 10, 8))
    nodes = grid.grid_points(spark, space).selectExpr("point_idx", "i", "j", "k", "x", "y", "z", "3 - y AS vx", "x - 2.5 AS vy", "0.2 + 0.1 * z AS vz", "x + y AS sum")
    corners = grid.cell_points(spark, space)
    cells = topology.unstructured(nodes, corners).withColumn("cell_type", F.lit(12))
    rng = np.random.default_rng(8)
    seeds = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-0.2, 5.5, (60, 3)))], "seed_idx long, x double, y double, z double")
    options = {"steps": 30, "most": 0.5}
    line = lambda df: [(r.seed_idx, r.seq, *(round(r[c], 6) for c in "xyzt"), r.cell_idx) for r in df.orderBy("seed_idx", "seq").collect()]
    want = line(integrate.streamlines(seeds, nodes, space, direction, **options))
    assert len(want) > 200
    for per_leaf in (None, 60):
        lines = integrate.mesh_streamlines(seeds, cells, nodes, ["vx", "vy", "vz"], direction, fields=("sum",), per_leaf=per_leaf, **options)
        assert line(lines) == want
        assert all(r["sum"] == pytest.approx(r.x + r.y) for r in lines.collect())


def test_streamlines_through_polyhedra_and_nothing(spark):
    cells, points, faces = mixed_mesh(spark)
    flow = points.withColumns({"u": F.lit(1.0), "v": F.lit(0.0), "w": F.lit(0.0)})
    seeds = spark.createDataFrame([(0, 0.1, 0.4, 0.3), (1, 7.0, 0.0, 0.0)], "seed_idx long, x double, y double, z double")
    got = views.mesh_streamlines(seeds, cells, flow, ["u", "v", "w"], ["value"], "forward", faces=faces, most=0.2).orderBy("seq").collect()
    assert {r.seed_idx for r in got} == {0} and {r.cell_idx for r in got} == {0, 1} and got[-1].x <= 2 and got[-1].x > 1.6
    assert all(r.value == pytest.approx(2 * r.x - r.y + 3 * r.z) and r.t == pytest.approx(r.x - 0.1) for r in got)
    short = views.mesh_streamlines(seeds, cells, flow, ["u", "v", "w"], ["value"], "forward", 0.5, faces, most=0.2).collect()
    assert 1 < len(short) < len(got) and max(r.t for r in short) <= 0.5
    voxels, space = views.mesh_volume(cells, points, 8, faces=faces)
    assert voxels.where("mask = 1").count() > 30 and max(space.point_dims) <= 9


def test_sparse_blocks_and_back(spark):
    rng = np.random.default_rng(9)
    at = {tuple(map(int, p)) for p in rng.integers(-12, 20, (600, 3))} | {(i, j, 0) for i in range(8) for j in range(8)} | {(0, 0, -8), (7, 7, 7)}
    values = {p: float(n % 7) for n, p in enumerate(sorted(at))}
    nodes = spark.createDataFrame([(*p, v) for p, v in values.items()] + [(50, 50, 50, None)], "i long, j long, k long, value double")
    held = blocks.to_blocks(nodes, 3.0)
    active = {p: v for p, v in values.items() if v != 3.0}
    assert {(r.i, r.j, r.k): r.value for r in blocks.to_nodes(held).collect()} == active
    assert held.count() == len({tuple(x // 8 for x in p) for p in active}) and all(len(r["values"]) == sum(bin(m & (2**64 - 1)).count("1") for m in r["mask"]) for r in held.collect())
    space = grid.ImageGrid((1.0, 0.0, -2.0), (0.5, 1.0, 2.0), (0, 0, 0), (1, 1, 1))
    index = np.concatenate([rng.uniform(-14, 22, (300, 3)), rng.integers(-12, 20, (100, 3)), np.array([(7.5, 7.5, 7.5), (-0.5, -0.5, -0.5), (7.0, 7.0, 7.0)])])
    p = index * np.array(space.spacing) + np.array(space.origin)
    samples = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(p)], "id long, x double, y double, z double")

    def want(x):
        low = np.floor(x).astype(int)
        f = x - low
        return sum(np.prod([t if d else 1 - t for t, d in zip(f, step)]) * active.get(tuple((low + step).tolist()), 3.0) for step in itertools.product((0, 1), repeat=3))

    got = {r.id: r.value for r in blocks.probe(samples, "id", held, space, 3.0).collect()}
    assert all(got[n] == pytest.approx(want(x)) for n, x in enumerate((p - np.array(space.origin)) / np.array(space.spacing)))
    assert blocks.probe(samples, "id", held.limit(0), space, 3.0).where("value <> 3").count() == 0


def test_dense_faces_of_mixed_cells(spark):
    faces = spark.createDataFrame([(7, 0, [1, 2, 3]), (7, 1, [3, 2, 4]), (9, 0, [9, 8, 7, 6]), (9, 1, [4, 2, 3]), (9, 2, [2, 1, 5])], "cell_idx long, local_face int, face_pts array<long>")
    cells, refs, dense = (sorted(tuple(r) for r in df.collect()) for df in topology.dense_faces(faces))
    assert cells == [(7, 2, 0), (9, 3, 2)]
    assert dense == [(0, 3, 0, [1, 2, 3]), (1, 3, 3, [3, 2, 4]), (2, 4, 6, [9, 8, 7, 6]), (3, 3, 10, [2, 1, 5])]
    assert refs == [(0, 7, 0, 0), (1, 7, 1, 1), (2, 9, 0, 2), (3, 9, 1, 1), (4, 9, 2, 3)]


def plane_samples(spark):
    planes = None
    for name in "xyz":
        quad = grid.plane_quad((1.5, 0.5, 0.5), tuple(float(name == a) for a in "xyz"), (0, 0, 0), (2, 1, 1))
        p = grid.slice_positions(spark, quad, 4, 4).withColumn("slice", F.lit(name))
        planes = p if planes is None else planes.union(p)
    return planes.withColumn("key", F.concat_ws(",", "slice", "col", "row"))


def test_probe_of_cell_fields_and_several_point_fields(spark):
    cells, points, faces = mixed_mesh(spark)
    samples = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 1.5, 0.5, 0.5), (2, 9.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: (r.cell_idx, r.mask, r.heat) for r in mesh_probe.probe_cells(samples, "id", cells, points, "heat", faces).collect()}
    assert got == {0: (0, 1, 10.0), 1: (1, 1, 20.0), 2: (None, 0, 0.0)}
    two = points.withColumn("y2", 2 * F.col("y"))
    both = {r.id: (r.value, r.y2) for r in mesh_probe.probe_mesh(samples, "id", cells, two, faces, -5.0, ("value", "y2")).collect()}
    assert both[0] == pytest.approx((2.0, 1.0)) and both[1] == pytest.approx((4.0, 1.0)) and both[2] == (-5.0, -5.0)
    with pytest.raises(ValueError):
        mesh_probe.voxelize(cells, points, (0, 0, 0), (1, 1, 1), (1.0,) * 3)


def test_prefix_sums_of_sparse_and_clustered_keys(spark):
    rnd = np.random.default_rng(5)
    keys = np.unique(np.concatenate((rnd.integers(-(2**62), 2**62, 500), np.arange(1000), [2**62])))
    df = spark.createDataFrame([(int(k), i % 7) for i, k in enumerate(keys)], "k long, v long")
    want = dict(zip(keys.tolist(), np.concatenate(([0], np.cumsum(np.arange(len(keys)) % 7)[:-1])).tolist()))
    for rows in (50, 10**6):
        assert {r.k: r.offset for r in scan.prefix_sum(df, "k", "v", rows=rows).collect()} == want
    assert len(scan.key_bounds(df, "k", 50)) > 20 and scan.prefix_sum(df.limit(0), "k", "v").count() == 0


def test_dense_bins_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(resample, "DENSE", 10)
    rnd = np.random.default_rng(2)
    make = lambda n: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rnd.random((n, 3)) * 2)], "id long, x double, y double, z double")
    few, many = make(30), make(200)
    for samples, points in ((few, many), (many, few)):
        a, b = (np.array([tuple(r)[1:] for r in df.orderBy("id").collect()]) for df in (samples, points))
        want = {(i, j) for i, j in zip(*np.nonzero(np.linalg.norm(a[:, None] - b[None], axis=2) <= 0.5))}
        assert {(r.id, r.p_id) for r in resample.within_radius(samples, points, 0.5).collect()} == want


def test_missing_cells_are_an_error(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12)], "cell_idx long, face_idx long")
    cells = spark.createDataFrame([(1, 0.5), (2, 1.5)], "cell_idx long, v double")
    with pytest.raises(ValueError, match="1 faces .* 12"):
        topology.fields_to_faces(pairs, cells, "v")
    values = cells.withColumnRenamed("cell_idx", "idx")
    assert {r.face_idx: r.v for r in topology.field_of_faces(values, "v", pairs.where("cell_idx < 3"), 2, 9).collect()} == {10: 0.5, 11: 1.5}
    assert topology.field_of_faces(values, "v", pairs, 9, 2).count() == 2
    with pytest.raises(ValueError):
        topology.field_of_faces(values, "v", pairs, 5, 6)


def test_links_in_chunks(mesh):
    whole = {r.point_idx: r.cells for r in metrics.point_links(mesh).collect()}
    parts = metrics.point_links(mesh, 1).collect()
    assert {p: sorted(c for r in parts if r.point_idx == p for c in r.cells) for p in whole} == whole


def test_snapshots(spark):
    still = spark.createDataFrame([(0.0, 1)], "t double, p long")
    field = spark.createDataFrame([(1.0, 1, 10.0), (3.0, 1, 30.0)], "t double, k long, v double")
    for at, want in ((0.0, 10.0), (1.0, 10.0), (2.5, 25.0), (9.0, 30.0)):
        points, low, high, f = temporal.snapshots(still, field, "t", at)
        assert points.count() == 1 and temporal.lerp(low, high, "k", ["v"], f, check=True).first().v == pytest.approx(want)
    with pytest.raises(TypeError):
        temporal.lerp(low, high, "k", ["k"], 0.5)
    assert temporal.locked(field, "t", 5.0).select("t").distinct().first().t == 5.0


def test_panel(spark):
    from lattica.plans import views

    df = spark.createDataFrame([(float(i), i % 4, None) for i in range(9)], "a double, b long, c double")
    found, counts = views.field_panel(df, ["a", "b", "c"], 4)
    assert {r.field: r.n for r in found.collect()} == {"a": 9, "b": 9, "c": 0}
    got = {(r.field, r.bin): r.n for r in counts.collect()}
    assert len(got) == 12 and [got["a", k] for k in range(4)] == [2, 2, 2, 2] and sum(got["c", k] for k in range(4)) == 0


def test_prepared_fields(mesh):
    from lattica.plans import views

    assert {r.point_idx: r.value for r in views.prepared(mesh, "value").collect()} == {0: 5.0, 1: 5.0, 2: 5.0}
    assert views.prepared(mesh, "value", ((8.0, 8.0, 8.0), (9.5, 9.5, 9.5))).count() == 0
    voxels = views.prepared(mesh, "value", ((0.0, 0.0, 0.0), (1.0, 2.0, 0.0)), inflate=10, resolution=8).collect()
    assert {round(r.value, 9) for r in voxels if r.weight > 0} == {5.0}


def test_views_refuse_what_is_wrong(mesh):
    from lattica.plans import views

    with pytest.raises(ValueError):
        views.gaussian_voxels(mesh.points.withColumn("value", F.lit(1.0)), (0, 0, 0), (4, 9, 9), 1.0)
    with pytest.raises(ValueError):
        views.validated(mesh.with_points(mesh.points.drop("z")))
    assert views.dangling(mesh).count() == 0


def test_mesh_between_snapshots_keeps_other_columns_and_refuses_other_meshes(spark):
    points = spark.createDataFrame([(0, 0.0, 1.0, 2.0, 5), (1, 4.0, 4.0, 4.0, 6)], "point_idx long, x double, y double, z double, n long")
    cells = spark.createDataFrame([(0, "line", 1.0)], "cell_idx long, cell_type string, v double")
    mesh = MeshDataset(points, cells, spark.createDataFrame([(0, 0), (0, 1)], "cell_idx long, point_idx long"))
    later = mesh.with_points(points.withColumn("x", F.col("x") + 2)).with_cells(cells.withColumn("v", F.lit(3.0)).withColumn("only_here", F.lit(1.0)))
    for f, x, v in ((-1, 0.0, 1.0), (0.5, 1.0, 2.0), (2, 2.0, 3.0)):
        out = temporal.lerp_mesh(mesh, later, f)
        assert [tuple(r) for r in out.points.orderBy("point_idx").collect()] == [(0, x, 1.0, 2.0, 5), (1, x + 4, 4.0, 4.0, 6)]
        assert [tuple(r) for r in out.cells.collect()] == [(0, "line", v)]
    with pytest.raises(ValueError, match="one snapshot only"):
        temporal.lerp_mesh(mesh, mesh.with_points(points.where("point_idx = 0")), 0.5)


def held_in(spark, n: int):
    """A row of unit hexahedra as ``solids`` has them, and n samples that all lie in it."""
    corner = [spatial.corner(k, [F.col("id") + x, F.lit(y), F.lit(z)], F.col("id") + x) for k, (x, y, z) in enumerate(((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)))]
    cells = spark.range(0, 40, 1, 1).select(F.col("id").alias("cell_idx"), F.lit(spatial.HEXAHEDRON).alias("cell_type"), F.array(*corner).alias("corners"))
    return spark.range(n).selectExpr("id", "(id % 397) / 10 AS x", "0.5D AS y", "0.25D AS z"), cells


def test_a_small_mesh_is_not_copied_for_its_positions(spark, monkeypatch):
    samples, cells = held_in(spark, 2_000)
    monkeypatch.setattr(spatial, "POSITIONS", 50)
    whole = spatial.located(samples, "id", cells, 1)
    assert "CoGroup" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(spatial, "MOST_SENT", 0)
    boxed = spatial.located(samples, "id", cells, 1)
    assert "CoGroup" in boxed._jdf.queryExecution().toString()
    rows = lambda df: [(r.id, r.cell_idx, r.weights, r["values"]) for r in df.orderBy("id").collect()]
    assert rows(whole) == rows(boxed) and len(rows(whole)) == 2_000


def test_copies_of_cells_are_written_by_many_tasks(spark):
    """The cells of a box of 100 parts, all in one partition, are dealt before they are copied."""
    held = spark.range(0, 400, 1, 1).selectExpr("id AS cell_idx", "0L AS leaf")
    made = spatial.copies(held, spark.createDataFrame([(0, 100)], "leaf long, parts long"), "leaf", 16, "cell_idx")
    loads = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(loads) == 40_000 and made.distinct().count() == 40_000 and max(loads) < 10_000


def test_a_probe_passes_its_samples_through(spark):
    """Columns and rows of samples stay, rows of one key too, and no join brings the hits back."""
    cells, points, faces = mixed_mesh(spark)
    samples = spark.createDataFrame([(1, "a", 0.5, 0.5, 0.5), (1, "b", 1.5, 0.5, 0.5), (None, "c", 0.25, 0.5, 0.5), (2, "d", 9.0, 0.0, 0.0), (3, "e", None, 0.0, 0.0)], "key long, name string, x double, y double, z double")
    out = mesh_probe.probe_mesh(samples, "key", cells, points, faces)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {r.name: (r.key, r.cell_idx, r.mask, round(r.value, 9)) for r in out.collect()}
    assert got == {"a": (1, 0, 1, 2.0), "b": (1, 1, 1, 4.0), "c": (None, 0, 1, 1.5), "d": (2, None, 0, 0.0), "e": (3, None, 0, 0.0)}


def test_lines_in_a_small_mesh_are_made_in_one_pass(spark, monkeypatch):
    """And the same lines come out of a box that is dealt to many tasks."""
    _, cells = held_in(spark, 0)
    cells = cells.select("cell_idx", "cell_type", F.transform("corners", lambda c: (c["x"] * 4 + c["y"] * 2 + c["z"]).cast("long")).alias("pts"))
    points = spark.range(164).selectExpr("id AS point_idx", "floor(id / 4) * 1D AS x", "floor(id / 2) % 2 * 1D AS y", "id % 2 * 1D AS z", "1D AS u", "0D AS v", "0D AS w", "id * 1D AS heat")
    seeds = spark.range(300).selectExpr("id AS seed_idx", "id % 41 + 0.25D AS x", "0.5D AS y", "id / 400 AS z")
    made = lambda: integrate.mesh_streamlines(seeds, cells, points, ["u", "v", "w"], "both", fields=("heat",), steps=6)
    rows = lambda df: [tuple(r) for r in df.orderBy("seed_idx", "seq").collect()]
    whole = made()
    assert "CoGroup" not in whole._jdf.queryExecution().toString() and "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    want = rows(whole)
    monkeypatch.setattr(spatial, "MOST_SENT", 0)
    monkeypatch.setattr(integrate, "SEEDS", 20)
    assert rows(made()) == want and len({r[0] for r in want}) > 280


def test_a_position_is_looked_for_once_and_alike_in_any_batch(monkeypatch):
    space = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 0.5, 2.0), (1, 0, 0), (5, 4, 3))
    rng = np.random.default_rng(3)
    field, p = integrate.GridVelocity(rng.normal(size=(4, 5, 5, 3)), space), rng.uniform(-0.5, 5.5, (200, 3))
    calls, locate = [], integrate.locate
    monkeypatch.setattr(integrate, "locate", lambda *a: calls.append(1) or locate(*a))
    cell, velocity, _, _ = field.at(p)
    assert len(calls) == 1
    assert (cell == integrate.cell_of(space, p)).all() and (velocity == np.concatenate([field(p[k : k + 1]) for k in range(200)])).all()


def test_rows_are_dealt_to_a_bounded_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "MOST_TASKS", 5)
    assert scan.dealt(spark.range(4_000), 10, "id").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert scan.dealt(spark.range(35), 10, "id").rdd.getNumPartitions() == 4


def test_both_ways_of_many_lines_are_made_at_once(monkeypatch):
    """The same points, bit by bit, as each line by itself, with velocities made in pieces of a cache's size."""
    space = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 0.5, 2.0), (1, 0, 0), (9, 8, 5))
    rng = np.random.default_rng(5)
    field = integrate.GridVelocity(rng.normal(size=(6, 9, 9, 3)), space)
    seeds = rng.uniform((1, 0, 0), (9, 4, 10), (60, 3))
    largest, locate = [], integrate.locate
    monkeypatch.setattr(integrate, "locate", lambda g, p: largest.append(len(p)) or locate(g, p))
    monkeypatch.setattr(integrate, "CACHED", 16)
    got = integrate.advance(integrate.Lines.begin_all(seeds, [True, False], 0.2), field, steps=12)[0]
    assert max(largest) == 16 and len(got[0]) > 600
    for head in range(120):
        alone = integrate.advance(integrate.Lines.begin(seeds[head % 60 : head % 60 + 1], head < 60, 0.2), field, steps=12)[0]
        assert all((x[got[0] == head] == y).all() for x, y in zip(got[1:], alone[1:], strict=True))


def test_rows_are_dealt_without_being_kept_in_memory(spark):
    """Spark writes a shuffle to so many tasks row by row, however many rows a task reads."""
    most = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    assert 4 * spark.sparkContext.defaultParallelism < scan.dealt(spark.range(10_000_000), 25_000, "id").rdd.getNumPartitions() <= most


def test_cells_of_the_grid_are_made_from_the_lines_once(spark):
    """What a query selects among the cells is not asked of every line item."""
    cells, _ = queries._boxes(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in " ".join(cells.where("cell_idx % 3 = 0").inputFiles()) and cells.count() > 0
