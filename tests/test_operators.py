"""Operators against plain numpy and Python versions on small grids."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import grid, sdf
from voxmill.operators import band, components, conditions, elasticity, graph, krylov, optimize, predicates, region, search, stencil
from voxmill.sources import mesh, snapshots

BOX = list(product(range(3), repeat=3))


def cells_of(spark, keys, density=1.0):
    return spark.createDataFrame([(*k, density) for k in keys], "i int, j int, k int, density double")


def keys(df):
    return {tuple(r) for r in df.select("i", "j", "k").collect()}


def test_region_is_half_open(spark):
    assert keys(region.region(spark, (1, 2, 3), (3, 4, 6))) == set(product((1, 2), (2, 3), (3, 4, 5)))
    assert region.region(spark, (0, 0, 0), (0, 5, 5)).count() == 0


def test_transforms_truncate_toward_zero(spark):
    row = spark.range(1).select(grid.to_index(F.lit(-0.6), 0.125).alias("a"), grid.to_index(F.lit(0.0), 0.125).alias("b"), grid.to_position(F.lit(8), 0.125).alias("c")).first()
    assert (row.a, row.b, row.c) == (8, 12, -0.5)


PLAIN_DOMAINS = {
    "dense": lambda x, y, z: True,
    "cylinder": lambda x, y, z: abs(y) <= 0.5 and abs(math.hypot(x, z) - 0.4) <= 0.015,
    "wheel": lambda x, y, z: math.hypot(math.hypot(x, y) - 0.45, z) <= 0.03 or math.hypot(x, y) + 4.5 * abs(z) <= 0.45,
    "box": lambda x, y, z: max(abs(x), abs(y), abs(z)) <= 0.3,
    "sphere": lambda x, y, z: 0.4 <= math.hypot(x, y, z) <= 0.5,
    "gripper": lambda x, y, z: math.hypot(x, y, z) <= 0.45 and not (y > 0 and abs(x) < 0.05),
}


@pytest.mark.parametrize("name", sorted(sdf.DOMAINS))
def test_populate_keeps_what_the_predicate_holds(spark, name):
    got = keys(region.populate(spark, (20, 20, 20), sdf.domain(name)))
    want = {(i + 8, j + 8, k + 8) for i, j, k in product(range(20), repeat=3) if PLAIN_DOMAINS[name](*((c + 0.5) / 20 - 0.5 for c in (i, j, k)))}
    assert got == want and got


@pytest.mark.parametrize("name", sorted(sdf.DOMAINS))
def test_blocks_that_are_left_out_hold_no_cell(spark, name):
    every = sdf.domain(name)
    plain = lambda x, y, z: every(x, y, z)  # noqa: E731  without bounds: asked at every cell
    for res, box in (((64, 64, 64), None), ((40, 24, 52), ((-0.4, -0.3, -0.45), (0.2, 0.1, 0.5)))):
        got, want = (region.populate(spark, res, f, box).select("i", "j", "k") for f in (every, plain))
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_examined_cells_follow_the_surface(spark):
    found = {n: region.candidates(spark, (8,) * 3, (8 + n,) * 3, sdf.domain("sphere", inner=0.5 - 2 / n, outer=0.5), 1 / n).count() for n in (128, 512)}
    assert found[512] < 16 * 1.2 * found[128] and found[512] < 0.05 * 512**3


def test_places_are_those_of_the_whole_order(spark):
    rng = np.random.default_rng(3)
    rows = [(int(x), int(y)) for x, y in rng.integers(0, 9, (500, 2))]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = sorted((r.place, r.a, r.b) for r in search.ranked(df, F.col("a").desc(), "b").collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert search.ranked(df.limit(0), "a").count() == 0


def plain_main(keys_, least=0.3):
    """The one face-connected component over the share, by flooding."""
    left, large = set(keys_), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            x = todo.pop()
            for o in grid.FACES:
                y = tuple(p + q for p, q in zip(x, o, strict=True))
                if y in left:
                    left.remove(y)
                    own.add(y)
                    todo.append(y)
        if len(own) > least * len(set(keys_)):
            large.append(own)
    assert len(large) == 1
    return large[0]


def test_filtered_voxels_leave_the_container(spark):
    rng = np.random.default_rng(8)
    d = {k: float(x) for k, x in zip(product(range(12), repeat=3), rng.random(12**3), strict=True)}
    d |= {(30, 30, z): 0.9 for z in range(5)}  # apart from all others
    cells = spark.createDataFrame([(*k, x) for k, x in d.items()], "i int, j int, k int, density double")
    block = lambda k: tuple(c // 4 for c in k)
    thin_ = {block(k) for k, x in d.items() if x >= 0.3 + 1e-6}
    main = plain_main([k for k, x in d.items() if x > 0.5 and block(k) in thin_])
    left = {k for k in d if d[k] <= 0.5 or k in main}
    got, thin_blocks, fat_blocks = components.filter_voxels(cells, 0.5, 0.3)
    assert keys(got) == left and not any(k[0] == 30 for k in left)
    want = {block(k) for k in left if d[k] >= 0.3 + 1e-6}
    assert {(r.bi, r.bj, r.bk) for r in thin_blocks.collect()} == want
    reached = {block(tuple(p + q for p, q in zip(k, o, strict=True))) for k in left if d[k] > 1e-6 and block(k) in want for o in grid.DIAGONALS}
    assert {(r.bi, r.bj, r.bk) for r in fat_blocks.collect()} == reached & {block(k) for k in left}
    killed, _, _ = components.threshold_and_kill(cells, 0.5)
    assert keys(killed) == plain_main([k for k, x in d.items() if x >= 0.5])
    filtered = {(r.i, r.j, r.k): r.density for r in components.filter_density(cells, 0.5).collect()}
    assert filtered == {k: x if k in main else 0.0 for k, x in d.items()}


def test_filtered_blocks(spark):
    near, far = list(product(range(8), range(8), range(4))), [(40, 0, 0)]
    cells = cells_of(spark, near + far)
    got, kept = components.filter_blocks(cells, 0.5)
    assert {(r.bi, r.bj, r.bk) for r in kept.collect()} == {(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)}
    assert {(r.i, r.density) for r in got.where("i = 40").collect()} == {(40, 0.0)} and got.where("density = 1").count() == len(near)


def test_keys_that_do_not_fit_stop(spark):
    with pytest.raises(Exception, match="21 bits"):
        components.face_components(cells_of(spark, [(1 << 20, 0, 0)])).collect()
    assert components.face_components(cells_of(spark, [((1 << 20) - 2, -(1 << 20), 0)])).count() == 1


def test_wide_components_equal_flooding(spark):
    from voxmill.plans import more

    at = {tuple(r) for r in more.wide_field(spark, "/root/testdata/sf0.001").where("n >= 2").select("i", "j", "k").collect()}
    sizes, left = [], set(at)
    while left:
        own, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            own.add(x)
            near = [tuple(p + q for p, q in zip(x, o, strict=True)) for o in grid.FACES]
            todo += [y for y in near if y in left]
            left -= set(near)
        sizes.append(len(own))
    assert sorted(r.cells for r in more.w25_components(spark, "/root/testdata/sf0.001").collect()) == sorted(sizes)


def test_parts_of_blocks_equal_flooding():
    rng = np.random.default_rng(4)
    masks = rng.integers(0, 2**64, 300, dtype=np.uint64, endpoint=False) & np.where(rng.random(300) < 0.5, rng.integers(0, 2**64, 300, dtype=np.uint64), ~np.uint64(0))
    masks[:3] = (0, ~np.uint64(0), 1 << 63)
    rows, bits = components.parts(masks)
    cells = list(product(range(4), repeat=3))
    for n, mask in enumerate(masks):
        left, want = {c for b, c in enumerate(cells) if int(mask) >> b & 1}, set()
        while left:
            todo, own = [left.pop()], set()
            while todo:
                x = todo.pop()
                own.add(x)
                near = {tuple(p + q for p, q in zip(x, o, strict=True)) for o in grid.FACES} & left
                left -= near
                todo += near
            want.add(frozenset(own))
        assert {frozenset(c for b, c in enumerate(cells) if int(x) >> b & 1) for x in bits[rows == n]} == want


def test_components_that_wind_through_all_blocks(spark):
    # a snake of a hundred thousand cells with gaps of one cell, negative coordinates, and single cells between
    snake = []
    for row in range(500):
        line = [(2 * row - 200, y, -7) for y in range(-100, 98)]
        snake += line if row % 2 == 0 else line[::-1]
        snake.append((2 * row - 199, 97 if row % 2 == 0 else -100, -7))
    lone = [(2 * k, 2 * k, 40 + 2 * k) for k in range(50)]
    assert len(snake) > 99_000
    df = spark.createDataFrame(snake + lone + snake[:10], "i int, j int, k int").repartition(4)
    sizes = sorted(r.cells for r in components.sizes(components.face_components(df)).collect())
    assert sizes == [1] * 50 + [len(snake)]
    first = min(snake)
    name = components.face_components(df).where("k = -7").select("component", components.packed(*(F.lit(c) for c in first)).alias("want")).distinct().collect()
    assert [r.component == r.want for r in name] == [True]


def test_domains_reject_what_they_do_not_know():
    with pytest.raises(ValueError):
        sdf.domain("torus")
    with pytest.raises(ValueError):
        sdf.sphere(upper_only=True)


def test_upscaled_fields_meet_by_a_shuffle(spark):
    low, scale = (2, -3, 4), 3
    fine = region.region(spark, low, tuple(a + 9 for a in low))
    coarse = region.region(spark, (0, 0, 0), (3, 3, 3)).withColumn("density", (F.col("i") * 9 + F.col("j") * 3 + F.col("k")).cast("double")).where("density <> 13")
    got = region.upscale(fine, coarse, low, scale)
    at = lambda p: tuple((c - a + s) // scale for c, a, s in zip(p, low, (0, 0, scale - 1), strict=True))
    met = {p: at(p) for p in product(*(range(a, a + 9) for a in low))}
    want = {(*p, 9.0 * i + 3 * j + k) for p, (i, j, k) in met.items() if k < 3 and (i, j, k) != (1, 1, 1)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # small as they are


def test_mirrored_populate_adds_a_symmetry_plane(spark):
    got = region.populate(spark, (4, 4, 4), sdf.dense(), mirror="x")
    assert got.agg(F.max("i")).first()[0] == 4 // 2 + 8 + 1
    assert got.where("mirror_axes = 'x'").count() == 16


def test_nodes_and_flags(spark):
    c = cells_of(spark, [(0, 0, 0), (1, 0, 0)]).withColumn("flags", F.when(F.col("i") == 0, grid.ACTIVE_CELL | 0x200).otherwise(grid.ACTIVE_CELL).cast("long"))
    got = {(r.i, r.j, r.k): r.flags for r in predicates.flag_nodes(c).collect()}
    assert len(got) == 12 and got[0, 0, 0] == 0x30 and got[1, 1, 1] == 0x30 and got[2, 0, 0] == 0x10
    assert keys(region.nodes_of(c)) == set(got)


def test_blocks_are_validated(spark):
    c = cells_of(spark, [(3, 0, 0)])
    assert keys(predicates.outside_blocks(c, predicates.blocks_of(c))) == {(4, j, k) for j in (0, 1) for k in (0, 1)}


def test_fixed_cells_need_all_corners(spark):
    d = conditions.cell_dirichlet(cells_of(spark, [(0, 0, 0)]), "y")
    assert [tuple(r) for r in conditions.fixed_cells(d).collect()] == [(0, 0, 0, 1)]
    assert conditions.fixed_cells(d.where("i = 0")).count() == 0


def test_contradicting_records_stop(spark):
    d = conditions.cell_dirichlet(cells_of(spark, [(0, 0, 0)]), "x")
    assert conditions.unique_dirichlet(d.union(d)).count() == 8
    with pytest.raises(Exception, match="contradicting"):
        conditions.unique_dirichlet(d.union(d.withColumn("value", F.lit(1.0)))).collect()


def test_last_force_wins_or_all_add_up(spark):
    f = spark.createDataFrame([(1, 0, 0, 0, 1.0, 0.0, 0.0), (2, 0, 0, 0, 5.0, 0.0, 0.0)], "seq long, i int, j int, k int, fx double, fy double, fz double")
    assert conditions.right_hand_side(f).first().fx == 5
    assert conditions.right_hand_side(f, True).first().fx == 6


def test_loads_share_the_whole_force(spark):
    c = cells_of(spark, BOX)
    total = lambda f: f.agg(F.sum("fy")).first()[0]
    assert total(conditions.plane_load(region.nodes_of(c), (0, -1, 0), 0, 3)) == pytest.approx(-1)
    assert total(conditions.bridge_load(c, 0)) == pytest.approx(-1)
    assert total(conditions.box_force(c, (1, 1, 1), (0, -1, 0), 2)) == pytest.approx(-1)


def test_forces_mark_cells_and_skip_fixed_nodes(spark):
    c = cells_of(spark, BOX).withColumn("flags", F.lit(1).cast("long"))
    f = spark.createDataFrame([(0, 0, 0, 1.0, 0.0, 0.0), (3, 3, 3, 1.0, 0.0, 0.0), (9, 9, 9, 1.0, 0.0, 0.0)], "i int, j int, k int, fx double, fy double, fz double")
    good, marked = conditions.node_force(c, f, spark.createDataFrame([(3, 3, 3)], "i int, j int, k int"), fix=True)
    assert keys(good) == {(0, 0, 0)}
    assert {(r.i, r.j, r.k) for r in marked.collect() if r.flags & grid.HAS_FORCE} == {(0, 0, 0)}


def test_band_grows_by_diagonals(spark):
    c = cells_of(spark, [(3, 3, 3)])
    box = spark.createDataFrame([(i, j, k) for i, j, k in product(range(3), repeat=3)], "bi int, bj int, bk int")
    thin = band.thin(c, 0.5)
    assert {tuple(r) for r in band.fat(c, thin, box).collect()} == set(product((0, 1), repeat=3))
    assert band.fatter(thin.select("bi", "bj", "bk"), box).count() == 8
    assert band.densest(c, 1.0, 1).count() == 1


def test_components(spark):
    line = [(i, 0, 0) for i in range(20)]
    c = cells_of(spark, line + [(30, 0, 0), (31, 1, 0)])
    assert sorted(r.cells for r in components.sizes(components.face_components(c)).collect()) == [1, 1, 20]
    assert keys(components.main_component(c)) == set(line)
    with pytest.raises(ValueError):
        components.main_component(cells_of(spark, [(0, 0, 0), (5, 0, 0)]))


def test_components_of_a_random_graph(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in edges)}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_many_partitions(spark, monkeypatch):
    """Edges that no single task sees together: a path, a star and a grid in shuffled order, seven edges a task."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", 7)
    rng = np.random.default_rng(11)
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 80)] + [(2000 + 10 * i + j, 2000 + 10 * i + j + d) for i in range(9) for j in range(9) for d in (1, 10)]
    names = rng.permutation(3000)
    rows = [(int(names[a]), int(names[b])) for a, b in rng.permutation(edges)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "src long, dst long").repartition(4)).collect()}
    groups = [range(101), range(1000, 1080), {x for e in edges if e[0] >= 2000 for x in e}]
    want = {int(names[x]): int(min(names[y] for y in g)) for g in groups for x in g}
    assert got == want


def test_smoothing_of_a_constant(spark):
    c = cells_of(spark, BOX).withColumn("dc0", F.lit(-2.0))
    for r in stencil.smooth(c).collect():
        assert r.dc0 == pytest.approx(-2 / 1.001) and r.dc1 == -2


def test_transfers_are_transposed(spark):
    fine = cells_of(spark, [(2, 2, 2)])
    coarse = stencil.restrict(fine.withColumnRenamed("density", "u"))
    assert [tuple(r) for r in coarse.collect()] == [(1, 1, 1, 1.0)]
    zero = cells_of(spark, list(product(range(5), repeat=3)), 0.0).withColumnRenamed("density", "u")
    got = {(r.i, r.j, r.k): r.u for r in stencil.prolong(coarse, zero).collect()}
    assert all(got[k] == math.prod(max(0, 1 - abs(x - 2) / 2) for x in k) for k in got)


def test_surface_of_a_cube(spark):
    faces = stencil.boundary_faces(cells_of(spark, BOX), 0.5)
    assert faces.count() == 54
    lines = [r.line for r in mesh.ply_lines(faces).orderBy("part", "n").collect()]
    assert lines[2] == "element vertex 216" and len(lines) == 9 + 216 + 108


def test_bisection_visits_the_same_middles(spark):
    df = spark.range(100).select((F.col("id") / 100).alias("density"))
    t = search.threshold_for_volume(df, 30)
    assert df.where(F.col("density") >= t).count() == 30
    assert search.cut(df, t).agg(F.sum("density")).first()[0] == 30


@pytest.mark.parametrize("seed", range(3))
def test_thresholds_and_multipliers_equal_bisections(spark, seed):
    rng = np.random.default_rng(seed)
    d = np.round(rng.random(400), seed + 1) if seed else rng.integers(0, 2, 400).astype(float)
    df = spark.createDataFrame([(float(x),) for x in d], "density double")
    for target in (0, 1, 30, 399, 400, 1000):
        low, high = 0.0, 1.0
        while high - low > 1e-8:
            m = (low + high) / 2
            low, high = (m, high) if (d >= m).sum() > target else (low, m)
        assert search.threshold_for_volume(df, target) == high, target
    d, dc = rng.random(300), -rng.exponential(3, 300) * (rng.random(300) < 0.9)
    cells = spark.createDataFrame([(n, 0, 0, float(x), float(y)) for n, (x, y) in enumerate(zip(d, dc, strict=True))], "i int, j int, k int, density double, dc0 double")

    def new(m):
        return np.clip(np.clip(d * np.sqrt(np.maximum(0, -dc) / m), d - 0.2, d + 0.2), 0.01, 1)

    for target in (1.0, 120.0, 150.0, 190.0, 290.0):
        low, high = 1e-20, 1e20
        while low * (1 + 1e-9) < high:
            m = (low * high) ** 0.5
            low, high = (m, high) if new(m).sum() > target else (low, m)
        out, multiplier = optimize.oc_step(cells, target, optimize.Settings(minimum_density=0.01))
        assert multiplier == pytest.approx(high, rel=1e-7)
        assert [r.density for r in out.orderBy("i").collect()] == pytest.approx(new(high), abs=1e-7)


def test_iteration_table(spark, tmp_path):
    blocks = spark.range(40).select(F.col("id").cast("int").alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("bk"), (F.col("id") < 10).alias("thin"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("iterations"))
    objectives = [10.0, 8.0, 7.0, 6.9, 6.89, 6.89]
    spark.sparkContext.setJobGroup("iterations", "")
    for n, o in enumerate(objectives):
        row = snapshots.record_iteration(str(tmp_path), "blocks", blocks, n, {"n_container": F.count("*"), "n_thin": F.count_if("thin")}, {"objective": o})
        assert row == {"objective": o, "n_container": 40, "n_thin": 10}
    assert jobs() == 2 * len(objectives)  # a write each, none for the counts
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    snapshots.record_iteration(str(tmp_path), "blocks", blocks.limit(7), 5, {"n_container": F.count("*"), "n_thin": F.count_if("thin")}, {"objective": 6.89})
    table = snapshots.iterations(spark, str(tmp_path))
    assert [tuple(r) for r in table.orderBy("iter").select("iter", "objective", "n_container", "n_thin").collect()][-2:] == [(4, 6.89, 40, 10), (5, 6.89, 7, 7)]
    got = snapshots.convergence(table, after=4).orderBy("iter").collect()
    want = [abs((a + b - c - d) / (a + b)) for d, c, b, a in zip(objectives, objectives[1:], objectives[2:], objectives[3:])]
    assert [r.ratio for r in got[3:]] == pytest.approx(want) and got[2].ratio is None
    assert [r.converged for r in got] == [n >= 3 and optimize.converged(objectives[: n + 1], after=4) for n in range(6)]


def test_blocks_that_have_not_changed_are_not_stored_again(spark, tmp_path):
    path = str(tmp_path / "state")
    states = [{k: 0.5 for k in product(range(12), range(8), range(4))}]
    states.append({k: v for k, v in states[0].items()} | {(0, 0, 0): 0.75, (20, 0, 0): 1.0})
    states.append({k: v for k, v in states[1].items() if k[0] >= 4})  # two blocks go
    states.append(states[2] | {(0, 0, 1): 0.25})  # one comes again with another cell
    for n, state in enumerate(states):
        df = spark.createDataFrame([(*k, v) for k, v in state.items()], "i int, j int, k int, density double")
        snapshots.save_blocks(path, df, n, first=n == 0)
    read = lambda n: {(r.i, r.j, r.k): r.density for r in snapshots.load_blocks(spark, path, n).collect()}
    assert [read(n) for n in range(4)] == states and read(None) == states[3]
    stored = {r["iter"]: r["count"] for r in spark.read.parquet(f"{path}/cells").groupBy("iter").count().collect()}
    assert stored == {0: 384, 1: 65, 3: 1}


def test_slabs_skip_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    n, path = 96, str(tmp_path / "field")
    cells = region.region(spark, (0, 0, -n // 2), (n, n, n // 2)).withColumn("density", F.rand(3))
    snapshots.save_clustered(cells.repartition(6), path, group_bytes=4 << 10)
    assert spark.read.parquet(path).count() == n**3
    got = snapshots.slab(spark, path, "z", 7, 8, 0.5)
    want = cells.where("k = 7 and density >= 0.5")
    assert keys(got) == keys(want) and got.count() == want.count() > 3000
    groups = [r for p in (tmp_path / "field").glob("*.parquet") for m in [pq.read_metadata(p)] for r in (m.row_group(g) for g in range(m.num_row_groups))]
    col = {groups[0].column(c).path_in_schema: c for c in range(4)}["k"]
    met = [g for g in groups if g.column(col).statistics.min <= 7 <= g.column(col).statistics.max]
    assert len(groups) > 50 and sum(g.num_rows for g in met) < 0.25 * n**3
    plan = got._jdf.queryExecution().executedPlan()
    got._jdf.queryExecution().toRdd().count()
    scans, todo = [], [plan]
    while todo:
        x = todo.pop()
        todo += [x.children().apply(i) for i in range(x.children().size())]
        if x.nodeName().startswith("Scan parquet"):
            scans.append(x.metrics().apply("numOutputRows").value())
    assert scans and sum(scans) == sum(g.num_rows for g in met)  # other groups are never read


def test_scenes_of_all_kinds_of_leaves(spark, tmp_path):
    from voxmill.operators import scene, texture

    (tmp_path / "cube.obj").write_text(CUBE)
    cube = scene.Mesh(mesh.corners(*mesh.read_obj(spark, str(tmp_path / "cube.obj"))))
    cells = region.region(spark, (8,) * 3, (16,) * 3)
    at = lambda k: [(x - 8 + 0.5) / 8 - 0.5 for x in k]
    ball, stored = scene.Shape(sdf.domain("sphere", inner=0.0)), scene.Field(cells_of(spark, [(8, 8, 8), (12, 12, 12)] * 2))
    # a linear texture is sampled exactly between its outer points
    grid_ = spark.createDataFrame([(i, j, k, i * 0.25 + j * 0.5 - k * 0.125) for i, j, k in product(range(4), repeat=3)], "i int, j int, k int, density double")
    points = texture.sample(cells.select("i", "j", "k", *((F.col(c) - 8 + 0.5).alias(f"p{c}") for c in "ijk")), grid_, (4, 4, 4), tuple(F.col(f"p{c}") / 8 for c in "ijk")).collect()
    clip = lambda x: min(max(x / 2 - 0.5, 0), 3)
    assert all(p.sampled == pytest.approx(clip(p.pi) * 0.25 + clip(p.pj) * 0.5 - clip(p.pk) * 0.125) for p in points) and len(points) == 512
    high = {(p.i, p.j, p.k) for p in points if p.sampled >= 0.7 - 1e-6}
    tex = scene.Texture(grid_, (4, 4, 4), level=0.7)
    tree = scene.difference(scene.union(ball, stored), scene.intersection(cube, tex))
    in_ball = {k for k in product(range(8, 16), repeat=3) if math.dist(at(k), (0, 0, 0)) <= 0.5}
    in_cube = set(product(range(10, 14), repeat=3))
    got = scene.declared(cells, tree, 1 / 8, fixed=stored, loaded=tex)
    assert keys(got) == (in_ball | {(8, 8, 8)}) - (in_cube & high)
    assert {(r.i, r.j, r.k) for r in got.collect() if r.fixed} == {(8, 8, 8), (12, 12, 12)} & keys(got)
    assert {(r.i, r.j, r.k) for r in got.collect() if r.fy is not None} == high & keys(got)
    row = snapshots.record_iteration(str(tmp_path), "scene", got, 0, scene.counts(got))
    assert row == {"cells": got.count(), "fixed": got.where("fixed").count(), "loaded": len(high & keys(got))}


def test_states_of_a_scope_and_loaded_bands(spark, tmp_path):
    c = cells_of(spark, product(range(8), repeat=3), 0.0).withColumn("density", F.when(F.expr("i = 1 and j = 1 and k = 1"), 0.9).otherwise(F.lit(0.0)))
    snapshots.save_state(str(tmp_path), {"cells": c}, 1, scope=band.thin(c, 0.5))
    got, _ = snapshots.load_state(spark, str(tmp_path))
    assert keys(got["cells"]) == set(product(range(4), repeat=3)) and got["cells"].columns == c.columns
    stored = spark.createDataFrame([(3, 3, 3, 2.0), (0, 0, 0, -1.0), (7, 7, 7, 0.0), (9, 9, 9, 1.0)], "i int, j int, k int, density double")
    cells, thin_blocks, fat_blocks, dropped = snapshots.load_density_with_bands(c, stored, minimum=0.5)
    assert {(r.i, r.j, r.k): r.density for r in cells.where("density <> 0").collect()} == {(3, 3, 3): 1.0} and cells.count() == 512
    assert [tuple(r)[:3] for r in thin_blocks.collect()] == [(0, 0, 0)] and fat_blocks.count() == 8 and keys(dropped) == {(9, 9, 9)}


def test_small_parts_of_the_inventory(spark, tmp_path):
    """Text dumps, bounding boxes, initial densities, continuation and overrides."""
    c = cells_of(spark, BOX)
    snapshots.as_text(c, str(tmp_path / "text"))
    import json

    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert {(x["i"], x["j"], x["k"]) for x in lines} == set(BOX) and {x["density"] for x in lines} == {1.0}
    for n in (1, 2, 2):
        snapshots.append_iteration(str(tmp_path / "series"), c.limit(n), n)
    assert {r["iter"]: r["count"] for r in spark.read.parquet(str(tmp_path / "series")).groupBy("iter").count().collect()} == {1: 1, 2: 2}
    boxed = region.populate(spark, (10, 10, 10), sdf.dense(), ((-0.19, -0.5, -0.5), (0.11, 0.0, 0.5)), density=0.3)
    assert keys(boxed) == set(product(range(11, 14), range(8, 13), range(8, 18))) and {r.density for r in boxed.collect()} == {0.3}
    s = optimize.Settings(progressive_vol_frac=10, volume_fraction=0.5, minimum_density=0.01)
    assert [optimize.volume_fraction(s, n) for n in (0, 5, 10, 20)] == [1.0, 0.75, 0.5, 0.5]
    changed = s.override(volume_fraction=0.2)
    assert changed.volume_fraction == 0.2 and s.volume_fraction == 0.5
    with pytest.raises(ValueError):
        s.override(volume_fraction=0.001)


def dense_matrix(cell_keys, scale, mu, lam):
    nodes = sorted({tuple(np.add(c, o)) for c in cell_keys for o in grid.CORNERS})
    at, e = {n: i for i, n in enumerate(nodes)}, elasticity.element_matrix(mu, lam)
    k = np.zeros((3 * len(nodes),) * 2)
    for c, s in zip(cell_keys, scale, strict=True):
        d = [3 * at[tuple(np.add(c, o))] + a for o in grid.CORNERS for a in range(3)]
        k[np.ix_(d, d)] += s * e
    return nodes, k


def test_element_matrix():
    k = elasticity.element_matrix(1.0, 1.0)
    assert np.allclose(k, k.T) and (np.abs(np.linalg.eigvalsh(k)) < 1e-12).sum() == 6
    assert elasticity.element_matrix(1.0, 0.0)[0, 0] == pytest.approx(32 / 72)
    assert elasticity.youngs(*elasticity.lame(1e6, 0.3)) == pytest.approx((1e6, 0.3))


def test_product_equals_the_dense_matrix(spark):
    rng = np.random.default_rng(2)
    scale = rng.random(27)
    nodes, k = dense_matrix(BOX, scale, 0.4, 0.7)
    u = rng.normal(size=(len(nodes), 3))
    cells = spark.createDataFrame([(*c, float(s)) for c, s in zip(BOX, scale, strict=True)], "i int, j int, k int, scale double")
    table = spark.createDataFrame([(*map(int, n), *map(float, x)) for n, x in zip(nodes, u, strict=True)], "i int, j int, k int, u0 double, u1 double, u2 double")
    got = {(r.i, r.j, r.k): (r.f0, r.f1, r.f2) for r in elasticity.multiply(cells, table, 0.4, 0.7).collect()}
    want = (k @ u.ravel()).reshape(-1, 3)
    assert np.allclose([got[tuple(map(int, n))] for n in nodes], want)
    d = {(r.i, r.j, r.k): (r.d0, r.d1, r.d2) for r in elasticity.diagonal(cells, 0.4, 0.7).collect()}
    assert np.allclose([d[tuple(map(int, n))] for n in nodes], np.diag(k).reshape(-1, 3))


def test_conjugate_gradients_solve(spark):
    keys_ = list(product(range(2), repeat=3))
    cells = cells_of(spark, keys_).withColumn("scale", F.lit(1.0))
    fixed = conditions.plane_dirichlet(cells, 0, 0).where("i = 0")
    force = conditions.plane_load(region.nodes_of(cells), (0.0, -1.0, 0.0), 0, 2)
    out = krylov.solve(cells, force, fixed, 0.5, 0.25, tolerance=1e-6)
    nodes, k = dense_matrix(keys_, [1.0] * 8, 0.5, 0.25)
    f = np.array([[0, -1 / 9, 0] if n[0] == 2 else [0, 0, 0] for n in nodes], float).ravel()
    free = np.array([[n[0] != 0] * 3 for n in nodes]).ravel()
    u = np.zeros(len(f))
    u[free] = np.linalg.solve(k[np.ix_(free, free)], f[free])
    got = {(r.i, r.j, r.k): (r.u0, r.u1, r.u2) for r in out.nodes.collect()}
    assert out.success and np.allclose([got[tuple(map(int, n))] for n in nodes], u.reshape(-1, 3), atol=1e-4)


def test_multigrid_preconditioner_is_symmetric(spark):
    from voxmill.operators import multigrid

    rng = np.random.default_rng(0)
    cells = cells_of(spark, list(product(range(4), range(2), range(2)))).withColumn("scale", F.lit(1.0))
    cycle = multigrid.v_cycle(cells, 0.5, 0.25, coarse_steps=2)
    base = elasticity.diagonal(cells, 0.5, 0.25).orderBy(*grid.KEY).collect()
    out = []
    for r in rng.normal(size=(2, len(base), 3)):
        r[[n for n, d in enumerate(base) if d.i == 0]] = 0
        rows = [(d.i, d.j, d.k, d.d0, d.d1, d.d2, *map(float, x), *([0.0] * 3 if d.i == 0 else [None] * 3)) for d, x in zip(base, r, strict=True)]
        got = {(z.i, z.j, z.k): (z.z0, z.z1, z.z2) for z in cycle(spark.createDataFrame(rows, "i int, j int, k int, d0 double, d1 double, d2 double, r0 double, r1 double, r2 double, g0 double, g1 double, g2 double")).collect()}
        out.append((r, np.array([got[d.i, d.j, d.k] for d in base])))
    (x, mx), (y, my) = out
    assert (mx * y).sum() == pytest.approx((my * x).sum()) and (mx * x).sum() > 0
    assert all((m[[n for n, d in enumerate(base) if d.i == 0]] == 0).all() for m in (mx, my))


def test_density_update_meets_the_volume(spark):
    cells = spark.createDataFrame([(i, 0, 0, 0.5, -float(1 + i % 7)) for i in range(50)], "i int, j int, k int, density double, dc0 double")
    new, _ = optimize.oc_step(cells, 20.0)
    assert new.agg(F.sum("density")).first()[0] == pytest.approx(20, abs=1e-4)
    assert new.agg(F.min("density")).first()[0] >= 0.3 - 1e-9


def test_one_iteration_lowers_nothing_but_the_target(spark):
    cells = cells_of(spark, list(product(range(3), range(2), range(2))), 0.5)
    fixed = conditions.plane_dirichlet(cells, 0, 0).where("i = 0")
    force = conditions.plane_load(region.nodes_of(cells), (0.0, -1.0, 0.0), 0, 3)
    new, log = optimize.run(cells, force, fixed, 1.0, 1, optimize.Settings(volume_fraction=0.4, youngs=1.0, cg_max_iterations=15))
    assert new.agg(F.sum("density")).first()[0] == pytest.approx(0.4 * 12, abs=1e-4)
    assert log[0]["objective"] > 0


def test_settings_are_checked():
    with pytest.raises(TypeError):
        optimize.Settings(volume_fracton=0.3)
    with pytest.raises(ValueError):
        optimize.Settings(volume_fraction=0.1, minimum_density=0.2)
    s = optimize.Settings(progressive_vol_frac=10, volume_fraction=0.2)
    assert optimize.volume_fraction(s, 0) == 1 and optimize.volume_fraction(s, 20) == pytest.approx(0.2)
    assert optimize.converged([10.0] * 12) and not optimize.converged([10.0, 1.0])


CUBE = """v -0.25 -0.25 -0.25
v 0.25 -0.25 -0.25
v 0.25 0.25 -0.25
v -0.25 0.25 -0.25
v -0.25 -0.25 0.25
v 0.25 -0.25 0.25
v 0.25 0.25 0.25
v -0.25 0.25 0.25
f 1 4 3 2
f 5/1 6/1 7/1 8/1
f 1 2 6 5
f 2 3 7 6
f 3 4 8 7
f 4 1 5 8
"""


def test_meshes(spark, tmp_path):
    (tmp_path / "cube.obj").write_text(CUBE)
    v, t = mesh.read_obj(spark, str(tmp_path / "cube.obj"))
    tri = mesh.corners(v, t)
    assert (v.count(), tri.count()) == (8, 12)
    cells = region.populate(spark, (8, 8, 8), sdf.dense())
    inner = set(product(range(10, 14), repeat=3))
    assert keys(mesh.inside(tri, cells, 1 / 8)) == inner
    fixed = mesh.shell(tri, cells, 1 / 8, 0.07)
    near = {k for k in product(range(8, 16), repeat=3) if abs(max(abs((x - 8 + 0.5) / 8 - 0.5) for x in k) - 0.25) <= 0.07 and sum(abs((x - 8 + 0.5) / 8 - 0.5) > 0.25 for x in k) <= 1}
    assert {(r.i, r.j, r.k) for r in fixed.collect() if r.flags & grid.FIXED_DENSITY} == near
    f = {(r.i, r.j, r.k): (r.fx, r.fy, r.fz) for r in mesh.normal_force(tri, cells, 1 / 8, 0.07).collect()}
    assert f[14, 12, 12] == pytest.approx((1, 0, 0)) and f[10, 12, 12] == pytest.approx((-1, 0, 0))


def plain_distance(p, t):
    """Of a point to a triangle, by many points of it and its edges' exact nearest ones."""
    a, b, c = (np.array(x) for x in t)
    n = np.cross(b - a, c - a)
    n = n / np.linalg.norm(n)
    foot = p - np.dot(p - a, n) * n
    if all(np.dot(np.cross(e - s, foot - s), n) >= 0 for s, e in ((a, b), (b, c), (c, a))):
        return abs(np.dot(p - a, n))
    return min(np.linalg.norm(p - s - np.clip(np.dot(p - s, e - s) / np.dot(e - s, e - s), 0, 1) * (e - s)) for s, e in ((a, b), (b, c), (c, a)))


@pytest.mark.parametrize("law", [{"strength": 2.0}, {"wing": True}, {"no_z": True}, {"override": (0.0, 0.5, -1.0), "strength": 3.0}])
def test_normal_forces_equal_a_plain_loop(spark, law):
    rng = np.random.default_rng(12)
    tris = [rng.uniform(-0.45, 0.45, 3) + rng.uniform(-size, size, (3, 3)) for size in (0.02, 0.05, 0.1, 0.3, 0.6) for _ in range(3)]
    tris.append(np.array([[-0.4, -0.4, 0.1], [0.4, -0.4, 0.1], [-0.4, 0.4, 0.1]]))
    tri = spark.createDataFrame([(n, *map(float, t.ravel())) for n, t in enumerate(tris)], "fid long, " + ", ".join(f"{c} double" for c in mesh.CORNER))
    n, dx, reach, centre, falloff = 12, 1 / 12, 0.06, (0.1, 0.0, -0.1), 0.6
    cells = region.region(spark, (8, 8, 8), (8 + n, 8 + n, 8 + n)).where("(i + j + k) % 5 > 0")
    want = {}
    for key in keys(cells):
        p = (np.array(key) - 8) * dx - 0.5
        w = max(0.0, 1 - np.linalg.norm(p - np.array(centre)) / falloff)
        near = [np.cross(t[1] - t[0], t[2] - t[0]) for t in tris if plain_distance(p, t) <= reach]
        total = sum((x / np.linalg.norm(x) for x in near), np.zeros(3))
        if w <= 0 or total @ total < 1e-6:
            continue
        u = np.array(law["override"]) if "override" in law else total / np.linalg.norm(total)
        if law.get("wing"):
            if abs(u[1]) > 0.05:
                want[key] = -u * (u[1] if u[1] > 0 else 0.4 / u[1]) * w
        elif not (law.get("no_z") and abs(u[2]) >= 0.99):
            want[key] = u * law.get("strength", 1.0) * w
    got = {(r.i, r.j, r.k): (r.fx, r.fy, r.fz) for r in mesh.normal_force(tri, cells, dx, reach, centre=centre, falloff=falloff, **law).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(tuple(want[k])) for k in want)


def test_triangles_of_any_size_have_few_bins(spark):
    rng = np.random.default_rng(1)
    rows = [(n, *map(float, (rng.uniform(-0.5, 0.5, 3) + rng.uniform(-size, size, (3, 3))).ravel())) for n, size in enumerate((1e-4, 1e-3, 1e-2, 0.1, 0.5, 1.0) * 20)]
    tri = spark.createDataFrame(rows, "fid long, " + ", ".join(f"{c} double" for c in mesh.CORNER))
    most = mesh.binned(tri, 1 / 4000, 0.01).groupBy("fid").count().agg(F.max("count")).first()[0]
    assert most <= 8


def test_state_round_trip(spark, tmp_path):
    c = cells_of(spark, BOX).withColumn("dc0", F.lit(1.0))
    snapshots.save_state(str(tmp_path), {"cells": c}, 7, compact=True)
    tables, n = snapshots.load_state(spark, str(tmp_path))
    assert n == 7 and keys(tables["cells"]) == set(BOX) and "dc0" not in tables["cells"].columns
    kept, out = snapshots.load_density(c, cells_of(spark, [(0, 0, 0), (9, 9, 9)], 3.0))
    assert kept.first().density == 1.0 and keys(out) == {(9, 9, 9)}


def test_galerkin_product_equals_transferred_matrix(spark):
    from voxmill.operators import multigrid

    rng = np.random.default_rng(8)
    fine_keys = list(product(range(4), range(2), range(2)))
    scale = rng.random(16)
    cells = spark.createDataFrame([(*c, float(s)) for c, s in zip(fine_keys, scale, strict=True)], "i int, j int, k int, scale double")
    coarse = multigrid.coarse_cells(cells, 0.4, 0.7)
    fine_nodes, k = dense_matrix(fine_keys, scale, 0.4, 0.7)
    coarse_nodes = sorted(set(product(range(3), range(2), range(2))))
    p = np.zeros((len(fine_nodes), len(coarse_nodes)))
    for a, n in enumerate(fine_nodes):
        for b, m in enumerate(coarse_nodes):
            p[a, b] = np.prod([max(0, 1 - abs(x - 2 * y) / 2) for x, y in zip(n, m, strict=True)])
    p = np.kron(p, np.eye(3))
    u = rng.normal(size=(len(coarse_nodes), 3))
    table = spark.createDataFrame([(*n, *map(float, x)) for n, x in zip(coarse_nodes, u, strict=True)], "i int, j int, k int, u0 double, u1 double, u2 double")
    got = {(r.i, r.j, r.k): (r.f0, r.f1, r.f2) for r in multigrid.coarse_multiply(coarse, table, ["u0", "u1", "u2"]).collect()}
    assert np.allclose([got[n] for n in coarse_nodes], (p.T @ k @ p @ u.ravel()).reshape(-1, 3))
    d = {(r.i, r.j, r.k): (r.d0, r.d1, r.d2) for r in multigrid.coarse_diagonal(coarse).collect()}
    assert np.allclose([d[n] for n in coarse_nodes], np.diag(p.T @ k @ p).reshape(-1, 3))
    fine = spark.createDataFrame([(*map(int, n), *map(float, x)) for n, x in zip(fine_nodes, (p @ u.ravel()).reshape(-1, 3), strict=True)], "i int, j int, k int, u0 double, u1 double, u2 double")
    up = {(r.i, r.j, r.k): (r.u0, r.u1, r.u2) for r in multigrid.prolong_vectors(table, fine, ["u0", "u1", "u2"]).collect()}
    assert np.allclose([up[tuple(map(int, n))] for n in fine_nodes], (p @ u.ravel()).reshape(-1, 3))
    down = {(r.i, r.j, r.k): (r.u0, r.u1, r.u2) for r in multigrid.restrict_vectors(fine, ["u0", "u1", "u2"]).collect()}
    assert np.allclose([down[n] for n in coarse_nodes], (p.T @ p @ u.ravel()).reshape(-1, 3))


def test_problem_files(spark, tmp_path):
    import struct

    from voxmill.sources import problems

    data = [0.0] * 64
    data[1 * 16 + 2 * 4 + 3] = 0.5
    body = struct.pack("<ii", 3, 1) + struct.pack("<Q", 1) + struct.pack("<Q", 1) + b"a" + struct.pack("<Q", 2) + b"bc" + struct.pack("<QQ", 0, 0)
    body += struct.pack("<dQ?", 0.01, 0, True) + struct.pack("<dd", 2.0, 1.0) + struct.pack("<iii", 8, 8, 8) + struct.pack("<Q", 1) + struct.pack("<iii64d", 4, 8, 12, *data)
    body += struct.pack("<iiiid", 1, 0, 1, 1, 0.4) + struct.pack("<iii", 8, 8, 8) + struct.pack("<Qiiiddd", 1, 1, 2, 3, 0.0, -1.0, 0.0) + struct.pack("<Qiiiid", 1, 95, 6, 3, 2, 0.1234) + struct.pack("<Q", 0)
    (tmp_path / "a.bin").write_bytes(struct.pack("<Q", len(body) + 8) + body)
    cells = problems.read(spark, str(tmp_path)).collect()
    assert [(r.i, r.j, r.k, r.density) for r in cells] == [(5, 10, 15, 0.5)]
    assert [tuple(r)[1:] for r in problems.read(spark, str(tmp_path), "forces").collect()] == [(0, 1, 2, 3, 0.0, -1.0, 0.0)]
    assert [tuple(r)[1:] for r in problems.read(spark, str(tmp_path), "dirichlet").collect()] == [(95, 6, 3, 2, 0.1234)]
    block = problems.blocks(spark.createDataFrame([tuple(cells[0])[1:]], "i int, j int, k int, density double")).first()
    assert (block.i, block.j, block.k) == (4, 8, 12) and block.data == data
    with pytest.raises(ValueError):
        problems.layout(b"\x00" * 8 + body)


def test_problem_files_round_trip(spark, tmp_path):
    from voxmill.sources import problems

    cells = [("x/a.bin", n, 2 * n, -n, n / 8) for n in range(1, 40)] + [("x/b.bin", 0, 0, 0, 1.0)]
    forces = [("x/a.bin", n, 2 * n + 1, n * n + 14, n // 3 + 1, n**0.5, float(n * n), n**3 / 1e4) for n in range(17)]
    fixed, fixed_cells = [("x/a.bin", 94, 11, 16, 1, 0.5432), ("x/a.bin", 95, 6, 3, 2, 0.1234)], [("x/b.bin", 1, 2, 3, 0, 0.0)]
    settings = {"extra string log": "/tmp/x", "extra int sweeps": 3, "extra double damping": 0.5, "dx": 0.01, "global_mu": 2.0, "global_lambda": 1.0, "resolution_x": 128, "krylov_tolerance": 1e-5, "krylov_print": True, "caller_method": "optimisation"}
    tables = [spark.createDataFrame(rows, problems.KINDS[k]) for k, rows in (("density", cells), ("forces", forces), ("dirichlet", fixed), ("dirichlet_cells", fixed_cells))]
    (tmp_path / "out").mkdir()
    for _ in range(2):  # writing again replaces
        problems.write(problems.encoded(*tables, settings), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin", "b.bin"]
    named = lambda df: sorted((r[0].split("/")[-1], *r[1:]) for r in df.collect())
    for kind, rows in (("density", cells), ("forces", forces), ("dirichlet", fixed), ("dirichlet_cells", fixed_cells), ("mu", [])):
        assert named(problems.read(spark, str(tmp_path / "out"), kind)) == sorted((r[0][2:], *r[1:]) for r in rows), kind
    header = {r[1]: r[2] for r in problems.read(spark, str(tmp_path / "out" / "a.bin"), "header").collect()}
    assert {k: header[k] for k in settings} == {k: str(v) for k, v in settings.items()}
    assert problems.last_file(spark, str(tmp_path / "out")).endswith("/b.bin")
    assert problems.last_file(spark, str(tmp_path / "out"), "a*").endswith("/a.bin")


def test_large_problem_files_are_read_by_ranges(spark, tmp_path):
    """Both kinds of a problem of 10^5 blocks: many tasks read and no task writes half a file."""
    from voxmill.sources import problems

    n = F.col("id")
    cells = spark.range(100_000).select(F.lit("a.bin").alias("path"), *((n if c == "i" else F.lit(0)).cast("int").alias(c) for c in "ijk"), (n % 7 + 1).cast("double").alias("mu")).withColumn("i", F.col("i") * 4)
    other = cells.select("path", "i", "j", "k", (F.col("mu") / 2).alias("lambda"))
    forces = spark.range(40_000).select(F.lit("a.bin").alias("path"), F.col("id").alias("seq"), *(F.lit(x).alias(c) for c, x in zip("ijk", (1, 2, 3), strict=True)), *((F.col("id") * x).cast("double").alias(f"f{c}") for c, x in zip("xyz", (1, 2, 3), strict=True)))
    none = spark.createDataFrame([], problems.DIRICHLET)
    problems.write(problems.encoded((cells, other), forces, none, none, {"dx": 0.5, "caller_method": "é"}), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.bin"]
    for kind, want in (("mu", cells), ("lambda", other), ("forces", forces)):
        got = problems.read(spark, str(tmp_path), kind).drop("path")
        assert got.rdd.getNumPartitions() > 1 and got.count() == want.count()
        assert got.select(F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first() == want.select(*got.columns).select(F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first()
    assert problems.read(spark, str(tmp_path), "density").count() == 0
    assert {r.name: r.value for r in problems.read(spark, str(tmp_path), "header").collect()}["caller_method"] == "é"
    bad = problems.encoded((cells, other), forces.withColumn("fx", F.when(F.col("seq") == 39_999, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("fx"))), none, none, {}).withColumn("path", F.lit("b.bin"))
    with pytest.raises(Exception, match="lost"):
        problems.write(bad, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.bin"]


def test_result_and_grid_files(spark, tmp_path):
    import struct

    from voxmill.sources import problems

    def framed(path, body):
        path.write_bytes(struct.pack("<Q", len(body) + 8) + body)

    shape = struct.pack("<iii", 8, 8, 8)
    move, left = np.zeros((64, 4)), np.zeros(64)
    move[5], left[6] = (1.0, 0.0, -2.0, 9.0), 0.25
    body = struct.pack("<iiQQQ", 3, 1, 0, 0, 0) + shape + struct.pack("<Qiii", 1, 4, 0, 0) + move.tobytes() + shape + struct.pack("<Qiii", 1, 0, 4, 0) + left.tobytes()
    body += struct.pack("<Q2s", 2, b"ok") + struct.pack("<Qdd", 2, 1.0, 0.5) + struct.pack("<i?", 0, True)
    (tmp_path / "r").mkdir()
    framed(tmp_path / "r" / "a.bin", body)
    table = lambda kind: [tuple(r)[1:] for r in problems.read_results(spark, str(tmp_path / "r"), kind).collect()]
    assert table("displacements") == [(4, 1, 1, 1.0, 0.0, -2.0)]
    assert table("residual_field") == [(0, 5, 2, 0.25)]
    assert table("residuals") == [(0, 1.0), (1, 0.5)]
    assert dict(table("header")) == {"info": "ok", "error_code": "0", "success": "True"}
    for form, kind, value in (("float", np.float32, 0.5), ("uint8", np.uint8, 200)):
        data = np.zeros(64, kind)
        data[63] = value
        (tmp_path / form).mkdir()
        framed(tmp_path / form / "g.bin", shape + struct.pack("<Qiii", 1, 0, 0, 4) + data.tobytes())
        assert [tuple(r)[1:] for r in problems.read_grid(spark, str(tmp_path / form), form).collect()] == [(3, 3, 7, float(value))]


def test_wing_of_a_profile(spark, tmp_path):
    (tmp_path / "vertices.txt").write_text("4\n1 0 -1 0\n0 0.5\n0 -0.5\n")
    profile = mesh.wing_profile(spark, str(tmp_path / "vertices.txt"))
    points = [(1.0, 0.0), (0.0, 0.5), (-1.0, 0.0), (0.0, -0.5)]
    assert sorted(tuple(r) for r in profile.collect()) == [(n, *p) for n, p in enumerate(points)]
    quads = {(r.surface, r.n, r.step): np.array(r[3:]).reshape(4, 3) for r in mesh.loft(profile, steps=2).collect()}
    assert len(quads) == 3 * 4 * 2
    (x, y), (x1, y1) = points[3], points[0]
    assert np.allclose(quads["side", 3, 1], [(x * s, y * s, z) if first else (x1 * s, y1 * s, z) for first, s, z in ((1, 0.37, 0), (0, 0.37, 0), (0, 0.4, 0.4), (1, 0.4, 0.4))])
    assert np.allclose(quads["near", 3, 1], [(a * t * 0.34, b * t * 0.34, -0.4) for (a, b), t in (((x, y), 0.5), ((x1, y1), 0.5), ((x1, y1), 1), ((x, y), 1))])
    lines = [r.line for r in mesh.quad_lines(mesh.loft(profile, steps=2)).orderBy("part", "n").collect()]
    assert lines[2] == "element vertex 96" and lines[6] == "element face 48" and len(lines) == 9 + 96 + 48


def test_spar_and_target_deformation(spark):
    cells = spark.createDataFrame([(i, j, 0, 1.0) for i in range(20, 45) for j in range(20, 45)], "i int, j int, k int, density double")
    dx, at = 0.02, lambda n: (n - 8) * 0.02 - 0.5
    found = {(r.i, r.j, r.k) for r in conditions.spar_dirichlet(cells, dx, lambda x, y, z: x + 0.15).select("i", "j", "k").collect()}
    expected = {(i + a, j + b, c) for i, j, *_ in cells.collect() if at(i) + 0.15 < 0 and math.hypot(at(i) + 0.1765, at(j) + 0.004) < 0.0691 for a, b, c in product((0, 1), repeat=3)}
    assert found == expected and found
    moved = conditions.target_deformation(cells, (20, 21, 0), (22, 23, 1), (1.0, 0.0, 2.0)).collect()
    assert sorted(tuple(r) for r in moved) == [(i, j, 0, 1.0, 0.0, 2.0, 1.0) for i in (20, 21) for j in (21, 22)]
