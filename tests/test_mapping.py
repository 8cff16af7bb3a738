"""Goldens and properties of the mapping operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.functions import gauss, se2
from cellweave.operators import graph, lookup, occupancy, registration, spatial, trajectory, voxel
from cellweave.schemas import Config
from cellweave.sources import readers, writers
from cellweave.streaming import live


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def pose(spark, p):
    r = row(spark, x=p[0], y=p[1], t=p[2])
    return r.x, r.y, r.t


# pose algebra


def test_component_difference(spark):
    assert pose(spark, se2.component_difference(lits(10, 10, 0), lits(20, 20, 0))) == pytest.approx((10, 10, 0))
    x, y, t = pose(spark, se2.component_difference(lits(-10, 5, 1.2), lits(10, 6, 2)))
    assert (x, y, t) == pytest.approx((20, 1, 0.8)) and math.hypot(x, y) == pytest.approx(math.sqrt(401))
    assert abs(pose(spark, se2.component_difference(lits(0, 0, 0), lits(0, 0, math.pi)))[2]) == pytest.approx(math.pi)


@pytest.mark.parametrize(
    ("a", "b", "points", "want"),
    [
        ((2, 2, math.pi / 2), (0, 0, 0), [(0, 0), (0, 1), (1, 0), (1, 1)], [(2, 2), (1, 2), (2, 3), (1, 3)]),
        ((2, 2, math.pi / 4), (0, 0, math.pi / 2), [(0, 0), (1, 0), (0, 1)], [(2, -2), (2.7, -2.7), (2.7, -1.3)]),
        ((2, 2, math.pi / 4), (-1, 3, math.pi / 2), [(0, 0), (1, 0), (0, 1)], [(-1, -3), (-0.3, -3.7), (-0.29, -2.29)]),
        ((2, 2, 0), (-1, 3, 0), [(0, 0), (1, 0), (0, 1)], [(3, -1), (4, -1), (3, 0)]),
    ],
)
def test_between_frames(spark, a, b, points, want):
    t = se2.between_frames(lits(*a), lits(*b))
    for p, w in zip(points, want):
        x, y = se2.apply(t, F.lit(float(p[0])), F.lit(float(p[1])))
        r = row(spark, x=x, y=y)
        assert (r.x, r.y) == pytest.approx(w, abs=0.1)


def test_inverse_undoes(spark):
    t = lits(3, -1, 2.5)
    assert pose(spark, se2.compose(t, se2.inverse(t))) == pytest.approx((0, 0, 0), abs=1e-12)
    assert pose(spark, se2.compose(lits(1, 2, 0.3), se2.relative(lits(1, 2, 0.3), t))) == pytest.approx((3, -1, 2.5))


def test_segments(spark):
    pt = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    meet = lambda *s, **k: row(spark, m=se2.segments_meet(*[pt(*p) for p in s], **k)).m
    assert meet((0, 0), (2, 2), (0, 2), (2, 0))
    assert not meet((0, 0), (1, 0), (0, 1), (1, 1))
    assert not meet((0, 0), (2, 0), (1, 0), (3, 0))
    assert meet((0, 0), (2, 0), (1, 0), (3, 0), collinear=True)


# cells


def test_extents_grow_and_never_shrink(spark):
    def ext(minx, miny, maxx, maxy):
        box = spark.createDataFrame([(1, minx, maxx, miny, maxy)], "g int, minx double, maxx double, miny double, maxy double")
        return voxel.extents(box, 1.0)

    size = lambda d: (lambda r: (r.left + r.right + 1, r.up + r.down + 1))(d.first())
    a = ext(0.0, 0.0, 10.0, 10.0)
    assert size(a) == (11, 11)
    c = voxel.enlarged(a, ext(-10.0, -10.0, 5.0, 5.0), ["g"])
    assert size(c) == (21, 21)
    assert size(voxel.enlarged(c, ext(-10.0, -10.0, 11.0, 5.0), ["g"])) == (22, 21)


def test_seeded_covariance_and_floor(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(0, 0.04, (60, 2))
    df = spark.createDataFrame([(1, float(x), float(y), 0.0) for x, y in p], "g int, x double, y double, z double")
    r = voxel.floored(voxel.cells(df.filter("abs(x) < 0.12 AND abs(y) < 0.12"), ["g"], 0.25)).first()
    q = p[(np.abs(p) < 0.12).all(axis=1)]
    n, m = len(q), q.mean(axis=0)
    cov = ((q.T @ q + np.eye(2)) / n - np.outer(m, m)) * (n - 1) / n
    values, vectors = np.linalg.eigh(cov)
    cov = vectors @ np.diag(np.maximum(values, 0.01 * max(values[-1], (n - 1) / n**2))) @ vectors.T
    assert (r.cxx, r.cxy, r.cyy) == pytest.approx((cov[0, 0], cov[0, 1], cov[1, 1]))
    inv = np.linalg.inv(cov)
    assert (r.ixx, r.ixy, r.iyy) == pytest.approx((inv[0, 0], inv[0, 1], inv[1, 1]))


def test_equal_eigenvalues(spark):
    r = row(spark, **gauss.floored(*lits(0.5, 0, 0.5, 0.1)))
    assert (r.cxx, r.cxy, r.cyy) == pytest.approx((0.5, 0, 0.5))


def test_merging_by_sums_is_merging_in_pairs(spark):
    cells = spark.createDataFrame(
        [(0, 0, 7, 0.1, 0.0, 0.2, 0.01, 0.1, 0.1, 1.0, True), (0, 0, 9, -0.05, 0.02, 0.1, 0.0, 0.3, 0.1, 1.0, True)],
        "cx bigint, cy bigint, n bigint, mx double, my double, cxx double, cxy double, cyy double, czz double, occ double, has_gaussian boolean",
    )
    a, b = cells.filter("n = 7"), cells.filter("n = 9")
    one, two = voxel.merged_pair(a, b, ["cx", "cy"]).first(), voxel.merged_sums(cells, ["cx", "cy"]).first()
    for c in ("n", "mx", "my", "cxx", "cxy", "cyy", "czz"):
        assert one[c] == pytest.approx(two[c])


def test_move_by_whole_cells(spark):
    rows = spark.createDataFrame([(0, 0, 0.0, 0.0), (2, 0, 2.0, 0.0)], "cx bigint, cy bigint, mx double, my double").withColumns({k: F.lit(2) for k in ("left", "right", "up", "down")})
    out, rx, ry = voxel.moved(rows, 1.5, -3.9, 1.0)
    assert (rx, ry) == pytest.approx((0.5, -0.9)) and out.count() == 0
    out, _, _ = voxel.moved(rows, 1.5, -1.9, 1.0)
    assert {(r.cx, r.cy, r.mx, r.my) for r in out.collect()} == {(-1, -1, -1.0, 1.0), (1, -1, 1.0, 1.0)}


# rays


def _ray(spark, start, end, sides=None, mode="bounded"):
    df = spark.createDataFrame([(1, *map(float, start), *map(float, end))], "rid int, sx double, sy double, ex double, ey double")
    ext = None if sides is None else spark.createDataFrame([sides], "left bigint, right bigint, up bigint, down bigint")
    rows = spatial.ray_cells(df, 1.0, mode, ext).orderBy("step").collect()
    return [(r.cx, r.cy) for r in rows]


NUMBERED = (5, 7, 10, 3)


@pytest.mark.parametrize(
    ("end", "want"),
    [((3, 3), [135, 123, 111]), ((-90, -1.3), [135, 134, 133, 132, 131, 130]), ((0, 20), [135, 122, 109, 96, 83, 70, 57, 44, 31, 18, 5])],
)
def test_rays_on_the_numbered_grid(spark, end, want):
    value = lambda cx, cy: (10 + cy) * 13 + (cx + 5)
    got = [value(*c) for c in _ray(spark, (0, 0), end, NUMBERED)]
    assert [v for v in got if v in want] == want[: len([v for v in got if v in want])] and got[0] == 135


@pytest.mark.parametrize(("start", "end", "n"), [((-3, 0), (-3, 10), 4), ((-8, -3), (10, -3), 0), ((-3, -3), (10, -3), 7), ((0, 0), (0, 10), 4), ((0, 0), (-3, 0), 3), ((-2, -3), (2, -3), 4)])
def test_ray_sizes(spark, start, end, n):
    assert len(_ray(spark, start, end, (3, 3, 3, 3))) == n


def test_short_rays(spark):
    assert _ray(spark, (0, 0), (0.4, 0)) == [(0, 0)]
    assert len(_ray(spark, (0, 0), (0.4, 0), (3, 3, 3, 3), "reference")) == 4
    with pytest.raises(ValueError):
        _ray(spark, (0, 0), (1, 0), None, "reference")


# neighbours


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(5)
    t, q = rng.normal(0, 1, (200, 2)), np.vstack([rng.normal(0, 1, (40, 2)), [[9.0, 9.0]]])
    targets = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)], "tid bigint, tx double, ty double")
    queries = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "qid bigint, qx double, qy double")
    got = {}
    for r in spatial.nearest(queries, targets, [], 3, 0.25).collect():
        got.setdefault(r.qid, {})[r.place] = r.tid
    for i, p in enumerate(q):
        want = np.argsort(((t - p) ** 2).sum(axis=1), kind="stable")[:3]
        assert [got[i][k] for k in (1, 2, 3)] == want.tolist()


def test_nearest_of_crowds_copies_and_far_points(spark):
    rng = np.random.default_rng(6)
    t = np.vstack([rng.normal(0, 0.1, (6000, 2)), np.tile([[0.25, 0.25]], (300, 1)), np.column_stack([np.full(500, 0.5), rng.normal(0, 1, 500)]), [[1e6, -1e6]]])
    q = np.vstack([t[::9], [[1e6, 1e6], [-3e5, 0.0]]])
    ids = rng.permutation(len(t))
    targets = spark.createDataFrame(pd.DataFrame({"tid": ids, "tx": t[:, 0], "ty": t[:, 1]}))
    queries = spark.createDataFrame(pd.DataFrame({"qid": np.arange(len(q)), "qx": q[:, 0], "qy": q[:, 1]}))
    order = np.argsort(ids)
    d2 = ((t[order][None] - q[:, None]) ** 2).sum(axis=2)
    want = np.argsort(d2, axis=1, kind="stable")[:, :4]
    got = spatial.nearest(queries, targets, [], 4, 0.1).toPandas().sort_values(["qid", "place"])
    assert np.array_equal(got.tid.to_numpy().reshape(-1, 4), want) and got.place.tolist() == [1, 2, 3, 4] * len(q)
    keyed = [f.withColumn("k", F.lit(1)) for f in (queries, targets)]
    found = spatial.nearest(*keyed, ["k"], 4).toPandas().sort_values(["qid", "place"])
    assert np.array_equal(found.tid.to_numpy().reshape(-1, 4), want)


def test_tiles_hold_few_targets():
    rng = np.random.default_rng(8)
    p = np.vstack([rng.normal(0, 0.01, (4000, 2)), rng.normal(50, 1, (100, 2)), [[1e9, 0.0]]])
    tiles = spatial._Tiles(p, 4)
    _, tile = tiles.of(p[:, 0], p[:, 1])
    held = np.bincount(tile)
    assert len(tile) == len(p) and held.min() >= 16 and held.max() < 64


def test_block_neighbours_of_the_corner(spark):
    cells = spark.createDataFrame([(x, y, v) for x, y, v in ((3, -3, 303), (2, -2, 202), (1, -1, 101), (0, 0, 0))], "cx bigint, cy bigint, v int")
    q = spark.createDataFrame([(3, -3)], "cx bigint, cy bigint")
    assert {r.v for r in spatial.block_neighbours(q, cells, [], 1).collect()} == {303, 202}
    assert {r.v for r in spatial.block_neighbours(q, cells, [], 2).collect()} == {303, 202, 101}


# folds


def test_clamp_fold_in_buckets_is_the_plain_fold(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0, 0.7, 60)
    rows = spark.createDataFrame([(1, i, i // 7, float(x)) for i, x in enumerate(d)], "k int, i int, b int, d double")
    occ = 0.0
    for x in d:
        occ = min(1, max(-1, occ + x))
    for bucket in (None, "b"):
        assert occupancy.clamp_fold(rows, ["k"], ["i"], "d", bucket).first().occ == pytest.approx(occ)


def test_prefix_poses_in_buckets(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(0, 1, (40, 3))
    rows = spark.createDataFrame([(1, i, i // 6, *map(float, x)) for i, x in enumerate(m)], "k int, i int, b int, dx double, dy double, dtheta double")
    at = np.zeros(3)
    for x in m:
        at = graph._compose(at, x)
    for bucket in (None, "b"):
        r = trajectory.prefix_poses(rows, ["k"], ["i"], bucket).filter("i = 39").first()
        assert (r.x, r.y, r.theta) == pytest.approx(tuple(at))


# look-up tables, registration


def test_kernel():
    assert [v for _, _, v in lookup.kernel(0.25, 0.5)] == [2, 14, 2, 14, 100, 14, 2, 14, 2]


@pytest.mark.parametrize(("outlier", "size", "want"), [(0.3, 2, (-1.9218, 0.4790)), (0.55, 0.25, (-4.8821, 0.2139)), (0.7, 1, (-1.6650, 0.5247))])
def test_fitting_constants(outlier, size, want):
    assert gauss.fitting(outlier, size) == pytest.approx(want, abs=1e-3)


def room(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 1, n)
    wall = rng.integers(0, 4, n)
    x = np.select([wall == 0, wall == 1, wall == 2], [t * 8 - 3, t * 8 - 3, np.full(n, -3.0)], np.full(n, 5.0))
    y = np.select([wall == 0, wall == 1, wall == 2], [np.full(n, -2.0), np.full(n, 3.0), t * 5 - 2], t * 5 - 2)
    pillar = rng.normal([1.5, 0.5], 0.1, (n // 5, 2))
    return np.vstack([np.stack([x, y], 1) + rng.normal(0, 0.02, (n, 2)), pillar])


@pytest.mark.parametrize("method", ["p2d", "d2d", "robust"])
def test_registration_recovers_a_known_motion(spark, method):
    target, want = room(), np.array([0.15, -0.1, 0.12])
    source = registration.moved(room(seed=1), graph.relative_pose(want, np.zeros(3)))
    frame = lambda p: spark.createDataFrame(pd.DataFrame({"pair_id": 1, "x": p[:, 0], "y": p[:, 1]}))
    r = registration.register_pairs(frame(source), frame(target), method).first()
    assert r.converged and abs(r.dx - want[0]) < 0.1 and abs(r.dy - want[1]) < 0.1 and abs(r.dtheta - want[2]) < 0.2


def test_correlative_table_search_agrees_with_columns(spark):
    target, source = room(600), room(600, 2)
    best = registration.correlative(target, source)
    frame = lambda p: spark.createDataFrame(pd.DataFrame({"scan_id": 1, "x": p[:, 0], "y": p[:, 1]}))
    r = lookup.correlative_best(frame(source), frame(target), ["scan_id"]).first()
    table = registration._Table(target, 0.5)
    score = lambda t: table.at(*(lambda ix, iy: (ix + math.floor(t[0] / 0.5), iy - math.floor(t[1] / 0.5)))(*table.index(registration.moved(source, (0, 0, t[2])), 0)))
    assert score(best) == pytest.approx(r.score) and score((r.dx, r.dy, r.theta)) == pytest.approx(r.score)


def test_gradients_are_derivatives():
    g, p, pose = registration.grid(room(), 0.5), room(200, 3), np.array([0.1, 0.05, 0.2])
    d1, d2 = gauss.fitting(0.55, 0.5)
    s = registration.grid(room(800, 4), 0.5)
    for terms in (lambda x: registration.p2d_terms(g, p, x, d1, d2), lambda x: registration.d2d_terms(g, s, x, d1, d2)):
        near = registration._nearest
        try:
            fixed = {}
            registration._nearest = lambda grid, at, k: fixed.setdefault(k, near(grid, at, k))
            _, gradient, _ = terms(pose)
            for i in range(2):
                step = np.eye(3)[i] * 1e-5
                slope = (terms(pose + step)[0] - terms(pose - step)[0]) / 2e-5
                assert slope == pytest.approx(gradient[i], rel=1e-3, abs=1e-3)
        finally:
            registration._nearest = near


# graphs


def _chain(n=20):
    g = graph.PoseGraph()
    for i in range(n):
        g.add_node((float(i), 0.0, 0.0))
    for i in range(n - 1):
        g.add_edge(i, i + 1, (1.0, 0.0, 0.0))
    return g


def test_graph_ids_are_used_again():
    g = _chain()
    assert (len(g.nodes), len(g.edges)) == (20, 19)
    assert [g.remove_edge(i) for i in (10, 11, 200, 10)] == [True, True, False, False]
    assert [g.add_edge(0, 5), g.add_edge(0, 6), g.add_edge(0, 7)] == [11, 10, 19]
    with pytest.raises(IndexError):
        g.edge(500)


def test_graph_edges_of_a_node():
    g = _chain()
    for i in (4, 7, 8, 17, 18):
        g.remove_edge(i)
    assert [g.edges[e][0] for e in sorted(g.edges)] == [0, 1, 2, 3, 5, 6, *range(9, 17)]
    g.add_edge(1, 3), g.add_edge(3, 1)
    assert (len(g.edges_in(3)), len(g.edges_out(3))) == (2, 2)


def test_loop_search_and_optimisation(spark):
    g, at = graph.PoseGraph(), np.zeros(3)
    for i in range(40):
        g.add_node(tuple(at))
        at = graph._compose(at, (1.0, 0.0, 2 * math.pi / 40))
        if i:
            g.add_edge(i - 1, i, (1.0, 0.0, 2 * math.pi / 40 + 0.01))
    found = graph.find_loops(g, 39, lambda a, b, angle: (0.0, 0.0, 0.0), max_distance=3.0, min_distance=20.0)
    assert found and all(a == 39 for a, _, _ in found)
    g.add_edge(39, 0, (1.0, 0.0, 2 * math.pi / 40), "LOOP")
    nodes, edges = g.frames(spark)
    out, chi2 = graph.optimise(spark, nodes, edges)
    assert chi2[-1] < 0.05 * chi2[0]
    assert graph.residuals(edges, out).agg(F.sum("chi2")).first()[0] == pytest.approx(chi2[-1], rel=1e-6)


def test_backward_paths_have_no_last_hop(spark):
    nodes, edges = _chain(40).frames(spark)
    branch = edges.limit(1).select(*[F.lit(v).alias(c) if c in ("id", "src", "dst") else F.col(c) for c, v in zip(edges.columns, (99, 5, 30, *[None] * 6))])
    got = sorted((r.node, r.hop, r.distance) for r in graph.backward_reach(nodes, edges.unionByName(branch)).collect())
    assert got == sorted([(39 - i, i, float(i)) for i in range(40)] + [(5 - i, 10 + i, 10.0 + i) for i in range(6)])
    with pytest.raises(ValueError, match="cycle"):
        graph.backward_reach(nodes, edges.unionByName(edges.limit(1).select(*[F.lit(v).alias(c) if c in ("id", "src", "dst") else F.col(c) for c, v in zip(edges.columns, (99, 39, 0, *[None] * 6))])))


def test_graph_text_round_trip(spark, tmp_path):
    nodes, edges = _chain(4).frames(spark)
    writers.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = readers.graph_text(spark, str(tmp_path / "g"))
    assert n.count() == 4 and {(r.src, r.dst, r.dx) for r in e.collect()} == {(i, i + 1, 1.0) for i in range(3)}
    assert e.first().info == [500.0, 0.0, 0.0, 0.0, 500.0, 0.0, 0.0, 0.0, 5000.0]
    assert {r.line for r in graph.dot_lines(edges, nodes).collect()} >= {"p0->p1", 'p0[ pose="0.0,0.0!"]'}


def test_graph_text_reads_known_tags_only(spark, tmp_path):
    tail = "1.0 2.0 0.5 9.0 0.0 0.0 9.0 0.0 9.0"
    (tmp_path / "g").write_text(f"VERTEX_SE2 0 0 0 0\nEDGE_SE2 0 1 {tail}\nEDGE_SE2_SWITCHABLE 1 2 7 {tail}\nEDGE_SE2_MIXTURE 2 EDGE_SE2 0.9 2 3 {tail}\n\nFIX 0\n")
    n, e = readers.graph_text(spark, str(tmp_path / "g"))
    assert [r.id for r in n.collect()] == [0]
    assert {(r.src, r.dst, r.switch, r.dx, r.dy, r.dtheta) for r in e.collect()} == {(0, 1, None, 1.0, 2.0, 0.5), (1, 2, 7, 1.0, 2.0, 0.5)}


# sources, configuration, streaming


def test_logs(spark, tmp_path):
    (tmp_path / "data.scans").write_text("t0,-1.5,0.5,x,1.0,2.0,99\nt1,0.0,0.1,x,3.0\n")
    scans = readers.scan_log(spark, str(tmp_path / "data.scans"))
    points = {(r.scan_id, r.pt_idx): (r.x, r.y) for r in readers.project(scans).collect()}
    assert set(points) == {(0, 0), (0, 1), (1, 0)} and points[1, 0] == pytest.approx((3.0, 0.0))
    assert readers.scan_log(spark, str(tmp_path / "data.scans"), 1).count() == 1
    (tmp_path / "data.poses").write_text("1327777922168249,29.241,130.653,0.531198\n")
    assert readers.pose_log(spark, str(tmp_path / "data.poses")).first().t_us == 1327777922168249
    assert row(spark, s=readers.split_text(F.lit("a||b|"), "|")).s == ["a", "", "b", ""]


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        Config(loop_score_threshold=1.0)
    with pytest.raises(ValueError):
        registration.robust(room(), room(), rejection=0.0)


def _scans(spark):
    rows = []
    for i in range(8):
        p = registration.moved(room(700, i), graph.relative_pose((0.3 * i, 0.0, 0.0), np.zeros(3)))
        rows.append((7, i, 0.3 if i else 0.0, 0.0, 0.0, p[:, 0].tolist(), p[:, 1].tolist()))
    return spark.createDataFrame(rows, "robot bigint, seq bigint, dx double, dy double, dtheta double, px array<double>, py array<double>")


def test_state_machine_follows_the_motion(spark):
    out = live.replay(_scans(spark), Config(node_generation_distance=1.0)).orderBy("seq").collect()
    assert out[0].event == "init" and "frame" in {r.event for r in out}
    assert abs(out[-1].x - 2.1) < 0.5 and abs(out[-1].y) < 0.4


def test_stateful_stream_equals_replay(spark, tmp_path):
    scans, config = _scans(spark), Config(node_generation_distance=1.0)
    for i in range(2):
        scans.filter(f"seq div 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "in"))
        live.run_to_end(live.live_mapping(stream, config), str(tmp_path / "state"), lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")), "append")
    finally:
        spark.conf.set(key, before)
    got = {r.seq: (r.event, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.seq: (r.event, r.x) for r in live.replay(scans, config).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_replay_gives_each_robot_its_own_task(spark):
    scans = spark.createDataFrame([(r, 0, 0.0, 0.0, 0.0, [0.0], [0.0]) for r in range(4)], "robot bigint, seq bigint, dx double, dy double, dtheta double, px array<double>, py array<double>")
    plan = live.replay(scans, Config())._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {live.ROBOT_TASKS})" in plan and plan.count("Exchange") == 1


def test_edges_into_a_node_follow_removals():
    g = graph.PoseGraph()
    for _ in range(3):
        g.add_node((0.0, 0.0, 0.0))
    first, second = g.add_edge(0, 2), g.add_edge(1, 2)
    assert g.edges_in(2) == [first, second] and g.edges_in(0) == []
    g.remove_edge(first)
    assert g.edges_in(2) == [second] and g.add_edge(2, 1) == first and g.edges_in(1) == [first]


def test_direct_solution_equals_conjugate_gradients(monkeypatch):
    rng = np.random.default_rng(3)
    nodes = pd.DataFrame({"id": range(50), "x": 0.0, "y": 0.0, "theta": 0.0})
    links = pd.DataFrame([(k, k + 1, "ODOM", *rng.normal((1, 0, 0.1), 0.05)) for k in range(49)] + [(k, k - 10, "LOOP", *rng.normal(0, 0.5, 3)) for k in range(10, 50, 10)], columns=["src", "dst", "type", "dx", "dy", "dtheta"])
    solve = lambda: graph._solved(list(nodes.itertuples()), list(links.itertuples()), 10, 1e-6, graph.INFORMATION)
    direct, history = solve()
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "_direct", None)
    other, rounds = solve()
    assert len(history) == len(rounds) and np.allclose(history, rounds) and np.allclose(direct, other, atol=1e-6)
