"""Pose graphs as tables: edits, accessors, loop candidates, the best-first search, exports and least-squares optimisation."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import se2
from cellweave.schemas import EDGE
from cellweave.storage import stored

INFORMATION = (500.0, 500.0, 5000.0)  # the diagonal every edge gets


class PoseGraph:
    """The small graph of one robot, edited on the driver; frames() gives it as tables. Freed ids are used again, last first."""

    def __init__(self) -> None:
        self.nodes: dict[int, tuple[float, float, float]] = {}
        self.edges: dict[int, tuple[int, int, str, str, tuple[float, float, float]]] = {}
        self._in: dict[int, set[int]] = {}  # edges by their last node
        self._free: list[int] = []
        self._next = 0

    def add_node(self, pose: tuple[float, float, float]) -> int:
        self.nodes[len(self.nodes)] = pose
        return len(self.nodes) - 1

    def add_edge(self, src: int, dst: int, step: tuple[float, float, float] = (0.0, 0.0, 0.0), kind: str = "ODOM", state: str = "ACTIVE") -> int:
        if src not in self.nodes or dst not in self.nodes:
            raise IndexError(f"no node {src} or {dst}")
        if self._free:
            edge = self._free.pop()
        else:
            edge, self._next = self._next, self._next + 1
        self.edges[edge] = (src, dst, kind, state, step)
        self._in.setdefault(dst, set()).add(edge)
        return edge

    def remove_edge(self, edge: int) -> bool:
        if edge not in self.edges:
            return False
        self._in[self.edges.pop(edge)[1]].discard(edge)
        self._free.append(edge)
        return True

    def edge(self, edge: int) -> tuple:
        if edge not in self.edges:
            raise IndexError(f"no edge {edge}")
        return self.edges[edge]

    def edges_in(self, node: int) -> list[int]:
        return sorted(self._in.get(node, ()))

    def edges_out(self, node: int) -> list[int]:
        return [e for e, x in sorted(self.edges.items()) if x[0] == node]

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        info = [float(v) for v in np.diag(INFORMATION).ravel()]
        nodes = [(i, *map(float, p), i) for i, p in self.nodes.items()]
        edges = [(i, s, d, k, st, *map(float, t), info) for i, (s, d, k, st, t) in self.edges.items()]
        return spark.createDataFrame(nodes, "id bigint, x double, y double, theta double, frame_id bigint"), spark.createDataFrame(edges, EDGE)


def with_ends(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges that are not removed, with the poses of both ends (sx, sy, st; ex, ey, et)."""
    end = lambda p, on: nodes.select(*keys, F.col("id").alias(on), *[F.col(c).alias(p + c[0]) for c in ("x", "y", "theta")])
    live = edges.filter("state <> 'REMOVED'")
    return live.join(end("s", "src"), [*keys, "src"]).join(end("e", "dst"), [*keys, "dst"])


def _poses() -> tuple[se2.Pose, se2.Pose, se2.Pose]:
    return tuple(tuple(F.col(c) for c in cs) for cs in (("sx", "sy", "st"), ("ex", "ey", "et"), ("dx", "dy", "dtheta")))


def residuals(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = (), information: tuple[float, float, float] = INFORMATION) -> DataFrame:
    """Edges with their error e0, e1, e2 and chi2."""
    e = se2.edge_error(*_poses())
    rows = with_ends(edges, nodes, keys).withColumns({f"e{i}": e[i] for i in range(3)})
    return rows.withColumn("chi2", sum(w * F.col(f"e{i}") ** 2 for i, w in enumerate(information)))


def jacobians(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges with the row-major blocks a and b."""
    a, b = se2.edge_jacobians(*_poses())
    return with_ends(edges, nodes, keys).withColumns({f"a{i}": v for i, v in enumerate(a)} | {f"b{i}": v for i, v in enumerate(b)})


def normal_blocks(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = (), information: tuple[float, float, float] = INFORMATION) -> DataFrame:
    """i, j, h0..h8 of the normal equations: J' W J summed over the edges of each pair of nodes, i <= j."""
    a, b = se2.edge_jacobians(*_poses())
    rows = with_ends(edges, nodes, keys)

    def block(p, q, r, c):
        return sum(information[k] * p[3 * k + r] * q[3 * k + c] for k in range(3))

    parts = []
    for i, j, p, q in (("src", "src", a, a), ("dst", "dst", b, b), ("src", "dst", a, b)):
        entry = [block(p, q, r, c) for r in range(3) for c in range(3)]
        if i != j:  # of a pair, the block above the diagonal
            swap = [block(q, p, r, c) for r in range(3) for c in range(3)]
            entry = [F.when(F.col("src") < F.col("dst"), x).otherwise(y) for x, y in zip(entry, swap)]
        parts.append(F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), *[x.alias(f"h{n}") for n, x in enumerate(entry)]))
    rows = rows.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.*")
    return rows.groupBy(*keys, "i", "j").agg(*[F.sum(f"h{n}").alias(f"h{n}") for n in range(9)])


def loop_candidates(nodes: DataFrame, keys: tuple[str, ...], max_distance: float, min_path: float) -> DataFrame:
    """Pairs a > b of nodes (keys, id, x, y, path) near in space but far along the path, by cells as wide as the distance."""
    cell = lambda c: F.floor(F.col(c) / max_distance).cast("long")
    rows = nodes.withColumns({"cx": cell("x"), "cy": cell("y")})
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = rows.withColumn("o", F.explode(shifts)).select(*keys, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("path").alias("ap"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    right = rows.select(*keys, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("path").alias("bp"), "cx", "cy")
    pairs = left.join(right, [*keys, "cx", "cy"])
    dist = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = pairs.withColumn("distance", dist).withColumn("path_distance", F.col("ap") - F.col("bp"))
    return pairs.filter((F.col("a") > F.col("b")) & (F.col("distance") < max_distance) & (F.col("path_distance") >= min_path)).select(*keys, "a", "b", "distance", "path_distance")


def backward_reach(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """node, hop, distance: every path backward over odometry edges from the node of largest id of each graph.

    Paths double: a round joins what is reached with the paths of 1, 2, 4, ... edges, so rounds grow with the logarithm of the
    longest path. Nothing is broadcast. A cycle has paths without end and is an error.
    """
    last = nodes.groupBy(*keys).agg(F.max("id").alias("node"), F.count(F.lit(1)).alias("n"))
    reach = stored(last.select(*keys, "node", F.lit(0).alias("hop"), F.lit(0.0).alias("distance"), "n"))
    most = reach.agg(F.max("n")).first()[0] or 0
    reach = reach.drop("n")
    paths = stored(edges.filter("type = 'ODOM'").select(*keys, F.col("dst").alias("at"), F.col("src").alias("to"), F.abs("dx").alias("way")))
    edge_count = 1
    while True:
        more = reach.join(paths.withColumnRenamed("at", "node").hint("merge"), [*keys, "node"])
        more = stored(more.select(*keys, F.col("to").alias("node"), (F.col("hop") + edge_count).alias("hop"), (F.col("distance") + F.col("way")).alias("distance")))
        if more.isEmpty():
            return reach
        if edge_count >= most:
            raise ValueError("odometry edges of a graph form a cycle")
        reach = reach.unionByName(more)
        onward = paths.select(*keys, F.col("at").alias("to"), F.col("to").alias("end"), F.col("way").alias("rest"))
        paths = paths.join(onward.hint("merge"), [*keys, "to"]).select(*keys, "at", F.col("end").alias("to"), (F.col("way") + F.col("rest")).alias("way"))
        paths, edge_count = stored(paths), 2 * edge_count


def markers(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One arrow for each edge: odometry red, loops green."""
    rows = with_ends(edges, nodes, keys)
    return rows.select(*keys, "id", "sx", "sy", "ex", "ey", F.when(F.col("type") == "ODOM", "red").otherwise("green").alias("colour"))


def dot_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph as lines of DOT text."""
    n = nodes.select(F.format_string("p%d[ pose=\"%s,%s!\"]", F.col("id"), F.round("x", 3).cast("string"), F.round("y", 3).cast("string")).alias("line"))
    e = edges.filter("state <> 'REMOVED'").select(F.format_string("p%d->p%d", F.col("src"), F.col("dst")).alias("line"))
    return n.unionByName(e)


def max_mixture(residual_rows: DataFrame, weights: tuple[float, float] = (0.9, 0.1), null_information: float = 5e-9, information: tuple[float, float, float] = INFORMATION) -> DataFrame:
    """component: 0 if the edge's own Gaussian explains its error best, 1 if the null hypothesis does."""
    def cost(w: float, info: tuple[float, float, float]):
        return -math.log(w) - 0.5 * sum(map(math.log, info)) + 0.5 * sum(v * F.col(f"e{i}") ** 2 for i, v in enumerate(info))

    costs = [cost(weights[0], information), cost(weights[1], (null_information,) * 3)]
    return residual_rows.withColumns({"cost0": costs[0], "cost1": costs[1]}).withColumn("component", F.when(F.col("cost1") < F.col("cost0"), 1).otherwise(0))


def switchable(residual_rows: DataFrame, switch) -> DataFrame:
    """Errors scaled by a switch held to 0..1, and the error of its prior."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), switch))
    return residual_rows.withColumn("s", s).withColumns({f"e{i}": F.col("s") * F.col(f"e{i}") for i in range(3)}).withColumn("prior", 1 - F.col("s"))


def _compose(a, b):
    c, s = math.cos(a[2]), math.sin(a[2])
    return np.array([c * b[0] - s * b[1] + a[0], s * b[0] + c * b[1] + a[1], math.atan2(math.sin(a[2] + b[2]), math.cos(a[2] + b[2]))])


def _inverse(t):
    return _compose((0, 0, -t[2]), (-t[0], -t[1], 0.0))


def relative_pose(a, b):
    return _compose(_inverse(a), b)


def find_loops(graph: PoseGraph, node: int, match: Callable[[int, int, float], tuple | None], max_distance: float = 15.0, min_distance: float = 20.0, depth: int = 50, order: str = "max_det") -> list[tuple[int, int, tuple]]:
    """Loops from a node: backward over in-edges, by the determinant of the covariance, largest first (or least, 'min_det').

    match(source, target, guess angle) gives the transform or None; at most `depth` matches are tried.
    """
    visited, used, heap, turn = {node}, set(), [], 0

    def push(at: int, cov: np.ndarray, t: np.ndarray, dist: float) -> None:
        nonlocal turn
        for e in graph.edges_in(at):
            if e in used:
                continue
            used.add(e)
            src, _, _, _, step = graph.edges[e]
            if src in visited:
                continue
            back = _inverse(step)
            c, s = math.cos(t[2]), math.sin(t[2])
            j1 = np.array([[1, 0, -s * back[0] - c * back[1]], [0, 1, c * back[0] - s * back[1]], [0, 0, 1]])
            j2 = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
            new = j1 @ cov @ j1.T + j2 @ np.diag(1 / np.array(INFORMATION)) @ j2.T
            det = float(np.linalg.det(new))
            turn += 1
            heapq.heappush(heap, (-det if order == "max_det" else det, turn, src, new, _compose(back, t), dist + math.hypot(back[0], back[1])))

    push(node, np.zeros((3, 3)), np.zeros(3), 0.0)
    found, tried = [], 0
    while heap and len(visited) < len(graph.nodes) and tried < depth:
        _, _, at, cov, t, dist = heapq.heappop(heap)
        a, b = graph.nodes[node], graph.nodes[at]
        if math.hypot(a[0] - b[0], a[1] - b[1]) < max_distance and dist >= min_distance:
            tried += 1
            result = match(at, node, float(relative_pose(a, b)[2]))
            if result is not None:
                found.append((node, at, result))
        visited.add(at)
        push(at, cov, t, dist)
    return found


GRAPH_TASKS = 256  # a fixed number, which adaptive execution does not cut to a few by the bytes of the rows
SMALL = 200  # nodes of a graph whose normal equations are solved as one dense matrix


def _direct(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step that solves the normal equations, the first node held."""
    n, d = len(g), np.arange(3)
    at, parts = [], []
    for p, q, left, right in ((i, i, wa, a), (j, j, wb, b), (i, j, wa, b), (j, i, wb, a)):
        at.append(((3 * p[:, None, None] + d[:, None]) * 3 * n + 3 * q[:, None, None] + d).ravel())
        parts.append((left.transpose(0, 2, 1) @ right).ravel())
    h = np.bincount(np.concatenate(at), np.concatenate(parts), 9 * n * n).reshape(3 * n, 3 * n)
    step = np.zeros_like(g)
    step[1:] = np.linalg.solve(h[3:, 3:], -g[1:].ravel()).reshape(-1, 3)
    return step


def _solved(rows: list, links: list, iterations: int, gain: float, information: tuple[float, float, float]) -> tuple[np.ndarray, list[float]]:
    """Gauss-Newton over the rows of one graph, in the order of their ids: poses and chi2 after each round. The first node stays.

    Start poses follow the odometry from the first node where it reaches. Graphs of up to SMALL nodes that it reaches whole are
    solved directly, others by conjugate gradients, whose memory grows with the edges only.
    """
    at = {r.id: i for i, r in enumerate(rows)}
    x = np.array([[r.x, r.y, r.theta] for r in rows], float).reshape(-1, 3)
    i, j = (np.array([at[getattr(r, k)] for r in links], int) for k in ("src", "dst"))
    z = np.array([[r.dx, r.dy, r.dtheta] for r in links], float).reshape(-1, 3)
    seen = {0}
    for r in sorted((r for r in links if r.type == "ODOM"), key=lambda r: (r.src, r.dst)):
        if at[r.src] in seen and at[r.dst] not in seen:
            x[at[r.dst]] = _compose(x[at[r.src]], (r.dx, r.dy, r.dtheta))
            seen.add(at[r.dst])
    w, history = np.array(information), []
    wrap = lambda a: np.arctan2(np.sin(a), np.cos(a))

    def errors(p):
        d, c, s = p[j] - p[i], np.cos(p[i, 2]), np.sin(p[i, 2])
        r = np.stack([c * d[:, 0] + s * d[:, 1], c * d[:, 1] - s * d[:, 0], wrap(d[:, 2])], 1) - z
        c, s = np.cos(z[:, 2]), np.sin(z[:, 2])
        return np.stack([c * r[:, 0] + s * r[:, 1], c * r[:, 1] - s * r[:, 0], wrap(r[:, 2])], 1)

    for _ in range(iterations if len(links) else 0):
        e = errors(x)
        history.append(float((w * e * e).sum()))
        if len(history) > 1 and history[-2] - history[-1] < gain * history[-2]:
            break
        angle, d = z[:, 2] + x[i, 2], x[j] - x[i]
        c, s, o = np.cos(angle), np.sin(angle), np.zeros(len(angle))
        a = np.stack([-c, -s, c * d[:, 1] - s * d[:, 0], s, -c, -(c * d[:, 0] + s * d[:, 1]), o, o, o - 1], 1).reshape(-1, 3, 3)
        b = np.stack([c, s, o, -s, c, o, o, o, o + 1], 1).reshape(-1, 3, 3)
        wa, wb = a * w[None, :, None], b * w[None, :, None]
        g = np.zeros_like(x)
        np.add.at(g, i, np.einsum("nki,nk->ni", wa, e))
        np.add.at(g, j, np.einsum("nki,nk->ni", wb, e))
        if len(seen) == len(x) <= SMALL:
            x = x + _direct(i, j, a, b, wa, wb, g)
            x[:, 2] = wrap(x[:, 2])
            continue
        diag = np.zeros((len(x), 3, 3))
        np.add.at(diag, i, np.einsum("nki,nkj->nij", wa, a))
        np.add.at(diag, j, np.einsum("nki,nkj->nij", wb, b))
        g[0] = 0
        inv = np.linalg.inv(diag + 1e-9 * np.eye(3))

        def times(v):
            r = np.einsum("nij,nj->ni", a, v[i]) + np.einsum("nij,nj->ni", b, v[j])
            out = np.zeros_like(v)
            np.add.at(out, i, np.einsum("nki,nk->ni", wa, r))
            np.add.at(out, j, np.einsum("nki,nk->ni", wb, r))
            out[0] = 0
            return out

        step, res = np.zeros_like(x), -g
        y = np.einsum("nij,nj->ni", inv, res)
        y[0] = 0
        p, rho = y.copy(), float((res * y).sum())
        for _ in range(6 * len(x) + 30):
            if rho < 1e-16:
                break
            q = times(p)
            alpha = rho / float((p * q).sum())
            step, res = step + alpha * p, res - alpha * q
            y = np.einsum("nij,nj->ni", inv, res)
            y[0] = 0
            new = float((res * y).sum())
            p, rho = y + new / rho * p, new
        x = x + step
        x[:, 2] = wrap(x[:, 2])
    history.append(float((w * errors(x) ** 2).sum()) if len(links) else 0.0)
    return x, history


_NODE, _LINK = ["id", "x", "y", "theta"], ["src", "dst", "type", "dx", "dy", "dtheta"]


def optimise(spark, nodes: DataFrame, edges: DataFrame, iterations: int = 10, gain: float = 1e-6, information: tuple[float, float, float] = INFORMATION) -> tuple[DataFrame, list[float]]:
    """The optimised poses (id, x, y, theta) of one graph and chi2 after each round.

    Nodes are keyframes, some metres apart, so a graph fits the driver.
    """
    rows = nodes.select(*_NODE).orderBy("id").collect()
    links = edges.filter("state <> 'REMOVED'").select(*_LINK).orderBy("id").collect()
    x, history = _solved(rows, links, iterations, gain, information)
    return spark.createDataFrame([(int(r.id), *map(float, v)) for r, v in zip(rows, x)], "id bigint, x double, y double, theta double"), history


def optimise_each(nodes: DataFrame, edges: DataFrame, key: str = "robot", iterations: int = 10, gain: float = 1e-6, information: tuple[float, float, float] = INFORMATION) -> DataFrame:
    """id, x, y, theta, key, chi2_first, chi2_last: every graph optimised by itself, one a task at a time."""

    def solve(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own, links = own.sort_values("id"), links.sort_values("id")
        if not len(own):  # edges without nodes
            return own.assign(chi2_first=0.0, chi2_last=0.0)[[*_NODE, key, "chi2_first", "chi2_last"]]
        x, history = _solved(list(own.itertuples(index=False)), list(links.itertuples(index=False)), iterations, gain, information)
        return own.assign(x=x[:, 0], y=x[:, 1], theta=x[:, 2], chi2_first=history[0], chi2_last=history[-1])[[*_NODE, key, "chi2_first", "chi2_last"]]

    left = nodes.select(key, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in _NODE[1:]])
    right = edges.filter("state <> 'REMOVED'").select(key, "id", *_LINK)
    schema = f"id long, x double, y double, theta double, {key} {nodes.schema[key].dataType.simpleString()}, chi2_first double, chi2_last double"
    left, right = (d.repartition(GRAPH_TASKS, key) for d in (left, right))
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(solve, schema)
