"""Live operation: cells from a point stream, time synchronisation, and the mapping state of each robot."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellweave.operators import registration, voxel
from cellweave.operators.graph import PoseGraph, _compose, find_loops, relative_pose
from cellweave.schemas import Config

ROBOT_TASKS = 512  # more than robots, so that few share a task
STATE_OUT = "robot bigint, seq bigint, x double, y double, theta double, event string, node bigint, loop_to bigint"


def run_to_end(df: DataFrame, checkpoint: str, write, mode: str = "update") -> None:
    """Runs a stream over all that is there; write(batch, id) gets every micro-batch."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_cells(points: DataFrame, size: float) -> DataFrame:
    """Cells of each scan so far, from a stream of points; sums are the state, so it grows with cells only."""
    return voxel.cells(points, ["scan_id"], size)


def synchronised(left: DataFrame, right: DataFrame, tolerance: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Stream pairs (robot, ts) within the tolerance; rows wait in state until the watermark passes. Mutual nearest pairs are
    picked afterwards, as trajectory.nearest_in_time does."""
    a = left.withWatermark("ts", lateness).alias("a")
    b = right.withWatermark("ts", lateness).alias("b")
    near = F.expr(f"a.robot = b.robot AND b.ts >= a.ts - INTERVAL {tolerance} AND b.ts <= a.ts + INTERVAL {tolerance}")
    return a.join(b, near).select(F.col("a.robot").alias("robot"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.abs(F.unix_micros("a.ts") - F.unix_micros("b.ts")).alias("gap_us"))


class MappingState:
    """One robot: gates on motion, registers scans to a running window, emits frames, closes loops."""

    def __init__(self, config: Config) -> None:
        self.config, self.ready = config, False
        self.position = np.zeros(3)  # in the world
        self.local = np.zeros(3)  # in the window
        self.unused, self.frame_move, self.last_move = np.zeros(3), np.zeros(3), np.zeros(3)
        self.window = np.empty((0, 2))  # points near the robot, in the window's frame
        self.frame = np.empty((0, 2))
        self.frames: list[np.ndarray] = []
        self.graph = PoseGraph()

    def update(self, motion: np.ndarray, points: np.ndarray) -> tuple[str, int | None, int | None]:
        """What the scan did: init, skip, step or frame; the node made and the node it closed a loop to."""
        c = self.config
        if not self.ready:
            self.ready, self.window, self.frame = True, points, points
            return "init", None, None
        self.unused = _compose(self.unused, motion)
        if abs(self.unused[2]) <= c.gate_rotation and math.hypot(*self.unused[:2]) <= c.gate_distance:
            return "skip", None, None
        self.unused = np.zeros(3)
        guess = _compose(self.local, motion)
        pose, _, ok, _ = registration.p2d(self.window, points, guess, c.cell_size, step=c.p2d_step, outlier=c.p2d_outlier)
        if ok:
            step, self.local = relative_pose(self.local, pose), pose
            near = np.vstack([self.window, registration.moved(points, pose)])
            cells = np.round(near / c.cell_size * 4)  # a few points in each cell keep the window bounded
            near = near[np.unique(cells, axis=0, return_index=True)[1]]
            self.window = near[np.abs(near - pose[:2]).max(axis=1) <= c.window_radius]
        else:
            step = motion
        self.frame_move = _compose(self.frame_move, step)
        if math.hypot(*self.frame_move[:2]) <= c.node_generation_distance:
            self.position = _compose(self.position, step)
            self.frame = np.vstack([self.frame, registration.moved(points, self.frame_move)])
            return "step", None, None
        before = _compose(self.position, step)
        node = self.graph.add_node(tuple(_compose(before, relative_pose(self.frame_move, np.zeros(3)))))
        if node:
            self.graph.add_edge(node - 1, node, tuple(self.last_move))
        self.frames.append(self.frame)
        self.last_move, self.frame_move, self.frame = self.frame_move, np.zeros(3), points
        self.position = before
        return "frame", node, self._close(node)

    def _close(self, node: int) -> int | None:
        c = self.config

        def match(source: int, target: int, angle: float):
            pose, score, ok, _ = registration.robust(self.frames[target], self.frames[source], (0.0, 0.0, angle), c.cell_size, c.loop_score_threshold, step=0.1, rotation=3.0)
            return tuple(pose) if ok else None

        found = find_loops(self.graph, node, match, c.loop_max_distance, c.loop_min_distance, c.search_depth)
        for a, b, step in found:
            self.graph.add_edge(a, b, step, "LOOP")
        return found[0][1] if found else None


class MappingProcessor(StatefulProcessor):
    """Keeps a MappingState for each robot in the state store."""

    def __init__(self, config: Config) -> None:
        self.options = asdict(config)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mapping", "data binary, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        robot, seq = (pickle.loads(held[0]), held[1]) if held else (MappingState(Config(**self.options)), 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            points = np.array([list(p) for p in zip(r.px, r.py)], float).reshape(-1, 2)
            event, node, loop = robot.update(np.array([r.dx, r.dy, r.dtheta]), points)
            seq = int(r.seq)
            out.append((int(key[0]), seq, *map(float, robot.position), event, node, loop))
        self.state.update((pickle.dumps(robot), seq))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATE_OUT.split(", ")])
        yield frame.astype({"node": "Int64", "loop_to": "Int64"})

    def close(self) -> None:
        pass


def live_mapping(scans: DataFrame, config: Config) -> DataFrame:
    """The state machine over a stream (robot, seq, dx, dy, dtheta, px array, py array)."""
    return scans.groupBy("robot").transformWithStateInPandas(MappingProcessor(config), STATE_OUT, "Append", "None")


def replay(scans: DataFrame, config: Config) -> DataFrame:
    """The same over a table: every robot's scans in order, one robot a task, read in Arrow batches.

    Robots are dealt to a fixed number of tasks, which adaptive execution does not join however small their rows are.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        robot, out = MappingState(config), []
        for r in pdf.sort_values("seq").itertuples():
            points = np.stack([np.asarray(r.px, float), np.asarray(r.py, float)], 1)
            event, node, loop = robot.update(np.array([r.dx, r.dy, r.dtheta]), points)
            out.append((int(key[0]), int(r.seq), *map(float, robot.position), event, node, loop))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE_OUT.split(", ")]).astype({"node": "Int64", "loop_to": "Int64"})

    return scans.repartition(ROBOT_TASKS, "robot").groupBy("robot").applyInPandas(run, STATE_OUT)
