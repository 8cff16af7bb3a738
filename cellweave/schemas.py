"""Explicit schemas and the options of the mapping engine."""

from __future__ import annotations

from dataclasses import dataclass

POINT = "scan_id bigint, pt_idx int, x double, y double, z double"
LASER_SCAN = "scan_id bigint, ts timestamp, angle_min double, angle_increment double, range_min double, range_max double, ranges array<double>"
POSE = "x double, y double, theta double"
CELL = "cx bigint, cy bigint, n bigint, mx double, my double, cxx double, cxy double, cyy double, czz double, occ double, has_gaussian boolean"
NODE = f"id bigint, {POSE}, frame_id bigint"
EDGE = "id bigint, src bigint, dst bigint, type string, state string, dx double, dy double, dtheta double, info array<double>"

# Fixed values of the data model.
MIN_OCC, MAX_OCC = -1.0, 1.0
LOG_LIKE_OCCUPANCY = 0.405465108
SENSOR_NOISE = 0.01
MAX_POINTS = 1_000_000_000
NO_GAUSSIAN_UPDATE = -0.2
MIN_POINTS_GAUSSIAN = 6


@dataclass(frozen=True)
class Config:
    """Options of the live engine; the defaults are those of its node.

    Nothing reads the subscribe mode, the frame ids, the merge and ray modes and the least scan points yet.
    """

    window_radius: float = 40.0
    node_generation_distance: float = 2.0
    loop_max_distance: float = 30.0
    loop_min_distance: float = 14.0
    loop_score_threshold: float = 0.6
    cell_size: float = 0.25
    gate_distance: float = 0.2
    gate_rotation: float = 0.1
    search_depth: int = 50
    min_scan_points: int = 400
    subscribe_mode: str = "NON"
    odom_frame_id: str = "odom"
    map_frame_id: str = "map"
    merge_mode: str = "overwrite"
    ray_mode: str = "bounded"
    p2d_step: float = 0.01
    p2d_outlier: float = 0.7

    def __post_init__(self) -> None:
        if not 0 < self.loop_score_threshold < 1:
            raise ValueError("the rejection limit must lie between 0 and 1")
        if self.subscribe_mode not in ("NON", "ODOM", "POSE"):
            raise ValueError(f"unknown subscribe mode {self.subscribe_mode}")
        if self.merge_mode not in ("overwrite", "merge") or self.ray_mode not in ("bounded", "reference"):
            raise ValueError("unknown merge or ray mode")
