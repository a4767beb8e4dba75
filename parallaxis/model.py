"""Options, presets and schemas."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: What each quality name sets.
PRESETS: dict[str, dict[str, float | int]] = {
    "low": {"max_image_size": 1600, "mvs_resolution": 0.5, "mvs_iterations": 4, "poisson_depth": 8},
    "medium": {"max_image_size": 2400, "mvs_resolution": 0.75, "mvs_iterations": 6, "poisson_depth": 9},
    "high": {},
    "ultra": {"max_image_size": 4800, "mvs_resolution": 1.0, "mvs_iterations": 12, "poisson_depth": 12},
}


@dataclass(frozen=True)
class Config:
    """Options of a reconstruction. Fields under "accepted" are carried but change nothing yet."""

    input_dir: str = ""
    output_path: str = ""
    pointcloud_path: str = ""
    save_intermediate: bool = False
    verbose: bool = False
    quality: str = "high"
    max_image_size: int = 3200
    match_ratio: float = 0.75
    min_matches: int = 30
    min_triangulation_angle: float = 2.0
    max_reprojection_error: float = 4.0
    turntable: bool = False
    focal_length_mm: float = 0.0
    sensor_width_mm: float = 0.0
    mvs_resolution: float = 1.0
    mvs_iterations: int = 12
    mvs_patch_size: int = 11
    scale_bar_length_mm: float = 0.0
    # accepted
    log_path: str = ""
    poisson_depth: int = 10
    poisson_screening: float = 4.0
    smooth_iterations: int = 3
    smooth_lambda: float = 0.5
    decimate_target: int = 0
    gpu_id: int = 0
    gpu_memory_limit: int = 0

    def preset(self, explicit: frozenset[str] = frozenset()) -> Config:
        """With the quality's values; fields named in ``explicit`` keep theirs. An unknown quality changes nothing."""
        return replace(self, **{k: v for k, v in PRESETS.get(self.quality, {}).items() if k not in explicit})


CAMERAS = "image_id int, R array<double>, t array<double>, K array<double>, is_registered boolean"
KEYPOINTS = "image_id int, kp_id int, x float, y float, size float, angle float, response float, octave int, descriptor array<float>"
POINTS = "point_id long, X double, Y double, Z double"
OBSERVATIONS = "point_id long, seq int, image_id int, kp_id int"
DEPTH_PIXELS = "image_id int, y int, x int, depth float, nx float, ny float, nz float, conf float"
EXIF = "focal_mm double, make string, model string, orientation int, valid boolean"
