"""Command line options: ``python -m parallaxis.cli -i photos/ -o model.obj``."""

from __future__ import annotations

import argparse
import sys

from parallaxis.model import Config

#: Flags, the options they set, and their kinds.
FLAGS = [
    (("-i", "--input"), "input_dir", str), (("-o", "--output"), "output_path", str), (("--quality",), "quality", str),
    (("--max-image-size",), "max_image_size", int), (("--focal-length",), "focal_length_mm", float), (("--sensor-width",), "sensor_width_mm", float),
    (("--turntable",), "turntable", bool), (("--save-intermediate",), "save_intermediate", bool), (("--pointcloud",), "pointcloud_path", str),
    (("--gpu",), "gpu_id", int), (("--verbose",), "verbose", bool), (("--scale-bar",), "scale_bar_length_mm", float),
    (("--poisson-depth",), "poisson_depth", int), (("--mvs-resolution",), "mvs_resolution", float), (("--decimate",), "decimate_target", int),
]


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{message}\n")


def parse(argv: list[str]) -> Config:
    """Options with their preset applied; flags that are given win. No arguments show the help; bad ones exit with 1."""
    parser = _Parser("parallaxis", description="Multi-view reconstruction from photographs.", allow_abbrev=False)
    for names, target, kind in FLAGS:
        extra = {"action": "store_true"} if kind is bool else {"type": kind}
        parser.add_argument(*names, dest=target, default=argparse.SUPPRESS, **extra)
    if not argv:
        parser.print_help()
        raise SystemExit(0)
    given = vars(parser.parse_args(argv))
    if not given.get("input_dir") or not given.get("output_path"):
        parser.error("an input directory and an output file are required")
    return Config(**given).preset(frozenset(given))


if __name__ == "__main__":
    print(parse(sys.argv[1:]))
