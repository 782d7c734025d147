"""Named queries over the test tables, one module per operator family."""

from importlib import import_module
from importlib.util import find_spec

MODULES = ("catalog", "splits", "voxel", "geometry", "histogram", "morphology", "spectral", "score", "tiles", "prompts", "space")


def load_all() -> None:
    for name in MODULES:
        if find_spec(f"voxlake.plans.{name}") is not None:
            import_module(f"voxlake.plans.{name}")
