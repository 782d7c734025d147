"""Extension points: metrics, transforms, segmenters and models by name, with declared parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import affine as af
from voxlake.operators import chunks as ch
from voxlake.operators import components as cc
from voxlake.operators import flow as fl
from voxlake.operators import geometry as ge
from voxlake.operators import histogram as hi
from voxlake.operators import morphology as mo
from voxlake.operators import score as sc
from voxlake.operators import spectral as sp
from voxlake.operators import splits
from voxlake.operators import superpixels as su
from voxlake.operators import tiles as ti
from voxlake.operators import voxel as vx
from voxlake.operators.joins import VOXEL, densify
from voxlake.session import cut_lineage
from voxlake.sources import catalog as ct


@dataclass(frozen=True)
class Parameter:
    default: Any
    low: float | None = None
    high: float | None = None
    options: Sequence[Any] = ()

    def check(self, name: str, value: Any) -> Any:
        if value is None:
            return value
        if self.options and value not in self.options:
            raise ValueError(f"{name} must be one of {list(self.options)}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name} must lie in {self.low}..{self.high}")
        return value


@dataclass
class Registry:
    kind: str
    entries: dict[str, Callable] = field(default_factory=dict)
    parameters: dict[str, dict[str, Parameter]] = field(default_factory=dict)

    def register(self, name: str, **parameters: Parameter):
        def wrap(fn):
            if name in self.entries:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self.entries[name] = fn
            self.parameters[name] = parameters
            return fn

        return wrap

    def run(self, name: str, *args, **values):
        if name not in self.entries:
            raise KeyError(f"no {self.kind} named {name!r}; known: {sorted(self.entries)}")
        declared = self.parameters[name]
        unknown = set(values) - set(declared)
        if unknown:
            raise ValueError(f"{self.kind} {name!r} has no parameter {sorted(unknown)}")
        full = {p: spec.check(p, values.get(p, spec.default)) for p, spec in declared.items()}
        return self.entries[name](*args, **full)


METRICS = Registry("metric")
TRANSFORMS = Registry("transform")
SEGMENTERS = Registry("segmenter")
MODELS = Registry("model")

metric = METRICS.register
transform = TRANSFORMS.register
segmenter = SEGMENTERS.register
model = MODELS.register


def benchmark(names: Sequence[str], gt: DataFrame, pred: DataFrame, pairs: DataFrame, volumes: DataFrame) -> DataFrame:
    """Long scores (metric, model, volume_id, value) of several metrics; names of one function are computed once."""
    known: dict[Any, list[str]] = {}
    for name in names:
        known.setdefault(METRICS.entries.get(name, name), []).append(name)
    out = None
    for same in known.values():
        rows = METRICS.run(same[0], gt, pred, pairs, volumes).select("model", "volume_id", "value")
        rows = rows.select(F.explode(F.array(*map(F.lit, same))).alias("metric"), "model", "volume_id", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@metric("Average Dice")
def average_dice(gt, pred, pairs, volumes):
    return sc.dice(sc.overlap_counts(gt, pred, pairs)).withColumnRenamed("dice", "value")


def _object_scores(gt, pred, pairs, volumes):
    g = cut_lineage(cc.object_runs(gt, volumes, 3))
    p = cut_lineage(cc.object_runs(pred, volumes, 3, sc.PAIR))
    return sc.object_scores(g, p, sc.match_objects(sc.run_object_pairs(g, p)), pairs).withColumnRenamed("f1", "value")


metric("Mean Object F1")(_object_scores)
metric("Panoptic F1")(_object_scores)


@metric("Boundary F1")
def boundary_f1(gt, pred, pairs, volumes):
    return sc.boundary_f1(gt, pred, volumes, pairs).withColumnRenamed("f1", "value")


# The defaults and bounds below are those that users of these segmenters know.
SMALL = Parameter(50, 0, 10000)


@segmenter("otsu", remove_small_objects=SMALL)
def otsu_segmenter(sparse, volumes, remove_small_objects):
    mask = hi.above(sparse, hi.otsu_of(sparse, volumes))
    return cc.remove_small(mask, volumes, remove_small_objects)


@segmenter("sauvola", window_size=Parameter(25, 3, 101), k=Parameter(0.2, 0.0, 1.0), remove_small_objects=SMALL)
def sauvola_segmenter(sparse, volumes, window_size, k, remove_small_objects):
    local = ch.to_voxels(ch.sauvola(sparse, volumes, window_size, k), ("data", "threshold"), ("v", "threshold"))
    mask = local.filter(F.col("v") > F.col("threshold")).select("volume_id", *VOXEL, F.lit(1).alias("label"))
    return cc.remove_small(mask, volumes, remove_small_objects)


@segmenter("felzenszwalb", scale=Parameter(100.0, 0.0), sigma=Parameter(0.5, 0.0, 5.0), min_size=SMALL)
def felzenszwalb_segmenter(sparse, volumes, scale, sigma, min_size):
    """Superpixels of each slice, those of at most ``min_size`` cells left out."""
    return su.as_labels(su.superpixels(sparse, volumes, scale, sigma, more_than=min_size))


@segmenter("canny", sigma=Parameter(1.0, 0.1, 10.0), low_threshold=Parameter(0.1, 0.0, 1.0), high_threshold=Parameter(0.3, 0.0, 1.0))
def canny_segmenter(sparse, volumes, sigma, low_threshold, high_threshold):
    edges = mo.canny(densify(sparse, volumes, {"v": 0.0}), volumes, sigma, low_threshold, high_threshold)
    return edges.withColumn("label", F.lit(1))


@segmenter("organoid", minimum_size=Parameter(None, 0), sigma=Parameter(None, 0))
def organoid_segmenter(sparse, volumes, minimum_size, sigma):
    return mo.organoid_mask(sparse, volumes, minimum_size, sigma)


@segmenter("single cell", minimum_size=Parameter(0, 0), percentile=Parameter(90.0, 0.0, 100.0))
def single_cell_segmenter(sparse, volumes, minimum_size, percentile):
    return sp.high_frequency_mask(sparse, volumes, percentile, minimum_size)


@segmenter(
    "nuclear",
    percentile=Parameter(90.0, 0.0, 100.0),
    max_freq=Parameter(20.0, 1.0),
    frequency_step=Parameter(1.0, 0.01),
    sigma=Parameter(0.3, 0.1, 100.0),
    remove_background=Parameter(True),
)
def nuclear_segmenter(sparse, volumes, percentile, max_freq, frequency_step, sigma, remove_background):
    return sp.phase_mask(sparse, volumes, percentile, max_freq, frequency_step, sigma, remove_background)


@transform("normalize range", low=Parameter(-1.0), high=Parameter(1.0), mode=Parameter("minmax", options=("minmax", "as_computed")))
def normalize_transform(voxels, low, high, mode):
    return vx.normalize(voxels, low, high, mode)


@transform("uint8", kind=Parameter("float", options=("float", "any", "int", "frame")))
def uint8_transform(voxels, kind):
    return vx.to_uint8(voxels, kind=kind)


@transform("place labels")
def place_labels_transform(labels, data, existing):
    return ct.place_labels(labels, data, existing)


@transform("number cases")
def number_cases_transform(files, existing):
    return ct.name_mapping(ct.number_cases(files, existing))


@transform("plane views")
def plane_views_transform(voxels):
    return ge.multiview(voxels)


@transform("training split", ratio=Parameter(0.8, 0.0, 1.0), seed=Parameter(42))
def training_split_transform(files, ratio, seed):
    return splits.group_split(files, ratio, seed)


@transform("binary mask")
def binary_mask_transform(voxels):
    return vx.binarize(vx.require_uint8(voxels))


@transform("canonical orientation", codes=Parameter("RAS"))
def orientation_transform(voxels, frames, codes):
    return af.reorient(voxels, af.orientations(frames, codes))


@transform("view fusion by flow")
def view_flow_transform(view_labels, views, volumes):
    return fl.flow_fusion(view_labels, views, volumes)


@transform("view consensus", connectivity=Parameter(3, 1, 3))
def view_consensus_transform(view_masks, views, volumes, connectivity):
    return ti.view_consensus(view_masks, views, volumes, connectivity)


def predict(name: str, tiles: DataFrame, schema: str, keys: Sequence[str] | None = None, **values) -> DataFrame:
    """Run a registered model over tile rows; with ``keys`` failing rows are reported and get a zero mask."""
    load = MODELS.run(name, **values)
    return ti.predict(tiles, load, schema) if keys is None else ti.predict_guarded(tiles, load, keys, schema, ti.zero_mask)
