"""Result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.ranks import sorted_rank


def score_table(scores: DataFrame, value: str, models: Sequence[str]) -> DataFrame:
    """Long scores to one row per sample and one column per model; samples counted from 0 by volume."""
    wide = scores.groupBy("volume_id").pivot("model", list(models)).agg(F.first(value))
    ranked = sorted_rank(wide, [], ["volume_id"], "_i")
    return ranked.select((F.col("_i") - 1).alias("sample_index"), *models)


def metric_file_name(metric: str) -> str:
    return metric.lower().replace(" ", "_") + ".csv"


def write_scores(table: DataFrame, folder: str, metric: str) -> str:
    """Write the wide scores as CSV part files under <folder>/<metric file name>."""
    target = f"{folder.rstrip('/')}/{metric_file_name(metric)}"
    table.write.mode("overwrite").option("header", True).csv(target)
    return target


def write_channels(voxels: DataFrame, folder: str) -> None:
    """Voxel rows with a channel column, one sub-folder per channel."""
    voxels.write.mode("overwrite").partitionBy("channel").parquet(folder)
