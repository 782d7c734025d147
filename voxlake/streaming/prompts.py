"""The annotation log as a stream: prompts folded into labels with state for each tile of a slice.

Prompts wait until the watermark passes them and are then applied in event-time order, so arrival order does not
matter; prompts older than the watermark are dropped by Spark. The fold can start from labels that were saved before. A tile's
state is bounded by its size: clicks and resets, which clear an object everywhere on a slice, go to all of its tiles, masks
only to the tiles that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxlake.operators.joins import fact_join

PENDING = "seq bigint, op string, obj_id int, cells string"


class SliceLabels(StatefulProcessor):
    """State of one tile: prompts not yet due, and the labelled voxels."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "ms bigint, seq bigint", PENDING)
        self.labels = handle.getMapState("labels", "y int, x int", "label int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for y, x, label in zip(initialState["y"], initialState["x"], initialState["label"]):
            self.labels.updateValue((int(y), int(x)), (int(label),))

    def _none(self) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in self.names})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for at, seq, op, obj, cells in zip(ms, pdf["seq"], pdf["op"], pdf["obj_id"], pdf["cells"]):
                self.pending.updateValue((int(at), int(seq)), (int(seq), op, int(obj), cells))
                due.add(int(at))
        for at in due:
            self.handle.registerTimer(at + 1)
        yield self._none()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All prompts that are due at once: the labels are read once, and only changed ones are written back."""
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted(tuple(k) for k in self.pending.keys() if k[0] < now)
        if not ready:
            yield self._none()
            return
        labels: dict[tuple[int, int], int] = {}
        cells: dict[int, set[tuple[int, int]]] = {}
        for at, label in self.labels.iterator():
            labels[at[0], at[1]] = label[0]
            cells.setdefault(label[0], set()).add((at[0], at[1]))
        changed: dict[tuple[int, int], tuple[int, int]] = {}

        def put(at: tuple[int, int], label: int, seq: int) -> None:
            old = labels.pop(at, 0)
            if old:
                cells[old].discard(at)
            if label:
                labels[at] = label
                cells.setdefault(label, set()).add(at)
            changed[at] = (label, seq)

        for k in ready:
            seq, op, obj, mask = self.pending.getValue(k)
            self.pending.removeKey(k)
            if op in ("click", "reset_object"):
                for at in list(cells.get(obj, ())):
                    put(at, 0, seq)
            elif op == "reset_all":
                for at in list(labels):
                    put(at, 0, seq)
            if op in ("click", "box", "propagate"):
                for cell in mask.split():
                    y, x = cell.split(",")
                    at = int(y), int(x)
                    if op != "propagate" or at not in labels:
                        put(at, obj, seq)
        for at, (label, _) in changed.items():
            if label:
                self.labels.updateValue(at, (label,))
            else:
                self.labels.removeKey(at)
        rows = [(key[0], key[1], y, x, label, seq) for (y, x), (label, seq) in changed.items()]
        yield pd.DataFrame(rows, columns=self.names)

    def close(self) -> None:
        pass


def square_cells(reach: int = 1) -> Column:
    """A square around the prompt, clipped to the slice, as (y, x) cells."""
    axis = lambda c, n: F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.col(n) - 1))
    return F.flatten(F.transform(axis("y", "ny"), lambda y: F.transform(axis("x", "nx"), lambda x: F.struct(y.alias("y"), x.alias("x")))))


#: Cells (y, x) of a tile.
TILE = (256, 256)
KEY = ("volume_id", "z", "ty", "tx")


def to_tiles(prompts: DataFrame, volumes: DataFrame, reach: int = 1, tile: tuple[int, int] = TILE) -> DataFrame:
    """Send each reset to every tile of its volume and each click to every tile of its slice, so that tiles are independent.

    A column ``cells`` of (y, x) is the prompt's own mask; without one, or where it is null, a square is drawn.
    """
    dims = volumes.select("volume_id", "nz", "ny", "nx")
    rows = prompts.join(dims, "volume_id") if prompts.isStreaming else fact_join(prompts, dims, ["volume_id"])
    every = F.when(F.col("nz") > 0, F.sequence(F.lit(0), F.col("nz") - 1))
    slices = F.when(F.col("op").startswith("reset"), every).otherwise(F.array("z"))
    drawn = F.coalesce("cells", square_cells(reach)) if "cells" in prompts.columns else square_cells(reach)
    rows = rows.withColumn("z", F.explode(slices)).withColumn("_c", F.when(F.col("op").isin("click", "box", "propagate"), drawn).otherwise(F.array().cast("array<struct<y:int,x:int>>")))
    each = [F.when(F.col(f"n{a}") > 0, F.sequence(F.lit(0), F.floor((F.col(f"n{a}") - 1) / size).cast("int"))) for a, size in zip("yx", tile)]
    rows = rows.withColumn("ty", F.explode(each[0])).withColumn("tx", F.explode(each[1]))
    rows = rows.withColumn("_c", F.expr(f"filter(_c, c -> c.y div {tile[0]} = ty and c.x div {tile[1]} = tx)"))
    rows = rows.filter(F.col("op").startswith("reset") | (F.col("op") == "click") | (F.size("_c") > 0))
    # As text, "y,x y,x", which the state holds as one value.
    text = F.array_join(F.transform("_c", lambda c: F.concat_ws(",", c["y"], c["x"])), " ")
    return rows.select("seq", "ts", *KEY, "op", "obj_id", text.alias("cells"))


def fold_stream(
    prompts: DataFrame, volumes: DataFrame, delay: str = "10 minutes", reach: int = 1, initial: DataFrame | None = None, tile: tuple[int, int] = TILE
) -> DataFrame:
    """Streaming prompts to label changes (label 0 = cleared); update mode. The volume id keeps its type.

    ``initial`` (volume_id, z, y, x, label) are the labels to start from; a restarted query goes on from its checkpoint and
    doesn't read them again. The session must use a state store that holds map state (``voxlake.session.STATE_STORE``).
    """
    timed = prompts.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = to_tiles(timed.withWatermark("ts", delay), volumes, reach, tile)
    out = f"volume_id {prompts.schema['volume_id'].dataType.simpleString()}, z int, y int, x int, label int, seq bigint"
    start = None
    if initial is not None:
        places = [F.floor(F.col(a) / size).cast("int").alias(f"t{a}") for a, size in zip("yx", tile)]
        start = initial.select("volume_id", F.col("z").cast("int").alias("z"), *places, "y", "x", F.col("label").cast("int").alias("label")).groupBy(*KEY)
    return rows.groupBy(*KEY).transformWithStateInPandas(
        SliceLabels([c.split()[0] for c in out.split(", ")]), outputStructType=out, outputMode="Update", timeMode="EventTime", initialState=start
    )


def latest_labels(changes: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Label changes (a table the stream wrote), on top of the labels it started from, to the labels that stand."""
    rows = changes.select("volume_id", "z", "y", "x", "seq", "label")
    if initial is not None:
        rows = rows.unionByName(initial.select("volume_id", "z", "y", "x", F.lit(-(2**62)).alias("seq"), F.col("label").cast("int").alias("label")))
    last = rows.groupBy("volume_id", "z", "y", "x").agg(F.max(F.struct("seq", "label")).alias("_l"))
    return last.filter(F.col("_l.label") != 0).select("volume_id", "z", "y", "x", F.col("_l.label").alias("label"))
