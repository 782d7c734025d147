"""Join and grid building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.session import num_partitions

VOXEL = ("z", "y", "x")


#: Ways in which ``fact_join`` splits the rows of one key.
SPLIT = 16


def fact_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", parts: int | None = None, one: bool = False) -> DataFrame:
    """Attach one-row-per-key facts to voxel rows when one key may own a third of the voxels.

    The key travels as a struct, so the rows are dealt anew for this join alone. Adaptive execution can then split a hot
    key of the big side, and sends the small side to all tasks only if the bytes it really wrote are few. With ``parts`` the rows
    are dealt over so many partitions, where each key's are split ``SPLIT`` ways, and the small side is repeated as often. With
    ``one`` there is one key, such as a constant: its few facts go to all tasks, as the planner would make a product of both sides.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only the big side may be preserved")
    left = big.withColumn("_key", F.struct(*on))
    right = small.select(F.struct(*on).alias("_key"), *[c for c in small.columns if c not in on])
    if one:
        return left.join(F.broadcast(right), "_key", how).drop("_key")
    if parts:
        left = left.withColumn("_split", F.coalesce(F.pmod(F.hash(*big.columns), F.lit(SPLIT)), F.lit(0))).repartition(parts, "_key", "_split")
        right = right.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        return left.join(right, ["_key", "_split"], how).drop("_key", "_split")
    return left.join(right, "_key", how).drop("_key")


def voxel_grid(volumes: DataFrame, keys: Sequence[str] = ("volume_id",), keep: Sequence[str] = ()) -> DataFrame:
    """All (z, y, x) of each volume, with the ``keep`` columns of the volume table.

    Lines are spread over the cluster before their cells are made, so one huge volume is
    never expanded inside a single task. A volume with an empty axis has no cells.
    """
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    spark = volumes.sparkSession
    carried = list(dict.fromkeys([*keys, *keep]))
    planes = volumes.select(*dict.fromkeys([*carried, "ny", "nx"]), F.explode(upto("nz")).alias("z"))
    lines = planes.select(*dict.fromkeys([*carried, "nx"]), "z", F.explode(upto("ny")).alias("y"))
    spread = lines.repartition(num_partitions(spark), *keys, "z", "y")
    return spread.select(*carried, "z", "y", F.explode(upto("nx")).alias("x"))


def densify(
    sparse: DataFrame, volumes: DataFrame, fill: dict[str, object], keys: Sequence[str] = ("volume_id",)
) -> DataFrame:
    """Sparse voxel rows to one row per grid cell; missing cells take the fill values."""
    grid = voxel_grid(volumes, keys)
    out = grid.join(sparse.select(*keys, *VOXEL, *fill), [*keys, *VOXEL], "left")
    return out.select(*keys, *VOXEL, *[F.coalesce(F.col(c), F.lit(f)).alias(c) for c, f in fill.items()])


def raster(volumes_or_dims: tuple[int, int] | None = None) -> Column:
    """Raster index (z*ny + y)*nx + x; dims come from columns ny, nx unless given."""
    ny, nx = (F.col("ny"), F.col("nx")) if volumes_or_dims is None else (F.lit(volumes_or_dims[0]), F.lit(volumes_or_dims[1]))
    return (F.col("z").cast("bigint") * ny + F.col("y")) * nx + F.col("x")


def offsets(kind: int, half: bool = False) -> list[tuple[int, int, int]]:
    """Neighbour offsets in raster order; ``kind`` = how many axes may change (1=6, 2=18, 3=26)."""
    steps = (-1, 0, 1)
    out = [(a, b, c) for a in steps for b in steps for c in steps if 0 < abs(a) + abs(b) + abs(c) <= kind]
    return [o for o in out if o > (0, 0, 0)] if half else out


def offset_array(moves: Sequence[Sequence[float]], names: Sequence[str]) -> Column:
    """Literal array of structs, exploded next to each voxel to reach its neighbours without a join."""
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(m, names)]) for m in moves]
    return F.array(*rows)


#: Grid cell of a voxel that ``box_join`` has listed.
CELL = ("_cz", "_cy", "_cx")


def box_join(
    boxes: DataFrame,
    voxels: DataFrame,
    keys: Sequence[str] = ("volume_id",),
    cell: tuple[int, int, int] = (16, 64, 64),
    parts: int | None = None,
    listed: bool = False,
) -> DataFrame:
    """Boxes (z0,y0,x0,dz,dy,dx, half-open) joined with the voxels they hold.

    Each box is listed under the grid cells it touches, so the range condition becomes an equi-join
    on (keys, cell) and one large volume is split over its cells. Listing multiplies the box rows beyond
    what the planner estimates, so neither side may be broadcast. ``parts`` deals the voxels over so many partitions; with
    ``listed`` the rows keep their grid cell (``CELL``), by which they lie together.
    """
    b = boxes
    v = voxels
    cells = []
    for axis, size in zip(VOXEL, cell):
        last = F.col(f"{axis}0") + F.col(f"d{axis}") - 1
        span = F.sequence(F.floor(F.col(f"{axis}0") / size).cast("int"), F.floor(last / size).cast("int"))
        b = b.withColumn(f"_c{axis}", F.explode(span))
        v = v.withColumn(f"_c{axis}", F.floor(F.col(axis) / size).cast("int"))
        cells.append(f"_c{axis}")
    v = v.repartition(parts, *keys, *cells) if parts else v
    joined = v.join(b.hint("merge"), [*keys, *cells])
    inside = None
    for axis in VOXEL:
        cond = (F.col(axis) >= F.col(f"{axis}0")) & (F.col(axis) < F.col(f"{axis}0") + F.col(f"d{axis}"))
        inside = cond if inside is None else inside & cond
    return joined.filter(inside).drop(*([] if listed else cells))
