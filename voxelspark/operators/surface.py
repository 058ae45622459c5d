"""Surface elements of masks and their distances."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import INF, NEG

#: Weight of a voxel in the code of the corner it touches, by offset (z, y, x).
WEIGHTS = {(0, 0, 0): 128, (0, 0, 1): 64, (0, 1, 0): 32, (0, 1, 1): 16, (1, 0, 0): 8, (1, 0, 1): 4, (1, 1, 0): 2, (1, 1, 1): 1}


def _part_triangles(part: list[tuple[int, int, int]]) -> list[tuple[float, float, float]]:
    """Area vectors (z, y, x magnitudes) of the triangles that cut off one part of a cell's corners, joined by edges.

    Vertices are the middles of the cell's edges, so a single corner is cut off by a triangle of an eighth in each
    direction, an edge by two triangles that make a rectangle, and so on.
    """
    across = lambda axis, on, off: tuple(on if k == axis else off for k in range(3))
    neighbours = {c: [d for d in part if sum(map(abs, np.subtract(c, d))) == 1] for c in part}
    axis_of = lambda c, d: int(np.flatnonzero(np.subtract(c, d))[0])
    flat = [k for k in range(3) if len({c[k] for c in part}) == 1]
    eighth, quarter = (1 / 8,) * 3, (2 / 8,) * 3
    most = max(len(x) for x in neighbours.values())
    if len(part) == 1:
        return [eighth]
    if len(part) == 2:
        return [across(axis_of(*part), 0, 2 / 8)] * 2
    if len(part) == 3:
        return [eighth, quarter, across(flat[0], 4 / 8, 0)]
    if flat:
        return [across(flat[0], 4 / 8, 0)] * 2
    if most == 3:
        return [eighth, eighth, quarter, quarter]
    ends = [c for c in part if len(neighbours[c]) == 1]
    return [eighth, (3 / 8,) * 3, *(across(axis_of(c, neighbours[c][0]), 0, 2 / 8) for c in ends)]


def _triangles(code: int) -> list[tuple[float, float, float]]:
    """Triangles of a code: the smaller side of the cell's corners, each part of it by itself."""
    corners = [c for c, w in WEIGHTS.items() if code & w]
    if len(corners) > 4:
        corners = [c for c, w in WEIGHTS.items() if not code & w]
    out, left = [], set(corners)
    while left:
        part, edge = [], [left.pop()]
        while edge:
            c = edge.pop()
            part.append(c)
            near = [d for d in left if sum(map(abs, np.subtract(c, d))) == 1]
            left -= set(near)
            edge += near
        out += _part_triangles(sorted(part))
    return out


def areas(spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> list[float]:
    """Surface area of each of the 256 codes, from the geometry of a cell of 2 x 2 x 2 voxels."""
    s0, s1, s2 = spacing
    size = lambda n: sqrt((n[0] * s1 * s2) ** 2 + (n[1] * s0 * s2) ** 2 + (n[2] * s0 * s1) ** 2)
    return [sum(sorted(map(size, _triangles(code)))) for code in range(256)]


def surface_elements(df: DataFrame, side: str, spacing: Sequence[float] = (1.0, 1.0, 1.0), keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, z, y, x, code, area) of the corners where a mask has a surface. Only set voxels are dealt out."""
    offsets = F.array(*[F.struct(*[F.lit(1 - o).alias(n) for o, n in zip(off, ("dz", "dy", "dx"), strict=True)], F.lit(w).alias("w")) for off, w in WEIGHTS.items()])
    touched = df.where(F.col(side) == 1).select(*keys, "z", "y", "x", F.inline(offsets))
    corner = touched.groupBy(*keys, (F.col("z") + F.col("dz")).alias("z"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).agg(F.sum("w").cast("int").alias("code"))
    table = F.array(*[F.lit(a) for a in areas(spacing)])
    return corner.where("code <> 255").select(*keys, "z", "y", "x", "code", F.get(table, F.col("code")).alias("area"))


#: Cells of a volume that a pass along an axis takes at once.
BLOCK = 1 << 21


def _lower_envelope(cost: np.ndarray, step: float) -> np.ndarray:
    """min over j of cost[j] + ((i - j) * step)^2 for each line of (places, lines), in time linear in the places.

    Of each line a stack of parabolas is kept, the lowest from left to right; all lines go on together.
    """
    n, lines = cost.shape
    at = np.arange(n) * step
    lowest = np.zeros((n, lines), np.int32)
    since = np.full((n, lines), np.inf)
    top = np.full(lines, -1)
    for j in range(n):
        active = np.flatnonzero(np.isfinite(cost[j]))
        while active.size:
            depth = top[active]
            old = lowest[depth, active]
            with np.errstate(divide="ignore", invalid="ignore"):
                meet = (cost[j, active] + at[j] ** 2 - cost[old, active] - at[old] ** 2) / (2 * (at[j] - at[old]))
            meet = np.where(depth < 0, -np.inf, meet)
            covered = (depth >= 0) & (meet <= since[depth, active])
            placed = active[~covered]
            top[placed] += 1
            lowest[top[placed], placed] = j
            since[top[placed], placed] = meet[~covered]
            active = active[covered]
            top[active] -= 1
    out = np.full_like(cost, np.inf)
    some = np.flatnonzero(top >= 0)
    now = np.zeros(lines, int)
    for i in range(n):
        behind = some
        while behind.size:
            after = now[behind] + 1
            behind = behind[(after <= top[behind]) & (since[np.minimum(after, n - 1), behind] < at[i])]
            now[behind] += 1
        j = lowest[now[some], some]
        out[i, some] = cost[j, some] + (at[i] - at[j]) ** 2
    return out


def distance_map(seeds: np.ndarray, spacing: Sequence[float]) -> np.ndarray:
    """Exact Euclidean distance of each voxel to the nearest seed: a pass of linear time along each axis, by blocks of
    lines, so beside the volume itself only a block is in memory."""
    out = np.where(seeds, 0.0, np.inf)
    for axis, step in enumerate(spacing):
        n = out.shape[axis]
        other = [k for k in range(out.ndim) if k != axis]
        cross = [out.shape[k] for k in other]
        planes = np.moveaxis(out, axis, 0)
        rows = max(1, BLOCK // max(1, n * int(np.prod(cross[1:]))))
        for lo in range(0, cross[0], rows):
            part = planes[:, lo : lo + rows]
            planes[:, lo : lo + rows] = _lower_envelope(part.reshape(n, -1), float(step)).reshape(part.shape)
    return np.sqrt(out)


def _nearest(rows: pd.DataFrame, spacing: Sequence[float]) -> pd.DataFrame:
    place = rows[["z", "y", "x"]].to_numpy()
    place = place - place.min(axis=0)
    shape = tuple(place.max(axis=0) + 1)
    out = np.full(len(rows), np.inf)
    side = rows["side"].to_numpy()
    for own, other in (("pred", "ref"), ("ref", "pred")):
        if (side == other).any():
            seeds = np.zeros(shape, bool)
            seeds[tuple(place[side == other].T)] = True
            out[side == own] = distance_map(seeds, spacing)[tuple(place[side == own].T)]
    return rows.assign(d=out)


def nearest_distances(points: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Adds d, the distance of each point (side pred or ref, z, y, x) to the nearest point of the other side.

    A volume is one group: its points are at most a volume, which one task holds as the loader did.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*points.schema.fields, StructField("d", DoubleType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _nearest(rows, spacing)

    return points.groupBy(*keys).applyInPandas(run, schema)


def surface_distances(df: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, side, z, y, x, code, area, d) of the surface elements of both masks."""
    both = [surface_elements(df, side, spacing, keys).withColumn("side", F.lit(side)) for side in ("pred", "ref")]
    return nearest_distances(both[0].unionByName(both[1]), spacing, keys)


def hausdorff(distances: DataFrame, subjects: DataFrame, percentile: float = 100.0, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Largest of both directions' distances at a share of the area; infinity where a surface is missing."""
    order = Window.partitionBy(*keys, "side").orderBy("d", "area").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "side")
    ranked = distances.select(*keys, "side", "d", (F.sum("area").over(order) / F.sum("area").over(whole)).alias("share"))
    per_side = ranked.groupBy(*keys, "side").agg(F.coalesce(F.min(F.when(F.col("share") >= percentile / 100, F.col("d"))), F.max("d")).alias("d"))
    both = per_side.groupBy(*keys).agg(F.max("d").alias("d"), F.count("*").alias("sides"))
    value = F.when(F.col("sides") == 2, F.col("d")).otherwise(F.expr(INF))
    return subjects.select(*keys).distinct().join(both, list(keys), "left").select(*keys, value.alias("HDRFDST"))


def surface_dice(distances: DataFrame, subjects: DataFrame, tolerance: float = 1.0, keys: Sequence[str] = ("subject",)) -> DataFrame:
    total = distances.groupBy(*keys).agg(F.sum(F.when(F.col("d") <= tolerance, F.col("area")).otherwise(0.0)).alias("near"), F.sum("area").alias("all"))
    value = F.when(F.col("all").isNull(), F.expr(NEG)).otherwise(F.expr("near / `all`"))
    return subjects.select(*keys).distinct().join(total, list(keys), "left").select(*keys, value.alias("SURFDICE"))


def surface_overlap(distances: DataFrame, subjects: DataFrame, tolerance: float = 1.0, side: str = "pred", keys: Sequence[str] = ("subject",)) -> DataFrame:
    out = surface_dice(distances.where(F.col("side") == side), subjects, tolerance, keys)
    return out.withColumnRenamed("SURFDICE", "SURFOVLP")


def average_distance(df: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), combine: str = "mean", keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Average of both directed mean distances between the voxels of two masks (or their maximum)."""
    sides = [df.where(F.col(s) == 1).select(*keys, "z", "y", "x", F.lit(s).alias("side")) for s in ("pred", "ref")]
    near = nearest_distances(sides[0].unionByName(sides[1]), spacing, keys)
    directed = near.groupBy(*keys).agg(F.avg(F.when(F.col("side") == "pred", F.col("d"))).alias("p"), F.avg(F.when(F.col("side") == "ref", F.col("d"))).alias("r"))
    both = (F.col("p") + F.col("r")) / 2 if combine == "mean" else F.greatest("p", "r")
    value = F.when(F.col("p").isNull() | F.col("r").isNull(), F.expr(INF)).otherwise(both)
    return df.select(*keys).distinct().join(directed, list(keys), "left").select(*keys, value.alias("AVGDIST"))
