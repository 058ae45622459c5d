"""Transforms and augmentation of samples: voxel tables (keys, z, y, x, value) to voxel tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import AXES, hash_number

Transform = Callable[[DataFrame], DataFrame]


def compose(*parts: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for part in parts:
            df = part(df)
        return df

    return run


def loop_entries(make: Callable[..., Transform], entries: Sequence[str], keys: Sequence[str] = ("subject",)) -> Transform:
    """A transform on each listed entry by itself: its statistics are the entry's own. Other entries stay as they are.

    ``make`` builds the transform for keys. A table that lacks one of the entries raises when it is read.
    """

    def run(df: DataFrame) -> DataFrame:
        listed = F.col("entry").isin(list(entries))
        done = make(keys=[*keys, "entry"])(df.where(listed))
        out = done.unionByName(df.where(~listed | F.col("entry").isNull()))
        found = df.where(listed).agg(F.size(F.collect_set("entry")).alias("found"))  # one row
        check = F.when(F.col("found") == len(set(entries)), True).otherwise(F.raise_error(F.lit(f"entries {sorted(entries)} aren't all there")).cast("boolean"))
        return out.join(F.broadcast(found), check).drop("found")

    return run


def checked(value, kind: type):
    """The value, if it is of this kind."""
    if not isinstance(value, kind):
        raise ValueError(f"{kind.__name__} is needed, not {type(value).__name__}")
    return value


def with_stats(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates of each sample: aggregated first, then joined back, so no sample is sorted or held whole."""
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]), list(keys))


def intensity_rescale(lower: float, upper: float, keys: Sequence[str] = ("subject",)) -> Transform:
    """Linear to [lower, upper] by the sample's range; a constant sample raises."""

    def run(df: DataFrame) -> DataFrame:
        stats = with_stats(df, keys, lo=F.min("value"), hi=F.max("value"))
        value = F.when(F.col("lo") == F.col("hi"), F.raise_error(F.lit("a sample is constant")).cast("double"))
        return stats.withColumn("value", value.otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (upper - lower) + lower)).select(df.columns)

    return run


def intensity_normalization(keys: Sequence[str] = ("subject",)) -> Transform:
    """Zero mean and unit population deviation; a constant sample gives NaN."""

    def run(df: DataFrame) -> DataFrame:
        stats = with_stats(df, keys, mean=F.avg("value"), std=F.stddev_pop("value"))
        return stats.withColumn("value", F.when(F.col("std") == 0, F.lit(float("nan"))).otherwise((F.col("value") - F.col("mean")) / F.col("std"))).select(df.columns)

    return run


def value_transform(f: Callable[[Column], Column]) -> Transform:
    return lambda df: df.withColumn("value", f(F.col("value"))).select(df.columns)


def clip_percentile(upper: float, lower: float | None = None, keys: Sequence[str] = ("subject",)) -> Transform:
    """Clips to the upper percentile, then to the lower percentile of what that gives."""
    low = 100 - upper if lower is None else lower

    def run(df: DataFrame) -> DataFrame:
        top = with_stats(df, keys, cut=F.percentile("value", upper / 100)).withColumn("value", F.least("value", "cut")).drop("cut")
        return with_stats(top, keys, cut=F.percentile("value", low / 100)).withColumn("value", F.greatest("value", "cut")).select(df.columns)

    return run


def relabel_chain(changes: dict[int, int], column: str = "value") -> Transform:
    """{new: old}, one after another on the result so far."""

    def run(df: DataFrame) -> DataFrame:
        value = F.col(column)
        for new, old in changes.items():
            value = F.when(value == old, F.lit(new)).otherwise(value)
        return df.withColumn(column, value)

    return run


def reshape(shape: Sequence[int], to: Sequence[int]) -> Transform:
    """Row-major reshape of samples of one shape; one -1 is what is left."""
    to = list(to)
    if -1 in to:
        to[to.index(-1)] = prod(shape) // -prod(to)
    if prod(to) != prod(shape):
        raise ValueError("the shapes hold different numbers of voxels")

    def run(df: DataFrame) -> DataFrame:
        flat = F.lit(0)
        for a, n in zip(AXES, shape, strict=True):
            flat = flat * n + F.col(a)
        out = df.withColumn("__flat", flat)
        for k, a in enumerate(AXES):
            out = out.withColumn(a, F.pmod(F.floor(F.col("__flat") / prod(to[k + 1 :])), F.lit(to[k])).cast("int"))
        return out.drop("__flat")

    return run


def permute(order: Sequence[int]) -> Transform:
    """New axis k is old axis order[k]."""
    return lambda df: df.select(*[F.col(AXES[order[AXES.index(c)]]).alias(c) if c in AXES else F.col(c) for c in df.columns])


def squeeze(axis: int) -> Transform:
    """Drops an axis of size 1; any other place in it raises."""
    name = AXES[axis]
    return lambda df: df.where(F.when(F.col(name) == 0, True).otherwise(F.raise_error(F.lit(f"axis {name} isn't of size 1")).cast("boolean"))).drop(name)


def unsqueeze(name: str = "channel") -> Transform:
    return lambda df: df.withColumn(name, F.lit(0))


def _grid(subjects: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    for a, n in sizes.items():
        subjects = subjects.withColumn("__n", n).where("__n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias(a)).drop("__n")
    return subjects


def size_correction(shape: Sequence[int | None], pad_value: float = 0.0, two_sided: bool = True, keys: Sequence[str] = ("subject",)) -> Transform:
    """Crops or pads to a shape (None: as it is), about the centre (odd voxels at the end) or at the beginnings."""
    if len(shape) > len(AXES):
        raise ValueError("more sizes than axes")
    target = dict(zip(AXES, shape, strict=False))

    def run(df: DataFrame) -> DataFrame:
        size = df.groupBy(*keys).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
        moved = df.join(size, list(keys))
        want = {a: F.col(f"n{a}") if target.get(a) is None else F.lit(target[a]) for a in AXES}
        for a in AXES:
            excess = F.col(f"n{a}") - want[a]
            half = lambda d: F.floor(d / 2).cast("int")
            shift = F.when(excess >= 0, -(half(excess) if two_sided else excess)).otherwise(half(-excess) if two_sided else -excess)
            moved = moved.withColumn(a, (F.col(a) + shift).cast("int")).where((F.col(a) >= 0) & (F.col(a) < want[a]))
        moved = moved.drop(*[f"n{a}" for a in AXES])
        grid = _grid(size, want).select(*keys, *AXES)
        return grid.join(moved, [*keys, *AXES], "left").withColumn("value", F.coalesce("value", F.lit(pad_value))).select(df.columns)

    return run


def mask(masks: DataFrame, mask_column: str, mask_value: int = 0, masking_value: float = 0.0, keys: Sequence[str] = ("subject",)) -> Transform:
    """Sets the value where a mask has the masked value; the mask is joined on the coordinates."""
    on = [*keys, *AXES]

    def run(df: DataFrame) -> DataFrame:
        out = df.join(masks.select(*on, F.col(mask_column).alias("__m")), on, "left")
        return out.withColumn("value", F.when(F.col("__m") == mask_value, F.lit(masking_value)).otherwise(F.col("value"))).select(df.columns)

    return run


def random_crop(size: dict[str, int], seed: int, inclusive: bool = True, keys: Sequence[str] = ("subject",)) -> Transform:
    """The same box in each sample of a key, its corner from a hash of the key."""

    def run(df: DataFrame) -> DataFrame:
        out = df.join(df.groupBy(*keys).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in size]), list(keys))
        for k, (a, n) in enumerate(size.items()):
            places = F.col(f"n{a}") - n + (1 if inclusive else 0)
            start = F.when(places > 0, hash_number(seed + k, *keys) % places).otherwise(F.raise_error(F.lit("the crop is larger than a sample")).cast("long"))
            out = out.withColumn(a, (F.col(a) - start).cast("int")).where((F.col(a) >= 0) & (F.col(a) < n))
        return out.select(df.columns)

    return run


def applied(seed: int, p: float, keys: Sequence[str] = ("subject",)) -> Column:
    """Whether a sample is augmented: a hash of its key below the probability."""
    return hash_number(seed + 1000, *keys) < F.lit(int(p * 2**32))


def random_mirror(axis: int, seed: int, p: float = 1.0, keys: Sequence[str] = ("subject",)) -> Transform:
    name = AXES[axis]

    def run(df: DataFrame) -> DataFrame:
        out = with_stats(df, keys, __n=F.max(name))
        return out.withColumn(name, F.when(applied(seed, p, keys), F.col("__n") - F.col(name)).otherwise(F.col(name)).cast("int")).select(df.columns)

    return run


def random_rotation90(axes: Sequence[int], seed: int, p: float = 1.0, keys: Sequence[str] = ("subject",)) -> Transform:
    """One to three quarter turns in a plane, from its first axis towards its second."""
    if len(axes) != 2:
        raise ValueError("a rotation needs two axes")
    a, b = AXES[axes[0]], AXES[axes[1]]

    def run(df: DataFrame) -> DataFrame:
        out = with_stats(df, keys, __a=F.max(a), __b=F.max(b)).withColumn("__k", F.when(applied(seed, p, keys), hash_number(seed, *keys) % 3 + 1).otherwise(0))
        i, j, last_i, last_j = F.col(a), F.col(b), F.col("__a"), F.col("__b")
        new_i = F.when(F.col("__k") == 1, last_j - j).when(F.col("__k") == 2, last_i - i).when(F.col("__k") == 3, j).otherwise(i)
        new_j = F.when(F.col("__k") == 1, i).when(F.col("__k") == 2, last_j - j).when(F.col("__k") == 3, last_i - i).otherwise(j)
        return out.select(*[new_i.cast("int").alias(a) if c == a else new_j.cast("int").alias(b) if c == b else F.col(c) for c in df.columns])

    return run


def random_shift(axis: int, seed: int, shift: int | float, p: float = 1.0, keys: Sequence[str] = ("subject",)) -> Transform:
    """Circular shift by a number below ``shift`` either way (a share of the size if below 1)."""
    name = AXES[axis]

    def run(df: DataFrame) -> DataFrame:
        out = with_stats(df, keys, __n=F.max(name) + 1)
        most = F.lit(shift) if isinstance(shift, int) else F.floor(F.col("__n") * shift)
        by = F.when(applied(seed, p, keys) & (most > 0), hash_number(seed, *keys) % F.greatest(2 * most, F.lit(1)) - most).otherwise(0)
        return out.withColumn(name, F.pmod(F.col(name) + by, F.col("__n")).cast("int")).select(df.columns)

    return run


def _spline_weights(t: np.ndarray) -> np.ndarray:
    """Cubic B-spline weights of the four control points around a place."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], axis=-1) / 6


def elastic_deformation(seed: int, control_points: int = 4, sigma: float = 5.0, fill: float = 0.0, keys: Sequence[str] = ("subject", "z"), p: float = 1.0) -> Transform:
    """Random displacement of 2-D samples (y, x) on a B-spline grid of control points, linear interpolation.

    A sample is one group, as large as one slice; a share p of the samples is displaced, by seed and keys.
    """
    if control_points < 2 or sigma < 1:
        raise ValueError("at least two control points and a sigma of at least 1 are needed")

    def deform(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        h, w = int(rows.y.max()) + 1, int(rows.x.max()) + 1
        image = np.full((h, w), fill)
        image[rows.y, rows.x] = rows.value
        rng = np.random.default_rng([seed, *[crc32(str(rows[k].iloc[0]).encode()) for k in keys]])
        if p < 1 and rng.random() >= p:
            return rows
        noise = rng.normal(0, sigma, (2, control_points + 3, control_points + 3))
        places = [np.linspace(0, control_points - 1e-9, n) for n in (h, w)]
        wy, wx = (_spline_weights(x - np.floor(x)) for x in places)
        by, bx = (np.floor(x).astype(int)[:, None] + np.arange(4) for x in places)
        move = np.einsum("dhiwj,hi,wj->dhw", noise[:, by][:, :, :, bx], wy, wx)
        y, x = np.arange(h)[:, None] + move[0], np.arange(w)[None, :] + move[1]
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        padded = np.pad(image, 1, constant_values=fill)

        def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return padded[np.clip(i + 1, 0, h + 1), np.clip(j + 1, 0, w + 1)]

        fy, fx = y - y0, x - x0
        out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
        return rows.assign(value=out[rows.y, rows.x])

    return lambda df: df.groupBy(*keys).applyInPandas(deform, df.schema)
