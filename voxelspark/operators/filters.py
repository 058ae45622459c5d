"""Image filters on voxel tables (subject, z, y, x, value)."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extract import AXES
from .transform import intensity_normalization, intensity_rescale, size_correction, with_stats

Filter = Callable[[DataFrame], DataFrame]

#: Cells of images that registration moves together.
CELLS = 1 << 15


@dataclass
class FilterPipeline:
    """Filters one after another; a filter with parameters is a function of (table, parameters)."""

    filters: list = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def add(self, f: Filter) -> FilterPipeline:
        self.filters.append(f)
        return self

    def set_param(self, params, index: int) -> FilterPipeline:
        if not 0 <= index < len(self.filters):
            raise ValueError("no such filter")
        self.params[index] = params
        return self

    def execute(self, df: DataFrame) -> DataFrame:
        for i, f in enumerate(self.filters):
            df = f(df, self.params[i]) if i in self.params else f(df)
        return df

    def __str__(self) -> str:
        return "\n".join(f"{i}. {getattr(f, '__name__', type(f).__name__)}" for i, f in enumerate(self.filters, 1))


def relabel(changes: dict[int, int | Sequence[int]], column: str = "value") -> Filter:
    """{new: old or olds} on the original values; of several rules that fit, the last one counts."""

    def run(df: DataFrame) -> DataFrame:
        value = F.col(column)
        for new, old in changes.items():
            value = F.when(F.col(column).isin([old] if isinstance(old, int) else list(old)), F.lit(new)).otherwise(value)
        return df.withColumn(column, value)

    return run


def correct_size(shape: Sequence[int | None], two_sided: bool = True, pad_constant: float = 0.0) -> Filter:
    """Shape in x, y, z order, about the centre or at the lower ends."""
    if shape is None:
        raise ValueError("a reference shape is needed")
    zyx = [*[None] * (3 - len(shape)), *reversed(shape)]
    return size_correction(zyx, pad_constant, two_sided)


def binary_threshold(threshold: float, lower: float = 0.0) -> Filter:
    """0 inside [lower, threshold], else 1."""
    return lambda df: df.withColumn("value", F.when(F.col("value").between(lower, threshold), 0).otherwise(1))


normalize_z_score = intensity_normalization
rescale_intensity = intensity_rescale


def connected_components(df: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, z, y, x, component) of the set voxels; voxels touch at faces; a component is named by its first voxel.

    Smallest labels move along edges and labels of labels are followed; an image is one group.
    """

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", "y", "x"]).reset_index(drop=True)
        place = rows[["z", "y", "x"]].to_numpy().astype(np.int64)
        size = place.max(axis=0) + 2
        flat = (place[:, 0] * size[1] + place[:, 1]) * size[2] + place[:, 2]
        root = np.arange(len(rows))
        edges = []
        for step in (1, size[2], size[1] * size[2]):
            at = np.minimum(np.searchsorted(flat, flat + step), len(flat) - 1)
            hit = flat[at] == flat + step
            edges.append(np.stack([np.flatnonzero(hit), at[hit]]))
        a, b = np.concatenate(edges, axis=1)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while not np.array_equal(jump := new[new], new):
                new = jump
            if (new == root).all():
                break
            root = new
        return rows[[*keys, "z", "y", "x"]].assign(component=root + 1)

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*[df.schema[k] for k in (*keys, *AXES)], StructField("component", LongType())])
    return df.where(F.col("value") != 0).select(*keys, *AXES).groupBy(*keys).applyInPandas(label, schema)


def largest_components(n: int = 1, consecutive: bool = False, keys: Sequence[str] = ("subject",)) -> Filter:
    """The n largest components as 1, or as 1 to n by size; ties go to the first voxel."""
    if n < 1:
        raise ValueError("at least one component is needed")

    def run(df: DataFrame) -> DataFrame:
        parts = connected_components(df, keys)
        sizes = parts.groupBy(*keys, "component").count()
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "component"))
        best = sizes.withColumn("rank", rank).where(F.col("rank") <= n)
        kept = parts.join(best, [*keys, "component"]).select(*keys, *AXES, "rank")
        value = F.coalesce("rank" if consecutive else F.when(F.col("rank").isNotNull(), 1), F.lit(0))
        return df.join(kept, [*keys, *AXES], "left").withColumn("value", value.cast("int")).select(df.columns)

    return run


def otsu_thresholds(df: DataFrame, bins: int = 200, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, threshold): the upper edge of the bin that parts the histogram with the largest variance between."""
    ranged = with_stats(df, keys, lo=F.min("value"), hi=F.max("value"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width)))
    histogram = ranged.withColumn("bin", at.cast("int")).groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    running = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    cum = histogram.select(*keys, "bin", "lo", "hi", F.sum("c").over(running).alias("w0"), F.sum(F.col("c") * F.col("bin")).over(running).alias("s0"), F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * F.col("bin")).over(whole).alias("s"))
    between = F.expr("CASE WHEN w0 = w THEN -1D ELSE w0*(w-w0)*pow(s0/w0-(s-s0)/(w-w0),2) END")
    best = cum.withColumn("v", between).groupBy(*keys).agg(F.max_by(F.struct("bin", "lo", "hi"), F.struct(F.round("v", 6), -F.col("bin"))).alias("b"))
    return best.select(*keys, (F.col("b.lo") + (F.col("b.bin") + 1) * (F.col("b.hi") - F.col("b.lo")) / bins).alias("threshold"))


def otsu_mask(bins: int = 200, keys: Sequence[str] = ("subject",)) -> Filter:
    """0 up to the threshold, 1 above it."""
    return lambda df: df.join(otsu_thresholds(df, bins, keys), list(keys)).withColumn("value", (F.col("value") > F.col("threshold")).cast("int")).select(df.columns)


def anisotropic_diffusion(iterations: int = 5, time_step: float = 0.125, conductance: float = 3.0, keys: Sequence[str] = ("subject", "z"), axes: Sequence[str] = ("y", "x")) -> Filter:
    """Diffusion that slows at edges, relative to the sample's mean squared gradient; borders repeat.

    Each step looks at neighbours by windows along each axis, so a sample needn't be in memory.
    """

    def run(df: DataFrame) -> DataFrame:
        for _ in range(iterations):
            step = df
            flows, squares = [], []
            for a in axes:
                others = [c for c in (*keys, *AXES) if c != a and c in df.columns]
                w = Window.partitionBy(*dict.fromkeys(others)).orderBy(a)
                step = step.withColumn(f"n_{a}", F.coalesce(F.lead("value").over(w), "value") - F.col("value")).withColumn(f"p_{a}", F.coalesce(F.lag("value").over(w), "value") - F.col("value"))
                flows += [F.col(f"n_{a}"), F.col(f"p_{a}")]
                squares.append(F.pow((F.col(f"n_{a}") - F.col(f"p_{a}")) / 2, 2))
            square = squares[0]
            for s in squares[1:]:
                square = square + s
            step = with_stats(step.withColumn("g2", square), keys, k=F.avg("g2"))
            scale = F.col("k") * (-2.0 * conductance * conductance)
            move = F.lit(0.0)
            for d in flows:
                move = move + F.when(scale == 0, 0.0).otherwise(d * F.exp(d * d / scale))
            df = step.withColumn("value", F.col("value") + move * time_step).select(df.columns)
        return df

    return run


def match_histogram(reference: DataFrame, match_points: int = 1, threshold_at_mean: bool = True, keys: Sequence[str] = ("subject",)) -> Filter:
    """Maps each image's quantiles to those of its reference, linear between them.

    Points are the minimum (or mean), ``match_points`` quantiles above it, and the maximum.
    """
    if reference is None:
        raise ValueError("a reference image is needed")
    shares = [k / (match_points + 1) for k in range(match_points + 2)]

    def points(df: DataFrame, name: str) -> DataFrame:
        base = with_stats(df, keys, __m=F.avg("value")).where(F.col("value") >= F.col("__m")) if threshold_at_mean else df
        return base.groupBy(*keys).agg(F.percentile("value", F.array(*[F.lit(s) for s in shares])).alias(name))

    def run(df: DataFrame) -> DataFrame:
        out = df.join(points(df, "src"), list(keys)).join(points(reference, "dst"), list(keys))
        n = len(shares)
        value = F.col("value") - F.col("src")[0] + F.col("dst")[0]
        for k in range(n - 1):
            a, b, c, d = F.col("src")[k], F.col("src")[k + 1], F.col("dst")[k], F.col("dst")[k + 1]
            line = c + F.when(b == a, 0.0).otherwise((F.col("value") - a) / (b - a)) * (d - c)
            value = F.when(F.col("value") >= a, line if k < n - 2 else F.when(F.col("value") <= b, line).otherwise(F.col("value") - b + d)).otherwise(value) if k == 0 else F.when(F.col("value") >= a, line).otherwise(value)
        return out.withColumn("value", value).select(df.columns)

    return run


def correct_bias(mask: DataFrame | None = None, levels: int = 3, iterations: int = 10, fwhm: float = 0.15, bins: int = 200, noise: float = 0.01, threshold: float = 0.001, keys: Sequence[str] = ("subject",)) -> Filter:
    """Bias field correction: the log histogram is sharpened by deconvolution, the smoothed difference is the field.

    Smoothing is by cubic B-splines, twice as many control points on each level. An image is one group. Without a mask,
    voxels above Otsu's threshold count.
    """

    def basis(n: int, spans: int) -> np.ndarray:
        place = np.linspace(0, spans - 1e-9, n)
        t, cell = place - np.floor(place), np.floor(place).astype(int)
        w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], axis=1) / 6
        out = np.zeros((n, spans + 3))
        for k in range(4):
            out[np.arange(n), cell + k] += w[:, k]
        return out

    def smooth(field_: np.ndarray, spans: int) -> np.ndarray:
        for axis in range(3):
            b = basis(field_.shape[axis], min(spans, max(1, field_.shape[axis] - 1)))
            fit = b @ np.linalg.pinv(b.T @ b + 1e-3 * np.eye(b.shape[1])) @ b.T
            field_ = np.moveaxis(np.tensordot(fit, field_, (1, axis)), 0, axis)
        return field_

    def sharpen(v: np.ndarray) -> np.ndarray:
        lo, hi = v.min(), v.max()
        if hi <= lo:
            return v
        width = (hi - lo) / (bins - 1)
        count, _ = np.histogram(v, bins, (lo - width / 2, hi + width / 2))
        size = 1 << (2 * bins - 1).bit_length()
        sigma = fwhm / width / 2.3548
        x = np.minimum(np.arange(size), size - np.arange(size))
        gauss = np.fft.fft(np.exp(-0.5 * (x / sigma) ** 2) / (sigma * 2.5066))
        spectrum = np.fft.fft(np.pad(count, (0, size - bins)))
        wiener = np.conj(gauss) / (np.abs(gauss) ** 2 + noise)
        sharp = np.maximum(np.real(np.fft.ifft(spectrum * wiener)), 0)
        centre = lo + width * np.arange(size)
        top = np.real(np.fft.ifft(np.fft.fft(sharp * centre) * gauss))
        bottom = np.real(np.fft.ifft(np.fft.fft(sharp) * gauss))
        mean = np.where(np.abs(bottom) > 1e-8, top / np.where(np.abs(bottom) > 1e-8, bottom, 1), centre)
        return np.interp(v, centre[:bins], mean[:bins])

    def correct(rows: pd.DataFrame) -> pd.DataFrame:
        place = tuple(rows[a].to_numpy() for a in AXES)
        shape = tuple(int(p.max()) + 1 for p in place)
        image = np.zeros(shape)
        image[place] = rows["value"]
        inside = np.zeros(shape, bool)
        inside[place] = rows["__m"].to_numpy() != 0
        inside &= image > 0
        if not inside.any():
            return rows.drop(columns="__m")
        log = np.where(inside, np.log(np.where(image > 0, image, 1)), 0)
        bias = np.zeros(shape)
        for level in range(levels):
            for _ in range(iterations):
                v = (log - bias)[inside]
                rest = np.zeros(shape)
                rest[inside] = v - sharpen(v)
                step = smooth(rest, 1 << level)
                step -= step[inside].mean()
                bias += step
                change = np.exp(step[inside])
                if change.std() / max(change.mean(), 1e-9) < threshold:
                    break
        return rows.assign(value=(image / np.exp(bias))[place]).drop(columns="__m")

    def run(df: DataFrame) -> DataFrame:
        m = otsu_mask(keys=keys)(df) if mask is None else mask
        on = [*keys, *AXES]
        joined = df.join(m.select(*on, F.col("value").alias("__m")), on, "left").fillna(0, ["__m"])
        return joined.select(*df.columns, "__m").groupBy(*keys).applyInPandas(correct, df.schema)

    return run


def run_command(command: Sequence[str], enabled: bool = False, keys: Sequence[str] = ("subject",)) -> Filter:
    """Runs a program on each image: it reads the CSV named first and writes the one named second (z, y, x, value).

    Off unless enabled, as it starts programs on the workers. Each image has a folder of its own that goes afterwards.
    """
    if not enabled:
        raise PermissionError("commands are off; pass enabled=True")

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        with tempfile.TemporaryDirectory() as d:
            source, target = os.path.join(d, "in.csv"), os.path.join(d, "out.csv")
            rows[[*AXES, "value"]].to_csv(source, index=False)
            subprocess.run([*command, source, target], check=True)
            out = pd.read_csv(target)
            for k in keys:
                out[k] = rows[k].iloc[0]
            return out[list(rows.columns)]

    return lambda df: df.groupBy(*keys).applyInPandas(call, df.schema)


def moved_images(images: np.ndarray, p: np.ndarray, cells: np.ndarray, shape: tuple[int, int], transform: str) -> np.ndarray:
    """Values (image, cell) that images (image, y, x), each moved by its row of p, have at cells of a grid of that shape."""
    n, k = len(images), len(cells)
    if transform == "affine":
        m, shift = np.stack([1 + p[:, 0], p[:, 1], p[:, 2], 1 + p[:, 3]], axis=1), p[:, 4:6]
    else:
        cos, sin = np.cos(p[:, 0]), np.sin(p[:, 0])
        m, shift = np.stack([cos, -sin, sin, cos], axis=1), p[:, 1:3]
        if transform == "similarity":
            m = (1 + p[:, 3:4]) * m
    size = np.array(images.shape[1:])
    at = (m.reshape(-1, 2) @ (cells - (np.array(shape) - 1) / 2).T).reshape(n, 2, k)
    at = at + shift[:, :, None] + ((size - 1) / 2)[:, None]
    i0 = np.floor(at).astype(int)
    f = at - i0
    padded = np.pad(images, ((0, 0), (1, 1), (1, 1)))
    rows, columns = ([np.clip(i0[:, a] + b, 0, size[a] + 1) for b in (1, 2)] for a in (0, 1))
    rows = [r * padded.shape[2] + (np.arange(n) * padded[0].size)[:, None] for r in rows]
    pick = lambda a, b: padded.ravel()[rows[a] + columns[b]]
    fy, fx = f[:, 0], f[:, 1]
    return (pick(0, 0) * (1 - fx) + pick(0, 1) * fx) * (1 - fy) + (pick(1, 0) * (1 - fx) + pick(1, 1) * fx) * fy


def histogram_bins(values: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each value (image, cell) between its image's least and largest value, by the edges of NumPy's histograms."""
    lo, hi = values.min(axis=1), values.max(axis=1)
    if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
        raise ValueError("the range of an image is not finite")
    lo, hi = np.where(lo == hi, lo - 0.5, lo), np.where(lo == hi, hi + 0.5, hi)
    width, k = (hi - lo)[:, None], np.arange(bins + 1.0)
    edges = np.where(width / bins == 0, k / bins * width, k * (width / bins)) + lo[:, None]
    at = np.clip((values - lo[:, None]) * (bins / width), 0, bins - 1).astype(np.intp)
    edges[:, 0], edges[:, -1] = -np.inf, np.inf
    flat, first = edges.ravel(), (np.arange(len(values)) * (bins + 1))[:, None]
    while True:
        move = (values >= flat[first + at + 1]).astype(np.intp) - (values < flat[first + at])
        if not move.any():
            return at
        at += move


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int) -> np.ndarray:
    """Of each image, from its cells' bins (image, cell) on both sides."""
    n = len(a)
    place = (np.arange(n)[:, None] * bins + a) * bins + b
    joint = np.bincount(place.ravel(), minlength=n * bins * bins).reshape(n, bins, bins) / a.shape[1]
    both = joint.sum(axis=2)[:, :, None] * joint.sum(axis=1)[:, None]
    hit = joint > 0
    terms = joint * np.log(np.divide(joint, both, out=np.ones_like(joint), where=hit))
    return terms.reshape(n, -1).sum(axis=1)


def registered_images(targets: np.ndarray, images: np.ndarray, transform: str, bins: int, iterations: int, shrink_factors: Sequence[int]) -> np.ndarray:
    """Images (image, y, x) moved onto targets (image, y, x) by a pattern search that all of them take together.

    An image's result doesn't depend on the others: each has its own place and steps, and leaves when its steps are small.
    """
    n, n_params, shape = len(images), {"rigid": 3, "similarity": 4, "affine": 6}[transform], targets.shape[1:]
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), axis=-1)
    p = np.zeros((n, n_params))
    for factor in shrink_factors:
        cells = grid[::factor, ::factor].reshape(-1, 2)
        aims = histogram_bins(targets[:, ::factor, ::factor].reshape(n, -1), bins)
        score = lambda live, q: mutual_information(aims[live], histogram_bins(moved_images(images[live], q, cells, shape, transform), bins), bins)  # noqa: B023, E731
        step = np.full((n, n_params), 0.1)
        step[:, -3 if transform == "similarity" else -2 :] = float(factor)
        live = np.arange(n)
        best = score(live, p)
        for _ in range(iterations):
            tried = [p[live] + s * step[live] * e for e in np.eye(n_params) for s in (1, -1)]
            values = np.stack([score(live, q) for q in tried])
            top = values.argmax(axis=0)
            found = values[top, np.arange(len(live))]
            better = found > best[live] + 1e-9
            up = live[better]
            best[up], p[up] = found[better], np.stack(tried)[top[better], np.flatnonzero(better)]
            step[live[~better]] /= 2
            live = live[better | (step[live].max(axis=1) >= 1e-3)]
            if not len(live):
                break
    return moved_images(images, p, grid.reshape(-1, 2), shape, transform).reshape(n, *shape)


def register_images(fixed: DataFrame, transform: str = "rigid", bins: int = 32, iterations: int = 60, sampling: float = 1.0, seed: int = 0, shrink_factors: Sequence[int] = (2, 1), keys: Sequence[str] = ("subject",)) -> Filter:
    """Moves 2-D images (keys, y, x, value) onto fixed ones by mutual information and a pattern search.

    transform: rigid (turn, shift), similarity (and scale) or affine. Coarse levels come first. Voxels reach the workers
    in order of their images, those of a table onto itself once; images of one size are moved together, ``CELLS`` cells
    at a time.
    """
    if fixed is None:
        raise ValueError("a fixed image is needed")
    if transform not in ("rigid", "similarity", "affine"):
        raise KeyError(transform)

    FIXED, MOVING, BOTH = range(3)

    def starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
        """The first row of each run of equal values."""
        new = np.zeros(len(table), bool)
        new[:1] = True
        for name in names:
            codes = table[name].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole images; all but the last hold about as many cells as are moved at a time, or one image."""
        held, rows, most = [], 0, 2 * CELLS
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= most:
                table = pa.Table.from_batches(held)
                last = int(starts(table, keys)[-1])
                if last:
                    yield table.slice(0, last)
                held, rows = table.slice(last).to_batches(), rows - last
                most = max(2 * CELLS, 2 * rows)
        if rows:
            yield pa.Table.from_batches(held)

    def register(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table.schema.field("value").type
        y, x, value, side = (table[c].to_numpy() for c in ("y", "x", "value", "__side"))
        first = starts(table, [*keys, "__side"])
        rows, side = np.diff(first, append=len(table)), side[first]
        shape = np.stack([np.maximum.reduceat(c, first) + 1 for c in (y, x)], axis=1).astype(int)
        image = np.searchsorted(starts(table, keys), first, "right")
        pair = np.flatnonzero((side == BOTH) | (side == MOVING) & (np.roll(image, 1) == image) & (np.arange(len(image)) > 0))
        onto = np.where(side == BOTH, np.arange(len(side)), np.arange(len(side)) - 1)
        alone = np.setdiff1d(np.flatnonzero(side == MOVING), pair)

        def batch(at: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[table[k].take(at).combine_chunks() for k in keys], *columns], names=[*keys, "y", "x", "value"])

        def filled(runs: np.ndarray) -> np.ndarray:
            out = np.zeros((len(runs), *shape[runs[0]]))
            at = np.repeat(first[runs] - np.cumsum(rows[runs]) + rows[runs], rows[runs]) + np.arange(rows[runs].sum())
            out[np.repeat(np.arange(len(runs)), rows[runs]), y[at], x[at]] = value[at]
            return out

        for run in alone:
            at = np.arange(first[run], first[run] + rows[run])
            yield batch(at, *[table[c].take(at).combine_chunks() for c in ("y", "x", "value")])
        sizes, group = np.unique(np.concatenate([shape[onto[pair]], shape[pair]], axis=1), axis=0, return_inverse=True)
        for g, size in enumerate(sizes):
            same = pair[group.ravel() == g]
            n = max(1, CELLS // max(size[0] * size[1], bins * bins))
            for part in np.split(same, range(n, len(same), n)):
                out = registered_images(filled(onto[part]), filled(part), transform, bins, iterations, shrink_factors)
                cells = np.indices(out.shape[1:], np.int32).reshape(2, -1)
                place = [pa.array(np.tile(c, len(part))).cast(table.schema.field(a).type) for a, c in zip("yx", cells, strict=True)]
                yield batch(np.repeat(first[part], cells.shape[1]), *place, pa.array(out.ravel()).cast(kind, safe=False))

    def run(df: DataFrame) -> DataFrame:
        columns = [*keys, "y", "x", "value"]
        sent = lambda d, side: d.select(*columns, F.lit(side).alias("__side"))
        sides = sent(df, BOTH) if df is fixed else sent(fixed, FIXED).unionByName(sent(df, MOVING))
        ordered = sides.repartition(*keys).sortWithinPartitions(*keys, "__side")
        move = lambda batches: (out for table in whole(batches) for out in register(table))
        out = ordered.mapInArrow(move, ordered.select(columns).schema)
        return out.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns])

    return run
