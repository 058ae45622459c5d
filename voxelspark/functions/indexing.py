"""Indexing as SQL table functions: the shape of an image to the corners of its samples."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="z0 int, y0 int, x0 int")
class PatchIndex:
    """Corners of the complete patches of a grid, in row-major order."""

    def eval(self, nz: int, ny: int, nx: int, pz: int, py: int, px: int) -> Iterator[tuple[int, int, int]]:
        yield from product(*(range(0, n - p + 1, p) for n, p in ((nz, pz), (ny, py), (nx, px))))


@udtf(returnType="axis int, position int")
class SliceIndex:
    """Positions along every axis, the axes one after another."""

    def eval(self, nz: int, ny: int, nx: int) -> Iterator[tuple[int, int]]:
        for axis, n in enumerate((nz, ny, nx)):
            for position in range(n):
                yield axis, position


def register(spark: SparkSession) -> None:
    """Names the functions patch_index and slice_index in SQL."""
    spark.udtf.register("patch_index", PatchIndex)
    spark.udtf.register("slice_index", SliceIndex)
