"""Assembly of predicted chunks into whole volumes.

Chunks are rows (subject, sample_index, arrival, z, y, x, value) in image coordinates. Where chunks overlap the last
arrival stays; what no chunk covers is the fill.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import AXES
from .transform import _grid


def full_grid(shape: DataFrame) -> DataFrame:
    """Every voxel of shapes (subject, nz, ny, nx)."""
    return _grid(shape, {a: F.col(f"n{a}") for a in AXES}).select("subject", *AXES)


def assemble_subjects(chunks: DataFrame, shape: DataFrame, fill: float = 0.0, interact: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Whole volumes (subject, z, y, x, value). ``interact`` may change the chunks first."""
    if interact is not None:
        chunks = interact(chunks)
    on = ["subject", *AXES]
    last = chunks.groupBy(*on).agg(F.max_by("value", F.struct("arrival", "sample_index")).alias("value"))
    return full_grid(shape).join(last, on, "left").select(*on, F.coalesce("value", F.lit(fill)).alias("value"))


def ready_subjects(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Subjects all of whose samples have arrived, in any order."""
    expected = samples.groupBy("subject").agg(F.count_distinct("sample_index").alias("expected"))
    arrived = chunks.groupBy("subject").agg(F.count_distinct("sample_index").alias("arrived"))
    return expected.join(arrived, "subject").where("arrived >= expected").select("subject")


def closed_subjects(chunks: DataFrame, last_batch: bool = False) -> DataFrame:
    """Subjects that are finished when samples come subject by subject: a new subject closes all that came before it.

    The last subject stays open until the last batch is told.
    """
    first = chunks.groupBy("subject").agg(F.min("arrival").alias("first"))
    if last_batch:
        return first.select("subject")
    newest = first.agg(F.max("first").alias("newest"))  # one row
    return first.join(F.broadcast(newest), F.col("first") < F.col("newest")).select("subject")


def assembled_subject(assembled: DataFrame, ready: DataFrame, subject) -> DataFrame:
    """The volume of one subject; one that isn't among the ready raises."""
    if ready.where(F.col("subject") == subject).isEmpty():
        raise ValueError(f"subject {subject} isn't assembled")
    return assembled.where(F.col("subject") == subject)


def assemble_planes(planes: Sequence[DataFrame], shape: DataFrame, merge: Callable[[Column], Column] = F.avg, fill: float = 0.0) -> DataFrame:
    """Volumes of each plane's chunks, merged voxel by voxel."""
    on = ["subject", *AXES]
    chunks = None
    for k, plane in enumerate(planes):
        one = plane.select(*on, "arrival", "sample_index", "value", F.lit(k).alias("plane"))
        chunks = one if chunks is None else chunks.unionByName(one)
    if chunks is None:
        raise ValueError("no planes are given")
    # Keyed by voxel throughout: the last arrivals, the join with the grid and the merge share one exchange by voxel.
    last = chunks.groupBy(*on).agg(*[F.max_by(F.when(F.col("plane") == k, F.col("value")), F.when(F.col("plane") == k, F.struct("arrival", "sample_index"))).alias(f"v{k}") for k in range(len(planes))])
    values = F.array(*[F.coalesce(f"v{k}", F.lit(fill)) for k in range(len(planes))])
    filled = full_grid(shape).join(last, on, "left").select(*on, F.explode(values).alias("value"))
    return filled.groupBy(*on).agg(merge(F.col("value")).alias("value"))


def planes_ready(planes: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Subjects that are ready in every plane; a plane is its chunks and its samples."""
    ready = [ready_subjects(*p) for p in planes]
    out = ready[0]
    for more in ready[1:]:
        out = out.intersect(more)
    return out


def assemble_2d(predictions: DataFrame) -> DataFrame:
    """Whole 2-D images (subject, y, x, arrival, value): the last arrival of each subject and voxel stays."""
    return predictions.groupBy("subject", "y", "x").agg(F.max_by("value", "arrival").alias("value"))
