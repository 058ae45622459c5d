"""Dataset creation: catalogue of files, loading, channels, metadata tables, and the stored layout.

A dataset is a folder with data (slices, partitioned by category), shapes, image_props, names, files and subjects.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import images as I
from .extract import AXES

LOG = logging.getLogger(__name__)


def subject_files(subjects: dict[str, dict[str, dict[str, str]]], spark: SparkSession) -> DataFrame:
    """subject -> category -> entry -> path as rows; an entry may stand in one category of a subject only."""
    rows = []
    for index, (subject, categories) in enumerate(subjects.items()):
        seen: set[str] = set()
        for category, entries in categories.items():
            if clash := seen & set(entries):
                raise ValueError(f"entries {sorted(clash)} of {subject} stand in several categories")
            seen |= set(entries)
            rows += [(index, subject, category, channel, entry, path) for channel, (entry, path) in enumerate(entries.items())]
    if not rows:
        raise ValueError("no files are given")
    return spark.createDataFrame(rows, "subject_index int, subject string, category string, channel int, entry string, path string")


def clashing_entries(files: DataFrame) -> DataFrame:
    """Subjects that have an entry twice."""
    counts = files.groupBy("subject_index").agg(F.count("*").alias("n"), F.count_distinct("category", "entry").alias("d"))
    return counts.where("n <> d").select("subject_index")


def all_files(files: DataFrame) -> DataFrame:
    """(subject_index, files): a map of all entries of each subject."""
    pairs = F.array_sort(F.collect_list(F.struct("entry", "path")))
    return files.groupBy("subject_index").agg(F.map_from_entries(pairs).alias("files"))


def file_root(files: DataFrame) -> DataFrame:
    """One row: the longest common folder of all paths. The smallest and largest path alone decide it."""
    parts = F.split("path", "/")
    ends = files.agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x == y)
    length = F.when(F.forall(same, lambda s: F.coalesce(s, F.lit(False))), F.size("a") - 1).otherwise(F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False)).cast("int")), 0) - 1)
    return ends.select(F.array_join(F.slice("a", 1, length.cast("int")), "/").alias("file_root"))


def relative_files(files: DataFrame) -> DataFrame:
    root = file_root(files)
    wide = files.join(F.broadcast(root), F.lit(True))  # one row
    return wide.withColumn("rel_path", F.expr("substring(path, length(file_root) + 2)")).drop("path")


def consistent_names(files: DataFrame) -> DataFrame:
    """(category, names, versions): versions is the number of different entry lists among subjects."""
    lists = files.groupBy("category", "subject_index").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return lists.groupBy("category").agg(F.count_distinct("entries").alias("versions"), F.array_join(F.min("entries"), ",").alias("names"))


def check_names(files: DataFrame) -> None:
    if bad := [r["category"] for r in consistent_names(files).where("versions <> 1").toLocalIterator()]:
        raise ValueError(f"entries of {bad} differ between subjects")


def names(voxels: DataFrame) -> DataFrame:
    return voxels.select("category", "channel", "entry").distinct()


def stack_channels(images: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Entries of a category as channels, in the order given."""
    out = None
    for channel, (entry, df) in enumerate(images):
        one = df.select("subject", *AXES, F.lit(channel).alias("channel"), F.lit(entry).alias("entry"), "value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no images are given")
    return out


def stored_shapes(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("subject").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in (*AXES, "channel")])


def image_properties(voxels: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(subject, size, origin, spacing, direction), in x, y, z order."""
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    size = F.array(*[(F.max(a) + 1).cast("int") for a in reversed(AXES)])
    return voxels.groupBy("subject").agg(size.alias("size")).select("subject", "size", literal(origin).alias("origin"), literal(spacing).alias("spacing"), literal(eye).alias("direction"))


def same_geometry(a: str, b: str) -> Column:
    """Equality of two property structs: size, origin, spacing and direction; pixel kind and components don't count."""
    out = F.lit(True)
    for c in ("size", "origin", "spacing", "direction"):
        out &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return out


def is_two_dimensional(size: Column) -> Column:
    return F.size(size) == 2


def is_three_dimensional(size: Column) -> Column:
    return F.size(size) == 3


def is_vector_image(components: Column) -> Column:
    return components > 1


def grid_to_flat(n_y: int, n_x: int) -> Column:
    return (F.col("z") * n_y + F.col("y")) * n_x + F.col("x")


def flat_to_grid(flat: Column, n_y: int, n_x: int) -> list[Column]:
    return [F.floor(flat / (n_y * n_x)).cast("int").alias("z"), F.pmod(F.floor(flat / n_x), F.lit(n_y)).cast("int").alias("y"), F.pmod(flat, F.lit(n_x)).cast("int").alias("x")]


def to_slices(voxels: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """A row for each z slice, its values in row-major order: the stored form."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    packed = voxels.groupBy(*keys, "z").agg(cells.alias("cells"), (F.max("x") + 1).cast("int").alias("width"))
    return packed.select(*keys, "z", "width", F.transform("cells", lambda c: c["value"]).alias("data"))


def to_voxels(slices: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    flat = slices.select(*keys, "z", "width", F.posexplode("data").alias("p", "value"))
    return flat.select(*keys, "z", F.expr("CAST(p DIV width AS INT)").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "value")


def entry_name(index: Column, count: Column) -> Column:
    """Number of a subject with as many digits as the number of subjects has."""
    return F.lpad(index.cast("string"), F.length(count.cast("string")), "0")


def bytes_to_string(column: Column) -> Column:
    return F.decode(column, "UTF-8")


class ParquetWriter:
    """Entries of a dataset as folders of Parquet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def reserve(self, entry: str, schema: str) -> None:
        """An empty entry that has its columns already; ``write`` or ``fill`` give it rows."""
        self.write(entry, self.spark.createDataFrame([], schema))

    def fill(self, entry: str, df: DataFrame, partition_by: Sequence[str]) -> None:
        """Writes the partitions that the rows belong to anew; others stay."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(f"{self.path}/{entry}")

    def write(self, entry: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Writes the whole entry anew."""
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{entry}")


WRITERS: dict[str, type] = {"parquet": ParquetWriter}


def _by_extension(known: dict[str, type], path: str, what: str) -> type:
    kind = path.rsplit("/", 1)[-1].partition(".")[2] or "parquet"
    if kind not in known:
        raise ValueError(f"no {what} for {kind}")
    return known[kind]


def get_writer(spark: SparkSession, path: str) -> ParquetWriter:
    """By the path's extension; none means a folder of Parquet."""
    return _by_extension(WRITERS, path, "writer")(spark, path)


@dataclass(frozen=True)
class Creation:
    """What callbacks see: voxels (subject, category, channel, entry, z, y, x, value), and of a traversal also the
    properties (subject, category, size, origin, spacing, direction) and the catalogue of files."""

    voxels: DataFrame
    properties: DataFrame | None = None
    files: DataFrame | None = None


class Callback:
    """A part of a dataset's creation. All subjects come at once, as rows."""

    def on_start(self, made: Creation) -> None:
        pass

    def on_subjects(self, made: Creation) -> None:
        pass

    def on_end(self, made: Creation) -> None:
        pass


class ComposeCallback(Callback):
    def __init__(self, callbacks: Sequence[Callback]) -> None:
        self.callbacks = list(callbacks)

    def on_start(self, made: Creation) -> None:
        for c in self.callbacks:
            c.on_start(made)

    def on_subjects(self, made: Creation) -> None:
        for c in self.callbacks:
            c.on_subjects(made)

    def on_end(self, made: Creation) -> None:
        for c in self.callbacks:
            c.on_end(made)


class MonitoringCallback(Callback):
    """Logs the start, the number of subjects once all are processed, and the end."""

    def on_start(self, made: Creation) -> None:
        LOG.info("start dataset creation")

    def on_subjects(self, made: Creation) -> None:
        rows = made.voxels if made.files is None else made.files
        LOG.info("%d subjects", rows.select("subject").distinct().count())

    def on_end(self, made: Creation) -> None:
        LOG.info("dataset creation finished")


@dataclass
class WriteData(Callback):
    """Slices by category, sorted so that row groups cover ranges of subjects and slices."""

    writer: Any

    def on_subjects(self, made: Creation) -> None:
        keys = [c for c in ("subject", "category", "channel", "entry") if c in made.voxels.columns]
        slices = to_slices(made.voxels, keys).repartition("category", "subject").sortWithinPartitions("subject", "z")
        self.writer.write("data", slices, ["category"])


@dataclass
class WriteEssential(Callback):
    writer: Any

    def on_subjects(self, made: Creation) -> None:
        rows = made.voxels if made.files is None else made.files
        self.writer.write("subjects", rows.select("subject").distinct())
        self.writer.write("shapes", stored_shapes(made.voxels))


@dataclass
class WriteImageInformation(Callback):
    """Geometry of a category as the files state it; of voxels without files, their size and a plain geometry."""

    writer: Any
    category: str = "images"

    def on_subjects(self, made: Creation) -> None:
        if made.properties is None:
            self.writer.write("image_props", image_properties(made.voxels))
        else:
            self.writer.write("image_props", made.properties.where(F.col("category") == self.category).drop("category"))


@dataclass
class WriteNames(Callback):
    writer: Any

    def on_subjects(self, made: Creation) -> None:
        self.writer.write("names", names(made.voxels))


@dataclass
class WriteFiles(Callback):
    """The files of each subject, relative to the folder that they share. Voxels without files have none."""

    writer: Any

    def on_subjects(self, made: Creation) -> None:
        if made.files is not None:
            self.writer.write("files", relative_files(made.files).select("subject", "category", "channel", "entry", "file_root", "rel_path"))


def default_callbacks(writer: Any, meta_only: bool = False) -> ComposeCallback:
    """All writers; with ``meta_only`` the one of voxels is left out."""
    meta = [WriteEssential(writer), WriteImageInformation(writer), WriteNames(writer), WriteFiles(writer)]
    return ComposeCallback(meta if meta_only else [WriteData(writer), *meta])


def _run(made: Creation, callback: Callback) -> None:
    callback.on_start(made)
    callback.on_subjects(made)
    callback.on_end(made)


def create_dataset(voxels: DataFrame, path: str, callback: Callback | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs callbacks (None: all writers) on voxels (subject, category, channel, entry, z, y, x, value)."""
    if transform is not None:
        voxels = transform(voxels)
    _run(Creation(voxels), default_callbacks(get_writer(voxels.sparkSession, path)) if callback is None else callback)


def file_path(path: Column) -> Column:
    """Paths of the local file system in one form, as Spark's readers write them in several."""
    return F.regexp_replace(path, "^file:/+", "/")


@dataclass(frozen=True)
class LoadImages:
    """The default loader: files (path, content) to voxels and properties by the parsers of ``sources.images``.

    ``contents`` are the bytes of the files; without them Spark reads all files under the folder that the listed share.
    """

    contents: DataFrame | None = None

    def __call__(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        contents = self.contents
        if contents is None:
            root = file_root(files).first()[0]
            contents = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
        contents = contents.select(file_path(F.col("path")).alias("path"), "content")
        wanted = contents.join(files.select(file_path(F.col("path")).alias("path")).distinct(), "path", "left_semi")
        return I.decode_voxels(wanted), I.decode_properties(wanted)


#: Loads listed files: voxels (path, z, y, x, channel, value) and properties (path, size, spacing, origin, direction).
Load = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def concat_entries(loaded: DataFrame) -> DataFrame:
    """Entries as channels of their category, in the order of the catalogue; components of an entry stay together."""
    parts = loaded.groupBy("category", "channel").agg((F.max("component") + 1).alias("n"))
    # A row for each entry of a category, not of a subject.
    order = parts.alias("a").join(parts.alias("b"), (F.col("a.category") == F.col("b.category")) & (F.col("b.channel") < F.col("a.channel")), "left")
    first = order.groupBy("a.category", "a.channel").agg(F.coalesce(F.sum("b.n"), F.lit(0)).cast("int").alias("first"))
    return loaded.join(F.broadcast(first), ["category", "channel"]).withColumn("channel", F.col("first") + F.col("component")).drop("first", "component")


class Traverser:
    """From files to a dataset: loading, channels, properties of each category's first entry, a transform, callbacks."""

    def __init__(self, categories: str | Sequence[str] | None = None) -> None:
        self.categories = [categories] if isinstance(categories, str) else categories

    def load(self, files: DataFrame, load: Load | None = None, concat: Callable[[DataFrame], DataFrame] = concat_entries) -> Creation:
        """Voxels and properties of files (subject, category, channel, entry, path, ...), not stored."""
        if self.categories is not None:
            files = files.where(F.col("category").isin(list(self.categories)))
        if files.isEmpty():
            raise ValueError("no files are given")
        check_names(files)
        voxels, properties = (load or LoadImages())(files)
        listed = files.select(file_path(F.col("path")).alias("path"), "subject", "category", "channel", "entry")
        loaded = voxels.withColumnRenamed("channel", "component").join(listed, "path").drop("path")
        first = F.min_by(F.struct("size", "origin", "spacing", "direction"), "channel").alias("p")
        geometry = properties.join(listed, "path").groupBy("subject", "category").agg(first).select("subject", "category", "p.*")
        made = concat(loaded).select("subject", "category", "channel", "entry", *AXES, "value")
        return Creation(made, geometry, files)

    def traverse(self, files: DataFrame, callback: Callback | None, load: Load | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, concat: Callable[[DataFrame], DataFrame] = concat_entries) -> None:
        if callback is None:
            raise ValueError("a callback is needed")
        made = self.load(files, load, concat)
        _run(made if transform is None else replace(made, voxels=transform(made.voxels)), callback)


class Reader:
    """Reads a stored dataset; filters on category, subject and z reach the scan."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def has(self, entry: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{entry}")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def read(self, entry: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{entry}")

    def subjects(self) -> DataFrame:
        return self.read("subjects")

    def subject_entries(self) -> DataFrame:
        """(subject, entry): each subject's number as text of equal length, in the order of subjects."""
        numbered = self.subjects().select("subject", (F.row_number().over(Window.orderBy("subject")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
        return numbered.select("subject", entry_name(F.col("i"), F.col("n")).alias("entry"))

    def shapes(self) -> DataFrame:
        return self.read("shapes")

    def properties(self) -> DataFrame:
        return self.read("image_props")

    def names(self) -> DataFrame:
        return self.read("names")

    def files(self) -> DataFrame:
        return self.read("files")

    def spacing(self) -> tuple[float, ...]:
        """The spacing that all images share, in z, y, x order; images that differ raise."""
        found = self.properties().select("spacing").distinct().take(2)
        if len(found) != 1:
            raise ValueError("images have no spacing in common")
        return tuple(reversed(found[0].spacing))

    def slices(self, category: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").where(F.col("category") == category)

    def voxels(self, category: str) -> DataFrame:
        slices = self.slices(category)
        return to_voxels(slices, [c for c in slices.columns if c not in ("z", "width", "data")])


READERS: dict[str, type] = {"parquet": Reader}


def get_reader(spark: SparkSession, path: str) -> Reader:
    """By the path's extension; none means a folder of Parquet."""
    return _by_extension(READERS, path, "reader")(spark, path)
