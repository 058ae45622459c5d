"""Indexing, extraction and selection of samples from voxel tables (subject, z, y, x, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Index = int | tuple[int, int] | list[int] | slice | None


def index_bounds(indexing: Index | Sequence[Index], axis: int | Sequence[int] = 0) -> dict[int, tuple[int | None, int | None, bool]]:
    """Half-open bounds of each named axis and whether the axis drops out; axes that aren't named are whole."""
    axes = [axis] if isinstance(axis, int) else list(axis)
    items = [indexing] if isinstance(axis, int) else list(indexing)
    if len(axes) != len(items):
        raise ValueError("as many axes as indices are needed")
    out: dict[int, tuple[int | None, int | None, bool]] = {}
    for a, item in zip(axes, items, strict=True):
        if item is None:
            out[a] = (None, None, False)
        elif isinstance(item, bool):
            raise ValueError(f"unknown index {item!r}")
        elif isinstance(item, int):
            out[a] = (item, item + 1, True)
        elif isinstance(item, slice):
            out[a] = (item.start, item.stop, False)
        elif isinstance(item, (tuple, list)) and len(item) == 2:
            out[a] = (item[0], item[1], False)
        else:
            raise ValueError(f"unknown index {item!r}")
    return out


def extract(voxels: DataFrame, bounds: dict[int, tuple[int | None, int | None, bool]]) -> DataFrame:
    """Range predicates on the coordinates, which the scan can take over; dropped axes leave the result."""
    for a, (lo, hi, _) in bounds.items():
        if lo is not None:
            voxels = voxels.where(F.col(AXES[a]) >= lo)
        if hi is not None:
            voxels = voxels.where(F.col(AXES[a]) < hi)
    return voxels.drop(*[AXES[a] for a, (_, _, drop) in bounds.items() if drop])


def shapes(voxels: DataFrame) -> DataFrame:
    """Size of each subject's image along z, y, x."""
    return voxels.groupBy("subject").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in AXES])


def _bounds(**given: Column) -> list[Column]:
    return [given.get(f"{a}{i}", F.lit(0) if i == 0 else F.col(f"n{a}")).cast("int").alias(f"{a}{i}") for a in AXES for i in (0, 1)]


def _row_major(at: Sequence[Column], counts: Sequence[Column]) -> Column:
    out = F.lit(0).cast("long")
    for k, n in zip(at, counts, strict=True):
        out = out * n + k
    return out


class Indexing:
    """Shape of an image to its samples: (subject, own, z0, z1, y0, y1, x0, x1); own is the number in the subject.

    ``count`` and ``covering`` say the same by arithmetic, so neither numbers nor voxels of samples need a sort or a join
    on ranges. A class that defines only ``__call__`` with rows of own works too, by a join on ranges.
    """

    def __call__(self, shape: DataFrame) -> DataFrame:
        raise NotImplementedError

    def count(self) -> Column | None:
        """Samples of a subject, from the columns nz, ny, nx."""
        return None

    def covering(self) -> Column | None:
        """An array of the samples (own, z0, y0, x0) that hold a voxel, from its coordinates and nz, ny, nx."""
        return None


def _sample(own: Column, z0: Column, y0: Column, x0: Column) -> Column:
    return F.struct(own.cast("long").alias("own"), *[c.cast("int").alias(n) for n, c in (("z0", z0), ("y0", y0), ("x0", x0))])


class EmptyIndexing(Indexing):
    """The whole image is one sample."""

    def __call__(self, shape: DataFrame) -> DataFrame:
        return shape.select("subject", F.lit(0).cast("long").alias("own"), *_bounds())

    def count(self) -> Column:
        return F.lit(1).cast("long")

    def covering(self) -> Column:
        return F.array(_sample(*[F.lit(0)] * 4))


@dataclass
class SliceIndexing(Indexing):
    """A sample for each position of each axis, the axes one after another."""

    axes: Sequence[int] = (0,)

    def _before(self, k: int) -> Column:
        return sum((F.col(f"n{AXES[a]}") for a in list(self.axes)[:k]), F.lit(0).cast("long"))

    def __call__(self, shape: DataFrame) -> DataFrame:
        parts = []
        for k, a in enumerate(self.axes):
            name = AXES[a]
            at = shape.where(F.col(f"n{name}") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(f"n{name}") - 1)).alias("at"))
            parts.append(at.select("subject", (self._before(k) + F.col("at")).alias("own"), *_bounds(**{f"{name}0": F.col("at"), f"{name}1": F.col("at") + 1})))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def count(self) -> Column:
        return self._before(len(self.axes))

    def covering(self) -> Column:
        return F.array(*[_sample(self._before(k) + F.col(AXES[a]), *[F.col(n) if n == AXES[a] else F.lit(0) for n in AXES]) for k, a in enumerate(self.axes)])


class VoxelIndexing(Indexing):
    """A sample for each voxel, in row-major order."""

    def __call__(self, shape: DataFrame) -> DataFrame:
        for a in AXES:
            shape = shape.where(F.col(f"n{a}") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1)).alias(a))
        return shape.select("subject", self._own().alias("own"), *_bounds(**{f"{a}{i}": F.col(a) + i for a in AXES for i in (0, 1)}))

    def _own(self) -> Column:
        return _row_major([F.col(a) for a in AXES], [F.col(f"n{a}") for a in AXES])

    def count(self) -> Column:
        return F.col("nz").cast("long") * F.col("ny") * F.col("nx")

    def covering(self) -> Column:
        return F.array(_sample(self._own(), *[F.col(a) for a in AXES]))


@dataclass
class PatchIndexing(Indexing):
    """A grid of patches that don't overlap; incomplete ones at the ends go or stay."""

    patch: Sequence[int]
    ignore_incomplete: bool = True

    def _counts(self) -> list[Column]:
        whole = F.floor if self.ignore_incomplete else F.ceil
        return [whole(F.col(f"n{a}") / p).cast("int") for a, p in zip(AXES, self.patch, strict=True)]

    def grid(self, shape: DataFrame) -> DataFrame:
        """(shape, pz, py, px, own): a row for each patch."""
        counts = self._counts()
        for a, n in zip(AXES, counts, strict=True):
            shape = shape.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias(f"p{a}"))
        return shape.withColumn("own", _row_major([F.col(f"p{a}") for a in AXES], counts))

    def __call__(self, shape: DataFrame) -> DataFrame:
        size = dict(zip(AXES, self.patch, strict=True))
        return self.grid(shape).select("subject", "own", *_bounds(**{f"{a}{i}": (F.col(f"p{a}") + i) * size[a] for a in AXES for i in (0, 1)}))

    def count(self) -> Column:
        n = self._counts()
        return n[0].cast("long") * n[1] * n[2]

    def covering(self) -> Column:
        counts = self._counts()
        at = [F.floor(F.col(a) / p).cast("int") for a, p in zip(AXES, self.patch, strict=True)]
        inside = (at[0] < counts[0]) & (at[1] < counts[1]) & (at[2] < counts[2])
        sample = _sample(_row_major(at, counts), *[k * p for k, p in zip(at, self.patch, strict=True)])
        return F.filter(F.array(F.when(inside, sample)), lambda s: s.isNotNull())


#: Takes a datasource and the samples wanted, None for all; gives rows keyed by (sample_index, subject).
Extractor = Callable[["Datasource", DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Datasource:
    """Voxels with an indexing, a subset of subjects, an extractor and a transform. Changes make copies."""

    voxels: DataFrame
    indexing: Indexing = EmptyIndexing()
    subset: tuple | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    extractor: Extractor | None = None

    def with_indexing(self, indexing: Indexing, subset: Sequence | None = None) -> Datasource:
        return replace(self, indexing=indexing, subset=None if subset is None else tuple(subset))

    def with_transform(self, transform: Callable[[DataFrame], DataFrame] | None) -> Datasource:
        return replace(self, transform=transform)

    def with_extractor(self, extractor: Extractor | None) -> Datasource:
        return replace(self, extractor=extractor)

    def subjects(self) -> DataFrame:
        return self.voxels.select("subject").distinct()

    def _shapes(self) -> DataFrame:
        """Shapes with ``before``, the samples of all earlier subjects: a running sum over one short row an image."""
        shape = shapes(self.voxels)
        if self.subset is not None:
            shape = shape.where(F.col("subject").isin(list(self.subset)))
        count = self.indexing.count()
        if count is None:
            counts = self.indexing(shape).groupBy("subject").agg(F.count("*").alias("n"))
            shape, count = shape.join(counts, "subject"), F.col("n")
        earlier = F.sum(count).over(Window.orderBy("subject").rowsBetween(Window.unboundedPreceding, -1))
        return shape.select("subject", "nz", "ny", "nx", F.coalesce(earlier, F.lit(0)).cast("long").alias("before"))

    def _joined(self, shape: DataFrame) -> DataFrame:
        samples = self.indexing(shape.select("subject", "nz", "ny", "nx"))
        numbered = samples.join(shape.select("subject", "before"), "subject")
        return numbered.select("subject", *[f"{a}{i}" for a in AXES for i in (0, 1)], (F.col("own") + F.col("before")).alias("sample_index"))

    def samples(self) -> DataFrame:
        """All samples with their numbers."""
        return self._joined(self._shapes())

    def __len__(self) -> int:
        count = self.indexing.count()
        if count is None:
            return self.samples().count()
        shape = shapes(self.voxels)
        shape = shape if self.subset is None else shape.where(F.col("subject").isin(list(self.subset)))
        return shape.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]

    def data(self, samples: DataFrame | None = None) -> DataFrame:
        """Voxels of the samples (None: all), coordinates from each sample's corner."""
        if samples is not None:
            return self.data().join(samples.select("sample_index"), "sample_index", "left_semi")
        rest = [F.col(c) for c in self.voxels.columns if c not in ("subject", *AXES)]
        covering, shape = self.indexing.covering(), self._shapes()
        if covering is not None:
            held = self.voxels.join(shape, "subject").select("*", F.explode(covering).alias("at"))
            return held.select((F.col("at.own") + F.col("before")).alias("sample_index"), "subject", *[(F.col(a) - F.col(f"at.{a}0")).alias(a) for a in AXES], *rest)
        near = self.voxels.join(self._joined(shape), "subject")
        for a in AXES:
            near = near.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")))
        return near.select("sample_index", "subject", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in AXES], *rest)

    def items(self) -> DataFrame:
        """What the extractor takes from all samples (without one: their voxels), transformed."""
        out = self.data() if self.extractor is None else self.extractor(self, None)
        return out if self.transform is None else self.transform(out)

    def item(self, sample_index: int) -> DataFrame:
        """One sample. Its place is looked up first, so its subject and bounds reach the scan as constants."""
        place = self.samples().where(F.col("sample_index") == sample_index).first()
        if place is None:
            raise IndexError(f"there is no sample {sample_index}")
        box = self.voxels.where(F.col("subject") == place.subject)
        for a in AXES:
            box = box.where((F.col(a) >= place[f"{a}0"]) & (F.col(a) < place[f"{a}1"]))
        if self.extractor is None:
            rest = [F.col(c) for c in self.voxels.columns if c not in ("subject", *AXES)]
            out = box.select(F.lit(sample_index).cast("long").alias("sample_index"), "subject", *[(F.col(a) - place[f"{a}0"]).alias(a) for a in AXES], *rest)
        else:
            out = self.extractor(self, self.samples().where(F.col("sample_index") == sample_index))
        return out if self.transform is None else self.transform(out)

    def direct_extract(self, subject, bounds: dict, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        out = extract(self.voxels.where(F.col("subject") == subject), bounds)
        return out if transform is None else transform(out)


def extract_data(source: Datasource, samples: DataFrame | None = None) -> DataFrame:
    return source.data(samples)


def extract_indexing(source: Datasource, samples: DataFrame | None = None) -> DataFrame:
    """Bounds of the samples."""
    return source.samples() if samples is None else samples


def extract_table(table: DataFrame) -> Extractor:
    """Columns of a table with a row for each subject: names, shapes, image properties, lists of files."""
    return lambda source, samples=None: extract_indexing(source, samples).select("sample_index", "subject").join(table, "subject", "left")


def extract_names(names: DataFrame, categories: Sequence[str] = ("images",)) -> Extractor:
    """A column for each category: its entries in the order of channels, from (category, channel, entry)."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("channel", "entry")))), lambda s: s["entry"]).alias(c) for c in categories]
    # One row, whatever the dataset's size.
    return lambda source, samples=None: extract_indexing(source, samples).select("sample_index", "subject").join(F.broadcast(names.agg(*lists)), F.lit(True))


def extract_files(files: DataFrame, categories: Sequence[str] = ("images",)) -> Extractor:
    """A column for each category: its relative paths in the order of channels, from (subject, category, channel, rel_path)."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("channel", "rel_path")))), lambda s: s["rel_path"]).alias(c) for c in categories]
    return extract_table(files.groupBy("subject").agg(*lists))


def extract_from_files(files: DataFrame, load: Callable[[DataFrame], DataFrame], root: str | None = None, categories: Sequence[str] = ("images",)) -> Extractor:
    """Voxels of files (subject, category, channel, file_root, rel_path), loaded when they are taken.

    ``load`` gives (path, z, y, x, value) of files (path); ``root`` stands in for the folder the files were stored with.
    """
    where = F.lit(root) if root is not None else F.col("file_root")
    listed = files.where(F.col("category").isin(list(categories))).withColumn("path", F.concat_ws("/", where, "rel_path"))

    def run(source: Datasource, samples: DataFrame | None = None) -> DataFrame:
        loaded = load(listed.select("path").distinct()).select("path", *AXES, "value").join(listed.select("path", "subject", "category", "channel"), "path").drop("path")
        return replace(source, voxels=loaded).data(samples)

    return run


def compose_extractors(*parts: Extractor) -> Extractor:
    """All extractors' columns side by side; one of them at most gives several rows for a sample."""
    if not parts:
        raise ValueError("an extractor is needed")

    def run(source: Datasource, samples: DataFrame | None = None) -> DataFrame:
        out = parts[0](source, samples)
        for more in parts[1:]:
            out = out.join(more(source, samples), ["sample_index", "subject"])
        return out

    return run


def slice_samples(voxels: DataFrame) -> DataFrame:
    """Voxels with their z slice as the sample."""
    return voxels.withColumn("sample", F.col("z"))


def patch_items(voxels: DataFrame, patch: Sequence[int]) -> DataFrame:
    """Voxels of complete patches by arithmetic on the coordinates: an equality key instead of a range join."""
    shape = shapes(voxels)
    keyed = voxels.join(shape, "subject")
    inside = F.lit(True)
    for a, p in zip(AXES, patch, strict=True):
        inside &= F.col(a) < F.floor(F.col(f"n{a}") / p) * p
    keyed = keyed.where(inside)
    ids = [F.floor(F.col(a) / p).cast("int").alias(f"p{a}") for a, p in zip(AXES, patch, strict=True)]
    local = [F.pmod(F.col(a), F.lit(p)).cast("int").alias(a) for a, p in zip(AXES, patch, strict=True)]
    return keyed.select("subject", *ids, *local, "value")


#: Where the value of a place of the padded box comes from: place and size of the axis to a place in the image.
#: A place outside the image takes the fill.
Pad = Callable[[Column, Column], Column]


def pad_constant(place: Column, size: Column) -> Column:
    return place


def pad_edge(place: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size - 1, place))


def pad_reflect(place: Column, size: Column) -> Column:
    """Mirrored at the first and the last place, which aren't repeated."""
    turn = F.greatest(2 * (size - 1), F.lit(1))
    return F.least(F.pmod(place, turn), turn - F.pmod(place, turn)) * (size > 1).cast("int")


def padded_items(voxels: DataFrame, patch: Sequence[int], padding: Sequence[int | tuple[int, int]], fill: float = 0.0, pad: Pad = pad_constant, ignore_incomplete: bool = True) -> DataFrame:
    """Patches enlarged by a padding of each axis (one number, or left and right): the image where there is some.

    Incomplete patches have the full size too, if they stay. A place of a patch finds its voxel by equality.
    """
    sides = [(p, p) if isinstance(p, int) else tuple(p) for p in padding]
    cells = PatchIndexing(patch, ignore_incomplete).grid(shapes(voxels)).drop("own")
    for a, p, (left, right) in zip(AXES, patch, sides, strict=True):
        cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(p + left + right - 1))).alias(a))
    from_image = [pad(F.col(f"p{a}") * p + F.col(a) - left, F.col(f"n{a}")).cast("int").alias(f"v{a}") for a, p, (left, _) in zip(AXES, patch, sides, strict=True)]
    keys = ["subject", "pz", "py", "px", *AXES]
    near = voxels.select("subject", *[F.col(a).alias(f"v{a}") for a in AXES], "value")
    joined = cells.select(*keys, *from_image).join(near, ["subject", "vz", "vy", "vx"], "left")
    return joined.select(*keys, F.coalesce("value", F.lit(fill)).alias("value"))


def hash_number(seed: int, *key: str) -> Column:
    """The same 32 bits in every engine: the start of the MD5 of seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_entry(voxels: DataFrame, entries: Sequence[str], seed: int, key: str = "subject") -> DataFrame:
    """One entry for each sample, chosen by a hash; rows have a column entry."""
    pick = F.get(F.array(*[F.lit(e) for e in entries]), (hash_number(seed, key) % len(entries)).cast("int"))
    return voxels.where(F.col("entry") == pick)


def selective(voxels: DataFrame, selection: Sequence[str]) -> DataFrame:
    """The listed entries, channel numbers in the order of the list."""
    if not selection:
        raise ValueError("an entry must be named")
    order = F.array_position(F.array(*[F.lit(e) for e in selection]), F.col("entry")) - 1
    return voxels.where(F.col("entry").isin(list(selection))).withColumn("channel", order.cast("int"))


def two_channels(voxels: DataFrame) -> DataFrame:
    """Test pattern of two entries: T1 is the image, T2 the image doubled."""
    both = F.array(F.struct(F.lit("T1").alias("entry"), F.col("value").alias("v")), F.struct(F.lit("T2").alias("entry"), (F.col("value") * 2).alias("v")))
    return voxels.select("subject", *AXES, F.inline(both)).withColumnRenamed("v", "value")


class Selection:
    """Samples whose aggregates pass. ``value`` names the voxel column, ``keys`` the sample."""

    def aggregates(self) -> dict[str, Column]:
        raise NotImplementedError

    def test(self) -> Column:
        raise NotImplementedError

    def select(self, items: DataFrame, keys: Sequence[str] = ("sample_index",)) -> DataFrame:
        named = [a.alias(n) for n, a in self.aggregates().items()]
        return items.groupBy(*keys).agg(*named).where(self.test()).select(*keys)


@dataclass
class NonConstant(Selection):
    value: str = "value"

    def aggregates(self):
        return {"lo": F.min(self.value), "hi": F.max(self.value)}

    def test(self):
        return F.col("lo") != F.col("hi")


@dataclass
class NonConstantAlong(Selection):
    """Any slice along an axis isn't constant."""

    axis: int
    value: str = "value"

    def select(self, items: DataFrame, keys: Sequence[str] = ("sample_index",)) -> DataFrame:
        return NonConstant(self.value).select(items, [*keys, AXES[self.axis]]).select(*keys).distinct()


@dataclass
class NonBlack(Selection):
    black: float = 0.0
    value: str = "value"

    def aggregates(self):
        return {"hi_b": F.max(self.value)}

    def test(self):
        return F.col("hi_b") > self.black


@dataclass
class Percentile(Selection):
    """All voxels are at or above the sample's own percentile."""

    percentile: float
    value: str = "value"

    def aggregates(self):
        return {"lo_p": F.min(self.value), "cut": F.percentile(self.value, self.percentile / 100)}

    def test(self):
        return F.col("lo_p") >= F.col("cut")


@dataclass
class WithForeground(Selection):
    value: str = "ref"

    def aggregates(self):
        return {"any_fg": F.max((F.col(self.value) != 0).cast("int"))}

    def test(self):
        return F.col("any_fg") == 1


@dataclass
class OfSubjects(Selection):
    subjects: Sequence

    def aggregates(self):
        return {"of_subject": F.min("subject")}

    def test(self):
        return F.col("of_subject").isin(list(self.subjects))


@dataclass
class Compose(Selection):
    """All selections pass, in one aggregate."""

    parts: Sequence[Selection]

    def aggregates(self):
        return {n: a for p in self.parts for n, a in p.aggregates().items()}

    def test(self):
        out = F.lit(True)
        for p in self.parts:
            out &= p.test()
        return out


def select_indices(source: Datasource, selection: Selection) -> DataFrame:
    return selection.select(source.items())
