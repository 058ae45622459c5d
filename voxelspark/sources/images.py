"""Image files: MetaImage (.mha) and NIfTI (.nii, .nii.gz) read by our own parsers into voxel tables, and written."""

from __future__ import annotations

import gzip
import io
import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the two formats: names and codes of pixel types.
MHA_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "<i2", "MET_USHORT": "<u2", "MET_INT": "<i4", "MET_UINT": "<u4", "MET_FLOAT": "<f4", "MET_DOUBLE": "<f8"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


#: Bytes that are read at a time, and voxels that leave at a time.
CHUNK, VOXELS = 1 << 16, 1 << 16


class Inflated:
    """The bytes of a zlib stream, read like a file."""

    def __init__(self, source: io.BytesIO) -> None:
        self.source, self.inflate = source, zlib.decompressobj()

    def read(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.source.read(CHUNK)
            piece = self.inflate.decompress(data, n - len(out))
            if not data and not piece:
                raise zlib.error("incomplete or truncated stream")
            out += piece
        return bytes(out)


@dataclass
class OpenImage:
    """An image whose header is read; its voxels follow in source. shape: z, y, x, and components if there are several."""

    source: io.BytesIO | Inflated | gzip.GzipFile
    kind: np.dtype
    shape: tuple[int, ...]
    info: dict
    slope: float = 1.0
    shift: float = 0.0

    def scaled(self, values: np.ndarray) -> np.ndarray:
        if self.slope not in (0.0, 1.0) or (self.slope and self.shift):
            return values * (self.slope or 1.0) + self.shift
        return values

    def parts(self, n: int) -> Iterator[np.ndarray]:
        """Values in order, n at a time; the rest of the file is read too, so that a broken one is noticed."""
        left = math.prod(self.shape)
        while left:
            data = self.source.read(min(n, left) * self.kind.itemsize)
            if len(data) < min(n, left) * self.kind.itemsize:
                raise ValueError("buffer is smaller than requested size")
            values = np.frombuffer(data, self.kind)
            left -= len(values)
            yield self.scaled(values)
        while self.source.read(CHUNK):
            pass

    def array(self) -> np.ndarray:
        return [*self.parts(math.prod(self.shape)), self.scaled(np.empty(0, self.kind))][0].reshape(self.shape)


def open_mha(data: bytes) -> OpenImage:
    head: dict[str, str] = {}
    at = 0
    while "ElementDataFile" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the header has no ElementDataFile")
        name, _, value = data[at:end].decode("latin-1").partition("=")
        head[name.strip()] = value.strip()
        at = end + 1
    if head["ElementDataFile"] != "LOCAL":
        raise ValueError("only images in one file are read")
    source = io.BytesIO(data)
    source.seek(at)
    size = [int(x) for x in head["DimSize"].split()]
    components = int(head.get("ElementNumberOfChannels", 1))
    kind = np.dtype(MHA_TYPES[head["ElementType"]])
    if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True":
        kind = kind.newbyteorder(">")
    numbers = lambda key, default: [float(x) for x in head[key].split()] if key in head else default
    n = len(size)
    info = {"size": size, "spacing": numbers("ElementSpacing", [1.0] * n), "origin": numbers("Offset", [0.0] * n), "direction": numbers("TransformMatrix", np.eye(n).ravel().tolist())}
    return OpenImage(Inflated(source) if head.get("CompressedData", "False") == "True" else source, kind, (*reversed(size), *([components] if components > 1 else [])), info)


def parse_mha(data: bytes) -> tuple[np.ndarray, dict]:
    """Array in z, y, x order (and a last axis of components) and its properties in x, y, z order."""
    image = open_mha(data)
    return image.array(), image.info


def mha_header(size: Sequence[int], kind: np.dtype, spacing: list[float] | None = None, origin: list[float] | None = None, compressed: bool = False) -> bytes:
    """size in x, y, z order."""
    name = next(k for k, v in MHA_TYPES.items() if np.dtype(v) == kind)
    text = lambda values: " ".join(map(str, values))
    lines = ["ObjectType = Image", f"NDims = {len(size)}", "BinaryData = True", "BinaryDataByteOrderMSB = False", f"CompressedData = {compressed}", f"TransformMatrix = {text(np.eye(len(size)).astype(int).ravel())}", f"Offset = {text(origin or [0] * len(size))}", f"ElementSpacing = {text(spacing or [1] * len(size))}", f"DimSize = {text(size)}", f"ElementType = {name}", "ElementDataFile = LOCAL"]
    return ("\n".join(lines) + "\n").encode()


def write_mha(array: np.ndarray, spacing: list[float] | None = None, origin: list[float] | None = None, compressed: bool = False) -> bytes:
    body = np.ascontiguousarray(array).tobytes()
    return mha_header(list(reversed(array.shape)), array.dtype, spacing, origin, compressed) + (zlib.compress(body) if compressed else body)


def open_nifti(data: bytes) -> OpenImage:
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    data = source.read(348)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI file")
    dim = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    pixdim = struct.unpack(order + "8f", data[76:108])
    offset = int(struct.unpack(order + "f", data[108:112])[0])
    slope, shift = struct.unpack(order + "2f", data[112:120])
    rows = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    size = list(dim[1 : 1 + dim[0]])
    if offset < 0 or len(source.read(max(0, offset - 348))) < offset - 348:
        raise ValueError("offset must be non-negative and no greater than buffer length")
    if offset < 348:
        source.seek(offset)
    spacing = [float(x) for x in pixdim[1 : 1 + dim[0]]]
    origin, direction = [0.0] * len(size), np.eye(len(size)).ravel().tolist()
    if struct.unpack(order + "h", data[254:256])[0] and dim[0] >= 3:
        flip = np.array([-1.0, -1.0, 1.0])
        origin = (rows[:, 3] * flip).tolist()
        direction = (rows[:, :3] * flip[:, None] / np.array(spacing[:3])).ravel().tolist()
    return OpenImage(source, np.dtype(NIFTI_TYPES[code]).newbyteorder(order), tuple(reversed(size)), {"size": size, "spacing": spacing, "origin": origin, "direction": direction}, slope, shift)


def parse_nifti(data: bytes) -> tuple[np.ndarray, dict]:
    image = open_nifti(data)
    return image.array(), image.info


def open_image(path: str, data: bytes) -> OpenImage:
    if path.endswith(".mha"):
        return open_mha(data)
    if path.endswith((".nii", ".nii.gz")):
        return open_nifti(data)
    raise ValueError(f"no parser for {path}")


def parse_image(path: str, data: bytes) -> tuple[np.ndarray, dict]:
    image = open_image(path, data)
    return image.array(), image.info


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, OpenImage]]:
    for batch in batches:
        for path, data in zip(*batch.columns, strict=True):
            yield path.as_py(), open_image(path.as_py(), data.as_py())


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content); Spark reads the bytes."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def decode_voxels(files: DataFrame) -> DataFrame:
    """Files (path, content) as (path, z, y, x, channel, value).

    A task gets one file at a time, as it is stored; its voxels are unpacked and leave ``VOXELS`` at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, image in opened(batches):
            shape = image.shape if len(image.shape) > len(image.info["size"]) else (*image.shape, 1)
            if len(shape) > 4:
                raise ValueError(f"{path} has more than three dimensions")
            shape, at = (*[1] * (4 - len(shape)), *shape), 0
            for values in image.parts(VOXELS):
                index = np.unravel_index(np.arange(at, at + len(values)), shape)
                at += len(values)
                yield pa.RecordBatch.from_arrays([pa.repeat(path, len(values)), *[pa.array(a.astype(np.int32)) for a in index], pa.array(values.astype(np.float64))], names=["path", "z", "y", "x", "channel", "value"])

    return files.select("path", "content").groupBy("path").applyInArrow(run, "path string, z int, y int, x int, channel int, value double")


def encode_files(slices: DataFrame, key: str = "subject", spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Slices (key, z, width, data) as .mha files (path, content), one for each key; spacing in x, y, z order.

    Slices reach a task in their order and are packed as they come, so it holds a file only as it is stored.
    """
    steps = list(spacing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate, parts, depth, size, last = zlib.compressobj(), [], 0, None, None
        for batch in batches:
            z, width, data = (batch.column(c) for c in ("z", "width", "data"))
            order = np.concatenate([[] if last is None else [last], z.to_numpy(zero_copy_only=False)])
            if (order[1:] < order[:-1]).any():
                raise RuntimeError("the slices of an image are not in order")
            size, last = size or (pc.list_value_length(data)[0].as_py(), width[0].as_py()), order[-1]
            if data.null_count or pc.any(pc.or_(pc.not_equal(pc.list_value_length(data), size[0]), pc.not_equal(width, size[1]))).as_py() or size[0] % size[1]:
                raise ValueError("the slices of an image must have the same shape")
            parts.append(deflate.compress(np.ascontiguousarray(data.flatten().to_numpy(zero_copy_only=False), "<f8")))
            depth, name = depth + len(batch), batch.column(key)[0].as_py()
        parts.append(deflate.flush())
        head = mha_header([size[1], size[0] // size[1], depth], np.dtype("<f8"), steps, compressed=True)
        content = pa.py_buffer(b"".join([head, *parts]))
        parts.clear()
        file = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(content)], np.int32)), content])
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.mha"]), file], names=["path", "content"])

    ordered = slices.repartition(key).sortWithinPartitions(F.col(key), F.col("z").asc_nulls_last())
    return ordered.groupBy(key).applyInArrow(run, "path string, content binary")


def load_voxels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return decode_voxels(read_files(spark, paths))


def decode_properties(files: DataFrame) -> DataFrame:
    """Files (path, content) as (path, size, spacing, origin, direction)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, image in opened(batches):
            info = image.info
            for _ in image.parts(VOXELS):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([info["size"]], pa.list_(pa.int32())), *[pa.array([info[k]], pa.list_(pa.float64())) for k in ("spacing", "origin", "direction")]], names=["path", "size", "spacing", "origin", "direction"])

    return files.select("path", "content").groupBy("path").applyInArrow(run, "path string, size array<int>, spacing array<double>, origin array<double>, direction array<double>")


def load_properties(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return decode_properties(read_files(spark, paths))
