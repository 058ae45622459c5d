"""Helpers shared by the text operators: vectorised words and hashes, chunks, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash, and the constants of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)
#: Bytes of text that one vectorised step takes at most, unless a single text is longer.
CHUNK_BYTES = 1 << 20
BATCHED = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> S33)
    h = h * MIX_1
    h = h ^ (h >> S33)
    h = h * MIX_2
    return h ^ (h >> S33)


class _Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def grown(base: int) -> np.ndarray:
                p = np.full(n, base, np.uint64)
                p[0] = 1
                return np.cumprod(p)

            self.up, self.down = grown(BASE), grown(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class SpanHash:
    """Hashes of any byte ranges of one buffer in constant time each."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self._down = _POWERS.get(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self._sums[1:])

    def rolling(self, size: int) -> np.ndarray:
        """Unmixed hash of the ``size`` bytes from each byte on at which they fit: equal bytes have equal hashes."""
        n = len(self._sums) - size
        return (self._sums[size:] - self._sums[:n]) * self._down[:n] if n > 0 else np.zeros(0, np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * MIX_2)


@dataclass
class Chunk:
    """Some texts as one byte buffer. Text i lies at [begin[i], end[i]); a newline follows each."""

    first: int
    buf: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def words(self, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the index of its first word (with a last entry)."""
        buf = self.buf if buf is None else buf
        space = np.ones(len(buf) + 2, bool)
        space[1:-1] = SPACE[buf]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.append(np.searchsorted(starts, self.begin), len(starts))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.end] - sums[self.begin]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class _Freed:
    """Gives freed memory back to the system now and then: idle workers stay, and keep what they have."""

    def __init__(self, every: int = 16 << 20) -> None:
        self.every, self.done = every, 0
        try:
            self.trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            self.trim = None

    def add(self, n_bytes: int) -> None:
        self.done += n_bytes
        if self.done >= self.every:
            self.done = 0
            pa.default_memory_pool().release_unused()
            if self.trim:
                self.trim(0)


FREED = _Freed()


def give_back() -> None:
    """Frees what a task held, at its end."""
    FREED.add(FREED.every)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Splits a text column into chunks of about ``limit`` bytes; a longer text is a chunk of its own."""
    texts = text_bytes(column)
    at, total = 0, 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < limit):
            size += len(texts[stop]) + 1
            stop += 1
        part = texts[at:stop]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(lengths + 1) - 1
        yield Chunk(at, np.frombuffer(b"\n".join(part) + b"\n", np.uint8), end - lengths, end)
        at, total = stop, total + size
    FREED.add(total)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (two bytes each in UTF-8) lower-cased, all other bytes kept."""
    out = lower_ascii(buf)
    second = np.zeros(len(buf), bool)
    second[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[second] += np.uint8(32)
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words at each word that has n words of its text from it on, and those words' indexes."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k : total - n + 1 + k]
    ok = np.ones(total - n + 1, bool)
    for back in range(1, n):
        cut = first[1:] - back
        cut = cut[(cut >= 0) & (cut < len(ok)) & (cut >= 0)]
        ok[cut] = False
    # Windows that start before a text's last n-1 words end inside the text.
    return mix(out)[ok], np.flatnonzero(ok)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local master gets a folder of its own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return spark.sparkContext.getCheckpointDir()


def stash(df: DataFrame, rows_at_once: int | None = None) -> DataFrame:
    """Writes a table to the shared checkpoint folder and reads it again: cuts lineage, survives lost executors.

    rows_at_once: rows that go to Python in one batch while it is written. Spark bounds batches by rows alone, so rows
    with texts need fewer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    if rows_at_once:
        spark.conf.set(BATCH_ROWS, min(rows_at_once, int(before)) if int(before) > 0 else rows_at_once)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    # Shuffle files go when the driver's garbage is collected, which may otherwise be long after the write.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """At most BATCHED rows in a batch that goes to Python, from now on. Spark bounds batches by rows alone, so rows
    with long texts would fill the memory of both sides; the queries and the pipeline call this."""
    now = int(spark.conf.get(BATCH_ROWS))
    if now <= 0 or now > BATCHED:
        spark.conf.set(BATCH_ROWS, BATCHED)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> list:
    """Columns that name a row even where ids repeat: rows that share both are the same text."""
    return [F.col(id_col).alias("k_id"), F.xxhash64(text_col).alias("k_text")]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
