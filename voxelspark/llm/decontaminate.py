"""Benchmark decontamination: n-gram seeds propose windows of texts, Smith-Waterman alignment scores them.

The n-grams of the test items go to every task in blocks of bounded size. One scan keeps, around the n-grams of a text
that occur in items, windows of word hashes. Every n-gram of an item is a seed, common or not: a window is a candidate
of each item of which it holds one. A bound on the score by shared words alone, which no alignment exceeds, drops most
candidates of common n-grams; the rest are aligned word by word. Edited copies lose some n-grams but keep others, and
the alignment bridges changed, dropped and added words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, SpanHash, chunks, lower_latin, shingles, stash

#: n-grams of items that one block sends to every task (16 bytes each); more items make more blocks.
BLOCK_GRAMS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells that one alignment step holds at most.
CELLS = 1 << 20

#: Letters and digits in lower case; other ASCII characters separate words.
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[[i for i in range(128) if not chr(i).isalnum()]] = 32


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in lower case without marks, and for each text the index of its first word."""
    buf = lower_latin(WORD_BYTES[chunk.buf])
    starts, ends, first = chunk.words(buf)
    return SpanHash(buf)(starts, ends), first


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items as (item_id, words): their word hashes, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                h, first = word_hashes(chunk)
                words = [h[i:j].astype("<u8").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(words)), pa.array(words, pa.binary())], names=["item_id", "words"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, words binary")


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """n-grams of one item; an item of fewer words has one, of all its words."""
    n = min(n, len(words))
    return np.unique(shingles(words, np.array([0, len(words)]), n)[0]) if n else np.zeros(0, np.uint64)


def align(item: list[np.ndarray], window: list[np.ndarray]) -> list[tuple[int, int]]:
    """Smith-Waterman score of each item with its window, and the word of the window at which the alignment ends.

    All pairs advance together, a row for each word of the items; gaps along a row are a running maximum.
    """
    rows, width = max(map(len, item)), max(map(len, window))
    n = len(item)
    a = np.zeros((n, rows), np.uint64)
    b = np.ones((n, width), np.uint64)  # padding that equals nothing
    real = np.zeros((n, rows), bool)
    for k, (x, y) in enumerate(zip(item, window, strict=True)):
        a[k, : len(x)], b[k, : len(y)], real[k, : len(x)] = x, y, True
    slope = np.arange(1, width + 1) * -GAP
    last = np.zeros((n, width + 1), np.int32)
    best, at = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for r in range(rows):
        score = np.where((a[:, r, None] == b) & real[:, r, None], MATCH, MISMATCH).astype(np.int32)
        cell = np.maximum(np.maximum(last[:, :-1] + score, last[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        last[:, 1:] = np.where(real[:, r, None], cell, last[:, 1:])
        row_best = cell.argmax(axis=1)
        value = cell[np.arange(n), row_best]
        better = (value > best) & real[:, r]
        best[better], at[better] = value[better], row_best[better]
    return [(int(x), int(y)) for x, y in zip(best, at, strict=True)]


def span_factor(min_ratio: float) -> float:
    """Words of a text that an alignment of at least ``min_ratio`` covers at most, for each word of the item.

    Words without a partner cost 1 each and matches give 2, for at most all words of the item.
    """
    return 1 + MATCH * (1 - min_ratio) / -max(MISMATCH, GAP)


def may_reach(known: np.ndarray, n_words: int, window: np.ndarray, min_ratio: float) -> bool:
    """Whether an item of ``n_words`` words, ``known`` its distinct ones sorted, can reach the ratio in a window.

    Never false where an alignment reaches it: each word of the window in it is a match, which the item has to know, or
    costs 1 at least, and the matches lie within the longest span.
    """
    inside = known[np.minimum(np.searchsorted(known, window), len(known) - 1)] == window
    sums = np.zeros(len(window) + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    span = min(int(span_factor(min_ratio) * n_words + 1e-9), len(window))
    if (sums[span:] - sums[: len(sums) - span]).max() < min_ratio * n_words - 1e-9:
        return False
    gain = np.zeros(len(window) + 1, np.int64)
    np.cumsum(np.where(inside, MATCH, max(MISMATCH, GAP)), out=gain[1:])
    return (gain - np.minimum.accumulate(gain)).max() >= min_ratio * MATCH * n_words - 1e-9


def _windows(docs: DataFrame, sent, n: int, reach: int) -> DataFrame:
    """Windows of texts around n-grams of the block: (doc_id, at, words, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sizes = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                h, first = word_hashes(chunk)
                at, gram = [], []
                for size in sizes:
                    g, where = shingles(h, first, size)
                    place = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                    hit = grams[place] == g
                    at.append(where[hit])
                    gram.append(g[hit])
                at, gram = np.concatenate(at), np.concatenate(gram)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, gram = at[order], gram[order]
                text = np.searchsorted(first, at, "right") - 1
                cut = np.flatnonzero((text[1:] != text[:-1]) | (at[1:] - at[:-1] > reach)) + 1
                rows = []
                for i, j in zip([0, *cut], [*cut, len(at)], strict=True):
                    t = text[i]
                    lo, hi = max(first[t], at[i] - reach), min(first[t + 1], at[j - 1] + n + reach)
                    rows.append((ids[chunk.first + t], int(lo - first[t]), h[lo:hi].astype("<u8").tobytes(), np.unique(gram[i:j]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "at", "words", "grams"])

    return docs.mapInArrow(run, "doc_id long, at long, words binary, grams array<long>")


def _aligned(windows: DataFrame, sent, min_ratio: float) -> DataFrame:
    """Aligns each window with the items of its n-grams, where the shared words allow the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, seed_items, words = sent.value
        known = {item: np.unique(w) for item, w in words.items()}
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: (len(x[3]), len(words[x[2]])))
            rows, i = [], 0
            while i < len(held):
                j = i
                while j < len(held) and (j == i or (j - i + 1) * len(held[j][3]) <= CELLS):
                    j += 1
                part = held[i:j]
                for (doc_id, at, item, window), (score, end) in zip(part, align([words[x[2]] for x in part], [x[3] for x in part]), strict=True):
                    ratio = score / (MATCH * len(words[item]))
                    if ratio >= min_ratio:
                        rows.append((doc_id, item, score, ratio, at + end + 1))
                i = j
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "ratio", "end_word"])

        for batch in batches:
            for doc_id, at, data, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = np.array(grams, np.int64).view(np.uint64)
                lo, hi = np.searchsorted(seeds, grams), np.searchsorted(seeds, grams, "right")
                items = {int(seed_items[k]) for i, j in zip(lo, hi, strict=True) for k in range(i, j)}
                if items:
                    window = np.frombuffer(data, "<u8")
                    held.extend((doc_id, at, item, window) for item in sorted(items) if may_reach(known[item], len(words[item]), window, min_ratio))
                if len(held) > 2000:
                    yield from flush()
        yield from flush()

    return windows.mapInArrow(run, "doc_id long, item_id long, score long, ratio double, end_word long")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *, n: int = 4, min_ratio: float = 0.6) -> DataFrame:
    """Pairs of a text and a test item that it copies, edited or not: doc_id, item_id, score, ratio, end_word.

    ratio is the best local alignment's score over that of a whole copy. Every pair that shares an n-gram is judged; a
    copy with an edit in every run of n words shares none and isn't found. An item of fewer than n words has one
    n-gram, of all its words. Null or empty texts and items match nothing. Repeated rows give one row
    for each id and item, the best. Null ids of texts are carried, null ids of items dropped. Extra columns are
    ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = item_words(items.where(F.col(item_id_col).isNotNull()), item_id_col, item_text_col).where(F.length("words") > 0)
    total = listed.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    n_blocks = max(1, -int(-total // BLOCK_GRAMS))
    found = []
    for block in range(n_blocks):
        mine = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else listed
        words = {r["item_id"]: np.frombuffer(r["words"], "<u8") for r in mine.toLocalIterator()}
        if not words:
            continue
        grams = {k: grams_of(w, n) for k, w in words.items()}
        every = np.unique(np.concatenate(list(grams.values())))
        sizes = sorted({min(n, len(w)) for w in words.values()})
        reach = int(np.ceil(max(2, span_factor(min_ratio)) * max(map(len, words.values()))))
        sent = spark.sparkContext.broadcast((every, sizes))
        windows = stash(_windows(docs, sent, n, reach))
        seeds = np.concatenate(list(grams.values()))
        owners = np.repeat(np.array(list(grams), np.int64), [len(own) for own in grams.values()])
        order = np.argsort(seeds, kind="stable")
        sent_seeds = spark.sparkContext.broadcast((seeds[order], owners[order], words))
        found.append(_aligned(windows, sent_seeds, min_ratio))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, score long, ratio double, end_word long")
    every_pair = found[0]
    for more in found[1:]:
        every_pair = every_pair.unionByName(more)
    best = F.max(F.struct("score", "ratio", "end_word")).alias("best")
    return every_pair.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.ratio", "best.end_word")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose id is in no pair. Rows with a null id are kept unless a text with a null id is contaminated."""
    ids = contaminated(docs, items, id_col, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids["__bad"]), "left_anti")
