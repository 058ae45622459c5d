"""Packing of token sequences by the harmonic method.

Class j takes pieces of at most capacity / j tokens, more than capacity / (j + 1), and fills each bin with exactly j
of them, so a bin's place is known without looking at other bins and every worker packs on its own. Documents may be
cut: whole capacities first, then the rest is cut down to class sizes, until what is left fills its class well. Bins
that are open at a worker's end hold less than one bin of each class; their pieces are joined and cut at powers of two.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Chunk, SpanHash, chunks, give_back

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Words and their ids, and parts of words, that a worker keeps; a full table starts anew. Longer parts aren't kept.
CACHE_WORDS, CACHE_IDS, CACHE_PARTS, LONG_WORD = 1_000_000, 6_000_000, 300_000, 64
#: From this class on, a bin of pieces just over the next class's size wastes at most 1 / class of its capacity.
FINE_CLASS = 64


class WordIds:
    """Ids of whole texts, word by word: white space ends every token of the tokenizer, so words are independent.

    A table of 64-bit word hashes says where in a pool the ids of known words lie; all words of a chunk are looked up
    at once. A new word of plain letters and ASCII marks behind them is two parts to the tokenizer, which ignores case;
    the ids of such parts are kept too, and new parts are encoded in one call. Other words are encoded as they are.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|<>]*)|([.,;:!?#$%&*|]+)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.parts.clear()
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, parts: list[str], each: bool) -> None:
        """Keeps the ids of parts; those that are one token run each end with an end-of-word token."""
        if not parts:
            return
        if not each:
            ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) == len(parts) and cut[-1] == 4 * len(ids):
                data = ids.tobytes()
                self.parts.update(zip(parts, map(data.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
                return
        for w, x in zip(parts, self.tokenizer.encode_batch(parts, add_special_tokens=False), strict=True):
            self.parts[w] = np.array(x.ids, "<u4").tobytes()

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        """Adds new words, whose hashes are sorted, to the table."""
        parts = self.parts
        if len(parts) > CACHE_PARTS:
            parts.clear()
        made: list[tuple[str, ...]] = []
        plain: dict[str, None] = {}
        other: dict[str, None] = {}
        for text in words:
            m = self.PLAIN.fullmatch(text)
            if m is None:
                own: tuple[str, ...] = (text,)
                if text not in parts:
                    other[text] = None
            else:
                letters, marks, alone = m.groups()
                own = (alone,) if alone else (letters.lower(), marks) if marks else (letters.lower(),)
                for x in own:
                    if x not in parts:
                        plain[x] = None
            made.append(own)
        self._encode(list(plain), each=False)
        self._encode(list(other), each=True)
        ids = [b"".join([parts[x] for x in own]) for own in made]
        for x in other:
            if len(x) > LONG_WORD:
                del parts[x]
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        data = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(data) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(data), np.uint32)])
        self.pool[self.used : self.used + len(data)] = data
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, where, count)
        self.keys = np.insert(self.keys, where, keys)
        self.used += len(data)

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, one behind the other, and where each text's begin (with a last entry)."""
        if len(self.keys) > CACHE_WORDS or self.used > CACHE_IDS:
            self.forget()
        starts, ends, first = chunk.words()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        keys, sample, inverse = np.unique(SpanHash(chunk.buf)(starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if new.any():
            raw = chunk.buf.tobytes()
            self._learn([raw[i:j].decode() for i, j in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)], keys[new])
            place = np.searchsorted(self.keys, keys)
        count = self.count[place][inverse]
        behind = np.cumsum(count)
        ids = self.pool[np.repeat(self.at[place][inverse] - (behind - count), count) + np.arange(behind[-1])]
        return ids, np.append(0, behind)[first]


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer in each worker process."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def cuts(length: int, capacity: int) -> list[int]:
    """Piece lengths of a document: whole bins, then sizes capacity // j, then a last piece that fills its class."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if j >= FINE_CLASS or rest == capacity // j:
            out.append(rest)
            break
        size = capacity // (j + 1)
        if capacity - rest * j <= capacity // 50:
            size = rest
        out.append(size)
        rest -= size
    return out


class HarmonicPacker:
    """Bins of one worker. Open bins hold fewer than ``class`` pieces each, at most one bin for each class."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Places a document; gives the rows of bins that are full."""
        total, start = len(ids) // 4, 0
        for size in cuts(total, self.capacity):
            piece = (doc_id, start, ids[4 * start : 4 * (start + size)], total)
            start += size
            j = self.capacity // size
            held = self.open.setdefault(j, [])
            held.append(piece)
            if len(held) == j:
                del self.open[j]
                yield from self._close(held)

    def finish(self) -> Iterator[tuple]:
        """Joins the pieces of the open bins: full bins, and for what is left sequences of powers of two."""
        queue = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in queue)
        queue.reverse()
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            held = []
            while size:
                doc_id, start, ids, total = queue.pop()
                n = len(ids) // 4
                if n > size:
                    queue.append((doc_id, start + size, ids[4 * size :], total))
                    ids, n = ids[: 4 * size], size
                held.append((doc_id, start, ids, total))
                size -= n
            yield from self._close(held)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.

    Null or empty text: the end id alone, one piece. Repeated rows and ties: each row is a document of its own. Null
    ids are carried. Extra columns are ignored. An empty table gives no rows. Texts of any length are packed whole.
    No shuffle: a sequence's number is the worker's partition and a running number in it, the same in every attempt.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=NAMES)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                ids, begin = encode(chunk)
                data, cut = ids.tobytes(), (4 * begin).tolist()
                for i in range(len(cut) - 1):
                    rows.extend(packer.add(names[chunk.first + i], data[cut[i] : cut[i + 1]] + end))
                    if len(rows) > 20_000:
                        yield batch_of()
                        rows.clear()
        rows.extend(packer.finish())
        give_back()
        if rows:
            yield batch_of()

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
