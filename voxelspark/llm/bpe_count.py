"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a linked list; a heap gives the adjacent pair of the lowest rank; each merge joins two
symbols and offers the two new pairs. The count is the number of initial symbols minus the number of merges, so no
identifiers are made. Counts of words are kept in a bounded table in each worker.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE_MARK = "▁"
#: Words and parts of words whose counts a worker keeps; a full table starts anew. Longer words aren't kept.
CACHE_WORDS, CACHE_PARTS, LONG_WORD = 600_000, 800_000, 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceCounter:
    """Counts tokens as a piece model of kind BPE with byte fallback and identity normalisation gives them."""

    NORMAL, UNUSED = 1, 5

    def __init__(self, model_path: str) -> None:
        with open(model_path, "rb") as f:
            data = f.read()
        pieces = []
        normalizer: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, self.NORMAL)
                if kind == self.NORMAL:
                    pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]))
                elif kind in (4, self.UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only identity normalisation with a leading space mark is supported")
        self.rank = {text: -score for text, score in pieces}
        joined = {c for text in self.rank if len(text) > 1 for c in text}
        if not joined <= self.rank.keys() or any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in self.rank):
            raise ValueError("a piece has a character that is no piece, or a space mark behind another character")
        #: A line break that no longer piece contains never merges, so texts can be cut there.
        self.cut_lines = "\n" not in joined
        self.line_cost = self._cost("\n")
        #: Pairs of neighbours inside some piece; no merge joins other neighbours, so words are cut between them.
        self.pairs = {text[i : i + 2] for text in self.rank for i in range(len(text) - 1)}
        self.cache: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def _cost(self, char: str) -> int:
        return 1 if char in self.rank else len(char.encode())

    def merged(self, word: str) -> int:
        """Initial symbols minus merges for a word that begins with its space marks, if any."""
        symbols = list(word)
        rank = self.rank
        n = len(symbols)
        count = sum(1 if c in rank else len(c.encode()) for c in symbols)
        if n < 2:
            return count
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        if not heap:
            return count
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, j, size = heappop(heap)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has been merged since
            symbols[i] = left = left + right
            symbols[j] = ""
            count -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                pair = left + symbols[j]
                if (r := rank.get(pair)) is not None:
                    heappush(heap, (r, i, j, len(pair)))
            j = before[i]
            if j >= 0:
                pair = symbols[j] + left
                if (r := rank.get(pair)) is not None:
                    heappush(heap, (r, j, i, len(pair)))
        return count

    def word(self, word: str) -> int:
        """Tokens of a word, cut where no piece reaches across."""
        pairs, parts, total, begin = self.pairs, self.parts, 0, 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in pairs:
                part = word[begin:i]
                begin = i
                n = parts.get(part)
                if n is None:
                    n = self.merged(part)
                    if len(part) <= LONG_WORD:
                        parts[part] = n
                total += n
        return total

    def _words(self, line: str) -> Iterator[str]:
        """Cuts before each run of space marks, where no piece reaches across."""
        begin, n = 0, len(line)
        while begin < n:
            at = begin
            while at < n and line[at] == SPACE_MARK:
                at += 1
            at = line.find(SPACE_MARK, at)
            at = n if at < 0 else at
            yield line[begin:at]
            begin = at

    def count(self, text: str) -> int:
        if not text:
            return 0
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        if not self.cut_lines:
            lines = [SPACE_MARK + text.replace(" ", SPACE_MARK)]
        else:
            lines = (SPACE_MARK + text.replace(" ", SPACE_MARK)).split("\n")
        total = (len(lines) - 1) * self.line_cost
        for line in lines:
            head, *words = line.split(SPACE_MARK)
            if "" in words or (words and SPACE_MARK in head):
                parts = list(self._words(line))
            else:
                parts = [SPACE_MARK + w for w in words]
                if head:
                    parts.append(head)
            try:
                total += sum(map(cache.__getitem__, parts))
            except KeyError:
                for part in parts:
                    n = cache.get(part)
                    if n is None:
                        n = self.word(part)
                        if len(part) <= LONG_WORD:
                            cache[part] = n
                    total += n
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    """One counter in each worker process."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of each text, and whether it is over ``limit`` tokens.

    Null or empty text: no bytes, no tokens. Repeated rows and ties: each row is counted alone. Null ids are carried.
    Extra columns are ignored. An empty table gives an empty result. Texts of any length are counted whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [count(x) for x in texts]
            n_bytes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
