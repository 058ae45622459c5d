"""Quality rules by suffix-array repetition.

A suffix array over the words of each text, with the common prefixes of neighbours, gives the intervals of suffixes
that start alike. An interval whose suffixes don't all follow the same word is a maximal repeated substring: it can't
be made longer on either side. The deepest interval of a suffix reaches as far as the larger of its two common
prefixes, so the union of those spans is the union of all repeats. The rules limit the share of the text that repeats
of some length or more cover, and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Chunk, SpanHash, chunks, mix

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Share of the characters in words that repeats of so many words or more may cover: the longer, the less.
SHARES = {5: 0.20, 10: 0.15, 20: 0.10, 40: 0.05}

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_share double, longest_repeat long, n_maximal_repeats long"
)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ids and the common prefix length of each suffix with the one before it.

    Prefix doubling: in each round only suffixes that are still tied get sorted. ids must hold values that occur once
    at the ends of texts, so no common prefix crosses texts.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    sorted_ids = ids[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_ids[1:] != sorted_ids[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank.copy()], 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = sa[slots]
        key = (rank[at] << 32) | rank[at + h]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        levels.append(rank.copy())
        h *= 2
    lcp = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    left, right = sa[pairs - 1].copy(), sa[pairs].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][left] == levels[k][right]
        step = same.astype(np.int64) << k
        lcp[pairs] += step
        left += step
        right += step
    return sa, lcp


def maximal_repeats(ids: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeated substrings of ``least`` ids or more: one place of each, and its length.

    Each is an interval of the suffix array whose common prefix is longer than on either side, and whose suffixes don't
    all follow the same id. The stack holds the open intervals.
    """
    before = np.where(sa > 0, ids[sa - 1], -1)
    changes = np.zeros(len(sa), np.int64)
    np.cumsum(before[1:] != before[:-1], out=changes[1:])
    changes = changes.tolist()
    where, length = [], []
    deep = np.flatnonzero(lcp >= least)
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix) of open intervals
    last = -2

    def close(until: int, end: int) -> int:
        first = end
        while stack and stack[-1][0] > until:
            depth, first = stack.pop()
            if changes[end] > changes[first]:
                where.append(first)
                length.append(depth)
        return first

    for k, depth in zip(deep.tolist(), lcp[deep].tolist(), strict=True):
        if k != last + 1:
            close(0, last)
            first = k - 1
        else:
            first = close(depth, last) if stack and stack[-1][0] > depth else last
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
        last = k
    close(0, last)
    return sa[np.array(where, np.int64)], np.array(length, np.int64)


def chunk_rules(chunk: Chunk, shares: dict[int, float], max_longest: int) -> dict[str, np.ndarray]:
    """All columns but the id for the texts of a chunk."""
    min_repeat = min(shares)
    n = len(chunk.begin)
    buf = chunk.buf
    starts, ends, first = chunk.words()
    n_words = np.diff(first)
    text_of = np.repeat(np.arange(n), n_words)
    spans = SpanHash(buf)
    lead = (buf & 0xC0) != 0x80
    space = np.isin(buf, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    word_chars = chunk.per_text(lead & ~space)
    n_symbols = chunk.per_text(SYMBOLS[buf])

    # Lines with a word that equal an earlier line of their text.
    line_end = np.flatnonzero(buf == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_begin)
    line_begin, line_end = line_begin[has_word], line_end[has_word]
    line_text = np.searchsorted(chunk.end, line_begin)
    key = mix(spans(line_begin, line_end) + line_text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    distinct = np.unique(key, return_index=True)[1]
    n_dup_lines = np.bincount(line_text, minlength=n) - np.bincount(line_text[distinct], minlength=n)

    # Word ids, with a value of its own behind each text.
    ids = np.empty(len(starts) + n, np.int64)
    word_slot = np.arange(len(starts)) + text_of
    # A word's id differs from text to text, so only repeats inside a text count.
    own = mix(text_of.astype(np.uint64) + np.uint64(1))
    values, inverse = np.unique(mix(spans(starts, ends) ^ own), return_inverse=True)
    ids[word_slot] = inverse
    ids[first[1:] + np.arange(n)] = len(values) + np.arange(n)
    sa, lcp = suffix_array(ids)
    reach = np.zeros(len(ids), np.int64)
    reach[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    reach = reach[word_slot]
    lead_sum = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=lead_sum[1:])
    chars = lead_sum[ends] - lead_sum[starts]

    def covered_by(least: int) -> np.ndarray:
        at = np.flatnonzero(reach >= least)
        diff = np.zeros(len(starts) + 1, np.int64)
        diff[at] += 1
        np.subtract.at(diff, at + reach[at], 1)
        return np.cumsum(diff)[:-1] > 0

    n_repeat = np.bincount(text_of[covered_by(5)], minlength=n)
    share = {}
    for least in shares:
        covered = covered_by(least)
        share[least] = np.bincount(text_of[covered], weights=chars[covered], minlength=n) / np.maximum(word_chars, 1)
    place, length = maximal_repeats(ids, sa, lcp, min_repeat)
    owner = np.searchsorted(first[1:] + np.arange(n), place)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    within = np.all([share[least] <= limit for least, limit in shares.items()], axis=0)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & within & (longest <= max_longest),
        "covered_share": share[min_repeat],
        "longest_repeat": longest,
        "n_maximal_repeats": np.bincount(owner, minlength=n),
    }


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shares: dict[int, float] = SHARES, max_longest: int = 50) -> DataFrame:
    """Repetition rules for each row: repeats of so many words or more may cover at most such a share of the characters
    in words (``shares``), and none may be longer than ``max_longest`` words. covered_share is the share of the shortest.

    Null or empty text: no words, failed. Repeated rows and ties: each row is judged alone, so equal rows get equal
    results. Null ids are carried. Extra columns are ignored. An empty table gives an empty result. A text of any
    length is read whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                out = chunk_rules(chunk, shares, max_longest)
                ids = batch.column(0).slice(chunk.first, len(chunk.begin))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in out.values())], names=["doc_id", *out])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
