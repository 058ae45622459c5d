"""Removal of long byte strings that start more than once in the corpus, by suffix arrays.

Every window of ``length`` bytes has an anchor: the leftmost smallest hash of its 32-byte strings. Half of what a
window holds beside its anchor, or more, lies on one side, and the anchor with that half is the window's key. Equal
windows have equal keys, so the windows of one key of a text, a fragment, need only meet fragments of the same key.
Fragments whose key occurs once are unique, and those of a key whose fragments are all equal repeat. The others meet
in tasks, equal ones as one, where a suffix array over them sorts their windows and the common prefixes of neighbours
tell which of them repeat.

The suffix array is built in two stages: suffixes smaller than their successors are sorted directly, the others are
induced from them by scans over the buckets of first symbols.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, S33, SpanHash, chunks, drop_stash, mix, partitions_of, stash, text_bytes

GRAM = 32
#: Low bits of an anchor's sort key that hold its place; texts may have up to 2^30 bytes.
PLACE = np.uint64((1 << 30) - 1)
#: Distinct fragments of one key that meet in one task; more are dealt to slices.
SLICE = 1000
#: Bytes of fragments in one suffix array, unless one slice has more.
SORT_BYTES = 1 << 19
#: Texts that a task remembers so as not to cut copies again, and rows of texts that go to Python at once.
SEEN_TEXTS, TEXT_ROWS = 200_000, 500
#: Bits of a fragment's place: number of windows, first window, and the low bits of the text's length.
N_BITS, FIRST_BITS = 9, 31
#: Symbols in a sort key, of nine bits each: 0 ends a fragment, a byte is its value plus 1.
KEY_SYMBOLS = 7
#: Lengths whose rolling hashes tell a common prefix step by step: whole keys first, single symbols last.
LADDER, FINE = [224, 112, 56, 28, 14, 7], [4, 2, 1]
#: A window of a sliced key, one of those that are equal in its slice, and whether no other of the slice equals it.
LONE = np.dtype([("window", "<u8"), ("key", "<i8"), ("content", "<i8"), ("at", "<i4"), ("alone", "<i4")])


def anchors(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For the texts at [begin, end) of a buffer: text, first window, number of windows and key of each fragment."""
    spans = SpanHash(buf)
    n, w = len(buf), length - GRAM + 1
    long = np.flatnonzero(end - begin >= length)
    if not len(long):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = spans.rolling(GRAM) * MIX_1
    h ^= h >> S33
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[: len(key) - w + 1], ahead[w - 1 : len(key)])
    place = (least & PLACE).astype(np.int64)
    # The longer side of each window beside its anchor: the right one up to half of the bytes on the left.
    half = (length - GRAM) // 2
    kind = 2 * place + (place - np.arange(len(place)) > half)
    # Windows inside texts, as a mask with a border on either side.
    change = np.zeros(len(least) + 2, np.int8)
    change[begin[long] + 1] += 1
    np.subtract.at(change, np.minimum(end[long] - length + 2, len(least) + 1), 1)
    inside = np.cumsum(change, dtype=np.int8) > 0
    inside[-1] = False
    other = np.ones(len(least) + 1, bool)
    other[1:-1] = kind[1:] != kind[:-1]
    first = np.flatnonzero(inside[1:-1] & (other[:-1] | ~inside[:-2]))
    last = np.flatnonzero(inside[1:-1] & (other[1:] | ~inside[2:]))
    text = np.searchsorted(begin, first, "right") - 1
    at, left = place[first], kind[first] % 2 == 1
    whole = spans(np.where(left, at - half - 1, at), np.where(left, at + GRAM, at + length - half))
    return text, first, last - first + 1, mix(whole + left)


def two_stage_suffix_array(t: np.ndarray, spans: SpanHash, depth: int) -> np.ndarray:
    """Suffix array of symbols t (uint16 below 512, the last one 0), in order by their first ``depth`` symbols at least."""
    n = len(t)
    step = t[1:].astype(np.int32) - t[:-1]
    # A suffix is smaller than its successor if the next change of symbol is a rise; the last one is larger than nothing.
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    place = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.append(step, -1)[place] > 0
    padded = np.zeros(n + KEY_SYMBOLS, np.uint64)
    padded[:n] = t
    keys = np.zeros(n + 1, np.uint64)
    for k in range(KEY_SYMBOLS):
        keys[:n] |= padded[k : n + k] << np.uint64(9 * (KEY_SYMBOLS - 1 - k))

    # Stage one: direct sort. Hashes of the next 224, 112, ... 7 symbols tell in six steps how much two suffixes share.
    ladder = []
    for size in LADDER:
        rung = np.arange(n + 2 * LADDER[0], dtype=np.uint64)
        known = spans.rolling(size)
        rung[: len(known)] = known
        ladder.append((size, rung))
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(keys[direct], kind="stable")]
    tied = keys[direct[1:]] == keys[direct[:-1]]
    group = np.zeros(len(direct), np.int64)
    np.cumsum(~tied, out=group[1:])
    active = np.zeros(len(direct), bool)
    active[1:] |= tied
    active[:-1] |= tied
    slots = np.flatnonzero(active)
    while len(slots):
        own, g = direct[slots], group[slots]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(head, len(g)))
        lead = np.repeat(own[head], size)
        # What all of a group share is skipped: the least common prefix with the group's first, in whole keys.
        low = np.zeros(len(own), np.int64)
        for k, rung in ladder:
            low += k * (rung[own + low] == rung[lead + low])
        low[head] = depth
        common = np.repeat(np.minimum.reduceat(low, head), size)
        rest = common < depth
        slots, own, g, common = slots[rest], own[rest], g[rest], common[rest]
        if not len(slots):
            break
        key = keys[np.minimum(own + common, n)]
        order = np.lexsort((key, g))
        own, key = own[order], key[order]
        direct[slots] = own
        new = np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))
        group[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]

    # Stage two: the larger suffixes come first in the bucket of their symbol, in the order of their successors.
    count = np.bincount(t, minlength=258)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    n_direct = np.bincount(t[direct], minlength=258)
    split = begin + count - n_direct
    sa = np.empty(n, np.int64)
    symbol = t[direct]
    first = np.concatenate([[0], np.cumsum(n_direct)[:-1]])
    sa[split[symbol] + np.arange(len(direct)) - first[symbol]] = direct
    head = begin.copy()
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    for c in np.flatnonzero(count):
        at = begin[c]
        while at < head[c]:  # runs of one symbol induce in their own bucket, one wave at a time
            wave = sa[at : head[c]] - 1
            at = head[c]
            wave = wave[(wave >= 0) & (t[wave] == c)]
            sa[at : at + len(wave)] = wave
            head[c] += len(wave)
        before = sa[begin[c] : begin[c] + count[c]] - 1
        before = before[before >= 0]
        before = before[(t[before] > c) & ~smaller[before]]
        symbol = t[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        moved = np.bincount(symbol, minlength=258)
        first = np.concatenate([[0], np.cumsum(moved)[:-1]])
        sa[head[symbol] + np.arange(len(before)) - first[symbol]] = before
        head += moved
    return sa


def common_prefixes(sa: np.ndarray, spans: SpanHash, room: np.ndarray) -> np.ndarray:
    """Symbols that each suffix of a sorted list shares with the one before it, up to the reach of the ladder.

    room: symbols from each place to its fragment's end.
    """
    left, right = sa[:-1], sa[1:]
    out = np.zeros(len(left), np.int64)
    for size in [*LADDER, *FINE]:
        rung = spans.rolling(size)
        i, j = left + out, right + out
        fits = np.maximum(i, j) < len(rung)
        same = np.zeros(len(left), bool)
        same[fits] = rung[i[fits]] == rung[j[fits]]
        out += size * same
    return np.minimum(out, np.minimum(room[left], room[right]))


def repeated_windows(fragments: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each fragment, whether each of its windows starts more than once among the fragments, and their hashes."""
    sizes = np.array([len(x) for x in fragments])
    raw = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8)
    end = np.cumsum(sizes + 1) - 1
    t = raw.astype(np.uint16) + 1
    t[end] = 0
    # Hashes see where a fragment ends as a byte that no text holds.
    seen = raw.copy()
    seen[end] = 0xFF
    spans = SpanHash(seen)
    sa = two_stage_suffix_array(t, spans, length)
    begin = end - sizes
    room = np.repeat(end, sizes + 1) - np.arange(len(t))
    sa = sa[room[sa] >= length]
    same = common_prefixes(sa, spans, room) >= length
    again = np.zeros(len(t), bool)
    again[sa[1:][same]] = True
    again[sa[:-1][same]] = True
    windows = mix(spans.rolling(length))
    cut = [(b, b + k) for b, k in zip(begin.tolist(), (sizes - length + 1).tolist(), strict=True)]
    return [again[i:j] for i, j in cut], [windows[i:j] for i, j in cut]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Fragments of all texts (k_id, k_text, text): their texts, place, key and a hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            fresh = []
            for k, h in enumerate(batch.column(1).to_pylist()):
                if h not in seen:
                    fresh.append(k)
                    seen[h] = None
                    if len(seen) > SEEN_TEXTS:
                        seen.popitem(last=False)
            batch = batch.take(pa.array(fresh, pa.int64()))
            for chunk in chunks(batch.column(2)):
                text, first, n, key = anchors(chunk.buf, chunk.begin, chunk.end, length)
                content = SpanHash(chunk.buf)(first, first + n + length - 1)
                rows = pa.array(text + chunk.first)
                size = (chunk.end - chunk.begin)[text]
                place = size.astype(np.uint64) << np.uint64(N_BITS + FIRST_BITS) | (first - chunk.begin[text]).astype(np.uint64) << np.uint64(N_BITS) | n.astype(np.uint64)
                columns = [pa.array(place.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(mix(content + n.astype(np.uint64)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=["k_id", "k_text", "place", "key", "content"])

    return texts.mapInArrow(run, "k_id long, k_text long, place long, key long, content long")


def _unpacked(df: DataFrame) -> DataFrame:
    """Columns k_size, first and n for place."""
    first = F.shiftrightunsigned("place", N_BITS).bitwiseAND(F.lit((1 << FIRST_BITS) - 1))
    rest = [c for c in df.columns if c != "place"]
    return df.select(*rest, F.shiftrightunsigned("place", N_BITS + FIRST_BITS).alias("k_size"), first.alias("first"), F.col("place").bitwiseAND(F.lit((1 << N_BITS) - 1)).alias("n"))


def _bytes_of(texts: DataFrame, fragments: DataFrame, length: int) -> DataFrame:
    """The bytes of fragments, read from one text that holds each: a text is joined once, with all its fragments."""
    lists = fragments.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("first", "n", "key", "content", "slice", "slices")).alias("parts"))
    same = texts["k_id"].eqNullSafe(lists["k_id"]) & (texts["k_text"] == lists["k_text"])
    found = texts.join(lists.hint("shuffle_hash"), same).select(lists["k_id"], lists["k_text"], "text", "parts")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple] = set()
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "slice", "content", "slices", "data"])

        for batch in batches:
            ids, keys, parts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for name, text, own in zip(zip(ids, keys, strict=True), text_bytes(batch.column(2)), parts, strict=True):
                if name in given:  # a row that repeats
                    continue
                given.add(name)
                for p in own:
                    data = text[p["first"] : p["first"] + p["n"] + length - 1]
                    rows.append((p["key"], p["slice"], p["content"], p["slices"], data))
                    size += len(data)
                if size > 4 << 20:
                    yield made()
                    rows.clear()
                    size = 0
        if rows:
            yield made()

    return found.mapInArrow(run, "key long, slice int, content long, slices int, data binary")


def _sorted(fragments: DataFrame, length: int) -> DataFrame:
    """Runs lo, hi of repeated windows of each fragment. Of sliced keys also each slice's distinct windows, packed by
    buckets of their hash (``lone``, with the bucket in place of the key)."""
    parts = partitions_of(fragments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        names = ["key", "content", "lo", "hi", "lone"]

        def flush() -> Iterator[pa.RecordBatch]:
            flags, hashes = repeated_windows([x[4] for x in held], length)
            rows, lone = [], []
            told: set[int] = set()
            for (key, _, content, slices, _), flag, h in zip(held, flags, hashes, strict=True):
                if flag.any():
                    rows.append((key, content, *_runs(flag), None))
                if slices > 1:
                    again = [k for k in np.flatnonzero(flag).tolist() if (x := int(h[k])) not in told and not told.add(x)]
                    at = np.concatenate([np.flatnonzero(~flag), np.array(again, np.int64)])
                    own = np.empty(len(at), LONE)
                    own["window"], own["key"], own["content"], own["at"], own["alone"] = h[at], key, content, at, ~flag[at]
                    lone.append(own)
            if lone:
                every = np.concatenate(lone)
                bucket = (every["window"] % np.uint64(parts)).astype(np.int64)
                every = every[np.argsort(bucket, kind="stable")]
                edge = np.searchsorted(np.sort(bucket), np.arange(parts + 1))
                rows += [(b, None, None, None, every[i:j].tobytes()) for b, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if i < j]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last and size > SORT_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
                last = row[:2]
                held.append(row)
                size += len(row[4])
        if held:
            yield from flush()

    ordered = fragments.repartition(parts, "key", "slice").sortWithinPartitions("key", "slice")
    return ordered.mapInArrow(run, "key long, content long, lo array<int>, hi array<int>, lone binary")


def _across(found: DataFrame) -> DataFrame:
    """Runs of single windows that slices hold alone but others hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, LONE) for batch in batches for x in batch.column(1).to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["window"], kind="stable")]
        same = rows["window"][1:] == rows["window"][:-1]
        rows = rows[(np.append(False, same) | np.append(same, False)) & (rows["alone"] == 1)]
        at = rows["at"].astype(np.int32)
        one = np.arange(len(rows) + 1, dtype=np.int32)
        columns = [pa.array(np.ascontiguousarray(rows["key"])), pa.array(np.ascontiguousarray(rows["content"])), pa.ListArray.from_arrays(one, pa.array(at)), pa.ListArray.from_arrays(one, pa.array(at + 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "lo", "hi"])

    lone = found.where(F.col("lone").isNotNull()).select("key", "lone")
    return lone.repartition(partitions_of(found.sparkSession), "key").mapInArrow(run, "key long, content long, lo array<int>, hi array<int>")


def repeated_spans(texts: DataFrame, length: int, slice_size: int) -> DataFrame:
    """For the texts (k_id, k_text, text) that have some: k_text, k_size and the byte ranges that repeat, as spans.

    Copies of a text share a row: they have the same ranges, all of it. Tables that joins read are written first, so
    that Spark sees their sizes and can split a key that many rows share.
    """
    copies = texts.select("k_text", F.octet_length("text").cast("long").alias("size")).where(F.col("size") >= length)
    copies = copies.groupBy("k_text", "size").count().where("count > 1")
    low = F.col("size").bitwiseAND(F.lit((1 << (64 - N_BITS - FIRST_BITS)) - 1))
    whole = copies.select("k_text", low.alias("k_size"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))

    cut = stash(_cut(texts, length), TEXT_ROWS)
    twice = cut.groupBy("key").agg(F.count("*").alias("n_rows"), (F.min("content") == F.max("content")).alias("alike"))
    twice = stash(twice.where("n_rows > 1").select("key", "alike"))
    shared = stash(_unpacked(cut.join(twice, "key")))
    drop_stash(cut, twice)
    alike = shared.where("alike").select("k_text", "k_size", F.col("first").alias("lo"), (F.col("first") + F.col("n") + length - 1).alias("hi"))
    mixed = shared.where("NOT alike").select("k_id", "k_text", "k_size", "first", "n", "key", "content")
    distinct = stash(mixed.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("k_id", "k_text", "first", "n")).alias("at")))
    hot = stash(distinct.groupBy("key").count().where(F.col("count") > slice_size).select("key", F.ceil(F.col("count") / slice_size).cast("int").alias("slices")))
    dealt = distinct.join(hot, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.select("key", "content", "at.*", "slices", F.pmod(F.xxhash64("content"), F.col("slices")).cast("int").alias("slice"))
    found = stash(_sorted(_bytes_of(texts, dealt, length), length), TEXT_ROWS)
    runs = found.where(F.col("lone").isNull()).select("key", "content", "lo", "hi").unionByName(_across(found))
    runs = runs.select("key", "content", F.explode(F.arrays_zip("lo", "hi")).alias("r")).select("key", "content", "r.lo", "r.hi")
    # What equal fragments hold repeats as a whole.
    runs = stash(runs.unionByName(distinct.where("copies > 1").select("key", "content", F.lit(0).alias("lo"), F.col("at.n").cast("int").alias("hi"))))
    begin = F.col("first")
    parts = mixed.join(runs, ["key", "content"]).select("k_text", "k_size", (begin + F.col("lo")).alias("lo"), (begin + F.col("hi") + length - 1).alias("hi"))
    every = whole.unionByName(alike).unionByName(parts)
    out = stash(every.groupBy("k_text", "k_size").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    drop_stash(shared, distinct, hot, found, runs)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, keep_text: bool = False, slice_size: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for each row.

    Every byte that a string of ``length`` bytes covers which also starts elsewhere in the corpus is removed, the same
    text included; overlaps count. Null or empty text: no bytes. Repeated rows: their texts repeat, so those of
    ``length`` bytes or more are removed whole. Null ids are carried. Extra columns are ignored. An empty table gives
    an empty result. Texts are read whole. Strings are told apart by 64-bit hashes. ``slice_size`` distinct fragments
    of one key are sorted together at most; the result is the same for any.
    """
    if not GRAM < length <= sum(LADDER) or length - GRAM >= 1 << N_BITS:
        raise ValueError(f"length must be over {GRAM} and at most {sum(LADDER)}")
    rows = docs.select(F.col(id_col).cast("long").alias("k_id"), F.xxhash64(text_col).alias("k_text"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.where(F.col("text").isNotNull()), length, slice_size)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").bitwiseAND(F.lit((1 << (64 - N_BITS - FIRST_BITS)) - 1))
    sized = rows.withColumn("size", size)
    same = (sized["k_text"] == spans["k_text"]) & (sized["size"] == spans["k_size"])
    joined = sized.join(spans.hint("shuffle_hash"), same, "left").select("k_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                pieces, at, removed, n_spans, until = [], 0, 0, 0, -1
                for i, j in sorted((r["lo"], r["hi"]) for r in ranges or []):
                    if i > until:
                        n_spans += 1
                    if i > at:
                        pieces.append(text[at:i])
                    removed += max(0, j - max(i, at))
                    at = until = max(at, j)
                pieces.append(text[at:])
                kept = b"".join(pieces)
                out.append((len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            columns = list(zip(*out, strict=True)) if out else [[]] * (5 if keep_text else 4)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=False))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
