"""Exact n-gram Jaccard join with prefix trees.

All sets share one global order of n-grams: frequent ones first, the others by hash. A set is the sequence of its
n-grams in that order, and a prefix tree holds the sequences of a block, so sets that agree in frequent n-grams share
a path. Probes walk the tree together: what they share with a path is counted once for all sets below it, and a
subtree is left as soon as the overlap so far and the lengths that remain can't reach the threshold.

Which sets get into one block: two sets of Jaccard similarity t have their k rarest common n-grams among the rarest
|s| - ceil(t |s|) + k of each, for any k up to the overlap that their sizes need. So sets meet by those, a meeting
counts if the n-grams that both have beyond it in the order could make up the overlap, and a pair needs k meetings
(COMMON): the more text there is, the more sets share one rare n-gram by chance.

1. Each distinct set is told by a 64-bit hash of its n-grams; copies collapse to it.
2. Meetings of few sets give pairs, which are counted; those of many a star around one set. Their components are the
   blocks: every link lies inside one. Each block's texts move once, to the task that joins them by a tree.
3. A block over the bounds is cut into slices that each get a few leaders too. What slices can't tell, pairs and crowds
   whose sets are still apart, is then joined by trees of its own.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, chunks, drop_stash, lower_ascii, mix, partitions_of, shingles, stash

#: Frequent n-grams that the order knows; a matter of speed, never of results. They go to every task (16 bytes each).
MAX_FREQUENT = 1 << 20
#: n-grams that a task holds to count them.
COUNT_GRAMS = 1 << 21
#: One text of so many, by hash, is taken to find n-grams that make crowds, and how often it must show one, as a share
#: of a crowd. A task sees few of the sets that share such an n-gram, so it can't tell by its own.
SAMPLE, SHOWN = 4, 8
#: Entries of prefixes that a task holds to send them by buckets.
SEND_ENTRIES = 1 << 18
#: Sets that a task remembers so as not to send copies again.
SEEN_SETS = 200_000
#: Buckets of meetings for each partition; a task holds one at a time.
BUCKETS = 4
#: Rows of texts that go to Python at once.
TEXT_ROWS = 500
#: Common n-grams among the rarest that a pair must show, or all that it needs if those are fewer.
COMMON = 4
#: Bits of the filter that tells which texts may be wanted: this many for each, and at most in all. More wanted texts
#: than it has room for cost a move, never a result.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 27
#: n-grams of an edge that a walk takes between two looks at the bounds, and cells of a walk's table of probes.
STEP, CELLS = 256, 1 << 23
#: Stands for a null id inside, larger than any.
NO_ID = (1 << 63) - 1
RARE = np.uint64(1 << 63)


@dataclass(frozen=True)
class Bounds:
    """What one task does at most; results are the same under any bounds.

    crowd: sets that meet at one n-gram and get paired up. block, grams: sets and n-grams of one slice of a block.
    hot: seen occurrences of an n-gram for each of the parts that its meeting is dealt to.
    """

    crowd: int = 32
    block: int = 512
    grams: int = 1 << 20
    hot: int = 1 << 16


BOUNDS = Bounds()


def shingle_sets(chunk, n: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of each text of a chunk, as 63-bit hashes; fewer than n words make one."""
    buf = lower_ascii(chunk.buf)
    starts, ends, first = chunk.words(buf)
    words = SpanHash(buf)(starts, ends)
    grams, at = shingles(words, first, n)
    grams >>= np.uint64(1)
    begin = np.searchsorted(at, first)
    out = []
    for t in range(len(first) - 1):
        count = first[t + 1] - first[t]
        if count >= n:
            own = np.sort(grams[begin[t] : begin[t + 1]])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif count:
            h = np.uint64(count)
            for w in words[first[t] : first[t + 1]]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + w
            out.append(mix(np.array([h])) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(grams: np.ndarray) -> int:
    """Signed 64-bit hash of a set; 0 for the empty one."""
    if not len(grams):
        return 0
    h = np.array([mix(grams * np.uint64(2) + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(grams))])
    return int(mix(h).astype(np.int64)[0]) or 1


class Order:
    """The global order of n-grams: each has a key, small for frequent ones."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, hot: int) -> None:
        rank = np.empty(len(grams), np.uint64)
        rank[np.lexsort((grams, -counts))] = np.arange(len(grams), dtype=np.uint64)
        order = np.argsort(grams)
        self.grams, self.rank = grams[order], rank[order]
        self.parts = np.empty(len(grams), np.uint32)  # by rank
        self.parts[rank.astype(np.int64)] = 1 + counts // hot

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The keys of a set, in order."""
        if not len(self.grams):
            return grams | RARE
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[place] == grams
        return np.concatenate([np.sort(self.rank[place[known]]), grams[~known] | RARE])


class _Seen:
    """The last sets of a task."""

    def __init__(self) -> None:
        self.held: OrderedDict[int, None] = OrderedDict()

    def new(self, h: int) -> bool:
        if h in self.held:
            self.held.move_to_end(h)
            return False
        self.held[h] = None
        if len(self.held) > SEEN_SETS:
            self.held.popitem(last=False)
        return True


def _quiet(f):
    """numpy warns of wrap-around in scalars, which the hashes want."""

    def run(batches):
        with np.errstate(over="ignore"):
            yield from f(batches)

    return run


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows (kind 0: id, set, size) and n-grams that two of a task's next sets hold (kind 1: n-gram, count)."""

    @_quiet
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        fresh: list[np.ndarray] = []
        held = 0

        def count() -> Iterator[pa.RecordBatch]:
            grams = np.sort(np.concatenate(fresh))
            fresh.clear()
            edge = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            times = np.diff(np.append(edge, len(grams)))
            often = times >= 2
            grams, times = grams[edge[often]], times[often]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(grams), np.int32)), pa.array(np.zeros(len(grams), np.int64)), pa.array(grams.astype(np.int64)), pa.array(times)], names=["kind", "id", "set_id", "n"])

        for batch in batches:
            hashes, sizes = [], []
            for chunk in chunks(batch.column(1)):
                for grams in shingle_sets(chunk, n):
                    h = set_hash(grams)
                    hashes.append(h)
                    sizes.append(len(grams))
                    if h and seen.new(h):
                        fresh.append(grams)
                        held += len(grams)
                if held > COUNT_GRAMS:
                    yield from count()
                    held = 0
            rows = len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), batch.column(0), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())], names=["kind", "id", "set_id", "n"])
        if fresh:
            yield from count()

    return docs.mapInArrow(run, "kind int, id long, set_id long, n long")


def _sampled(docs: DataFrame, n: int, parts: int, crowd: int) -> DataFrame:
    """n-grams (set_id) that enough texts of a sample hold to make crowds, with their counts (n) carried to all texts.

    Copies in one task count once. Sets in one crowd by such an n-gram needn't be alike, and crowds chain to blocks that
    grow with the input; first in the order, it only leads to sets that hold little else.
    """
    buckets = parts * BUCKETS

    @_quiet
    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out, held = _Seen(), [], 0

        def sent() -> pa.RecordBatch:
            grams = np.concatenate(out)
            out.clear()
            bucket = (mix(grams) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            grams, bucket = grams[by], bucket[by]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            data = [grams[i:j].tobytes() for i, j in zip(edge, np.append(edge[1:], len(grams)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(data, pa.binary())], names=["bucket", "grams"])

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for grams in shingle_sets(chunk, n):
                    if len(grams) and seen.new(set_hash(grams)):
                        out.append(grams)
                        held += len(grams)
                if held > COUNT_GRAMS:
                    yield sent()
                    held = 0
        if held:
            yield sent()

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.sort(np.concatenate(held))
        held.clear()
        edge = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        times = np.diff(np.append(edge, len(grams)))
        often = times > max(1, crowd // SHOWN)
        return pa.RecordBatch.from_arrays([pa.array(grams[edge[often]].astype(np.int64)), pa.array(times[often] * SAMPLE)], names=["set_id", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != last and held:
                    yield count(held)
                last = bucket
                held.append(np.frombuffer(data.as_py(), np.uint64))
        if held:
            yield count(held)

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    sent = texts.mapInArrow(grams_of, "bucket int, grams binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, "set_id long, n long")


ENTRY = np.dtype([("key", "<u8"), ("set", "<i8"), ("n", "<u4"), ("rest", "<u4"), ("parts", "<u4")])


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that two sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def meeting_pairs(entries: np.ndarray, percent: int, crowd: int, common: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of entries that meet and can reach the overlap; entries are sorted by key and size.

    common: a meeting counts if it may be among this many last ones, in the order, of a pair.
    """
    key, n, rest = entries["key"], entries["n"].astype(np.int64), entries["rest"].astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, crowd):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        j = i + step
        fits = (n[i] * 100 >= percent * n[j]) & (common + np.minimum(rest[i], rest[j]) >= _needed(n[i], n[j], percent))
        left.append(i[fits])
        right.append(j[fits])
    return np.concatenate(left), np.concatenate(right)


def may_meet(n: np.ndarray, rest: np.ndarray, percent: int, common: int = 1) -> np.ndarray:
    """Which sets of one meeting, sorted by size, have another whose size lets them reach the overlap; never too few."""
    most = (100 + percent) * (rest + common) // percent - n  # of a partner's size
    at = np.searchsorted(n, -(-percent * n // 100))
    at = np.where(at == np.arange(len(n)), at + 1, at)
    return (at < len(n)) & (n[np.minimum(at, len(n) - 1)] <= most)


def _meetings(docs: DataFrame, order, n: int, percent: int, parts: int, crowd: int) -> DataFrame:
    """Pairs (a, b) of sets that meet among few (gid null), and sets a of crowds; equal crowds share a gid.

    A pair comes with the number of its meetings and the number that it needs, unless both are in one crowd.
    """
    buckets = parts * BUCKETS
    names = ["gid", "a", "b", "times", "least"]

    @_quiet
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = _Seen(), order.value
        out: list[np.ndarray] = []
        held = 0

        def sent() -> pa.RecordBatch:
            entries = np.concatenate(out)
            out.clear()
            often = np.flatnonzero(entries["key"] < RARE)
            entries["parts"][often] = known.parts[entries["key"][often].astype(np.int64)]
            part = mix(entries["set"].astype(np.uint64)) % entries["parts"]
            bucket = (mix(entries["key"] + part * np.uint64(0x9FB21C651E98DF25)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            entries, bucket = entries[by], bucket[by]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            data = [entries[i:j].tobytes() for i, j in zip(edge, np.append(edge[1:], len(entries)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(data, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for chunk in chunks(batch.column(1)):
                for grams in shingle_sets(chunk, n):
                    h = set_hash(grams)
                    if not h or not seen.new(h):
                        continue
                    keep = min(len(grams), len(grams) - -(-percent * len(grams) // 100) + COMMON)
                    keys = known.keys(grams)[-keep:]
                    entry = np.empty(keep, ENTRY)
                    entry["key"], entry["set"], entry["n"], entry["rest"], entry["parts"] = keys, h, len(grams), np.arange(len(grams) - keep, len(grams)), 1
                    out.append(entry)
                    held += keep
                if held > SEND_ENTRIES:
                    yield sent()
                    held = 0
        if out:
            yield sent()

    def of_bucket(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate(held)
        held.clear()
        entries = entries[np.lexsort((entries["set"], entries["n"], entries["key"]))]
        again = np.zeros(len(entries), bool)
        again[1:] = (entries["key"][1:] == entries["key"][:-1]) & (entries["set"][1:] == entries["set"][:-1])
        entries = entries[~again]
        edge = np.flatnonzero(np.append(True, entries["key"][1:] != entries["key"][:-1]))
        size = np.diff(np.append(edge, len(entries)))
        few = np.repeat((size > 1) & (size <= crowd) & (entries["parts"][edge] == 1), size)
        crowds = np.flatnonzero((size > crowd) | (entries["parts"][edge] > 1))
        rest = [entries[few]]
        gids, members, told = [], [], set()
        for k in crowds:
            own = entries[edge[k] : edge[k] + size[k]]
            if own["parts"][0] == 1:
                for _ in range(3):
                    own = own[may_meet(own["n"].astype(np.int64), own["rest"].astype(np.int64), percent, COMMON)]
                if len(own) <= crowd:
                    rest.append(own)
                    continue
                gid = int(mix(np.array([mix(own["set"].astype(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(own))]))[0])
                if gid in told:
                    continue
                told.add(gid)
            else:
                gid = int(mix(own["key"][:1])[0])
            gids.append(np.full(len(own), gid, np.uint64))
            members.append(own["set"])
        small = np.concatenate(rest)
        i, j = meeting_pairs(small, percent, crowd, COMMON)
        a, b = small["set"][i], small["set"][j]
        if len(a):
            least = np.minimum(_needed(small["n"][i].astype(np.int64), small["n"][j].astype(np.int64), percent), COMMON)
            a, b = np.minimum(a, b), np.maximum(a, b)
            by = np.lexsort((b, a))
            a, b, least = a[by], b[by], least[by]
            at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            times = np.minimum(np.diff(np.append(at, len(a))), COMMON)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(a[at]), pa.array(b[at]), pa.array(times.astype(np.int32)), pa.array(least[at].astype(np.int32))], names=names)
        for gid, sets in zip(gids, members, strict=True):
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(gid.astype(np.int64)), pa.array(np.ascontiguousarray(sets)), pa.nulls(len(sets), pa.int64()), none, none], names=names)

    @_quiet
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != last and held:
                    yield from of_bucket(held)
                last = bucket
                held.append(np.frombuffer(data.as_py(), ENTRY))
        if held:
            yield from of_bucket(held)

    sent = docs.mapInArrow(prefixes, "bucket int, entries binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "gid long, a long, b long, times int, least int")


class PrefixTree:
    """Sets in the global order as a tree, laid flat: sorted as sequences, with the length each shares with the last.

    A node is a range of the sorted sets and the depth to which they agree.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = np.array(sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes()), np.int64)
        ordered = [sets[k] for k in self.order]
        self.size = np.array([len(x) for x in ordered], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words, self.ids = np.unique(np.concatenate(ordered), return_inverse=True)
        self.shared = np.zeros(len(sets), np.int64)
        for k in range(1, len(ordered)):
            m = min(len(ordered[k - 1]), len(ordered[k]))
            differ = ordered[k - 1][:m] != ordered[k][:m]
            self.shared[k] = differ.argmax() if differ.any() else m

    def links(self, probes: list[np.ndarray], percent: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) with a Jaccard similarity of percent or more, as indexes of the lists given.

        own: the probes are the tree's sets; each pair is told once.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at_once = max(1, CELLS // max(1, len(self.words)))
        which = self.order if own else np.arange(len(probes))
        for i in range(0, len(which), at_once):
            part = which[i : i + at_once]
            for p, k in self._walk([probes[x] for x in part], percent, i if own else None):
                found.append((part[p], np.full(len(p), self.order[k])))
        a, b = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b)

    def _walk(self, probes: list[np.ndarray], percent: int, first: int | None) -> Iterator[tuple[np.ndarray, int]]:
        """All probes go down together. first: the place of the first probe among the sorted sets, if they are sets."""
        n = np.array([len(p) for p in probes], np.int64)
        every, owner = np.concatenate(probes), np.repeat(np.arange(len(probes)), n)
        place = np.minimum(np.searchsorted(self.words, every), len(self.words) - 1)
        hit = self.words[place] == every
        holds = np.zeros((len(self.words), len(probes)), bool)
        holds[place[hit], owner[hit]] = True
        known = np.bincount(owner[hit], minlength=len(probes))
        stack = [(0, len(self.size), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            lo, hi, depth, active, overlap = stack.pop()
            if first is not None:  # a pair is told at its later set
                early = active + first < hi - 1
                active, overlap = active[early], overlap[early]
                if not len(active):
                    continue
            end = self.size[lo] if hi - lo == 1 else self.shared[lo + 1 : hi].min()
            stop = min(end, depth + STEP)
            edge = self.ids[self.begin[lo] + depth : self.begin[lo] + stop]
            overlap = overlap + holds[edge][:, active].sum(axis=0)
            # What the shortest set below needs, and what the longest can still give.
            sizes = self.size[lo:hi]
            reach = overlap + np.minimum(sizes.max() - stop, known[active] - overlap)
            alive = reach >= _needed(n[active], sizes.min(), percent)
            active, overlap = active[alive], overlap[alive]
            if not len(active):
                continue
            if stop < end:
                stack.append((lo, hi, stop, active, overlap))
            elif hi - lo == 1:
                if first is not None:
                    active = active[active + first < lo]
                if len(active):
                    yield active, lo
            else:
                cut = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == end)), hi]
                stack.extend((i, j, end, active, overlap) for i, j in zip(cut, cut[1:], strict=False))


def joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each one's component, for links (a, b) among n."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tree_links(placed: DataFrame, order, n: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join what is joined in each slice. placed: block, slice, role, set_id, text.

    Sets of role 0 make the slice's tree; those of role 1 and, in slices from 0 on, the tree's own sets probe it. Slice
    0 is a whole block, so its links name the smallest set of the component (``whole``).
    """

    @_quiet
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        tree: PrefixTree | None = None
        label = np.zeros(0, np.int64)
        names: list[int] = []
        sets: list[np.ndarray] = []
        probes: list[np.ndarray] = []

        def add(links: tuple[np.ndarray, np.ndarray]) -> None:
            nonlocal label
            label = np.concatenate([label, np.arange(len(label), len(names))])
            label = joined(len(names), *links, label)

        def ask() -> None:
            nonlocal tree
            if not sets:
                return
            if tree is None:
                tree = PrefixTree(sets)
                if group[1] >= 0 and len(sets) > 1:
                    add(tree.links(sets, percent, own=True))
            if probes:
                p, k = tree.links(probes, percent)
                add((p + len(names) - len(probes), k))
                probes.clear()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal tree, label
            ask()
            own = np.flatnonzero(label != np.arange(len(label)))
            if len(own):
                ids = np.array(names, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]]), pa.array(np.full(len(own), group[1] == 0))], names=["a", "b", "whole"])
            names.clear()
            sets.clear()
            probes.clear()
            tree, label = None, np.zeros(0, np.int64)

        for batch in batches:
            blocks, parts, roles, ids = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            for chunk in chunks(batch.column(4)):
                for grams in shingle_sets(chunk, n):
                    if (blocks[at], parts[at]) != group:
                        if group is not None:
                            yield from close()
                        group = blocks[at], parts[at]
                    if not names or names[-1] != ids[at]:  # else a row that repeats
                        if roles[at] and len(probes) >= block:
                            ask()
                        names.append(ids[at])
                        (probes if roles[at] else sets).append(order.value.keys(grams))
                    at += 1
        if group is not None:
            yield from close()

    spark = placed.sparkSession
    ordered = placed.select("block", "slice", "role", "set_id", "text").repartition(partitions_of(spark), "block", "slice")
    return ordered.sortWithinPartitions("block", "slice", "role", "set_id").mapInArrow(run, "a long, b long, whole boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the component's smallest node.

    Each round, every node goes to the smallest neighbour of its smallest neighbour, and edges between the nodes that
    remain make the next, smaller graph. The rounds' tables are put together from the last to the first.
    """
    edges, tables = stash(edges.where("a <> b").distinct()), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("near")))
        far = low.select(F.col("a").alias("near"), F.col("near").alias("root"))
        table = stash(low.join(far, "near").select(F.col("a").alias("node"), "root"))
        to = lambda name: table.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        left = edges.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root")
        left = stash(left.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        tables.append(table)
        drop_stash(edges, low)
        edges = left
        if not left.limit(1).count():
            break
    drop_stash(edges)
    out = tables.pop()
    while tables:
        last = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        table = tables.pop()
        longer = stash(table.join(last, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        drop_stash(out, table)
        out = longer
    return out


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and counts of all that have a count so high that at most MAX_FREQUENT have it, and 2 or more."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    levels = sorted((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect())  # under 1100
    total, least = 0, None
    while levels and total + levels[-1][1] <= MAX_FREQUENT and levels[-1][0] >= 2:
        least, more = levels.pop()
        total += more
    top = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toArrow()  # bounded by MAX_FREQUENT
    return top.column("set_id").to_numpy().astype(np.uint64), top.column("n").to_numpy()


def _maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids, and few others. ids: one column."""
    spark = docs.sparkSession
    bits = min(MAX_FILTER_BITS, 1 << (FILTER_BITS * ids.count() + 63).bit_length())

    def places(column: pa.Array) -> np.ndarray:
        return mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)

    @_quiet
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0))
            word, bit = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bit"])

    found = ids.mapInArrow(put, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # bounded
    words = np.zeros(bits >> 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(words)

    @_quiet
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0))
            there = held.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            if there.any():
                yield batch.filter(pa.array(there.astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def _texts(placed: DataFrame, docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The rows of placed (set_id, ...) with a text for each set. Rows of one id may hold different texts.

    A filter by id drops most of the other texts before any move.
    """
    holder = rows.join(placed.select("set_id"), "set_id").groupBy("set_id").agg(F.min("doc_id").alias("holder"))
    wanted = stash(placed.join(holder, "set_id"))
    columns = [*placed.columns, "text"]
    docs = _maybe(docs, wanted.select("holder"))
    near = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"] == wanted["holder"]).select(*columns)

    @_quiet
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(0).to_pylist()
            keep, at = [], 0
            for chunk in chunks(batch.column(len(columns) - 1)):
                for grams in shingle_sets(chunk, n):
                    keep.append(set_hash(grams) == sets[at])
                    at += 1
            yield batch.filter(pa.array(keep, pa.bool_()))

    out = stash(near.mapInArrow(run, near.schema), TEXT_ROWS)
    drop_stash(wanted)
    return out


def _apart(pairs: DataFrame, crowds: DataFrame, big: DataFrame, roots: DataFrame) -> DataFrame:
    """What slices could not tell, as blocks for trees: pairs, and crowds, of sets that are still in two components.
    big: the sets of cut blocks.

    A pair's first set probes trees of its partners. Of a crowd's cluster, sets outside the largest component probe
    trees of all its sets.
    """
    root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    left = pairs.join(big.select(F.col("set_id").alias("a")), "a", "left_semi")
    left = left.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    left = left.select("a", "b", (F.lit(-1) - F.pmod(F.xxhash64("b"), F.lit(1 << 30)) % 16).cast("int").alias("slice"))
    probes = left.select(F.col("a").alias("block"), "slice", F.lit(1).alias("role"), F.col("a").alias("set_id")).distinct()
    members = left.select(F.col("a").alias("block"), "slice", F.lit(0).alias("role"), F.col("b").alias("set_id"))
    out = probes.unionByName(members)

    sets = crowds.select(F.col("a").alias("set_id")).distinct().join(big.select("set_id", "block", "slices"), "set_id")
    sets = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    count = sets.groupBy("block", "root").agg(F.count("*").alias("members"), F.max("slices").alias("slices"))
    main = count.groupBy("block").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("apart")).where("apart > 1")
    sets = sets.join(main, "block")
    placed = sets.select("block", (F.lit(-100) - F.pmod(F.xxhash64("set_id"), F.col("slices"))).cast("int").alias("slice"), F.lit(0).alias("role"), "set_id")
    asked = sets.where("root <> main").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("k"), "set_id")
    out = out.unionByName(placed).unionByName(asked.select("block", (F.lit(-100) - F.col("k")).cast("int").alias("slice"), F.lit(1).alias("role"), "set_id"))
    return out.join(big.select("set_id", "text"), "set_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 75, bounds: Bounds = BOUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest id reachable by links of ``percent`` or more.

    Words are lower-cased in A-Z. Fewer than n words make one n-gram; null or empty texts and texts without words make
    an empty set, linked with nothing. Equal sets are always linked, so repeated rows share a component. A null id is
    carried and never names a component unless all of the component's ids are null. Extra columns are ignored. An
    empty table gives an empty result. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    parts = partitions_of(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    scan = stash(_scan(docs, n), TEXT_ROWS)
    rows = scan.where("kind = 0").select(F.col("id").alias("doc_id"), "set_id", "n")
    often = stash(_sampled(docs, n, parts, bounds.crowd), TEXT_ROWS)
    counts = scan.where("kind = 1").groupBy("set_id").agg(F.sum("n").alias("n")).unionByName(often)
    counts = stash(counts.groupBy("set_id").agg(F.max("n").alias("n")))
    drop_stash(often)
    order = spark.sparkContext.broadcast(Order(*_frequent(counts), bounds.hot))
    drop_stash(counts)

    met = stash(_meetings(docs, order, n, percent, parts, bounds.crowd), TEXT_ROWS)
    pairs = met.where("gid IS NULL").groupBy("a", "b").agg(F.sum("times").alias("times"), F.first("least").alias("least"))
    pairs = stash(pairs.where("times >= least").select("a", "b"))
    crowds = met.where("gid IS NOT NULL").select("gid", "a").distinct()
    star = crowds.groupBy("gid").agg(F.min("a").alias("b"))
    near = components(pairs.unionByName(crowds.join(star, "gid").where("a <> b").select("a", "b")))

    # Blocks, slices and leaders: the sets that are in most crowds, and some by hash.
    sizes = rows.join(near.select(F.col("node").alias("set_id")), "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"))
    placed = near.select(F.col("node").alias("set_id"), F.col("root").alias("block")).join(sizes, "set_id")
    slices = placed.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / bounds.block), F.ceil(F.sum("n") / bounds.grams)).cast("int").alias("slices"))
    texts = _texts(placed.join(slices, "block").select("set_id", "block", "slices"), docs, rows, n)
    part = F.when(F.col("slices") == 1, 0).otherwise(1 + F.pmod(F.xxhash64("set_id"), F.col("slices"))).cast("int").alias("slice")
    member = texts.select("block", part, F.lit(0).alias("role"), "set_id", "text")
    big = texts.where("slices > 1")
    degree = crowds.groupBy(F.col("a").alias("set_id")).count()
    ranked = big.select("set_id", "block", "slices").join(degree, "set_id", "left")
    leads = F.array_distinct(F.array(*[F.max_by("set_id", F.struct(F.coalesce("count", F.lit(0)), F.xxhash64("set_id"))), *[F.min_by("set_id", F.xxhash64("set_id", F.lit(k))) for k in range(3)]]))
    leaders = ranked.groupBy("block").agg(leads.alias("leads"), F.max("slices").alias("slices"))
    leaders = leaders.select("block", "slices", F.explode("leads").alias("set_id"))
    leaders = leaders.select("block", "set_id", part.alias("own"), F.explode(F.sequence(F.lit(1), F.col("slices"))).alias("slice"))
    leaders = leaders.where("slice <> own").join(big.select("set_id", "text"), "set_id")
    found = stash(_tree_links(member.unionByName(leaders.select("block", "slice", F.lit(1).alias("role"), "set_id", "text")), order, n, percent, bounds.block), TEXT_ROWS)
    roots = found.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if big.limit(1).count():
        links = found.where("NOT whole").select("a", "b")
        cut = components(links)
        more = stash(_tree_links(_apart(pairs, crowds, big, cut), order, n, percent, bounds.block), TEXT_ROWS)
        if more.limit(1).count():
            drop_stash(cut)
            cut = components(links.unionByName(more.select("a", "b")))
        drop_stash(more)
        roots = roots.unionByName(cut)
    drop_stash(met, pairs, near, texts)
    order.destroy()  # every table that needs it is written

    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("low")).where("set_id <> 0")
    sets = sets.join(roots, sets["set_id"] == roots["node"], "left").select("set_id", "low", F.coalesce("root", "set_id").alias("root"))
    lowest = sets.groupBy("root").agg(F.min("low").alias("component_id"))
    named = sets.join(lowest, "root").select("set_id", "component_id")
    out = rows.join(named, "set_id", "left")
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component: the one with the smallest id, null ids last; ties go by the hash of id and text.

    Rows are told by id and text, so a link of one text removes no other text of the same id. Of rows that repeat, in
    id and text, one stays, whatever their other columns hold. Null or empty texts and texts without words are linked
    with nothing and all stay. Null ids and extra columns are carried. An empty table stays empty. Texts are read whole.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("__key")
    keyed = docs.select("*", key)
    found = jaccard_components(keyed, "__key", text_col, n=n, percent=percent).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("__key")).agg(F.first("component_id").alias("component"), F.count("*").alias("times"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"), key).groupBy("__key").agg(F.min("id").alias("id"))
    found = stash(found.join(ids, "__key"))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "__key")).alias("best"))
    marked = stash(found.join(best, "component").select("__key", (F.col("best.__key") == F.col("__key")).alias("kept"), "times").where("NOT kept OR times > 1"))
    drop_stash(found)
    out = keyed.join(marked.select("__key"), "__key", "left_anti").select(docs.columns)
    again = marked.where("kept").select("__key")
    if again.limit(1).count():  # rows that repeat
        out = out.unionByName(keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns))
    return out
