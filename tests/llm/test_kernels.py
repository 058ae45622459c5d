"""Kernels against plain definitions, and the pipeline as a whole."""

import random
import re

import numpy as np
import pytest

from voxelspark.llm.common import SpanHash
from voxelspark.llm.decontaminate import align, contaminated, may_reach
from voxelspark.llm.ngram_join import ENTRY, PrefixTree, joined, may_meet, meeting_pairs
from voxelspark.llm.packing import cuts
from voxelspark.llm.repetition import maximal_repeats, suffix_array
from voxelspark.llm.suffix_dedup import FINE, LADDER, common_prefixes, repeated_windows, two_stage_suffix_array
from voxelspark.llm.toxicity import label_model


def test_suffix_array_of_words():
    rng = np.random.default_rng(0)
    ids = np.append(rng.integers(0, 3, 200), 99)
    sa, lcp = suffix_array(ids)
    seq = ids.tolist()
    assert sa.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])
    for k in range(1, len(sa)):
        a, b = seq[sa[k - 1] :], seq[sa[k] :]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_maximal_repeats():
    """Substrings that occur twice and can't be made longer on either side."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        words = rng.integers(0, 3, rng.integers(2, 40)).tolist()
        ids = np.array([*words, 99])
        place, length = maximal_repeats(ids, *suffix_array(ids), 2)
        want = set()
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                at = [k for k in range(len(words)) if words[k : k + j - i] == words[i:j]]
                around = [{words[k - 1] if k else -1 for k in at}, {[*words, 99][k + j - i] for k in at}]
                if len(at) > 1 and all(len(x) > 1 for x in around):
                    want.add(tuple(words[i:j]))
        assert sorted(tuple(ids[p : p + n].tolist()) for p, n in zip(place, length, strict=True)) == sorted(want)


@pytest.mark.parametrize("letters", [b"ab", b"a", b"abcdefgh"])
def test_two_stage_suffix_array(letters):
    rng = random.Random(1)
    raw = np.array([rng.choice(letters) for _ in range(300)] + [0], np.uint8)
    t = raw.astype(np.uint16) + 1
    t[-1] = 0
    seen = raw.copy()
    seen[-1] = 255
    sa = two_stage_suffix_array(t, SpanHash(seen), 400)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_common_prefixes():
    rng = random.Random(8)
    base = bytes(rng.choice(b"ab") for _ in range(700))
    parts = [base[:500], base[20:520], base[:450], b"a" * 430]
    raw = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    end = np.cumsum([len(x) + 1 for x in parts]) - 1
    room = np.repeat(end, [len(x) + 1 for x in parts]) - np.arange(len(raw))
    text = raw.tobytes()
    sa = np.array(sorted(range(len(raw)), key=lambda i: text[i:]))
    got = common_prefixes(sa, SpanHash(raw), room)
    for k, (i, j) in enumerate(zip(sa.tolist(), sa[1:].tolist(), strict=False)):
        m = min(int(room[i]), int(room[j]), sum(LADDER) + sum(FINE))
        assert got[k] == next((x for x in range(m) if text[i + x] != text[j + x]), m)


def test_repeated_windows():
    rng = random.Random(2)
    base = bytes(rng.choice(b"abc") for _ in range(900))
    fragments = [base[:500], base[100:700], bytes(rng.choice(b"xyz") for _ in range(450)), b"q" * 600]
    flags, _ = repeated_windows(fragments, 400)
    seen: dict = {}
    for f in fragments:
        for i in range(len(f) - 399):
            seen[f[i : i + 400]] = seen.get(f[i : i + 400], 0) + 1
    for f, flag in zip(fragments, flags, strict=True):
        assert flag.tolist() == [seen[f[i : i + 400]] > 1 for i in range(len(f) - 399)]


def test_alignment():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(3)
    pairs = [(rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64)) for _ in range(50)]
    got = align([a for a, _ in pairs], [b for _, b in pairs])
    assert [s for s, _ in got] == [plain(a, b) for a, b in pairs]


def plain_score(a, b):
    """Smith-Waterman score of two word lists, cell by cell."""
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, row[j] - 1))
        last, best = row, max(best, *row)
    return best


def edited(words, every, how):
    """A copy with every so many-th word replaced, dropped or followed by another."""
    out = []
    for k, w in enumerate(words, 1):
        hit = k % every == 0
        out += [] if hit and how == "drop" else [f"other{k}"] if hit and how == "replace" else [w, f"added{k}"] if hit else [w]
    return out


@pytest.mark.parametrize("alone", [True, False])
def test_edited_copies_against_all_alignments(spark, alone):
    """One edited copy of an item is found even where the n-grams it lost occur nowhere and those it kept are common."""
    rng = random.Random(6)
    items = {k: [f"w{rng.randrange(60)}" for _ in range(rng.choice([12, 40, 64]))] for k in range(9)}
    docs = {}
    for k, words in items.items():
        way, every = ("replace", "drop", "add")[k % 3], (8, 6, 5)[k // 3]
        docs[k] = [f"pre{j}" for j in range(30)] + edited(words, every, way) + [f"post{j}" for j in range(30)]
    if not alone:
        for k in range(9, 60):
            at = rng.randrange(len(items[k % 9]) - 6)
            docs[k] = [f"w{rng.randrange(60)}" for _ in range(150)] + items[k % 9][at : at + rng.randint(4, 6)] + [f"z{rng.randrange(9)}" for _ in range(20)]
    want = {}
    for d, text in docs.items():
        for i, words in items.items():
            score = plain_score(words, text)
            if score / (2 * len(words)) >= 0.6:
                want[d, i] = score
    assert all((k, k) in want for k in items)
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{name} long, text string")
    out = contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in out} == want


def test_bound_never_drops_an_alignment():
    rng = np.random.default_rng(7)
    reached = 0
    for _ in range(400):
        item = rng.integers(0, 30, rng.integers(1, 20)).astype(np.uint64)
        copy = item[rng.random(len(item)) > 0.15]
        window = np.concatenate([rng.integers(0, 40, rng.integers(0, 30)), copy, rng.integers(0, 40, rng.integers(1, 30))]).astype(np.uint64)
        if plain_score(item.tolist(), window.tolist()) >= 0.6 * 2 * len(item):
            reached += 1
            assert may_reach(np.unique(item), len(item), window, 0.6)
    assert reached > 100


def some_sets(rng, n):
    base = np.unique(rng.integers(0, 400, 100).astype(np.uint64))
    out = []
    for _ in range(n):
        own = base[rng.random(len(base)) < rng.uniform(0.6, 1)]
        out.append(np.unique(np.concatenate([own, rng.integers(0, 400, rng.integers(0, 30)).astype(np.uint64)])))
    return out + [np.arange(5, dtype=np.uint64), np.arange(6, dtype=np.uint64)]


def similar(a, b):
    return 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))


@pytest.mark.parametrize("cells", [1, 1 << 25])
def test_tree_links(monkeypatch, cells):
    """Probes and the tree's own sets, all at once and one at a time."""
    monkeypatch.setattr("voxelspark.llm.ngram_join.CELLS", cells)
    monkeypatch.setattr("voxelspark.llm.ngram_join.STEP", 7)
    rng = np.random.default_rng(4)
    sets, probes = some_sets(rng, 60), some_sets(rng, 20)
    tree = PrefixTree(sets)
    got = sorted(zip(*(x.tolist() for x in tree.links(probes, 75)), strict=True))
    assert got == [(p, k) for p, a in enumerate(probes) for k, b in enumerate(sets) if similar(a, b)] and got
    own = sorted(tuple(sorted(x)) for x in zip(*(x.tolist() for x in tree.links(sets, 75, own=True)), strict=True))
    assert own == [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and similar(a, b)] and own


def test_tree_leaves_subtrees():
    """Sets below a path that the probe can't follow are never looked at."""
    rng = np.random.default_rng(5)
    far = [np.unique(np.concatenate([np.arange(100), rng.integers(1000, 9000, 20)])).astype(np.uint64) for _ in range(200)]
    near = [np.append(np.arange(200, 320), k).astype(np.uint64) for k in range(400, 410)]
    tree = PrefixTree(far + near)
    seen = []
    plain = tree.ids
    tree.ids = type("Counted", (), {"__getitem__": lambda self, x: seen.append(x.stop - x.start) or plain[x]})()
    p, k = tree.links([np.arange(200, 321).astype(np.uint64)], 75)
    assert sorted(k.tolist()) == list(range(200, 210)) and sum(seen) < 400


def test_joined():
    assert joined(6, np.array([4, 5, 1]), np.array([3, 4, 2])).tolist() == [0, 1, 1, 3, 3, 3]


def test_meetings_lose_no_pair():
    """Every similar pair passes at the first common n-gram of the prefixes, and stays in a crowd."""
    rng = np.random.default_rng(6)
    sets = some_sets(rng, 25)
    rows = []
    for k, x in enumerate(sets):
        keep = len(x) - -(-75 * len(x) // 100) + 1
        rows += [(x[i], k, len(x), i, 1) for i in range(len(x) - keep, len(x))]
    entries = np.array(rows, ENTRY)
    entries = entries[np.lexsort((entries["set"], entries["n"], entries["key"]))]
    i, j = meeting_pairs(entries, 75, 60)
    got = {tuple(sorted(x)) for x in zip(entries["set"][i].tolist(), entries["set"][j].tolist(), strict=True)}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and similar(a, b)}
    assert want <= got
    for key in np.unique(entries["key"]):
        own = entries[entries["key"] == key]
        stay = set(own["set"][may_meet(own["n"].astype(int), own["rest"].astype(int), 75)].tolist())
        i, j = meeting_pairs(own, 75, 60)
        assert {*own["set"][i].tolist(), *own["set"][j].tolist()} <= stay


def test_cuts_fill_their_class():
    for length in range(1, 6000, 7):
        pieces = cuts(length, 2048)
        assert sum(pieces) == length
        for p in pieces:
            j = 2048 // p
            assert 2048 - j * p <= max(41, 32)


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.2
    votes = []
    for accuracy, coverage in ((0.95, 0.6), (0.9, 0.5), (0.55, 0.5), (0.92, 1.0)):
        right = rng.random(3000) < accuracy
        votes.append(np.where(rng.random(3000) < coverage, np.where(right == truth, 1, -1), 0))
    posterior, table, corr, share = label_model(np.stack([*votes[:3], votes[0], votes[3]], axis=1).astype(float), 0.2)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert table[0, 1, 2] > table[2, 1, 2] and corr[0, 3] > 0.9 and share[0] < share[1]


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < out.count() <= before
        before, docs = out.count(), out
    pieces = C.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == before


def test_pipeline_stages_by_brute_force(spark):
    """Line dedup, near duplicates and decontamination on all documents of the smallest table, and planted cases."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").select(*C.COLUMNS)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    base = [tuple(r) for r in table.collect()]
    alone = " ".join(w if k % 8 else f"changed{k}" for k, w in enumerate(max(items.values(), key=len).split()))
    once = " ".join(f"word{k}" for k in range(60))
    line = "a line that stands on very many sites"
    texts = [alone, once, once + " end", *[f"{line}\nonly here {k} and {k * 7}" for k in range(12)]]
    docs = base + [(10**9 + k, t, "en", f"site{k}", len(t)) for k, t in enumerate(texts)]
    frame = lambda rows: spark.createDataFrame(rows, table.schema)
    stages = dict(C.STAGES)

    sites: dict = {}
    for _, t, _, source, _ in docs:
        for x in (t or "").split("\n"):
            if len(x.strip(" ")) >= 16:
                sites.setdefault(x, set()).add(source)
    wide = {x for x, on in sites.items() if len(on - {None}) >= 10}
    clean = {d: "\n".join(x for x in (t or "").split("\n") if x not in wide) for d, t, *_ in docs}
    got = {r.doc_id: r.text or "" for r in stages["line_dedup"](spark, frame(docs), sf).collect()}
    assert got == clean and line in wide

    grams = {}
    for d, t, *_ in docs:
        w = (t or "").encode().lower().split()
        grams[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {d: d for d in grams}

    def top(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(grams)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if grams[a] and 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b]):
                x, y = sorted((top(a), top(b)))
                low[y] = x
    got = sorted(r.doc_id for r in stages["near_duplicates"](spark, frame(docs), sf).collect())
    assert got == [d for d in ids if top(d) == d] and 10**9 + 2 not in got

    number: dict = {}
    small = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}
    words = lambda t: np.array([number.setdefault(w, len(number) + 2) for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").translate(small))], np.uint64)
    asked = [w for w in map(words, items.values()) if len(w)]
    bad = set()
    for d, t, *_ in docs:
        w = words(t)
        if len(w) and any(score >= 0.6 * 2 * len(i) for i, (score, _) in zip(asked, align(asked, [w] * len(asked)), strict=True)):
            bad.add(d)
    got = sorted(r.doc_id for r in stages["decontamination"](spark, frame(docs), sf).collect())
    assert got == [d for d in ids if d not in bad] and 10**9 in bad
