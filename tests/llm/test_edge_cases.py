"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from voxelspark.llm import queries as Q
from voxelspark.llm.bpe_count import token_counts
from voxelspark.llm.decontaminate import contaminated, remove_contaminated
from voxelspark.llm.line_spread import dedup_lines
from voxelspark.llm.ngram_join import BOUNDS, Bounds, jaccard_components, keep_one
from voxelspark.llm.packing import pack
from voxelspark.llm.pii import find_pii, pii_digest
from voxelspark.llm.repetition import repetition_rules
from voxelspark.llm.sharding import assign_shards, lookup_table
from voxelspark.llm.suffix_dedup import remove_repeats
from voxelspark.llm.toxicity import drop_toxic, score_toxicity

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
COPY = " ".join(f"copied{i}" for i in range(120))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, LONG),
    (5, COPY),
    (6, COPY),
    (6, COPY),
    (7, COPY.replace("copied7 ", "changed ")),
    (None, "no id here but some words"),
    (None, COPY),
    (8, "one two three"),
    (9, "One  two\nthree"),
    (10, "call +1 (555) 010-1234, a.b@c.de, 10.0.0.255 or 4111 1111 1111 1111"),
]
SCHEMA = "doc_id long, text string, k_id string, n_lines int, slot string, source string, score string, h int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", f"site{k % 3}", "z", 1) for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return df.collect()


def test_repetition(docs, empty):
    out = rows(repetition_rules(docs))
    assert len(out) == len(TEXTS)
    for r in out:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, True, False)
        if r.doc_id == 4:
            words = LONG.split()
            windows: dict = {}
            for i in range(len(words) - 4):
                windows.setdefault(tuple(words[i : i + 5]), []).append(i)
            covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
            assert r.n_words == 30_000 and r.n_repeat_words == len(covered)
        if r.doc_id == 5:
            assert r.kept
    assert not rows(repetition_rules(empty))


def test_repetition_verdict(spark):
    """Long repeats are rejected where they cover less than the base rule bears, and where they are few but long."""
    word = iter(f"w{i}" for i in range(10**6))
    own = lambda n: " ".join(next(word) for _ in range(n))
    passage, long = own(25), own(60)
    texts = [own(300), f"{passage} {own(250)} {passage}", f"{long} {own(2500)} {long}", f"{own(6)} {own(300)}", " ".join([own(150), passage[:60], own(100), passage[:60]])]
    out = {r.doc_id: r for r in rows(repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [(out[i].base_failed, out[i].kept) for i in range(5)] == [(False, True), (False, False), (False, False), (False, True), (False, True)]
    assert [(out[i].longest_repeat, out[i].n_maximal_repeats) for i in range(3)] == [(0, 0), (25, 1), (60, 1)]


def test_token_counts(docs, empty):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows(token_counts(docs, path)))
    want = sorted((len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for _, t in TEXTS)
    assert got == want
    assert not rows(token_counts(empty, path))


def test_sharding(docs, empty):
    out = rows(assign_shards(docs, "doc_id", Q.SHARDS))
    assert len(out) == len(TEXTS) and all(r.shard in Q.SHARDS for r in out)
    assert len({r.shard for r in out if r.doc_id == 6}) == 1
    assert not rows(assign_shards(empty, "doc_id", Q.SHARDS))
    with pytest.raises(ValueError, match="prime"):
        lookup_table(["a"], 10)


def test_lookup_table_by_preference_lists():
    names, size = [f"s{i}" for i in range(7)], 251
    digest = [hashlib.md5(n.encode()).hexdigest() for n in names]
    lists = [[(int(d[:8], 16) + k * (int(d[8:16], 16) % (size - 1) + 1)) % size for k in range(size)] for d in digest]
    table: dict[int, int] = {}
    while len(table) < size:
        for s, wanted in enumerate(lists):
            if len(table) < size:
                table[next(x for x in wanted if x not in table)] = s
    assert lookup_table(names, size) == [table[i] for i in range(size)]
    fewer = lookup_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(fewer, lookup_table(names, size), strict=True) if b != 6)
    assert moved < size // 4


def brute_repeats(data):
    starts: dict = {}
    for d in data:
        for i in range(len(d) - 399):
            starts[d[i : i + 400]] = starts.get(d[i : i + 400], 0) + 1
    want = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - 399):
            if starts[d[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        want.append((len(d), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def test_suffix_dedup(docs, empty):
    out = rows(remove_repeats(docs))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_repeats([(t or "").encode() for _, t in TEXTS])
    assert not rows(remove_repeats(empty))


@pytest.mark.parametrize("slice_size", [1000, 3])
def test_suffix_dedup_of_shared_passages(spark, slice_size):
    """A passage in many texts, cut at either side, beside shorter ones, inside one text, and keys over a slice's size."""
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = text(700), text(390)
    texts = [text(rng.randrange(60)) + passage[rng.choice([0, 0, 1, 5, 250]) : rng.choice([700, 700, 699, 660])] + text(rng.randrange(60)) for _ in range(25)]
    texts += [passage[:600] + end for end in ("", "x", "y" + text(200))]
    texts += [text(50) + other + text(50), text(9) + other + text(70), passage + text(30) + passage, "ab" * 500, text(2000), passage[:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = rows(remove_repeats(df, slice_size=slice_size))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_repeats([t.encode() for t in texts])


def test_packing(docs, empty):
    import numpy as np
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = rows(pack(docs.coalesce(1), path))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in TEXTS if i not in (6, None)}
    for i, want in ids.items():
        at = 0
        for p in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    sequences: dict = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048
    assert not rows(pack(empty, path))


def test_packing_special_strings(spark):
    import numpy as np
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b C'mon it's", "ÀÉß Éá x y", "１２ 日本 ﬁ Σ ΑΣ", "don't!?! 3,4 <|startoftext|>", "İ z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = rows(pack(df, path))
    for i, t in enumerate(texts):
        want = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        got = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert sum(n for _, n, _ in got) == len(want)
        assert all(c == zlib.crc32(want[s : s + n].tobytes()) for s, n, c in got)


def test_pii_context_on_both_sides(spark):
    """Words after a match count, and those beyond neighbouring matches, within 48 characters."""
    far = "x " * 24
    texts = ["123-45-6789 (SSN)", "555-010-1234 (phone)", "SSNs 123-45-6789, 234-56-7890", "123-45-6789, 234-56-7890 are SSNs", f"123-45-6789 {far}ssn", f"ssn {far}123-45-6789", f"{far * 3}123-45-6789 (SSN) {far * 3}", "123-45-6789 plain", "ssn " + "123-45-6789 " * 6]
    out = {r.doc_id: r for r in rows(find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [len(out[i].national_id) for i in range(len(texts))] == [1, 0, 2, 2, 0, 0, 1, 0, 4]
    assert [(x.start, x.end, x.score) for x in out[2].national_id] == [(5, 16, 0.6), (18, 29, 0.6)]
    assert len(out[1].local_phone) == 1


def test_decontamination(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while seven bright lanterns hang above a narrow river bridge tonight"
    words = item.split()
    edited = " ".join(w if k % 8 else "other" for k, w in enumerate(words))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "one two three")], "item_id long, text string")
    more = spark.createDataFrame([(20, f"before {item.upper()}! after"), (21, f"x {edited} y"), (22, "the quick brown fox sleeps"), (20, f"before {item.upper()}! after")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    out = {(r.doc_id, r.item_id) for r in rows(contaminated(every, items))}
    assert {(20, 1), (21, 1), (8, 4), (9, 4)} <= out and not {d for d, _ in out} & {22, 4, 5}
    kept = rows(remove_contaminated(every, items))
    assert {r.doc_id for r in kept}.isdisjoint({20, 21}) and any(r.doc_id is None for r in kept)
    assert not rows(contaminated(empty, items))
    assert not rows(contaminated(docs, items.limit(0)))


def test_keep_one_decides_by_row(spark):
    """Repeats, null ids and ids with two texts: one row of each component stays, and no text without a link goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    data = [(1, a, "r"), (1, a, "s"), (2, a + " more", "t"), (None, a, "u"), (None, b, "v"), (None, b, "w"), (2, c, "x"), (7, "", "y"), (7, "", "y"), (None, None, "z")]
    out = [tuple(r) for r in keep_one(spark.createDataFrame(data, "doc_id long, text string, extra string")).collect()]
    assert sorted((d or 0, t or "") for d, t, _ in out) == sorted([(1, a), (0, b), (2, c), (7, ""), (7, ""), (0, "")])
    assert all(r in data for r in out)


def test_jaccard_components(docs, empty):
    out = rows(jaccard_components(docs))
    assert len(out) == len(TEXTS)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (1, 2, 3))
    assert by[5].component_id == by[6].component_id == by[7].component_id == 5
    assert by[8].component_id == by[9].component_id == 8 and by[8].n_shingles == 1
    assert sorted(r.component_id is None for r in out if r.doc_id is None) == [False, True]
    kept = [r.doc_id for r in rows(keep_one(docs))]
    assert kept.count(5) == 1 and 6 not in kept and 7 not in kept and 9 not in kept
    assert not rows(jaccard_components(empty))


@pytest.mark.parametrize("bounds", [BOUNDS, Bounds(crowd=3, block=4, grams=600, hot=20)])
def test_jaccard_components_by_brute_force(spark, bounds):
    import random

    rng = random.Random(5)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 90))] for _ in range(40)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            w = list(words)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            texts.append(" ".join(w if rng.random() < 0.7 else w + passage))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(jaccard_components(df, bounds=bounds))}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("bounds", [BOUNDS, Bounds(crowd=3, block=9), Bounds(crowd=2, block=5, hot=4)])
def test_jaccard_crowds(spark, bounds):
    """Many near copies of one text, of which some link only through others, and outsiders that share a passage."""
    import random

    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{k}_{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [f"o{k}_{i}" for i in range(30)]) for k in range(20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in rows(jaccard_components(df, bounds=bounds))}
    assert got == dict(enumerate(root))


def test_jaccard_moves_few_texts(spark, monkeypatch):
    """Texts that share one rare n-gram by chance are in no block; near copies are, short ones too."""
    from voxelspark.llm import ngram_join

    texts = []
    for k in range(120):
        w = [f"t{k}_{i}" for i in range(40)]
        w[17:22] = [f"chance{k // 2}_{i}" for i in range(5)]
        texts.append(" ".join(w))
    base = [f"c{i}" for i in range(90)]
    texts += [" ".join(base), " ".join([*base[:50], "changed", *base[51:]]), "s1 s2 s3 s4 s5 s6 s7", "s1 s2 s3 s4 s5 s6 s7 s8", "u1 u2 u3 u4 u5 u6", "u1 u2 u3 u4 u5 u6 u7"]
    made, moved = ngram_join._texts, []

    def spied(placed, *rest):
        moved.extend(r.set_id for r in placed.collect())
        return made(placed, *rest)

    monkeypatch.setattr(ngram_join, "_texts", spied)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 0)  # as where the order can't know all n-grams that repeat
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in rows(jaccard_components(df))}
    assert got == {**{i: i for i in range(len(texts))}, 121: 120, 123: 122}
    assert len(moved) == 4

    found = {r.doc_id for r in rows(ngram_join._maybe(df, df.select("doc_id").where("doc_id % 40 = 0")))}
    assert {0, 40, 80, 120} <= found and len(found) < 40
    assert not rows(ngram_join._maybe(df, df.select("doc_id").where("doc_id < 0")))


def test_near_duplicates_moves_few_texts(spark, monkeypatch):
    """The pipeline's stage sends no text for pairs that meet at one n-gram by chance, and keeps one of each group."""
    import corpus_pipeline
    from voxelspark.llm import ngram_join

    texts = []
    for k in range(120):
        w = [f"p{k}_{i}" for i in range(40)]
        w[9:14] = [f"met{k // 2}_{i}" for i in range(5)]
        texts.append(" ".join(w))
    texts += [COPY, COPY.replace("copied7 ", "changed "), None]
    made, moved = ngram_join._texts, []

    def spied(placed, *rest):
        moved.extend(r.set_id for r in placed.collect())
        return made(placed, *rest)

    monkeypatch.setattr(ngram_join, "_texts", spied)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 0)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = rows(corpus_pipeline.near_duplicates(spark, df, ""))
    assert sorted(r.doc_id for r in out) == [i for i in range(123) if i != 121]
    assert len(moved) == 2


def test_near_duplicates_shared_passage(spark, monkeypatch):
    """A passage that many unlike texts share makes no block of them, though no task sees two of them."""
    import corpus_pipeline
    from voxelspark.llm import ngram_join

    passage = [f"shared{i}" for i in range(20)]
    texts = [" ".join([*(f"q{k}_{i}" for i in range(20)), *passage, *(f"r{k}_{i}" for i in range(20))]) for k in range(80)]
    texts.append(texts[7].replace("q7_3 ", "changed "))
    made, moved = ngram_join._texts, []

    def spied(placed, *rest):
        moved.extend(r.set_id for r in placed.collect())
        return made(placed, *rest)

    monkeypatch.setattr(ngram_join, "_texts", spied)
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, len(data)), "doc_id long, text string, lang string, source string, n_chars long")
    out = rows(corpus_pipeline.near_duplicates(spark, df, ""))
    assert sorted(r.doc_id for r in out) == list(range(80))
    assert len(moved) == 2


def test_toxicity(spark, docs, empty):
    texts = [(i, f"a calm day number {i} in the garden by the water" if i % 4 else f"you stupid clown number {i} are trash in the garden") for i in range(400)]
    many = spark.createDataFrame(texts, "doc_id long, text string")
    labels = many.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic")).unionByName(spark.createDataFrame([(None, 1), (0, None)], "doc_id long, toxic int"))
    out = rows(score_toxicity(many, labels))
    assert all(r.predicted == (r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(rows(score_toxicity(docs, labels))) == len(TEXTS)
    assert len(rows(score_toxicity(docs, labels.limit(0)))) == len(TEXTS)
    assert not rows(score_toxicity(empty, labels))
    assert {r.doc_id % 4 == 0 for r in rows(drop_toxic(many, labels))} == {False}
    assert drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    """Rank of held-out toxic rows over the others, of the driver's labels."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    out = score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    higher = sum((b > g) + (b == g) / 2 for b in bad for g in good)
    assert len(bad) > 50 and higher / (len(bad) * len(good)) > 0.95


def test_line_spread(spark, docs, empty):
    line = "this line stands on every single site"
    rows_in = [(i, f"own text of {i}\n{line}\nend {i}", f"site{i % 6}") for i in range(30)] + [(30, None, "a"), (31, "", None), (32, line, None), (32, line, None)]
    df = spark.createDataFrame(rows_in, "doc_id long, text string, source string")
    out = rows(dedup_lines(df, min_sites=6))
    assert len(out) == 34
    for r in out:
        if r.doc_id < 30:
            assert r.text == f"own text of {r.doc_id}\nend {r.doc_id}" and (r.n_lines, r.n_removed_lines) == (3, 1)
        elif r.doc_id == 30:
            assert r.text is None and r.n_lines == 0
        elif r.doc_id == 31:
            assert r.text == "" and (r.n_lines, r.n_removed_lines) == (1, 0)
        else:
            assert r.text == "" and r.n_removed_lines == 1
    assert all(r.n_removed_lines == 0 for r in rows(dedup_lines(df, min_sites=7)) if r.doc_id < 30)
    assert len(rows(dedup_lines(docs, min_sites=2))) == len(TEXTS)
    assert not rows(dedup_lines(empty))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 16 <= len(digits) <= 19 and _luhn(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(spans)


def test_pii(spark, docs, empty):
    texts = [
        "a@b.c_d@e.f x@y.c.@z.w aa@b @c.d ..@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.1 1..2.3.4 99999999999.1.1.1",
        "4111-1111 1111-1111 4111111111111112 5500 0000 0000 0004 1 2 3", "+1 (555) 010-1234 +5 ( +49.30.1234567- ++44 20 7946 0958",
        "é🙂 4111111111111111 🙂 a.b@c.de", "IBAN: DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01", "SSN 123-45-6789, call 555-010-1234", "1 " * 20_000, "7" * 30_000, "a" * 50_000 + "@b",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows(pii_digest(find_pii(df))):
        want = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert r.spans.startswith(want)
        if r.doc_id == 5:
            assert r.spans == "iban:6:33"
        if r.doc_id == 6:
            assert "national_id:4:15" in r.spans and "local_phone:22:34" in r.spans
    assert len(rows(pii_digest(find_pii(docs)))) == len(TEXTS)
    assert not rows(pii_digest(find_pii(empty)))


def test_pipeline_stages_on_edge_cases(spark, docs, empty):
    """Nulls in every column, empty and long texts, repeated rows, extra and clashing columns, and no rows, as a chain."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    odd = [(None, None, None, None, None), (50, "", None, None, 0), (51, "some words", "en", None, None), (51, "some words", "en", None, None)]
    extra = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), "k_id", "n_lines", "h", F.lit(1).alias("__key"))
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    table = extra.unionByName(odd, allowMissingColumns=True)
    counts = [table.count()]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == C.COLUMNS, name
        table = spark.createDataFrame(out.collect(), out.schema)
        counts.append(table.count())
    left = [(r.doc_id, r.text) for r in table.collect()]
    # The copies of one text and the repeated row go, texts without words stay.
    assert left.count((51, "some words")) == 1 and left.count((5, COPY)) == 1 and (50, "") in left
    assert {1, 2, 3, 4} <= {i for i, _ in left} and not {6, 7} & {i for i, _ in left} and (None, None) in left
    assert counts[0] == counts[2] > counts[3] >= counts[4]
    pieces = rows(C.STAGES[-1][1](spark, table, sf))
    assert {p.doc_id for p in pieces} == {i for i, _ in left}
    none = empty.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"), "h")
    for name, stage in C.STAGES:
        assert not rows(stage(spark, none, sf)), name
