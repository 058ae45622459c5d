"""Toxicity by weak supervision.

Voters look at a text: each word of a fixed lexicon, words that labelled rows show to go with the label, patterns, the
absence of all lexicon words, and the annotator. A generative model with a hidden label estimates each voter's
accuracy by expectation maximisation, and how voters depend on each other given the label; voters that repeat each
other share one voice. A linear classifier is trained on the model's posterior labels and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, chunks, drop_stash, lower_latin, mix, stash
from .decontaminate import WORD_BYTES

#: Labelled rows that the models are fitted on at most, the first by a hash of their id.
MAX_FIT_ROWS = 20_000
#: Words of the classifier, and words taken as voters, at most.
MAX_WORDS, MAX_VOTERS = 1024, 64
#: A word needs so many labelled texts, and as a voter so large a share of them toxic.
MIN_TEXTS, MIN_PRECISION = 8, 0.5
#: Beginnings of words, of so many bytes, count beside whole words: languages inflect and join words.
STEMS = (4, 5, 6, 7, 8)
HELD_OUT_FOLDS = 5

#: Words that insult.
LEXICON = [
    "idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting",
    "imbecile", "fool", "jerk", "ugly", "filthy", "coward", "vermin", "garbage", "hate", "idiota", "imbécil",
    "estúpido", "basura", "asqueroso", "abruti", "ordure", "connard", "stupide", "dégoûtant", "dummkopf", "abschaum",
    "trottel", "widerlich", "blöd",
]
N_PATTERNS = 3
#: Weight of a lexicon word before training.
LEXICON_WEIGHT = 6.0


def fold(doc_id: Column) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS


def term_hashes(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case without marks, and of their stems, with the text of each."""
    buf = lower_latin(WORD_BYTES[chunk.buf])
    starts, ends, first = chunk.words(buf)
    spans = SpanHash(buf)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, texts = [spans(starts, ends)], [text]
    for size in STEMS:
        longer = ends - starts > size
        begin = starts[longer]
        hashes.append(mix(spans(begin, begin + size) + np.uint64(size)))
        texts.append(text[longer])
    return np.concatenate(hashes), np.concatenate(texts)


def lexicon_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(SpanHash(data)(np.array([0]), np.array([len(data)]))[0])
    return np.array(out, np.uint64)


def patterns(chunk) -> np.ndarray:
    """Of each text: share of exclamation marks (as tenths of a percent, 1 at most), of capitals, and of repeated marks."""
    buf = chunk.buf
    length = np.maximum(chunk.end - chunk.begin, 1)
    shout = chunk.per_text(buf == ord("!")) / length
    capital = chunk.per_text((buf >= 65) & (buf <= 90)) / length
    twice = np.zeros(len(buf), bool)
    twice[1:] = (buf[1:] == buf[:-1]) & np.isin(buf[1:], np.frombuffer(b"!?", np.uint8))
    return np.stack([np.minimum(1, 100 * shout), np.minimum(1, 2 * capital), np.minimum(1, 100 * chunk.per_text(twice) / length)], axis=1)


def presence(chunk, vocabulary: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) pairs of the vocabulary's words in a chunk, each once. vocabulary is sorted; places are its words."""
    h, text = term_hashes(chunk)
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Most terms are in no slot of a bit table of their first 16 bits, so few are searched for.
    slot = np.zeros(1 << 16, bool)
    slot[vocabulary >> np.uint64(48)] = True
    maybe = np.flatnonzero(slot[h >> np.uint64(48)])
    at = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
    hit = vocabulary[at] == h[maybe]
    pair = np.unique(text[maybe[hit]] * len(vocabulary) + at[hit])
    return pair // len(vocabulary), places[pair % len(vocabulary)]


@dataclass
class Model:
    """Weights of the linear classifier over words (sorted hashes) and patterns."""

    words: np.ndarray
    weights: np.ndarray
    pattern_weights: np.ndarray
    bias: float
    accuracies: dict[str, float] = field(default_factory=dict)
    correlated: list[tuple[int, int, float]] = field(default_factory=list)


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden labels from votes (1 toxic, -1 not, 0 none).

    Gives the posterior, each voter's probabilities of its votes under both labels (voter, label, vote + 1), the
    correlations of voters given the label, and the share of a voice that each voter has.
    """
    n, k = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    score = votes[:, :].sum(axis=1)
    posterior = np.clip(np.where(score > 0, 0.8, 0.2 * prior), 0.01, 0.99)
    # The annotator is the last voter; its vote starts the search.
    posterior = np.where(votes[:, -1] > 0, np.maximum(posterior, 0.7), np.where(votes[:, -1] < 0, np.minimum(posterior, 0.3), posterior))
    share = np.ones(k)
    corr = np.eye(k)
    for step in range(rounds):
        weight = np.stack([1 - posterior, posterior], axis=1)
        table = np.einsum("nl,nkv->klv", weight, one_hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        balance = np.clip((posterior.sum() + 1) / (n + 2), 0.001, 0.999)
        if step % 10 == 5:
            expected = np.einsum("nl,klv,v->nk", weight, table, np.array([-1.0, 0.0, 1.0]))
            rest = votes - expected
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(spread, spread)
            share = 1 / np.maximum(1, (np.clip(corr, 0, 1) ** 2 * (np.abs(corr) > 0.3)).sum(axis=1))
        logit = np.log(balance / (1 - balance)) + np.einsum("nkv,kv,k->n", one_hot, np.log(table[:, 1] / table[:, 0]), share)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-6 and step > 10:
            break
        posterior = new
    return posterior, table, corr, share


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, penalty: float = 2e-5, rounds: int = 600, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels, by accelerated gradient descent, drawn towards the weights at the start.

    The rarer label weighs up to the square root of ten times as much.
    """
    n = len(x)
    pos = max(y.sum(), 1e-6)
    weight = np.where(y > 0.5, min(10.0, max(1.0, (n - pos) / pos)) ** 0.5, 1.0)
    w, b, vw, vb = start.copy(), 0.0, np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30)))
        g = weight * (p - y) / n
        gw, gb = g.astype(x.dtype) @ x + penalty * (w - start), g.sum()
        vw, vb = 0.95 * vw - rate * gw, 0.95 * vb - rate * gb
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", *, max_rows: int = MAX_FIT_ROWS, annotator: bool = True) -> Model:
    """Fits on at most ``max_rows`` labelled rows outside the held-out fold. annotator: labels vote beside the others."""
    fixed = lexicon_hashes(LEXICON)
    key = F.col(label_id_col).cast("long").alias("l_id")
    chosen = labels.where((fold(F.col(label_id_col)) != 0) & F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = chosen.groupBy(key).agg(F.max(F.col(label_col).cast("int")).alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)
    # At most max_rows rows of 12 bytes: bounded, so they go to every task.
    sample = docs.select(F.col(id_col).cast("long").alias("l_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "l_id").select("label", "text")
    sample = stash(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy()
            for chunk in chunks(batch.column(1)):
                h, text = term_hashes(chunk)
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
                h, text = h[new], text[new]
                edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                if len(edge):
                    own = label[text + chunk.first].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h[edge].astype(np.int64)), pa.array(np.add.reduceat(own, edge)), pa.array(np.diff(np.append(edge, len(h))))], names=["h", "pos", "n"])

    size, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not positive or positive == size:
        drop_stash(sample)
        order = np.argsort(fixed)
        return Model(fixed[order], np.full(len(fixed), LEXICON_WEIGHT), np.zeros(N_PATTERNS), -LEXICON_WEIGHT / 2)
    base = positive / size
    words = sample.mapInArrow(count, "h long, pos long, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    z = (F.col("pos") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    top = words.where(F.col("n") >= MIN_TEXTS).withColumn("z", z).orderBy(F.desc(F.abs("z")), "h").limit(MAX_WORDS).toArrow()  # bounded by MAX_WORDS
    learned = top.column("h").to_numpy().astype(np.uint64)
    precise = (top.column("pos").to_numpy() / top.column("n").to_numpy() >= MIN_PRECISION) & (top.column("z").to_numpy() > 0)
    voters = np.concatenate([fixed, learned[precise & ~np.isin(learned, fixed)][:MAX_VOTERS]])
    vocabulary = np.unique(np.concatenate([voters, learned]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                n = len(chunk.begin)
                text, word = presence(chunk, vocabulary, np.arange(len(vocabulary)))
                cut = np.searchsorted(text, np.arange(1, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, n), pa.array([x.astype(np.int32) for x in np.split(word, cut)], pa.list_(pa.int32())), pa.array(list(patterns(chunk)), pa.list_(pa.float64()))], names=["label", "words", "patterns"])

    rows = sample.mapInArrow(features, "label int, words array<int>, patterns array<double>").toArrow()  # bounded by max_rows and MAX_WORDS
    drop_stash(sample)
    lists = [np.array(x, np.int64) for x in rows.column("words").to_pylist()]
    x = np.zeros((len(lists), len(vocabulary) + N_PATTERNS), np.float32)
    x[np.repeat(np.arange(len(lists)), [len(w) for w in lists]), np.concatenate(lists)] = 1
    x[:, len(vocabulary) :] = np.array(rows.column("patterns").to_pylist())
    label = rows.column("label").to_numpy()
    own = np.searchsorted(vocabulary, voters)
    seen = x[:, own] > 0
    used = seen.any(axis=0)
    pattern_votes = np.stack([x[:, len(vocabulary)] > 0.5, x[:, len(vocabulary) + 1] > 0.6, x[:, len(vocabulary) + 2] > 0.3], axis=1)
    votes = np.concatenate([seen[:, used].astype(int), pattern_votes.astype(int), -(~seen.any(axis=1)[:, None]).astype(int), np.where(label > 0, 1, -1)[:, None] * annotator], axis=1)
    posterior, table, corr, _ = label_model(votes.astype(np.float64), base)
    start = np.zeros(x.shape[1])
    start[np.searchsorted(vocabulary, fixed)] = LEXICON_WEIGHT
    weights, bias = logistic(x, posterior, start)
    names = [*[LEXICON[i] if i < len(LEXICON) else f"word-{i}" for i in np.flatnonzero(used)], "shouting", "capitals", "repeated marks", "no lexicon word", "annotator"]
    linked = [(int(i), int(j), float(corr[i, j])) for i, j in zip(*np.nonzero(np.triu(np.abs(corr) > 0.3, 1)), strict=True)]
    return Model(vocabulary, weights[: len(vocabulary)], weights[len(vocabulary) :], bias, {n: float(t[1, 2] + t[0, 0]) / 2 for n, t in zip(names, table, strict=True)}, linked)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row. Only the text is an input of the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS and the voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                n = len(chunk.begin)
                text, word = presence(chunk, m.words, np.arange(len(m.words)))
                logit = m.bias + np.bincount(text, weights=m.weights[word], minlength=n) + patterns(chunk) @ m.pattern_weights
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, n), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = MAX_FIT_ROWS, annotator: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null or empty texts are scored as texts without words. Repeated rows: each is scored alone; repeated labels of an
    id count as toxic if one is. Null ids are carried and count as held out; labels with a null id or value are left
    out. Without labels of both kinds the fixed lexicon alone scores. Extra columns are ignored. An empty table gives
    an empty result. No shuffle of texts.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, max_rows=max_rows, annotator=annotator), id_col, text_col)
    held_out = F.col("doc_id").isNull() | (fold(F.col("doc_id")) == 0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows that score below the threshold, with all their columns. The same model and cases as ``score_toxicity``."""
    model = fit(docs, labels, id_col, text_col, max_rows=max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = []
            for chunk in chunks(batch.column(at)):
                text, word = presence(chunk, m.words, np.arange(len(m.words)))
                logit = m.bias + np.bincount(text, weights=m.weights[word], minlength=len(chunk.begin)) + patterns(chunk) @ m.pattern_weights
                keep.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))) < threshold)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
