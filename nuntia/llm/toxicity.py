"""Subword-bag classifier for toxicity.

A word is the bag of its character n-grams (with word-boundary marks), hashed into buckets. Bucket embeddings are
averaged over the bag and go into a linear softmax; embeddings and softmax are trained jointly in numpy. A misspelt
or inflected word that training never saw shares most n-grams, and so most vectors, with the words it did see; a few
made-up misspellings of the strongest words take part in training, so that single n-grams learn to count.
A document's evidence is the mean of its two most toxic words: toxicity is local, so an average over all words would
drown it in a long text, while a single look-alike occurs in clean texts too. Training therefore alternates between
choosing the strongest words of toxic documents and fitting (multiple-instance learning), with the words of clean
documents as negatives. Several trainings from different starts are averaged, as one alone is unsteady on rare words.
A logistic curve gives the document's probability.

At prediction softmax(W mean(E)) over two classes is a logistic function of the mean of one number per n-gram,
so whole batches are scored from their raw bytes by array operations.

Defined results: a text without words (null, empty, only signs) has no evidence and gets the score of the lowest
evidence seen in fitting. Without labels of both classes every score is the labels' smoothed share of class 1 (0.5
without any). An empty table gives no rows. A very long text is read in pieces, of which the strongest words count.
Repeated rows are scored alike. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import LONG, buffers, fold, labelled_sample, lowered, pieces, platt, prior_shift, sigmoid, slices, table

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
SHIFT = np.uint64(64 - 17)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
EVIDENCE = (-12.0, 12.0)
#: Misspellings of each strong word that are learned with it.
MISSPELT = 4


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray | None  # one float32 per bucket: difference of the two softmax rows times the embedding
    bias: float
    slope: float
    intercept: float
    floor: float


def word_mask(data: np.ndarray) -> np.ndarray:
    """Letters a-z, digits and all bytes of other scripts belong to words."""
    return ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased rows: each word's row, and for all n-grams the word's number and the bucket."""
    n_rows = len(offsets) - 1
    # a mark before each row and after the last keeps words apart
    text = np.zeros(len(data) + n_rows + 1 + max(SIZES), np.uint8)
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(n_rows), lengths)
    place = np.arange(len(data)) + row_of + 1
    text[place] = data
    inside = word_mask(text)
    text[~inside] = 0
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.zeros(len(text), np.int32)
    owner[begins] = 1
    owner = np.cumsum(owner) - 1
    starts = np.arange(n_rows) + offsets[:-1] + 1
    word_row = np.searchsorted(starts, begins, "right") - 1
    gaps = np.cumsum(~inside, dtype=np.int32)
    m = len(text) - max(SIZES)
    rolling = text[:m].astype(np.uint64)
    words, hashes = [], []
    for n in range(2, max(SIZES) + 1):
        rolling = rolling * np.uint64(0x100000001B3) + text[n - 1 : n - 1 + m]
        if n in SIZES:  # positions 1 to n-2 lie in one word, the ends may be its boundaries
            ok = np.flatnonzero(gaps[n - 2 : n - 2 + m] == gaps[:m])
            ok = ok[inside[ok + 1]]
            words.append(owner[ok + 1])
            hashes.append((((rolling[ok] + np.uint64(n)) * MULTIPLY) >> SHIFT).astype(np.int64))
    return word_row, np.concatenate(words), np.concatenate(hashes)


def word_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and logit of every word."""
    rows, words, hashes = subwords(data, offsets)
    count = np.bincount(words, minlength=len(rows))
    total = np.bincount(words, weights[hashes], minlength=len(rows))
    return rows, total / np.maximum(count, 1) + bias


def strongest(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run of words that begins at first: the mean of the two largest logits, or the only one."""
    top = np.maximum.reduceat(logits, first)
    size = np.diff(np.r_[first, len(logits)])
    rest = logits.copy()
    at = np.flatnonzero(logits == np.repeat(top, size))
    run = np.searchsorted(first, at, "right")
    rest[at[np.r_[True, run[1:] != run[:-1]]]] = -np.inf  # one word of each run
    second = np.maximum.reduceat(rest, first)
    return np.where(size > 1, (top + second) / 2, top)


def evidence(data: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """The mean of the two largest word logits of each row, the model's floor where there is no word."""
    out = np.full(len(offsets) - 1, model.floor)
    for a, b in slices(data, offsets):
        part = offsets[a : b + 1]
        own = data[part[0] : part[-1]]
        if len(own) > LONG:  # one long row; the two strongest words of each piece are enough
            top = [np.sort(word_scores(lowered(x), np.array([0, len(x)]), model.weights, model.bias)[1])[-2:] for x in pieces(own)]
            if len(top := np.sort(np.concatenate(top))):
                out[a : b] = np.where(np.diff(part) > 0, top[-2:].mean(), model.floor)
            continue
        rows, logits = word_scores(lowered(own), part - part[0], model.weights, model.bias)
        if len(rows):
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[a + rows[first]] = strongest(logits, first)
    return np.clip(out, *EVIDENCE)


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words (strings of bytes), one word after the other, and where each word's begin."""
    data = np.frombuffer(" ".join(words).encode("latin-1"), np.uint8)
    _, owner, hashes = subwords(data, np.array([0, len(data)]))
    order = np.argsort(owner, kind="stable")
    return hashes[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def misspelt(word: str, rng: np.random.Generator) -> str:
    """The word with one letter left out, doubled, replaced, or swapped with the next."""
    i, how = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    middle = ("", word[i] * 2, chr(97 + int(rng.integers(26))), word[i + 1] + word[i])[how]
    return word[:i] + middle + word[i + 1 + (how == 3) :]


@dataclass(frozen=True)
class Words:
    """The distinct words of the labelled rows: names, buckets with where each word's begin, and their documents."""

    kinds: dict[str, int]
    hashes: np.ndarray
    at: np.ndarray
    toxic: list[np.ndarray]
    seen_bad: np.ndarray
    seen_good: np.ndarray


def words_of(docs: list[np.ndarray], y: np.ndarray, kinds: dict[str, int]) -> Words:
    hashes, at = bags(list(kinds))
    seen_bad, seen_good = np.zeros(len(kinds)), np.zeros(len(kinds))
    for d, k in zip(docs, y, strict=True):
        (seen_bad if k else seen_good)[d] += 1
    return Words(kinds, hashes, at, [d for d, k in zip(docs, y, strict=True) if k and len(d)], seen_bad, seen_good)


def logits_of(own: Words, flat: np.ndarray, bias: float) -> np.ndarray:
    size = np.diff(own.at)
    return np.bincount(np.repeat(np.arange(len(size)), size), flat[own.hashes], minlength=len(size)) / np.maximum(size, 1) + bias


def trained(own: Words, rng: np.random.Generator, dim: int, rounds: int, epochs: int, top: int) -> tuple[np.ndarray, float]:
    """One joint training of embeddings and softmax: a weight per bucket, and the bias."""
    names, n = list(own.kinds), len(own.kinds)
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((2, dim), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    slot = np.zeros(BUCKETS, np.int64)
    # at first, a toxic document is represented by the words that clean documents have least
    logit = np.log((own.seen_bad + 0.1) / (own.seen_good + 1.0))
    fixed = own.seen_good > 0
    lettered = np.array([not w.isdigit() for w in names])  # numbers are no words
    for _ in range(rounds):
        chosen = np.zeros(n)
        for d in own.toxic:
            chosen[d[np.argsort(-logit[d], kind="stable")[:top]]] += 1
        chosen[~lettered] = 0
        if (repeated := (chosen > 0) & (own.seen_bad >= 2)).any():  # a word of one document is rather chance
            chosen[~repeated] = 0
        # misspellings of the chosen words, unless they are words of clean documents, are learned with them
        long = [i for i in np.flatnonzero(chosen > 0) if len(names[i]) > 4]
        wrong = [(i, v) for i in long for v in sorted({misspelt(names[i], rng) for _ in range(MISSPELT)}) if not (v in own.kinds and fixed[own.kinds[v]])]
        more_hashes, more_at = bags([v for _, v in wrong])
        hashes, at = np.r_[own.hashes, more_hashes], np.r_[own.at, own.at[-1] + more_at[1:]]
        kind_ids = np.concatenate([np.flatnonzero(chosen > 0), np.arange(n, n + len(wrong)), np.flatnonzero(fixed)])
        label = np.r_[np.ones((chosen > 0).sum() + len(wrong), int), np.zeros(fixed.sum(), int)]
        weight = np.r_[np.sqrt(chosen[chosen > 0]), np.sqrt(chosen[[i for i, _ in wrong]]) / 2, np.sqrt(own.seen_good[fixed])].astype(np.float32)
        weight *= np.where(label == 1, 1.0, max(1.0, 0.5 * weight[label == 1].sum() / max(weight[label == 0].sum(), 1e-9)))
        for _ in range(epochs):
            mix = rng.permutation(len(kind_ids))
            for lo in range(0, len(mix), 512):
                pick = mix[lo : lo + 512]
                ids, lab, wt = kind_ids[pick], label[pick], weight[pick]
                size = np.maximum(at[ids + 1] - at[ids], 0)
                item = np.repeat(np.arange(len(ids)), size)
                first = np.r_[0, np.cumsum(size)[:-1]]
                idx = hashes[np.repeat(at[ids] - first, size) + np.arange(size.sum())]
                mean = np.add.reduceat(emb.take(idx, axis=0), first, axis=0) / size[:, None]
                z = mean @ soft.T + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(ids)), lab] -= 1
                p *= np.minimum(wt, 8)[:, None] / 512
                d_soft, d_bias, d_mean = p.T @ mean, p.sum(0), p @ soft / size[:, None]
                # buckets of the batch are numbered by their last place in it, without a sort
                places = np.arange(len(idx))
                slot[idx] = places
                last = slot[idx]
                own_place = last == places
                uniq, number = idx[own_place], (np.cumsum(own_place) - 1)[last]
                grad = np.stack([np.bincount(number, column.take(item), len(uniq)) for column in np.ascontiguousarray(d_mean.T)], 1).astype(np.float32)
                squares = g_emb[uniq] + (grad**2).mean(1)
                g_emb[uniq] = squares
                emb[uniq] = emb.take(uniq, axis=0) - 0.5 * grad / np.sqrt(squares)[:, None]
                g_soft += d_soft**2
                g_bias += d_bias**2
                soft -= 0.2 * d_soft / np.sqrt(g_soft)
                bias -= 0.2 * d_bias / np.sqrt(g_bias)
        flat = (emb @ (soft[1] - soft[0])).astype(np.float32)
        logit = logits_of(own, flat, float(bias[1] - bias[0]))
    return flat, float(bias[1] - bias[0])


def fit(rows: list[tuple[str, int]], counts: dict[int, int] | None = None, dim: int = 8, rounds: int = 3, epochs: int = 3, top: int = 4, seed: int = 8, models: int = 3) -> ToxicityModel:
    """Joint training of embeddings and softmax over word types of the labelled rows, `models` times from other starts.

    What one training makes of rare words depends on its start. A word's logit is linear in the weights of its buckets,
    so the mean of the weights is the mean of the models, and scores as fast as one.
    """
    y = np.array([r[1] for r in rows])
    if len(np.unique(y)) < 2:
        counts = counts or {k: int((y == k).sum()) for k in (0, 1)}
        return ToxicityModel(None, 0.0, 0.0, float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))), 0.0)
    kinds: dict[str, int] = {}
    docs = []
    for text, _ in rows:
        low = lowered(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
        low[~word_mask(low)] = 32
        docs.append(np.array(sorted({kinds.setdefault(w, len(kinds)) for w in low.tobytes().decode("latin-1").split()}), np.int64))
    own = words_of(docs, y, kinds)
    every = [trained(own, np.random.default_rng(seed + i), dim, rounds, epochs, top) for i in range(models)]
    flat, bias = np.mean([f for f, _ in every], 0, dtype=np.float32), float(np.mean([b for _, b in every]))
    logit = logits_of(own, flat, bias)
    best = np.array([np.clip(np.sort(logit[d])[-2:].mean(), *EVIDENCE) if len(d) else EVIDENCE[0] for d in docs])
    slope, intercept = platt(best, y.astype(float))
    return ToxicityModel(flat, bias, slope, intercept + prior_shift(rows, counts or {}), float(best.min()))


def score_toxicity(documents: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and score, one row per row of documents; one pass without a shuffle."""
    kind = documents.schema[id_column].dataType.simpleString()
    if model.weights is None:
        return documents.select(id_column, F.lit(float(sigmoid(np.float64(model.intercept)))).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: one float per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = evidence(*buffers(batch.column(1)), own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(own.slope * x + own.intercept), pa.float64())], names=[id_column, "score"])

    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double")


def fitted(spark: SparkSession, sf_dir: str, per_class: int = 2500, max_chars: int = 20_000) -> ToxicityModel:
    """A model of labels.toxic from the rows whose crc32(doc_id) mod 5 is not 0 (bounded sample, see labelled_sample)."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit(*labelled_sample(documents, labels, "toxic", fold("doc_id", 5) == 0, per_class, 8, max_chars))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_toxicity(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
