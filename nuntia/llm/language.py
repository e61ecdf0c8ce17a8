"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of STEPS bytes. A gated recurrent unit reads each window forwards, another backwards;
from both states a softmax labels every byte position with a language, and a document's language is the one with
the largest mean probability over all its positions. Both units are trained in numpy by backpropagation through
time on a bounded sample of documents of each language. At prediction thousands of windows advance together.

Defined results: `und` with score 0 for a null text or one without letters, and for every text if no row could be
learned from. Ties go to the language that sorts first. Repeated rows are labelled alike; other columns are ignored. An
empty table gives no rows; a very long text is read in windows.

Every language that a row to learn from names is learned, however many there are and however long its texts: the sample
holds about SAMPLE documents in all, but for at least FEWEST of each language, and of a long text a stretch of max_chars.
Training takes at least LEAST_WINDOWS windows of each language, so it grows with their number beyond about 140.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import buffers, discard, fold, slices, small, table, written

STEPS = 96
HIDDEN = 8
SAMPLE, FEWEST, LEAST_WINDOWS = 6000, 10, 64
PARTS = ("Xf", "Uf", "Xb", "Ub", "V", "v")


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: dict[str, np.ndarray]


def fresh(n_languages: int, rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """X: what a byte adds to update, reset and candidate (3 * hidden rows); U: what the state adds; V, v: the softmax."""
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    w = {f"{k}{d}": draw(3 * hidden, n, by=by) for d in "fb" for k, n, by in (("X", 256, 0.3), ("U", hidden, 0.5 / hidden**0.5))}
    return w | {"V": draw(n_languages, 2 * hidden, by=0.3), "v": np.zeros((n_languages, 1), np.float32)}


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def advance(x: np.ndarray, u: np.ndarray, tokens: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, hidden, windows) of one unit over tokens (steps, windows)."""
    h3 = u.shape[0]
    n = h3 // 3
    state = np.zeros((n, tokens.shape[1]), np.float32)
    out = np.empty((len(tokens), *state.shape), np.float32)
    for t, byte in enumerate(tokens):
        a = np.take(x, byte, axis=1)
        a[: 2 * n] += u[: 2 * n] @ state
        np.tanh(0.5 * a[: 2 * n], out=a[: 2 * n])
        zr = 0.5 + 0.5 * a[: 2 * n]
        z, r = zr[:n], zr[n:]
        reset = r * state
        c = np.tanh(a[2 * n :] + u[2 * n :] @ reset)
        if keep is not None:
            keep.append((state, z, r, reset, c))
        state = c + z * (state - c)
        out[t] = state
    return out


def backward(grads: np.ndarray, kept: list, tokens: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of X and U through all steps."""
    n = u.shape[0] // 3
    dx, du, carry = np.zeros_like(x), np.zeros_like(u), np.zeros_like(grads[0])
    for t in range(len(tokens) - 1, -1, -1):
        state, z, r, reset, c = kept[t]
        dh = grads[t] + carry
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (state - c) * z * (1 - z)
        dreset = u[2 * n :].T @ dc
        dr = dreset * state * r * (1 - r)
        da = np.concatenate([dz, dr, dc])
        du[: 2 * n] += da[: 2 * n] @ state.T
        du[2 * n :] += dc @ reset.T
        for j in range(3 * n):
            dx[j] += np.bincount(tokens[t], da[j], 256)[:256]
        carry = dh * z + dreset * r + u[: 2 * n].T @ da[: 2 * n]
    return dx, du


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and number of bytes of each window."""
    counts = -(-np.diff(offsets) // STEPS)
    row = np.repeat(np.arange(len(counts)), counts)
    start = offsets[row] + STEPS * (np.arange(len(row)) - (np.cumsum(counts) - counts)[row])
    return row, start, np.minimum(STEPS, offsets[row + 1] - start)


def tokens_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(STEPS, windows): the windows' bytes, padded with 0."""
    at = start[None, :] + np.arange(STEPS)[:, None]
    tokens = data[np.minimum(at, max(len(data) - 1, 0))]
    tokens[np.arange(STEPS)[:, None] >= length[None, :]] = 0
    return tokens


def label_probabilities(tokens: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """(steps, languages, windows): the softmax at every position."""
    n = w["Uf"].shape[0] // 3
    fore, back = advance(w["Xf"], w["Uf"], tokens), advance(w["Xb"], w["Ub"], tokens[::-1])
    out = np.matmul(w["V"][:, :n], fore)
    out += np.matmul(w["V"][:, n:], back[::-1])
    out += w["v"]
    np.exp(out, out=out)
    out /= out.sum(1, keepdims=True)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, model: LanguageModel, at_once: int = 2048) -> np.ndarray:
    """(rows, languages): mean probability over a row's positions, 0 for empty rows."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    for a, b in slices(data, offsets):
        row, start, length = windows(offsets[a : b + 1])
        for i in range(0, len(row), at_once):
            j = slice(i, i + at_once)
            p = label_probabilities(tokens_of(data, start[j], length[j]), model.weights)
            short = np.flatnonzero(length[j] < STEPS)
            sums = p.sum(0)
            for k in short:
                sums[:, k] = p[: length[j][k], :, k].sum(0)
            for k in range(sums.shape[0]):
                total[a:b, k] += np.bincount(row[j], sums[k], b - a)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def fit(rows: list[tuple[str, str]], epochs: int = 5, batch: int = 256, most_windows: int = 9000, rate: float = 0.02, seed: int = 4) -> LanguageModel:
    """Learn from (text, language) rows; whole texts are cut into windows, of which each language gives equally many."""
    languages = tuple(sorted({k for t, k in rows if t}))
    rng = np.random.default_rng(seed)
    w = fresh(max(1, len(languages)), rng)
    if len(languages) < 2:
        return LanguageModel(languages, w)
    parts = [t.encode("utf-8", "replace") for t, k in rows if t]
    label = np.array([languages.index(k) for t, k in rows if t])
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
    data = np.frombuffer(b"".join(parts), np.uint8)
    row, start, length = windows(offsets)
    label = label[row]
    share = max(LEAST_WINDOWS, most_windows // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == k))[:share] for k in range(len(languages))])
    n = HIDDEN
    m1, m2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    total = epochs * -(-len(chosen) // batch)
    for _ in range(epochs):
        mix = rng.permutation(chosen)
        for lo in range(0, len(mix), batch):
            pick = mix[lo : lo + batch]
            x, y = tokens_of(data, start[pick], length[pick]), label[pick]
            kf, kb = [], []
            fore, back = advance(w["Xf"], w["Uf"], x, kf), advance(w["Xb"], w["Ub"], x[::-1], kb)
            both = np.concatenate([fore, back[::-1]], 1)
            p = np.exp(np.matmul(w["V"], both) + w["v"])
            p /= p.sum(1, keepdims=True)
            p[:, y, np.arange(len(y))] -= 1
            p *= (np.arange(STEPS)[:, None, None] < length[pick]) / np.float32(length[pick].sum())
            d = np.matmul(w["V"].T, p)
            g = {"V": np.tensordot(p, both, ((0, 2), (0, 2))), "v": p.sum((0, 2))[:, None]}
            g["Xf"], g["Uf"] = backward(d[:, :n], kf, x, w["Xf"], w["Uf"])
            g["Xb"], g["Ub"] = backward(d[::-1, n:], kb, x[::-1], w["Xb"], w["Ub"])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            now = rate * min(1.0, 2 * (1 - (step - 1) / total))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                w[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return LanguageModel(languages, w)


def identify(documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, lang_pred and score, one row per row of documents; one pass without a shuffle."""
    kind = documents.schema[id_column].dataType.simpleString()
    lettered = documents.select(id_column, F.when(F.col(text_column).rlike(r"\p{L}"), F.col(text_column)).alias(text_column))
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            if len(model.languages) > 1:
                p = pooled(data, offsets, model)
            else:  # the only language learned, if any
                p = np.ones((len(offsets) - 1, len(model.languages))) if model.languages else np.zeros((len(offsets) - 1, 1))
            known = (np.diff(offsets) > 0) & bool(model.languages)
            best = np.where(known, p.argmax(1), len(names) - 1)
            score = np.where(known, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=[id_column, "lang_pred", "score"])

    return lettered.mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")


def language_sample(documents: DataFrame, skip: Column, per_language: int = 300, max_chars: int = 20_000, seed: int = 4) -> list[tuple[str, str]]:
    """(text, lang) of up to about per_language documents of every language, chosen by a hash of the id, or of the text
    where there is no id. Of a text over max_chars characters a stretch of that length, at a place set by the hash.

    Rows of one id, or of one text without id, share a hash: one of them serves, the smallest, however many there are, so
    what comes to the driver is bounded by the languages. Such rows count as they are where a language's share is set."""
    chance = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    usable = documents.where(F.col("lang").isNotNull() & ~F.coalesce(skip, F.lit(True)) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang", chance.alias("chance"))
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    most = min(per_language, max(FEWEST, SAMPLE // max(1, counts.count())))
    share = F.pmod("chance", F.lit(1 << 30)) / float(1 << 30)
    # a rare language is taken whole, so that chance leaves none out
    found = usable.join(small(counts), "lang").where((F.col("n") <= 2 * most) | (share < most / F.col("n")))
    start = F.pmod("chance", F.greatest(F.length("text") - max_chars + 1, F.lit(1))) + 1
    found = found.select("chance", F.struct("doc_id", F.substring(F.col("text"), start, F.lit(max_chars)).alias("text"), "lang").alias("row"))
    rows = found.groupBy("chance").agg(F.min("row").alias("row")).select("row.*").collect()
    discard(counts)
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))]


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned only where crc32(doc_id) mod 4 is not 2."""
    documents = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = fit(language_sample(documents, held))
    return identify(documents, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
