"""Classifier queries against their models' formulas, worked out in plain Python for every row of a table."""

import math
import re

import numpy as np
import pytest
import zstandard

from nuntia.llm import language, quality, toxicity
from nuntia.llm.common import fold


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def curve(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_quality_by_hand(spark, sf_dir, docs, texts):
    model = quality.fitted(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = by_id(quality.op7_quality(spark, sf_dir), "score", "predicted")
    assert got.keys() == texts.keys()
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))
    for i, text in texts.items():
        data = (text or "").encode()
        parts = [data[k : k + 512] for k in range(0, len(data), 512)]
        want = model.prior
        if data:
            gain = sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts) / len(data)
            base = math.log(model.prior / (1 - model.prior))
            want = curve((len(data) * (model.slope * gain + model.intercept) + 80 * base) / (len(data) + 80))
        assert got[i] == (pytest.approx(want, abs=1e-9), int(got[i][0] >= 0.5)), i


def word_logit(word, model):
    marked, buckets = b"\0" + word + b"\0", []
    for n in (3, 4, 5, 6):
        for k in range(len(marked) - n + 1):
            h = 0
            for byte in marked[k : k + n]:
                h = (h * 0x100000001B3 + byte) % 2**64
            buckets.append((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 47)
    return sum(float(model.weights[b]) for b in buckets) / len(buckets) + model.bias


def test_toxicity_by_hand(spark, sf_dir, texts):
    model = toxicity.fitted(spark, sf_dir)
    got = by_id(toxicity.op8_toxicity(spark, sf_dir), "score", "predicted")
    assert got.keys() == texts.keys() and model.weights is not None
    known = {}
    for i, text in texts.items():
        words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
        for w in set(words) - known.keys():
            known[w] = word_logit(w, model)
        top = sorted((known[w] for w in words), reverse=True)[:2]
        x = sum(top) / len(top) if top else model.floor
        want = curve(model.slope * max(-12.0, min(12.0, x)) + model.intercept)
        assert got[i] == (pytest.approx(want, abs=1e-6), int(got[i][0] >= 0.5)), i


def unit(x, u, tokens):
    """States of one gated recurrent unit, a byte at a time."""
    n, state, out = u.shape[0] // 3, np.zeros(u.shape[0] // 3), []
    for byte in tokens:
        z = 1 / (1 + np.exp(-(x[:n, byte] + u[:n] @ state)))
        r = 1 / (1 + np.exp(-(x[n : 2 * n, byte] + u[n : 2 * n] @ state)))
        c = np.tanh(x[2 * n :, byte] + u[2 * n :] @ (r * state))
        state = z * state + (1 - z) * c
        out.append(state)
    return out


def test_language_by_hand(spark, sf_dir, docs, texts):
    model = language.fit(language.language_sample(docs, fold("doc_id", 4) == 2))
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    got = by_id(language.identify(docs, model).select("doc_id", "lang_pred", "score"), "lang_pred", "score")
    query = by_id(language.op4_language(spark, sf_dir), "lang_pred", "score")
    assert query.keys() == got.keys() == texts.keys() and query == got  # training repeats itself
    for i, text in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        data, total = text.encode(), np.zeros(len(model.languages))
        for k in range(0, len(data), 96):
            own = data[k : k + 96]
            tokens = own + bytes(96 - len(own))
            fore, back = unit(w["Xf"], w["Uf"], tokens), unit(w["Xb"], w["Ub"], tokens[::-1])[::-1]
            for a, b in list(zip(fore, back, strict=True))[: len(own)]:
                e = np.exp(w["V"] @ np.r_[a, b] + w["v"][:, 0])
                total += e / e.sum()
        p = total / len(data)
        assert got[i][1] == pytest.approx(p.max(), abs=1e-3) and p[model.languages.index(got[i][0])] >= p.max() - 1e-3, i
