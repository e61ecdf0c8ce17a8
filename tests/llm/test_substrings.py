import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nuntia.llm import substrings as ss

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """(n_words, n_removed, kept) of each (id, text); ids are distinct."""
    docs = sorted((i, WORD.findall(t or "")) for i, t in rows)
    seen, out = set(), {}
    for i, words in docs:
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            phrase = tuple(words[j : j + window])
            if phrase in seen:
                gone[j : j + window] = [True] * window
            seen.add(phrase)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()}


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def repetitive(seed, n, words=3, most=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = [f"w{j}" for j in rng.integers(words, size=rng.integers(most))]
        if rows and rng.random() < 0.5:
            other = WORD.findall(rows[rng.integers(len(rows))][1])
            at = rng.integers(len(other) + 1)
            text[5:5] = other[at : at + rng.integers(40)]
        rows.append((i * 3 - n, rng.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("window,gram", [(20, 8), (6, 3), (3, 3), (5, 1)])
def test_random_texts(spark, window, gram):
    rows = repetitive(window, 120, 200 if window == 20 else 4)
    assert got(ss.without_repeats(frame(spark, rows), window, gram)) == brute(rows, window)


@pytest.mark.parametrize("name,value", [("HEAVY", 1), ("BITS", 1 << 12), ("BLOCK_WORDS", 1), ("BLOCK_VOCABULARY", 1), ("HASHED", 16)])
def test_no_bound_changes_the_result(spark, monkeypatch, name, value):
    monkeypatch.setattr(ss, name, value)
    if name == "BITS":
        monkeypatch.setattr(ss, "BITS_EACH", 0)  # as full as a table gets
    rows = repetitive(7, 150, 6, 80)
    assert got(ss.without_repeats(frame(spark, rows), 6, 3)) == brute(rows, 6)


def test_common_passage_and_line_stay_spread_out(spark, monkeypatch):
    """A passage of every document, a line in ever other surroundings, and many copies: few pieces for each key."""
    monkeypatch.setattr(ss, "HEAVY", 20)
    passage, line = " ".join(f"p{i}" for i in range(60)), " ".join(f"l{i}" for i in range(10))
    rows = [(i, f"{passage} " + " ".join(f"a{i}x{j}" for j in range(15)) + f"\n{line}\n" + " ".join(f"b{i}x{j}" for j in range(15))) for i in range(300)]
    rows += [(1000 + i, "one copied text of many words " * 8) for i in range(200)]
    largest = []
    cut = ss.sharded

    def measured(pieces, window):
        largest.append(pieces.groupBy("key").count().agg(F.max("count")).first()[0])
        return cut(pieces, window)

    monkeypatch.setattr(ss, "sharded", measured)
    assert got(ss.without_repeats(frame(spark, rows, 4))) == brute(rows)
    assert largest[0] <= 20


def test_odd_rows(spark, odd, none):
    out = ss.without_repeats(odd)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert len(rows) == odd.count()
    by = {r[0]: r for r in rows}
    assert by[1] == (1, 0, 0, "") and by[2] == (2, 0, 0, "") and by[3] == (3, 0, 0, "")
    assert by[4] == (4, 60_000, 60_000 - 22, "The long text. " * 7 + "The") or by[4][1:] == brute([(4, "The long text. " * 20_000)])[4]
    assert [r for r in rows if r[0] is None] == [(None, 3, 0, "no id here")] * 2 and [r for r in rows if r[0] == 5] == [(5, 3, 0, "the same row")] * 2
    assert ss.without_repeats(none).collect() == []


def test_rows_of_one_id_and_without_id(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text + " none"), (9, text)]
    out = [tuple(r) for r in ss.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(r[1:3] for r in out) == [(25, 25)] * 3 + [(26, 0), (26, 25)]
    twice = [(5, text), (5, text)]
    assert [tuple(r)[1:3] for r in ss.without_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect()] == [(25, 0)] * 2


def test_windows_are_judged_on_the_input(spark):
    """b's last window occurs in a; what covers it in c is judged against all of b, of which words go."""
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(10)]
    rows = [(1, " ".join(a)), (2, " ".join(b + a)), (3, " ".join(b + a[:15]))]
    out = got(ss.without_repeats(frame(spark, rows)))
    assert out == brute(rows) and out[2] == (30, 20, " ".join(b)) and out[3] == (25, 25, "")


def test_query(spark, sf_dir):
    df = ss.op11_substrings(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute(rows).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == want and any(m for _, m, _ in want.values())
