import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nuntia.llm import near_dup as nd
from nuntia.llm.common import buffers
from nuntia.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """component of each id over links of full sets; rows: (id, text)."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(n)
    for n, (i, s) in enumerate(sets):
        for m, both in Counter(m for x in s for m in by[x] if m < n).items():
            j, other = sets[m]
            if 100 * both >= percent * (len(s) + len(other) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in sets}


def family(n, size=120, seed=1, first=0):
    """n near copies of one text, each with a few words replaced, so that by no means all pairs are linked."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = [(first, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80), (1, 50)])
def test_components_are_those_of_brute_force(spark, k, percent):
    rows = family(60, first=100) + family(30, 40, 2, 1000) + [(5000 + i, f"a b c d e f g h {i // 2}") for i in range(6)] + [(6000, "One two"), (6001, "one  TWO"), (6002, "one"), (6003, ""), (6004, None)]
    random.Random(3).shuffle(rows)
    found = nd.near_duplicates(frame(spark, rows), k, percent)
    assert got(found) == brute(rows, k, percent)
    sizes = {r["doc_id"]: r["n_shingles"] for r in found.collect()}
    assert sizes == {i: len(shingles(t, k)) for i, t in rows}


def test_large_groups_go_through_hubs_samples_blocks_and_chunks(spark, monkeypatch):
    for name, value in (("VOLUME", 2000), ("WEIGHT", 16), ("SAMPLE", 8), ("LARGE", 24)):
        monkeypatch.setattr(nd, name, value)
    rows = family(150, first=10) + family(40, 80, 4, 1000) + [(2000 + i, "same text " * 5) for i in range(50)]
    want = brute(rows, 3, 85)
    assert len(set(want.values())) > 3 and Counter(want.values()).most_common(1)[0][1] > 40
    assert got(nd.near_duplicates(frame(spark, rows), 3, 85)) == want


def moved(spark, monkeypatch, rows, k=3, percent=85):
    """The components found, and how many rows of texts went through tasks."""
    n = 0
    compared = nd.compared

    def counted(df, *rest):
        nonlocal n
        n += df.count()
        return compared(df, *rest)

    monkeypatch.setattr(nd, "compared", counted)
    out = got(nd.near_duplicates(frame(spark, rows), k, percent))
    monkeypatch.setattr(nd, "compared", compared)
    return out, n


def test_rows_moved_for_a_chain_grow_with_its_length(spark, monkeypatch):
    for name, value in (("VOLUME", 4000), ("WEIGHT", 16), ("SAMPLE", 8), ("LARGE", 24)):
        monkeypatch.setattr(nd, name, value)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    chain = []
    for i in range(300):  # each is near the one before, and far from all but a few
        words = [*words[4:], *(f"w{rng.randrange(10**6)}" for _ in range(4))]
        chain.append((i, " ".join(words)))
    counts = []
    for n in (100, 300):
        out, rows = moved(spark, monkeypatch, chain[:n])
        assert out == brute(chain[:n], 3, 85)
        counts.append(rows)
    assert counts[1] < 3.6 * counts[0] and counts[1] < 30 * 300


def test_very_long_texts_in_a_large_group(spark, monkeypatch):
    for name, value in (("VOLUME", 20_000), ("SAMPLE", 4), ("LARGE", 8)):
        monkeypatch.setattr(nd, name, value)
    rows = family(12, 30_000, 6) + [(100 + i, t.replace("w1", "v1")) for i, t in family(12, 30_000, 6)] + family(20, 60, 7, 1000)
    assert got(nd.near_duplicates(frame(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_odd_rows(spark, odd, none):
    rows = nd.near_duplicates(odd, 3, 85).orderBy("doc_id").collect()
    assert len(rows) == odd.count() and nd.near_duplicates(none, 3, 85).collect() == []
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert out[1] == [(0, 1)] and out[3] == [(0, 3)] and out[5] == [(1, 5)] * 2 and out[6] == [(1, 5)] and out[None] == [(1, None)] * 2


def test_ids_repeated_with_other_texts_keep_their_links(spark):
    rows = [(1, "a b c d"), (7, "a b c d"), (7, "p q r s t"), (9, "p q r s t"), (9, "p q r s t")]
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in nd.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert out == {(1, 2): 1, (7, 2): 1, (7, 3): 7, (9, 3): 7}
    first = sorted((r["doc_id"], r["n_shingles"], r["first"]) for r in nd.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert first == [(1, 2, True), (7, 2, False), (7, 3, True), (9, 3, False), (9, 3, False)]


def test_hashes_do_not_depend_on_neighbours_in_the_batch():
    texts = ["A b  c d", "", None, "\n x\ty z", "é ü A", "a b c d", "a\xa0b c d e"]
    together = list(nd.shingle_sets(*buffers(pa.array(texts)), 3))
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(s, next(nd.shingle_sets(*buffers(pa.array([t], pa.string())), 3))) and len(s) == len(shingles(t, 3))
    assert np.array_equal(together[0], together[5]) and not np.array_equal(together[0], together[6])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    functions = nd.permutations(256)
    for share in (0.3, 0.85):
        every = rng.integers(0, 1 << 63, 2000, np.uint64)
        both = int(2000 * share)
        a, b = every[: both + (2000 - both) // 2], np.r_[every[:both], every[both + (2000 - both) // 2 :]]
        agree = (nd.signature(a, *functions) == nd.signature(b, *functions)).mean()
        assert abs(agree - share) < 0.07


def test_bands_miss_hardly_any_pair():
    for t in (0.8, 0.85, 0.5):
        n = nd.bands_for(t)
        assert n % 2 == 0 and (1 - t**nd.ROWS) ** n <= nd.MISS
    functions = nd.permutations(nd.bands_for(0.85) * nd.ROWS // 2)
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        every = rng.integers(0, 1 << 63, 400, np.uint64)
        keys = [nd.band_keys(nd.signature(s, *functions), nd.bands_for(0.85)) for s in (every[:370], every[30:])]
        missed += not set(keys[0]) & set(keys[1])
    assert missed == 0


def test_components_of_chains_stars_and_rings(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (3000, 3001), (3001, 3000)]
    random.Random(1).shuffle(edges)
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, 300)} | {2000 + i: 2000 for i in range(1, 50)} | {3001: 3000}
    assert {k: v for k, v in out.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query(spark, sf_dir, docs):
    df = nd.op6_near_dup(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 3, 85)
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in df.collect()} == {i: (c, c == i) for i, c in want.items()}
    assert df.where(F.col("kept")).count() < len(rows) and math.isfinite(nd.MISS)
