import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from nuntia.llm import mixing


def filled(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by resharing what is cut, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {s: 0.0 for s in order}, float(sum(sizes.values())), set(order)
    for _ in range(1000):
        if left < 1e-9 or not open_:
            break
        total, share, left = sum(w[s] for s in open_), left, 0.0
        for s in list(open_):
            target[s] += share * w[s] / total
            if target[s] > repeats * sizes[s]:
                left += target[s] - repeats * sizes[s]
                target[s] = float(repeats * sizes[s])
                open_.discard(s)
    return target


def test_targets_reshare_the_excess():
    rng = random.Random(1)
    for _ in range(60):
        names = [f"s{i}" for i in range(rng.randint(1, 9))] + ([None] if rng.random() < 0.5 else [])
        sizes = {s: rng.choice([0, 1, 7, 100, 10_000]) for s in names}
        got, want = mixing.targets(sizes), filled(sizes)
        assert all(abs(got[s] - want[s]) < 1e-3 for s in names), (sizes, got, want)
    assert mixing.targets({}) == {}


def test_flow_repeats_as_little_as_possible():
    capacity, quota = {("a",): 100, ("b",): 50, ("a", "b"): 100}, {"a": 120, "b": 200}
    flow = mixing.route(capacity, quota)
    taken = {p: sum(f.values()) for p, f in flow.items()}
    assert Counter({s: sum(f.get(s, 0) for f in flow.values()) for s in quota}) == Counter(quota)
    # 320 words of 250: all of them once and 70 twice, none thrice
    assert sum(min(taken[p], capacity[p]) for p in capacity) == 250 and all(taken[p] <= 2 * capacity[p] for p in capacity)
    # a quota beyond what its patterns can give is met as far as it goes
    assert mixing.route({("a",): 5}, {"a": 100, "b": 3}) == {("a",): {"a": 15}}
    assert mixing.route({("a",): 0, ("b", None): 4}, {"a": 0, "b": 2, None: 2}) == {("a",): {}, ("b", None): {"b": 2, None: 2}}


def test_flow_has_least_cost_on_small_graphs():
    import itertools

    rng = random.Random(2)
    for _ in range(25):
        patterns = [("a",), ("b",), ("a", "b")]
        capacity, quota = {p: rng.randint(0, 3) for p in patterns}, {"a": rng.randint(0, 4), "b": rng.randint(0, 4)}
        price = lambda p, n, c=capacity: sum(min(max(n - j * c[p], 0), c[p]) * j for j in range(3))

        def options(p, c=capacity):
            return [x for x in itertools.product(range(3 * c[p] + 1), repeat=len(p)) if sum(x) <= 3 * c[p]]

        best = None
        for choice in itertools.product(*[options(p) for p in patterns]):
            got = Counter()
            for p, x in zip(patterns, choice, strict=True):
                got.update(dict(zip(p, x, strict=True)))
            if all(got[s] <= quota[s] for s in quota):
                key = (-sum(got.values()), sum(price(p, sum(x)) for p, x in zip(patterns, choice, strict=True)))
                best = key if best is None or key < best else best
        flow = mixing.route(capacity, quota)
        taken = {p: sum(f.values()) for p, f in flow.items()}
        assert (-sum(taken.values()), sum(price(p, taken[p]) for p in patterns)) == best


def test_overlapping_sources(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 50), rng.choice([["a"], ["b"], ["a", "b"], ["b", "a", "c"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    out = mixing.mix(df, sources=F.col("tags"), weights=(1, 1, 6))
    routed = Counter()
    for f in out.flow.values():
        routed.update(f)
    assert all(abs(routed[s] - t) <= 1 for s, t in out.source_targets.items())
    by = Counter()
    for r in out.collect():
        by[tuple(r["sources"])] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(by[p] == sum(f.values()) for p, f in out.flow.items())


def test_sources_come_near_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["x", "x", "x", "y", "z", None])) for i in range(3000)] + [(9000, "v " * 5, "tiny"), (9001, None, "empty")]
    rows += [(77, "same row", "y")] * 40
    df = spark.createDataFrame([(*r, 1, 2, "d") for r in rows], "doc_id long, text string, source string, size int, target int, row string")
    out = mixing.mixed_by_source(df)
    assert out.columns == ["doc_id", "text", "source", "row", "size", "source_size", "target", "taken"]
    first = sorted((str(r["doc_id"]), r["taken"]) for r in out.collect())
    rows = out.collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in rows) == first and len(rows) == 3042  # reruns agree
    totals, targets, sizes = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        totals[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    assert all(abs(totals[s] - t) <= 1 for s, t in targets.items()) and {r["source_size"] for r in rows if r["source"] == "tiny"} == {5}
    want = filled(sizes)
    assert all(abs(targets[s] - want[s]) < 1e-3 for s in want)


@pytest.mark.parametrize("ids", [[None], [5], [None, 7, 8]])
def test_rows_that_share_a_bin_meet_the_target(spark, ids):
    rows = [(ids[i % len(ids)], "w" + " v" * (i % 3 if len(ids) > 1 else 0), "a") for i in range(1000)] + [(i, "w " * 1000, "b") for i in range(3)] + [(None, "w", None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    totals, targets = Counter(), {}
    for r in mixing.mixed_by_source(df).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        totals[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(abs(totals[s] - t) <= 1 for s, t in targets.items())


def test_odd_rows(odd, none):
    rows = mixing.mixed_by_source(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed_by_source(none).collect() == []
    assert all((r["size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in mixing.mixed_by_source(odd.where("doc_id < 4")).collect())


def test_query_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(mixing.ORACLE)
    names = [c[0] for c in cursor.description]
    df = mixing.op9_mix(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \t\n\x0b\x0c\r ", 0), ("a\xa0b c", 2), ("é\x1cü", 1)])
def test_sizes_count_words(spark, text, n):
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert mixing.mixed_by_source(df).first()["size"] == n
