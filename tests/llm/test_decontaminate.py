import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nuntia.llm import decontaminate as dec


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def replaced(w, places, seed=1):
    rng = random.Random(seed)
    return [f"x{rng.randrange(10**6)}" if i in places else v for i, v in enumerate(w)]


def test_whole_partial_and_substituted_passages(spark):
    item, other, short = words(40, 1), words(30, 2), words(6, 3)
    around = lambda w: " ".join(words(20, 9) + w + words(20, 10))
    texts = {
        1: around(item).upper(), 2: around(replaced(item, range(3, 40, 6))), 3: around(item[5:20]), 4: around(item[5:12]), 5: around(replaced(item, range(0, 40, 2))), 6: around(short), 7: around(replaced(short, {2})),
        8: around(item[:20] + ["extra"] * 30 + item[20:]), 9: around(words(40, 77)), 10: None, 11: "", 12: around(item) + " " + around(other), 13: "Ñandú " + " ".join(item),
    }
    docs = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(100, " ".join(item)), (200, "; ".join(other) + "."), (300, " ".join(short)), (400, None), (500, "")], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in dec.contamination(docs, items).collect()}
    # 4: eight tokens of forty; 5: half of the tokens replaced; 7: five of six tokens agree
    assert set(rows) == {(1, 100), (2, 100), (3, 100), (6, 300), (7, 300), (8, 100), (12, 100), (12, 200), (13, 100)}
    assert (rows[1, 100]["text_start"], rows[1, 100]["item_start"], rows[1, 100]["compared"], rows[1, 100]["agreeing"]) == (20, 0, 40, 40)
    assert rows[2, 100]["agreeing"] == 33 and rows[2, 100]["compared"] == 39 and rows[3, 100]["compared"] == 15 and rows[8, 100]["compared"] == 20


def test_masks_find_substitutions_anywhere(spark):
    item = words(30, 5)
    docs = spark.createDataFrame([(i, " ".join(replaced(item, {i, i + 5, i + 11, i + 17}, i))) for i in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    assert dec.contamination(docs, items).count() == 6


def test_every_fifth_token_replaced_and_exact_parts_before_poor_ones(spark):
    item = words(45, 6)
    texts = [replaced(item, range(4, 45, 5)), item[:13] + replaced(item[13:], range(0, 32, 3))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = dec.contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id short, text string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["agreeing"]) for r in rows] == [(0, 36), (1, 13)]


def test_rows_repeat_and_large_benchmarks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(dec, "TABLE_HASHES", 200)
    items = spark.createDataFrame([(i, " ".join(words(20, i))) for i in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words(5, 50 + i) + words(20, i))) for i in range(7)] * 2, "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dec.contamination(docs, items).collect()) == sorted([(i, i) for i in range(7)] * 2)


def test_empty_tables(spark, none, odd):
    items = spark.createDataFrame([(1, "the same row")], "item_id long, text string")
    assert dec.contamination(none, items).collect() == [] == dec.contamination(odd, items.where("false")).collect()
    assert dec.contamination(odd, items).count() == 0  # three tokens are too few
    five = spark.createDataFrame([(1, "text the long text the")], "item_id long, text string")
    assert [r["doc_id"] for r in dec.contamination(odd, five).collect()] == [4]


def test_substitutions_are_found_at_every_length(spark, sf_dir):
    """Stretches of real items as items of their own, a fifth of their tokens replaced, inside real documents."""
    rng = random.Random(11)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    clean = [r["text"].split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 100").orderBy("doc_id").limit(60).collect()]
    items, docs, trials = [], [], 40
    for n in [*range(5, 16), 18, 22, 30, 45]:
        for _ in range(trials):
            source = re.findall(r"[^\W_]+", " ".join(rng.sample(texts, 6)).lower())
            start = rng.randrange(len(source) - n)
            own = [f"{w}{rng.randrange(50)}" for w in source[start : start + n]]  # items that share no stretch by chance
            changed = replaced(own, set(rng.sample(range(n), n // 5)), rng.random())
            around = rng.choice(clean)
            at = rng.randrange(len(around))
            items.append((len(items), " ".join(own), n))
            docs.append((len(docs), " ".join(around[:at] + changed + around[at:])))
    found = {(r["doc_id"], r["item_id"]) for r in dec.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, n int")).collect()}
    for n in {n for _, _, n in items}:
        own = [i for i, _, m in items if m == n]
        assert sum((i, i) in found for i in own) >= 0.9 * len(own), n
    assert sum(d != i for d, i in found) <= 0.01 * len(docs)


def test_repeated_tokens_stay_small():
    import tracemalloc

    test = dec.TestTable([(1, 0, 1)], ["la " * 1000])
    data, offsets = dec.buffers(pa.array(["la " * 20_000, "la " * 600 + "so"]))
    tracemalloc.start()
    rows = list(dec.overlaps(data, offsets, test, 13, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r, i, n, same) for r, i, _, _, n, same in rows] == [(0, 0, 1000, 1000), (1, 0, 600, 600)] and peak < 100 << 20


def test_all_diagonals_are_found_though_hits_are_skipped():
    rng = random.Random(4)
    for _ in range(30):
        item = [rng.choice("abc") for _ in range(rng.randint(13, 40))]
        text = [rng.choice("abc") for _ in range(rng.randint(5, 60))]
        test = dec.TestTable([(1, 0, 1)], [" ".join(item)])
        hashes, first = dec.tokens(*dec.buffers(pa.array([" ".join(text)])))
        got = {int(a - p) for at, place in test.hits(hashes, first) for a, p in zip(at, place, strict=True)}
        want = set()
        for mask in dec.MASKS:
            on = [k for k, c in enumerate(mask) if c == "1"]
            want |= {a - p for a in range(len(text) - len(mask) + 1) for p in range(len(item) - len(mask) + 1) if all(text[a + k] == item[p + k] for k in on)}
        assert got == want


def test_scripts_without_spaces_and_other_cases(spark):
    chinese, greek = "我们今天在图书馆里读了一本关于海洋的书", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί σήμερα"
    items = spark.createDataFrame([(1, chinese), (2, greek)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"前面的话。{chinese}后面还有"), (2, greek.upper().replace("Ή", "Η")), (3, greek.title()), (4, "前面的话后面还有")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dec.contamination(docs, items).collect()} >= {(1, 1), (3, 2)}


def test_equal_items_count_once_and_long_items_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dec, "PART_CHARS", 300)
    monkeypatch.setattr(dec, "PART_OVERLAP", 100)
    monkeypatch.setattr(dec, "TABLE_HASHES", 1000)
    long, other = words(400, 21), words(20, 22)
    items = spark.createDataFrame([(7, " ".join(other)), (3, " ".join(other).upper()), (5, " ".join(other)), (9, " ".join(long))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(long[150:170])), (2, " ".join(other)), (3, " ".join(long))], "doc_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in dec.contamination(docs, items).collect()}
    assert set(rows) == {(1, 9), (2, 3), (3, 9)} and rows[2, 3]["equal_items"] == 3
    assert (rows[1, 9]["item_start"], rows[1, 9]["compared"]) == (150, 20)
    assert {r["item"]: r["class_id"] for r in dec.item_classes(items).collect()} == {7: 3, 3: 3, 5: 3, 9: 9}


def test_query_against_brute_force(spark, sf_dir):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    docs = {r["doc_id"]: f" {norm(r['text'])} " for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x and f" {x} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in dec.op2_decontaminate(spark, sf_dir).collect()}
    assert whole and whole <= got
    for d, i in got - whole:  # whatever else is reported shares most of a passage
        assert len(set(items[i].split()) & set(docs[d].split())) >= 0.6 * min(13, len(set(items[i].split())))


@pytest.mark.parametrize("least, bits", [(13, 1 << 29), (8, 1 << 12)])
def test_a_large_benchmark_gives_what_a_small_one_gives_and_reads_the_texts_once(spark, sf_dir, monkeypatch, least, bits):
    """Also where the bits are so few that most texts are marked."""
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rng = random.Random(3)
    texts = [r["text"].split() for r in items.orderBy("item_id").collect()]
    changed = [(10_000 + i, " ".join(replaced(w, set(rng.sample(range(len(w)), len(w) // 6)), i))) for i, w in enumerate(texts)]
    odd = [(20_000, None), (20_001, "")] + [(20_002 + i % 2, " ".join(["la", "le"][: 1 + i % 2] * 300 + texts[0])) for i in range(4)]
    extra = spark.createDataFrame(changed + odd, "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(extra)
    songs = spark.createDataFrame([(900, "la " * 200), (901, "LA " * 200), (902, "la le " * 40), (903, "la"), (904, None)], "item_id long, text string")
    items = items.select(F.col("item_id").cast("long"), "text").unionByName(songs)
    small = sorted(map(tuple, dec.contamination(docs, items, least).collect()))
    monkeypatch.setattr(dec, "TABLE_HASHES", dec.TABLE_HASHES // 10_000)
    monkeypatch.setattr(dec, "MOST_BITS", bits)
    counted = docs.mapInArrow(counting, docs.schema)
    assert sorted(map(tuple, dec.contamination(counted, items, least).collect())) == small and len(small) > 50
    assert read.value == docs.count()


@pytest.mark.parametrize("hashes", [2_000_000, 0])
def test_short_items_are_looked_for_as_far_as_asked(spark, monkeypatch, hashes):
    monkeypatch.setattr(dec, "TABLE_HASHES", hashes)
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 10)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words "), "text", F.lit(" and more")).alias("text"))
    changed = docs.select("doc_id", F.regexp_replace("text", "x0", "y0").alias("text")).where("doc_id < 5")
    for shortest in (1, 4, 8):
        got = dec.contamination(docs.unionByName(changed), items, shortest=shortest).collect()
        assert sorted((r["doc_id"], r["item_id"], r["agreeing"]) for r in got) == [(n, n, n) for n in range(shortest, 10)]


@pytest.mark.parametrize("hashes", [2_000_000, 0])
def test_parts_of_long_items_with_substitutions(spark, monkeypatch, hashes):
    """Stretches of 14 to 40 tokens of longer items, a fifth of their tokens replaced."""
    monkeypatch.setattr(dec, "TABLE_HASHES", hashes)
    rng = random.Random(5)
    items, docs = [], []
    for k in range(200):
        own, n = words(100, 1000 + k), rng.randrange(14, 41)
        at = rng.randrange(100 - n)
        items.append((k, " ".join(own)))
        docs.append((k, " ".join(words(30, 5000 + k) + replaced(own[at : at + n], set(rng.sample(range(n), n // 5)), k) + words(30, 9000 + k))))
    got = dec.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["doc_id"] for r in got if r["doc_id"] == r["item_id"]}
    print("recall", len(found) / len(docs))
    assert all(r["doc_id"] == r["item_id"] for r in got) and len(found) >= 0.9 * len(docs)
