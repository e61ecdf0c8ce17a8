import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from nuntia.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(SMALL))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        total = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = sorted((-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), q.encode()) for q, o in counts.items() if q != s)
            terms = sorted((-((p(c, t) - p(total, t)) ** 2 // p(total, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(total, t))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def test_query_agrees_with_sql(spark, sf_dir):
    df = dv.op12_divergence(spark, sf_dir)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got(df) == set(con.execute(dv.ORACLE).fetchall())


def test_odd_rows(spark):
    rows = [
        (None, "s", "Über über ÜBER a a b"), ("", "s", "a a a b"), (None, None, "a b\x00c über"), ("de", "s", "Ä-Ä ä1ä"), ("de", "t", "ä Ä Ä"), ("de", None, "ä x"), ("de", "é", None), ("de", "z", "12 _ ."), ("de", "s", "Ä ä"),
        ("fr", "one", "mot mot"), ("fr", "one", "mot"), ("fr", "one", "mot"), ("it", "a", "x"), ("it", "b", None), ("it", "b", ""), ("de", "t", "\u0085ä ä KK"),
    ]
    df = frame(spark, rows).withColumn("n", F.lit("clash")).withColumn("term", F.lit(1)).withColumn("p", F.lit(None))
    assert got(dv.divergence(df)) == brute(rows)
    assert got(dv.divergence(df.where("false"))) == set()


def test_repeated_rows_and_one_frequent_source(spark):
    rows = [("l", "hot" if i % 3 else f"s{i % 7}", " ".join(f"w{j % (i % 5 + 1)}x" + "y" * (j * i % 11) for j in range(i % 17))) for i in range(400)]
    rows += [("l", "s1", "again and again")] * 50
    letters = [(a, b, re.sub(r"\d", lambda m: chr(97 + int(m[0])), c)) for a, b, c in rows]
    assert got(dv.divergence(frame(spark, letters).repartition(5))) == brute(letters)


def test_only_the_first_terms_and_long_texts(spark):
    names = ["".join(chr(97 + int(c)) for c in f"{i:04d}") for i in range(700)]
    rows = [("l", "a", " ".join(names * 40)), ("l", "a", " ".join(names[:300])), ("l", "b", " ".join(names[100:])), ("l", "b", "aaaa " * 200_000), ("l", "c", "aaaa")]
    out = got(dv.divergence(frame(spark, rows), 2, 50))
    assert out == brute(rows, 2, 50) and max(r[5] for r in out if r[2] == "term") == 50


@pytest.mark.parametrize("at_once", [1, 64])
def test_counts_of_slices(spark, monkeypatch, at_once):
    monkeypatch.setattr(dv, "AT_ONCE", at_once)
    rows = [("l", f"s{i % 2}", "one two " * (i % 4) + "tail") for i in range(12)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": a, "source": b, "text": c} for a, b, c in rows])
    n, docs = Counter(), Counter()
    for b in dv.counted(iter([batch])):
        for r in b.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n == Counter((s, w) for _, s, t in rows for w in t.split()) and docs == Counter((s, w) for _, s, t in rows for w in set(t.split()))
