r"""Source divergence audit: how differently the sources of a language use its words, from joint count histograms.

A term is kept if enough documents of its language hold it; with V kept terms and N occurrences of them in a source, a
term with `count` of these has p = 1 + floor(10**9 * (count + 1) / (N + V)) there. The divergence of one source from
another is the sum over all kept terms of f = floor((p - q)**2 / q).

f depends on a term through its two counts only. So for every pair of sources the distinct (count, count) combinations
are tallied with the number of terms that have them, f is evaluated once for each and multiplied:

1. Texts become counts by (language, source, term), summed within a batch, then within a task, then by a shuffle. Only
   such sums move, so a frequent term or source costs a row a task.
2. A kept term becomes one row: its counts in the sources that have it. Terms with equal rows are tallied, so the many
   rare terms of a corpus become few rows, and only these are taken apart into pairs of sources.
3. Cells where one count is zero aren't listed but implied: the terms with count c in one source, less those that the
   other has as well. They are entered in the same ledger, the former added and the latter subtracted, and whatever
   is left of V has neither. One sum by (pair, count, count) gives the whole histogram.

All arithmetic is exact (longs, decimals of 38 digits). The result holds every pair of sources of a language, so it grows
with their square; what precedes it grows with pairs that have a term in common.

Defined results: null text, language and source read as ''. Every (language, source) that occurs is a group, with or
without terms; a language without kept terms has 0 for each pair. A language with one source has no pairs. Rows that
repeat count as documents of their own; ids play no part. Ties in value go to the smaller item by bytes. An empty table
gives no rows. A text is counted whole, at about twelve times its size in memory. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nuntia.llm.common import buffers, lowered, slices, small, table, written

ONE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Parts into which rows of a language are dealt where they meet all its sources, as languages are few.
PARTS = 16
#: Bytes of text that are counted together.
AT_ONCE = 4 << 20


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows as a string column, and the row of each."""
    low = lowered(data)
    inside = ((low >= 97) & (low <= 122)) | (low >= 128)
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    begins = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
    at = np.r_[0, np.cumsum(ends - begins)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(low[inside].tobytes())])
    return words, np.searchsorted(offsets, begins, "right") - 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text): lang, source, term, its occurrences and the documents that have it, summed by batch."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for a, b in slices(data, offsets, AT_ONCE):
            part = offsets[a : b + 1]
            words, row = terms(data[part[0] : part[-1]], part - part[0])
            if not len(words):
                continue
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            both, times = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            langs, sources = (batch.column(i).slice(a, b - a).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            keys, at = np.unique(group[both // size] * size + both % size, return_inverse=True)
            group, term = keys // size, keys % size
            n, docs = np.bincount(at, times).astype(np.int64), np.bincount(at).astype(np.int64)
            columns = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def whole(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(ONE * (count + 1) / (n + v)); null where there are no kept terms."""
    return F.when(v > 0, F.lit(1).cast("long") + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * whole(count + 1), whole(n + v)))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    if most is not None:
        out = out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def in_parts(groups: DataFrame, *columns: Column) -> DataFrame:
    """Groups by language, once for each part."""
    return groups.select(F.col("lang").alias("of"), *columns, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("in_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))


def histogram(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m: m terms have count ca in source a and cb in source b, for a < b, but for (0, 0)."""
    alike = kept.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    first = alike.select("lang", "m", "counts", F.posexplode("counts").alias("i", "x")).where(F.col("i") + 1 < F.size("counts"))
    pairs = first.select("lang", "m", "x", F.explode(F.expr("slice(counts, i + 2, size(counts))")).alias("y"))
    cell = lambda ca, cb, m: F.struct(ca.cast("long").alias("ca"), cb.cast("long").alias("cb"), m.cast("long").alias("m"))
    ca, cb, m, none = F.col("x.n"), F.col("y.n"), F.col("m"), F.lit(0)
    both = pairs.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.explode(F.array(cell(ca, cb, m), cell(ca, none, -m), cell(none, cb, -m))).alias("cell"))
    # terms by their count in one source, beside every other source of the language
    alone = alike.select("lang", "m", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.sum("m").alias("m"))
    alone = dealt(alone, "source", "n").join(in_parts(groups, F.col("source").alias("other")), (F.col("lang") == F.col("of")) & (F.col("in_part") == F.col("part")) & (F.col("source") != F.col("other")))
    low = F.col("source") < F.col("other")
    n = F.col("n")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), cell(F.when(low, n).otherwise(0), F.when(low, 0).otherwise(n), F.col("m")).alias("cell"))
    entered = both.unionByName(alone).select("lang", "a", "b", "cell.*")
    return entered.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` for all other sources of the language, `term` for the `top` terms
    that a source uses more than its language does."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = documents.select(blank("lang"), blank("source"), blank("text"))
    counts = given.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = written(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("nl"))
    single = kept.select("lang", "term", "total", F.explode("counts").alias("x")).select("lang", "term", "total", "x.*")
    sums = single.groupBy("lang", "source").agg(F.sum("n").alias("ns"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = given.select("lang", "source").distinct().join(small(sums), ["lang", "source"], "left").join(small(langs), "lang", "left")
    groups = written(groups.select("lang", "source", zero("ns"), zero("v"), zero("nl")), "groups")

    known = small(groups)
    used = single.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("ns"), F.col("v"))).withColumn("q", share(F.col("total"), F.col("nl"), F.col("v")))
    of_terms = ranked(used.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), "term", top)

    side = lambda s: small(groups.select("lang", F.col("source").alias(s), F.col("ns").alias(f"n{s}")))
    v = F.col("v")
    pa_, pb = share(F.col("ca"), F.col("na"), v), share(F.col("cb"), F.col("nb"), v)
    cells = histogram(kept, groups).join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).join(small(langs), "lang")
    cells = cells.withColumn("pa", pa_).withColumn("pb", pb)
    times = lambda f: F.sum(whole(F.col("m")) * whole(f))
    sums = cells.groupBy("lang", "a", "b").agg(F.sum("m").alias("m"), times(apart(F.col("pa"), F.col("pb"))).alias("ab"), times(apart(F.col("pb"), F.col("pa"))).alias("ba"))
    # every pair of the language; terms that neither has are what its histogram leaves of V
    pairs = dealt(groups.select("lang", F.col("source").alias("a"), F.col("ns").alias("na"), "v"), "a")
    pairs = pairs.join(in_parts(groups, F.col("source").alias("b"), F.col("ns").alias("nb")), (F.col("lang") == F.col("of")) & (F.col("in_part") == F.col("part")) & (F.col("a") < F.col("b")))
    pairs = pairs.select("lang", "a", "b", "na", "nb", "v").join(sums, ["lang", "a", "b"], "left")
    left = F.col("v") - F.coalesce("m", F.lit(0))
    none_a, none_b = share(F.lit(0), F.col("na"), v), share(F.lit(0), F.col("nb"), v)
    total = lambda s, p, q: F.when(v > 0, F.coalesce(F.col(s), F.lit(0)).cast("decimal(38,0)") + whole(left) * whole(apart(p, q))).otherwise(0).cast("long").alias("value")
    way = lambda s, t, sums, p, q: F.struct(F.col(s).alias("source"), F.col(t).alias("item"), total(sums, p, q))
    of_pairs = pairs.select("lang", F.explode(F.array(way("a", "b", "ab", none_a, none_b), way("b", "a", "ba", none_b, none_a))).alias("x")).select("lang", "x.*")
    return ranked(of_pairs, "pair").unionByName(of_terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: divergence of each source from the others of its language, and its most typical terms."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM k GROUP BY lang),
u AS (SELECT c.lang, c.source, c.term, c.n::HUGEINT AS n FROM c JOIN k USING (lang, term)),
g AS (SELECT x.lang, x.source, coalesce(sum(u.n), 0)::HUGEINT AS ns FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN u USING (lang, source) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000 * (coalesce(u.n, 0) + 1)) // (g.ns + l.v) AS p, 1 + (1000000000 * (k.total + 1)) // (l.nl + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN u USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM grid a JOIN grid b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source WHERE a.source <> b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM every
UNION ALL
SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term QUALIFY rank <= 200
"""
