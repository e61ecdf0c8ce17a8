"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources); each
pattern offers its words up to `repeats` times, the first time free and each further time at a higher price (convex
costs), and each source asks for its quota. A min-cost flow over patterns and sources routes the words with as little
repetition as possible. Of each pattern all documents are then taken as often as the flow covers the pattern whole,
and for the rest seeded documents: those in the lowest bins of a hash of seed and id. In the bin where the rest ends
documents stand in the order of that hash and their size, and each gives the words that a running share of the bin's
words grants it, so the rest is met to the word and reruns agree. Many rows of one id (or without one) share a bin;
copies of one id and size are counted first and numbered within their parts of the table, never sorted in one task.

Weights go to sources in code point order (null last), repeating; quotas share all words of the input by weight, stop
at `repeats` times the words of their source, and what is cut there goes to the other sources by weight.

One row per pattern goes through the driver, as the flow is computed there: a graph of all patterns has to fit in its
memory (some hundred bytes each). Tables with a row per pattern or source are broadcast if they are small, else joined.

Defined results: an empty table gives no rows; a null or empty text has size 0; without words every target is 0; rows
with the same id are treated alike, but for words that can't be shared evenly; a very long text may give a part of its
words; extra columns are kept, and those named like a column of the result are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nuntia.llm.common import WORD, discard, small, table, written

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Hexadecimal digits of a bin: 4,096 bins for each pattern.
DIGITS = 3
SEED = 9


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: min(repeats * size, level * weight), at the level where they add up to all words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, place = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {s: i for i, s in enumerate(order)}
    left, load = sum(sizes.values()), sum(weight.values())
    level = 0.0
    for s in sorted(order, key=lambda s: (repeats * sizes[s] / weight[s], place[s])):
        level = left / load
        if level <= repeats * sizes[s] / weight[s]:
            break
        left, load = left - repeats * sizes[s], load - weight[s]
        if not load:
            break
    return {s: round(min(float(repeats * sizes[s]), level * weight[s]), 6) for s in order}


def route(capacity: dict[tuple, int], quota: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Min-cost flow from patterns (tuples of sources) to sources: words by pattern and source.

    Sources that no pattern joins, directly or over others, share no words, so each such set is a graph of its own.
    """
    up: dict = {}

    def root(s):
        while up.get(s, s) != s:
            s = up[s]
        return s

    for p in capacity:
        for s in p[1:]:
            if root(s) != root(p[0]):
                up[root(s)] = root(p[0])
    parts: dict = {}
    for p in sorted(capacity, key=repr):
        parts.setdefault(root(p[0]) if p else (), []).append(p)
    flow: dict = {}
    for patterns in parts.values():
        flow |= routed({p: capacity[p] for p in patterns}, {s: quota[s] for p in patterns for s in p if s in quota}, repeats)
    return flow


def routed(capacity: dict[tuple, int], quota: dict[str | None, int], repeats: int) -> dict[tuple, dict[str | None, int]]:
    """The flow of one connected graph.

    Successive cheapest paths with potentials; copy number j of a pattern costs j, so costs are convex. Each step
    fills an arc, and arcs are taken in sorted order, so the result is the same in every run.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=lambda s: (s is None, s or ""))
    n = len(patterns) + len(sources) + 2
    start, end = n - 2, n - 1
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    arcs: list[list[int]] = []  # to, left, cost; the arc after an even one is its reverse
    out: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    total = sum(quota.values())
    for i, p in enumerate(patterns):
        for copy in range(repeats):
            arc(start, i, capacity[p], copy)
        for s in p:
            if s in place:
                arc(i, place[s], total, 0)
    for s in sources:
        arc(place[s], end, quota[s], 0)
    potential = [0] * n
    while True:
        cost, via = [float("inf")] * n, [-1] * n
        cost[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > cost[a]:
                continue
            for k in out[a]:
                b, room, price = arcs[k]
                if room > 0 and d + price + potential[a] - potential[b] < cost[b]:
                    cost[b], via[b] = d + price + potential[a] - potential[b], k
                    heapq.heappush(heap, (cost[b], b))
        if via[end] < 0:
            break
        potential = [p + c if c < float("inf") else p for p, c in zip(potential, cost, strict=True)]
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {p: {sources[arcs[k][0] - len(patterns)]: arcs[k ^ 1][1] for k in out[i] if not k % 2 and arcs[k][0] != end and arcs[k ^ 1][1]} for i, p in enumerate(patterns)}


def seeded(key: str, seed: int) -> Column:
    """md5 of seed and id; its first DIGITS digits are the bin."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"))


def before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows that stand before, within keys."""
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order)) - F.col(value))


def shared_out(edge: DataFrame) -> DataFrame:
    """edge (sources, hash, size, part, words, and others) with `given`: what each row gives of its words, `part` in all
    of the `words` of its sources, as running shares in the order of hash and size."""
    same = ["sources", "hash", "size"]
    rows = written(edge.withColumn("file", F.spark_partition_id()), "edge")
    copies = written(rows.groupBy(*same, "file").agg(F.count("*").alias("n"), F.sum("size").alias("held")), "copies")
    kinds = copies.groupBy(*same).agg(F.sum("held").alias("held")).withColumn("sub", F.substring("hash", DIGITS + 1, DIGITS))
    subs = before(kinds.groupBy("sources", "sub").agg(F.sum("held").alias("total")), ["sources"], ["sub"], "total", "lower")
    kinds = before(kinds.join(subs, ["sources", "sub"]), ["sources", "sub"], ["hash", "size"], "held", "less")
    files = before(copies, same, ["file"], "held", "earlier").select(*same, "file", "earlier")
    places = files.join(kinds.select(*same, (F.col("lower") + F.col("less")).alias("start")), same).select(*same, "file", (F.col("start") + F.col("earlier")).alias("start"))
    number = F.row_number().over(Window.partitionBy(*same, "file").orderBy(F.lit(1)))
    upto = rows.join(places, [*same, "file"]).withColumn("upto", F.col("start") + number * F.col("size"))
    share = lambda c: F.floor(c.cast("decimal(38,0)") * F.col("part") / F.col("words")).cast("long")
    return upto.withColumn("given", F.when(F.col("words") > 0, share(F.col("upto")) - share(F.col("upto") - F.col("size"))).otherwise(0)).drop("upto", "start", "file")


def word_count(text_column: str) -> Column:
    return F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long")


def mix(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", sources: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """(row, sources, size, taken) of each document: all its columns, its sources, its words, and how many of them the
    mix takes (repeats counted).

    sources: an array column of the sources a document belongs to; by default its column `source` alone. size: by
    default the number of words in the text; it is read twice, so give a column where it is known.
    Attributes of the result: source_sizes, source_targets and flow, plain dicts by source and pattern.
    """
    spark = documents.sparkSession
    sources = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    hash_ = seeded(id_column, seed)
    sized = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), sources.alias("sources"), (word_count(text_column) if size is None else size).alias("size"), hash_.alias("hash"), F.substring(hash_, 1, DIGITS).alias("bin"))
    bins = written(sized.groupBy("sources", "bin").agg(F.sum("size").alias("words")), "bins")
    capacity = {tuple(r["sources"] or ()): int(r["words"]) for r in bins.groupBy("sources").agg(F.sum("words").alias("words")).toLocalIterator()}
    sizes: dict[str | None, int] = {}
    for pattern, words in capacity.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    wanted = targets(sizes, weights, repeats)
    flow = route(capacity, {s: int(t + 0.5) for s, t in wanted.items()}, repeats)
    plan = []
    for pattern, words in capacity.items():
        routed = sum(flow[pattern].values())
        plan.append((list(pattern), routed // words if words else 0, routed % words if words else 0))
    plan = spark.createDataFrame(plan, "sources array<string>, copies long, rest long")
    # of each pattern, the bin in which the rest ends, and the words of it that are taken
    ends = before(bins.join(small(plan), "sources"), ["sources"], ["bin"], "words", "lower")
    ends = ends.where((F.col("lower") <= F.col("rest")) & (F.col("lower") + F.col("words") > F.col("rest")))
    ends = ends.select("sources", F.col("bin").alias("last"), (F.col("rest") - F.col("lower")).alias("part"), "words")
    cut = written(plan.join(ends, "sources", "left"), "cut")
    discard(bins)
    placed = sized.join(small(cut), "sources", "left")
    # a bin of which a part is taken is shared out; in all others documents stand before or behind the end
    split = F.coalesce((F.col("bin") == F.col("last")) & (F.col("part") > 0), F.lit(False))
    edge = shared_out(placed.where(split).select("row", "sources", "size", "hash", "copies", "part", "words"))
    plain = placed.where(~split).withColumn("given", F.when(F.col("bin") < F.col("last"), F.col("size")).otherwise(0))
    taken = F.coalesce(F.col("copies") * F.col("size") + F.col("given"), F.lit(0)).cast("long")
    out = plain.select("row", "sources", "size", taken.alias("taken")).unionByName(edge.select("row", "sources", "size", taken.alias("taken")))
    out.source_sizes, out.source_targets, out.flow = sizes, wanted, flow
    return out


def mixed_by_source(documents: DataFrame, size: Column | None = None) -> DataFrame:
    """All columns of documents, each document in its one source, with size, source_size, target and taken.

    Columns of the input that have one of these four names are replaced.
    """
    mixed = mix(documents, size=size)
    rows = [(s, n, mixed.source_targets[s]) for s, n in mixed.source_sizes.items()]
    facts = documents.sparkSession.createDataFrame(rows, "name string, source_size long, target double")
    added = ["size", "source_size", "target", "taken"]
    own = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in added]
    return mixed.join(small(facts), F.element_at("sources", 1).eqNullSafe(F.col("name"))).select(*own, *added)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 5, 2, 1, repeating over the sources."""
    documents = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("words")), "sizes")
    return mixed_by_source(documents, F.col("words")).drop("source", "words")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('9:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash, substr(md5('9:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS bin
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT source, source_size, weight, 3 * source_size / weight AS ratio,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM ranked WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (
  SELECT source, source_size, round(least(CAST(3 * source_size AS DOUBLE), weight * (
    SELECT level FROM filling WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)), 6) AS target
  FROM filling),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS copies,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest
  FROM wanted),
bins AS (
  SELECT source, bin, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS up_to
  FROM sized GROUP BY source, bin),
running AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, bin ORDER BY hash, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS own FROM sized)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(p.copies * s.size + CASE WHEN b.up_to <= p.rest THEN s.size WHEN b.up_to - b.words >= p.rest THEN 0
         ELSE s.own * (p.rest - b.up_to + b.words) // b.words - (s.own - s.size) * (p.rest - b.up_to + b.words) // b.words END AS BIGINT) AS taken
FROM running s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN bins b ON s.source IS NOT DISTINCT FROM b.source AND s.bin = b.bin
"""
