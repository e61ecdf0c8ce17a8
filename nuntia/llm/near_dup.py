r"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

1. Every document becomes the set of hashes of its word shingles. Each hash function is evaluated once per shingle
   and both its minimum and its maximum are kept, so `m` evaluations give `2 * m` signature values whose agreement is
   an unbiased estimate of set similarity, with less variance than `2 * m` independent minima. ROWS values make a
   band; the number of bands is such that a pair at the threshold shares no band with a chance under MISS.
   All of this is array arithmetic over the bytes of a batch; what leaves is a few numbers per document.
2. Rows with equal sets form a class with a number of its own; from here on only classes count.
3. Of each bucket (classes that share a band) the class with most company in all its buckets is the hub. Each class is
   confirmed on full sets against the hubs of its buckets; equal pairs of many bands count once. The classes around a
   hub are its star: every pair that shares a bucket lies in a star, and a star holds direct neighbours only, so a chain
   of near copies makes many small stars and no large group.
4. What a star leaves open are pairs of classes that no links connect yet. Set distance obeys the triangle inequality,
   so two linked classes differ in their distance to the hub by at most the threshold's distance: a star is split into
   overlapping rings of that width, and only rings with classes of different components go on. From large ones, SAMPLE
   classes are compared with all the others; what is connected with no link by then is settled by comparing all classes
   outside the ring's largest component with every class of the ring.
5. The components of the confirmed links, carried over to the classes' members, are the result.

Comparisons run in tasks of one block of hubs (an inverted index of about VOLUME shingles, or one set if that is
larger) and one chunk of classes of about VOLUME shingles, which are streamed past it; pairs are counted and never
emitted. Rows moved grow with the number of classes, but for rings of many classes that nothing links: those cost
their number times the ring's, divided by the block's size.

Exact: the only chance of a lost link is that no band is shared (under MISS at the threshold, less above it).

Defined results: an empty table gives no rows; a text without words, empty or null, has an empty set, is linked with
nothing and is its own component. Links are between rows: of rows that share an id but not the text, each has the
component of its own text. Repeated rows (same id and text) have the same class. Rows without an id are left out of
links and have no component. Ties between equal sets go to the smallest id. A very long text is hashed in pieces and
streams through a task by itself. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import LONG, buffers, discard, lowered, pieces, slices, small, table, written
from nuntia.llm.components import components

ROWS, MISS = 4, 1e-5
#: Shingles in a block of hubs or a chunk of classes, and for how many a class counts at least, so that short ones are few.
VOLUME, WEIGHT = 1 << 17, 1024
#: Classes of a large ring that are tried first, and when a ring is large.
SAMPLE, LARGE = 64, 512
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(threshold: float) -> int:
    """Number of bands for which a pair at the threshold is missed with a chance under MISS."""
    n = math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))
    return n + n % 2


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mix of 64 bits."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


BYTE = scrambled(np.arange(256, dtype=np.uint64)) | np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all rows, A-Z lowered, and for each row the number of its first word (one more at the end)."""
    n = len(data)
    if n > LONG:
        parts, counts = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = [hashed_words(x, np.array([0, len(x)]))[0] for x in pieces(data[a:b])]
            parts += own
            counts.append(sum(map(len, own)))
        return np.concatenate(parts), np.r_[0, np.cumsum(counts)]
    return hashed_words(data, offsets)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    low = lowered(data)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    prior = np.ones(n, bool)
    prior[1:] = space[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    prior[edges] = True
    begins = np.flatnonzero(~space & prior)
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    last = offsets[1:] - 1
    after[last[(last >= 0) & (np.diff(offsets) > 0)]] = True
    ends = np.flatnonzero(~space & after) + 1
    # polynomial hashes from prefix sums: the base is odd, so it has an inverse modulo 2**64
    up = powers(int(BASE), n)
    down = powers(pow(int(BASE), -1, 1 << 64), n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[low] * up[:n], out=sums[1:])
    words = scrambled((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return words, np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of a shorter text, of all its words as one."""
    words, first = word_hashes(data, offsets)
    if len(words) >= k:
        joined = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            joined = (joined + words[j : j + len(joined)]) * MIX2
            joined ^= joined >> np.uint64(29)
        joined = scrambled(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            part = np.array([b - a], np.uint64)
            for w in words[a:b]:
                part = scrambled(part + w)
            yield part
        else:
            yield np.zeros(0, np.uint64)


def permutations(n: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(hashes: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each function: 2 values per function."""
    low = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(multiply), np.uint32)
    for i in range(0, len(hashes), 2048):  # high halves of products are the well-mixed ones
        values = ((hashes[None, i : i + 2048] * multiply[:, None] + add[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of ROWS signature values; a band mixes minima and maxima of different functions."""
    out = np.arange(bands).astype(np.uint64)
    for j in range(ROWS):
        own = j * bands + (np.arange(bands) + j) % bands  # so that no function gives a band both its values
        out = scrambled(out * GOLD + values[own].astype(np.uint64))
    return out


def signed(documents: DataFrame, k: int, bands: int, id_column: str, text_column: str) -> DataFrame:
    """id, its text's hash, n_shingles, two 64-bit halves of the set's identity, and the band keys (null for an empty set)."""
    functions = permutations(bands * ROWS // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(data, offsets):
                part = offsets[a : b + 1]
                n, s1, s2, keys = [], [], [], []
                for hashes in shingle_sets(data[part[0] : part[-1]], part - part[0], k):
                    n.append(len(hashes))
                    s1.append(int(np.add.reduce(hashes).view(np.int64)))
                    s2.append(int(np.bitwise_xor.reduce(scrambled(hashes * MIX1)).view(np.int64)) if len(hashes) else 0)
                    keys.append(band_keys(signature(hashes, *functions), bands).view(np.int64) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "th", "n_shingles", "s1", "s2", "bands"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("id"), text_column, F.xxhash64(text_column)).mapInArrow(run, f"id {kind}, th long, n_shingles long, s1 long, s2 long, bands array<long>")


class Index:
    """Sets by number, for counting how many elements another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.first = np.r_[self.first, len(every)]
        self.owners = owner[order]

    def shared(self, other: np.ndarray) -> np.ndarray:
        """For every set the number of elements that it shares with another one."""
        at = np.minimum(np.searchsorted(self.keys, other), max(len(self.keys) - 1, 0))
        at = at[self.keys[at] == other] if len(self.keys) else at[:0]
        size = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(at) else at
        return np.bincount(self.owners[places], minlength=len(self.sizes))


class Forest:
    """Union-find over the few ids of a task; keeps only links that join something."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.links: list[tuple] = []

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[x] = y
            self.links.append((a, b))


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = buffers(texts)
    for a, b in slices(data, offsets):
        part = offsets[a : b + 1]
        yield from shingle_sets(data[part[0] : part[-1]], part - part[0], k)


def compared(rows: DataFrame, k: int, percent: int, every_pair: bool) -> DataFrame:
    """Classes against the hubs of their task. rows: task (long), hub (boolean), node, text.

    With every_pair, a row (a, b, linked, ring) for each class and each hub; the ring is their distance in units of the
    threshold's distance. Else the links of a spanning forest of each task. Hubs of a task are held, its classes stream.
    """
    width = max(100 - percent, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, sets, index, forest = None, [], [], None, Forest()
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks, hubs, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.r_[0, np.flatnonzero((tasks[1:] != tasks[:-1]) | (hubs[1:] != hubs[:-1])) + 1, len(tasks)]
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tasks[a] != task:
                    task, names, sets, index, forest = tasks[a], [], [], None, Forest()
                own = sets_of(batch.column(3).slice(a, b - a), k)
                if hubs[a]:
                    names += nodes[a:b].tolist()
                    sets += own
                    continue
                if index is None:
                    index, sets, names = Index(sets), [], np.array(names, np.int64)
                for node, mine in zip(nodes[a:b].tolist(), own, strict=True):
                    both = index.shared(mine)
                    union = index.sizes + len(mine) - both
                    linked = 100 * both >= percent * union
                    if every_pair:
                        ring = 100 * (union - both) // np.maximum(union * width, 1)
                        out += [(node, h, bool(y), int(r)) for h, y, r in zip(names.tolist(), linked, ring, strict=True) if h != node]
                    else:
                        for h in names[linked].tolist():
                            if h != node:
                                forest.join(node, h)
                if forest.links:
                    out += [(*link, True, 0) for link in forest.links]
                    forest.links = []
            if out:
                a, b, linked, ring = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(ring, pa.int32())], names=["a", "b", "linked", "ring"])

    dealt = rows.select("task", "hub", "node", "text").repartition("task").sortWithinPartitions("task", F.desc("hub"))
    return dealt.mapInArrow(run, "a long, b long, linked boolean, ring int")


def tasks_of(groups: DataFrame, members: DataFrame, hubs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for compared(). groups: grp, blocks, chunks; members and hubs: grp, node; texts: node, text.

    A hub lies in one block of its group and goes to every chunk; a class lies in one chunk and goes to every block.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n))
    groups = small(groups)
    held = hubs.join(groups, "grp").select("grp", place("blocks", 1).alias("block"), upto("chunks").alias("chunk"), F.lit(True).alias("hub"), "node")
    streamed = members.join(groups, "grp").select("grp", upto("blocks").alias("block"), place("chunks", 2).alias("chunk"), F.lit(False).alias("hub"), "node")
    rows = held.unionByName(streamed)
    return rows.join(texts, "node").select(F.xxhash64("grp", "block", "chunk").alias("task"), "hub", "node", "text")


def parts(shingles: Column) -> Column:
    """In how many blocks or chunks classes with so many shingles in all are dealt; a class counts for WEIGHT at least."""
    return F.ceil(shingles / VOLUME).cast("long")


def star_links(stars: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """All that the stars (hub, node) settle: a, b, linked, ring of every pair."""
    weighed = texts.select("node", F.greatest("n_shingles", F.lit(WEIGHT)).alias("weight"))
    groups = written(stars.join(weighed, "node").groupBy(F.col("hub").alias("grp")).agg(parts(F.sum("weight")).alias("chunks")).withColumn("blocks", F.lit(1).cast("long")), "tasks")
    hubs = groups.select("grp", F.col("grp").alias("node"))
    out = written(compared(tasks_of(groups, stars.select(F.col("hub").alias("grp"), "node"), hubs, texts), k, percent, True), "stars")
    discard(groups)
    return out


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (grp, node, weight) with the component of each node, of the groups that hold more than one component."""
    found = components(links)
    known = members.join(small(found.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left")
    known = written(known.select("grp", "node", "weight", F.coalesce("component", "node").alias("label")), "labels")
    discard(found)
    open_ = known.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("grp")
    out = written(known.join(small(open_), "grp", "left_semi"), "open")
    discard(known)
    return out


def ring_links(stars: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of a star other than its hub, as far as they connect more than the stars do."""
    links = stars.where("linked").select("a", "b")
    weighed = texts.select("node", F.greatest("n_shingles", F.lit(WEIGHT)).alias("weight"))
    rings = stars.select(F.col("a").alias("node"), F.explode(F.array(F.xxhash64("b", "ring"), F.xxhash64("b", F.col("ring") + 1))).alias("grp"))
    members = labelled(rings.join(weighed, "node").select("grp", "node", "weight"), links)
    more = []
    large = members.groupBy("grp").agg(F.count("*").alias("n"), parts(F.sum("weight")).alias("chunks")).where(F.col("n") > LARGE)
    large = written(large.withColumn("share", F.ceil(F.col("n") / SAMPLE).cast("long")), "large")
    if not large.isEmpty():
        some = members.join(small(large), "grp")
        tried = written(some.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.col("share")) == 0).select("grp", "node", "weight"), "tried")
        groups = tried.groupBy("grp").agg(parts(F.sum("weight")).alias("blocks")).join(large.select("grp", "chunks"), "grp")
        more.append(written(compared(tasks_of(groups, some.select("grp", "node"), tried, texts), k, percent, False).select("a", "b"), "links"))
        again = labelled(members.select("grp", "node", "weight"), links.unionByName(more[0]))
        for t in (tried, members):
            discard(t)
        members = again
    discard(large)
    if not members.isEmpty():
        sizes = members.groupBy("grp", "label").agg(F.sum("weight").alias("w"))
        most = sizes.groupBy("grp").agg(F.max_by("label", F.struct("w", "label")).alias("most"), F.sum("w").alias("all"), F.max("w").alias("largest"))
        groups = written(most.select("grp", "most", parts(F.col("all")).alias("chunks"), parts(F.col("all") - F.col("largest")).alias("blocks")), "tasks")
        rest = members.join(small(groups.select("grp", "most")), "grp").where("label != most").select("grp", "node")
        more.append(written(compared(tasks_of(groups.drop("most"), members.select("grp", "node"), rest, texts), k, percent, False).select("a", "b"), "links"))
        discard(groups)
    discard(members)
    out = links
    for m in more:
        out = out.unionByName(m)
    return out


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, text_hash, n_shingles, component_id (smallest id reachable over links of `percent` similarity) and
    first (whether id and text are those of the component's first row) of every row."""
    bands = bands_for(percent / 100)
    marked = written(signed(documents, k, bands, id_column, text_column), "signed")
    usable, same = F.expr("n_shingles > 0 AND id IS NOT NULL"), ["n_shingles", "s1", "s2"]
    classes = marked.where(usable).groupBy(*same).agg(F.min(F.struct("id", "th")).alias("least"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), *same, "least", "bands"), "classes")
    placed = classes.select("node", F.explode("bands").alias("key"))
    buckets = written(placed.groupBy("key").agg(F.count("*").alias("company")).where("company > 1"), "buckets")
    shared = written(placed.join(small(buckets), "key").select("key", "node", "company"), "shared")
    discard(buckets)
    company = written(shared.groupBy("node").agg(F.sum("company").alias("company")), "company")
    central = shared.select("key", "node").join(small(company), "node")
    hubs = written(central.groupBy("key").agg(F.max_by("node", F.struct("company", F.xxhash64("node"))).alias("hub")), "hubs")
    pairs = written(shared.join(small(hubs), "key").where("node != hub").select("hub", "node").distinct(), "pairs")
    wanted = company.join(classes.select("node", "n_shingles", "least"), "node").select("node", "n_shingles", "least.id", "least.th")
    wanted = written(wanted, "wanted")
    for t in (shared, company, hubs):
        discard(t)
    own = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("th"))
    texts = own.join(small(wanted), ["id", "th"]).select("node", "n_shingles", "text")
    if marked.where(usable).groupBy("id", "th").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])  # repeated rows count once
    texts = written(texts, "texts")
    discard(wanted)
    stars = star_links(pairs, texts, k, percent)
    discard(pairs)
    found = components(ring_links(stars, texts, k, percent))
    discard(texts)
    # from classes to their rows
    of_class = classes.select("node", *same, "least").join(small(found.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left").select(*same, "least", F.coalesce("component", "node").alias("component"))
    first = of_class.groupBy("component").agg(F.min("least").alias("first"))
    of_class = of_class.drop("least").join(first, "component").select(*same, "first")
    out = marked.where(usable).join(of_class, same).select("id", F.col("th").alias("text_hash"), "n_shingles", F.col("first.id").alias("component_id"), (F.struct("id", "th") == F.col("first")).alias("first"))
    alone = marked.where(~F.coalesce(usable, F.lit(False))).select("id", F.col("th").alias("text_hash"), "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(alone).withColumnRenamed("id", id_column)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; three words, 85 percent."""
    found = near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
