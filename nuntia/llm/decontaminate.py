"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become sequences of tokens: runs of letters and digits in lower case, and single characters of
scripts that don't part words (Chinese, Japanese, Thai, Lao, Khmer, Burmese). A mask says which
places of a window of tokens count and which are ignored, so windows that differ by substituted tokens at ignored
places hash alike. Hashes of all windows of all items form the test table; hashes of all windows of all texts are
joined with it; around each hit, item and text are laid over each other on the hit's diagonal and compared token
by token. The compared stretch is what of the item lies inside the text, whole or trimmed at both ends to the best stretch, so
parts of items count too. It must hold `least` tokens, or half of the item if that is fewer (but not under FEWEST),
or the whole of an item shorter than that, and at least `percent` of its tokens must agree.

Items of `SHORT` tokens or more are looked for with MASKS, shorter ones with SHORT_MASKS, of four tokens each: of any 5 to
12 tokens of which a fifth at most is replaced, some window of these has a hit. An item of four tokens is found where all
four stand together, and so are items of one to three tokens, each by a mask of its own length. `shortest` (4, if nothing is
said) is the number of tokens that an item needs to be looked for at all: a few ordinary words are no leak.

A hit that only continues the hit before it, on the same diagonal, is never written out: places of a hash are sorted by the
hash of the window before them, and those that agree in it with the text are skipped. So a text and an item that repeat a
token n and m times give n + m diagonals and not n * m hits.

Equal items (same text but for case) are looked for once, by the smallest id; `equal_items` says how many there are,
and item_classes() which.

The texts are read once, whatever the benchmark's size:

* If its windows are at most TABLE_HASHES, by the length of its items, the test table is broadcast: a bit table of its hashes
  drops nearly all windows, the sorted hashes decide about the rest, and nothing is shuffled.
* Larger benchmarks stay on the executors. Their hashes mark at most MOST_BITS bits, which are broadcast; the one pass over
  the texts writes the windows that are marked, and the texts that hold any, by the hash of the text, so that copies are
  one. A shuffle join of these windows with those of the items gives diagonals; text and items are then brought together and
  compared, an item at a time. The fuller the bits, the more texts are written that hold nothing (10^7 hashes let
  about two windows in 10,000 through, 10^8 one in ten, and then all texts are written); results stay exact.

Items longer than PART_CHARS are cut into overlapping parts, of which the best overlap is reported.

Defined results: empty tables, and texts or items that are null, empty or without tokens, give no rows; repeated rows give
repeated results; a very long text is read in pieces; the best overlap of a pair is reported, of equally good ones the first;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nuntia.llm.common import LONG, buffers, discard, lowered, pieces, slices, small, table, written
from nuntia.llm.near_dup import BASE, BYTE, GOLD, MIX2, powers, scrambled

#: 1: the token counts, 0: it is ignored.
MASKS = ("11111", "1110111", "1101011", "11001011", "1101100101")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
TINY_MASKS = ("1", "11", "111")
EVERY_MASK = (*MASKS, *SHORT_MASKS, *TINY_MASKS)
SHORT = 13
LEAST, FEWEST, PERCENT, SLACK, SHORTEST = 13, 8, 80, 20, 4
#: Windows of a benchmark up to which it is broadcast.
TABLE_HASHES = 2_000_000
#: Bits for the hashes of a larger one: so many for each, and at most.
BITS_EACH, MOST_BITS, PROBES = 32, 1 << 29, 3
#: Rows of a batch of windows.
BATCH = 1 << 16
#: Characters of a part of a very long item, and how many two parts share.
PART_CHARS, PART_OVERLAP = 400_000, 2_000
TABLE_BITS = 22
#: First and last characters of scripts that don't part words, all of three bytes in UTF-8.
UNPARTED = (("\u0e00", "\u0eff"), ("\u1000", "\u109f"), ("\u1780", "\u17ff"), ("\u2e80", "\u9fff"), ("\uf900", "\ufaff"))


def single(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces between words begin."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xEF))
    at = at[at + 2 < len(data)]
    if len(at):
        code = ((data[at].astype(np.uint32) & 15) << 12) | ((data[at + 1].astype(np.uint32) & 63) << 6) | (data[at + 2] & 63)
        hit = np.zeros(len(at), bool)
        for first, last in UNPARTED:
            hit |= (code >= ord(first)) & (code <= ord(last))
        out[at[hit]] = True
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of all rows, and each row's first token (one more at the end). Letters are in lower case already."""
    if len(data) > LONG:
        parts, counts = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = [hashed_tokens(x, np.array([0, len(x)]))[0] for x in pieces(data[a:b])]
            parts += own
            counts.append(sum(map(len, own)))
        return np.concatenate(parts), np.r_[0, np.cumsum(counts)]
    return hashed_tokens(data, offsets)


def hashed_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, n = lowered(data), len(data)
    inside = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    alone = np.flatnonzero(single(low))
    cut[alone] = cut[alone + 3] = True
    begins = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
    up, down = powers(int(BASE), n), powers(pow(int(BASE), -1, 1 << 64), n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[low] * up[:n], out=sums[1:])
    return scrambled((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)), np.searchsorted(begins, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows that lie in one row, and their hashes under the mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = np.full(n, np.uint64(number), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            joined = (joined + hashes[i : i + n]) * MIX2
            joined ^= joined >> np.uint64(29)
    joined *= GOLD
    bad = np.zeros(len(hashes) + 1, np.int32)  # +1 where windows begin to cross into a row, -1 where they no longer do
    inner = np.unique(first[1:-1])
    inner = inner[(inner > 0) & (inner < len(hashes))]
    np.add.at(bad, np.maximum(inner - len(mask) + 1, 0), 1)
    np.add.at(bad, inner, -1)
    ok = np.flatnonzero(np.cumsum(bad[:n]) == 0)
    return ok, joined[ok]


def best_stretch(agree: np.ndarray, level: int) -> tuple[int, int]:
    """The stretch with the largest sum of gains, where an agreement gains 100 - level and a mismatch loses level."""
    sums = np.r_[0, np.cumsum(np.where(agree, 100 - level, -level))]
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return begin, end


def continued(at: np.ndarray, keys: np.ndarray, end: int) -> np.ndarray:
    """Each window's hash mixed with that of the window one place before it, or with `end` where there is none."""
    prior = np.full(len(keys), np.uint64(end), np.uint64)
    if len(keys) > 1:
        follows = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        prior[follows] = keys[follows - 1]
    return scrambled(keys * MIX2 ^ scrambled(prior))


def item_windows(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, mask, places, hashes, hashes with the window before) for each mask that items of these lengths are looked for with."""
    size = np.repeat(np.diff(first), np.diff(first))
    for number, mask in enumerate(EVERY_MASK):
        at, keys = windows(hashes, first, mask, number)
        both = continued(at, keys, 1)
        n = size[at]
        own = np.flatnonzero(n >= SHORT if mask in MASKS else (n >= len(TINY_MASKS) + 1) & (n < SHORT) if mask in SHORT_MASKS else n == len(mask))
        if len(own):
            yield number, mask, at[own], keys[own], both[own]


class TestTable:
    """All windows of some items, by hash, with the items' tokens."""

    def __init__(self, items: list, texts: list[str | None]):
        self.items = items
        self.tokens, self.first = tokens(*buffers(pa.array(texts, pa.large_string())))
        self.masks = []
        for number, mask, at, keys, both in item_windows(self.tokens, self.first):
            order = np.lexsort((at, both, keys))
            bits = np.zeros(1 << TABLE_BITS, bool)
            bits[keys >> np.uint64(64 - TABLE_BITS)] = True
            runs = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]])
            by = np.argsort(both[order][runs], kind="stable")
            self.masks.append((mask, number, keys[order], at[order], np.packbits(bits), both[order][runs][by], runs[by], np.diff(np.r_[runs, len(at)])[by]))
        self.spread: list | None = None

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and item positions that share a window, where the windows before them differ."""
        if self.spread is None:
            self.spread = [np.unpackbits(m[4]).astype(bool) for m in self.masks]
        for (mask, number, keys, places, _, pairs, run_at, run_size), bits in zip(self.masks, self.spread, strict=True):
            at, own = windows(hashes, first, mask, number)
            may = np.flatnonzero(bits[own >> np.uint64(64 - TABLE_BITS)])
            if not len(may):
                continue
            low, high = np.searchsorted(keys, own[may], "left"), np.searchsorted(keys, own[may], "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            may, low, high = may[hit], low[hit], high[hit]
            # the places that go on from the window before lie together, and are left out
            prior = np.where((may > 0) & (at[np.maximum(may - 1, 0)] == at[may] - 1), own[np.maximum(may - 1, 0)], np.uint64(0))
            both = scrambled(own[may] * MIX2 ^ scrambled(prior))
            j = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
            same = pairs[j] == both
            skip_at, skip_end = np.where(same, run_at[j], high), np.where(same, run_at[j] + run_size[j], high)
            for a, b in ((low, skip_at), (skip_end, high)):
                size = b - a
                if total := size.sum():
                    yield np.repeat(at[may], size), places[np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)]


def overlaps(data: np.ndarray, offsets: np.ndarray, test: TestTable, least: int, percent: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item number, first token in the row, first token in the item, tokens compared, tokens that agree)."""
    hashes, first = tokens(data, offsets)
    diagonals = []
    for at, place in test.hits(hashes, first):
        row = np.searchsorted(first, at, "right") - 1
        item = np.searchsorted(test.first, place, "right") - 1
        diagonals.append(np.unique(np.stack([row, item, (at - first[row]) - (place - test.first[item])]), axis=1))
    if not diagonals:
        return
    found = {}
    for r, i, d in np.unique(np.concatenate(diagonals, 1), axis=1).T.tolist():
        best = compared(hashes[first[r] : first[r + 1]], test.tokens[test.first[i] : test.first[i + 1]], d, least, percent)
        if best and best[-1] > found.get((r, i), (0,))[-1]:
            found[r, i] = best
    for (r, i), rest in sorted(found.items()):
        yield (r, i, *rest)


def compared(text: np.ndarray, item: np.ndarray, d: int, least: int, percent: int) -> tuple[int, int, int, int] | None:
    """(first token in the text, first token in the item, tokens compared, tokens that agree) of the best overlap on a diagonal."""
    lo, hi = max(0, -d), min(len(item), len(text) - d)  # the item's tokens that lie on a token of the text
    enough = min(len(item), max(FEWEST, min(least, len(item) // 2)))
    if hi - lo < enough:
        return None
    agree = text[lo + d : hi + d] == item[lo:hi]
    found = None
    # a level below percent bridges more mismatches, which may make the stretch too poor; so both are tried, and the whole
    for begin, end in (best_stretch(agree, percent - SLACK), best_stretch(agree, percent), (0, hi - lo)):
        same, n = int(agree[begin:end].sum()), end - begin
        if n >= enough and 100 * same >= percent * n and (found is None or same > found[-1]):
            found = (int(lo + d + begin), int(lo + begin), n, same)
    return found


def item_classes(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item and class_id (smallest id with the same text but for case) of every item with a text."""
    lower = F.lower(text_column)
    own = benchmark.where(F.col(text_column).isNotNull()).select(F.col(item_column).alias("item"), F.sha2(lower.cast("binary"), 256).alias("hash"))
    return own.join(own.groupBy("hash").agg(F.min("item").alias("class_id")), "hash").select("item", "class_id")


def parts(text: str) -> Iterator[tuple[int, str]]:
    """A very long text in parts that share PART_OVERLAP characters at least and begin and end between words where there
    are any: (tokens before the part, part)."""
    begin = 0
    while len(text) - begin > PART_CHARS + PART_OVERLAP:
        end = begin + PART_CHARS + PART_OVERLAP
        yield begin, text[begin:end]
        following = re.compile(r"\s").search(text, begin + PART_CHARS - PART_OVERLAP, begin + PART_CHARS)
        begin = following.end() if following else begin + PART_CHARS
    yield begin, text[begin:]


def count_tokens(text: str) -> int:
    return len(tokens(*buffers(pa.array([text], pa.large_string())))[0])


def item_parts(benchmark: DataFrame, shortest: int, item_column: str, text_column: str) -> DataFrame:
    """item, equal (items with this text), before (tokens before the part), text (of the part, in lower case) of all items
    of `shortest` tokens or more."""
    lower = F.lower(F.col(f"`{text_column}`"))
    classes = benchmark.where(F.col(f"`{text_column}`").isNotNull()).groupBy(lower.alias("text")).agg(F.min(f"`{item_column}`").alias("item"), F.count("*").alias("equal"))
    kind = benchmark.schema[item_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(2).to_pylist()):
                before, prior, out = 0, 0, []
                for begin, part in parts(text):
                    before += count_tokens(text[prior:begin]) if begin else 0
                    prior = begin
                    out.append((before, part))
                if before >= shortest or count_tokens(text) >= shortest:
                    own = [batch.column(c).take(pa.array([row] * len(out))) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out])], names=["item", "equal", "before", "text"])

    return classes.select("item", "equal", "text").mapInArrow(run, f"item {kind}, equal long, before int, text string")


class Marks:
    """A set of hashes as bits, PROBES for each; the number of bits is a power of two."""

    def __init__(self, size: int, at: np.ndarray, words: np.ndarray):
        self.size, self.words = size, np.zeros(size // 64, np.uint64)
        self.words[at] = words.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be in the set."""
        at = np.arange(len(hashes))
        for probe in range(PROBES):
            bit = (hashes[at] >> np.uint64(17 * probe)) & np.uint64(self.size - 1)
            at = at[(self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        return at


def marks(found: DataFrame) -> Marks:
    """The hashes of all windows as bits, put together by the executors; the driver gets at most MOST_BITS / 64 words."""
    size = 1 << 12
    while size < min(MOST_BITS, BITS_EACH * found.count()):
        size *= 2
    probes = F.array(*[F.shiftrightunsigned("hash", 17 * p).bitwiseAND(F.lit(size - 1)) for p in range(PROBES)])
    words = found.select(F.explode(probes).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    return Marks(size, words.column(0).to_numpy(), words.column(1).to_numpy())


def windows_of_items(items: DataFrame) -> DataFrame:
    """hash, both (the hash with that of the window before), part, place of all windows of the items' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(data, offsets):
                span = offsets[a : b + 1]
                hashes, first = tokens(data[span[0] : span[-1]], span - span[0])
                for _, _, at, keys, both in item_windows(hashes, first):
                    row = np.searchsorted(first, at, "right") - 1
                    columns = [pa.array(keys.view(np.int64)), pa.array(both.view(np.int64)), batch.column(0).take(pa.array(a + row)), pa.array((at - first[row]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["hash", "both", "part", "place"])

    return items.select("part", "text").mapInArrow(run, "hash long, both long, part long, place int")


def marked_windows(rows: DataFrame, kind: str, own: Marks) -> DataFrame:
    """One pass over rows of (id, text in lower case): a row with id, key (hash of the text) and text for each text that has a
    marked window, and a row with key, hash, both and at (its place) for each such window."""
    shared = rows.sparkSession.sparkContext.broadcast(own)  # at most MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["nuntia_id", "key", "text", "hash", "both", "at"]
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(data, offsets):
                span = offsets[a : b + 1]
                hashes, first = tokens(data[span[0] : span[-1]], span - span[0])
                keys: dict[int, bytes] = {}
                for number, mask in enumerate(EVERY_MASK):
                    at, found = windows(hashes, first, mask, number)
                    may = shared.value.has(found)
                    both = continued(at, found, 0)[may]
                    row = np.searchsorted(first, at[may], "right") - 1
                    for r in np.unique(row).tolist():
                        if r not in keys:
                            keys[r] = hashlib.blake2b(data[offsets[a + r] : offsets[a + r + 1]].tobytes(), digest_size=16).digest()
                    for lo in range(0, len(may), BATCH):
                        n, part = len(row[lo : lo + BATCH]), slice(lo, lo + BATCH)
                        key = pa.array([keys[r] for r in row[part].tolist()], pa.binary())
                        columns = [pa.array(x) for x in (found[may][part].view(np.int64), both[part].view(np.int64), (at[may] - first[row])[part].astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, batch.column(0).type), key, pa.nulls(n, batch.column(1).type), *columns], names=names)
                if keys:
                    at_rows = pa.array([a + r for r in keys])
                    empty = [pa.nulls(len(keys), t) for t in (pa.int64(), pa.int64(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), pa.array(list(keys.values()), pa.binary()), batch.column(1).take(at_rows), *empty], names=names)

    return rows.mapInArrow(run, f"nuntia_id {kind}, key binary, text string, hash long, both long, at int")


def compared_pairs(texts: DataFrame, pairs: DataFrame, item_kind: str, least: int, percent: int) -> DataFrame:
    """key, nuntia_item, before, text_start, item_start, compared, agreeing, equal_items: best overlaps of texts (key, text) with
    parts of items (key, text, item, equal, before, diagonals). Each text is followed by its items, of which one is held at a time."""
    both = texts.withColumn("diagonals", F.lit(None).cast("array<int>")).unionByName(pairs, allowMissingColumns=True)
    ordered = both.repartition("key").sortWithinPartitions("key", F.col("diagonals").isNotNull())
    names = ["key", "nuntia_item", "before", "text_start", "item_start", "compared", "agreeing", "equal_items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            diagonals, out = batch.column("diagonals"), []
            for a, b in slices(data, offsets):
                span = offsets[a : b + 1]
                hashes, first = tokens(data[span[0] : span[-1]], span - span[0])
                for r in range(b - a):
                    own = hashes[first[r] : first[r + 1]]
                    if not diagonals[a + r].is_valid:
                        text = own.copy()
                        continue
                    best = None
                    for d in sorted(diagonals[a + r].as_py()):
                        found = compared(text, own, d, least, percent)
                        if found and (best is None or found[-1] > best[-1]):
                            best = found
                    if best:
                        out.append((a + r, *best))
            if out:
                at, *numbers = zip(*out, strict=True)
                key, item, before, equal = (batch.column(c).take(pa.array(at)) for c in ("key", "item", "before", "equal"))
                yield pa.RecordBatch.from_arrays([key, item, before, *[pa.array(x, pa.int32()) for x in numbers], equal], names=names)

    return ordered.select("key", "text", "item", "equal", "before", "diagonals").mapInArrow(run, f"key binary, nuntia_item {item_kind}, before int, text_start int, item_start int, compared int, agreeing int, equal_items long")


def by_join(rows: DataFrame, kind: str, items: DataFrame, item_kind: str, least: int, percent: int) -> DataFrame:
    """The overlaps with a benchmark of any size; tables in between are deleted once the result is written."""
    items = written(items.withColumn("part", F.monotonically_increasing_id()), "items")
    found = written(windows_of_items(items), "windows")
    seen = written(marked_windows(rows, kind, marks(found.select("hash").distinct())), "marked")
    # windows that go on from the same window before them are left out, as in TestTable.hits
    places = found.groupBy("hash", F.col("both").alias("item_both"), "part").agg(F.collect_set("place").alias("places"))
    hits = seen.where("hash IS NOT NULL").groupBy("key", "hash", "both").agg(F.collect_set("at").alias("ats")).join(places, "hash").where("both != item_both")
    each = hits.select("key", "part", F.explode("ats").alias("at"), "places").select("key", "part", "at", F.explode("places").alias("place"))
    pairs = written(each.groupBy("key", "part").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals")), "diagonals")
    texts = seen.where("text IS NOT NULL")
    once = texts.select("key", "text").join(small(pairs.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    overlap = compared_pairs(once, pairs.join(small(items), "part").drop("part"), item_kind, least, percent)
    best = F.max_by(F.struct("text_start", (F.col("item_start") + F.col("before")).alias("item_start"), "compared", "agreeing", "equal_items"), F.struct("agreeing", -F.col("before")))
    overlap = written(overlap.groupBy("key", "nuntia_item").agg(best.alias("best")).select("key", "nuntia_item", "best.*"), "best")
    out = written(texts.select("nuntia_id", "key").join(small(overlap), "key").drop("key"), "overlaps")
    for made in (items, found, seen, pairs, overlap):
        discard(made)
    return out


def by_broadcast(rows: DataFrame, schema: str, items: DataFrame, item_type: pa.DataType, least: int, percent: int) -> DataFrame:
    """The overlaps with a benchmark of at most TABLE_HASHES windows: one pass without a shuffle."""
    own = items.collect()
    if not own:
        return rows.sparkSession.createDataFrame([], schema)
    own.sort(key=lambda r: (r["item"] is not None, r["item"] if r["item"] is not None else 0, r["before"], r["text"]))
    shared = rows.sparkSession.sparkContext.broadcast(TestTable([(r["item"], r["before"], r["equal"]) for r in own], [r["text"] for r in own]))
    names = ["nuntia_id", "nuntia_item", "text_start", "item_start", "compared", "agreeing", "equal_items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(data, offsets):
                part = offsets[a : b + 1]
                best: dict = {}
                for r, i, at, start, n, same in overlaps(data[part[0] : part[-1]], part - part[0], test, least, percent):
                    item, before, equal = test.items[i]
                    if same > best.get((r, item), (0,) * 4)[3]:  # parts of one item count as one
                        best[r, item] = (at, start + before, n, same, equal)
                if best:
                    columns = [pa.array(x, pa.int32()) for x in list(zip(*best.values(), strict=True))[:4]]
                    equal = pa.array([x[4] for x in best.values()], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + r for r, _ in best])), pa.array([i for _, i in best], item_type), *columns, equal], names=names)

    return rows.mapInArrow(run, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", shortest: int = SHORTEST) -> DataFrame:
    """id, item, text_start, item_start, compared, agreeing (in tokens), equal_items: the best overlap of each pair that has one."""
    item_type = benchmark.schema[item_column].dataType
    item_kind, kind = item_type.simpleString(), documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(f"`{id_column}`").alias("nuntia_id"), F.lower(f"`{text_column}`"))
    items = item_parts(benchmark, shortest, item_column, text_column)
    # a token takes two characters at least, but in scripts that don't part words
    size = benchmark.agg(F.sum(F.length(f"`{text_column}`"))).first()[0] or 0
    if size // 2 * len(MASKS) <= TABLE_HASHES:
        out = by_broadcast(rows, f"nuntia_id {kind}, nuntia_item {item_kind}, text_start int, item_start int, compared int, agreeing int, equal_items long", items, to_arrow_type(item_type), least, percent)
    else:
        out = by_join(rows, kind, items, item_kind, least, percent)
    return out.withColumnsRenamed({"nuntia_id": id_column, "nuntia_item": item_column})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps between documents and classes of equal benchmark items: one row per pair."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
