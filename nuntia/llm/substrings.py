r"""Substring dedup: words of passages that occurred before are removed, located by repeated-phrase automata.

A window is WINDOW consecutive words of one document. A word goes if a window over it also starts earlier: in a document
of smaller id, or further up in the same one.

1. Anchors. Of the phrases of GRAM words in a window, the one with the smallest hash (the first of several) is its
   anchor, so equal windows have equal anchors, and about one word in seven is one. Anchors that occur once anywhere rule
   out their windows. What is left, a small part of a corpus, is marked in a table of bits, of at most BITS; a second
   table marks anchors with more than HEAVY places. As they fill, the tables let more anchors through than they need
   to, which costs time and no result.
2. Pieces. The windows of one marked anchor are neighbours; their words are a piece, and pieces are dealt to shards by the
   anchor's hash. Windows of heavy anchors are pieces of their own, dealt by the window's hash, and equal ones
   are put together before they are moved: a line or passage that is in every third document stays spread out.
3. Automata. A shard reads its pieces in blocks of bounded size. Windows whose words are equal one by one, at two or more
   places, are confirmed phrases, each with the place where it starts first. Aho-Corasick automata over the words
   of these phrases then stream the pieces and locate every occurrence; one that isn't the first is a repeat.
4. A document gets back which of its windows are first or only ones. The other windows of marked anchors are repeats; words
   under them go. Texts travel to these answers compressed, and only if they have a marked anchor.

Hashes only decide what is compared: phrases are confirmed and located word by word.

Defined results: null and empty texts have no words. Texts shorter than a window lose nothing. White space between words
doesn't count, and is one space in what is kept. Rows that repeat id and text have the same result, none being earlier
than the other; rows that share an id but not the text are documents of their own, in the order of their texts' hashes.
Rows without an id come before all others. An empty table gives no rows; extra columns are ignored, whatever
their names. A text is worked on whole, at some fifteen times its size in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import buffers, discard, slices, table, written
from nuntia.llm.near_dup import BASE, BYTE, GOLD, MIX2, powers, scrambled

WINDOW, GRAM = 20, 8
#: Bits of each table at most, and for each marked anchor; places of an anchor above which its windows are dealt singly.
BITS, BITS_EACH, HEAVY = 1 << 28, 16, 1000
#: Bytes of text hashed at once, and words of pieces and different words in a block (a larger group is a block of its own).
HASHED, BLOCK_WORDS, BLOCK_VOCABULARY = 1 << 18, 1 << 17, 256
#: Stands for a missing id, before all others.
NO_ID = -(1 << 63)


@dataclass
class Texts:
    """Words of several rows: their bytes with one space after each, where each begins and ends there, and each row's first word (one more at the end)."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Texts:
        space = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins = np.flatnonzero(~space & (cut[:-1] | np.r_[True, space[:-1]][: len(data)]))
        ends = np.flatnonzero(~space & (cut[1:] | np.r_[space[1:], True][: len(data)])) + 1
        first = np.searchsorted(begins, offsets)
        sizes = ends - begins
        after = np.cumsum(sizes + 1)
        out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
        into = np.ones(len(out), bool)
        into[after - 1] = False
        out[into] = data[~space]
        return cls(out, after - sizes - 1, after - 1, first)

    def hashes(self) -> np.ndarray:
        """A hash of each word, worked out for runs of words of about HASHED bytes."""
        out, i = np.zeros(len(self.begins), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.begins[i] + HASHED, "right")))
            begins, ends = self.begins[i:j] - self.begins[i], self.ends[i:j] - self.begins[i]
            own = self.data[self.begins[i] : self.ends[j - 1]]
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(BYTE[own] * powers(int(BASE), len(own)), out=sums[1:])
            out[i:j] = scrambled((sums[ends] - sums[begins]) * powers(pow(int(BASE), -1, 1 << 64), len(own) + 1)[begins] + (ends - begins).astype(np.uint64))
            i = j
        return out


def phrases(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        out = (out + words[j : j + len(out)]) * MIX2
        out ^= out >> np.uint64(29)
    return scrambled(out)


def runs(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows by anchor, for all rows: the anchor's hash, the first window and how many follow each other from it on."""
    grams = phrases(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, window - gram + 1):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[:n] == row[window - 1 :]
    change = np.flatnonzero(inside & (np.r_[True, place[1:] != place[:-1]] | np.r_[True, ~inside[:-1]] | np.r_[True, row[1:n] != row[: n - 1]]))
    stop = np.flatnonzero(inside & np.r_[(place[1:] != place[:-1]) | ~inside[1:] | (row[1:n] != row[: n - 1]), True]) + 1
    return best[change], change, stop - change


class Bits:
    """Two sets of hashes as bits of one size, a power of two."""

    def __init__(self, size: int, at: np.ndarray, marked: np.ndarray, heavy: np.ndarray):
        self.size = size
        self.marked, self.heavy = np.zeros(size // 64, np.uint64), np.zeros(size // 64, np.uint64)
        self.marked[at], self.heavy[at] = marked.view(np.uint64), heavy.view(np.uint64)

    def has(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.size - 1)
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """h and n of each anchor with two or more places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in slices(data, offsets, 1 << 22):
                part = offsets[a : b + 1]
                own = Texts.of(data[part[0] : part[-1]], part - part[0])
                found, n = np.unique(runs(own.hashes(), own.first, window, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def tables(found: DataFrame) -> Bits:
    """Bit tables of the anchors, put together by the executors; the driver gets at most BITS / 64 words of each."""
    size = 1 << 12
    while size < min(BITS, BITS_EACH * found.count()):
        size *= 2
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = found.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("marked"), F.bit_or(F.when(F.col("n") > HEAVY, bit).otherwise(F.lit(0).cast("long"))).alias("heavy")).toArrow()
    return Bits(size, *(words.column(i).to_numpy() for i in range(3)))


def marked(own: Texts, words: np.ndarray, bits: Bits, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows whose anchor is marked."""
    hashes, begin, many = runs(words, own.first, window, gram)
    keep = bits.has(bits.marked, hashes)
    return hashes[keep], begin[keep], many[keep]


PIECE = "key long, id long, th long, at int, n long, words binary"


def pieces_of(own: Texts, ids: np.ndarray, hashes: np.ndarray, bits: Bits, window: int, gram: int) -> pa.RecordBatch:
    """Pieces of all rows; equal windows of heavy anchors are one, at their first place."""
    words = own.hashes()
    keys, begin, many = marked(own, words, bits, window, gram)
    heavy = bits.has(bits.heavy, keys)
    row = np.searchsorted(own.first, begin, "right") - 1
    data = own.data.tobytes()
    cut = lambda at, n: [data[i:j] for i, j in zip(own.begins[at].tolist(), own.ends[at + n + window - 2].tolist(), strict=True)]
    light = ~heavy
    found = [(keys[light], row[light], begin[light], np.ones(int(light.sum()), np.int64), cut(begin[light], many[light]))]
    if heavy.any():
        total = many[heavy]
        at = np.repeat(begin[heavy] - (np.cumsum(total) - total), total) + np.arange(total.sum())
        of = np.repeat(row[heavy], total)
        order = np.lexsort((at, hashes[of], ids[of]))
        at, of = at[order], of[order]
        first: dict[bytes, int] = {}
        n = np.zeros(len(at), np.int64)
        texts = cut(at, np.ones(len(at), np.int64))
        for i, text in enumerate(texts):
            n[first.setdefault(text, i)] += 1
        kept = np.flatnonzero(n)
        found.append((phrases(words, window)[at[kept]], of[kept], at[kept], n[kept], [texts[i] for i in kept.tolist()]))
    key, of, at, n = (np.concatenate([f[i] for f in found]) for i in range(4))
    place = (at - own.first[of]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[of]), pa.array(hashes[of]), pa.array(place), pa.array(n), pa.array([t for f in found for t in f[4]], pa.binary())], names=["key", "id", "th", "at", "n", "words"])


Place = tuple[int, int, int]


def located(block: list[dict[bytes, list]], window: int) -> Iterator[tuple[Place, int]]:
    """The places of the block's pieces, each with a mask of the windows that start there first or only.

    block: for each key, its different pieces with their number, first place and words.
    """
    numbers: dict[bytes, int] = {}
    pieces = [(tuple(numbers.setdefault(w, len(numbers)) for w in words), n, first) for group in block for n, first, words in group.values()]
    seen: dict[tuple[int, ...], list] = {}
    for words, n, (id_, th, at) in pieces:
        for j in range(len(words) - window + 1):
            own = seen.setdefault(words[j : j + window], [0, (id_, th, at + j)])
            own[0] += n
            own[1] = min(own[1], (id_, th, at + j))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, (n, first) in seen.items():
        if n > 1:
            automaton.add_word(phrase, first)
    automaton.make_automaton()
    for words, _, (id_, th, at) in pieces:
        mask = (1 << len(words) - window + 1) - 1
        if len(automaton):
            for end, first in automaton.iter(words):
                j = end - window + 1
                if first != (id_, th, at + j):
                    mask &= ~(1 << j)
        yield (id_, th, at), mask


def sharded(pieces: DataFrame, window: int) -> DataFrame:
    """id, th, at, mask of the pieces that hold a window which starts there first or only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict[bytes, list]] = []
        words, vocabulary, key = 0, set(), None

        def results() -> Iterator[pa.RecordBatch]:
            found = [(*place, mask) for place, mask in located(block, window) if mask]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["id", "th", "at", "mask"])

        for batch in batches:
            for own, id_, th, at, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if words >= BLOCK_WORDS or len(vocabulary) >= BLOCK_VOCABULARY:
                        yield from results()
                        block, words, vocabulary = [], 0, set()
                    key, group = own, {}
                    block.append(group)
                known = group.get(text)
                if known is None:
                    parts = text.split(b" ")
                    group[text] = [n, (id_, th, at), parts]
                    words += len(parts)
                    vocabulary.update(parts)
                else:
                    known[0] += n
                    known[1] = min(known[1], (id_, th, at))
        yield from results()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, th long, at int, mask long")


def kept_words(own: Texts, begin: np.ndarray, many: np.ndarray, first: dict[int, int], window: int) -> tuple[int, bytes]:
    """How many words of one row go, and the others, joined by a space. first: by the first window of a piece, which
    windows from there on stay."""
    n = len(own.begins)
    repeat = np.zeros(n + 1, np.int64)
    np.add.at(repeat, begin, 1)
    np.add.at(repeat, begin + many, -1)
    repeat = np.cumsum(repeat[:n]) > 0
    for at, mask in first.items():
        while mask:
            low = mask & -mask
            repeat[at + low.bit_length() - 1] = False
            mask ^= low
    cover = np.zeros(n + window, np.int64)
    starts = np.flatnonzero(repeat)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover[:n]) > 0
    stay = np.repeat(~gone, own.ends - own.begins + 1)
    return int(gone.sum()), own.data[stay].tobytes()[:-1]


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept, the words that stay, joined by a space, for each document."""
    if not 0 < gram <= window <= gram + 62:
        raise ValueError("a window holds at least one phrase of `gram` words, and at most 63 of them")
    texts = documents.select(F.col(id_column).cast("long").alias("given"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_column).alias("th"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = written(anchors(texts, window, gram), "anchors")
    bits = documents.sparkSession.sparkContext.broadcast(tables(found))  # two tables of at most BITS
    discard(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in slices(data, offsets, 1 << 22):
                part = offsets[a : b + 1]
                yield pieces_of(Texts.of(data[part[0] : part[-1]], part - part[0]), ids[a:b], hashes[a:b], bits.value, window, gram)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts, compressed, and their marked windows; of texts without any, the words as they stay."""
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            for a, b in slices(data, offsets, 1 << 22):
                part = offsets[a : b + 1]
                own = Texts.of(data[part[0] : part[-1]], part - part[0])
                _, begin, many = marked(own, own.hashes(), bits.value, window, gram)
                at = np.searchsorted(begin, own.first)
                end = np.r_[own.begins, len(own.data)]
                rows = [pack.compress(own.data[end[i] : end[j]].tobytes()) for i, j in zip(own.first[:-1].tolist(), own.first[1:].tolist(), strict=True)]
                runs_ = [np.stack([begin[i:j] - f, many[i:j]]).astype(np.int32).tobytes() for i, j, f in zip(at[:-1].tolist(), at[1:].tolist(), own.first[:-1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(rows, pa.binary()), pa.array(runs_, pa.binary())], names=["given", "id", "th", "packed", "runs"])

    first = sharded(texts.select("id", "th", "text").mapInArrow(cut, PIECE), window)
    first = first.groupBy("id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("first"))
    rows = texts.mapInArrow(weighed, "given long, id long, th long, packed binary, runs binary").join(first, ["id", "th"], "left").select("given", "packed", "runs", "first")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, gone, kept = [], [], []
            for packed, windows, own_first in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                text = np.frombuffer(unpack.decompress(packed), np.uint8)
                own = Texts.of(text, np.array([0, len(text)]))
                begin, many = np.frombuffer(windows, np.int32).reshape(2, -1).astype(np.int64)
                lost, rest = kept_words(own, begin, many, {f["at"]: f["mask"] for f in own_first or ()}, window) if len(begin) else (0, own.data.tobytes()[:-1])
                counts.append(len(own.begins))
                gone.append(lost)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_column, "n_words", "n_removed", "kept"])

    return rows.mapInArrow(applied, f"`{id_column}` long, n_words long, n_removed long, kept string")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages of 20 words that occurred before, as digests."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
