"""Whitening of embeddings from an exact integer scatter.

1. Each entry c becomes the integer x = floor(256 * c). Rows are packed into the narrowest integers that hold them, so
   equal vectors are equal bytes, and each distinct vector is kept once: the fit list. Spark drops repeats before the
   shuffle, so a vector that a third of all rows share costs little.
2. Each task subtracts a shift (the rounded mean of its first block) and sums entries and cross-products exactly: numbers
   are cut into limbs of 20 bits, whose products, for blocks of 4,096 rows, are whole numbers below 2**53 that a
   matrix product of doubles gives without rounding; they are put together as integers of any size. The shift is
   then taken back, exactly. What tasks have summed is merged by rows of the matrix, one row of it at a time in memory.
3. With n vectors, their sums S and cross-products XtX, n * XtX - S * St is formed in integers. Only then it becomes
   floating-point, once, rounded once, and is decomposed by eigh.
4. Every row of the input is projected: x - S / n, as an exact integer offset and a fraction, times the eigenvectors, over
   the root of the eigenvalue. A pass over the fit list measures how far the result's covariance is from the identity.

What the driver holds is the matrix, of the square of the vectors' length.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries give nothing; an empty table gives
no rows. Vectors of each length are whitened by themselves. Entries beyond the range of a long have its nearest end. An
eigenvalue of no more than 1e-12 of the largest counts as zero: that component's `whitened` is null, and it has no part
in identity_error (0 if there is no other); `explained` is null if all vectors are the same. A `deviation` beyond a
long is null. Repeated rows each have their result; rows without an id too. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import discard, table, written

SCALE, COMPONENTS = 256, 4
#: Bits of a limb, and rows of a block: products of limbs, summed over a block, stay below 2**53.
LIMB, BLOCK = 20, 4096
#: Eigenvalues up to this share of the largest count as zero.
ZERO = 1e-12
WIDTHS = (np.int16, np.int32, np.int64)
PACKED = "dim int, x binary"


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) as 64-bit integers, the nearest end of their range beyond it."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values)
    high, low = scaled >= 2.0**63, scaled < -(2.0**63)
    out = np.where(high | low, 0, scaled).astype(np.int64)
    out[high], out[low] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold all of it."""
    out: list[bytes] = [b""] * len(x)
    low, high, open_ = x.min(1), x.max(1), np.ones(len(x), bool)
    for width in WIDTHS:
        fits = open_ & (low >= np.iinfo(width).min) & (high <= np.iinfo(width).max)
        for i, row in zip(np.flatnonzero(fits), x[fits].astype(width), strict=True):
            out[i] = row.tobytes()
        open_ &= ~fits
    return out


def unpacked(dims: np.ndarray, rows: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, numbers of the rows of that length and width, and their matrix."""
    if not len(dims):
        return
    sizes = np.array([len(b.as_buffer()) for b in rows], np.int64)
    for dim, size in np.unique(np.stack([dims, sizes], 1), axis=0).tolist():
        at = np.flatnonzero((dims == dim) & (sizes == size))
        data = b"".join(rows[i].as_py() for i in at.tolist())
        width = {np.dtype(w).itemsize: w for w in WIDTHS}[size // dim]
        yield dim, at, np.frombuffer(data, width).reshape(len(at), dim).astype(np.int64)


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, vector): id, dim, x of each row whose vector is whole and finite."""
    for batch in batches:
        vectors = batch.column(1)
        lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == dim)
            values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            finite = np.isfinite(values).all(1)
            at, values = at[finite], values[finite]
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(packed(whole(values)), pa.binary())], names=["id", "dim", "x"])


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as sums of 2 ** (LIMB * i) times doubles that are whole numbers, below 2 ** LIMB and, but the last, not negative."""
    out = []
    while y.size and (y.max() >= 1 << LIMB or y.min() <= -(1 << LIMB)):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def exactly(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any size."""
    return values.astype(np.int64).astype(object)


@dataclass
class Scatter:
    """Number, sums and cross-products of integer vectors, all exact, about a shift."""

    shift: np.ndarray
    n: int = 0
    sums: np.ndarray = field(init=False)
    products: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        d = len(self.shift)
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)

    @classmethod
    def about(cls, x: np.ndarray) -> Scatter:
        """Shifted by about the mean of x."""
        return cls(np.clip(np.rint(x.astype(np.float64).mean(0)), -(2.0**61), 2.0**61).astype(np.int64))

    def add(self, x: np.ndarray) -> None:
        for i in range(0, len(x), BLOCK):
            part = x[i : i + BLOCK]
            self.n += len(part)
            if np.abs(part.astype(np.float64)).max() >= 2.0**61:  # shifted, it might not fit into 64 bits
                y = part.astype(object) - self.shift.astype(object)
                self.sums += y.sum(0)
                self.products += y.T.dot(y)
                continue
            parts = limbs(part - self.shift)
            for a, left in enumerate(parts):
                self.sums += exactly(left.sum(0)) << LIMB * a
                for b, right in enumerate(parts):
                    self.products += exactly(left.T @ right) << LIMB * (a + b)

    def rows(self) -> Iterator[tuple[int, str, list[str]]]:
        """Each row of the matrix without the shift: its number, the sum, the cross-products, as decimal text."""
        shift = self.shift.astype(object)
        sums = self.sums + self.n * shift
        for i in range(len(shift)):
            row = self.products[i] + shift[i] * self.sums + (self.sums[i] + self.n * shift[i]) * shift
            yield i, str(sums[i]), [str(v) for v in row]


SUMMED = "dim int, i int, n long, s string, products array<string>"


def summed(rows: list[tuple]) -> pa.RecordBatch:
    dims, numbers, counts, sums, products = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(numbers, pa.int32()), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(products, pa.list_(pa.string()))], names=["dim", "i", "n", "s", "products"])


def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows of the matrix, for each length of vectors."""
    found: dict[int, Scatter] = {}
    for batch in batches:
        for dim, _, x in unpacked(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
            found.setdefault(dim, None)
            if found[dim] is None:
                found[dim] = Scatter.about(x[:BLOCK])
            found[dim].add(x)
    for dim, own in found.items():
        for i, s, products in own.rows():
            yield summed([(dim, i, own.n, s, products)])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' rows of the matrix, which come one after the other."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            own = found.setdefault((r["dim"], r["i"]), [0, 0, np.zeros(r["dim"], object)])
            own[0] += r["n"]
            own[1] += int(r["s"])
            own[2] += np.array([int(v) for v in r["products"]], object)
    for (dim, i), (n, s, products) in found.items():
        yield summed([(dim, i, n, str(s), [str(v) for v in products])])


@dataclass(frozen=True)
class Whitening:
    """Of vectors of one length: how many were fitted, their sums, the components and their eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Whitening:
        scatter = n * products - np.multiply.outer(sums, sums)
        covariance = (scatter / (n * n)).astype(np.float64)  # quotients of integers, each rounded once
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        return cls(n, sums, vectors, values, float(sum(int(v) for v in scatter.diagonal()) / (n * n)))

    @property
    def usable(self) -> np.ndarray:
        return self.values > ZERO * max(self.values[0], 0.0) if self.values[0] > 0 else np.zeros(len(self.values), bool)

    def offsets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, as integers, and the rest of the mean times n."""
        shift = self.sums // self.n
        if max(np.abs(x.astype(np.float64)).max(), max(abs(int(v)) for v in shift)) < 2.0**61:
            return x - shift.astype(np.int64), self.sums - self.n * shift
        return x.astype(object) - shift, self.sums - self.n * shift

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component; not a number where the eigenvalue is zero."""
        y, rest = self.offsets(x)
        centred = y.astype(np.float64) - (rest / self.n).astype(np.float64)
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, self.usable] = centred @ self.vectors[:, self.usable] / np.sqrt(self.values[self.usable])
        return out

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions, exact; none if it isn't below 2**63."""
        y, rest = self.offsets(x)
        about = (((y.astype(np.float64) * self.n) - rest.astype(np.float64)) ** 2).sum(1)
        if about.max() < 2.0**62:
            return ((y.astype(np.int64) * self.n - rest.astype(np.int64)) ** 2).sum(1).tolist()
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero(about < 2.0**63 * 1.001).tolist():
            exact = sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(y[i], rest, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return out


def fitted(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each length of vectors in the fit list (dim, x)."""
    rows = fit.mapInArrow(scattered, SUMMED).repartition("dim", "i").mapInArrow(merged, SUMMED).collect()
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        own = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["i"])
        products = np.array([[int(v) for v in r["products"]] for r in own], object).reshape(dim, dim)
        out[dim] = Whitening.of(own[0]["n"], np.array([int(r["s"]) for r in own], object), products, components)
    return out


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """For each length, the largest absolute entry of the whitened fit list's covariance less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in unpacked(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                w = np.c_[np.ones(len(x)), models[dim].whitened(x)[:, models[dim].usable]]
                found[dim] = found.get(dim, 0) + w.T @ w
        for dim, sums in found.items():
            i, j = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(sums.ravel())], names=["dim", "i", "j", "value"])

    sums = {dim: np.zeros((1 + int(m.usable.sum()),) * 2) for dim, m in models.items()}
    for r in fit.mapInArrow(run, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        sums[r["dim"]][r["i"], r["j"]] = r["value"]
    out = {}
    for dim, s in sums.items():
        mean = s[0, 1:] / models[dim].n
        covariance = s[1:, 1:] / models[dim].n - np.outer(mean, mean)
        out[dim] = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row and each of the first components: id, component, n, deviation, whitened, explained, identity_error."""
    given = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    kind = given.schema["id"].dataType.simpleString()
    rows = given.mapInArrow(quantised, f"id {kind}, {PACKED}")
    fit = written(rows.select("dim", "x").distinct(), "fit")
    models = fitted(fit, components)
    errors = identity_errors(fit, models)
    discard(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in unpacked(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)):
                model = models[dim]
                k, m = len(model.values), len(at)
                explained = pa.array(np.tile(model.values / model.trace, m)) if model.trace else pa.nulls(m * k, pa.float64())
                columns = [batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))]
                columns += [pa.array(model.whitened(x).ravel(), from_pandas=True), explained, pa.array(np.full(m * k, errors[dim]))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_column)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first four whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))
