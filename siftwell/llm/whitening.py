"""Whitening of embeddings by the leading components of their covariance.

A random basis with some columns more than are sought is multiplied with the covariance again and
again, each time in one pass over all centred rows; the Rayleigh-Ritz values and vectors within the
basis come out of the same pass. Where their residuals stay too large for double precision (the
spectrum is flat), the basis is expanded to the full dimension and one more pass gives all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import id_type, materialize

#: Components, further columns of the random basis, power passes at most, levels of one whole number.
COMPONENTS, OVERSAMPLED, PASSES, SCALE = 4, 8, 4, 256
#: Largest norm of a residual by the gap between its Ritz value and the next: about the error of the vector's direction.
RESIDUAL = 1e-11
#: Eigenvalues below this part of the largest are none but rounding.
ZERO = 1e-12
#: Rows of a matrix in one partial sum, and partial sums that one task adds.
BLOCK, SALTS = 256, 32
LONG = 1 << 63


@dataclass
class Components:
    """What whitening needs: n fitted vectors, their sums (exact), unit eigenvectors (columns), eigenvalues, the trace, passes over the rows."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(embeddings: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``embeddings`` and x, floor(scale * entry) of each entry; rows without a vector of finite numbers go."""
    finite = F.forall(F.col(f"`{vector_col}`"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return embeddings.filter(F.col(f"`{vector_col}`").isNotNull() & finite).withColumn("x", F.transform(f"`{vector_col}`", lambda v: F.floor(v.cast("double") * scale).cast("long")))


def rows_of(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def total(partial: DataFrame) -> dict[int, np.ndarray]:
    """The sums of ``partial`` (block, salt, numbers as bytes) by block: two rounds on executors, one row a block to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = np.frombuffer(data)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield blocks(sums, 0)

    schema = "block int, salt int, numbers binary"
    found = partial.repartition("block", "salt").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema).collect()
    return {r.block: np.frombuffer(bytes(r.numbers)) for r in found}


def blocks(sums: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([salt] * len(sums), pa.int32()), pa.array([v.astype(float).tobytes() for v in sums.values()], pa.binary())], names=["block", "salt", "numbers"])


def covariance_times(fitted: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The covariance of the centred rows times ``basis``, in one pass; tasks send sums of the size of the basis, in blocks of rows."""
    d, width = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(basis.shape)
        seen = False
        for batch in batches:
            c = rows_of(batch, "x", d) - mean
            out += c.T @ (c @ basis)
            seen = True
        if seen:
            yield blocks({k: out[k * BLOCK : (k + 1) * BLOCK].ravel() for k in range(-(-d // BLOCK))}, TaskContext.get().partitionId() % SALTS)

    found = total(fitted.select("x").mapInArrow(run, "block int, salt int, numbers binary"))
    return np.concatenate([found[k] for k in sorted(found)]).reshape(d, width) / n


def counted(fitted: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension: high and low halves are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = rows_of(batch, "x", d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = fitted.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("i").collect()
    return (rows[0].n if rows else 0), [(int(r.high) << 32) + int(r.low) for r in rows]


def ritz(image: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling) and vectors of a covariance within an orthonormal basis, and the norms of their residuals, from its image."""
    small = basis.T @ image
    values, turned = np.linalg.eigh((small + small.T) / 2)
    values, turned = values[::-1], turned[:, ::-1]
    vectors = basis @ turned
    return values, vectors, np.linalg.norm(image @ turned - vectors * values, axis=0)


def fit_components(vectors: DataFrame, components: int = COMPONENTS, oversampled: int = OVERSAMPLED, passes: int = PASSES, seed: int = 5) -> Components | None:
    """The leading components of the distinct vectors ``x`` (arrays of whole numbers of one length); None if there are none."""
    # a vector that many rows have is counted once: copies go before the shuffle
    fitted = materialize(vectors.select("x").distinct(), "vectors")
    first = fitted.select(F.size("x").alias("d")).first()
    d = first.d if first else 0
    if not d:
        return None
    n, sums = counted(fitted, d)
    mean = np.array([s / n for s in sums])
    k, width, done = min(components, d), min(d, components + oversampled), 0
    if width < d:
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
        while done <= passes:
            image = covariance_times(fitted, mean, basis, n)
            done += 1
            values, found, residuals = ritz(image, basis)
            gaps = np.minimum(np.append(np.inf, values[: k - 1] - values[1:k]), values[:k] - values[1 : k + 1])
            # a zero matrix has no direction to be found
            if values[0] <= 0 or (residuals[:k] <= RESIDUAL * gaps).all():
                break
            basis = np.linalg.qr(image)[0]
        else:
            width = d
    if width == d:  # the residuals are too large, or the dimension is small
        basis = np.eye(d)
        image = covariance_times(fitted, mean, basis, n)
        done += 1
        values, found, _ = ritz((image + image.T) / 2, basis)
    found = found[:, :k]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), range(k)])
    return Components(n, sums, found, np.maximum(values[:k], 0), variance(fitted, mean, n), done)


def variance(fitted: DataFrame, mean: np.ndarray, n: int) -> float:
    """The trace of the covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(((rows_of(batch, "x", len(mean)) - mean) ** 2).sum())])], names=["v"])

    return fitted.select("x").mapInArrow(run, "v double").agg(F.sum("v")).first()[0] / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exact; null beyond a long."""
    most = max(abs(n * int(v) - s) for v, s in zip([*x.max(axis=0), *x.min(axis=0)], [*sums, *sums], strict=True)) if len(x) else 0
    if most * most * len(sums) < LONG:
        # whatever overflows on the way comes back, as the result is in range
        with np.errstate(over="ignore"):
            off = x * np.int64(n) - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < LONG else None for v in exact]


def whitened_rows(vectors: DataFrame, model: Components, id_col: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained of each row (id, x) and component."""
    kind, d, k = id_type(vectors, id_col), len(model.sums), model.vectors.shape[1]
    zero = model.values <= ZERO * max(model.values[0], 1e-300)
    onto = model.vectors / np.sqrt(np.where(zero, 1, model.values))
    explained = [None if z or not model.trace else float(v / model.trace) for v, z in zip(model.values, zero, strict=True)]
    mean = model.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, "x", d)
            flat = ((x - mean) @ onto).ravel()
            own = pa.array(np.repeat(np.arange(len(x)), k))
            white = pa.array(flat, mask=np.tile(zero, len(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), pa.array(list(range(1, k + 1)) * len(x), pa.int32()), pa.array([model.n] * len(flat), pa.int64()), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(own), white, pa.array(explained * len(x), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), "x")
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double")


def identity_error(vectors: DataFrame, model: Components) -> float:
    """How far the covariance of the distinct whitened vectors is from the identity, measured on them."""
    kept = model.values > ZERO * max(model.values[0], 1e-300)
    if not kept.any():
        return 0.0
    onto, mean, d = (model.vectors / np.sqrt(np.where(kept, model.values, 1)))[:, kept], model.mean, len(model.sums)
    width = onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width + 1, width))
        for batch in batches:
            w = (rows_of(batch, "x", d) - mean) @ onto
            out += np.vstack([w.T @ w, w.sum(axis=0)])
        if out.any():
            yield blocks({0: out.ravel()}, TaskContext.get().partitionId() % SALTS)

    found = total(vectors.select("x").distinct().mapInArrow(run, "block int, salt int, numbers binary"))[0].reshape(width + 1, width) / model.n
    return float(np.abs(found[:width] - np.outer(found[width], found[width]) - np.eye(width)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``embeddings`` and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry counts as floor(scale * entry), which saturates at the range of a long. Rows whose vector is
    null or holds nulls or numbers that aren't finite go. The components are those of the distinct vectors;
    rows and ids may repeat or be null, each row is returned. Vectors of another length than most distinct
    ones (of the longer, in a tie) go, and so do empty ones. There are as many components as dimensions at
    most; of one without variance whitened and explained are null, and it doesn't count for identity_error.
    deviation is null beyond the range of a long. Equal eigenvalues: any of their vectors. No rows: no rows.
    Other columns are not read, so their names can't clash.
    """
    x = whole_vectors(embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding")), "embedding", scale).drop("embedding")
    lengths = x.select("x").distinct().groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    kind = id_type(embeddings, id_col)
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    x = x.filter(F.size("x") == lengths.d)
    model = fit_components(x, components)
    return whitened_rows(x, model, "vec_id").withColumn("identity_error", F.lit(identity_error(x, model)))
