"""Whitening of embeddings by a randomised range finder (Halko, Martinsson, Tropp, 2011).

Entries become integers, so that sums, centred entries and distances from the mean are exact; products are sums of
centred entries. A block of random directions, more than components are wanted, is multiplied by the covariance again and
again, each time by a pass over all centred rows that adds up a matrix of dimensions x directions. After each pass
Rayleigh-Ritz gives components and their residuals. If these don't vanish within the passes (the spectrum falls too
slowly), the block is expanded to all dimensions, for which one pass is exact.

What the driver holds, and tasks get, grows with the dimensions only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written

OVERSAMPLE, PASSES = 10, 4
#: A component is accepted if its residual is at most this share of the gap to its neighbours: the sine of the angle by
#: which it can be wrong.
TOLERANCE = 1e-12
#: Components of less variance than this share of the largest are rounding.
LEAST_VARIANCE = 1e-12
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 53)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x: floor(64 * c) + 1000000 of each entry c. Vectors that are null, empty, hold null or non-finite entries,
    or have another length than most (of equally frequent ones the longer) are dropped. 64 * c beyond 2^53 counts as
    2^53."""
    e = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = e.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    scaled = F.transform("e", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))) + F.lit(SHIFT).cast("long"))
    return e.where(F.size("e") == (usual.d if usual else 0)).select("vec_id", scaled.alias("x"))


class Centre:
    """n rows whose sums by dimension are `sums`: centred entries of others, exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.most = n, sums, max(map(abs, sums), default=0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, of longs where these hold them, else of Python's integers."""
        if self.n * int(np.abs(x).max(initial=0)) + self.most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - mean, rounded once."""
        return (self.scaled(x) / self.n).astype(np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(fit: DataFrame, of, cells: int) -> np.ndarray:
    """The sum, over all rows of all partitions, of the `cells` numbers that of(matrix of rows) gives."""

    def run(batches):
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch["x"])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int64)), pa.array(total)], ["cell", "value"])

    found = np.zeros(cells)
    for r in fit.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():
        found[r.cell] = r.value
    return found


def centre_of(fit: DataFrame) -> Centre:
    """Exact sums, whatever their size."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch["x"])
            if len(x):
                n += len(x)
                part = x.sum(axis=0) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                total = part.astype(object) if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total]), pa.array([n] * len(total), pa.int64())], ["dim", "s", "n"])

    parts = fit.select("x").mapInArrow(run, "dim int, s string, n long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    rows = sorted(parts.collect())
    return Centre(rows[0].n if rows else 0, [int(r.s) for r in rows])


def principal(fit: DataFrame, centre: Centre, k: int, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(eigenvalues, unit eigenvectors as columns, the trace, whether all dimensions were needed) of the covariance of
    fit (x), divisor n: the k largest at most, those of no variance left out. The largest entry of a vector is positive."""
    d = len(centre.sums)

    def product(block: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.append((c.T @ (c @ block)).ravel(), (c * c).sum())

        found = _summed(fit, of, block.size + 1) / centre.n
        return found[:-1].reshape(block.shape), found[-1]

    width = min(d, k + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    for nth in range(passes + 1):
        if nth == passes and width < d:
            block = np.eye(d)
        whole = block.shape[1] == d
        image, trace = product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        wanted = int((values[:k] > LEAST_VARIANCE * max(values[0], 0)).sum()) if trace > 0 else 0
        vectors = block @ turn[:, :wanted]
        residual = np.linalg.norm(image @ turn[:, :wanted] - vectors * values[:wanted], axis=0)
        gap = np.minimum(np.append(np.inf, values[:-1] - values[1:])[:wanted], np.append(values[:-1] - values[1:], values[-1])[:wanted])
        if whole or (residual <= TOLERANCE * gap).all():
            break
        block = np.linalg.qr(image)[0]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    largest = np.abs(vectors).argmax(axis=0)
    return values[:wanted], vectors * np.sign(vectors[largest, np.arange(wanted)]), trace, whole


def whiten(vectors: DataFrame, k: int = 16, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """vectors (vec_id, embedding; other columns are ignored) as a row for each vector and component: vec_id, component
    (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    Components are fitted on each distinct vector of integers once: n of them. Dropped vectors (see integers) have no
    rows. deviation, the sum over dimensions of (n * x - sum)^2, is exact, and null where a long doesn't hold it.
    Components without variance are left out: with one distinct vector, or none, there are no rows. Repeated rows, and
    rows without an id, are judged each; a third of all rows being alike is pre-aggregated where it is read.
    """
    rows = integers(vectors)
    fit = written(rows.select("x").distinct(), "fit")
    centre = centre_of(fit)
    values, axes, trace, _ = principal(fit, centre, k, oversample, passes) if centre.n > 1 else (np.empty(0), np.empty((len(centre.sums), 0)), 0.0, True)
    kept = len(values)
    scaled = axes / np.sqrt(values)
    error = 0.0
    if kept:
        covariance = _summed(fit, lambda x: (w := centre(x) @ scaled).T @ w, kept * kept).reshape(kept, kept) / centre.n
        error = float(np.abs(covariance - np.eye(kept)).max())
    kind = rows.schema["vec_id"].dataType
    ids, explained, n = to_arrow_type(kind), values / trace if kept else values, centre.n

    def run(batches):
        for batch in batches:
            if not kept or not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            from_mean = centre.scaled(x)
            if from_mean.dtype != object and int(np.abs(from_mean).max()) ** 2 * x.shape[1] >= 1 << 63:
                from_mean = from_mean.astype(object)
            deviation = [s if s < 1 << 63 else None for s in (from_mean * from_mean).sum(axis=1).tolist()]
            white = centre(x) @ scaled
            m, each = len(x), np.repeat(np.arange(len(x)), kept)
            columns = [batch["vec_id"].cast(ids).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)), pa.array(deviation, pa.int64()).take(pa.array(each))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
