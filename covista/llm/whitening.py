"""Op 11: PCA whitening of embeddings from an incremental eigendecomposition.

Vectors become integers by a fixed scale, so counts and sums are exact.  Every task keeps the spectrum of
its vectors (``secular.Spectrum``) and takes each vector in by one centred rank-one update: it solves the
secular equation of the diagonal plus rank-one matrix, with deflation.  Spectra are combined in rounds,
``FAN_IN`` at a time, by successive rank-one updates, one for each eigenpair and one for the means.  At
the end one distributed Rayleigh-Ritz pass over all vectors projects the covariance onto the combined
basis with the exact mean, and the small symmetric matrix is diagonalised: this removes the error that
many updates add up.  A further pass measures the covariance of the whitened vectors.

A task holds one spectrum and one Arrow batch; only matrices of the vectors' width reach the driver and
go back in the tasks' code, so nothing there grows with the rows.

Defined results: rows whose vector is null or holds a null or non-finite entry take no part; a null or
repeated id stays, row by row; shorter vectors are filled up with zeros; entries beyond 2^50 after scaling
are cut to that; components without variance are whitened to 0 and explain 0; vectors narrower than the
wanted components give one component a dimension; ``deviation`` is null where it exceeds 63 bits; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_table, map_batches, shuffle_partitions
from .secular import Spectrum

SCALE, OFFSET = 1024.0, 100_000
MOST = 1 << 50                # size limit of an entry
COMPONENTS = 8
FAN_IN = 16                   # spectra combined by one task
RANK = 1e-13                  # eigenvalues below this share of the trace count as zero
SPECTRUM = "part bigint, n bigint, mean binary, eigenvalues binary, vectors binary"
SUMS = "n bigint, total array<bigint>"
MATRIX = "n bigint, first binary, second binary"
WHITENED = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
            "identity_error double")


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: the rows that take part, with entries floor(SCALE * c) + OFFSET."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(v, lambda c: F.greatest(F.least(F.floor(F.lit(SCALE) * F.least(F.greatest(
        c.cast("double"), F.lit(-float(MOST))), F.lit(float(MOST)))), F.lit(MOST)), F.lit(-MOST)).cast("bigint") + F.lit(OFFSET))
    return vectors.filter(v.isNotNull() & ~bad).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's integer vectors as rows, filled up to ``width``."""
    lists = batch.column("x")
    ends = np.asarray(lists.offsets)
    sizes, flat = np.diff(ends), np.asarray(lists.values)[ends[0]:ends[-1]]
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), OFFSET, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    arrays = [s.mean.tobytes(), s.values.tobytes(), np.ascontiguousarray(s.vectors).tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *[pa.array([a], pa.binary()) for a in arrays]],
        names=["part", "n", "mean", "eigenvalues", "vectors"])


def _spectrum(row: dict) -> Spectrum:
    mean, values = np.frombuffer(row["mean"]), np.frombuffer(row["eigenvalues"])
    s = Spectrum(len(mean))
    s.n, s.mean, s.values = row["n"], mean, values
    s.vectors = np.frombuffer(row["vectors"]).reshape(len(mean), len(mean))
    return s


def _update(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        s = Spectrum(width)
        for batch in batches:
            for x in (_matrix(batch, width) - OFFSET).astype(float):    # the offset moves the mean only
                s.add(x)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now:
                if held:
                    yield _row(now, held)
                now, held = row["part"], _spectrum(row)
            else:
                held.merge(_spectrum(row))
    if held:
        yield _row(now, held)


def spectrum(rows: DataFrame, width: int) -> Spectrum:
    """The spectrum of all rows: one a task, combined in rounds."""
    held = cut_lineage(map_batches(rows, _update(width), SPECTRUM), "spectra")
    parts = held.count()
    while parts > 1:
        number = F.row_number().over(_by_part())                # one row a task, in order
        groups = (held.withColumn("part", F.floor((number - 1) / FAN_IN).cast("bigint")).repartition("part")
                      .sortWithinPartitions("part", "n"))
        more = cut_lineage(map_batches(groups, _combine, SPECTRUM), "spectra")
        drop_table(held)
        held, parts = more, -(-parts // FAN_IN)
    found = held.collect()
    drop_table(held)
    return _spectrum(found[0].asDict())


def _by_part():
    from pyspark.sql import Window
    return Window.orderBy("part")


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch, width)
            n += len(x)
            for at in range(0, len(x), 4096):     # 2^12 entries of 2^50 fit 63 bits
                total = [t + int(s) for t, s in zip(total, x[at:at + 4096].sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))],
                                         names=["n", "total"])

    return run


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    parts = map_batches(rows, _sums(width), "n bigint, total array<string>")
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(width)]
    found = parts.agg(F.sum("n").alias("n"), *sums).first()
    return found["n"], [int(found[f"s{i}"]) for i in range(width)]


class Centre:
    """Exact distances from the mean: n * x - S in integers, of 64 bits where these suffice."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.fits = n, np.array(sums, object), max(map(abs, sums), default=0) < 1 << 62
        self.small = self.sums.astype(np.int64) if self.fits else None

    def times_n(self, x: np.ndarray) -> np.ndarray:
        if self.fits and (not x.size or int(np.abs(x).max()) * self.n < 1 << 62):
            return x * self.n - self.small
        return x.astype(object) * self.n - self.sums

    def away(self, x: np.ndarray) -> np.ndarray:
        return self.times_n(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.times_n(x)
        if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)] if d.shape[1] else [0] * len(x)


def _project(width: int, centre: Centre, basis: np.ndarray):
    """Sums of the projected vectors and of their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = centre.away(_matrix(batch, width)) @ basis
            n += len(y)
            first += y.sum(0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())],
            names=["n", "first", "second"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, first, second = 0, 0.0, 0.0
    for batch in batches:
        for row in batch.to_pylist():
            n += row["n"]
            first, second = first + np.frombuffer(row["first"]), second + np.frombuffer(row["second"])
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())],
            names=["n", "first", "second"])


def projected_covariance(rows: DataFrame, width: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Covariance of all rows in ``basis``, by one pass; partial sums are added in a tree of two levels."""
    k = basis.shape[1]
    parts = map_batches(rows, _project(width, centre, basis), MATRIX)
    few = max(1, round(shuffle_partitions(rows.sparkSession) ** 0.5))
    found = map_batches(map_batches(parts.repartition(few), _add_up, MATRIX).coalesce(1), _add_up, MATRIX).collect()
    first, second = np.frombuffer(found[0]["first"]) / centre.n, np.frombuffer(found[0]["second"]).reshape(k, k) / centre.n
    return second - np.outer(first, first)


def _whiten(width: int, centre: Centre, scaled: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = scaled.shape[1]
        for batch in batches:
            x = _matrix(batch, width)
            n, ids = len(x), batch.column("vec_id")
            again = pa.array(np.repeat(np.arange(n), k), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(again), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                 pa.array(np.full(n * k, centre.n), pa.int64()), pa.array(centre.deviation(x), pa.int64()).take(again),
                 pa.array((centre.away(x) @ scaled).ravel(), pa.float64()), pa.array(np.tile(explained, n), pa.float64()),
                 pa.array(np.full(n * k, error), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``WHITENED``: every row that takes part on each of the leading components."""
    spark = vectors.sparkSession
    rows = cut_lineage(integers(vectors, id_col, vector_col), "integers")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:                                        # no rows, or none with an entry
        return spark.createDataFrame([], WHITENED)
    found = spectrum(rows, width)
    n, sums = exact_sums(rows, width)
    centre = Centre(n, sums)
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    ritz = projected_covariance(rows, width, centre, basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(np.trace(ritz))
    k = min(components, width)
    live = values[:k] > RANK * trace
    e = np.where(live, values[:k], 1.0)
    scaled = np.where(live, (basis @ turn[:, :k]) / np.sqrt(e), 0.0)
    explained = np.where(live, values[:k] / trace, 0.0) if trace > 0 else np.zeros(k)
    error = float(np.abs(projected_covariance(rows, width, centre, scaled) - np.eye(k)).max())
    return map_batches(rows, _whiten(width, centre, scaled, explained, error), WHITENED)
