"""Whitened embeddings: principal components by matrix-free block Lanczos over distributed passes.

1. Vectors become integers, x = floor(256 * c). Each distinct x counts once in the fit list, which is written once; copies are united by partial aggregation before the shuffle.
2. Sums and squared deviations are exact: each task adds integers of any size, and Spark adds the tasks' decimals.
3. The covariance V is never made. A pass over the fit list gives V Q for a block Q of vectors: each task sums (x - S/n)ᵀ((x - S/n) Q) over its rows, and Spark sums the tasks' blocks.
4. Block Lanczos with full reorthogonalisation turns passes into eigenpairs: it ends when the residuals |V y - e y| of the components that are asked for are at rounding level, and restarts with a random direction where a block loses rank.

What reaches the driver are blocks of `dims` rows, never vectors of the table. The shares of variance come from the exact deviations: trace(V) is their sum over n**3.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import numbered, released, renamed, set_up, with_fields, written

SCALE = 256
COMPONENTS = 4
BLOCK = 8
#: Residuals, as a share of the largest eigenvalue, at which a component is found.
RESIDUAL = 2e-14
#: A component whose share of the variance is smaller has none.
NO_VARIANCE = 1e-13


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int = BLOCK, tolerance: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, largest first; unit eigenvectors in columns): the k largest of the symmetric operator `apply`, which takes and gives dims x b blocks.

    Every new block is made orthogonal to all before it, twice. Columns that vanish then (the basis is invariant in their direction) are replaced by random ones, orthogonal too, so nothing is missed; a block has at least k columns, so k equal eigenvalues are found as well.
    """
    rng = np.random.default_rng(seed)
    k = min(k, dims)
    block = min(max(block, k), dims)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = np.zeros((dims, block))
    scale = 0.0
    while True:
        fresh = np.zeros((dims, 0))
        for column in new.T[: dims - basis.shape[1]]:
            before = np.linalg.norm(column)
            while True:
                for _ in range(2):
                    column = column - basis @ (basis.T @ column)
                    column = column - fresh @ (fresh.T @ column)
                left = np.linalg.norm(column)
                if left > 1e-10 * before and left > 1e-13 * scale:
                    break
                column = rng.normal(size=dims)  # a breakdown
                before, scale = np.linalg.norm(column), min(scale, 1.0)
            fresh = np.column_stack([fresh, column / left])
        out = apply(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, out])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        scale = float(np.abs(values).max())
        residual = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        if basis.shape[1] == dims or (len(values) == k and (residual <= tolerance * scale).all()):
            found = basis @ vectors
            return values, found / np.linalg.norm(found, axis=0)
        new = out


def _integers(batches):
    """Of (embedding, kept columns): the kept columns and x as bytes (little-endian 64-bit integers)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column(0)
        size = np.asarray(vectors.value_lengths()).astype(np.int64)
        x = np.floor(SCALE * np.asarray(vectors.flatten()).astype(np.float64)) + 0
        if len(x) and np.abs(x).max() >= 2**62:
            raise OverflowError("an entry is too large for a 64-bit integer after scaling")
        cuts = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(x.astype("<i8").tobytes())])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), packed], [*batch.schema.names[1:], "x"])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of int64 from packed vectors."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    if (size != 8 * dims).any():
        raise ValueError(f"vectors differ in length: {dims} and {int(size[size != 8 * dims][0]) // 8}")
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], "<i8", len(column) * dims, int(first)).reshape(-1, dims)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the sum of (n * x - S)**2, exactly: in 64 bits where they surely hold it, else in integers of any size."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most**2 * max(len(sums), 1) < 2**63:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def _added(fit: DataFrame, add, size: int, kind: str) -> list:
    """The sums over all rows of what add(x column) gives, an array of `size` numbers: added within each task, then by Spark by place."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = add(batch.column(0))
                total = own if total is None else total + own
        if total is not None:
            values = [Decimal(int(v)) for v in total] if kind.startswith("decimal") else total
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(values, pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64())], ["place", "part"])

    rows = fit.select("x").mapInArrow(released(run), f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("whole")).collect()
    found = {r["place"]: r["whole"] for r in rows}
    return [found.get(i, 0) for i in range(size)]


def _exact_sums(dims: int):
    def add(column: pa.Array) -> np.ndarray:
        x = matrix(column, dims)
        own = x.astype(object).sum(0) if len(x) * int(np.abs(x).max(initial=0)) >= 2**63 else x.sum(0).astype(object)
        return np.array([len(x), *own], object)

    return add


def whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict | None:
    """The model of a table of packed vectors (see whiten): n, sums, values and axes of the components, explained shares, identity_error; None if there are no vectors.

    identity_error is the largest absolute entry of the covariance of the fit list's whitened vectors minus the identity, over the components that have variance.
    """
    fit = written(vectors.select("x").distinct(), "whiten-fit")
    first = fit.select((F.octet_length("x") / 8).cast("int").alias("d")).first()
    if first is None:
        return None
    dims = first["d"]
    n, *sums = map(int, _added(fit, _exact_sums(dims), dims + 1, "decimal(38,0)"))
    total = int(_added(fit, lambda c: np.array([sum(deviations(matrix(c, dims), n, sums))], object), 1, "decimal(38,0)")[0])
    mean = np.array([s / n for s in sums])

    def covariance_of(block: np.ndarray) -> np.ndarray:
        def add(column: pa.Array) -> np.ndarray:
            x = matrix(column, dims) - mean
            return (x.T @ (x @ block)).ravel()

        return np.array(_added(fit, add, block.size, "double")).reshape(block.shape) / n

    values, axes = block_lanczos(covariance_of, dims, components) if total else (np.zeros(min(components, dims)), np.eye(dims)[:, : min(components, dims)])
    trace = total / n**3
    shares = values / trace if trace else np.zeros(len(values))
    live = shares > NO_VARIANCE
    project = axes[:, live] / np.sqrt(values[live])
    size = project.shape[1]
    error = 0.0
    if size:
        middle = np.array(_added(fit, lambda c: ((matrix(c, dims) - mean) @ project).sum(0), size, "double")) / n

        def add(column: pa.Array) -> np.ndarray:
            w = (matrix(column, dims) - mean) @ project - middle
            return (w.T @ w).ravel()

        error = float(np.abs(np.array(_added(fit, add, size * size, "double")).reshape(size, size) / n - np.eye(size)).max())
    return {"n": n, "dims": dims, "sums": sums, "mean": mean, "values": values, "axes": axes, "explained": shares, "live": live, "identity_error": error}


def _projected(model_at):
    def run(batches):
        model = model_at.value
        scale = np.sqrt(np.where(model["live"], model["values"], 1.0))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(batch.num_columns - 1), model["dims"])
            w = (x - model["mean"]) @ model["axes"] / scale
            flat = pa.array(w.ravel(), mask=np.tile(~model["live"], len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(deviations(x, model["n"], model["sums"]), pa.int64()), lists], [*batch.schema.names[:-1], "deviation", "w"])

    return run


def whiten(docs: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """Of each row of docs with a usable vector and each component: the columns `keep`, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has null, NaN or infinite entries go; repeated rows and null keys stay. A table without usable vectors, or with empty ones, gives an empty result. There are as many components as dims, if those are
    fewer; a component without variance (all vectors equal, or of lower rank) has whitened null and explained 0. Vectors of different lengths, and deviations beyond 64 bits, raise an error. Other columns aren't read, whatever their names.
    """
    spark = docs.sparkSession
    set_up(spark)
    own, fields = numbered(docs, keep)
    column = F.col(f"`{vector}`")
    usable = column.isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    packed = docs.where(F.coalesce(usable, F.lit(False)) & (F.size(column) > 0)).select(column.cast("array<double>").alias("_vector"), *own)
    packed = written(packed.mapInArrow(released(_integers), with_fields(fields, "x binary")), "whiten-rows")
    model = whitening(packed, vector, components)
    kinds = with_fields(fields, "deviation bigint, w array<double>")
    if model is None:
        return spark.createDataFrame([], with_fields(fields, "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")).toDF(*keep, "component", "n", "deviation", "whitened", "explained", "identity_error")
    model_at = spark.sparkContext.broadcast(model)
    found = packed.mapInArrow(released(_projected(model_at)), kinds)
    found = found.select("*", F.posexplode("w").alias("_place", "whitened"))
    shares = F.array(*[F.lit(float(s)) for s in model["explained"]])
    return found.select(
        *renamed(found, keep),
        (F.col("_place") + 1).cast("int").alias("component"),
        F.lit(model["n"]).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_place")).alias("explained"),
        F.lit(model["identity_error"]).alias("identity_error"),
    )
