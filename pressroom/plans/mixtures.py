"""Gaussian mixtures with full covariances: a whole grid of fits in shared passes over the table.

One pass carries the statistics of every component of every fit that still moves: a task adds up its rows' weighted
counts, sums and cross products, Spark adds up the tasks, and the driver receives one row per component. So the reads of the table are
those of the slowest fit, whatever the number of settings. Each fit starts from k-means, whose first centres are drawn far apart (by
races that hash the rows, hence the same under any partitioning), and goes on with expectation-maximisation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.session import cut_lineage

#: Added to the diagonal of every covariance.
FLOOR = 1e-6
TINY = 10 * np.finfo(np.float64).eps
#: Rows whose densities are made at once, and numbers of a row in one block of components: what a core's cache holds.
CHUNK, BLOCK = 256, 600
VALUES, HASH = "values", "hash"


def parameter_count(k: int, d: int) -> int:
    return (k - 1) + k * d + k * d * (d + 1) // 2


def bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    return -2 * log_likelihood + parameter_count(k, d) * math.log(n)


@dataclass
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d), and the log-likelihood of the rows they were fitted on."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = math.nan
    converged: bool = False
    passes: int = 0
    _whitening: tuple | None = field(default=None, repr=False)

    @property
    def k(self) -> int:
        return len(self.weights)

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each component the matrix that makes its covariance the identity, and the constant of its log-density."""
        if self._whitening is None:
            d = self.means.shape[1]
            factors = np.linalg.cholesky(self.covariances)
            inverse = np.linalg.inv(factors).transpose(0, 2, 1)
            logs = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
            with np.errstate(divide="ignore"):
                constant = np.log(self.weights) - logs - 0.5 * d * math.log(2 * math.pi)
            self._whitening = inverse, constant
        return self._whitening

    def log_densities(self, rows: np.ndarray) -> np.ndarray:
        """Weighted log-densities (n, k) of the rows by the components."""
        inverse, constant = self.whitening()
        white = np.matmul((rows[:, None, :] - self.means).transpose(1, 0, 2), inverse)
        return constant - 0.5 * (white * white).sum(axis=2).T

    def predict(self, rows: np.ndarray) -> np.ndarray:
        labels = [self.log_densities(rows[i : i + CHUNK]).argmax(axis=1) for i in range(0, len(rows), CHUNK)]
        return np.concatenate(labels) if labels else np.zeros(0, dtype=np.int64)


def matrix(values: pd.Series, d: int) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64).reshape(-1, d)


def chunks(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        rows = batch.column(VALUES).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        hashes = batch.column(HASH).to_numpy(zero_copy_only=False).view(np.uint64)
        for low in range(0, len(rows), CHUNK):
            yield rows[low : low + CHUNK], hashes[low : low + CHUNK]


@dataclass(frozen=True)
class Stack:
    """Many mixtures side by side, with their components numbered through. A pass then takes a few matrix products, whatever their number."""

    starts: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    #: About ``means.mean(axis=0)``: (d + 1, components * d), the last row for a column of ones. Not there for k-means.
    whitening: np.ndarray | None = None
    constants: np.ndarray | None = None

    @staticmethod
    def of(models: Sequence[Mixture], whitened: bool) -> Stack:
        sizes = np.array([m.k for m in models])
        means = np.concatenate([m.means for m in models])
        starts = np.cumsum(sizes) - sizes
        if not whitened:
            return Stack(starts, sizes, means)
        inverse = np.concatenate([m.whitening()[0] for m in models])
        moved = np.einsum("kd,kde->ke", means - means.mean(axis=0), inverse)
        k, d = means.shape
        flat = np.concatenate([inverse.transpose(1, 0, 2).reshape(d, k * d), -moved.reshape(1, k * d)])
        return Stack(starts, sizes, means, flat, np.concatenate([m.whitening()[1] for m in models]))

    def squares(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances (n, components) from the means, in units of the covariances if these are there."""
        (n, d), k = rows.shape, len(self.means)
        found = np.empty((n, k))
        ones = None if self.whitening is None else np.hstack([rows - self.means.mean(axis=0), np.ones((n, 1))])
        step = max(1, BLOCK // d)
        for low in range(0, k, step):
            high = min(k, low + step)
            if ones is None:
                away = rows[:, None, :] - self.means[low:high]
            else:
                away = (ones @ self.whitening[:, low * d : high * d]).reshape(n, high - low, d)
            found[:, low:high] = np.einsum("nkd,nkd->nk", away, away)
        return found


Weigh = Callable[[Stack, np.ndarray], tuple[np.ndarray, np.ndarray]]


def soft(stack: Stack, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of every component in each row (n, components), and the log-likelihood of the rows by each mixture."""
    logs = stack.constants - 0.5 * stack.squares(rows)
    top = np.maximum.reduceat(logs, stack.starts, axis=1)
    shares = np.exp(logs - np.repeat(top, stack.sizes, axis=1))
    total = np.add.reduceat(shares, stack.starts, axis=1)
    return shares / np.repeat(total, stack.sizes, axis=1), (top + np.log(total)).sum(axis=0)


def hard(stack: Stack, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``soft``, for k-means: each row belongs to the nearest mean; its fit is the squared distance, negative."""
    squares = stack.squares(rows)
    shares = np.zeros(squares.shape)
    for start, size in zip(stack.starts, stack.sizes):
        shares[np.arange(len(rows)), start + squares[:, start : start + size].argmin(axis=1)] = 1.0
    return shares, -np.minimum.reduceat(squares, stack.starts, axis=1).sum(axis=0)


def one_pass(table: DataFrame, models: Sequence[Mixture], weigh: Weigh, d: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Of every model: counts (k), sums (k, d) and cross products (k, d, d) about its means, and the total fit."""
    upper = np.triu_indices(d)
    width = 2 + d + len(upper[0])
    stack = Stack.of(models, weigh is soft)
    origin = stack.means.mean(axis=0)
    parts = pa.schema([("fit", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(stack.means), width))
        for rows, _ in chunks(batches, d):
            shares, fits = weigh(stack, rows)
            about = rows - origin
            total[:, 0] += shares.sum(axis=0)
            total[stack.starts, 1] += fits
            total[:, 2:] += shares.T @ np.hstack([about, about[:, upper[0]] * about[:, upper[1]]])
        cells = [total[start : start + size].ravel() for start, size in zip(stack.starts, stack.sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, parts.field(1).type)], schema=parts)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for fit, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = sums.values.to_numpy()
                held[fit] = held[fit] + cells if fit in held else cells
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), parts.field(1).type)], schema=parts)

    # A wide SQL aggregate of some hundred sums costs seconds of planning and compiling in every pass; these are arrays.
    kind = "fit int, sums array<double>"
    tasks = min(len(models), max(1, table.sparkSession.sparkContext.defaultParallelism))
    summed = table.mapInArrow(add, kind).repartition(tasks, "fit").mapInArrow(merged, kind).toArrow()
    by_fit = dict(zip(summed.column("fit").to_pylist(), summed.column("sums")))
    every = np.concatenate([by_fit[i].values.to_numpy().reshape(-1, width) for i in range(len(models))])
    found = []
    for model, start in zip(models, stack.starts):
        part = every[start : start + model.k]
        counts, sums, products = part[:, 0], part[:, 2 : 2 + d], np.zeros((model.k, d, d))
        products[:, upper[0], upper[1]] = part[:, 2 + d :]
        products[:, upper[1], upper[0]] = part[:, 2 + d :]
        # From the common origin to the component's own mean.
        move = model.means - origin
        crossed = move[:, :, None] * sums[:, None, :]
        products = products - crossed - crossed.transpose(0, 2, 1) + counts[:, None, None] * move[:, :, None] * move[:, None, :]
        found.append((counts, sums - counts[:, None] * move, products, float(part[0, 1])))
    return found


def improved(model: Mixture, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, floor: float) -> Mixture:
    """The mixture that the statistics of a pass with ``model`` ask for."""
    held = counts + TINY
    moved = sums / held[:, None]
    spread = products / held[:, None, None] - moved[:, :, None] * moved[:, None, :]
    d = sums.shape[1]
    # A component that holds no row keeps its mean; rounding must not leave a negative variance.
    values, vectors = np.linalg.eigh(spread)
    spread = np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, 0.0), vectors)
    return Mixture(held / held.sum(), model.means + moved, spread + floor * np.eye(d))


def spread_hash(hashes: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) from a row's hash, a seed and a turn."""
    z = hashes + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def first_centres(table: DataFrame, seeds: Sequence[int], most: int, d: int) -> dict[int, np.ndarray]:
    """Of every seed ``most`` rows, each drawn with a chance in proportion to its squared distance from those before.

    One pass per centre serves all seeds. Each row runs a race whose time is exponential with that chance as its rate; the
    first of the race is the draw. Where all rows are centres already, the first one is repeated.
    """
    chosen: dict[int, list[np.ndarray]] = {seed: [] for seed in seeds}
    for turn in range(most):
        known = {seed: np.array(rows) for seed, rows in chosen.items()}

        def race(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for rows, hashes in chunks(batches, d):
                for seed, centres in known.items():
                    rate = np.ones(len(rows))
                    if len(centres):
                        rate = ((rows[:, None, :] - centres) ** 2).sum(axis=2).min(axis=1)
                    with np.errstate(divide="ignore"):
                        times = np.where(rate > 0, -np.log(spread_hash(hashes, seed, turn)) / rate, np.inf)
                    first = int(times.argmin())
                    found = (float(times[first]), rows[first].tolist())
                    if np.isfinite(found[0]) and (seed not in best or found < best[seed]):
                        best[seed] = found
            found = [{"seed": s, "time": t, VALUES: v} for s, (t, v) in best.items()]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("seed", pa.int32()), ("time", pa.float64()), (VALUES, pa.list_(pa.float64()))]))

        raced = table.mapInArrow(race, f"seed int, time double, {VALUES} array<double>")
        firsts = raced.groupBy("seed").agg(F.min(F.struct("time", VALUES)).alias("first"))
        drawn = {r["seed"]: np.array(r["first"][VALUES]) for r in firsts.collect()}
        for seed, rows in chosen.items():
            rows.append(drawn[seed] if seed in drawn else rows[0])
    return {seed: np.array(rows) for seed, rows in chosen.items()}


def dealt(table: DataFrame) -> DataFrame:
    """``table`` written once in as many parts as there are cores. A pass costs far more than its bytes, by which a scan would be split."""
    return cut_lineage(table.repartition(max(1, table.sparkSession.sparkContext.defaultParallelism)))


def fit_grid(
    table: DataFrame, settings: Sequence[tuple[int, int]], max_iter: int = 100, tolerance: float = 1e-3, lloyd: int = 10, floor: float = FLOOR
) -> dict[tuple[int, int], Mixture]:
    """A mixture for each (k, seed). ``table`` has ``values`` and ``hash`` (see ``rows_for``); a copy of it is read once per pass.

    A fit has converged when its mean log-likelihood of a row moves by less than ``tolerance``; ``log_likelihood`` is that of
    the mixture returned. The draws of a seed are the same for every k, so fewer centres are the first of more.
    """
    first = table.select(F.size(VALUES)).first()
    if first is None:
        raise ValueError("no rows to fit")
    d, table = first[0], dealt(table)
    n = table.count()
    centres = first_centres(table, sorted({seed for _, seed in settings}), max(k for k, _ in settings), d)
    models = {(k, seed): Mixture(np.full(k, 1 / k), centres[seed][:k].copy(), np.zeros((k, d, d))) for k, seed in settings}

    moving = list(models)
    started: dict[tuple[int, int], Mixture] = {}
    last: dict[tuple[int, int], float] = {}
    for turn in range(lloyd + 1):
        found = one_pass(table, [models[s] for s in moving], hard, d)
        still = []
        for setting, (counts, sums, products, fit) in zip(moving, found):
            model = improved(models[setting], counts, sums, products, floor)
            started[setting] = model
            if turn < lloyd and abs(fit - last.get(setting, -math.inf)) > 1e-4 * max(abs(fit), TINY):
                still.append(setting)
            last[setting] = fit
            models[setting] = model
        moving = still
        if not moving:
            break

    models, moving, last = started, list(started), {}
    for turn in range(max_iter):
        found = one_pass(table, [models[s] for s in moving], soft, d)
        still = []
        for setting, (counts, sums, products, fit) in zip(moving, found):
            model = models[setting]
            model.log_likelihood, model.passes = fit, turn + 1
            if abs(fit - last.get(setting, -math.inf)) < tolerance * n:
                model.converged = True
            elif turn + 1 < max_iter:
                models[setting] = improved(model, counts, sums, products, floor)
                last[setting] = fit
                still.append(setting)
        moving = still
        if not moving:
            break
    return models


def rows_for(df: DataFrame, values: Column) -> DataFrame:
    """What the passes read: ``values`` (array<double>) and a hash of them."""
    return df.select(values.alias(VALUES)).withColumn(HASH, F.xxhash64(VALUES))


MODEL = "component int, weight double, mean array<double>, covariance array<double>"


def as_table(spark: SparkSession, model: Mixture) -> DataFrame:
    """One row per component; covariances row by row."""
    rows = [(i, float(w), m.tolist(), c.ravel().tolist()) for i, (w, m, c) in enumerate(zip(model.weights, model.means, model.covariances))]
    return spark.createDataFrame(rows, MODEL)


def from_table(table: DataFrame) -> Mixture:
    """The mixture that ``as_table`` wrote."""
    rows = table.orderBy("component").collect()
    d = len(rows[0]["mean"])
    covariances = np.array([r["covariance"] for r in rows]).reshape(-1, d, d)
    return Mixture(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), covariances)


def label(model: Mixture, values: Column) -> Column:
    """The component of largest share in each row; of equal ones the first."""
    weights, means, covariances = model.weights, model.means, model.covariances

    @F.pandas_udf("int")
    def predict(rows: pd.Series) -> pd.Series:
        found = Mixture(weights, means, covariances)
        return pd.Series(found.predict(matrix(rows, means.shape[1])), dtype="int32")

    return predict(values)
