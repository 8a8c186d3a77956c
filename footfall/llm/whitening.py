"""Embedding whitening: blockwise QR, bidiagonalisation, dqds and twisted factorisations.

* Entries become integers x = floor(64 * c) + 1000000, so that sums are exact and the centred
  rows are rounded once.
* Each task reduces its centred rows, a block at a time, to the triangle R of their QR
  decomposition; triangles of tasks are stacked and reduced again, a few at a time. R holds all
  that the covariance does, but without squaring it.
* R, whose size is given by the dimension alone, is made bidiagonal by Householder reflections.
  The dqds algorithm finds the bidiagonal's singular values, the smallest first, each to high
  relative accuracy; their squares over n are the eigenvalues.
* For each of the largest ones the shifted matrix is factored from both ends (stationary and
  progressive qd); where the two meet with the smallest residue, the twisted factorisation
  gives the vector without any iteration. Vectors of close values are made orthogonal, by
  inverse iteration where they are not told apart.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from footfall.llm.tables import written

#: Components that are returned at most.
COMPONENTS = 32
#: Fixed values of the rounding to integers.
SCALE, SHIFT = 64, 1_000_000
#: Integers stop here, so that their differences are 64-bit numbers.
LIMIT = 1 << 61
#: Rows of a QR block, and partial results that one task combines.
BLOCK, FAN = 4096, 16

EPS = np.finfo(float).eps

# --- singular values of a bidiagonal matrix -------------------------------------------


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, right): diagonal and superdiagonal of U' matrix right, by Householder
    reflections."""
    work = np.array(matrix, float)
    n = work.shape[1]
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0.0 or not np.abs(x[1:]).max(initial=0.0):
            return None
        v = x / scale
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(work[k:, k].copy())
        if v is not None:
            work[k:, k:] -= 2.0 * np.outer(v, v @ work[k:, k:])
        if k + 1 < n:
            v = reflector(work[k, k + 1 :].copy())
            if v is not None:
                work[k:, k + 1 :] -= 2.0 * np.outer(work[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2.0 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(work).copy(), np.diagonal(work, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One transform: the next q and e, and the least d; it stops at the first negative d."""
    new_q, new_e = [], []
    d = q[0] - shift
    least = d
    for k in range(len(e)):
        if d < 0.0:
            return new_q, new_e, least
        pivot = d + e[k]
        new_q.append(pivot)
        if pivot == 0.0:
            new_e.append(0.0)
            d = q[k + 1] - shift
        else:
            ratio = q[k + 1] / pivot
            new_e.append(e[k] * ratio)
            d = d * ratio - shift
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), in falling order."""
    found: list[float] = []
    tolerance = (16 * EPS) ** 2
    todo = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        if q[0] < q[-1]:  # read from the other end, so that the least converges at the bottom
            q, e = q[::-1], e[::-1]
        estimate = 0.0
        while q:
            if len(q) == 1:
                found.append(moved + max(q[0], 0.0))
                break
            if e[-1] <= tolerance * (moved + q[-1]):
                found.append(moved + max(q.pop(), 0.0))
                e.pop()
                continue
            cut = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= tolerance * moved or e[k] == 0.0), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                estimate = 0.0
                continue
            shift = estimate
            for attempt in range(64):
                new_q, new_e, least = _dqds(q, e, shift)
                if least >= 0.0:
                    break
                # too far: the last d tells how far, if all others were positive
                late = len(new_q) == len(q) and min(new_q[:-1]) > 0.0
                shift = max(0.0, shift + least) if late and attempt == 0 else shift * 0.25
                if attempt > 3 or shift < EPS * estimate:
                    shift = 0.0
            q, e = new_q, new_e
            moved += shift
            # the least d bounds the least value from above, closely so at the end
            estimate = least * (1.0 - min(0.5, 4.0 * math.sqrt(e[-1] / (least + e[-1]))) if least > 0.0 else 0.0)
    return np.sort(np.array(found))[::-1]


# --- vectors --------------------------------------------------------------------------


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of L D L' for the eigenvalue, from its twisted factorisation."""
    n, tiny = len(d), np.finfo(float).tiny
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        pivot = d[i] + s[i] or tiny
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1] or tiny
        ratio = d[i] / pivot
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _solved(d: np.ndarray, low: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """x of (L D L' - value) x = right, up to its length."""
    n, s = len(d), -value
    least = EPS * max(abs(value), np.abs(d).max())
    pivots, down, x = np.empty(n), np.zeros(n), right.copy()
    for i in range(n):
        pivots[i] = d[i] + s
        if abs(pivots[i]) < least:
            pivots[i] = least
        if i + 1 < n:
            down[i] = d[i] * low[i] / pivots[i]
            s = down[i] * low[i] * s - value
            x[i + 1] -= down[i] * x[i]
    x /= pivots
    for i in range(n - 2, -1, -1):
        x[i] -= down[i] * x[i + 1]
    return x / np.linalg.norm(x)


def _residue(d: np.ndarray, low: np.ndarray, value: float, z: np.ndarray) -> float:
    """Length of (L D L' - value) z."""
    lower = z.copy()
    lower[:-1] += low * z[1:]  # L' z
    lower *= d
    out = lower.copy()
    out[1:] += low * lower[:-1]
    return float(np.linalg.norm(out - value * z))


def _vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of one block without zeros in ``b``, as columns."""
    a = np.where(np.abs(a) > EPS * np.abs(a).max(), a, EPS * np.abs(a).max())
    d, low = a * a, b / a[:-1]
    out = np.empty((len(a), len(values)))
    noise = np.random.default_rng(1)
    begin = 0  # of the group of close values
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * values[j - 1]:
            begin = j
        z = _twisted(d, low, value)
        close = out[:, begin:j]
        for attempt in range(10 if close.shape[1] else 0):
            for _ in range(3):
                z = z - close @ (close.T @ z)
                length = np.linalg.norm(z)
                z = z / length if length > 0.0 else noise.standard_normal(len(a))
                if length > 0.5:
                    break
            # what is left of a vector that the others held may be noise: back to the value
            if length > 0.5 and (attempt or _residue(d, low, value, z) < 1e-12 * d.max()):
                break
            z = _solved(d, low, value, z)
        for _ in range(2 if close.shape[1] else 0):
            z = z - close @ (close.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def principal_directions(triangle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, directions as columns) of triangle' triangle / rows."""
    a, b, right = bidiagonal(triangle / math.sqrt(max(rows, 1)))
    largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    small = np.abs(b) <= 4 * EPS * (np.abs(a[:-1]) + np.abs(a[1:])) + EPS * EPS * largest
    edges = [0, *(np.flatnonzero(small) + 1), len(a)]
    values, vectors = [], []
    for begin, end in zip(edges, edges[1:], strict=False):
        of = squared_singular_values(a[begin:end], b[begin : end - 1])
        block = np.zeros((len(a), end - begin))
        if largest and np.abs(a[begin:end]).max() > 0.0:
            block[begin:end] = _vectors(a[begin:end], b[begin : end - 1], of)
        else:
            block[begin:end] = np.eye(end - begin)
        values.append(of)
        vectors.append(block)
    found = np.concatenate(values)
    order = np.argsort(-found, kind="stable")
    directions = right @ np.concatenate(vectors, axis=1)[:, order]
    return found[order], directions


# --- passes over the rows ---------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and entries of the rows whose vector is whole, of the commonest length."""
    c = F.col("embedding")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = embeddings.where(c.isNotNull() & (F.size(c) > 0) & ~bad)
    whole = whole.select("vec_id", c.cast("array<double>").alias("_c"))
    lengths = whole.groupBy(F.size("_c").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    commonest = lengths.limit(1).collect()
    return whole.where(F.size("_c") == (commonest[0]["d"] if commonest else 0))


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """x of every row and dimension."""
    flat = batch.column("_c").flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    x = np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT
    return np.clip(x, -LIMIT, LIMIT).reshape(batch.num_rows, -1)


class Centre:
    """Exact means: x - S / n = (x - whole) - rest / n, with 0 <= rest < n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        parts = [divmod(s, n) for s in sums]
        self.whole = np.array([p[0] for p in parts], np.int64)
        self.rest = [p[1] for p in parts]
        self.share = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.share

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2; None beyond a 64-bit number."""
        apart = x - self.whole
        greatest = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if greatest * greatest * x.shape[1] < 1 << 62:
            y = self.n * apart - np.array(self.rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in apart)
        return [total if total < 1 << 63 else None for total in exact]


def _reduced(rows: DataFrame, begin: Callable, step: Callable, end: Callable, join: Callable) -> bytes | None:
    """``end(state)`` of each task's rows, combined by ``join``, a few tasks' at a time."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = begin()
        for batch in batches:
            if batch.num_rows:
                state = step(state, batch)
        found = end(state)
        if found is not None:
            key = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "part": pa.array([found], pa.binary())})

    def combined(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [int(group["key"].iloc[0]) // FAN], "part": [join(group.sort_values("key")["part"].tolist())]})

    schema = "key bigint, part binary"
    parts = written(rows.mapInArrow(partial, schema), "whitening")
    n = parts.count()
    while n > 1:
        parts = written(parts.groupBy(F.floor(F.col("key") / FAN)).applyInPandas(combined, schema), "whitening")
        n = parts.count()
    return bytes(parts.first()["part"]) if n else None


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of x in each dimension."""

    def step(state: list, batch: pa.RecordBatch) -> list:
        x = _entries(batch)
        safe = int(np.abs(x).max()) * len(x) < 1 << 62
        sums = (x if safe else x.astype(object)).sum(axis=0).tolist()
        held = state[1] or [0] * len(sums)
        return [state[0] + len(x), [a + b for a, b in zip(held, sums, strict=True)]]

    def end(state: list) -> bytes | None:
        return json.dumps(state).encode() if state[0] else None

    def join(parts: list[bytes]) -> bytes:
        found = [json.loads(p) for p in parts]
        return json.dumps([sum(f[0] for f in found), [sum(c) for c in zip(*(f[1] for f in found), strict=True)]]).encode()

    whole = _reduced(rows, lambda: [0, None], step, end, join)
    return tuple(json.loads(whole)) if whole else (0, [])


def triangle(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    d = len(centre.whole)

    def step(state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        x = centre.rows(_entries(batch))
        for begin in range(0, len(x), BLOCK):
            state = np.linalg.qr(np.vstack([state, x[begin : begin + BLOCK]]), mode="r")
        return state

    def join(parts: list[bytes]) -> bytes:
        found = [np.frombuffer(p).reshape(-1, d) for p in parts]
        return np.ascontiguousarray(np.linalg.qr(np.vstack(found), mode="r")).tobytes()

    whole = _reduced(
        rows,
        lambda: np.empty((0, d)),
        step,
        lambda r: np.ascontiguousarray(r).tobytes() if len(r) else None,
        join,
    )
    r = np.zeros((d, d))
    found = np.frombuffer(whole).reshape(-1, d)
    r[: len(found)] = found
    return r


def identity_error(rows: DataFrame, centre: Centre, matrix: np.ndarray) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity."""
    k = matrix.shape[1]
    if not k:
        return None

    def step(state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        w = centre.rows(_entries(batch)) @ matrix
        return state + np.vstack([w.T @ w, w.sum(axis=0)])

    def join(parts: list[bytes]) -> bytes:
        return sum(np.frombuffer(p) for p in parts).tobytes()

    whole = _reduced(rows, lambda: np.zeros((k + 1, k)), step, lambda s: s.tobytes(), join)
    held = np.frombuffer(whole).reshape(k + 1, k) / centre.n
    return float(np.abs(held[:k] - np.outer(held[k], held[k]) - np.eye(k)).max())


NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: its whitened coordinate and the component's share.

    Columns as in ``NAMES``. Rows whose vector is NULL, empty or holds NULL or non-finite entries
    are left out, and so are vectors of another length than the commonest (of ties, the longest).
    Repeated rows and NULL ids count as rows like any other. A component without variance (its
    eigenvalue is zero to working precision) has a NULL ``whitened`` and 0 explained. Entries
    stop at 2 ** 61; a deviation beyond a 64-bit number is NULL. An empty table gives no rows.
    Other columns don't matter.
    """
    rows = usable(embeddings)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double"
    )
    n, sums = totals(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    centre = Centre(n, sums)
    values, directions = principal_directions(triangle(rows, centre), n)
    kept = min(components, len(values))
    share = values / values.sum() if values.sum() > 0 else np.zeros(len(values))
    # no more directions than the rows span
    real = values[:kept] > (len(values) * EPS) ** 2 * values[0] if values[0] > 0 else np.zeros(kept, bool)
    real &= np.arange(kept) < n - 1
    matrix = directions[:, :kept][:, real] / np.sqrt(values[:kept][real])
    error = identity_error(rows, centre, matrix)
    share = np.where(real, share[:kept], 0.0)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                m, x = part.num_rows, _entries(part)
                w = np.full((m, kept), np.nan)
                w[:, real] = centre.rows(x) @ matrix
                each = pa.array(np.repeat(np.arange(m), kept))
                columns = [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, n, np.int64)),
                    pa.array(centre.deviations(x), pa.int64()).take(each),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(share, m)),
                    pa.array([error] * (m * kept), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return rows.mapInArrow(out, schema)
