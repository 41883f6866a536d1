"""Clustering around centroids with Yinyang bounds, in whole numbers (operator 12).

Vectors are scaled to integers, distances are squared and exact, ties go to the smaller centroid number, and centroids
are exact floors of means, so the result is the same however rows are split among tasks.

Method: Yinyang grouping (Ding et al. 2015).  The centroids are put into groups once, by their first positions.  Each
vector carries its centroid, an upper bound on the distance to it and, for each group, a lower bound on the distance to the
group's other centroids.  When centroids have moved, the bounds move with them by the triangle inequality; a vector whose
upper bound is below all lower ones keeps its centroid, first with the moved upper bound, then with the exact distance.  For
the rest, only groups whose bound is not above it are scanned, exactly, and their bounds set anew.  Bounds are floating point
with a margin far above their rounding, and only save exact distances.

A round reads the vectors with their bounds and writes them with the new ones into the shared folder: nothing is shuffled
but the sums of each task, added up by Spark; K rows of sums reach the driver.  The round before is then removed, so there
are two copies at most, and a lost executor costs the tasks it had.

Defined results: vectors with another number of components than WIDTH, or with a null or non-finite one, are left out, and
so are those with a component beyond LARGEST / SCALE, whose distances may exceed a long.  Repeated rows are vectors of their own; a null
vec_id is hashed as no digits.  With fewer than K vectors there are as many clusters; with none the result is empty.  Other
columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import giving_back
from .workspace import dropped, written

K, GROUPS, ROUNDS, WIDTH, SCALE = 8, 3, 10, 64, 1024
#: Components up to here have squared distances, over WIDTH of them, within a long.
LARGEST = 1 << 27
#: Up to here floating-point products and sums of squares are exact.
_EXACT = 1 << 20
_FAR = np.iinfo(np.int64).max
_STATE = "v binary, cluster int, bounds binary, tally_of int, tally_n long, tally array<long>"


def scaled(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of lists are kept, and their components as integers."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False)
    values = column.filter(pa.array(right)).flatten()
    values = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width) * float(SCALE)
    good = (np.abs(values) <= LARGEST).all(1)  # neither nan nor infinite
    return np.flatnonzero(right)[good], np.floor(values[good]).astype(np.int64)


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of v to every centre."""
    if max(np.abs(v).max(initial=0), np.abs(centres).max(initial=0)) <= _EXACT:
        a, b = v.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centres], axis=1) if len(centres) else np.zeros((len(v), 0), np.int64)


def to_own(v: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((v - centres[own]) ** 2).sum(1)


def grouped(centres: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of every centroid: a few rounds of means over the centroids themselves."""
    groups = min(groups, len(centres))
    points = centres.astype(float)
    middle = points[:groups].copy()
    for _ in range(5):
        of = ((points[:, None] - middle) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                middle[g] = points[of == g].mean(0)
    return of


class Yinyang:
    """Assignment to `centres`, given how far each has moved since the bounds were made."""

    def __init__(self, centres: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.centres, self.group = centres, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        moved = np.sqrt(((centres - (centres if before is None else before)).astype(float) ** 2).sum(1))
        self.moved, self.group_moved = moved, np.array([moved[m].max(initial=0) for m in self.members])
        self.exact = 0  # distances computed

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and bounds of vectors that have none: every distance."""
        d = distances(v, self.centres)
        self.exact += d.size
        own = d.argmin(1)  # of equal ones the first
        rows = np.arange(len(v))
        best = d[rows, own]
        d[rows, own] = _FAR
        lower = [np.sqrt(d[:, m].min(1, initial=_FAR)) for m in self.members]
        return own, np.stack([np.sqrt(best), *lower], axis=1)

    def again(self, v: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and bounds after the centroids have moved."""
        own, upper, lower = own.copy(), bounds[:, 0] + self.moved[own], bounds[:, 1:] - self.group_moved
        may = lambda low, up: low <= up * (1 + 1e-9) + 1e-6
        open_ = np.flatnonzero(may(lower.min(1), upper))
        best = to_own(v[open_], self.centres, own[open_])
        self.exact += len(open_)
        upper[open_] = np.sqrt(best)
        still = may(lower[open_].min(1), upper[open_])
        open_, best = open_[still], best[still]
        for g, members in enumerate(self.members):
            at = np.flatnonzero(may(lower[open_, g], upper[open_]))
            rows = open_[at]
            if not len(rows) or not len(members):
                continue
            d = distances(v[rows], self.centres[members])
            self.exact += d.size
            d[members == own[rows][:, None]] = _FAR  # the bound is one on the others
            nearest = d.argmin(1)
            low, name = d[np.arange(len(rows)), nearest], members[nearest]
            wins = (low < best[at]) | (low == best[at]) & (name < own[rows])
            d[np.arange(len(rows))[wins], nearest[wins]] = _FAR
            lower[rows, g] = np.sqrt(d.min(1))
            won, at = rows[wins], at[wins]
            left = self.group[own[won]]  # the centroid that was left is now one of the others
            lower[won, left] = np.minimum(lower[won, left], np.sqrt(best[at]))
            own[won], best[at] = name[wins], low[wins]
            upper[won] = np.sqrt(low[wins])
        return own, np.column_stack([upper, lower])


def _tallies(sums: np.ndarray, count: np.ndarray, width: int) -> dict[str, pa.Array]:
    k = len(count)
    return {"tally_of": pa.array(np.arange(k), pa.int32()), "tally_n": pa.array(count, pa.int64()), "tally": pa.array(list(sums), pa.list_(pa.int64()))}


def _packed(rows: np.ndarray, kind: str) -> pa.Array:
    data = np.ascontiguousarray(rows.astype(kind))
    size = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(-1, width)


def _rounds(centres: np.ndarray, group: np.ndarray, before: np.ndarray | None, vec_type: pa.DataType):
    """A round over vectors with their bounds, or over plain ones: rows of the new state, and each task's sums last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Yinyang(centres, group, before)
        k, width = centres.shape
        sums, count = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        names = ["vec_id", "v", "cluster", "bounds", "tally_of", "tally_n", "tally"]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unpacked(batch.column("v"), "<i4", width).astype(np.int64)
            if before is None:
                own, bounds = model.first(v)
            else:
                own, bounds = model.again(v, batch.column("cluster").to_numpy().astype(np.int64), _unpacked(batch.column("bounds"), "<f8", len(model.members) + 1))
            for c in np.unique(own):
                sums[c] += v[own == c].sum(0)
            count += np.bincount(own, minlength=k)
            n = len(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), _packed(bounds, "<f8"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        last = _tallies(sums, count, width)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, vec_type), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *last.values()], names)

    return run


def _last(centres: np.ndarray, group: np.ndarray, before: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Yinyang(centres, group, before)
        for batch in batches:
            v = _unpacked(batch.column("v"), "<i4", centres.shape[1]).astype(np.int64)
            if len(v):
                own, _ = model.again(v, batch.column("cluster").to_numpy().astype(np.int64), _unpacked(batch.column("bounds"), "<f8", len(model.members) + 1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(to_own(v, centres, own), pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _plain(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = scaled(batch.column("embedding"), width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), batch.column("key").take(pa.array(rows)), _packed(v, "<i4")], ["vec_id", "key", "v"])

    return run


def moved(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Every centroid's exact floor of the mean of its vectors; one without any stays."""
    width = centres.shape[1]
    told = state.where("tally_of is not null").groupBy("tally_of").agg(F.sum("tally_n").alias("n"), F.array(*[F.sum(F.col("tally")[i]) for i in range(width)]).alias("sums")).collect()  # K rows
    out = centres.copy()
    for r in told:
        if r.n:
            out[r.tally_of] = [s // r.n for s in r.sums]
    return out


def centroid_clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)["vec_id"]
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    source = embeddings.select("vec_id", "embedding", key.alias("key"))
    state = written(source.mapInArrow(giving_back(_plain(width)), f"vec_id {kind}, key string, v binary"), "vectors")
    seeds = state.orderBy("key", "v").limit(k).collect()
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        dropped(state)
        return spark.createDataFrame([], out)
    centres = np.array([np.frombuffer(s.v, dtype="<i4") for s in seeds], dtype=np.int64)
    group, before = grouped(centres, groups), None
    from pyspark.sql.pandas.types import to_arrow_type

    vec_type = to_arrow_type(embeddings.schema["vec_id"].dataType)
    for _ in range(rounds):
        rows = state.select("vec_id", "v") if before is None else state.where("tally_of is null").select("vec_id", "v", "cluster", "bounds")
        new = written(rows.mapInArrow(giving_back(_rounds(centres, group, before, vec_type)), f"vec_id {kind}, {_STATE}"), "round")
        dropped(state)
        state, before = new, centres
        centres = moved(state, centres)
    rows = state.where("tally_of is null").select("vec_id", "v", "cluster", "bounds")
    final = written(rows.mapInArrow(giving_back(_last(centres, group, before)), f"vec_id {kind}, cluster int, distance long"), "clusters")
    dropped(state)
    sums = {r.cluster: r.s for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # K rows
    about = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
