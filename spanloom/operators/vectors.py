"""Nearest neighbours by cosine: blocks of rows in numpy, and an inverted-file index with an exact way to search it.

Vectors are scaled to length 1 once.  Rows are compared with a class (null-safe equal columns) only; similarity is
the cosine clamped to 0 and 1, rounded half up if digits are given, and ties go to the smaller target.  A zero or null vector, and one
of another length than its class's lists hold, is near nothing.

The index: centroids are fitted on a bounded sample of rows (SAMPLE, by hash of id); every row is put into the list of its
nearest centroid, and lists into blocks of at most about BLOCK rows, so that a list with a third of all rows is not one task.
A list keeps the largest angle of its rows to the centroid.

Searching: a query first goes to the `probes` lists with the nearest centroids.  That is the approximate answer.  For the
exact one, a list that was left out can hold a row as near as the query's k-th only if the angle to its centroid less the
list's largest angle is small enough (triangle inequality for angles); such lists are searched in a second round, the others cannot
matter.  Every (query, list) pair is searched once, where the list's block is, and hands on at most k rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import dropped, small, written

SAMPLE, LISTS, PROBES, BLOCK = 20_000, 1_024, 8, 20_000
#: Rows that are compared with all queries of a block at once.
TOGETHER = 4_096
#: Added to angles and taken from similarities that prune: far above their rounding.
SLACK = 1e-6


def class_key(on: list[str]) -> Column:
    return F.to_json(F.struct(*on)) if on else F.lit("")


def scaled(vectors: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and those scaled to length 1; of the given or else the most common number of components."""
    if width is None:
        sizes = Counter(len(v) for v in vectors if v is not None and len(v))
        width = max(sizes, key=lambda n: (sizes[n], n), default=1)
    good = np.array([v is not None and len(v) == width for v in vectors], dtype=bool)
    out = np.array([v for v, g in zip(vectors, good, strict=True) if g], dtype=float).reshape(-1, width)
    size = np.sqrt((out * out).sum(1))
    fine = np.isfinite(size) & (size > 0)
    at = np.flatnonzero(good)[fine]
    return at, out[fine] / size[fine, None]


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    x = np.clip(x, 0.0, 1.0)
    return x if digits is None else np.floor(x * 10**digits + 0.5) / 10**digits


def best(names: np.ndarray, vectors: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, digits: int | None) -> Iterator[tuple]:
    """``(query, target, similarity)``: for each query the k nearest of some rows, itself left out."""
    order = np.argsort(names, kind="stable")  # equal similarities then come in order of target
    names, vectors = names[order], vectors[order]
    for at in range(0, len(asked), 512):
        part = asked[at : at + 512]
        held: list[list[tuple]] = [[] for _ in part]
        for low in range(0, len(names), TOGETHER):
            some = names[low : low + TOGETHER]
            near = _rounded(queries[at : at + 512] @ vectors[low : low + TOGETHER].T, digits)
            near[part[:, None] == some[None, :]] = -1.0
            take = min(k, near.shape[1])
            # the k-th similarity of each query; all above it, and of those equal to it the first
            edge = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take]
            for i in range(len(part)):
                hit = np.flatnonzero(near[i] >= max(edge[i], 0.0))
                hit = hit[np.argsort(-near[i][hit], kind="stable")][:take]
                held[i] += [(-near[i][j], some[j]) for j in hit]
        for q, found in zip(part, held, strict=True):
            for s, name in sorted(found)[:k]:
                yield q, name, -s


def scanned(queries: DataFrame, index: DataFrame, k: int, on: list[str], digits: int | None = None) -> DataFrame:
    """``query_id, target_id, similarity``: every row against all queries of its class, which are few and go to every task.

    The caller has checked the size of `queries`.  A task hands on at most k rows for each query.
    """
    asked: dict[str, tuple] = {}
    rows = queries.select("id", "vector", class_key(on).alias("class")).collect()
    for c in sorted({r["class"] for r in rows}):
        mine = [r for r in rows if r["class"] == c]
        at, vectors = scaled([r.vector for r in mine])
        asked[c] = ([mine[i].id for i in at], vectors)
    kind = dict(index.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple]] = {}
        for frame in frames:
            for c, mine in frame.groupby("class", sort=False):
                if c in asked and len(asked[c][0]):
                    at, vectors = scaled(mine["vector"].tolist(), asked[c][1].shape[1])
                    if len(at):
                        names = mine["id"].to_numpy()[at]
                        held.setdefault(c, []).extend(best(names, vectors, np.array(asked[c][0], dtype=names.dtype), asked[c][1], k, digits))
                if len(held.get(c, ())) > 4 * k * len(asked.get(c, ((),))[0]) + 10_000:
                    held[c] = _first(held[c], k)
        for found in held.values():
            yield pd.DataFrame(_first(found, k), columns=["query_id", "target_id", "similarity"])

    found = index.select("id", "vector", class_key(on).alias("class")).mapInPandas(run, f"query_id {kind}, target_id {kind}, similarity double")
    return nearest(found, k)


def _first(found: list[tuple], k: int) -> list[tuple]:
    found.sort(key=lambda r: (r[0], -r[2], r[1]))
    out, last, n = [], None, 0
    for r in found:
        n = n + 1 if r[0] == last else 1
        last = r[0]
        if n <= k:
            out.append(r)
    return out


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("target_id")))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


class VectorIndex:
    """An inverted file over rows ``id, vector`` with class columns; tables in the shared folder."""

    def __init__(self, rows: DataFrame, on: list[str], lists: int | None = None):
        self.on, self.kind = on, dict(rows.dtypes)["id"]
        keyed = rows.select("id", "vector", class_key(on).alias("class"))
        sample = keyed.where("vector is not null").select("vector").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()  # bounded
        at, points = scaled([r.vector for r in sample])
        self.centres = _fitted(points, lists or min(LISTS, max(1, int(np.sqrt(len(points))))))
        centres = self.centres

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                at, vectors = scaled(frame["vector"].tolist(), centres.shape[1])
                if not len(at):
                    continue
                near = vectors @ centres.T
                of = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1.0, 1.0))
                yield pd.DataFrame({"id": frame["id"].to_numpy()[at], "class": frame["class"].to_numpy()[at], "list": of, "angle": angle, "unit": list(vectors)})

        put = written(keyed.mapInPandas(placed, f"id {self.kind}, class string, list int, angle double, unit array<double>"), "placed")
        self.lists = written(put.groupBy("class", "list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")), "lists")
        blocks = self.lists.select("class", "list", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        self.rows = written(put.join(blocks, ["class", "list"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("angle"), "index")
        dropped(put)

    def search(self, queries: DataFrame, k: int, digits: int | None = None, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """``query_id, target_id, similarity``: the k nearest of each query (``id, vector``, class columns)."""
        asked = queries.select(F.col("id").alias("query_id"), "vector", class_key(self.on).alias("class"))
        centres = self.centres

        def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                at, vectors = scaled(frame["vector"].tolist(), centres.shape[1])
                if len(at):
                    angles = np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))
                    yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[at], "class": frame["class"].to_numpy()[at], "unit": list(vectors), "angles": list(angles)})

        asked = written(asked.mapInPandas(told, f"query_id {self.kind}, class string, unit array<double>, angles array<double>"), "asked")
        # the lists of a query's class, which are at most as many as centroids, by angle
        ways = asked.select("query_id", "class", F.posexplode("angles").alias("list", "angle")).join(self.lists, ["class", "list"])
        ways = written(ways.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("angle", "list"))), "ways")
        found = written(self._met(asked, ways.where(F.col("place") <= probes), k, digits), "near")
        if not exact:
            return nearest(found, k)
        # a query with fewer than k rows so far has no bound
        step = F.lit(SLACK if digits is None else SLACK + 10.0**-digits)
        reach = F.when(F.col("s").isNotNull(), F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") - step)))).otherwise(F.lit(np.pi))
        more = ways.where(F.col("place") > probes).join(nearest(found, k).groupBy("query_id").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "query_id", "left")
        # similarities are clamped to 0: then everything may tie
        more = more.where((F.col("angle") - F.col("radius") <= reach + SLACK) | (F.coalesce(F.col("s"), F.lit(0.0)) <= 0))
        return nearest(found.unionByName(self._met(asked, more, k, digits)), k)

    def _met(self, asked: DataFrame, ways: DataFrame, k: int, digits: int | None) -> DataFrame:
        """Queries where the blocks of their lists are."""
        blocks = self.lists.select("class", "list", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK) - 1)).alias("block"))
        left = ways.select("query_id", "class", "list").join(blocks, ["class", "list"]).join(asked.select("query_id", "class", F.col("unit").alias("q")), ["query_id", "class"])
        key = ["class", "list", "block"]

        def run(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(rows):
                return pd.DataFrame({"query_id": [], "target_id": [], "similarity": []})
            found = best(rows["id"].to_numpy(), np.stack(rows["unit"]), queries["query_id"].to_numpy(), np.stack(queries["q"]), k, digits)
            return pd.DataFrame(list(found), columns=["query_id", "target_id", "similarity"])

        # rows of lists that nothing asks for stay where they are
        wanted = written(left.select(*key).distinct(), "wanted")
        rows = self.rows.join(small(wanted), key, "left_semi")
        return left.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(run, f"query_id {self.kind}, target_id {self.kind}, similarity double")


def _fitted(points: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Directions of `lists` centroids: spherical means of a sample, started from its points in their order."""
    if not len(points):
        return np.zeros((1, 1))
    centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)].copy()
    for _ in range(rounds):
        of = (points @ centres.T).argmax(1)
        for c in np.unique(of):
            middle = points[of == c].mean(0)
            size = np.sqrt((middle * middle).sum())
            if size > 0:
                centres[c] = middle / size
    return centres
