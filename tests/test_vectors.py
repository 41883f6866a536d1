"""The vector index against all rows: exact answers, recall of the approximate one, classes, ties and odd vectors."""

import numpy as np
import pytest

from spanloom.operators import vectors

SCHEMA = "id long, vector array<double>, label int"


def table(spark, seed=1, n=3000, width=16, groups=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    rows = [(int(i), (middle[i % groups] + 0.4 * rng.normal(size=width)).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(30)]  # ties
    return rows + [(9001, None, 0), (9002, [0.0] * width, 0), (9003, [1.0] * 17, 0), (9004, [float("nan")] * width, 1)]


def brute(rows, asked, k, digits):
    good = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c in rows if v is not None and len(v) == 16 and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    out = []
    for i, q, c in good:
        if i in asked:
            near = [(-np.floor(min(1, max(0, float(q @ v))) * 10**digits + 0.5) / 10**digits, j) for j, v, d in good if d == c and j != i]
            out += [(i, j, -s) for s, j in sorted(near)[:k]]
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark):
    rows = table(spark)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_exact_search_equals_all_rows(spark, made, monkeypatch):
    rows, df = made
    monkeypatch.setattr(vectors, "BLOCK", 50)  # lists of several blocks
    index = vectors.VectorIndex(df, ["label"], lists=30)
    asked = df.where("id % 50 = 0 or id = 5 or id > 9000")
    got = sorted((r.query_id, r.target_id, r.similarity) for r in index.search(asked, 4, 4, probes=2).collect())
    assert got == brute(rows, {i for i, _, _ in rows if i % 50 == 0 or i == 5 or i > 9000}, 4, 4)
    same = sorted((r.query_id, r.target_id, r.similarity) for r in vectors.scanned(asked, df, 4, ["label"], 4).collect())
    assert same == got


def test_recall_of_probes(spark, made):
    rows, df = made
    index = vectors.VectorIndex(df, ["label"])
    asked = df.where("id % 50 = 0")
    near = {(r.query_id, r.target_id) for r in index.search(asked, 10, 6, exact=False).collect()}
    want = {(q, t) for q, t, _ in brute(rows, {i for i, _, _ in rows if i % 50 == 0}, 10, 6)}
    assert len(near & want) / len(want) >= 0.9


def test_more_asked_for_than_there_are(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [-1.0, 0.0], 0), (4, [1.0, 1.0], 1)], SCHEMA)
    index = vectors.VectorIndex(df, ["label"], lists=3)
    got = sorted((r.query_id, r.target_id, round(r.similarity, 9)) for r in index.search(df, 5, probes=1).collect())
    assert got == [(1, 2, 0.0), (1, 3, 0.0), (2, 1, 0.0), (2, 3, 0.0), (3, 1, 0.0), (3, 2, 0.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.VectorIndex(none, ["label"]).search(df, 2).count() == 0
    assert index.search(none, 2).count() == 0
    assert vectors.scanned(none, df, 2, []).count() == vectors.scanned(df, none, 2, []).count() == 0


def test_bounds_leave_lists_out(spark):
    """Tight groups far apart: the second round of the exact way searches few lists."""
    rng = np.random.default_rng(2)
    middle = np.eye(12)
    rows = [(i, (middle[i % 12] + 0.01 * rng.normal(size=12)).tolist(), 0) for i in range(1200)]
    index = vectors.VectorIndex(spark.createDataFrame(rows, SCHEMA), ["label"], lists=12)
    met, real = [], index._met

    def watched(asked, ways, k, digits):
        met.append(ways.count())
        return real(asked, ways, k, digits)

    index._met = watched
    asked = spark.createDataFrame(rows[:24], SCHEMA)
    assert index.search(asked, 3, probes=1).count() == 72
    assert met[0] == 24 and met[1] <= 24
