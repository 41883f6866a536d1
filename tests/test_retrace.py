"""Flows traced again after a change, against full traces of the changed graph."""

import random

from pyspark.sql import functions as F

from spanloom.operators import graph

LABELS = ("Screen", "Endpoint", "Channel", "Symbol", "Symbol", "Gap")
EDGES = ("FETCHES", "CALLS", "PUBLISHES", "SUBSCRIBES", "HANDLES", "DEFINED_IN")
CONFS = ("Confirmed", "InferredWeak", "Gap")


def _random(rng, k):
    """One small graph and a changed one: node labels and edges, each by its key."""
    ids = [f"g{k}.{i}" for i in range(rng.randint(2, 9))]
    edge = lambda: (rng.choice(ids), rng.choice(ids), rng.choice(EDGES))
    nodes = {i: rng.choice(LABELS) for i in ids if rng.random() < 0.95}
    edges = {edge(): rng.choice(CONFS) for _ in range(rng.randint(1, 14))}
    new_nodes, new_edges = dict(nodes), dict(edges)
    for _ in range(rng.randint(0, 2)):
        new_nodes[rng.choice(ids)] = rng.choice(LABELS)
    if rng.random() < 0.2:
        new_nodes.pop(rng.choice(ids), None)
    for _ in range(rng.randint(0, 3)):
        new_edges[edge()] = rng.choice(CONFS)
    for key in rng.sample(sorted(edges), min(len(edges), rng.randint(0, 2))):
        new_edges.pop(key, None)
    return nodes, edges, new_nodes, new_edges


def _chain(name, length):
    ids = [f"{name}.{i:02d}" for i in range(length + 1)]
    return {i: "Screen" if i == ids[0] else "Symbol" for i in ids}, {(a, b, "CALLS"): "Confirmed" for a, b in zip(ids, ids[1:], strict=False)}


def _frames(spark, nodes, edges):
    return (
        spark.createDataFrame(sorted(nodes.items()), "id string, label string"),
        spark.createDataFrame([(*k, c) for k, c in sorted(edges.items())], "src string, dst string, label string, conf string"),
    )


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _rounded(df):
    return _rows(df.withColumn("score", F.round("score", 9)))


def test_retraced_flows_equal_a_full_trace_of_many_random_changes(spark, monkeypatch):
    monkeypatch.setattr(graph, "DEPTH", 8)
    rng, old, new = random.Random(7), ({}, {}), ({}, {})
    for k in range(400):
        n, e, n2, e2 = _random(rng, k)
        old[0].update(n), old[1].update(e), new[0].update(n2), new[1].update(e2)
    for name, length, more in (("cut", 8, True), ("uncut", 9, False), ("same", 11, None)):  # at and over the depth bound
        n, e = _chain(name, length)
        old[0].update(n), old[1].update(e), new[0].update(n), new[1].update(e)
        if more:
            new[1][f"{name}.08", f"{name}.00", "CALLS"] = "Confirmed"
        elif more is False:
            del new[1][f"{name}.08", f"{name}.09", "CALLS"]
    nodes, edges = _frames(spark, *old)
    nodes2, edges2 = _frames(spark, *new)
    changed_n = [(i,) for i in old[0].keys() | new[0].keys() if old[0].get(i) != new[0].get(i)]
    changed_e = [k for k in old[1].keys() | new[1].keys() if old[1].get(k) != new[1].get(k)]
    before, full = graph.Flows(nodes, edges), graph.Flows(nodes2, edges2)
    after = graph.Retraced(before, nodes2, edges2, spark.createDataFrame(changed_n, "id string"), spark.createDataFrame(changed_e, "src string, dst string, label string"))
    gaps = lambda n: n.where("label = 'Gap'").select("id")
    assert _rows(after.triggers) == _rows(full.triggers)
    assert _rows(after.reach) == _rows(full.reach)
    assert _rounded(after.scores(before.scores(gaps(nodes)), gaps(nodes2))) == _rounded(full.scores(gaps(nodes2)))
    fresh = {t for (t,) in _rows(after.fresh)}
    assert {"cut.00", "uncut.00"} <= fresh and "same.00" not in fresh
    assert len(fresh) < full.triggers.count()


def test_an_unchanged_graph_retraces_nothing(spark):
    n, e = _chain("c", 5)
    nodes, edges = _frames(spark, n, e)
    before = graph.Flows(nodes, edges)
    after = graph.Retraced(before, nodes, edges, nodes.where("false"), edges.where("false"))
    assert after.fresh.isEmpty() and after.gone.isEmpty()
    assert _rows(after.triggers) == _rows(before.triggers)


def test_a_second_change_starts_from_the_retraced_flows(spark):
    nodes, edges = _frames(spark, {"s": "Screen", "e": "Endpoint", "f": "Endpoint"}, {("s", "e", "FETCHES"): "Confirmed"})
    edges2 = spark.createDataFrame([("s", "f", "FETCHES", "Confirmed")], edges.schema)
    edges3 = edges2.where("false")
    none = nodes.where("false")
    first = graph.Retraced(graph.Flows(nodes, edges), nodes, edges2, none, edges.unionAll(edges2))
    assert _rows(first.triggers.select("trigger_id")) == [("e",), ("s",)]
    second = graph.Retraced(first, nodes, edges3, none, edges2)
    assert _rows(second.triggers.select("trigger_id")) == [("e",), ("f",), ("s",)]
    assert {t for (t,) in _rows(second.fresh)} == {"f", "s"}
    assert _rows(second.reach.where(F.col("trigger_id") == "s")) == [("s", "s")]
