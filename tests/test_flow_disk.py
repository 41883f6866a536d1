"""Flows take the disk of what they need: columns, pairs and shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph, lineage
from spanloom.plans import catalog, graph_queries

NODES, EDGES = "id string, label string", "src string, dst string, label string, conf string"
WEIGHT = {"Confirmed": 1.0, "InferredWeak": 0.3, "Gap": 0.0}


def _shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_no_pairs_for_nodes_without_steps(spark):
    nodes = spark.createDataFrame([("s", "Screen"), ("alone", "Screen"), ("e", "Endpoint"), ("h", "Symbol"), ("c", "Channel"), ("w", "Symbol"), ("g", "Gap")], NODES)
    edges = spark.createDataFrame([("s", "e", "FETCHES", "Confirmed"), ("e", "h", "HANDLES", "Confirmed"), ("h", "c", "PUBLISHES", "Confirmed"), ("w", "c", "SUBSCRIBES", "Confirmed"), ("h", "g", "CALLS", "Gap"), ("g", "s", "CALLS", "Confirmed")], EDGES)
    flows = graph.Flows(nodes, edges)
    assert sorted(map(tuple, flows.reach.collect())) == [("alone", "alone"), ("s", "c"), ("s", "e"), ("s", "h"), ("s", "s")]
    assert sorted((h.src, h.dst) for h in flows.hops().collect()) == [("c", "w"), ("e", "h"), ("h", "c"), ("h", "g"), ("s", "e")]
    got = {r.trigger_id: (r.hops, round(r.score, 6), r.status) for r in flows.scores(nodes.where("label = 'Gap'").select("id")).collect()}
    assert got == {"s": (5, 0.8, "Partial"), "alone": (0, 0.0, "Partial")}


@pytest.mark.parametrize("rows", [0, lineage.SMALL_ROWS])
def test_flows_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "DEPTH", 5)
    monkeypatch.setattr(graph, "GATHERED", 2)
    monkeypatch.setattr(graph, "SMALL_ROWS", rows)
    rng, nodes, edges = random.Random(11), {}, {}
    for k in range(120):
        ids = [f"g{k}.{i}" for i in range(rng.randint(2, 12))]
        nodes |= {i: rng.choice(("Screen", "Endpoint", "Symbol", "Symbol", "Symbol", "Gap")) for i in ids if rng.random() < 0.95}
        edges |= {(rng.choice(ids), rng.choice(ids), rng.choice(("FETCHES", "CALLS", "SUBSCRIBES"))): rng.choice(list(WEIGHT)) for _ in range(rng.randint(1, 20))}
    out = {}
    for (a, b, label), conf in edges.items():
        src, dst = (b, a) if label == "SUBSCRIBES" else (a, b)
        out.setdefault(src, []).append((dst, label, conf))

    def flow(trigger):
        expanded, front = {trigger}, {trigger}
        for depth in range(1, 6):
            front = {d for n in front for d, _, _ in out.get(n, ()) if nodes.get(d, "Gap") != "Gap"} - expanded
            expanded |= front if depth < 5 else set()
        hops = [h for n in expanded for h in out.get(n, ())]
        cut = any(n in out for n in front)
        gap = any(conf == "Gap" or nodes.get(d) == "Gap" for d, _, conf in hops)
        status = "Partial" if not hops or cut or gap else "Verified" if all(conf == "Confirmed" for _, _, conf in hops) else "Inferred"
        return {d for d, label, _ in hops if label == "FETCHES"}, (len(hops), round(sum(WEIGHT[c] for _, _, c in hops) / max(1, len(hops)), 9), status)

    anchors = {i for i, label in nodes.items() if label == "Screen"}
    fetched = set().union(*(flow(t)[0] for t in anchors))
    want = {t: flow(t)[1] for t in anchors | {i for i, label in nodes.items() if label == "Endpoint" and i not in fetched}}
    n, e = spark.createDataFrame(sorted(nodes.items()), NODES), spark.createDataFrame([(*k, c) for k, c in sorted(edges.items())], EDGES)
    got = graph.Flows(n, e).scores(n.where("label = 'Gap'").select("id"))
    assert {r.trigger_id: (r.hops, round(r.score, 9), r.status) for r in got.collect()} == want
    assert {status for _, _, status in want.values()} == {"Partial", "Inferred", "Verified"}


def test_flows_leave_no_shuffle_files(spark):
    nodes = spark.createDataFrame([("s", "Screen"), ("a", "Symbol"), ("b", "Symbol")], NODES)
    edges = spark.createDataFrame([("s", "a", "CALLS", "Confirmed"), ("a", "b", "CALLS", "Confirmed"), ("b", "a", "CALLS", "Confirmed")], EDGES).repartition(3, "dst")
    conf, before = spark.conf.get(lineage._TIDY, None), _shuffled(spark)
    graph.Flows(nodes, edges)
    assert not _shuffled(spark) - before
    assert spark.conf.get(lineage._TIDY, None) == conf


def test_the_flow_query_writes_the_columns_it_uses(spark, sf, monkeypatch):
    columns = []
    real = lineage.written
    for module in (graph, graph_queries):
        monkeypatch.setattr(module, "written", lambda df, name="step": (columns.extend(df.columns), real(df, name))[1])
    catalog.QUERIES["flow_trace_set"](spark, sf)
    assert columns and not {"hash", "tier", "name", "extractor"} & set(columns)
