"""Traversals over edge tables: reachability, flow traces, neighbourhoods and packing."""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hop_weight
from .lineage import SMALL_ROWS, counted, dropped, running, small, tidied, written

DEPTH = 64
FORWARD = ("RENDERS", "FETCHES", "HANDLES", "ENTRY", "CALLS", "PUBLISHES")
REVERSED = ("SUBSCRIBES", "DEFINED_IN")
ANCHORS = ("Screen", "ExtensionContext", "Command")
#: Steps are composed with themselves while there are at most so many.
SQUARED_STEPS = 100_000
#: Rounds after which the tables of pairs seen are written as one.
GATHERED = 8


def reachable(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """``start, node``: what each start (``start``) reaches by one edge or more; itself only on a cycle.

    Every round joins the new pairs with the steps, drops pairs already seen and writes what is new.  From the
    fourth round on, as long as they are few, the steps are composed with themselves, so that long chains
    take a logarithmic number of rounds; a fixed point under more steps is one under the edges.  Rounds go on until
    no pair is new; if only so many `rounds` are allowed and do not suffice, that is an error and no part is returned.
    """
    steps, m = counted(edges.select("src", "dst").distinct(), "steps")
    new, n = counted(starts.select("start").distinct().join(steps, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct(), "reach")
    seen = new
    for k in itertools.count():
        if not n:
            return seen
        if rounds is not None and k >= rounds:
            raise ValueError(f"nodes are left to reach after {rounds} rounds")
        if k >= 3 and m <= SQUARED_STEPS:
            ahead = steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
            steps, m = counted(steps.unionAll(steps.join(ahead, "dst").select("src", F.col("to").alias("dst"))).distinct(), "steps")
            new = seen
        new, n = counted(new.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"), "reach")
        seen = seen.unionAll(new)
        if k % GATHERED == GATHERED - 1:
            seen = written(seen, "reach")


def reachable_doubling(edges: DataFrame) -> DataFrame:
    """``start, node`` of all pairs by path doubling: the number of rounds is logarithmic in the longest path."""
    pairs, n = counted(edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct(), "reach")
    while True:
        more = pairs.join(pairs.select(F.col("start").alias("node"), F.col("node").alias("to")), "node").select("start", F.col("to").alias("node"))
        grown, m = counted(pairs.unionAll(more).distinct(), "reach")
        if m == n:
            return grown
        pairs, n = grown, m


def steps_of(edges: DataFrame) -> DataFrame:
    """``src, dst, label, conf, reversed``: the directions in which a flow crosses edges."""
    forward = edges.where(F.col("label").isin(*FORWARD)).select("src", "dst", "label", "conf", F.lit(False).alias("reversed"))
    back = edges.where(F.col("label").isin(*REVERSED)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "conf", F.lit(True).alias("reversed"))
    return forward.unionAll(back)


def _walk(adjacency: dict, leads: set, trigger: str) -> list[tuple]:
    """Hops in depth-first order; only nodes with an adjacency are expanded, and none that is popped at the depth bound.

    A node is expanded where it is first popped below the bound, so one cut off on a long path may still be
    expanded on a shorter one.  `leads` are the nodes that steps lead on from: cutting one off makes the flow limited.
    """
    hops, visited, stack, limited = [], set(), [(trigger, 0)], False
    while stack:
        node, depth = stack.pop()
        if depth >= DEPTH:
            limited = limited or node in leads
            continue
        if node in visited:
            continue
        visited.add(node)
        out = adjacency.get(node, ())
        hops.extend((node, *step) for step in out)
        stack.extend((step[0], depth + 1) for step in reversed(out))
    return [(trigger, k, *hop, limited) for k, hop in enumerate(hops)]


def trace_exact(nodes: DataFrame, edges: DataFrame, triggers: DataFrame) -> DataFrame:
    """``trigger_id, ord, src, dst, label, conf, reversed, depth_limited``: depth-first narrative order.

    A depth-first walk expands no node that is further than the bound by the shortest way, so what a trigger's set-mode flow
    expands holds all it needs: the steps of these nodes are the trigger's own subgraph.  They meet in one group for each
    trigger, whatever the size of the graph, and are walked there; a group is as large as its trigger's flow.
    """
    steps = steps_of(edges)
    leads = steps.select(F.col("src").alias("dst")).distinct().withColumn("leads", F.lit(True))
    steps = written(steps.join(leads, "dst", "left").withColumn("leads", F.coalesce("leads", F.lit(False))), "steps")
    gaps = nodes.where("label = 'Gap'").select(F.col("id").alias("trigger_id"))
    open_nodes = nodes.where("label <> 'Gap'").select(F.col("id").alias("open"))
    links = _links(steps, open_nodes)
    reach, _ = _expanded(links, triggers.select("trigger_id").distinct().join(gaps, "trigger_id", "left_anti"))
    dropped(links)
    own = reach.join(steps, F.col("node") == F.col("src")).select("trigger_id", "src", "dst", "label", "conf", "reversed", "leads")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        adjacency = defaultdict(list)
        for src, dst, label, conf, back in frame.sort_values(["src", "reversed", "label", "dst"])[["src", "dst", "label", "conf", "reversed"]].itertuples(index=False):
            adjacency[src].append((dst, label, conf, back))
        leads = set(frame["dst"][frame["leads"]])
        return pd.DataFrame(_walk(adjacency, leads, frame["trigger_id"].iloc[0]), columns=["trigger_id", "ord", "src", "dst", "label", "conf", "reversed", "depth_limited"])

    return own.groupBy("trigger_id").applyInPandas(walk, "trigger_id string, ord long, src string, dst string, label string, conf string, reversed boolean, depth_limited boolean")


def _links(steps: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """``src, dst, on``: the steps into nodes that a flow may expand (`open_nodes`: ``open``) and that have steps themselves;
    ``on`` tells those whose ``dst`` has such a step in turn.  Tables are written between the shuffles, so one is on disk at a time."""
    inner = written(open_nodes.join(steps.select(F.col("src").alias("open")).distinct(), "open", "left_semi"), "inner")
    into = written(steps.select("src", "dst").join(inner, F.col("dst") == F.col("open"), "left_semi"), "into")
    leads = written(into.select(F.col("src").alias("dst")).distinct().withColumn("on", F.lit(True)), "leads")
    links = written(into.join(leads, "dst", "left").select("src", "dst", F.coalesce("on", F.lit(False)).alias("on")), "links")
    dropped(inner, into, leads)
    return links


def _expanded(links: DataFrame, triggers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``trigger_id, node``: nodes that each trigger's flow expands (itself among them), at most DEPTH - 1 steps away;
    and the triggers (``trigger_id``) whose flow the bound cuts while steps lead on.

    Nodes without steps add no hop, so they are no pairs, but for triggers; only nodes that links lead on from are joined
    with the links in the next round, and few of them are broadcast.
    """
    new, n = counted(triggers.select("trigger_id", F.concat("trigger_id", F.lit("")).alias("node"), F.lit(True).alias("on")), "flow")
    tables = [new]
    for depth in range(1, DEPTH + 1):
        seen = _pairs(tables)
        front = new.where("on").select("trigger_id", F.col("node").alias("src"))
        nxt = links.join(small(front) if n <= SMALL_ROWS else front, "src").groupBy("trigger_id", F.col("dst").alias("node")).agg(F.bool_or("on").alias("on"))
        new, n = counted(nxt.join(seen, ["trigger_id", "node"], "left_anti"), "flow", F.count_if("on"))
        if depth == DEPTH:
            break
        tables.append(new)
        if not n:
            new = new.where("on")
            break
        if depth % GATHERED == 0:
            done, tables = tables[:-1], [written(_pairs(tables[:-1]), "flow"), new]
            dropped(*done)
    return _pairs(tables), new.select("trigger_id").distinct()


def _pairs(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, [t.select("trigger_id", "node") for t in tables])


class Flows:
    """All flows of a graph in set form: all triggers advance together, by shortest distance.

    Anchors come first, then endpoints that no anchor's flow fetches and channels that are consumed and never
    published.  ``reach`` (``trigger_id, node``) holds the triggers and the expanded nodes that have steps, ``triggers`` (``trigger_id, depth_limited``).
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        with tidied(nodes.sparkSession):
            self._trace(nodes, edges)

    def _trace(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.steps = written(steps_of(edges), "steps")
        open_nodes = nodes.where("label <> 'Gap'").select(F.col("id").alias("open"))
        links = _links(self.steps, open_nodes)
        self.anchors = nodes.where(F.col("label").isin(*ANCHORS)).select(F.col("id").alias("trigger_id"))
        reach, cut = _expanded(links, self.anchors)
        fetches = self.steps.where("label = 'FETCHES'")
        callers = reach.select("node").join(small(fetches.select(F.col("src").alias("node")).distinct()), "node", "left_semi").distinct()
        fetched = fetches.join(callers, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("id")).distinct()
        endpoints = nodes.where("label = 'Endpoint'").select("id").join(fetched, "id", "left_anti")
        consumed = self.steps.where("label = 'SUBSCRIBES'").select(F.col("src").alias("id")).distinct()  # crossed backwards
        published = self.steps.where("label = 'PUBLISHES'").select(F.col("dst").alias("id")).distinct()
        channels = nodes.where("label = 'Channel'").select("id").join(consumed, "id", "left_semi").join(published, "id", "left_anti")
        self.rest = written(endpoints.unionAll(channels).withColumnRenamed("id", "trigger_id"), "triggers")
        more, cut_too = _expanded(links, self.rest)
        dropped(links)
        self.reach = reach.unionAll(more)
        self.triggers = _limited(self.anchors.unionAll(self.rest), cut.unionAll(cut_too))

    def hops(self) -> DataFrame:
        """``trigger_id, src, dst, label, conf, reversed``."""
        return self.reach.join(self.steps, F.col("node") == F.col("src")).select("trigger_id", "src", "dst", "label", "conf", "reversed")

    def scores(self, gap_nodes: DataFrame | None) -> DataFrame:
        """As :func:`flow_scores`, from sums over each node's steps: the hops themselves are never made."""
        return _summed(self.steps, self.reach, self.triggers, gap_nodes)


def _limited(triggers: DataFrame, cut: DataFrame) -> DataFrame:
    """Triggers with ``depth_limited``: true for those among the cut ones."""
    return triggers.join(cut.withColumn("depth_limited", F.lit(True)), "trigger_id", "left").withColumn("depth_limited", F.coalesce("depth_limited", F.lit(False)))


def _summed(steps: DataFrame, reach: DataFrame, triggers: DataFrame, gap_nodes: DataFrame | None) -> DataFrame:
    steps, gap = _with_gaps(steps, gap_nodes)
    sums = steps.groupBy(F.col("src").alias("node")).agg(*_sums(F.count("*"), F.sum(hop_weight(F.col("conf"))), F.bool_or(gap), F.bool_and(F.col("conf") == "Confirmed")))
    with tidied(sums.sparkSession):
        sums = written(sums, "sums")
    told = reach.join(sums, "node").groupBy("trigger_id").agg(*_sums(F.sum("_n"), F.sum("_w"), F.bool_or("_g"), F.bool_and("_c")))
    return _scored(triggers.join(told, "trigger_id", "left"))


class Retraced:
    """The flows of a changed graph: those that a change may touch are traced again, the others are taken over.

    `before` holds the flows of the old graph (a :class:`Flows` or another ``Retraced``), `changed_nodes` (``id``) every node
    that came, went or has a new label, `changed_edges` (``src, dst, label``) every edge that came, went or has a new
    confidence; both may name more than that.  A flow is touched if it expands the source of a changed step, or steps
    into that source or into a changed node.  Endpoints and channels are judged anew as triggers only where a touched anchor
    flow fetched or fetches them, or a change names them.

    ``fresh`` (``trigger_id``) are the flows traced again, ``gone`` the old ones dropped or replaced; ``reach``, ``triggers`` and
    :meth:`scores` equal those of a full trace.  Tables of the old flows are scanned against sets as large as the change.
    """

    def __init__(self, before: Flows | Retraced, nodes: DataFrame, edges: DataFrame, changed_nodes: DataFrame, changed_edges: DataFrame):
        self.steps = written(steps_of(edges), "steps")
        changed = written(changed_nodes.select("id").distinct(), "changed")
        sources = steps_of(changed_edges.select("src", "dst", "label", F.lit("").alias("conf"))).select(F.col("src").alias("id")).distinct()
        into = sources.unionAll(changed).distinct()
        ahead = before.steps.join(small(into.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id"))
        touched = written(sources.unionAll(ahead).select(F.col("id").alias("node")).distinct(), "touched")
        hit = before.reach.join(small(touched), "node", "left_semi").select("trigger_id")
        stale = written(hit.unionAll(changed.withColumnRenamed("id", "trigger_id")).distinct(), "stale")

        # anchors
        links = _links(self.steps, nodes.where("label <> 'Gap'").select(F.col("id").alias("open")))
        self.anchors = nodes.where(F.col("label").isin(*ANCHORS)).select(F.col("id").alias("trigger_id"))
        again = written(self.anchors.join(small(stale), "trigger_id", "left_semi"), "triggers")
        reach, cut = _expanded(links, again)
        reach = written(reach, "reach")

        # endpoints and channels that may have become triggers, or be none any more
        left = before.anchors.join(small(stale), "trigger_id", "left_semi")
        lost = before.reach.join(small(left), "trigger_id", "left_semi").select("node").distinct()
        fetches = lambda steps, of: of.select("node").join(steps.where("label = 'FETCHES'"), F.col("node") == F.col("src")).select(F.col("dst").alias("id"))
        linked = changed_edges.where("label in ('SUBSCRIBES', 'PUBLISHES')").select(F.col("dst").alias("id"))
        judged = written(changed.unionAll(linked).unionAll(fetches(before.steps, lost)).unionAll(fetches(self.steps, reach)).distinct(), "judged")
        asked = small(judged)
        callers = self.steps.where("label = 'FETCHES'").join(asked.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("id"))
        callers = written(callers.distinct(), "callers")
        kept_anchors = before.reach.join(small(callers.select("node").distinct()), "node", "left_semi").join(before.anchors.join(small(stale), "trigger_id", "left_anti"), "trigger_id", "left_semi")
        fetched = callers.join(kept_anchors.unionAll(reach).select("node").distinct(), "node", "left_semi").select("id").distinct()
        own = nodes.join(asked, "id", "left_semi")
        endpoints = own.where("label = 'Endpoint'").select("id").join(fetched, "id", "left_anti")
        ends = edges.where("label in ('SUBSCRIBES', 'PUBLISHES')").select(F.col("dst").alias("id"), "label").join(asked, "id", "left_semi").groupBy("id").agg(F.bool_or(F.col("label") == "PUBLISHES").alias("published"))
        channels = own.where("label = 'Channel'").select("id").join(ends.where("not published"), "id", "left_semi")
        told = endpoints.unionAll(channels).select(F.col("id").alias("trigger_id"))
        not_judged = before.rest.join(small(judged.withColumnRenamed("id", "trigger_id")), "trigger_id", "left_anti")
        self.rest = written(not_judged.unionAll(told), "triggers")
        came = self.rest.join(before.rest, "trigger_id", "left_anti")
        rest = written(came.unionAll(self.rest.join(small(stale), "trigger_id", "left_semi")).distinct(), "triggers")
        more, cut_too = _expanded(links, rest)
        dropped(links)

        went = before.rest.join(self.rest, "trigger_id", "left_anti")
        self.gone = written(before.triggers.select("trigger_id").join(small(written(stale.unionAll(went).distinct(), "stale")), "trigger_id", "left_semi"), "gone")
        self.fresh = again.unionAll(rest)
        self._fresh_reach, self._fresh_triggers = reach.unionAll(more), written(_limited(self.fresh, cut.unionAll(cut_too)), "triggers")
        self.reach = before.reach.join(small(self.gone), "trigger_id", "left_anti").unionAll(self._fresh_reach)
        self.triggers = before.triggers.join(small(self.gone), "trigger_id", "left_anti").unionAll(self._fresh_triggers)

    def scores(self, before: DataFrame, gap_nodes: DataFrame | None) -> DataFrame:
        """Scores of all flows: the old ones (`before`) but for ``gone``, and those of ``fresh``."""
        fresh = _summed(self.steps.join(small(self._fresh_reach.select(F.col("node").alias("src")).distinct()), "src", "left_semi"), self._fresh_reach, self._fresh_triggers, gap_nodes)
        return before.join(small(self.gone), "trigger_id", "left_anti").unionAll(fresh.select(*before.columns))


def trace_set(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hops (``trigger_id, src, dst, label, conf, reversed``) of all flows in set form, and the triggers."""
    flows = Flows(nodes, edges)
    return flows.hops(), flows.triggers


def _with_gaps(hops: DataFrame, gap_nodes: DataFrame | None) -> tuple[DataFrame, Column]:
    gap = F.col("conf") == "Gap"
    if gap_nodes is None:
        return hops, gap
    return hops.join(gap_nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_gap")), "dst", "left"), gap | F.col("_gap").isNotNull()


def _sums(n: Column, weight: Column, gap: Column, confirmed: Column) -> list[Column]:
    return [n.alias("_n"), weight.alias("_w"), gap.alias("_g"), confirmed.alias("_c")]


def _scored(told: DataFrame) -> DataFrame:
    """A flow without hops, with a gap, or cut by the depth bound is partial."""
    status = F.when(F.coalesce("_g", F.lit(True)) | F.col("depth_limited"), "Partial").when(F.col("_c"), "Verified").otherwise("Inferred")
    return told.select("trigger_id", F.coalesce("_n", F.lit(0)).alias("hops"), F.coalesce(F.col("_w") / F.col("_n"), F.lit(0.0)).alias("score"), status.alias("status"))


def flow_scores(hops: DataFrame, triggers: DataFrame, gap_nodes: DataFrame | None) -> DataFrame:
    """``trigger_id, hops, score, status`` from hops and triggers (``trigger_id``, perhaps ``depth_limited``).

    With `gap_nodes` (``id``), a hop into one makes the flow partial too.
    """
    if "depth_limited" in hops.columns:
        cut = hops.groupBy("trigger_id").agg(F.bool_or("depth_limited").alias("depth_limited"))
        triggers = triggers.drop("depth_limited").join(cut, "trigger_id", "left")
    elif "depth_limited" not in triggers.columns:
        triggers = triggers.withColumn("depth_limited", F.lit(False))
    triggers = triggers.withColumn("depth_limited", F.coalesce("depth_limited", F.lit(False)))
    hops, gap = _with_gaps(hops, gap_nodes)
    told = hops.groupBy("trigger_id").agg(*_sums(F.count("*"), F.sum(hop_weight(F.col("conf"))), F.bool_or(gap), F.bool_and(F.col("conf") == "Confirmed")))
    return _scored(triggers.join(told, "trigger_id", "left"))


def k_hop(nodes: DataFrame, edges: DataFrame, focus: DataFrame, hops: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undirected neighbourhood of the focus ids (``id``): distances (``id, hop``), its nodes, its induced edges."""
    ends = edges.select("src", "dst")
    seen = focus.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for k in range(1, hops + 1):
        # each side is cut down by the frontier before anything is made distinct
        out = ends.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
        back = ends.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
        frontier = written(out.unionAll(back).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(k)), "hop")
        seen = seen.unionAll(frontier)
    inside = nodes.join(seen, "id")
    induced = edges.join(seen.select(F.col("id").alias("src"), F.col("hop").alias("src_hop")), "src").join(seen.select(F.col("id").alias("dst"), F.col("hop").alias("dst_hop")), "dst")
    return seen, inside, induced


def packed(lines: DataFrame, budget: int) -> DataFrame:
    """Lines (``hop, kind, id, line``) in order, up to the first that would exceed the budget in bytes.

    Prefix sums only grow, so what fits is what has a sum within the budget.
    """
    return running(lines, F.octet_length("line") + 1, "used", "hop", "kind", "id").where(F.col("used") <= budget)


def hop_counts_by_cluster(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges rolled up between node labels: ``src_label, dst_label, label, n``."""
    of = nodes.select("id", F.col("label").alias("l"))
    return edges.join(of.select(F.col("id").alias("src"), F.col("l").alias("src_label")), "src").join(of.select(F.col("id").alias("dst"), F.col("l").alias("dst_label")), "dst").groupBy("src_label", "dst_label", "label").agg(F.count("*").alias("n"))
