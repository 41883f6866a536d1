"""Semantic proposals: nearest neighbours by cosine, a calibrated precision gate, an overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .graph import Flows
from .lineage import written
from .resolve import ranked, replaced_gaps
from .store import first_by

SLACK = 1e-6
#: Queries go to every task up to so many rows and bytes of vectors; beyond, an index is searched.
QUERY_ROWS, QUERY_BYTES = 20_000, 16 << 20
#: Kinds of channels that resources of these types may stand for.
STAGED = {"aws_sqs_queue": "sqs-queue", "aws_sns_topic": "sns-topic"}


def top_k(queries: DataFrame, index: DataFrame, k: int, on: list[str], digits: int | None = None) -> DataFrame:
    """``query_id, target_id, similarity``: the k nearest per query among index rows with null-safe equal `on` columns.

    The stated queries are held against all rows of their class.  Queries that fit go to every task, so index rows stay where
    they are and no class meets in one task; more are searched through an index, the exact way.
    """
    size = queries.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("d")).first()
    if size.d * 8 <= QUERY_BYTES and size.n <= QUERY_ROWS:
        return vectors.scanned(queries, index, max(k, 1), on, digits)
    return vectors.VectorIndex(index, on).search(queries, max(k, 1), digits)


def calibrated(pairs: DataFrame, floor: float) -> DataFrame:
    """One row ``threshold, precision, recall, tp, fp, fn`` from scored pairs (``score, is_match``).

    Every distinct score is a threshold (score >= t).  Among those with a true positive and precision at or above
    the floor the best recall wins, then precision, then threshold; if none passes, the gate stays shut at 1.
    """
    by = pairs.groupBy("score").agg(F.count_if("is_match").alias("p"), F.count_if(~F.col("is_match")).alias("n"))
    # cumulative counts over coarse score ranges first, so that only their sums meet in one task
    ranges = by.groupBy(F.floor(F.col("score") * 1000).alias("r")).agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("r").orderBy(F.desc("score"))
    each = by.withColumn("r", F.floor(F.col("score") * 1000)).join(ranges, "r").select("score", (F.sum("p").over(inside) + F.col("p0")).alias("tp"), (F.sum("n").over(inside) + F.col("n0")).alias("fp"))
    total = by.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    best = each.withColumn("precision", precision).where((F.col("tp") > 0) & (F.col("precision") >= floor)).agg(F.max(F.struct("tp", "precision", F.col("score").alias("threshold"), "fp")).alias("b"))
    # both sides are single aggregate rows
    one = best.join(total, F.lit(True))
    got = F.col("b").isNotNull()
    return one.select(F.when(got, F.col("b.threshold")).otherwise(1.0).alias("threshold"), F.when(got, F.col("b.precision")).otherwise(0.0).alias("precision"), F.when(got, F.col("b.tp") / F.col("positives")).otherwise(0.0).alias("recall"), F.when(got, F.col("b.tp")).otherwise(0).alias("tp"), F.when(got, F.col("b.fp")).otherwise(0).alias("fp"), (F.col("positives") - F.when(got, F.col("b.tp")).otherwise(0)).alias("fn"))


def gated(proposals: DataFrame, threshold: float) -> DataFrame:
    """The best proposal per gap at or above the threshold (filtered first): similarity, then target id."""
    return ranked(proposals.where(F.col("similarity") + SLACK >= threshold), ["gap_id"], [F.desc("similarity"), F.asc("target_id")], 1)


def graph_inputs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is unresolved and what it may mean, from nodes (``id, label, props`` JSON, ``evidence`` count) and edges.

    Slots (``gap_id, source_id, edge_label, kind, subtype, query``): edges into a gap that publish, subscribe or call, with the
    gap's raw text, callee or reason.  Candidates (``node_id, kind, subtype, text, staged``): channels by identity, symbols by
    name, and queue or topic resources as channels yet to be made.  Neither without text or evidence.
    """
    get = lambda key: F.get_json_object("props", f"$.{key}")
    kind = F.when(F.col("edge_label").isin("PUBLISHES", "SUBSCRIBES"), "Channel").when(F.col("edge_label") == "CALLS", "Call")
    gaps = nodes.where("label = 'Gap' and evidence > 0").select(F.col("id").alias("gap_id"), F.trim(F.coalesce(get("raw"), get("callee"), get("reason"), F.lit(""))).alias("query"), get("kind").alias("_k"))
    slots = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("gap_id"), F.col("label").alias("edge_label")).withColumn("kind", kind).where("kind is not null").join(gaps.where("query <> ''"), "gap_id")
    slots = slots.select("gap_id", "source_id", "edge_label", "kind", F.when(F.col("kind") == "Channel", F.col("_k")).alias("subtype"), "query")
    told = nodes.where("evidence > 0")
    none = F.lit(None).cast("string")
    channels = told.where("label = 'Channel'").select(F.col("id").alias("node_id"), F.lit("Channel").alias("kind"), get("kind").alias("subtype"), get("identity").alias("text"), none.alias("staged"))
    symbols = told.where("label in ('Symbol', 'Component')").select("id", F.lit("Call"), none, F.coalesce(get("name"), F.substring_index("id", "#", -1)), none)
    of = F.coalesce(*[F.when(get("type") == t, k) for t, k in STAGED.items()])
    text = F.concat_ws(" ", F.translate(get("logical_id"), "._-", "   "), get("type"))
    resources = told.where((F.col("label") == "Resource") & of.isNotNull() & get("logical_id").isNotNull()).select(F.concat(F.lit("chan:"), of, F.lit(":resource:"), "id"), F.lit("Channel"), of, text, F.col("id"))
    return slots, channels.unionAll(symbols).unionAll(resources).where("trim(text) <> ''")


def letters(text: Column) -> Column:
    """A deterministic embedding without a model: how often each letter a to z occurs."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in "abcdefghijklmnopqrstuvwxyz"])


def proposed(slots: DataFrame, candidates: DataFrame, neighbours: int = 3, embed=letters, digits: int | None = None) -> DataFrame:
    """``gap_id, source_id, edge_label, target_id, similarity, staged``: the nearest candidates of each slot's kind and subtype.

    Slots with equal text, kind and subtype have equal neighbours, so each such query is embedded and searched once.
    """
    key = F.sha2(F.to_json(F.struct("kind", "subtype", "query")), 256)
    asked = slots.withColumn("_key", key)
    queries = asked.select(F.col("_key").alias("id"), embed(F.col("query")).alias("vector"), "kind", "subtype").dropDuplicates(["id"])
    index = candidates.select(F.col("node_id").alias("id"), embed(F.col("text")).alias("vector"), "kind", "subtype")
    near = top_k(queries, index, neighbours, ["kind", "subtype"], digits)
    staged = first_by(candidates.select("node_id", "staged"), ["node_id"], "staged").withColumnRenamed("node_id", "target_id")
    return asked.join(near.withColumnRenamed("query_id", "_key"), "_key").join(staged, "target_id", "left").select("gap_id", "source_id", "edge_label", "target_id", "similarity", "staged")


def retraced(nodes: DataFrame, edges: DataFrame, approved: DataFrame) -> DataFrame:
    """Scores of all flows (as :meth:`Flows.scores`) over the graph with approved proposals (``src, gap, label, target, conf``)
    laid over it; nothing of the overlay is kept."""
    left, over = replaced_gaps(nodes, edges, approved)
    left, over = written(left, "nodes"), written(over, "edges")
    return Flows(left, over).scores(left.where("label = 'Gap'").select("id"))


def neighbours_of(edges: DataFrame, focus: DataFrame, hops: int) -> DataFrame:
    """``focus, id, hop``: what lies within some undirected hops of each focus (``focus``), itself at 0."""
    ends = edges.select("src", "dst")
    seen = focus.select("focus").distinct().select("focus", F.col("focus").alias("id"), F.lit(0).alias("hop"))
    frontier = seen
    for k in range(1, hops + 1):
        out = ends.join(frontier.select("focus", F.col("id").alias("src")), "src").select("focus", F.col("dst").alias("id"))
        back = ends.join(frontier.select("focus", F.col("id").alias("dst")), "dst").select("focus", F.col("src").alias("id"))
        frontier = written(out.unionAll(back).distinct().join(seen, ["focus", "id"], "left_anti").withColumn("hop", F.lit(k)), "hop")
        seen = seen.unionAll(frontier)
    return seen


#: Limits of an escalation task; fixed values.
TASK_HOPS, TASK_CANDIDATES = 2, 8


def escalation_tasks(nodes: DataFrame, edges: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks for gaps (``gap_id``) that go to a model: nodes ``id, label, conf, evidence`` (count), edges.

    Tasks: ``gap_id, source_id, edge_label, problem``.  The slot is the gap's first edge in, else its first edge out;
    ``problem`` is null where source or gap has evidence and a candidate exists.  Candidates (``gap_id, node_id, place``): the
    first TASK_CANDIDATES, by id, of the real facts with evidence within TASK_HOPS hops, without the gap and its source.
    """
    asked = gaps.select("gap_id").distinct()
    into = edges.join(asked.withColumnRenamed("gap_id", "dst"), "dst").select(F.col("dst").alias("gap_id"), F.lit(0).alias("_o"), F.col("src").alias("source_id"), F.col("label").alias("edge_label"))
    out = edges.join(asked.withColumnRenamed("gap_id", "src"), "src").select(F.col("src").alias("gap_id"), F.lit(1).alias("_o"), F.col("dst").alias("source_id"), F.col("label").alias("edge_label"))
    slot = first_by(into.unionAll(out), ["gap_id"], "_o", "source_id", "edge_label").drop("_o")
    about = nodes.select("id", "evidence")
    tasks = asked.join(slot, "gap_id", "left").join(about.select(F.col("id").alias("gap_id"), F.col("evidence").alias("_g")), "gap_id", "left").join(about.select(F.col("id").alias("source_id"), F.col("evidence").alias("_s")), "source_id", "left")
    real = nodes.where("label <> 'Gap' and conf <> 'Gap' and evidence > 0").select("id")
    near = neighbours_of(edges, asked.withColumnRenamed("gap_id", "focus"), TASK_HOPS).where("hop > 0").select(F.col("focus").alias("gap_id"), "id").join(real, "id")
    near = near.join(slot.select("gap_id", "source_id"), "gap_id", "left").where("id <> source_id or source_id is null")
    chosen = ranked(near.select("gap_id", F.col("id").alias("node_id")), ["gap_id"], [F.asc("node_id")], TASK_CANDIDATES)
    chosen = written(chosen, "candidates")
    some = chosen.select("gap_id").distinct().withColumn("_c", F.lit(True))
    problem = F.when(F.col("source_id").isNull(), "no adjacent edge").when(F.coalesce("_g", F.lit(0)) + F.coalesce("_s", F.lit(0)) == 0, "no evidence").when(F.col("_c").isNull(), "no candidates")
    return tasks.join(some, "gap_id", "left").select("gap_id", "source_id", "edge_label", problem.alias("problem")), chosen
