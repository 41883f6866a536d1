"""Registers and metrics over a graph: gaps, coverage, tallies, drift, decisions, security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_NODE = "label = 'Gap' or conf = 'Gap'"
GAP_EDGE = "conf = 'Gap'"
DRIFT_EDGES = ("CONFLICTS", "DRIFTS_FROM")


def tier_tallies(*facts: DataFrame) -> DataFrame:
    """``conf, n`` over nodes and edges, every confidence listed."""
    every = None
    for f in facts:
        every = f.select("conf") if every is None else every.unionAll(f.select("conf"))
    return every.groupBy("conf").agg(F.count("*").alias("n"))


def lone_gap_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Gap edges that touch no gap node."""
    gaps = nodes.where(GAP_NODE).select("id")
    return edges.where(GAP_EDGE).join(gaps.withColumnRenamed("id", "src"), "src", "left_anti").join(gaps.withColumnRenamed("id", "dst"), "dst", "left_anti")


def gap_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``findings``: gap nodes, and gap edges that touch none."""
    both = nodes.where(GAP_NODE).agg(F.count("*").alias("n")).unionAll(lone_gap_edges(nodes, edges).agg(F.count("*").alias("n")))
    return both.agg(F.sum("n").alias("findings"))


def coverage(facts: DataFrame, scope: DataFrame) -> DataFrame:
    """Per extractor: facts with evidence, distinct files, percent of its scope's files.

    An extractor in scope without facts shows 0; one out of scope has no percentage; a scope of 0 files is 0.0.
    """
    got = facts.where("file is not null").groupBy("extractor").agg(F.count("*").alias("facts"), F.countDistinct("file").alias("files"))
    out = got.join(scope.select("extractor", "scope_files"), "extractor", "full_outer")
    files = F.coalesce("files", F.lit(0))
    percent = F.when(F.col("scope_files") == 0, 0.0).otherwise(F.round(100.0 * files / F.col("scope_files"), 6))
    return out.select("extractor", F.coalesce("facts", F.lit(0)).alias("facts"), files.alias("files"), F.when(F.col("scope_files").isNotNull(), percent).alias("percent"))


def determinism(history: DataFrame) -> DataFrame:
    """One row ``verdict`` from ``repo, sha, graph_hash``: violated, verified or unproven."""
    groups = history.groupBy("repo", "sha").agg(F.count("*").alias("n"), F.countDistinct("graph_hash").alias("h"))
    return groups.agg(F.when(F.coalesce(F.bool_or((F.col("n") >= 2) & (F.col("h") > 1)), F.lit(False)), "violated").when(F.coalesce(F.bool_or(F.col("n") >= 2), F.lit(False)), "verified").otherwise("unproven").alias("verdict"))


def exported(facts: DataFrame, rejected: DataFrame, best_effort: bool) -> DataFrame:
    """Facts as exported: rejected inferred ones go, weak ones stay only in best effort."""
    inferred = F.col("conf").isin("InferredStrong", "InferredWeak")
    out = facts.join(rejected.select("hash", F.lit(True).alias("_no")).distinct(), "hash", "left").where(~(inferred & F.col("_no").isNotNull())).drop("_no")
    return out if best_effort else out.where("conf <> 'InferredWeak'")


def ungoverned_channels(channels: DataFrame, found_governs: DataFrame, edges: DataFrame) -> DataFrame:
    """Channels without a found decision but with a known publisher, subscriber or backing: ``id, conf``."""
    ends = edges.where(F.col("label").isin("PUBLISHES", "SUBSCRIBES", "BACKS") & (F.col("conf") != "Gap")).select(F.col("dst").alias("id"), "conf")
    told = ends.groupBy("id").agg(F.bool_or(F.col("conf") == "InferredWeak").alias("_w"))
    return channels.select("id").join(found_governs.select("id").distinct(), "id", "left_anti").join(told, "id").select("id", F.when(F.col("_w"), "InferredWeak").otherwise("InferredStrong").alias("conf"))


def drift(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions (``adr, governs, forbids``; one row each pair) broken by edges: ``adr, src, dst, label``."""
    known = edges.where("conf <> 'Gap'").select("src", "dst", "label")
    rule = decisions.select("adr", "governs", "forbids")
    hits = [known.join(rule, (F.col(end) == F.col("governs")) & (F.col("label") == F.col("forbids"))).select("adr", "src", "dst", "label") for end in ("src", "dst")]
    return hits[0].unionAll(hits[1]).distinct()


def with_triggers(broken: DataFrame, hops: DataFrame) -> DataFrame:
    """Drift rows with the sorted ids of the flows (``trigger_id, src, dst, label``) that contain the offending edge."""
    key = ["src", "dst", "label"]
    asked = broken.select(*key).distinct()
    told = hops.select("trigger_id", *key).join(asked, key, "left_semi").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("trigger_id")).alias("flow_triggers"))
    return broken.join(told, key, "left").withColumn("flow_triggers", F.coalesce("flow_triggers", F.array().cast("array<string>")))


def security_findings(endpoints: DataFrame, grants: DataFrame) -> DataFrame:
    """Explicitly open endpoints (``id, auth``) and grants with a wildcard (``src, dst, actions, scopes``), with evidence."""
    open_ = endpoints.where("auth = false and conf <> 'Gap'").select(F.lit("unauthenticated").alias("finding"), F.col("id").alias("subject"))
    wide = grants.where(F.exists("actions", lambda a: a.contains("*")) | F.exists(F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(F.array("dst")), lambda s: s.contains("*"))).where("conf <> 'Gap'")
    return open_.unionAll(wide.select(F.lit("wildcard grant").alias("finding"), F.concat_ws(" ", "src", F.lit("GRANTS"), "dst").alias("subject"))).distinct()


def union_of_evidence(facts: DataFrame, key: str) -> DataFrame:
    """``key, evidence``: sorted distinct evidence of all facts with a key; repeats go before anything is gathered."""
    each = facts.select(key, F.explode_outer("evidence").alias("e")).distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("evidence"))


def first_per(df: DataFrame, key: str, value: Column, order: Column) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"))


def gap_classes(gaps: DataFrame) -> DataFrame:
    """Gaps (``reason, extractor, in_flow``) by class, those that block flows first."""
    return gaps.groupBy("reason", "extractor").agg(F.count("*").alias("n"), F.count_if("in_flow").alias("blocking"))


def latest(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """``key, latest``: the value with the largest `seq` of each key."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias("latest"))


def newest(df: DataFrame, seq: str, limit: int | None = None) -> DataFrame:
    """Rows newest first, the first `limit` of them."""
    out = df.orderBy(F.desc(seq))
    return out if limit is None else out.limit(limit)


def authority(conf: Column) -> Column:
    """How far what was recovered may be relied on."""
    return F.when(conf == "Confirmed", "authoritative").when(conf == "Gap", "partial").otherwise("inferred")


def counters(nodes: DataFrame, by: str, file: str) -> DataFrame:
    """Nodes and distinct files by layer or extractor."""
    return nodes.groupBy(by).agg(F.count("*").alias("nodes"), F.countDistinct(file).alias("files"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``gaps, unsupported, open, graph_facts``."""
    parts = gap_findings(nodes, edges).select(F.lit("gaps").alias("k"), F.col("findings").alias("n"))
    parts = parts.unionAll(nodes.where("conf = 'InferredWeak'").agg(F.lit("unsupported").alias("k"), F.count("*").alias("n")))
    for df in (nodes, edges):
        parts = parts.unionAll(df.agg(F.lit("facts").alias("k"), F.count("*").alias("n")))
    of = lambda *k: F.sum(F.when(F.col("k").isin(*k), F.col("n")).otherwise(0))
    return parts.agg(of("gaps").alias("gaps"), of("unsupported").alias("unsupported"), of("gaps", "unsupported").alias("open"), of("facts").alias("graph_facts"))


def deterministic_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line`` of every fact of the deterministic tier, for snapshots that must not change between runs."""
    n = nodes.where("tier = 'Deterministic'").select(F.concat_ws(" ", F.lit("n"), "id", "label", "hash").alias("line"))
    return n.unionAll(edges.where("tier = 'Deterministic'").select(F.concat_ws(" ", F.lit("e"), "src", "label", "dst", "hash")))


def merged_tools(tools: DataFrame) -> DataFrame:
    """Tools (``tool, setting, behind_code, proof``) of all files: the first file's setting, all proofs in order."""
    return tools.groupBy("tool").agg(F.min_by("setting", "proof").alias("setting"), F.bool_or("behind_code").alias("behind_code"), F.array_join(F.transform(F.array_sort(F.collect_set("proof")), lambda x: x.cast("string")), ",").alias("proofs"))


def action_sets(grants: DataFrame) -> DataFrame:
    """``target, actions``: the sorted distinct actions granted on each target (``target, action``)."""
    return grants.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("action")), "|").alias("actions"))
