"""Small state tables: jobs, consent, plugins, caches.  Appends and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINISHED = ("done", "failed", "cancelled")


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new)


def clear_finished(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(*FINISHED))


def allowed_policies(tiers: DataFrame) -> DataFrame:
    """Enabled tiers that are local, or cloud with consent."""
    return tiers.where("enabled and (not cloud or consent)")


def change_provider(tiers: DataFrame, changes: DataFrame) -> DataFrame:
    """Provider changes (``tier, to``); leaving the cloud revokes consent."""
    out = tiers.join(changes, "tier", "left")
    leaves = F.col("to").isNotNull() & (F.col("to") != "cloud")
    return out.select("tier", F.coalesce("to", "provider").alias("provider"), (F.col("consent") & ~leaves).alias("consent"))


def reapplied(decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Decisions whose basis is that of a new task."""
    return decisions.join(tasks, "basis_hash")


def active_plugins(enabled: DataFrame, gates: DataFrame) -> DataFrame:
    """Plugins enabled at the very content that passed its gate."""
    return enabled.select("plugin", "content_hash").join(gates.select("plugin", "content_hash").distinct(), ["plugin", "content_hash"], "left_semi")


def discovered(found: DataFrame) -> DataFrame:
    """``plugin, chosen, shadowed``: the first root by priority, then name; the others are shadowed."""
    return found.groupBy("plugin").agg(F.min_by("root", F.struct("priority", "root")).alias("chosen"), (F.count("*") - 1).alias("shadowed"))


def cache_plan(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, action``: files (``path, hash``) whose cached facts are reused, and those to parse."""
    old = cache.select("path", F.col("hash").alias("_h"))
    return files.join(old, "path", "left").select("path", F.when(F.col("_h") == F.col("hash"), "reused").otherwise("parsed").alias("action"))


def deleted_files(cached: DataFrame, active: DataFrame) -> DataFrame:
    return cached.join(active.distinct(), "file", "left_anti")
