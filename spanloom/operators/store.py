"""Keyed storage of a property graph: merges, deletes, lookups, closure and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import label_of
from .lineage import running

NODE_KEY, EDGE_KEY = ["id"], ["src", "dst", "label"]
SCHEMA_VERSION = 2


def last_by(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row per key: the one with the largest `seq`.  Pre-aggregates, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, key: list[str], *seq: str) -> DataFrame:
    """One row per key: the one with the smallest `seq`."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows with the new ones put over them; of new rows with one key the later (`seq`) wins."""
    both = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    return last_by(both, key, "seq").drop("seq")


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and all edges that touch one of them."""
    gone = gone.select("id").distinct()
    edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), edges.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])


def with_labels(edges: DataFrame, labels: list[str]) -> DataFrame:
    return edges.where(F.col("label").isin(labels)) if labels else edges.where(F.lit(False))


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholders (``id, label``) for edge ends that have no node, labelled by their id's prefix."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").withColumn("label", label_of(F.col("id")))


def reconcile(old: DataFrame, new: DataFrame, key: list[str], hash_column: str, owned: Column) -> DataFrame:
    """``key, action``: inserted, updated, unchanged or deleted; rows of others (not owned) that are absent are kept."""
    o = old.select(*key, F.col(hash_column).alias("_old"), owned.alias("_owned"))
    n = new.select(*key, F.col(hash_column).alias("_new"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), F.when(F.col("_owned"), "deleted").otherwise("kept")).when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(*key, action.alias("action"))


def replace_partition(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the new rows' keys give way to the new rows."""
    return without(stored, new, key).unionByName(new)


def guarded_update(stored: DataFrame, changes: DataFrame, key: str, status: str = "status", open_states: tuple = ("queued", "running")) -> DataFrame:
    """Status changes apply only to rows still open, so a cancelled job stays cancelled."""
    change = changes.select(key, F.col(status).alias("_to"))
    out = stored.join(change, key, "left")
    return out.withColumn(status, F.when(F.col("_to").isNotNull() & F.col(status).isin(*open_states), F.col("_to")).otherwise(F.col(status))).select(*stored.columns)


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``graph_hash``: digest of all facts whatever their order.

    Every fact is digested; the digests' eight 32-bit words are added up over all facts, and the sums and the
    number of facts digested.  Sums add up before the shuffle, so no task holds a list of facts.
    """
    lines = nodes.select(F.concat_ws(" ", F.lit("n"), "id", "label", "hash").alias("l")).unionAll(edges.select(F.concat_ws(" ", F.lit("e"), "src", "label", "dst", "hash").alias("l")))
    digests = lines.select(F.sha2("l", 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")) for k in range(8)]
    return digests.agg(F.count("*").alias("n"), *[w.alias(f"w{k}") for k, w in enumerate(words)]).select(F.sha2(F.concat_ws(" ", "n", *[F.coalesce(F.col(f"w{k}").cast("string"), F.lit("0")) for k in range(8)]), 256).alias("graph_hash"))


def ordered_merge(*sources: DataFrame) -> DataFrame:
    """Rows of the first source first (``id, ord``), each id once, where it comes first."""
    every = None
    for k, s in enumerate(sources):
        s = s.select("id", F.struct(F.lit(k).alias("source"), F.col("ord").cast("long").alias("ord")).alias("at"))
        every = s if every is None else every.unionAll(s)
    return every.groupBy("id").agg(F.min("at").alias("at")).select("id", "at.source", "at.ord")


def numbered(df: DataFrame, key: str, form: str) -> DataFrame:
    """Presentational ids (``ref``) in the order of a unique `key`: ``{form % n}``."""
    return running(df, F.lit(1), "_n", key).withColumn("ref", F.format_string(form, F.col("_n").cast("bigint"))).drop("_n")


#: The stored layout's version; a graph written under another is thrown away.
VERSION_FILE = "schema_version"


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Store a graph as Parquet, partitioned by label, with the version of its layout."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        df.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/{name}")
    nodes.sparkSession.createDataFrame([(SCHEMA_VERSION,)], "version int").write.mode("overwrite").parquet(f"{folder}/{VERSION_FILE}")


def stored_version(spark: SparkSession, folder: str) -> int | None:
    """The version that a stored graph was written under; null where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{VERSION_FILE}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{folder}/{VERSION_FILE}").agg(F.max("version")).first()[0]


def read_graph(spark: SparkSession, folder: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """A stored graph; one of another version, or none, is empty: the graph can always be made again from its sources."""
    if stored_version(spark, folder) != SCHEMA_VERSION:
        return spark.createDataFrame([], node_schema), spark.createDataFrame([], edge_schema)
    return spark.read.schema(node_schema).parquet(f"{folder}/nodes"), spark.read.schema(edge_schema).parquet(f"{folder}/edges")


def cleared(*frames: DataFrame) -> list[DataFrame]:
    """The frames without rows."""
    return [df.where(F.lit(False)) for df in frames]
