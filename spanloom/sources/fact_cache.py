"""Facts of files that are kept between runs: a file is parsed again only if its text or the extractors have changed.

One Parquet table, partitioned by a bucket of repository and path, holds the facts and, for every file, a row of kind
``parsed`` with the digest of its text and the extractors' version.  A refresh compares digests by a join, parses what has none
that is equal, and writes anew only buckets in which a file came, changed or went; a bucket's rows are replaced by one commit
of a dynamic partition overwrite, so facts and digests never disagree.  Facts carry no commit, so an unchanged file's rows need none retargeted.

Defined results: of repeated rows of one file one counts, that with the smallest digest; a null text is the empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import counted, dropped, written
from ..operators.store import first_by
from .extractors import FACTS, facts

#: Raised with every change of what the extractors yield.
VERSION = 2
BUCKETS = 256
_STORED = f"{FACTS}, digest string, version int, bucket int"
_FILE = ["repo", "path"]


class FactCache:
    """The facts under a folder (a URI that driver and executors share)."""

    def __init__(self, spark: SparkSession, folder: str, version: int = VERSION, buckets: int = BUCKETS):
        self.spark, self.folder, self.version, self.buckets = spark, folder, version, buckets

    def _stored(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(self.folder)

    def read(self) -> DataFrame:
        """FACTS of all files of the last refresh."""
        return self._stored().where("kind not in ('parsed', 'bucket')").select(*[c.split()[0] for c in FACTS.split(", ")])

    def refresh(self, files: DataFrame) -> dict[str, int]:
        """Make the facts those of `files` (``repo, path, text``): how many files were parsed, reused and dropped."""
        text = F.coalesce("text", F.lit(""))
        now = first_by(files.select(*_FILE, text.alias("text"), F.sha2(text, 256).alias("digest")), _FILE, "digest", "text")
        now = now.withColumn("bucket", F.pmod(F.xxhash64(*_FILE), F.lit(self.buckets)).cast("int"))
        stored = self._stored()
        old = written(stored.where("kind = 'parsed'").select(*_FILE, "digest", "version", "bucket"), "parsed")
        same = old.where(F.col("version") == self.version)
        changed, parsed = counted(now.join(same.select(*_FILE, "digest"), [*_FILE, "digest"], "left_anti"), "changed")
        kept, reused = counted(same.join(now.select(*_FILE, "digest"), [*_FILE, "digest"], "left_semi"), "kept")
        gone, left = counted(old.join(now.select(*_FILE), _FILE, "left_anti"), "gone")
        if parsed or left:
            dirty = written(changed.select("bucket").unionAll(gone.select("bucket")).distinct(), "dirty")  # at most as many as buckets
            still = stored.where("kind <> 'bucket'").join(F.broadcast(dirty), "bucket", "left_semi").join(kept.select(*_FILE, "digest"), [*_FILE, "digest"], "left_semi")
            none = {c: F.lit(None) for c in ("language", "name", "detail", "owner", "byte_start", "byte_end")}
            mark = changed.select(*_FILE, "digest", "bucket").withColumns(none).withColumn("kind", F.lit("parsed"))
            # a bucket whose last file went is still written
            empty = dirty.withColumns(none | {"repo": F.lit(None), "path": F.lit(None), "digest": F.lit(None)}).withColumn("kind", F.lit("bucket"))
            fresh = facts(changed).join(changed.select(*_FILE, "digest", "bucket"), _FILE)
            kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], _STORED).schema}
            shaped = lambda df: df.withColumn("version", F.lit(self.version)).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
            rows = written(shaped(still).unionByName(shaped(fresh)).unionByName(shaped(mark)).unionByName(shaped(empty)), "buckets")
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)
            dropped(dirty, rows)
        dropped(old, changed, kept, gone)
        return {"parsed": parsed, "reused": reused, "dropped": left}
