"""Benchmark decontamination by a broadcast set of n-gram hashes (operator 3; DataFrame functions only).

Method: the windows of 13 normalised words of every benchmark item (a shorter item is one window) are hashed.  Of any
window of L words, one aligned run of (L + 1) // 2 words lies on a multiple of that length, so each document is first
scanned for aligned runs only: their hashes are looked up in the set of the runs of all windows, which travels with the
plan as a constant hash set.  Documents with such a run, and only they, have all their windows hashed and joined to the
broadcast windows; hits are verified word for word.

Sizes are counted first.  With more than SET_RUNS runs, the aligned runs of the documents are joined to the runs instead
of looked up; windows beyond SET_WINDOWS or SET_BYTES are joined by a shuffle instead of broadcast.  Both give the same
rows, at any size of the benchmark.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters from U+0080 on.  Defined results: a
null or wordless text has no words and no hits, nor has a null or wordless item.  Repeated rows give repeated
results; items that share an item_id count once.  Null item ids hit but are not listed.  Texts of any length are scanned
whole.  Other columns of the documents, whatever their names, are kept by `decontaminated` and ignored by `contamination`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import dropped, small, written

N = 13
#: Bounds of what is shipped to every task: hashes in the set, windows in the broadcast and their bytes.
SET_RUNS, SET_WINDOWS, SET_BYTES = 50_000, 200_000, 32 << 20
#: Contaminated rows are broadcast by their numbers up to so many.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _half(length: int) -> int:
    return (length + 1) // 2


def _aligned(w: Column, half: int) -> Column:
    """Hashes of the runs of `half` words that begin at multiples of `half`."""
    last = F.floor((F.size(w) - half) / half).cast("int")
    return F.when(F.size(w) >= half, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i * half + 1, half)))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame) -> DataFrame:
    """The distinct windows: ``length, window`` (words joined by spaces), ``items`` (sorted ids), ``whole`` (its hash)
    and ``parts`` (the hashes of its runs of (length + 1) // 2 words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(N))
    at = items.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("i"))
    sets = at.groupBy("length", F.expr("slice(w, i, length)").alias("w")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    parts = F.expr("transform(sequence(1, length - cast((length + 1) div 2 as int) + 1), i -> xxhash64(slice(w, i, cast((length + 1) div 2 as int))))")
    return sets.select("length", F.array_join("w", " ").alias("window"), "items", F.xxhash64("w").alias("whole"), parts.alias("parts"))


class Scan:
    """Documents (one text and some columns to carry) held against a benchmark.

    ``rows`` (``rid``, the carried columns, ``n_words``) has a row for every document, and ``verdicts`` one for each that was
    hit: ``rid, n_hit, items, hits, contaminated``.  rid is a number written with the row, so it holds when tasks run again.
    """

    def __init__(self, documents: DataFrame, carried: list[Column], text: Column, benchmark: DataFrame):
        self.known = written(windows(benchmark), "windows")
        size = self.known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window") + 16 * F.size("items")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("runs")).first()
        self.lengths = sorted(r.length for r in self.known.select("length").distinct().collect())  # N at most
        plain = documents.select(*carried, words(text).alias("_w")).withColumn("n_words", F.size("_w"))
        scanned = self._by_set(plain) if size.runs <= SET_RUNS else plain
        table = written(scanned.withColumn("rid", F.monotonically_increasing_id()), "scan")
        self.rows = table.drop("_w")
        asked = table.where("_w is not null").select("rid", "_w")
        if size.runs > SET_RUNS:
            asked = asked.join(self._by_join(asked), "rid", "left_semi")
        self.known = F.broadcast(self.known) if size.n <= SET_WINDOWS and size.bytes <= SET_BYTES else self.known
        self.verdicts = written(self._verdicts(asked, self.rows), "verdicts")

    def _by_set(self, plain: DataFrame) -> DataFrame:
        """With the words only of documents that have an aligned run of the benchmark's."""
        maybe, columns = F.lit(False), plain.columns
        for half in sorted({_half(x) for x in self.lengths}):
            mine = [x for x in self.lengths if _half(x) == half]
            runs = self.known.where(F.col("length").isin(mine)).select(F.explode("parts").alias("p")).distinct().collect()  # SET_RUNS at most
            held = ", ".join(f"{r.p}L" if r.p > -(1 << 63) else "cast('-9223372036854775808' as bigint)" for r in runs)
            plain = plain.withColumn(f"_runs{half}", F.when(F.size("_w") >= min(mine), _aligned(F.col("_w"), half)).otherwise(F.array().cast("array<bigint>")))
            maybe = maybe | F.expr(f"exists(_runs{half}, h -> h in ({held}))")
        return plain.withColumn("_w", F.when(maybe, F.col("_w"))).select(*columns)

    def _by_join(self, asked: DataFrame) -> DataFrame:
        """The numbers of documents that have an aligned run of the benchmark's."""
        runs = self.known.select(F.expr("cast((length + 1) div 2 as int)").alias("half"), F.explode("parts").alias("run")).distinct()
        halves = sorted({_half(x) for x in self.lengths})
        each = [asked.select("rid", F.lit(h).alias("half"), F.explode(F.array_distinct(_aligned(F.col("_w"), h))).alias("run")) for h in halves]
        return reduce(DataFrame.unionAll, each).join(runs, ["half", "run"], "left_semi").select("rid").distinct()

    def _verdicts(self, asked: DataFrame, rows: DataFrame) -> DataFrame:
        found = None
        for length in self.lengths:
            at = asked.where(F.size("_w") >= length).select("rid", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("start"))
            cut = F.slice("_w", F.col("start"), length)
            here = at.select("rid", "start", F.xxhash64(cut).alias("whole"), F.array_join(cut, " ").alias("_words"))
            hits = here.join(self.known.where(F.col("length") == length).select("whole", "window", "items"), "whole").where("_words = window")
            hits = hits.select("rid", F.struct("start", (F.col("start") + length).alias("end"), "items").alias("hit"))
            found = hits if found is None else found.unionAll(hits)
        if found is None:
            none = F.lit(None).cast("struct<start:int,end:int,items:array<string>>")
            found = asked.limit(0).select("rid", none.alias("hit"))
        told = found.groupBy("rid").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
        covered = F.aggregate("hits", start, lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["start"]))).alias("n")), lambda a: a["n"])
        told = told.select("rid", "hits", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"))
        return told.join(rows.select("rid", "n_words"), "rid").select("rid", "n_hit", "items", "hits", (20 * F.col("n_hit") >= F.col("n_words")).alias("contaminated"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    scan = Scan(documents, [F.col("doc_id")], F.col("text"), benchmark)
    out = scan.rows.join(scan.verdicts, "rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, start, end, items``: each occurrence of a window, in words from 1 on, end exclusive."""
    scan = Scan(documents, [F.col("doc_id")], F.col("text"), benchmark)
    return scan.rows.join(scan.verdicts, "rid").select("doc_id", F.inline("hits"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that are contaminated; all columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    scan = Scan(documents, [row.alias("row")], F.col("text"), benchmark)
    gone = written(scan.verdicts.where("contaminated").select("rid"), "contaminated")
    dropped(scan.verdicts)
    return scan.rows.join(small(gone, BROADCAST_ROWS), "rid", "left_anti").select("row.*")
