"""Stupid-backoff language-model scores, computed relationally (operator 7).

Words are maximal runs of characters other than ASCII white space, A-Z lower-cased.  Counts of all n-grams up to
`order` over the whole corpus.  A document is scored by the counts of all other text, so its own occurrences are taken
off: a word w after context c scores count(c w) / count(c) where that n-gram occurs elsewhere, else BACKOFF times
the score after the shorter context; a single word scores count(w) / N, with N the words elsewhere, and 1 / N where it
occurs nowhere else.  A document's score is the mean natural logarithm over its words.

Relations: the corpus is dealt into chunks of documents.  A chunk explodes its n-grams and pre-aggregates them;
what is shuffled are not single rows but blocks: the sorted distinct hashes, with counts, that one chunk has in one
hash bucket.  The count table is partitioned by these buckets: each bucket adds up what all chunks hold of it
and joins the totals back to each chunk's block.  The totals, in the order of the block's hashes, meet their chunk's
documents again (the same shuffle of the texts is read twice), whose n-grams are looked up and summed per document.
Chunk and bucket numbers grow with the corpus, and so do partitions, so a task's memory and input do not.  Blocks are as
many as any shuffle has (chunks times buckets), and never more than the pre-aggregated n-grams.

N-grams are identified by 64-bit hashes.  Defined results: a document without words (or null) has n_words 0 and
a null score.  The table is read more than once and must have the same rows in each partition each time, as files do.  Repeated rows count, and score, each on its own: each is text elsewhere for the others.  Other columns do
not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import PLACE, U, blocks, mix, windows

#: Order 3 takes 4.7 times the input in shuffles, order 2 about 3.
ORDER = 2
BACKOFF = 0.4
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 8_000_000
#: Chunks or buckets in a partition where they would otherwise be more.
TOGETHER = 8
_BLOCK = "chunk long, bucket long, keys binary, counts binary"


def _ngrams(column: pa.Array, order: int) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For blocks of texts: the first row's number, and for each n the n-gram hashes and where each text's begin."""
    for block in blocks(column):
        words, at = block.words()
        out = [windows(words, at, 1)]
        for n in range(2, order + 1):
            hashes, begin = windows(words, at, n)
            short = np.diff(at) < n  # a shorter text has no n-gram
            if short.any():
                keep = np.repeat(~short, np.diff(begin))
                hashes = hashes[keep]
                begin = np.concatenate([[0], np.cumsum(np.where(short, 0, np.diff(begin)))])
            out.append((hashes, begin))
        yield block.first, out


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, each in as many bytes as the largest needs; first all lowest bytes, then the next ..."""
    gaps = np.diff(keys, prepend=U(0))
    gaps[0] = 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    gaps = np.zeros((len(data) - 9) // width, dtype=U)
    gaps.view(np.uint8).reshape(-1, 8)[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(width, -1).T
    gaps[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(gaps, dtype=U)


def _narrow(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _chunk_counts(order: int, buckets: int):
    """The blocks of one chunk."""

    def counts(key: tuple, table: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[] for _ in range(order)]
        for _, grams in _ngrams(table.column("text"), order):
            for n in range(order):
                found[n].append(grams[n][0])
        rows: dict[str, list] = {"bucket": [], "keys": [], "counts": []}
        for n in range(order):
            keys, count = np.unique(np.concatenate(found[n]), return_counts=True) if found[n] else (np.zeros(0, U), np.zeros(0, np.int64))
            bucket = (keys >> U(40)) * U(buckets) >> U(24)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
            for a, z in zip(first, np.append(first[1:], len(keys)), strict=True) if len(keys) else ():
                rows["bucket"].append(int(bucket[a]) * order + n)
                rows["keys"].append(_packed(keys[a:z]))
                rows["counts"].append(_narrow(count[a:z]))
        chunk = pa.array([key[0].as_py()] * len(rows["bucket"]), pa.int64())
        return pa.Table.from_arrays([chunk, pa.array(rows["bucket"], pa.int64()), pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary())], ["chunk", "bucket", "keys", "counts"])

    return counts


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket of the count table, joined back to every chunk's block."""
    keys = [_unpacked(x.as_py()) for x in table.column("keys")]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate([_wide(x.as_py()) for x in table.column("counts")]), minlength=len(distinct)).astype(np.int64)
    out, at = [], 0
    for k in keys:
        out.append(_narrow(totals[place[at : at + len(k)]]))
        at += len(k)
    return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array(out, pa.binary())], ["chunk", "bucket", "counts"])


def _elsewhere(total: np.ndarray, hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Total counts of the n-grams of some texts without those in the n-gram's own text."""
    owner = np.repeat(np.arange(len(begin) - 1, dtype=np.int64), np.diff(begin))
    _, place, count = np.unique(mix(hashes + owner.astype(U) * PLACE[9]), return_inverse=True, return_counts=True)
    return total - count[place]


def _scored(order: int, words: int):
    def scored(key: tuple, docs: pa.Table, table: pa.Table) -> pa.Table:
        grams_of = [grams for _, grams in _ngrams(docs.column("text"), order)]
        blocks_of = sorted(zip(table.column("bucket").to_pylist(), table.column("counts").to_pylist(), strict=True))
        known = []
        for n in range(order):
            keys = np.unique(np.concatenate([grams[n][0] for grams in grams_of])) if grams_of else np.zeros(0, U)
            counts = [_wide(c) for bucket, c in blocks_of if bucket % order == n]
            known.append((keys, np.concatenate(counts) if counts else np.zeros(0, np.int64)))
        count, score = [], []
        for grams in grams_of:
            found = [_elsewhere(known[n][1][np.searchsorted(known[n][0], grams[n][0])], *grams[n]) if len(grams[n][0]) else np.zeros(0, np.int64) for n in range(order)]
            at = grams[0][1]
            size = np.diff(at)
            rest = np.repeat(np.maximum(words - size, 1), size)
            logs = np.log(np.maximum(found[0], 1) / rest)
            for n in range(1, order):
                begin = grams[n][1]
                # n-gram i of a text ends at its word i + n and has the (n)-gram i before as context
                owner = np.repeat(np.arange(len(at) - 1), np.diff(begin))
                inside = np.arange(len(owner)) - begin[owner]
                end = at[owner] + inside + n
                context = found[n - 1][grams[n - 1][1][owner] + inside]
                logs[end] = np.where(found[n] > 0, np.log(np.maximum(found[n], 1) / np.maximum(context, 1)), logs[end] + np.log(BACKOFF))
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            count.append(size)
            score.append(np.where(size > 0, (sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1), np.nan))
        n = np.concatenate(count) if count else np.zeros(0, np.int64)
        s = np.concatenate(score) if score else np.zeros(0)
        return pa.Table.from_arrays([docs.column("doc_id"), pa.array(n, pa.int64()), pa.array(s, pa.float64(), from_pandas=True)], ["doc_id", "n_words", "score"])

    return scored


def _dealt(df: DataFrame, column: str, groups: int) -> DataFrame:
    """By the column, in more partitions than usual where there would be more than TOGETHER groups in one."""
    need = -(-groups // TOGETHER)
    return df.repartition(need, column) if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def backoff_scores(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, score`` for every document, with counts from all of them."""
    # rows are numbered where they are read, so copies of one row are dealt to all chunks
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = docs.select(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    chunks = max(1, -(-(size["bytes"] or 0) // CHUNK_BYTES))
    buckets = max(1, -(-(size["bytes"] or 0) // BUCKET_BYTES))
    dealt = _dealt(docs.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks))).drop("row"), "chunk", chunks)
    parts = _dealt(dealt.groupBy("chunk").applyInArrow(_chunk_counts(order, buckets), _BLOCK), "bucket", buckets * order)
    totals = parts.groupBy("bucket").applyInArrow(_totals, "chunk long, bucket long, counts binary")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scored(order, max(1, size["words"] or 0)), schema)
