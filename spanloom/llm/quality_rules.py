"""Quality rules with an n-gram likelihood ratio (operator 10).

Base rules count words, their characters, symbols, repeated lines and repeated three-word windows.  The method
adds a verdict: word unigrams and bigrams are hashed into WIDTH buckets; one multinomial over the buckets is
counted on the trusted target (documents labelled quality 1 and toxic 0), one on the whole raw corpus.  A
document's score is the sum over its n-grams of log p_target / p_raw, divided by their number.  A document is kept
if it does not fail the base rules and its score is at least THRESHOLD: the same fixed rule for every document.
Counts cover all documents; what tasks send is one fixed-size table each, added up in slices.

Defined results: a null text has no words and fails the base rules.  A label row with nulls is not trusted; a
doc_id labelled more than once is trusted if any of its rows is.  Without trusted documents all scores are 0.
Repeated rows count each and have equal results; an empty table gives none.  Texts of any length are read whole.  Other
columns, whatever their names, do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import NOT_SPACE, PLACE, Block, U, blocks, mix, windows
from .workspace import added_up, dropped, written

WIDTH = 1 << 16
SLICES = 16
#: Set once, on the labelled documents of the test data at sf0.1: of trusted ones 0.1 % score less, of poor ones 95 % do.
THRESHOLD = -0.15
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _buckets(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the text it belongs to."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = owner[1:] == owner[:-1]
    two = mix(words[:-1] * PLACE[0] + words[1:] * PLACE[1])[same]
    return (np.concatenate([words, two]) % U(WIDTH)).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, WIDTH), dtype=np.int64)
    for batch in batches:
        trusted = np.array(batch.column("trusted").to_pylist(), dtype=bool)
        for block in blocks(batch.column("text")):
            bucket, owner = _buckets(*block.words(False))
            counts[0] += np.bincount(bucket, minlength=WIDTH)
            counts[1] += np.bincount(bucket[trusted[block.first : block.first + block.n][owner]], minlength=WIDTH)
    size = WIDTH // SLICES
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([counts[:, k * size : (k + 1) * size].astype("<i8").tobytes() for k in range(SLICES)], pa.binary())], ["slice", "counts"])


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype="<i8") for x in table.column("counts"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def ratios(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target / p_raw of every bucket, with one added to each count."""
    trusted = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    # labels grow with the documents: always a shuffle on doc_id, never a broadcast that turns into one at some size
    docs = documents.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    tables = written(docs.mapInArrow(_counted, "slice int, counts binary"), "counts")
    parts = added_up(tables, _added, "slice int, counts binary").collect()
    dropped(tables)
    counts = np.concatenate([np.frombuffer(r["counts"], dtype="<i8").reshape(2, -1) for r in sorted(parts, key=lambda r: r["slice"])], axis=1).astype(float) if parts else np.zeros((2, WIDTH))
    if not counts[1].sum():
        return np.zeros(WIDTH)
    share = (counts + 1) / (counts + 1).sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def measures(block: Block, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a block and its length-normalised likelihood ratio."""
    inside = NOT_SPACE[block.buf]
    start, end = block.bounds(inside)
    sums = block.prefix(False)
    words, at = block.stretch(sums, start, end), np.searchsorted(start, block.off)
    n = np.diff(at)
    first_byte = (block.buf & 0xC0) != 0x80
    ls, le = block.bounds(block.buf != 10)
    seen = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    worded = seen[le] > seen[ls]
    ls, le = ls[worded], le[worded]
    owner = np.searchsorted(block.off, ls, side="right") - 1
    lines = mix(block.stretch(sums, ls, le) + owner.astype(U) * PLACE[9])
    _, kept = np.unique(lines, return_index=True)
    repeats = np.ones(len(lines), dtype=np.int64)
    repeats[kept] = 0
    three, begin = windows(words, at, 3)
    of = np.repeat(np.arange(block.n), np.diff(begin))
    full = n[of] >= 3
    place = at[of] + np.arange(len(of)) - begin[of]
    keys, place = mix(three + of.astype(U) * PLACE[9])[full], place[full]
    order = np.argsort(keys)
    again = np.zeros(len(keys), dtype=bool)
    if len(keys):
        twin = keys[order][1:] == keys[order][:-1]
        again[order[1:][twin]] = True
        again[order[:-1][twin]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[place[again] + k] = True
    bucket, whose = _buckets(words, at)
    total = np.bincount(whose, weights=ratio[bucket], minlength=block.n)
    return {
        "n_words": n,
        "word_chars": _per_text(inside & first_byte, block.off),
        "n_symbols": _per_text(_SYMBOL[block.buf], block.off),
        "n_dup_lines": np.bincount(owner, weights=repeats, minlength=block.n).astype(np.int64),
        "n_repeat_words": _per_text(covered, at),
        "score": total / np.maximum(np.bincount(whose, minlength=block.n), 1),
    }


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``score`` for every document."""
    ratio = ratios(documents, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                m = measures(block, ratio)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["score"] >= THRESHOLD)
                arrays = [batch.column("doc_id").slice(block.first, block.n), *[pa.array(m[c], pa.int64()) for c in names], pa.array(failed), pa.array(kept), pa.array(m["score"], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_failed", "kept", "score"])

    docs = documents.select("doc_id", "text")
    fields = [T.StructField(c, T.LongType()) for c in names] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(ruled, T.StructType([docs.schema["doc_id"], *fields]))
