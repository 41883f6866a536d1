"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 5).

Grades: 0 poor text (labels.quality = 0), 1 well written but toxic, 2 well written and clean.  One weight vector
over hashed features is shared by all grades; ordered thresholds turn the score s into
P(grade > k) = sigmoid(s - t_k).  Out come the expected grade and, for selection, the tail probability
P(grade = 2).  A document is kept if that is at least KEEP.

Features of a whole text: presence of each lower-cased word of letters and of its stems (hashed), and of level features
(hashed alike): how often symbols, capitals, digits, short lines, repeated words, equal neighbours and repeated
lines occur, each share put on a logarithmic scale of levels.

Training uses one text each of the labelled documents with the SAMPLE smallest hashes of doc_id (the documented bound; all of
them where there are fewer); their features, not their texts, go to the driver, which fits by full-batch adaptive
gradient steps.  Ratings outside 0 and 1 or null leave a row out; of contradictory ratings of a document the lowest grade
counts.  Without any labelled rows every document gets the even odds of an unfitted model and all are kept.

Defined results: a null text is the empty text and is rejected (tail probability 0); an empty table gives none.  Texts
of any length are read whole.  Repeated rows have equal results.  Other columns, whatever their names, are kept by
`accepted` and ignored by `graded`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LETTERS, PLACE, Block, U, blocks, mix
from .memory import give_back, giving_back
from .workspace import dropped, small, written

SAMPLE = 8_000
WIDTH = 1 << 20
#: Word beginnings, in bytes, that are features beside the words: stems show a kind of word in all its forms.
STEMS = (4, 5, 6)
KEEP = 0.4
STEPS = 200
RIDGE = 2e-4
LEAST_COUNT = 6
#: A feature is used if its association with a boundary between grades is both significant (score of the test) and strong
#: (correlation), and if it occurs in LEAST_COUNT labelled texts: three constants, however many are labelled.
SCREEN, STRENGTH = 5.0, 0.09
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]).astype(float)


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys = np.sort(mix(hashes + owner.astype(U) * PLACE[9]))
    order = np.argsort(mix(hashes + owner.astype(U) * PLACE[9]), kind="stable")
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    return np.bincount(owner[order][first], minlength=len(at) - 1).astype(float)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below WIDTH, distinct within each text, and where each text's begin."""
    begin, finish = block.bounds(LETTERS[block.buf])
    sums = block.prefix(True)
    words, at = block.stretch(sums, begin, finish), np.searchsorted(begin, block.off)
    stems = [mix(block.stretch(sums, begin, np.minimum(finish, begin + k)) + PLACE[12]) for k in STEMS]
    n = block.n
    size = np.maximum(np.diff(block.off), 1)
    count = np.maximum(np.diff(at), 1)
    raw, raw_at = block.words(True)
    raw_count = np.maximum(np.diff(raw_at), 1)
    same = np.concatenate([raw[1:] == raw[:-1], [False]]) if len(raw) else np.zeros(0, dtype=bool)
    if len(raw):
        ends = raw_at[1:][np.diff(raw_at) > 0] - 1
        same[ends] = False
    start, end = block.bounds(block.buf != 10)
    lines = block.stretch(sums, start, end)
    line_at = np.searchsorted(start, block.off)
    shares = [
        _per_text(_SYMBOL[block.buf], block.off) / size,
        _per_text(_UPPER[block.buf], block.off) / size,
        _per_text(_DIGIT[block.buf], block.off) / size,
        _per_text(same, raw_at) / raw_count,
        1 - _distinct(words, at) / count,
        1 - _distinct(lines, line_at) / np.maximum(np.diff(line_at), 1),
        _per_text(block.buf == 10, block.off) / size,
        1 / count,
        count / size,
    ]
    levels = np.stack([np.clip(np.round(2 * np.log2(np.maximum(s, 1e-6))), -40, 10) + 64 for s in shares], axis=1).astype(U)
    levels = mix(levels * PLACE[10] + np.arange(len(shares), dtype=U) * PLACE[11])
    of_word = np.repeat(np.arange(n), np.diff(at))
    owner = np.concatenate([of_word] * (1 + len(STEMS)) + [np.repeat(np.arange(n), len(shares))])
    number = (np.concatenate([words, *stems, levels.ravel()]) % U(WIDTH)).astype(np.int64)
    both = np.unique(owner * WIDTH + number)
    return (both % WIDTH).astype(np.int32), np.searchsorted(both, np.arange(n + 1) * WIDTH)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            number, at = features(block)
            lists = [number[at[i] : at[i + 1]].astype("<i4").tobytes() for i in range(block.n)]
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(block.first, block.n), pa.array(lists, pa.binary())], ["grade", "features"])


def fit(grades: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the two ordered thresholds that maximise the penalised likelihood."""
    weights, cuts = np.zeros(WIDTH), np.array([-1.0, 1.0])
    if not len(grades):
        return weights, np.array([0.0, 0.0])
    above = np.stack([grades > 0, grades > 1]).astype(float)
    # screening: only features whose presence is associated with a boundary between grades, by a score test; some texts at a time
    some = [slice(k, k + 500) for k in range(0, len(lists), 500)]
    of = lambda part: np.repeat(np.arange(part.start, min(part.stop, len(lists)), dtype=np.int32), [len(x) for x in lists[part]])
    count, seen = np.zeros(WIDTH), np.zeros((2, WIDTH))
    for part in some:
        flat, owner = np.concatenate(lists[part]), of(part)
        count += np.bincount(flat, minlength=WIDTH)
        for k in range(2):
            seen[k] += np.bincount(flat, weights=above[k][owner], minlength=WIDTH)
    strongest = np.zeros(WIDTH)
    for k, rate in enumerate(above.mean(1)):
        spread = np.sqrt(np.maximum(count * rate * (1 - rate) * (1 - count / len(grades)), 1e-9))
        strongest = np.maximum(strongest, np.abs(seen[k] - count * rate) / np.maximum(spread, 0.5))
    chosen = np.flatnonzero((strongest >= SCREEN) & (strongest / np.sqrt(len(grades)) >= STRENGTH) & (count >= LEAST_COUNT))
    place = np.full(WIDTH, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    del seen, strongest, count
    flats, owners, width = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], len(chosen)
    for part in some:
        flat, owner = place[np.concatenate(lists[part])], of(part)
        flats.append(flat[flat >= 0])
        owners.append(owner[flat >= 0])
    flat, owner = np.concatenate(flats), np.concatenate(owners)
    del flats, owners, place
    part = np.zeros(width)
    share = np.array([np.mean(grades == g) for g in range(3)])
    weight = np.clip(1 / (3 * np.maximum(share, 1e-3)), 0.3, 3.0)[grades.astype(int)]
    first = second = np.zeros(width)
    cfirst = csecond = np.zeros(2)
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, weights=part[flat], minlength=len(grades))
        error = [(1 / (1 + np.exp(-np.clip(score - c, -30, 30))) - y) * weight for c, y in zip(cuts, above, strict=True)]
        slope = np.bincount(flat, weights=(error[0] + error[1])[owner], minlength=width) / len(grades) + RIDGE * part
        cslope = np.array([-e.mean() for e in error])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        cfirst, csecond = 0.9 * cfirst + 0.1 * cslope, 0.99 * csecond + 0.01 * cslope**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        part = part - 0.05 * fix * first / (np.sqrt(second) + 1e-5)
        cuts = np.sort(cuts - 0.05 * fix * cfirst / (np.sqrt(csecond) + 1e-5))
    weights[chosen] = part
    return weights, cuts


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of every labelled document; of contradictory ratings the lowest grade counts."""
    rated = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    return rated.groupBy("doc_id").agg(F.min(F.expr("if(quality = 0, 0, if(toxic = 1, 1, 2))")).alias("grade"))


def one_text_each(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """``grade, text`` of each chosen (``doc_id, grade``) document: of several rows with its id the text with the smallest hash."""
    met = documents.select("doc_id", "text").where("text is not null").join(small(chosen, SAMPLE), "doc_id")
    return met.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row")).select("grade", "row.text")


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the labelled documents with the SAMPLE smallest hashes of doc_id."""
    chosen = written(grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labels")
    docs = one_text_each(documents, chosen)
    rows = docs.mapInArrow(giving_back(_featured), "grade int, features binary").collect()
    dropped(chosen)
    rows.sort(key=lambda r: (r.grade, r.features))  # the same fit whatever the row order
    model = fit(np.array([r.grade for r in rows], dtype=np.int64), [np.frombuffer(r.features, dtype="<i4") for r in rows])
    del rows
    give_back()  # of the driver
    return model


def graded(documents: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (doc_id if not given) with ``expected_grade, p_good, kept`` for every document."""
    weights, cuts = train(documents, labels)
    model = (weights.astype(np.float32), cuts)
    names = columns or ["doc_id"]
    whole = documents.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = model
        for batch in batches:
            scores = []
            for block in blocks(batch.column(len(names))):
                number, at = features(block)
                scores.append(_per_float(weights[number], at))
            score = np.concatenate(scores) if scores else np.zeros(0)
            over = [1 / (1 + np.exp(-np.clip(score - c, -500, 500))) for c in cuts]
            empty = np.array([v is None or v == 0 for v in pa.compute.utf8_length(batch.column(len(names))).to_pylist()], dtype=bool)
            good = np.where(empty, 0.0, over[1])
            grade = np.where(empty, 0.0, over[0] + over[1])
            arrays = [batch.column(k) for k in range(len(names))] + [pa.array(grade, pa.float64()), pa.array(good, pa.float64()), pa.array(good >= KEEP, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "expected_grade", "p_good", "kept"])

    from pyspark.sql import types as T

    schema = T.StructType([*whole.schema.fields[: len(names)], T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return whole.mapInArrow(giving_back(scored), schema)


def _per_float(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    columns = documents.columns
    nested = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return graded(nested, labels, ["row"]).where("kept").select("row.*")
